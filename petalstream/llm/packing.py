"""Filling containers of fixed capacity: best fit in each partition, and a tree of merges of what is left underfull."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petalstream.plans.session import cut

BIN = "members array<struct<key:long,piece:long,n:long>>, fill long, done boolean"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Places in containers, largest item first, each into the fullest container that still takes it.

    Residual room is a small integer, so the open containers stand in one stack for each amount of room, and the bits of one number tell
    which stacks hold any.
    """
    out: list[list[int]] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    held = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        fitting = held >> s
        if fitting:
            room = s + (fitting & -fitting).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                held &= ~(1 << room)
            out[b].append(i)
        else:
            room, b = capacity, len(out)
            out.append([i])
        left = room - s
        if left:
            stacks[left].append(b)
            held |= 1 << left
    return out


def _round(capacity: int, full: int, at_once: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs containers into containers, at most about `at_once` members at a time. Members stay in Arrow's columns; only fills are looked at."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        members = table.column("members").chunk(0)
        starts = members.offsets.to_numpy()
        fills = table.column("fill").to_numpy()
        bins = best_fit(fills.tolist(), capacity)
        order = np.fromiter((i for b in bins for i in b), dtype=np.int64, count=len(fills))
        ends = np.cumsum([len(b) for b in bins])
        sizes = (starts[1:] - starts[:-1])[order]
        upto = np.cumsum(sizes)
        at = np.arange(upto[-1]) + np.repeat(starts[:-1][order] - (upto - sizes), sizes)
        offsets = np.concatenate([[0], upto[ends - 1]])
        fill = np.add.reduceat(fills[order], np.concatenate([[0], ends[:-1]]))
        values = members.values.take(pa.array(at))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.array(fill, pa.int64()), pa.array(fill >= full)], ["members", "fill", "done"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += len(b.column("members").flatten())
            if n >= at_once:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    return run


def pack(df: DataFrame, key: str, size: str, capacity: int = 2048, slack: float = 0.005, fan: int = 8, at_once: int = 200_000, gain: float = 0.005) -> DataFrame:
    """(key, piece, size, start, container): the container of each item, or of each piece of an item larger than the capacity.

    Such an item is cut into full pieces and a rest, numbered from 0; no other item is split; `start` is the piece's place in its item.
    Items are mixed by a hash first. Each partition packs by best fit and gives out containers with at most `slack` of their room left; all underfull ones go on as items,
    `fan` partitions merging into one, until a single one is left. A task packs about `at_once` pieces at a time: where more than that are left,
    they are not merged into fewer partitions but mixed anew over as many as they need, and what is left is final when such a round spares less
    than `gain` of its containers. So no task grows with the data, and nothing is given out early. Every round is
    written to the shared folder and its input has a fixed order. Items without a size or of size 0 take no place and give no rows;
    items are told apart by (key, piece), so equal keys should not occur.
    """
    rest = F.col("n") % capacity
    pieces = df.select(F.col(key).cast("long").alias("key"), F.col(size).cast("long").alias("n")).where("n > 0")
    pieces = pieces.select("key", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / capacity) - 1)).alias("piece"))
    last = (F.col("piece") + 1) * capacity >= F.col("n")
    pieces = pieces.select("key", "piece", F.when(last & (rest > 0), rest).otherwise(capacity).alias("fill"))
    items = pieces.select(F.array(F.struct("key", "piece", F.col("fill").alias("n"))).alias("members"), "fill")
    full = capacity - int(capacity * slack)
    width = max(1, items.rdd.getNumPartitions())
    if width > 1:
        items = items.repartition(width, F.xxhash64(F.col("members")[0]))  # else sizes that lie together pack among themselves
    parts: list[DataFrame] = []
    before = None
    while True:
        ordered = items.sortWithinPartitions(F.desc("fill"), F.col("members")[0])
        found = cut(ordered.mapInArrow(_round(capacity, full, at_once), BIN))
        parts.append(found.where("done"))
        left = found.where("not done")
        n, members = left.agg(F.count("*"), F.coalesce(F.sum(F.size("members")), F.lit(0))).first()
        narrower = max(-(-width // fan), -(-members // at_once))
        spared = before is None or n <= before * (1 - gain)
        if not n or (width == 1 and narrower == 1) or (narrower >= width and not spared):
            parts.append(left)
            break
        before, width = n, narrower
        items = left.select("members", "fill").repartition(width, F.xxhash64(F.col("members")[0], F.lit(len(parts))))
    bins = parts[0]
    for p in parts[1:]:
        bins = bins.unionByName(p)
    bins = bins.select(F.monotonically_increasing_id().alias("container"), "members")
    placed = bins.select("container", F.explode("members").alias("m"))
    return placed.select(F.col("m.key").alias(key), "m.piece", F.col("m.n").alias(size), (F.col("m.piece") * capacity).alias("start"), "container")


def fills(placed: DataFrame, size: str, capacity: int = 2048) -> DataFrame:
    """(container, n_pieces, fill, room) of the rows of `pack`."""
    out = placed.groupBy("container").agg(F.count("*").alias("n_pieces"), F.sum(size).alias("fill"))
    return out.withColumn("room", capacity - F.col("fill"))
