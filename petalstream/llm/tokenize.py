"""Byte-pair encoding by a public vocabulary: a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import base64
import os
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the vocabulary files, in the form "base64(token) rank" a line.
VOCABULARIES = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
# Fixed value: the vocabulary's split of a text into words, numbers, other characters and white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = sys.maxsize


def load_ranks(name: str, folder: str | None = None) -> dict[bytes, int]:
    with open(os.path.join(folder or VOCABULARIES, name), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece.

    A leaf of the tree holds the rank of the pair that begins there, with the place in the low digits, so that the root is the leftmost
    pair of lowest rank. A merge changes three leaves, each in logarithmic time; the end is reached when no pair is in the vocabulary.
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end = list(range(1, n + 1))  # of the part that begins at each place
    before = list(range(-1, n))  # where the part before it begins

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
            k >>= 1

    while tree[1] != NONE:
        i = tree[1] % size
        j = end[i]  # the part merged into the one at i
        end[i] = e = end[j]
        if j < n:
            put(j, NONE)
        if e < n:
            before[e] = i
            rank = get(piece[i : end[e]])
            put(i, NONE if rank is None else rank * size + i)
        else:
            put(i, NONE)
        p = before[i]
        if p >= 0:
            rank = get(piece[p:e])
            put(p, NONE if rank is None else rank * size + p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def encoder(ranks: dict[bytes, int], remembered: int = 200_000) -> Callable[[str], list[int]]:
    """text -> ids. Pieces are remembered up to a number and 64 characters; the store is emptied when full, so its size is bounded."""
    import regex

    find = regex.compile(PATTERN).findall
    known: dict[str, list[int]] = {}

    def encode(text: str) -> list[int]:
        out: list[int] = []
        for piece in find(text):
            ids = known.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "replace")
                whole = ranks.get(raw)
                ids = [whole] if whole is not None else merge(raw, ranks)
                if len(piece) <= 64:
                    if len(known) >= remembered:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    return encode


def _shared(spark: SparkSession, vocabulary: str, folder: str | None) -> Broadcast:
    """The ranks at the executors: the vocabulary's file bounds their size."""
    return spark.sparkContext.broadcast(load_ranks(vocabulary, folder))


def token_ids(df: DataFrame, text: str, key: str, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(key, ids): the ids of every text without special tokens, whose strings are ordinary text. Null and empty texts: an empty list.

    One pass without a shuffle; rows keep their number, equal keys included.
    """
    shared = _shared(df.sparkSession, vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                ids = [encode(t) if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, text: str, key: str, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(key, n_tokens) of every text; 0 for null and empty ones."""
    shared = _shared(df.sparkSession, vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value)
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], [key, "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens long")
