"""Records that differ only in formatting: canonical keys, a range-partitioned external sort, and a scan of adjacent runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petalstream.functions.text import bare, col, compose, fold_case
from petalstream.plans.session import cut, shuffle_width, small, written

FIELD_END, PART_END = "\x1f", "\x1e"


def plain(c: Column | str) -> Column:
    """Composed and case-folded text; null is empty. White space and punctuation still stand."""
    return compose(fold_case(F.coalesce(col(c), F.lit(""))))


def bare_url(folded: Column) -> Column:
    """A folded URL's path, its query parameters in sorted order, and its fragment, each without space and punctuation."""
    whole = F.split(folded, "#", 2)
    halves = F.split(whole[0], r"\?", 2)
    params = F.split(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), "&")
    params = F.array_sort(F.filter(F.transform(params, bare), lambda p: p != ""))
    fragment = F.coalesce(F.get(whole, F.lit(1)), F.lit(""))
    return F.concat_ws(PART_END, bare(halves[0]), F.array_join(params, PART_END), F.lit(""), bare(fragment))


def with_key(df: DataFrame, url: str | None, fields: Sequence[str], key: str = "key") -> DataFrame:
    """Adds the canonical key of a record.

    Two records get the same key if the fields are equal once white space, letter case, punctuation, Unicode composition and the order
    of the URL's parameters are ignored; null equals empty. All text goes through one composing, folding and stripping expression, so
    the cost does not grow with the number of fields.
    """
    without_ends = lambda f: F.replace(F.replace(F.coalesce(F.col(f), F.lit("")), F.lit(FIELD_END), F.lit(" ")), F.lit(PART_END), F.lit(" "))
    df = df.withColumn("__text", plain(F.concat_ws(PART_END, *map(without_ends, fields))))
    if url:
        df = df.withColumn("__url", plain(without_ends(url)))
    # the separators are white space too, so they stand outside what is stripped: the fields' ends become U+FFFF first
    text = F.replace(bare(F.replace("__text", F.lit(PART_END), F.lit("\uffff"))), F.lit("\uffff"), F.lit(PART_END))
    out = df.withColumn(key, F.concat_ws(FIELD_END, bare_url(F.col("__url")), text) if url else text)
    return out.drop("__text", "__url")


def _scanner(singles: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal keys in a sorted partition, a row each: its first id, its other ids and, if the run may go on in another
        partition (its hash is the first or the last one), its key."""
        key, ids, first_hash, last_hash = None, [], None, None
        open_: list[tuple] = []  # the runs of the hash at hand: edges, if no other hash follows
        out: list[tuple] = []

        def put(edge: bool) -> None:
            for k, first, others in open_:
                if edge or singles or others:
                    out.append((first, others, k if edge else None))
            open_.clear()

        def batch() -> pa.RecordBatch:
            firsts, others, edges = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array(others, pa.list_(pa.int64())), pa.array(edges, pa.string())], ["first_id", "others", "edge"])

        for b in batches:
            if not b.num_rows:
                continue
            hashes, keys, batch_ids = b.column("h"), b.column("key"), b.column("id").to_pylist()
            starts = [] if key is not None and keys[0].as_py() == key else [0]
            if b.num_rows > 1:
                starts += [i + 1 for i, differs in enumerate(pc.not_equal(keys.slice(1), keys.slice(0, b.num_rows - 1)).to_pylist()) if differs]
            done = 0
            for start in starts:
                ids += batch_ids[done:start]
                if key is not None:
                    open_.append((key, ids[0], ids[1:]))
                now = hashes[start].as_py()
                if now != last_hash:
                    put(last_hash == first_hash)
                    first_hash = now if first_hash is None else first_hash
                    last_hash = now
                key, ids, done = keys[start].as_py(), [], start
            ids += batch_ids[done:]
            if len(ids) > 100_000:  # a hot run: what there is of it goes out, and the rest as a run of the same key
                open_.append((key, ids[0], ids[1:-1]))
                put(True)
                ids, first_hash = ids[-1:], last_hash
            if out:
                yield batch()
        if ids:
            open_.append((key, ids[0], ids[1:]))
            put(True)
            yield batch()

    return scan


def runs(df: DataFrame, key: str, id_col: str, parts: int | None = None, singles: bool = False) -> DataFrame:
    """(first_id, others, edge) of each run of rows with one key.

    Keys are made once and written to the shared folder, for range partitioning reads its input twice. Rows are range-partitioned by (hash of the
    key, id), so a group of any size is spread over as many partitions as it needs and the bounds are two numbers each, and sorted externally
    by (hash, key, id); the scan compares the full keys of neighbours. Only a run of a partition's first or last hash can go on elsewhere: those
    carry their key. The result is written once too, for another execution would draw other ranges. Rows with a null
    key or id are left out; ids that repeat count as several copies.
    """
    n = parts or max(2, shuffle_width(df.sparkSession))
    rows = written(df.select(F.xxhash64(key).alias("h"), F.col(key).alias("key"), F.col(id_col).cast("long").alias("id")).where("key is not null and id is not null"))
    spread = rows.repartitionByRange(n, "h", "id").sortWithinPartitions("h", "key", "id")
    return cut(spread.mapInArrow(_scanner(singles), "first_id long, others array<long>, edge string").withColumn("run", F.monotonically_increasing_id()))


def _edges(found: DataFrame) -> DataFrame:
    """(run, edge_first, first_run, n_copies) of the runs at partitions' edges: the group's smallest id, the run that holds it, and all rows of the
    group. Two runs a partition as a rule, and one for each 100,000 rows of a hot group; their ids stay where they are."""
    ends = found.where("edge is not null").select("run", "edge", "first_id", (F.size("others") + 1).cast("long").alias("n"))
    groups = ends.groupBy("edge").agg(F.min(F.struct("first_id", "run")).alias("m"), F.sum("n").alias("n_copies"))
    return ends.join(groups, "edge").select("run", F.col("m.first_id").alias("edge_first"), F.col("m.run").alias("first_run"), "n_copies")


def copy_links(df: DataFrame, key: str, id_col: str, parts: int | None = None) -> DataFrame:
    """(first_id, copy_id): for each group of two or more rows its smallest id, with one row for each other row. No rows for no input."""
    found = runs(df, key, id_col, parts)
    inner = found.where("edge is null").select("first_id", F.explode("others").alias("copy_id"))
    # of the run that holds the group's first row the first id is no copy; of the group's other runs it is
    across = found.where("edge is not null").join(small(cut(_edges(found))), "run")
    every = F.when(F.col("run") == F.col("first_run"), F.col("others")).otherwise(F.concat(F.array("first_id"), "others"))
    across = across.select("edge_first", F.explode(every).alias("copy_id"))
    return inner.unionByName(across.withColumnRenamed("edge_first", "first_id"))


def collapse(df: DataFrame, key: str, id_col: str, parts: int | None = None) -> DataFrame:
    """(id, n_copies): one row for each distinct record, with its smallest id and the exact number of rows that are the same record."""
    found = runs(df, key, id_col, parts, singles=True)
    inner = found.where("edge is null").select(F.col("first_id").alias("id"), (F.size("others") + 1).cast("long").alias("n_copies"))
    return inner.unionByName(_edges(found).where("run = first_run").select(F.col("edge_first").alias("id"), "n_copies"))


MEMBERS = ("url", "title", "price_raw", "description", "promo", "image")


def payload_members(df: DataFrame, payload: str, names: Sequence[str] = MEMBERS) -> DataFrame:
    """The members of a JSON object as columns, whatever the case of their names; rows without a readable object are left out.

    The first member of a name counts. A text after the object's end, or one broken off, is unreadable.
    """
    whole = F.from_json(F.col(payload), "map<string,string>", {"mode": "PERMISSIVE"})
    entries = F.map_entries("__map")
    out = df.withColumn("__map", whole).where("__map is not null")
    get = lambda n: F.get(F.filter(entries, lambda e: F.lower(e["key"]) == n), F.lit(0))["value"]
    return out.select(*[c for c in df.columns if c not in names and c != payload], *[get(n).alias(n) for n in names])
