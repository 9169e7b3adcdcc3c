"""Order-dependent operators without one-task windows: keep-first, global ranks, exact order statistics, greedy selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petalstream.plans.session import cut, shuffle_width, small


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by the order (ties by all columns). A minimum of structs combines map-side, so a key that holds a third
    of all rows costs no more than another. Null keys form one group; an empty table gives no rows."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.min(F.struct(*order, *[c for c in rest])).alias("__row")
    out = df.groupBy(*keys).agg(row)
    return out.select(*[F.col(c) if c in keys else F.col(f"__row.`{c}`").alias(c) for c in df.columns])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by the order: an upsert in which later writes win."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    out = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__row"))
    return out.select(*[F.col(c) if c in keys else F.col(f"__row.`{c}`").alias(c) for c in df.columns])


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """Adds the place of each row, from 1, in the whole order.

    Range partitions are sorted on their own and counted; only one count a partition is gathered, to shift the places. The order should
    be total: ties get places in no defined order.
    """
    n = parts or max(2, shuffle_width(df.sparkSession))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("__n")).collect()  # a count a partition
    shift, total = [], 0
    for r in sorted(sizes, key=lambda r: r["__p"]):
        shift.append((r["__p"], total))
        total += r["__n"]
    starts = df.sparkSession.createDataFrame(shift, "__p long, __start long")
    local = F.col("__at") - F.shiftleft(part, 33)
    ranked = placed.withColumn("__p", part).join(F.broadcast(starts), "__p")
    return ranked.withColumn(name, F.col("__start") + local + 1).select(*df.columns, name)


def shuffled(df: DataFrame, keys: Sequence[str], seed: int = 42, name: str = "seq") -> DataFrame:
    """The rows in an order drawn by the seed from their keys, which is their new number from 0, whatever the partitioning. Keys should be unique."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("shuffle"), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    ranked = global_rank(df.drop(name).withColumn("__draw", draw) if name not in keys else df.withColumn("__draw", draw), ["__draw", *[k for k in keys if k != name]], "__rank")
    return ranked.withColumn(name, F.col("__rank") - 1).drop("__draw", "__rank")


def zip_strict(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of two tables side by side by a key that both hold once each; another number of rows, or a key of one side only, is an error."""
    both = cut(left.withColumn("__l", F.lit(1)).join(right.withColumn("__r", F.lit(1)), key, "full"))
    n, a, b, keys = both.agg(F.count("*"), F.count("__l"), F.count("__r"), F.count_distinct(key)).first()
    if not n == a == b == keys:
        raise ValueError(f"the sides don't fit: {a} rows and {b} rows, {keys} keys in {n} pairs")
    return both.drop("__l", "__r")


def order_statistics(df: DataFrame, value: str, percents: Sequence[float], digits: int = 6) -> DataFrame:
    """(percent, value): for each percent p the element at place round(p / 100 * (n - 1)), half to even, of the sorted non-null values.
    Exact, from equal values counted first; no rows for no values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    ranked = global_rank(counts, [value], "__r")
    w = cumulative(ranked, "__r", "n", "upto")
    total = df.select(F.count(value)).first()[0]
    if not total:
        return counts.limit(0).select(F.lit(0.0).alias("percent"), F.col(value).alias("value"))
    want = df.sparkSession.createDataFrame([(float(p), min(total - 1, int(_half_even(p / 100 * (total - 1))))) for p in percents], "percent double, at long")
    return w.join(F.broadcast(want), (F.col("at") >= F.col("upto") - F.col("n")) & (F.col("at") < F.col("upto"))).select("percent", F.round(value, digits).alias("value"))


def _half_even(x: float) -> int:
    return round(x)


def cumulative(ranked: DataFrame, rank: str, value: str, name: str, block: int = 100_000) -> DataFrame:
    """Adds the running sum of a value along a rank without gaps. Blocks of ranks are summed on their own; the blocks' totals, one row
    for each `block` rows, give the starts."""
    from pyspark.sql.window import Window

    blocks = ranked.withColumn("__b", F.floor((F.col(rank) - 1) / block))
    totals = blocks.groupBy("__b").agg(F.sum(value).alias("__t"))
    starts = totals.select("__b", (F.sum("__t").over(Window.orderBy("__b")) - F.col("__t")).alias("__s"))
    inner = F.sum(value).over(Window.partitionBy("__b").orderBy(rank))
    return blocks.withColumn("__own", inner).join(small(cut(starts)), "__b").withColumn(name, F.col("__own") + F.col("__s")).drop("__b", "__own", "__s")


def greedy_distinct(df: DataFrame, order: str, keys: Sequence[str]) -> DataFrame:
    """The rows kept by going through them in order and dropping each one that shares a key with a row kept before it.

    A dropped row doesn't count for its other keys. Rounds over the open rows, never pairs: a row that is the first of all its groups is kept,
    the others of its groups are dropped, and what is left waits for the next round, of which there are as many as the longest chain of rows each
    hidden by the one before. A row is looked up by (key, order), so a hot group is spread; null keys match nothing and stay apart. `order` must be unique;
    rows without it are left out.
    """
    own = lambda k: F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.concat(F.lit("!"), F.col(order).cast("string"))).alias(k)
    open_ = cut(df.where(F.col(order).isNotNull()).select(order, *map(own, keys)))
    kept: list[DataFrame] = []
    while not open_.isEmpty():
        leads = open_
        for k in keys:
            leads = leads.join(open_.groupBy(k).agg(F.min(order).alias(order)), [k, order], "left_semi")
        leads = cut(leads)
        kept.append(leads.select(order))
        for k in keys:
            open_ = open_.join(small(leads.select(k)), k, "left_anti")
        open_ = cut(open_)
    every = kept[0] if kept else open_.select(order)
    for k in kept[1:]:
        every = every.unionByName(k)
    return df.join(every, order, "left_semi")


def greedy_independent(nodes: DataFrame, order: str, pairs: DataFrame) -> DataFrame:
    """The orders kept by going through the nodes in order and dropping each that is paired with a kept one before it; pairs (a, b) with
    a < b. Rounds over open pairs only."""
    state = cut(nodes.select(order).distinct().withColumn("__s", F.lit(0)))
    while True:
        before = pairs.join(state.withColumnRenamed(order, "a").withColumnRenamed("__s", "__sa"), "a")
        seen = before.groupBy("b").agg(F.max((F.col("__sa") == 1).cast("int")).alias("__k"), F.max((F.col("__sa") == 0).cast("int")).alias("__o"))
        joined = state.join(seen, state[order] == seen["b"], "left")
        now = F.when(F.col("__s") > 0, F.col("__s")).when(F.col("__k") == 1, 2).when(F.coalesce("__o", F.lit(0)) == 0, 1).otherwise(0)
        state = cut(joined.select(order, now.alias("__s")))
        if state.where("__s = 0").isEmpty():
            return state.where("__s = 1").select(order)
