"""Measures of retrieval: rank metrics, abstention, latency, slices, comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_query(queries: DataFrame, hits: DataFrame, query_id: str, gold: str, url: str, ks: Sequence[int] = (1, 5, 10), rank: str = "hit_rank") -> DataFrame:
    """(query_id, n_gold, and recall_k, hit_k, mrr_k, ndcg_k for each k): queries hold their distinct gold as an array; hits that repeat
    count at their best rank. An empty gold list scores 0."""
    golds = queries.select(query_id, F.array_distinct(F.coalesce(gold, F.array().cast("array<string>"))).alias("__g"))
    best = hits.groupBy(query_id, url).agg(F.min(rank).alias("__r"))
    relevant = golds.select(query_id, F.explode("__g").alias(url)).join(best, [query_id, url])
    aggs = []
    for k in ks:
        within = F.col("__r") <= k
        aggs += [
            F.count_if(within).alias(f"__n{k}"), F.min(F.when(within, F.col("__r"))).alias(f"__f{k}"),
            F.sum(F.when(within, 1 / F.log2(F.col("__r") + 1.0))).alias(f"__d{k}"),
        ]
    found = relevant.groupBy(query_id).agg(*aggs)
    out = golds.select(query_id, F.size("__g").alias("n_gold")).join(found, query_id, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    cols: list[Column] = [F.col(query_id), F.col("n_gold")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n_gold", F.lit(k)))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
        cols += [
            zero(F.try_divide(f"__n{k}", "n_gold")).alias(f"recall_{k}"), (F.coalesce(f"__n{k}", F.lit(0)) > 0).cast("int").alias(f"hit_{k}"),
            zero(1 / F.col(f"__f{k}")).alias(f"mrr_{k}"), zero(F.col(f"__d{k}") / ideal).alias(f"ndcg_{k}"),
        ]
    return out.select(*cols)


def means(scores: DataFrame, by: Sequence[str], ks: Sequence[int] = (1, 5, 10), digits: int = 4) -> DataFrame:
    """(*by, n, and the mean of each metric) over queries with gold."""
    names = [f"{m}_{k}" for m in ("recall", "hit", "mrr", "ndcg") for k in ks]
    return scores.where("n_gold > 0").groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(c), digits).alias(c) for c in names])


def matrix(cells: dict[str, DataFrame], golds: DataFrame, query_id: str, gold: str, url: str, ks: Sequence[int] = (1, 5, 10), name: str = "config") -> DataFrame:
    """(name, n, and the mean of each metric) of each cell: its hits over the same queries with gold. One plan for all cells."""
    hits = reduce(DataFrame.unionByName, [h.select(query_id, url, "hit_rank", F.lit(c).alias(name)) for c, h in cells.items()])
    names = F.explode(F.array(*map(F.lit, cells))).alias(name)
    key = lambda df: df.withColumn("__key", F.concat_ws("\x1f", name, F.col(query_id).cast("string")))
    scores = per_query(key(golds.select(query_id, gold, names)), key(hits), "__key", gold, url, ks)
    return means(scores.withColumn(name, F.substring_index("__key", "\x1f", 1)), [name], ks)


def in_order(df: DataFrame, c: str, order: Sequence[str], place: str = "place") -> DataFrame:
    """The rows by a custom order of a column's values, with their place in it from 0; others stand last, without one."""
    at = F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(c)).cast("int"), F.lit(0)) - 1
    return df.withColumn(place, at).orderBy(F.col(place).asc_nulls_last(), c)


def outcome_blocks(queries: DataFrame, hits: DataFrame, query_id: str, gold: str, url: str, present: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """(block, n, n_scored, metrics) of 'raw', all gold, and 'restricted', only what the index `present` (url) holds; n counts the answerable queries with gold in
    both, n_scored those that have any left. Queries must have `answerable`."""
    asked = queries.where("answerable").select(query_id, F.array_distinct(F.coalesce(gold, F.array().cast("array<string>"))).alias(gold)).where(F.size(gold) > 0)
    left = asked.select(query_id, F.explode(gold).alias(url)).join(present.select(url).distinct(), url, "left_semi").groupBy(query_id).agg(F.collect_list(url).alias(gold))
    n = asked.agg(F.count("*").alias("n"))
    parts = []
    for name, golds in (("raw", asked), ("restricted", left)):
        one = means(per_query(golds, hits, query_id, gold, url, ks), [], ks).withColumnRenamed("n", "n_scored").withColumn("block", F.lit(name))
        parts.append(n.join(F.broadcast(one)))  # one row each
    return reduce(DataFrame.unionByName, parts)


def latency(df: DataFrame, value: str, digits: int = 1) -> DataFrame:
    """(p50, p95, mean): the interpolated median, the element at half-even 0.95 (n - 1), and the mean; from equal values counted first."""
    from petalstream.operators.ordering import order_statistics

    n = df.where(F.col(value).isNotNull()).count()
    if not n:
        return df.sparkSession.createDataFrame([(0.0, 0.0, 0.0)], "p50 double, p95 double, mean double")
    at = lambda i: 100 * i / (n - 1) if n > 1 else 0.0
    places = [at((n - 1) // 2), at(n // 2), 95.0]
    got = {r.percent: r.value for r in order_statistics(df, value, sorted(set(places)), 12).collect()}
    mean = df.agg(F.avg(value)).first()[0]
    row = ((got[places[0]] + got[places[1]]) / 2, got[95.0], mean)
    return df.sparkSession.createDataFrame([row], "p50 double, p95 double, mean double").select(*[F.bround(c, digits).alias(c) for c in ("p50", "p95", "mean")])


def slices(scores: DataFrame, dims: Sequence[str], metrics: Sequence[str], digits: int = 4) -> DataFrame:
    """(dim, value, n, metrics): independent groups by each dimension, in one pass of grouping sets. A slice whose queries are all
    without gold stands with n 0."""
    texts = scores.withColumns({d: F.coalesce(F.initcap(F.col(d).cast("string")) if t == "boolean" else F.col(d).cast("string"), F.lit("")) for d, t in scores.dtypes if d in dims})
    which = F.coalesce(*[F.when(F.grouping(d) == 0, d) for d in dims]).alias("dim")
    aggs = [F.round(F.avg(F.when(F.col("n_gold") > 0, F.col(m))), digits).alias(m) for m in metrics]
    grouped = texts.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(which, F.count_if(F.col("n_gold") > 0).alias("n"), *aggs)
    return grouped.select("dim", F.coalesce(*dims).alias("value"), "n", *metrics)


def abstention_scores(outcomes: DataFrame, answerable: str = "answerable", abstained: str = "abstained") -> DataFrame:
    """(precision, recall, f1, n_unanswerable, false_abstentions): silence on what has no answer. 0 where undefined."""
    a, s = F.coalesce(F.col(answerable), F.lit(False)), F.coalesce(F.col(abstained), F.lit(False))
    t = outcomes.agg(F.count_if(~a & s).alias("tp"), F.count_if(a & s).alias("false_abstentions"), F.count_if(~a).alias("n_unanswerable"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    t = t.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("false_abstentions"))).withColumn("recall", ratio(F.col("tp"), F.col("n_unanswerable")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return t.select(*[F.round(x, 4).alias(n) for n, x in (("precision", F.col("precision")), ("recall", F.col("recall")), ("f1", f1))], "n_unanswerable", "false_abstentions")


def missing_gold(queries: DataFrame, index: DataFrame, query_id: str, gold: str, url: str) -> DataFrame:
    """(query_id, url): gold that the index doesn't hold."""
    return queries.select(query_id, F.explode(F.array_distinct(gold)).alias(url)).join(index.select(url).distinct(), url, "left_anti").select(query_id, url)


def pivot(df: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """A table with one column for each of the given values; a cell without rows is null."""
    return df.groupBy(row).pivot(column, list(columns)).agg(F.first(value))


def recovery(df: DataFrame, state: str, value: str, low: str, high: str, mended: str) -> DataFrame:
    """(recovery): how much of what was lost from `high` to `low` came back in `mended`; null where nothing was lost."""
    at = lambda s: F.max(F.when(F.col(state) == s, F.col(value)))
    return df.agg(F.when(at(high) > at(low), (at(mended) - at(low)) / (at(high) - at(low))).alias("recovery"))


def markdown(df: DataFrame) -> str:
    """A table as Markdown, for reports: all of its rows, in their order. The text is made on the driver, so it is for tables that one reads."""
    line = lambda xs: "| " + " | ".join("–" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|") for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, df.toLocalIterator())])
