"""Ranked retrieval: exact nearest neighbours, BM25, rank fusion, thresholds and re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from petalstream.functions.text import squeeze, tokens
from petalstream.plans.session import cut, small, written


def top_k(scored: DataFrame, query: str, score: str, tie: str, k: int, rank: str = "hit_rank") -> DataFrame:
    """The k best rows of each query; ties go to the smaller `tie`. A WindowGroupLimit prunes before the shuffle."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def dense_top_k(
    docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, vector: str, k: int, block: int = 2048, digits: int = 6, width: int | None = None, chunk: int = 200_000
) -> DataFrame:
    """(query_id, doc_id, score, hit_rank): the exact k nearest rows of each query by inner product, rounded to `digits`; ties by doc_id.

    Up to `block` queries are broadcast; each task multiplies its rows with them and keeps the k best of each query, which are merged by rank. More
    queries meet the rows in a grid of one plan: blocks of queries go to each chunk of about `chunk` rows, and chunks to each block, so that a task holds one of either
    and nothing goes through the driver. Vectors have `width` numbers, by default as many as those of the queries, which must agree (ValueError);
    rows whose vector is null or of another length have no score. No queries or no rows give no hits.
    """
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).cast("long").alias(query_id), F.col(vector).alias("__q"))
    n, least, most = asked.agg(F.count("*"), F.min(F.size("__q")), F.max(F.size("__q"))).first()
    if n and (least != most or most != (width or most)):
        raise ValueError(f"query vectors of {least} to {most} numbers" + f" instead of {width}" * (width is not None))
    rows = docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(vector).alias("__v")).where(F.col("__v").isNotNull() & (F.size("__v") == (most or 0)))
    names, schema = [query_id, doc_id, "score"], f"`{query_id}` long, `{doc_id}` long, score double"
    if n <= block:
        own = asked.collect()  # at most `block` of them
        shared = docs.sparkSession.sparkContext.broadcast((np.array([r[0] for r in own], dtype=np.int64), np.array([r[1] for r in own], dtype=np.float64).reshape(n, most or 0)))
        hits = rows.mapInArrow(_scores(shared, k, digits, names), schema)
    else:
        down, across = max(1, -(-rows.count() // chunk)), -(-n // block)
        cells = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        left = rows.withColumn("__r", F.pmod(F.xxhash64(doc_id), F.lit(down)).cast("int")).withColumn("__c", cells(across))
        right = asked.withColumn("__c", F.pmod(F.xxhash64(query_id), F.lit(across)).cast("int")).withColumn("__r", cells(down))

        def cell(x: pa.Table, q: pa.Table) -> pa.Table:
            ids, vectors = q.column(query_id).to_numpy(), _matrix(q.column("__q"))
            best = _best(ids, vectors, [(x.column(doc_id).to_numpy(), _matrix(x.column("__v")))] if x.num_rows and q.num_rows else [], k, digits)
            return pa.table(dict(zip(names, best)))

        hits = left.groupBy("__r", "__c").cogroup(right.groupBy("__r", "__c")).applyInArrow(cell, schema)
    return top_k(hits, query_id, "score", doc_id, k)


def _matrix(c: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks()
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1)


def _best(ids: np.ndarray, q: np.ndarray, parts: Iterable[tuple[np.ndarray, np.ndarray]], k: int, digits: int) -> list[np.ndarray]:
    """The k best of each query over parts of (ids, vectors): queries, rows and scores, side by side."""
    best, who = np.empty((len(ids), 0)), np.empty((len(ids), 0), dtype=np.int64)
    for own, x in parts:
        for lo in range(0, len(own), 4096):
            best = np.hstack([best, np.round(q @ x[lo : lo + 4096].T, digits)])
            who = np.hstack([who, np.tile(own[lo : lo + 4096], (len(ids), 1))])
            order = np.lexsort((who, -best), axis=1)[:, :k]
            best, who = np.take_along_axis(best, order, 1), np.take_along_axis(who, order, 1)
    return [np.repeat(ids, best.shape[1]), who.ravel(), best.ravel()]


def _scores(shared: Broadcast, k: int, digits: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        if len(ids):
            best = _best(ids, q, ((b.column(0).to_numpy(), _matrix(b.column(1))) for b in batches if b.num_rows), k, digits)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names)

    return run


def postings(docs: DataFrame, doc_id: str, text: str, terms: DataFrame) -> DataFrame:
    """(doc_id, doc_len, term, tf) of each text and each of the given terms that it holds, and of the empty term once for each row of the table: so
    one pass over the texts gives what is scored and how long all of them are. Other terms drop out before the shuffle."""
    rows = docs.select(doc_id, tokens(text).alias("__t"))
    rows = rows.select(doc_id, F.size("__t").alias("doc_len"), F.explode(F.concat("__t", F.array(F.lit("")))).alias("term"))
    wanted = small(cut(terms.select("term").union(terms.sparkSession.createDataFrame([("",)], "term string")).distinct()))
    return rows.join(wanted, "term", "left_semi").groupBy(doc_id, "doc_len", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, query_id: str, question: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) of every text that shares a term with a query; each distinct query term counts once.

    Texts are taken apart once and only terms that are asked for are kept, written with the text's length. Queries meet them in an equi-join on
    terms, and sums combine map-side. A text without terms is not counted, nor are repeated doc ids told apart.
    """
    asked = cut(queries.select(query_id, F.explode(F.array_distinct(tokens(question))).alias("term")))
    every = written(postings(docs, doc_id, text, asked))
    own = every.where("term != ''")
    sizes = every.where("term = '' and doc_len > 0").agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("tf") * F.col("doc_len")) / F.sum("tf")).alias("mean_len"))
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    weights = df.join(F.broadcast(sizes)).select("term", "mean_len", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # sizes is one row
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("mean_len")))
    scored = own.join(small(cut(weights)), "term").select(doc_id, "term", part.alias("part"))
    return scored.join(small(asked), "term").groupBy(query_id, doc_id).agg(F.sum("part").alias("score"))


def fuse(lists: list[DataFrame], query_id: str, doc_id: str, k: int, constant: int = 60, rank: str = "hit_rank", digits: int = 9) -> DataFrame:
    """(query_id, doc_id, score, hit_rank): reciprocal rank fusion of ranked lists; ties by doc_id."""
    rows = reduce(DataFrame.unionByName, [x.select(query_id, doc_id, (F.lit(1.0) / (F.col(rank) + constant)).alias("part")) for x in lists])
    fused = rows.groupBy(query_id, doc_id).agg(F.round(F.sum("part"), digits).alias("score"))
    return top_k(fused, query_id, "score", doc_id, k, rank)


def rerank(hits: DataFrame, query_id: str, score: Column, k: int, rank: str = "hit_rank") -> DataFrame:
    """The k best hits by another score, given as a column; equal scores keep their old order. Adds rerank_score."""
    w = Window.partitionBy(query_id).orderBy(F.desc("rerank_score"), F.asc("__old"))
    out = hits.withColumnRenamed(rank, "__old").withColumn("rerank_score", score).withColumn(rank, F.row_number().over(w))
    return out.where(F.col(rank) <= k).drop("__old")


def abstentions(queries: DataFrame, hits: DataFrame, query_id: str) -> DataFrame:
    """(query_id, abstained): whether nothing was found for a query."""
    answered = hits.select(query_id).distinct().withColumn("__hit", F.lit(1))
    return queries.select(query_id).join(answered, query_id, "left").select(query_id, F.col("__hit").isNull().alias("abstained"))


@dataclass(frozen=True)
class RetrievalConfig:
    """A plan: what is fetched, filtered, fused and cut."""

    name: str
    top_k: int = 5
    fetch_k: int = 20
    rerank: bool = False
    prefilter: bool = False
    hybrid: bool = False
    threshold: float | None = None

    def __post_init__(self) -> None:
        if self.hybrid and self.threshold is not None:
            raise ValueError("fused scores are no similarities: no threshold")


# The configurations by name.
CONFIGS = {
    c.name: c
    for c in (
        RetrievalConfig("baseline"), RetrievalConfig("dense"), RetrievalConfig("dense_threshold", threshold=0.6),
        RetrievalConfig("dense_rerank", rerank=True, threshold=0.6), RetrievalConfig("dense_budget", prefilter=True), RetrievalConfig("hybrid", hybrid=True),
        RetrievalConfig("hybrid_budget", prefilter=True, hybrid=True), RetrievalConfig("full", rerank=True, prefilter=True, threshold=0.6),
    )
}


def run_config(
    config: RetrievalConfig, docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, vector: str, wanted: Column | None = None,
    lexical: DataFrame | None = None, second: Callable[[DataFrame], Column] | None = None, question: str | None = None,
) -> DataFrame:
    """The ranked hits of a configuration. Queries whose `question` is null or blank are not searched for. The filter stands below both rankings and the
    fusion; the threshold is on the first score, after re-ranking; `lexical` are scored texts (query_id, doc_id, score) to rank and fuse with, `second` makes the re-ranking
    score of the fetched hits."""
    filtered = config.prefilter and wanted is not None
    rows = docs.where(wanted) if filtered else docs
    asked = queries if question is None else queries.where(~is_blank(question))
    fetched = config.fetch_k if config.rerank or config.hybrid else config.top_k
    hits = dense_top_k(rows, asked, doc_id, query_id, vector, fetched)
    if config.hybrid and lexical is not None:
        other = lexical.join(rows.select(doc_id), doc_id, "left_semi") if filtered else lexical
        other = other if question is None else other.join(asked.select(query_id), query_id, "left_semi")
        return fuse([hits, top_k(other, query_id, "score", doc_id, fetched)], query_id, doc_id, config.top_k)
    if config.rerank and second is not None:
        hits = rerank(hits, query_id, second(hits), fetched)
    if config.threshold is not None:
        hits = hits.where(F.col("score") >= config.threshold)
    return top_k_by_rank(hits, query_id, config.top_k)


def is_blank(question: Column | str) -> Column:
    """Whether a question is null or white space only: it is not searched for, and counts as an abstention."""
    return squeeze(F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit(""))) == ""


def top_k_by_rank(hits: DataFrame, query_id: str, k: int, rank: str = "hit_rank") -> DataFrame:
    """The first k of the hits left after a filter, ranked anew."""
    w = Window.partitionBy(query_id).orderBy(rank)
    return hits.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop(rank).withColumnRenamed("__r", rank)


# The states of a corpus, each with an index of its own.
STATES = ("baseline", "clean", "corrupt", "repaired")


def collection_name(state: str, prefix: str = "items") -> str:
    """The index of a state; another state is an error."""
    if state not in STATES:
        raise ValueError(f"no state {state!r}; there are {', '.join(STATES)}")
    return f"{prefix}_{state}"


def payload(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The columns that an index hands out, under their names there."""
    return df.select(*[F.col(c).alias(name) for name, c in fields.items()])


def builders_for(state: str, naive: Column, clean: Column, fields: dict[str, str], unparsed: Sequence[str] = ()) -> tuple[Column, dict[str, str]]:
    """(text to index by, payload fields) of a state: the naive text without the parsed fields for the baseline, else the clean one with all."""
    collection_name(state)
    return (naive, {n: c for n, c in fields.items() if n not in unparsed}) if state == "baseline" else (clean, fields)


def write_index(docs: DataFrame, path: str, key: str, seq: str, buckets: int = 16, recreate: bool = True) -> None:
    """Writes a vector table, the last row of each key, partitioned by a hash of the key, so that an upsert rewrites only what it hits. Without
    `recreate` an index that exists stays as it is."""
    from petalstream.operators.ordering import keep_last

    if not recreate and exists(docs.sparkSession, path):
        return
    keep_last(docs, [key], [seq]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(path)


def drop_index(spark: SparkSession, path: str) -> bool:
    """Whether there was one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
