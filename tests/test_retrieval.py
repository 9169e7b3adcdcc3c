import math
import random

import pytest
from pyspark.sql import functions as F

from petalstream.operators import evaluation as E
from petalstream.operators import retrieval as R


def vectors(spark, n, dim=8, seed=0):
    r = random.Random(seed)
    return spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(dim)], i % 3) for i in range(n)], "vec_id long, v array<float>, label int")


def test_dense_blocks_agree_with_brute_force(spark):
    docs = vectors(spark, 80)
    queries = docs.where("vec_id % 10 = 0").select(F.col("vec_id").alias("q"), "v")
    rows = {r.vec_id: r.v for r in docs.collect()}
    for block, chunk in ((2, 30), (3, 1000), (2048, 1000)):
        got = R.dense_top_k(docs, queries, "vec_id", "q", "v", 4, block=block, chunk=chunk).collect()
        assert len(got) == 32
        for q in range(0, 80, 10):
            want = sorted(((round(sum(a * b for a, b in zip(rows[q], v)), 6), i) for i, v in rows.items()), key=lambda t: (-t[0], t[1]))[:4]
            own = sorted((r for r in got if r.q == q), key=lambda r: r.hit_rank)
            assert [r.vec_id for r in own] == [i for _, i in want]
            assert [r.score for r in own] == pytest.approx([s for s, _ in want])


def test_dense_edges(spark):
    docs = vectors(spark, 5)
    odd = spark.createDataFrame([(9, None, 0), (10, [1.0], 0)], docs.schema)
    q = docs.where("vec_id = 1").select(F.col("vec_id").alias("q"), "v")
    assert R.dense_top_k(docs.union(odd), q, "vec_id", "q", "v", 50).count() == 5
    with pytest.raises(ValueError):
        R.dense_top_k(docs, docs.union(odd).select(F.col("vec_id").alias("q"), "v"), "vec_id", "q", "v", 5)
    with pytest.raises(ValueError):
        R.dense_top_k(docs, q, "vec_id", "q", "v", 5, width=7)
    assert R.dense_top_k(docs.limit(0), q, "vec_id", "q", "v", 5).count() == 0
    assert R.dense_top_k(docs, q.limit(0), "vec_id", "q", "v", 5).count() == 0


def test_bm25_formula(spark):
    texts = ["a b b", "b c", "a a d e", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
    got = {r.d: r.score for r in R.bm25(docs, spark.createDataFrame([("q", "b b x")], "q string, t2 string"), "d", "t", "q", "t2").collect()}
    mean = (3 + 2 + 4) / 3
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    want = {0: idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / mean)), 1: idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / mean))}
    assert got == pytest.approx(want)


def test_configurations(spark):
    assert set(R.CONFIGS) >= {"baseline", "dense", "full", "hybrid"} and len(R.CONFIGS) == 8
    assert all(c.threshold is None for c in R.CONFIGS.values() if c.hybrid)
    with pytest.raises(ValueError):
        R.RetrievalConfig("x", hybrid=True, threshold=0.5)
    docs = vectors(spark, 60)
    q = docs.where("vec_id < 3").select(F.col("vec_id").alias("q"), "v")
    lexical = docs.where("vec_id < 20").select(F.lit(1).cast("long").alias("q"), "vec_id", F.lit(1.0).alias("score"), F.col("vec_id").cast("int").alias("hit_rank"))
    for c in R.CONFIGS.values():
        hits = R.run_config(c, docs, q, "vec_id", "q", "v", F.col("label") == 0, lexical, lambda h: -F.col("score")).collect()
        assert all(r.hit_rank <= 5 for r in hits)
        if c.prefilter:
            assert all(r.vec_id % 3 == 0 for r in hits)
        if c.threshold:
            assert all(r.score >= c.threshold for r in hits)
    silent = R.abstentions(q, docs.limit(0).select(F.col("vec_id").alias("q")), "q").collect()
    assert all(r.abstained for r in silent) and len(silent) == 3


def test_blank_questions_are_not_searched_for(spark):
    docs = vectors(spark, 30)
    q = docs.where("vec_id < 4").select(F.col("vec_id").alias("q"), "v", F.element_at(F.array(F.lit("x"), F.lit("  "), F.lit(None), F.lit("\xa0")), (F.col("vec_id") + 1).cast("int")).alias("question"))
    lexical = docs.select(F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("q"), "vec_id", F.lit(1.0).alias("score"))
    for name in ("dense", "hybrid"):
        hits = R.run_config(R.CONFIGS[name], docs, q, "vec_id", "q", "v", lexical=lexical, question="question")
        assert {r.q for r in hits.collect()} == {0}
        assert {r.q for r in R.abstentions(q, hits, "q").collect() if r.abstained} == {1, 2, 3}


def test_index_tables(spark, tmp_path):
    docs = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "url string, seq int, v string")
    path = str(tmp_path / "index")
    R.write_index(docs, path, "url", "seq")
    R.write_index(docs.limit(0), path, "url", "seq", recreate=False)
    assert {r.url: r.v for r in spark.read.parquet(path).collect()} == {"a": "y", "b": "z"}
    R.write_index(docs.where("url = 'b'"), path, "url", "seq")
    assert spark.read.parquet(path).count() == 1 and R.drop_index(spark, path) and not R.exists(spark, path)
    assert R.collection_name("clean") == "items_clean"
    with pytest.raises(ValueError):
        R.collection_name("legacy")
    for state, want in (("baseline", ("x", ["u"])), ("clean", ("y", ["u", "n"]))):
        text, fields = R.builders_for(state, F.lit("x"), F.lit("y"), {"u": "url", "n": "seq"}, ["n"])
        assert docs.select(text.alias("t")).first().t == want[0] and R.payload(docs, fields).columns == want[1]


def test_blocks_and_latency(spark):
    q = spark.createDataFrame([("a", ["u", "v"], True), ("b", ["w"], True), ("c", ["u"], False)], "q string, g array<string>, answerable boolean")
    hits = spark.createDataFrame([("a", "v", 1), ("b", "w", 1)], "q string, url string, hit_rank int")
    got = {r.block: r for r in E.outcome_blocks(q, hits, "q", "g", "url", spark.createDataFrame([("v",)], "url string"), (5,)).collect()}
    assert (got["raw"].n, got["raw"].n_scored, got["raw"].recall_5) == (2, 2, 0.75) and (got["restricted"].n, got["restricted"].n_scored, got["restricted"].recall_5) == (2, 1, 1.0)
    xs = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, 10.0, None)], "ms double")
    assert tuple(E.latency(xs, "ms").first()) == (3.0, 10.0, 4.2) and tuple(E.latency(xs.limit(0), "ms").first()) == (0.0, 0.0, 0.0)
    assert [r.c for r in E.in_order(spark.createDataFrame([("b",), ("x",), ("a",)], "c string"), "c", ("a", "b")).collect()] == ["a", "b", "x"]


def test_fusion_and_ties(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "q string, d string, hit_rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "x", 2), ("q", "z", 3)], "q string, d string, hit_rank int")
    got = [(r.d, r.hit_rank) for r in R.fuse([a, b], "q", "d", 3).orderBy("hit_rank").collect()]
    assert got == [("x", 1), ("y", 2), ("z", 3)]


def test_metrics_by_hand(spark):
    q = spark.createDataFrame([("a", ["u", "v", "u"], True), ("b", [], False), ("c", None, True), ("d", ["w"], True)], "q string, g array<string>, answerable boolean")
    hits = spark.createDataFrame([("a", "x", 1), ("a", "v", 2), ("a", "v", 3), ("d", "y", 1)], "q string, url string, hit_rank int")
    rows = {r.q: r for r in E.per_query(q, hits, "q", "g", "url", (1, 5)).collect()}
    assert rows["a"].n_gold == 2 and rows["a"].recall_5 == 0.5 and rows["a"].recall_1 == 0 and rows["a"].mrr_5 == 0.5
    assert rows["a"].ndcg_5 == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert rows["b"].recall_5 == rows["c"].ndcg_5 == rows["d"].hit_5 == 0
    m = E.means(E.per_query(q, hits, "q", "g", "url"), []).first()
    assert m.n == 2 and m.recall_5 == 0.25
    s = E.abstention_scores(q.withColumn("abstained", F.col("q").isin("b", "d"))).first()
    assert (s.precision, s.recall, s.n_unanswerable, s.false_abstentions) == (0.5, 1.0, 1, 1)
    table = E.markdown(E.pivot(spark.createDataFrame([("m", "x", 1.0)], "m string, s string, v double"), "m", "s", "v", ["x", "y"]))
    assert table.splitlines()[2] == "| m | 1.0000 | – |"
