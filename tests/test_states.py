import random

import pytest
from pyspark.sql import functions as F

from petalstream.operators import citations as C
from petalstream.operators import evalset as V
from petalstream.operators import ordering as O
from petalstream.operators import quality as Q
from petalstream.operators import states as S
from petalstream.plans.session import cut

WORDS = "hoa hồng lan cúc bó giỏ kệ tặng sinh nhật tươi trắng đỏ vàng xanh tím nhỏ lớn đẹp mềm".split()


def catalogue(spark, n):
    rows = []
    for i in range(n):
        r = random.Random(i)
        body = " ".join(f"{r.choice(WORDS)} n{i}x{j} {r.choice(WORDS)}" for j in range(12))
        rows.append((i, f"https://s.example/bo-hoa-m{i}/", f"Bó hoa {i} {r.choice(WORDS)}", body))
    return spark.createDataFrame(rows, "seq long, url string, title string, description string")


def damaged(spark, n=240, **kw):
    bad = S.corrupt(catalogue(spark, n), "seq", "url", "title", "description", **kw)
    return bad, O.shuffled(bad, ["url", "seq"])


def test_damage_is_deterministic_and_found_again(spark):
    df = catalogue(spark, 240)
    bad, mixed = damaged(spark)
    again = S.corrupt(df.repartition(3), "seq", "url", "title", "description")
    key = lambda d: sorted((r.url, r.description, tuple(r.labels)) for r in d.collect())
    assert key(bad) == key(again) and key(bad) != key(S.corrupt(df, "seq", "url", "title", "description", seed=1))
    assert df.count() == 240
    mixed = cut(mixed)
    mended = cut(S.mend(mixed, "seq", "url", "title", "description"))
    found = mended.select("url", F.explode("found").alias("label"))
    truth = mixed.select("url", F.explode("labels").alias("label"))
    scores = {r.label: r for r in S.prf(truth, found).collect()}
    assert S.macro_f1(S.prf(truth, found)).first().macro_f1 > 0.6 and scores["duplication"].f1 > 0.9 and scores["mojibake"].f1 > 0.9
    assert S.any_defect(truth, found).first().f1 > 0.8
    assert S.urls_with(truth, "mojibake").count() == scores["mojibake"].tp + scores["mojibake"].fn
    kept = mended.where("kept").collect()
    urls = [r.url for r in kept]
    assert len(urls) == len(set(urls)) and not any("?" in u or u.endswith("//") for u in urls)
    flooded = [r for r in kept if "boilerplate_flood" in r.found and not {"truncation", "missing_field"} & {*r.found, *r.labels}]
    assert flooded and not any(S.FLOOD in r.description for r in flooded)
    assert all(len(r.new_hash) == 16 for r in kept) and mended.where("not kept and new_hash is not null").count() == 0
    clean = {r.url: r for r in df.collect()}
    assert all(r.title == clean[r.url].title for r in kept if r.found == ["mojibake"])


def test_mending_by_hand(spark):
    rows = [
        (0, "https://s/a/?x=1", "A", "Bó hoa cúc vàng tươi cho ngày lễ lớn của mẹ"), (1, "https://s/a", "A", "Bó hoa cúc vàng tươi cho ngày lễ lớn của mẹ nhé"),
        (2, "https://s/b", "", "Bó hoa lan tím nhỏ cho ngày đầu tuần của bạn"), (3, "https://s/bb", " ", "Bó hoa lan tím nhỏ cho ngày đầu tuần của bạn"), (4, "https://s/c", "nan", None),
        (5, "https://s/d", "D", "hoa tươi"), (6, "https://s/e?list=2", "E", "Một trang có tham số mà không trùng với trang nào cả"), (7, None, "F", "none"),
    ]
    df = spark.createDataFrame(rows, "seq long, url string, title string, description string")
    got = {r.seq: (r.found, r.kept) for r in S.mend(df, "seq", "url", "title", "description", min_share=0.5).collect()}
    assert got[0] == (["duplication"], False) and got[1] == ([], True)  # the canonical form survives
    assert got[2] == (["missing_field"], False) and got[3] == (["missing_field", "duplication"], False)  # untitled rows still hide others
    assert got[4] == (["missing_field"], False) and got[5] == (["truncation"], True) and got[6] == ([], True)
    assert got[7] == (["missing_field"], True)
    fixed = {r.seq: r for r in S.repair(df.withColumn("h", F.lit("old")), "seq", "url", "title", "description", hash_col="h", min_share=0.5).collect()}
    assert fixed[7].description == "" and fixed[1].h != "old" and set(fixed) == {1, 5, 6, 7}
    assert S.mend(df.limit(0), "seq", "url", "title", "description").count() == 0


def test_three_fields_three_forms_and_constant_rows(spark):
    df = catalogue(spark, 400).withColumn("price_raw", F.lit("100"))
    bad = S.corrupt(df, "seq", "url", "title", "description", others=("price_raw",), rates={"missing_field": 0.5, "duplication": 0.5}, constants=[{"url": "https://s/cart", "label": "extra"}])
    rows = bad.collect()
    blank = [r for r in rows if "missing_field" in r.labels and "truncation" not in r.labels]
    assert all(any(not r[c] for r in blank) for c in ("title", "description", "price_raw"))
    ends = {f: sum(r.url.endswith(f) for r in rows) for f in S.CLONES}
    assert all(n > 30 for n in ends.values()) and [(r.title, r.labels) for r in rows if r.url == "https://s/cart"] == [(None, ["extra"])]


def test_shared_tokens_strip_short_sentences(spark):
    texts = [f"Own {i} goods n{i}. Call our shop now." for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r.t for r in S.strip_repeated(df, "t", "id").collect()}
    assert got[3] == "Own 3 goods n3." and set(got) == set(range(20))
    only = spark.createDataFrame([(i, "Call our shop now.") for i in range(5)], "id long, t string")
    assert {r.t for r in S.strip_repeated(only, "t", "id").collect()} == {"Call our shop now."}  # what would lose all stays


def test_baseline_counters(spark):
    df = spark.createDataFrame([("a", "nan"), ("b", "x"), (None, "nan")], "url string, naive string")
    out, seen = S.baseline_records(df, "naive", F.col("url") != "b")
    assert out.count() == 3 and seen.get == {"records": 3, "nan_texts": 2, "unwanted": 2}


def test_clean_counts_the_first_reason(spark):
    df = spark.createDataFrame([(1, "ftp://a", ""), (2, "https://a", None), (3, "https://a", "t"), (4, "https://a", "t2"), (5, None, "t")], "seq long, url string, title string")
    got = {r.seq: r.drop_reason for r in S.clean(df, "url", "title", "seq", F.col("url").startswith("https")).collect()}
    assert got == {1: "unwanted", 2: "no_title", 3: None, 4: "duplicate", 5: "unwanted"}


def test_scores_of_nothing(spark):
    none = spark.createDataFrame([], "url string, label string")
    assert {r.f1 for r in S.prf(none, none).collect()} == {0.0}


def test_quality(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, "a"), (4, ""), (5, None)], "id long, t string")
    assert {r.token: r.df for r in Q.boilerplate_tokens(df, "t").collect()} == {"a": 3, "b": 2}
    assert Q.boilerplate_ratio(df, "t").first().ratio == pytest.approx(5 / 6)
    text = " ".join(f"w{i}" for i in range(10))
    same = spark.createDataFrame([(1, text), (2, text), (3, "short"), (4, None)], "id long, t string")
    assert Q.repeated_passages(same, "t", "id").count() == 3
    assert {r.id: r.share for r in Q.repeated_share(same, "t", "id").collect()} == {1: 1.0, 2: 1.0}
    stripped = S.strip_repeated(spark.createDataFrame([(i, f"{text}. own n{i}.") for i in range(3)], "id long, t string"), "t", "id")
    assert sorted(r.t for r in stripped.collect()) == [f"own n{i}." for i in range(3)]
    rep = Q.quality_report(spark.createDataFrame([("u", "nan", "h"), ("u", None, None)], "url string, t string, h string"), "url", ["t"], "h")
    row = rep.first()
    assert (row.documents, row.null_t, row.null_words, row.duplicate_urls, row.duplicate_hashes) == (2, 1, 1, 1, 0)
    with pytest.raises(Q.QualityError):
        Q.assert_clean(rep, "null_words")
    assert Q.assert_clean(rep, "duplicate_hashes") is rep


def test_near_duplicates(spark):
    qs = ["hoa hồng đỏ tặng mẹ", "Hoa hồng ĐỎ tặng mẹ", "hoa hồng đỏ tặng mẹ nhé", "lan trắng", "", None, "x"]
    df = spark.createDataFrame(list(enumerate(qs)), "id long, q string")
    out, pairs = V.near_duplicates(df, "id", "q")
    kept = {r.id for r in out.collect() if r.kept}
    assert kept == {0, 3, 4} and pairs.count() == 1 and out.count() == len(qs)
    r = random.Random(5)
    rows = [(i, " ".join(sorted({r.choice(WORDS) for _ in range(6)}))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, q string")
    sets = V.token_sets(df, "id", "q").select("set_id", "tokens").distinct()
    got = {frozenset((x.a, x.b)) for x in V.similar_sets(sets).collect()}
    all_sets = [(x.set_id, set(x.tokens)) for x in sets.collect()]
    want = {frozenset((a, b)) for a, s in all_sets for b, t in all_sets if a < b and len(s & t) >= 0.8 * len(s | t)}
    assert got == want


def test_samples_are_monotone_and_independent(spark):
    df = spark.createDataFrame([(f"{g}{i}", g) for g in "abc" for i in range(40)], "id string, g string")
    take = lambda n, sh: {r.id for r in V.balanced_sample(df, "g", "id", sh, n).collect()}
    few, many = take(20, {"a": 0.5, "b": 0.5}), take(40, {"a": 0.5, "b": 0.5})
    assert few < many and len(few) == 20 and len(many) == 40
    assert {x for x in take(20, {"a": 0.5, "c": 0.5}) if x[0] == "a"} == {x for x in few if x[0] == "a"}
    ids = V.stable_ids(df, ["id"]).orderBy("id").collect()
    assert [r.stable_id for r in ids] == [f"q{i:08d}" for i in range(1, 121)]


def test_citations(spark):
    answers = [("Giá 1.100.000đ [1].", 2), ("Giá 1.100.000đ.\nĐẹp [7][1]", 2), ("Còn mẫu M20?", 2), ("Không có.", 0), (None, 3), ("[2] [02] [12]", 1)]
    df = spark.createDataFrame([(i, a, n) for i, (a, n) in enumerate(answers)], "i int, a string, n int")
    rows = C.report(df, "a", "n").orderBy("i").collect()
    assert [(r.cited, r.invalid, r.n_uncited_claims, r.is_valid) for r in rows] == [
        ([1], [], 0, True), ([1], [7], 1, False), ([], [], 0, True), ([], [], 0, True), ([], [], 0, True), ([], [2, 12], 0, False),
    ]
    assert rows[4].unused == [1, 2, 3] and rows[3].unused == []
    assert [r.x for r in df.orderBy("i").select(C.strip_invalid("a", F.col("n")).alias("x")).collect()][1] == "Giá 1.100.000đ.\nĐẹp [1]"
    assert C.rates(C.report(df, "a", "n"), "n").first().n == 5
    h = spark.createDataFrame([(["a", "b", "c", "d", "e", "f"],)], "t array<string>")
    assert h.select(C.history(F.col("t"), F.lit(6)).alias("x"), C.history(F.col("t"), F.lit(1)).alias("y")).first() == (["b", "c", "d", "e"], [])
    assert spark.range(1).select(C.fenced_json(F.lit('```json\n{"a": 1}\n```'), "a int").alias("x")).first().x.a == 1


def test_tiers_of_claims_and_the_gate(spark):
    df = spark.createDataFrame([("Giá 1.100.000đ. Màu đỏ đẹp. Màu gì?\nCao hai mét [1].", 2)], "a string, n int")
    row = C.report(df, "a", "n", descriptive="(?iu)màu|cao").first()
    assert (row.n_uncited_claims, row.n_uncited_descriptive, row.has_citations, row.is_valid) == (1, 1, True, False)
    asked = spark.createDataFrame([("còn màu trắng?", 0), ("còn màu trắng?", 1), ("loại đó có giao tận nơi không", 1), ("hoa đó có giao tận nơi không", 1), (None, 2)], "q string, turns int")
    got = [r.x for r in asked.select(C.needs_context("q", F.col("turns"), "đó|còn", "hoa|bó").alias("x")).collect()]
    assert got == [False, True, True, False, True]


def test_cache_probe(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "key string")
    found, misses = C.probe(asked, spark.createDataFrame([("a", "x")], "key string, answer string"), "key", "answer")
    assert sorted((r.key or "", r.answer or "") for r in found.collect()) == [("", ""), ("a", "x"), ("b", ""), ("b", "")] and [r.key for r in misses.collect()] == ["b"]


def test_an_evaluation_set_is_built(spark):
    qs = [("q1", "hoa hồng đỏ tặng mẹ", "a"), ("q2", "Hoa hồng đỏ tặng MẸ", "a"), ("q3", "lan", "a"), ("q4", "kệ hoa chúc mừng", "b"), ("q5", "giỏ hoa cúc tím nhỏ", "a")]
    questions = spark.createDataFrame(qs, "id string, question string, intent string")
    labelled = spark.createDataFrame([("q4", ["u9"])], "id string, gold_urls array<string>")
    pool = spark.createDataFrame([("q1", "u1", "Bó hướng dương", 0.9), ("q1", "u2", "Lan", 0.1), ("q5", "u3", "Giỏ hoa cúc tím", 0.9)], "id string, url string, title string, score double")
    got = {r.id: r for r in V.build(questions, labelled, pool, "id", "question", "intent", {"a": 0.5, "b": 0.5}, 8, 1, lambda p: F.col("score") > 0.5).collect()}
    assert set(got) == {"q1", "q4", "q5"} and got["q4"].carried and got["q4"].gold_urls == ["u9"] and not got["q1"].carried
    assert got["q1"].gold_urls == ["u1"] and got["q5"].leaks and not got["q1"].leaks and sum(r.in_subset for r in got.values()) == 1
    assert sorted(r.stable_id for r in got.values()) == ["q00000001", "q00000002", "q00000003"]
    again = V.sticky_subset(spark.createDataFrame([("a", True), ("b", False), ("c", None)], "id string, f boolean"), "id", "f", F.col("id") != "c", 1).collect()
    assert {r.id: r.f for r in again}["a"] and sum(r.f for r in again) in (1, 2)
    assert {r.g: (r.n, r["keys"]) for r in V.by_group(spark.createDataFrame([("x", 2), ("x", 1)], "g string, k int"), "g", "k").collect()} == {"x": (2, [1, 2])}


def test_strict_pairing(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, 5), (2, 6)], "k int, w int")
    assert sorted(map(tuple, O.zip_strict(a, b, "k").collect())) == [(1, "x", 5), (2, "y", 6)]
    for bad in (b.where("k = 1"), b.union(b), b.selectExpr("k + 1 as k", "w")):
        with pytest.raises(ValueError):
            O.zip_strict(a, bad, "k")
