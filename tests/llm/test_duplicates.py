import collections
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from petalstream.llm import duplicates as D

FIELDS = ("title", "text")


def brute(rows):
    groups = collections.defaultdict(list)
    for key, i in rows:
        if key is not None:
            groups[key].append(i)
    return sorted((min(v), c) for v in groups.values() for c in sorted(v)[1:])


def links(df, **kw):
    return sorted(tuple(r) for r in D.copy_links(df, "key", "id", **kw).collect())


@pytest.mark.parametrize("parts", [2, 7])
def test_links_and_counts_with_a_hot_key(spark, parts):
    r = random.Random(parts)
    rows = [("hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{r.randrange(200)}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, id long")
    assert links(df, parts=parts) == brute(rows)
    want = collections.Counter(k for k, _ in rows if k is not None)
    firsts = {}
    for k, i in rows:
        firsts.setdefault(k, i)
    got = {x.id: x.n_copies for x in D.collapse(df, "key", "id", parts=parts).collect()}
    assert got == {firsts[k]: n for k, n in want.items()}


def test_a_run_longer_than_one_hand_over(spark):
    df = spark.range(230_000).select(F.lit("same").alias("key"), "id")
    got = D.copy_links(df, "key", "id", parts=2)
    assert got.agg(F.count("*"), F.min("first_id"), F.max("first_id"), F.count_distinct("copy_id"), F.min("copy_id")).first() == (229_999, 0, 0, 229_999, 1)


def test_edges(spark):
    none = spark.createDataFrame([], "key string, id long")
    assert links(none) == [] and D.collapse(none, "key", "id").count() == 0
    assert links(spark.createDataFrame([("a", 5), ("a", 5), ("b", 1)], "key string, id long")) == [(5, 5)]
    long = "x" * 300_000
    assert links(spark.createDataFrame([(long, 1), (long + "y", 2), (long, 3)], "key string, id long")) == [(1, 3)]


def keys(spark, rows):
    df = spark.createDataFrame(rows, "id long, url string, title string, text string, key2 string")
    return {r.id: r.key for r in D.with_key(df, "url", FIELDS).collect()}


def test_what_the_key_ignores(spark):
    a = "Bó hoa, đẹp!\nStraße"
    rows = [
        (1, "https://X.example/a-b/?b=2&a=1", a, None, "x"), (2, "HTTPS://x.example/A-B?A=1&B=2", unicodedata.normalize("NFD", a.upper()), "", "y"),
        (3, "https://x.example/a-b/?a=1&b=2", " bó  hoa đẹp straße. ", " \t", None), (4, "https://x.example/a-b/?a=2&b=1", a, None, None),
        (5, "https://x.example/a-b/?b=2&a=1", "", a, None), (6, None, None, None, None), (7, "", " ", "!", None),
    ]
    k = keys(spark, rows)
    assert k[1] == k[2] == k[3] and len({k[1], k[4], k[5], k[6]}) == 4 and k[6] == k[7]


def test_separators_in_texts_hide_nothing(spark):
    k = keys(spark, [(1, "u", "a\x1eb", "c", None), (2, "u", "a", "b\x1ec", None), (3, "u", "ab", "c", None), (4, "u", "a￿b", "c", None)])
    assert k[1] == k[3] != k[2] and k[4] != k[1]


def test_payloads(spark):
    rows = [(1, '{"Title": "a", "URL": "u"}'), (2, '{ "url":"u" , "title" : "A" }'), (3, None), (4, '{"url": "u", "ti'), (5, "[1]"), (6, '{"url": null, "title": 5}'), (7, "")]
    df = spark.createDataFrame(rows, "id long, payload string")
    got = {r.id: (r.url, r.title) for r in D.payload_members(df, "payload", ("url", "title")).collect()}
    assert got == {1: ("u", "a"), 2: ("u", "A"), 6: (None, "5")}


def test_keys_of_one_hash_over_several_partitions():
    """Two keys under one hash, cut by ids into three partitions: every piece of both is an edge."""
    import pyarrow as pa

    def scan(rows):
        out = D._scanner(False)(iter([pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["h", "key", "id"])]))
        return [tuple(r.values()) for b in out for r in b.to_pylist()]

    assert scan([(1, "x", 1), (1, "x", 2), (2, "y", 3), (2, "y", 4), (5, "a", 1), (5, "a", 3), (5, "b", 2)]) == [(1, [2], "x"), (3, [4], None), (1, [3], "a"), (2, [], "b")]
    assert scan([(5, "a", 5), (5, "b", 6)]) == [(5, [], "a"), (6, [], "b")]
    assert scan([(5, "a", 7), (5, "b", 8), (6, "c", 9), (7, "d", 9)]) == [(7, [], "a"), (8, [], "b"), (9, [], "d")]
