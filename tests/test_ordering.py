import random

from petalstream.operators import ordering as O


def test_keep_first_and_last_with_ties_nulls_and_hot_keys(spark):
    rows = [(None if i % 3 else 1, i // 2, f"v{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "k int, at int, v string")
    first = {r.k: (r["at"], r.v) for r in O.keep_first(df, ["k"], ["at"]).collect()}
    assert first == {1: (0, "v0"), None: (0, "v1")}
    last = {r.k: (r["at"], r.v) for r in O.keep_last(df, ["k"], ["at"]).collect()}
    assert last == {1: (28, "v57"), None: (29, "v59")}
    assert O.keep_first(df.limit(0), ["k"], ["at"]).count() == 0


def test_global_rank_is_a_permutation_in_order(spark):
    xs = list(range(500))
    random.Random(1).shuffle(xs)
    df = spark.createDataFrame([(x, x % 7) for x in xs], "x int, y int")
    got = {r.x: r["rank"] for r in O.global_rank(df, ["y", "x"]).collect()}
    want = {x: i + 1 for i, x in enumerate(sorted(xs, key=lambda x: (x % 7, x)))}
    assert got == want
    assert O.global_rank(df.limit(0), ["x"]).count() == 0


def test_order_statistics(spark):
    values = [5.0, 1.0, 1.0, 9.0, 3.0, None, 2.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    xs = sorted(v for v in values if v is not None)
    got = {r.percent: r.value for r in O.order_statistics(df, "v", (0, 50, 95, 100)).collect()}
    assert got == {float(p): xs[min(round(p / 100 * (len(xs) - 1)), len(xs) - 1)] for p in (0, 50, 95, 100)}
    assert O.order_statistics(df.limit(0), "v", (50,)).count() == 0


def greedy(rows):
    seen, kept = [set(), set()], []
    for i, *keys in rows:
        if all(k is None or k not in s for k, s in zip(keys, seen)):
            kept.append(i)
            for k, s in zip(keys, seen):
                if k is not None:
                    s.add(k)
    return kept


def test_greedy_distinct_against_a_loop(spark):
    for seed in range(4):
        r = random.Random(seed)
        rows = [(i, r.choice([None, *range(9)]), r.choice([None, *range(9)])) for i in range(40)]
        df = spark.createDataFrame(rows, "i int, a int, b int")
        assert sorted(x.i for x in O.greedy_distinct(df, "i", ["a", "b"]).collect()) == greedy(rows)


def test_greedy_independent_against_a_loop(spark):
    r = random.Random(3)
    pairs = sorted({(a, b) for a, b in ((r.randrange(30), r.randrange(30)) for _ in range(60)) if a < b})
    kept = []
    for i in range(30):
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    nodes = spark.range(30).withColumnRenamed("id", "i")
    got = O.greedy_independent(nodes, "i", spark.createDataFrame(pairs, "a long, b long"))
    assert sorted(x.i for x in got.collect()) == kept
