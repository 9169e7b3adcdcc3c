import collections
import random
import unicodedata

from petalstream.llm import repeated_lines as L

FIELDS = ("a", "b")


def bare(x):
    x = unicodedata.normalize("NFC", x.lower().replace("ß", "ss"))
    x = "".join(c for c in x if not c.isspace() and unicodedata.category(c)[0] != "P")
    return x if any(unicodedata.category(c)[0] == "L" for c in x) else ""


def brute(rows):
    total, seen = collections.Counter(), collections.Counter()
    for _, s, *vals in rows:
        total[s] += 1
        for b in {bare(x) for v in vals for x in (v or "").split("\n")} - {""}:
            seen[s, b] += 1
    sure = {k for k, n in seen.items() if n >= 5 and n * 20 >= total[k[0]]}
    return {(i, f, n) for i, s, *vals in rows for f, v in zip(FIELDS, vals) if v is not None for n, x in enumerate(v.split("\n"), 1) if (s, bare(x)) in sure}


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, a string, b string")


def make(n=400):
    r = random.Random(2)
    rows = []
    for i in range(n):
        s = r.choice(["hot", "hot", "small", None, f"s{i % 40}"])
        lines = [r.choice(["Legal notice!", "legal  NOTICE", "Theo dõi: tiệm", unicodedata.normalize("NFD", "theo dõi tiệm"), "***", "", f"own {i}", "7"]) for _ in range(4)]
        rows.append((i, s, "\n".join(lines[:2]) if i % 9 else None, "\r\n".join(lines[2:]) if i % 7 else ""))
    return rows


def found(df, **kw):
    lines = L.hashed_lines(df, "source", FIELDS, ["id"])
    sure = L.repeated_lines(lines, FIELDS, **kw)
    return {(r.id, r.field, r.line_no) for r in L.find_lines(lines, sure, FIELDS, "id").collect()}, sure


def test_against_brute_force(spark):
    rows = make()
    got, _ = found(table(spark, rows))
    assert got == brute(rows) and got


def test_by_shuffle_where_the_set_is_too_large_to_broadcast(spark, monkeypatch):
    from petalstream.plans import session

    rows = make()
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    df = table(spark, rows)
    assert found(df)[0] == brute(rows)
    cleaned = L.remove_lines(df, "source", FIELDS)
    monkeypatch.undo()
    assert sorted(map(repr, cleaned.collect())) == sorted(map(repr, L.remove_lines(df, "source", FIELDS).collect()))


def test_sketches_of_many_tasks_merge(spark):
    rows = make(600)
    got, _ = found(table(spark, rows).repartition(150))
    assert got == brute(rows)


def test_exact_where_the_sketch_cannot_tell(spark):
    rows = make(200)
    df = table(spark, rows)
    few = found(df, tracked=8)  # far too small: every source falls back to exact counts
    assert few[0] == found(df)[0] == brute(rows)


def test_removal_leaves_the_rest(spark):
    rows = [(i, "s", f"keep {i}\nSame line.\n\nend", None if i else "same LINE") for i in range(6)]
    df = table(spark, rows).selectExpr("*", "id as line", "'x' as h", "'y' as field", "'z' as salt")
    out = {r.id: (r.a, r.b, r.line, r.h, r.field, r.salt) for r in L.remove_lines(df, "source", FIELDS).collect()}
    assert out == {i: (f"keep {i}\n", "" if i == 0 else None, i, "x", "y", "z") for i in range(6)}


def test_removal_keeps_repeated_rows_and_nulls(spark):
    rows = [(1, None, "same\nown", None)] * 6 + [(2, None, None, "")]
    out = L.remove_lines(table(spark, rows), "source", FIELDS).collect()
    assert sorted((r.id, r.a, r.b) for r in out if r.id == 1) == [(1, "", None)] * 6
    assert [(r.a, r.b, r.source) for r in out if r.id == 2] == [(None, "", None)]


def test_empty_and_long(spark):
    none = spark.createDataFrame([], "id long, source string, a string, b string")
    got, sure = found(none)
    assert got == set() and sure.count() == 0 and L.remove_lines(none, "source", FIELDS).count() == 0
    long = "\n".join(f"line {i}" for i in range(20_000))
    df = table(spark, [(i, "s", long, None) for i in range(5)])
    lines = L.hashed_lines(df, "source", FIELDS, ["id"])
    assert L.find_lines(lines, L.repeated_lines(lines, FIELDS), FIELDS, "id").count() == 100_000
