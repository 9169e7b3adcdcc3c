import random
import re
from datetime import datetime

from petalstream.operators import profile as P


def test_expressions_and_counts(spark):
    r = random.Random(0)
    rows = []
    for i in range(400):
        h = "".join(r.choice("0123456789abcdef") for _ in range(16))
        rows.append((i % 4, h.upper() if i % 50 == 1 else h[:9] if i % 50 == 2 else None if i % 50 == 3 else "" if i % 50 == 4 else h, f"https://a.example/bo-{i}-x/", i, "extra"))
    df = spark.createDataFrame(rows, "load long, h string, url string, price long, h2 string")
    out, found = P.profile(df, "load", ["h", "url"], ["price"])
    assert found["h"] == ["[0-9a-f]{16}"]
    got = {(x.load, x.column): x for x in out.collect()}
    for load in range(4):
        own = [x for x in rows if x[0] == load]
        hs = [x[1] for x in own]
        row = got[load, "h"]
        assert (row.n_rows, row.n_null, row.n_missing) == (100, sum(not h for h in hs), sum(h is None for h in hs))
        assert row.n_distinct == len({h for h in hs if h}) and row.n_values == sum(bool(h) for h in hs)
        assert row.n_violations == sum(bool(h) and (len(h) != 16 or h != h.lower()) for h in hs)
        assert (got[load, "price"].n_min, got[load, "price"].n_max) == (min(x[3] for x in own), max(x[3] for x in own))
        assert got[load, "url"].n_violations == 0
    loads = spark.createDataFrame([(i, 0, i + 1) for i in range(4)], "load long, run int, no int")
    changes = P.coverage_changes(out, "load", loads, "run", "no").where("column = 'url'").orderBy("load").collect()
    assert [c.coverage_before for c in changes] == [None, 1.0, 1.0, 1.0]


def test_empty_and_blank_tables(spark):
    none = spark.createDataFrame([], "load long, a string, n long")
    out, found = P.profile(none, "load", ["a"], ["n"])
    assert out.count() == 0 and found == {}
    blank = spark.createDataFrame([(None, None, None), (1, "", None), (1, "x" * 5000, 3)], "load long, a string, n long")
    rows = {(r.load, r.column): r for r in P.profile(blank, "load", ["a"], ["n"])[0].collect()}
    assert rows[None, "a"].n_null == 1 and rows[None, "a"].n_distinct == 0 and rows[1, "a"].n_distinct == 1 and rows[1, "n"].n_min == 3


def test_contracts_and_given_expressions(spark):
    df = spark.createDataFrame([(1, x) for x in ("aa", "ab", "1")], "load long, a string")
    out, found = P.profile(df, "load", ["a"], contracts={"a": "[0-9]"})
    assert found["a"] != ["[0-9]"] and (out.first().n_contract, out.first().n_violations) == (2, sum(re.fullmatch("|".join(found["a"]), x) is None for x in ("aa", "ab", "1")))
    again, _ = P.profile(df, "load", ["a"], expressions={"a": ["a.", "[0-9]"]})
    assert again.first().n_violations == 0


def test_shapes():
    assert P.expression("H", 16)[0] == "[0-9a-f]{16}"
    assert P.phrase("L-L-L/D") == f"{P.FOLD}L-{P.UNFOLD}/D" and P.phrase("<L/>") == "<L/>"
    assert P._phrase_expression("<L/>")[0] == "<[0-9a-z]+/>"
    assert P._phrase_expression(P.phrase("L-L-L/D"))[0] == "[0-9a-z]+(?:\\-[0-9a-z]+)*/[0-9]+"


def test_moments_and_text_ranges(spark):
    rows = [(1, "b", datetime(2024, 5, 2), 7), (1, "", datetime(2024, 4, 30, 1), 3), (1, "é", None, 5), (2, None, None, None)]
    df = spark.createDataFrame(rows, "load long, a string, at timestamp, n long")
    got = {(r.load, r.column): r for r in P.profile(df, "load", ["a"], ["n", "at"], ranges=True)[0].collect()}
    least, most = got[1, "at"].n_min, got[1, "at"].n_max
    assert most - least == (24 * 2 - 1) * 3_600_000_000 and least % 3_600_000_000 == 0 and got[1, "at"].n_distinct == 2 and got[1, "at"].n_null == 1
    assert (got[1, "a"].v_min, got[1, "a"].v_max, got[1, "n"].v_min, got[1, "n"].v_max) == ("b", "é", "3", "7") and got[2, "a"].v_min is None
    assert len(got) == 6


def test_every_column_of_products_is_profiled(spark, data):
    from petalstream.plans import catalogue as C
    from petalstream.sources.tables import table

    products = table(spark, data, "products")
    got = C.p5_profile(spark, data).groupBy("column").agg({"n_rows": "sum"}).collect()
    assert {r[0]: r[1] for r in got} == dict.fromkeys(set(products.columns) - {"load_id"}, products.count())


def test_a_repetition_is_credited_with_all_its_shapes(spark):
    values = ["-".join(f"12345678901{j}" if f >> i & 1 else f"ab12cd34ef5{j}" for i in range(9)) for f in range(512) for j in range(2)]
    df = spark.createDataFrame([(1, v) for v in values], "load long, slug string")
    found = P.induce(P.value_groups(df, "load", ["slug"]))["slug"]
    assert found[0] == r"[0-9a-f]+(?:\-[0-9a-f]+)*"


def test_long_values_are_described_by_their_words(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeghimnoprstuv") for _ in range(r.randrange(2, 9)))
    rows = [(1, ". ".join(" ".join(word() for _ in range(r.randrange(4, 12))) for _ in range(r.randrange(8, 30))) + ".") for _ in range(200)]
    rows += [(2, "x " * 20_000), (2, "  -- "), (2, "a")]
    df = spark.createDataFrame(rows, "load long, t string")
    out, found = P.profile(df, "load", ["t"])
    assert found["t"] == [P._words_expression("asp")]
    assert {x.load: x.n_violations for x in out.collect()} == {1: 0, 2: 1}


def test_long_values_of_one_shape(spark):
    line = "item number {} costs {} and weighs {} grams (net), delivered to the door of the house within the next {} days by our own couriers; see leaflet {}!"
    df = spark.createDataFrame([(1, line.format(*(f"n{i}x{j}" for j in range(5)))) for i in range(300)], "load long, t string")
    found = P.profile(df, "load", ["t"])[1]["t"]
    words = r"[\p{N}a-z]+(?:\s[\p{N}a-z]+)*+"
    assert found == [rf"{words}\s\([\p{{N}}a-z]+\),\s{words};\s{words}!"]


def test_profiles_of_products_against_brute_force(spark, data):
    """Violations and coverage of the expressions that were induced, counted once more value by value."""
    regex = __import__("regex")
    from petalstream.plans import catalogue as C
    from petalstream.sources.tables import table

    rows = table(spark, data, "products").collect()
    profile = {(r.load_id, r.column): r for r in C.p5_profile(spark, data).collect()}
    loads = sorted({r.load_id for r in rows})
    coverage = {}
    for c in C.TEXTS:
        for load in loads:
            values = [r[c] for r in rows if r.load_id == load]
            got = profile[load, c]
            java = "|".join(f"(?:{e})" for e in got.expressions.split(" | ")).replace(r"\s", r"[ \t\n\x0b\f\r]")  # there \s is ASCII
            say = regex.compile(f"(?V1s)(?:{java})")
            filled = [v for v in values if v]
            bad = sum(say.fullmatch(v) is None for v in filled)
            assert (got.n_rows, got.n_null, got.n_missing, got.n_values, got.n_distinct, got.n_violations) == (
                len(values), len(values) - len(filled), sum(v is None for v in values), len(filled), len(set(filled)), bad,
            ), (load, c)
            coverage[load, c] = (len(filled) - bad) / len(filled) if filled else None
    reports = {r.load_id: r for r in table(spark, data, "quality_corrupt").collect()}
    before = {k: max((x for x in reports.values() if x.run_id == r.run_id and x.load_no < r.load_no), key=lambda x: x.load_no, default=None) for k, r in reports.items()}
    got = C.p5_coverage(spark, data).collect()
    assert {(r.load_id, r.column) for r in got} == {k for k in coverage if k[0] in reports}
    for r in got:
        assert r.coverage == coverage[r.load_id, r.column]
        assert r.coverage_before == (coverage[before[r.load_id].load_id, r.column] if before[r.load_id] else None)
