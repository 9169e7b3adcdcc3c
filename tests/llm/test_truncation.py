import random

from petalstream.llm import truncation as T

SENTENCES = ["The roses last {} days in cold water.", "Each basket holds {} stems of lilies and tulips.", "Are you planning a wedding and don’t know what to send?", "Cut {}.5 cm off each stem before you place them in water!"]
CLOSING = ["Comes with card {} for a birthday", "Size: {} x 20 cm"]


def corpus(n=600):
    r = random.Random(4)
    out = []
    for i in range(n):
        text = " ".join(r.choice(SENTENCES).format(r.randrange(90)) for _ in range(4))
        if i % 3 == 0:
            text += "\n" + r.choice(CLOSING).format(r.randrange(90))
        out.append(text)
    return out


def cut(spark, texts, **kw):
    rows = [(i, f"s{i % 2}", t, "extra") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, source string, text string, tok string")
    found = T.truncated(df, "text", "id", "source", **kw)
    return {r.id for r in found.where("is_cut").collect()}, found


def test_cuts_are_found_and_whole_texts_are_not(spark):
    texts = corpus()
    r = random.Random(6)
    for i in range(0, 600, 10):
        at = r.randrange(12, len(texts[i]) - 12)
        while not texts[i][at - 1].isalpha() or not texts[i][at].isalpha() and texts[i][at] != " ":
            at -= 1
        texts[i] = texts[i][:at] + ("…" if i % 20 else " [...]" if i % 40 else "")
    got, found = cut(spark, texts)
    want = set(range(0, 600, 10))
    assert len(got & want) / len(want) > 0.9 and len(got & want) / len(got) > 0.95
    rates = {x.source: x.n_cut for x in T.truncation_rates(found, "source").collect()}
    assert sum(rates.values()) == len(got) and found.count() == 600


def test_blank_repeated_and_long_texts(spark):
    texts = corpus(200) + [None, "", "  \n ", "***", "nan"] + ["The roses last 4 days in"] * 30 + [" ".join(SENTENCES) * 500]
    got, found = cut(spark, texts)
    assert not got & set(range(200, 205)) and got >= set(range(205, 235)) and 235 not in got
    assert found.count() == len(texts)


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "id long, source string, text string")
    assert T.truncated(df, "text", "id", "source").count() == 0


def test_spaced_form(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("A 3.5 cm\n\n b. 花が",), ("",), ("\n\n",), ("x",)], "t string")
    assert [r.s for r in df.select(T.spaced(F.col("t")).alias("s")).collect()] == ["^ ^ a 0 cm $ ^ ^ b . 花 が @", "^ ^ @", "^ ^ @", "^ ^ x @"]


def test_a_long_token_broken_off(spark):
    """Beginnings of any length are counted: here of a token of 60 letters."""
    long = "".join(chr(97 + i * 7 % 26) for i in range(60))
    texts = corpus(300) + [f"Send it to {long} today." for _ in range(60)] + [f"Send it to {long[:45]}"]
    got, _ = cut(spark, texts)
    assert 360 in got and not got & set(range(300, 360))
