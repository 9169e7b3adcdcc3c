import hashlib
import re
import unicodedata
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from petalstream.functions import html as H
from petalstream.functions import text as T

MANY = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TEXTS = st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=40), min_size=1, max_size=40)


def run(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


@MANY
@given(TEXTS)
def test_normal_forms_are_those_of_python(spark, values):
    assert run(spark, values, T.compose("v")) == [unicodedata.normalize("NFC", v) for v in values]
    assert run(spark, values, T.decompose("v")) == [unicodedata.normalize("NFD", v) for v in values]


@MANY
@given(st.lists(st.text("aAbéß.- \t\n_7đ…“漢", max_size=30), min_size=1, max_size=40))
def test_tokens_and_shingles(spark, values):
    want = [re.findall(r"\w+", v.lower()) for v in values]
    assert run(spark, values, T.tokens("v")) == want
    grams = [list(dict.fromkeys(" ".join(w[i : i + 3]) for i in range(len(w) - 2))) for w in want]
    assert run(spark, values, T.shingles(T.tokens("v"), 3)) == grams


def test_normalize_text(spark):
    values = ["  a   b\n", "NaN", " null ", None, "é", "<NA>", "\x1f", "nano"]
    assert run(spark, values, T.normalize_text("v")) == ["a b", "", "", "", "é", "", "", "nano"]


def test_folding(spark):
    assert run(spark, ["Đà Nẵng", "STRASSE", None], T.fold_diacritics("v")) == ["đa nang", "strasse", None]
    assert run(spark, ["Straße", "STRASSE", "Σς"], T.fold_case("v")) == ["strasse", "strasse", "σσ"]


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://X.example/A//", "https://x.example/a"), ("https://x.example/a/?q=1#f", "https://x.example/a"), ("https://x.example/a#f?g", "https://x.example/a"), (None, None), ("", "")],
)
def test_canonical_url(spark, url, want):
    assert run(spark, [url], T.canonical_url("v")) == [want]


@MANY
@given(TEXTS)
def test_uuid5_and_hash(spark, values):
    assert run(spark, values, T.uuid5("v")) == [str(uuid.uuid5(uuid.NAMESPACE_URL, v)) for v in values]
    assert run(spark, values, T.content_hash("v", "v")) == [hashlib.sha256(f"{v}\x1f{v}".encode()).hexdigest()[:16] for v in values]


def test_wrong_decoding_round_trip(spark):
    values = ["Bó hoa hồng", "plain", "Café", "汉字", "đà"]
    bad = [v.encode().decode("latin-1") for v in values]
    assert run(spark, values, T.misdecode("v")) == bad
    assert run(spark, bad, T.redecode("v"))[0] == values[0]
    assert run(spark, values, T.redecode("v")) == values
    assert run(spark, ["ROMÃ", "Ã©", "É»"], T.redecode("v")) == ["ROMÃ", "é", "É»"]


def test_html(spark):
    page = """<html><head><meta property="og:image" content="https://x/i.jpg"><meta name="description" content=" Two  words &amp; more"></head>
      <script>var a = "<h1>no</h1>"</script><h1 class="big product_title">Red <b>roses</b></h1><p><del>900</del><ins>800 &nbsp;k</ins></p></html>"""
    p = run(spark, [page, "", None, "<h1>open"], H.product("v"))
    assert (p[0].title, p[0].price_raw, p[0].image) == ("Red roses", "800 k", "https://x/i.jpg")
    assert p[1] == p[2] == ("", "", "", "") and p[3].title == ""
    xml = "<urlset><loc> https://a </loc>\n<loc>https://b</loc><loc>https://a</loc></urlset>"
    assert run(spark, [xml, None], H.sitemap_locs("v")) == [["https://a", "https://b"], []]
    assert run(spark, ["<p>a<br>b</p><style>x{}</style>"], H.strip_tags("v")) == ["a b"]


def test_null_words(spark):
    assert run(spark, ["NA", " none", "x", None], T.is_null_word("v")) == [True, True, False, False]
    assert run(spark, [None, "b"], F.coalesce(T.bare("v"), F.lit("-"))) == ["-", "b"]
