"""The queries of the core operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from petalstream.functions import html
from petalstream.functions import text as T
from petalstream.operators import citations, evaluation, evalset, ordering, profile, quality, retrieval, states
from petalstream.plans.session import cut
from petalstream.sources import files
from petalstream.sources.tables import spread, table
from petalstream.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


# ---- problem 5: profiles of the loads

TEXTS = ("shop", "url", "title", "price_raw", "description", "promo", "image", "content_hash")
#: The other columns but the group: profiled with least and greatest value, moments as microseconds since 1970.
NUMBERS = ("price_vnd", "seq", "crawled_at")
NULL_RATES = ("title", "description", "price_raw", "price_vnd", "image")
HASH_CONTRACT = "[0-9a-f]{16}"


def _profiled(
    spark: SparkSession, d: str, texts: Sequence[str] = TEXTS, numbers: Sequence[str] = NUMBERS, counted: Sequence[str] = (), ranges: bool = False, expressions: dict[str, list[str]] | None = None
) -> tuple[DataFrame, dict[str, list[str]]]:
    products = spread(table(spark, d, "products").select("load_id", *numbers, *texts, *counted))
    return profile.profile(products, "load_id", texts, numbers, {c: HASH_CONTRACT for c in texts if c == "content_hash"}, expressions, ranges, counted)


def _load_metrics(profiled: DataFrame, expressions: dict[str, list[str]]) -> DataFrame:
    """One row per load with the published metrics, rates in units of the fourth decimal, rounded down. Violations are of the expression that was
    induced for the hashes; where it isn't the contract, the contract's are counted, the exact check."""
    of = lambda c, x: F.max(F.when(F.col("column") == c, F.col(x)))
    empty = lambda c: of(c, "n_null") - of(c, "n_missing")
    distinct = lambda c: of(c, "n_distinct") + (empty(c) > 0).cast("long")
    n = F.max("n_rows")
    units = lambda x: ((x * 10000 - (x * 10000) % n) / n).cast("long")
    broken = of("content_hash", "n_violations" if expressions.get("content_hash") == [HASH_CONTRACT] else "n_contract")
    return profiled.groupBy("load_id").agg(
        n.alias("documents"), *[units(of(c, "n_null")).alias(f"null_rate.{c}") for c in NULL_RATES], units(n - of("price_vnd", "n_missing")).alias("price_parse_rate"),
        distinct("url").alias("distinct_urls"), (n - distinct("url")).alias("duplicate_urls"),
        (n - of("content_hash", "n_missing") - distinct("content_hash")).alias("duplicate_content_hashes"), (broken + empty("content_hash")).alias("hash_pattern_violations"),
        of("price_vnd", "n_min").alias("price_vnd_min"), of("price_vnd", "n_max").alias("price_vnd_max"),
        units(n - distinct("url")).alias("duplicate_share"),
    )


RATES = (*[f"null_rate.{c}" for c in NULL_RATES], "price_parse_rate")
COUNTS = ("documents", "distinct_urls", "duplicate_urls", "duplicate_content_hashes", "hash_pattern_violations", "price_vnd_min", "price_vnd_max")


@query(
    "p5_found",
    """
    WITH m AS (
      SELECT load_id, count(*) AS documents,
        count(*) FILTER (title IS NULL OR title = '') AS n_title, count(*) FILTER (description IS NULL OR description = '') AS n_description,
        count(*) FILTER (price_raw IS NULL OR price_raw = '') AS n_price_raw, count(*) FILTER (price_vnd IS NULL) AS n_price_vnd,
        count(*) FILTER (image IS NULL OR image = '') AS n_image, count(DISTINCT url) AS distinct_urls,
        count(content_hash) - count(DISTINCT content_hash) AS duplicate_content_hashes,
        count(*) FILTER (content_hash IS NOT NULL AND NOT regexp_full_match(content_hash, '[0-9a-f]{16}')) AS hash_pattern_violations,
        min(price_vnd) AS price_vnd_min, max(price_vnd) AS price_vnd_max
      FROM products GROUP BY load_id),
    j AS (
      SELECT q.load_id, q.run_id, q.load_no, q.null_rate, q.price_parse_rate AS p_parse, coalesce(m.documents, 0) AS n, m.* EXCLUDE (load_id),
        m.documents - m.distinct_urls AS duplicate_urls, q.documents AS p_documents, q.duplicate_urls AS p_duplicate_urls, q.distinct_urls AS p_distinct_urls,
        q.duplicate_content_hashes AS p_hashes, q.hash_pattern_violations AS p_violations, q.price_vnd_min AS p_min, q.price_vnd_max AS p_max
      FROM quality_corrupt q LEFT JOIN m USING (load_id)),
    long AS (
      SELECT load_id, run_id, load_no, unnest([
        {'metric': 'documents', 'v': n, 'p': p_documents::DOUBLE, 'rate': false, 's': NULL::BIGINT},
        {'metric': 'null_rate.title', 'v': n_title * 10000 // n, 'p': null_rate.title, 'rate': true, 's': n_title * 10000 // n},
        {'metric': 'null_rate.description', 'v': n_description * 10000 // n, 'p': null_rate.description, 'rate': true, 's': n_description * 10000 // n},
        {'metric': 'null_rate.price_raw', 'v': n_price_raw * 10000 // n, 'p': null_rate.price_raw, 'rate': true, 's': n_price_raw * 10000 // n},
        {'metric': 'null_rate.price_vnd', 'v': n_price_vnd * 10000 // n, 'p': null_rate.price_vnd, 'rate': true, 's': n_price_vnd * 10000 // n},
        {'metric': 'null_rate.image', 'v': n_image * 10000 // n, 'p': null_rate.image, 'rate': true, 's': n_image * 10000 // n},
        {'metric': 'price_parse_rate', 'v': (n - n_price_vnd) * 10000 // n, 'p': p_parse, 'rate': true, 's': (n - n_price_vnd) * 10000 // n},
        {'metric': 'distinct_urls', 'v': distinct_urls, 'p': p_distinct_urls::DOUBLE, 'rate': false, 's': NULL},
        {'metric': 'duplicate_urls', 'v': duplicate_urls, 'p': p_duplicate_urls::DOUBLE, 'rate': false, 's': duplicate_urls * 10000 // n},
        {'metric': 'duplicate_content_hashes', 'v': duplicate_content_hashes, 'p': p_hashes::DOUBLE, 'rate': false, 's': NULL},
        {'metric': 'hash_pattern_violations', 'v': hash_pattern_violations, 'p': p_violations::DOUBLE, 'rate': false, 's': NULL},
        {'metric': 'price_vnd_min', 'v': price_vnd_min, 'p': p_min::DOUBLE, 'rate': false, 's': NULL},
        {'metric': 'price_vnd_max', 'v': price_vnd_max, 'p': p_max::DOUBLE, 'rate': false, 's': NULL}]) AS x
      FROM j),
    w AS (SELECT load_id, load_no, x.metric AS metric, x.v AS v, x.p AS p, x.rate AS rate, x.s AS s,
            lag(x.s) OVER (PARTITION BY run_id, x.metric ORDER BY load_no) AS before FROM long)
    SELECT load_id, metric, 'misreported' AS kind FROM w
    WHERE p IS NOT NULL AND (v IS NULL OR abs(p - CASE WHEN rate THEN v / 10000.0 ELSE v END) > 1e-9)
    UNION ALL
    SELECT load_id, metric, 'shifted' AS kind FROM w WHERE load_no > 1 AND abs(s - before) > 1000
    """,
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The published reports that differ from the profiles, and the shifts between loads of a run."""
    profiled, expressions = _profiled(spark, d, ("url", "content_hash"), ("price_vnd",), ("title", "description", "price_raw", "image"))
    measured = cut(_load_metrics(profiled, expressions))
    published = table(spark, d, "quality_corrupt")
    rows = published.select(
        "load_id", "run_id", "load_no", F.struct(*[F.col(c).cast("double").alias(c) for c in COUNTS], *[F.col(c).alias(c) for c in RATES]).alias("p")
    ).join(measured.select(F.col("load_id").alias("m_load_id"), F.struct(*[c for c in ("duplicate_share",)], *[F.col(f"`{c}`") for c in (*COUNTS, *RATES)]).alias("m")), F.col("load_id") == F.col("m_load_id"), "left")
    none = F.lit(None).cast("long")
    got = lambda c: F.col(f"m.`{c}`").cast("long")
    each = [F.struct(F.lit(c).alias("metric"), (F.coalesce(got(c), F.lit(0)) if c == "documents" else got(c)).alias("v"), F.col(f"p.`{c}`").alias("p"), F.lit(1.0).alias("unit"),
                     (got("duplicate_share") if c == "duplicate_urls" else none).alias("s")) for c in COUNTS]
    each += [F.struct(F.lit(c).alias("metric"), got(c).alias("v"), F.col(f"p.`{c}`").alias("p"), F.lit(10000.0).alias("unit"), got(c).alias("s")) for c in RATES]
    long = rows.select("load_id", "run_id", "load_no", F.explode(F.array(*each)).alias("x")).select("load_id", "run_id", "load_no", "x.*")
    before = F.lag("s").over(Window.partitionBy("run_id", "metric").orderBy("load_no"))
    long = long.withColumn("before", before)
    differs = F.col("p").isNotNull() & (F.col("v").isNull() | (F.abs(F.col("p") - F.col("v") / F.col("unit")) > 1e-9))
    shifted = (F.col("load_no") > 1) & (F.abs(F.col("s") - F.col("before")) > 1000)
    kinds = F.array_compact(F.array(F.when(differs, "misreported"), F.when(shifted, "shifted")))
    return long.select("load_id", "metric", F.explode(kinds).alias("kind"))


@query("p5_profile")
def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile of every column by load, with the expressions that were induced."""
    profiled, expressions = _profiled(spark, d, ranges=True)
    named = F.create_map(*[x for c, e in expressions.items() for x in (F.lit(c), F.lit(" | ".join(e)))])
    return profiled.withColumn("expressions", named[F.col("column")])


@query("p5_coverage")
def p5_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of each column its expressions describe, load by load, beside the load before."""
    profiled, _ = _profiled(spark, d)
    return profile.coverage_changes(profiled, "load_id", table(spark, d, "quality_corrupt"), "run_id", "load_no")


#: Expressions of an agreement, for a profile that induces none.
AGREED = {"url": ["https?://[a-z0-9.-]+(?:/[^?#]*)?"], "content_hash": [HASH_CONTRACT], "price_raw": ["[0-9][0-9.]* ?₫", "[0-9]+k"]}


def _agreed_sql() -> str:
    plain = lambda c: f"CAST({c} AS VARCHAR)"
    micros = lambda c: f"epoch_us({c})" if c == "crawled_at" else c
    parts = []
    for c in (*TEXTS, *NUMBERS):
        text = c in TEXTS
        bad = f"count(*) FILTER ({c} <> '' AND NOT regexp_full_match({c}, '{'|'.join(AGREED[c])}'))" if c in AGREED else "0" if text else "NULL::BIGINT"
        broken = f"count(*) FILTER ({c} <> '' AND NOT regexp_full_match({c}, '{HASH_CONTRACT}'))" if c == "content_hash" else "NULL::BIGINT"
        ends = "NULL::BIGINT AS n_min, NULL::BIGINT AS n_max" if text else f"min({micros(c)}) AS n_min, max({micros(c)}) AS n_max"
        parts.append(
            f"SELECT load_id, '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER ({c} IS NULL OR {plain(c)} = '') AS n_null, count(*) - count({c}) AS n_missing, "
            f"count(*) FILTER ({plain(c)} <> '') AS n_values, count(DISTINCT nullif({plain(c)}, '')) AS n_distinct, {bad} AS n_violations, {broken} AS n_contract, {ends} FROM products GROUP BY load_id"
        )
    return " UNION ALL ".join(parts)


@query("p5_agreed", _agreed_sql())
def p5_agreed(spark: SparkSession, d: str) -> DataFrame:
    """The profile of every column by load for expressions that were agreed on, as those of an earlier load."""
    return _profiled(spark, d, expressions={c: [profile.ANY] for c in TEXTS} | AGREED)[0]


# ---- text columns

TOK = r"[\p{L}\p{N}_]+"
SPACES = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


@query("normalize_text", rf"""
    WITH s AS (SELECT doc_id, trim(regexp_replace(nfc_normalize(coalesce(text, '')), '{SPACES}', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, CASE WHEN lower(t) IN ('nan', 'none', 'null', '<na>') THEN '' ELSE t END AS text FROM s""")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalize_text("text").alias("text"))


@query("fold_diacritics", "SELECT id, strip_accents(lower(question)) AS folded FROM golden")
def fold_diacritics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "golden").select("id", T.fold_diacritics("question").alias("folded"))


@query("canonical_url", "SELECT seq, lower(regexp_replace(regexp_replace(url, '[?#](.|\\n)*$', ''), '/+$', '')) AS canon FROM products")
def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("seq", T.canonical_url("url").alias("canon"))


HASHED = ("url", "title", "price_raw", "description", "promo", "image")


@query("content_hash16", "SELECT seq, left(sha256(" + " || chr(31) || ".join(f"coalesce({c}, '')" for c in HASHED) + "), 16) AS h FROM products")
def content_hash16(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("seq", T.content_hash(*HASHED).alias("h"))


@query("point_id_v5", r"""
    WITH h AS (SELECT seq, lower(sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url))) AS h FROM products)
    SELECT seq, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
      substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def point_id_v5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("seq", T.uuid5("url").alias("point_id"))


@query("embed_text", """
    SELECT seq, concat_ws(' . ', nullif(title, ''), nullif(description, '')) AS embed,
      CASE WHEN coalesce(title, '') = '' OR coalesce(price_raw, '') = '' OR coalesce(description, '') = '' OR coalesce(promo, '') = ''
        THEN 'nan' ELSE concat_ws(' ', title, price_raw, description, promo) END AS naive FROM products""")
def embed_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("seq", states.embed_text("title", "description").alias("embed"), states.baseline_text("title", "price_raw", "description", "promo").alias("naive"))


_BYTES_AS_CHARS = "array_to_string(list_transform(range(0, octet_length(encode(title))::BIGINT), lambda i: chr(('0x' || substr(hex(encode(title)), (2 * i + 1)::BIGINT, 2))::INT)), '')"


@query("misdecoded_titles", f"""
    SELECT seq, {_BYTES_AS_CHARS} AS bad, regexp_matches(title, 'Ã[\\x{{80}}-\\x{{BF}}]|á»|áº|Æ°|Ä‘|â€') AS shows,
      CASE WHEN NOT regexp_matches(title, 'Ã[\\x{{80}}-\\x{{BF}}]|á»|áº|Æ°|Ä‘|â€') AND regexp_matches({_BYTES_AS_CHARS}, 'Ã[\\x{{80}}-\\x{{BF}}]|á»|áº|Æ°|Ä‘|â€') THEN title END AS back
    FROM products WHERE title IS NOT NULL""")
def misdecoded_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles read in another encoding, whether they show it as they are, and what the repair makes of the misread ones that show it."""
    rows = table(spark, d, "products").where("title is not null").select("seq", "title", T.misdecode("title").alias("bad"))
    shows = T.looks_misdecoded("title")
    return rows.select("seq", "bad", shows.alias("shows"), F.when(~shows & T.looks_misdecoded("bad"), T.redecode("bad")).alias("back"))


@query("folded_tokens", f"SELECT id, regexp_extract_all(strip_accents(lower(coalesce(question, ''))), '{TOK}') AS tokens FROM golden")
def folded_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "golden").select("id", T.folded_tokens("question").alias("tokens"))


@query("normalized_body", rf"SELECT seq, trim(regexp_replace(nfc_normalize(lower(coalesce(title, '') || ' ' || coalesce(description, ''))), '{SPACES}', ' ', 'g')) AS body FROM products")
def normalized_body(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("seq", T.normalized_body("title", "description").alias("body"))


@query("iso_dates", "SELECT seq, strftime(crawled_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM products")
def iso_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("seq", T.iso_date("crawled_at").alias("day"))


PAGES = (
    ("https://a.example/1", '<html><head><meta name="description" content="Two  words &amp; more"></head><h1 class="product_title">Red <b>roses</b></h1><img data-large_image="https://a.example/l.jpg" src="https://a.example/s.jpg"><ins>800 k</ins></html>'),
    ("https://a.example/2", '<h1>Lilies</h1><div class="short-description"><p>Fresh<br>today</p></div><img src="https://a.example/x.jpg" data-large_image="l.jpg"><span class="amount">9&nbsp;k</span>'),
    ("https://a.example/3", '<meta property="og:image" content="https://a.example/o.png"><script>var t = "<h1>no</h1>"</script><img src="logo.png">'),
    ("https://a.example/4", "<h1>open"), ("https://a.example/5", ""),
)


@query("parsed_pages", """
    SELECT * FROM (VALUES ('https://a.example/1', 'Red roses', 'Two words & more', '800 k', 'https://a.example/l.jpg'), ('https://a.example/2', 'Lilies', 'Fresh today', '9 k', 'https://a.example/x.jpg'),
      ('https://a.example/3', 'no', '', '', 'https://a.example/o.png'), ('https://a.example/4', '', '', '', ''), ('https://a.example/5', '', '', '', '')) AS p(url, title, description, price_raw, image)""")
def parsed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a table of constants, taken apart."""
    return files.values_table(spark, list(PAGES), "url string, html string").select("url", html.product("html").alias("p")).select("url", "p.*")


@query("sitemap_children", "SELECT * FROM (VALUES (0, 'https://a/product-sitemap1.xml'), (1, 'https://a/product-sitemap2.xml')) AS s(place, loc)")
def sitemap_children(spark: SparkSession, d: str) -> DataFrame:
    index = "<sitemapindex>" + "".join(f"<sitemap><loc> https://a/{n}.xml </loc></sitemap>" for n in ("product-sitemap1", "page-sitemap", "product-sitemap2", "product-sitemap1")) + "</sitemapindex>"
    return files.values_table(spark, [(index,)], "xml string").select(F.posexplode(html.child_sitemaps("xml")).alias("place", "loc"))


@query("phrase_contains", rf"""
    SELECT id, contains(' ' || array_to_string(regexp_extract_all(lower(question), '{TOK}'), ' ') || ' ', ' lan hồ điệp ') AS has_phrase FROM golden""")
def phrase_contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "golden").select("id", evalset.contains_phrase(F.col("question"), "lan hồ điệp").alias("has_phrase"))


# ---- corpus health

DOC_TOKENS = f"SELECT doc_id, lang, source, text, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{TOK}'))) AS token FROM documents"


@query("token_doc_freq", f"SELECT token, count(*) AS df FROM ({DOC_TOKENS}) GROUP BY token")
def token_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return quality.document_frequency(table(spark, d, "documents"), "text")


FILLED = "SELECT source, count(*) AS n FROM documents WHERE text <> '' GROUP BY source"


@query("boilerplate_tokens", f"""
    SELECT t.source, token, count(*) AS df FROM ({DOC_TOKENS}) t JOIN ({FILLED}) n ON t.source = n.source
    GROUP BY t.source, token, n.n HAVING count(*) >= 0.3 * n.n""")
def boilerplate_tokens(spark: SparkSession, d: str) -> DataFrame:
    return quality.boilerplate_tokens(table(spark, d, "documents"), "text", ["source"], 0.3)


@query("boilerplate_ratio", f"""
    WITH f AS (SELECT t.source, token, count(*) AS df, n.n FROM ({DOC_TOKENS}) t JOIN ({FILLED}) n ON t.source = n.source GROUP BY t.source, token, n.n)
    SELECT source, round(sum(CASE WHEN df >= 0.3 * n THEN df ELSE 0 END) / sum(df), 6) AS ratio FROM f GROUP BY source""")
def boilerplate_ratio(spark: SparkSession, d: str) -> DataFrame:
    return quality.boilerplate_ratio(table(spark, d, "documents"), "text", ["source"], 0.3).select("source", F.round("ratio", 6).alias("ratio"))


GRAMS = f"""
    w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{TOK}') AS t FROM documents),
    g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i + 7], ' ')))) AS g FROM w WHERE len(t) >= 8),
    r AS (SELECT g, count(*) AS df FROM g GROUP BY g HAVING count(*) >= greatest(2, floor(0.005 * (SELECT count(*) FROM documents))))"""


@query("repeated_passages", f"WITH {GRAMS} SELECT df, count(*) AS n_passages FROM r GROUP BY df")
def repeated_passages(spark: SparkSession, d: str) -> DataFrame:
    return quality.repeated_passages(table(spark, d, "documents"), "text", "doc_id", 8, 0.005).groupBy("df").agg(F.count("*").alias("n_passages"))


@query("repeated_share", f"WITH {GRAMS} SELECT doc_id, round(count(r.g) / count(*), 6) AS share FROM g LEFT JOIN r USING (g) GROUP BY doc_id")
def repeated_share(spark: SparkSession, d: str) -> DataFrame:
    return quality.repeated_share(table(spark, d, "documents"), "text", "doc_id", 8, 0.005).select("doc_id", F.round("share", 6).alias("share"))


@query("quality_report", """
    SELECT shop, count(*) AS documents, count(*) FILTER (coalesce(title, '') = '') AS null_title, count(*) FILTER (coalesce(description, '') = '') AS null_description,
      count(*) FILTER (lower(trim(coalesce(title, ''))) IN ('nan', 'none', 'null', '<na>', 'na') OR lower(trim(coalesce(description, ''))) IN ('nan', 'none', 'null', '<na>', 'na')) AS null_words,
      count(url) - count(DISTINCT url) AS duplicate_urls, count(content_hash) - count(DISTINCT content_hash) AS duplicate_hashes
    FROM products GROUP BY shop""")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_report(table(spark, d, "products"), "url", ("title", "description"), "content_hash", ["shop"])


@query("url_variants", """
    WITH c AS (SELECT lower(regexp_replace(regexp_replace(url, '[?#](.|\\n)*$', ''), '/+$', '')) AS canon, url FROM products)
    SELECT canon, count(*) AS n_rows, count(DISTINCT url) AS n_forms FROM c GROUP BY canon HAVING count(DISTINCT url) > 1""")
def url_variants(spark: SparkSession, d: str) -> DataFrame:
    return quality.url_variants(table(spark, d, "products"), "url")


@query("freshness", """
    SELECT shop, min(floor((epoch_us(TIMESTAMPTZ '2025-01-01 00:00:00+00') - epoch_us(crawled_at)) / 86400000000))::BIGINT AS newest_days,
      max(floor((epoch_us(TIMESTAMPTZ '2025-01-01 00:00:00+00') - epoch_us(crawled_at)) / 86400000000))::BIGINT AS oldest_days FROM products GROUP BY shop""")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    return quality.freshness(table(spark, d, "products"), "crawled_at", F.lit("2025-01-01 00:00:00").cast("timestamp"), ["shop"])


# ---- states


@query("clean_drop_reasons", """
    WITH e AS (SELECT seq, url, CASE WHEN NOT starts_with(url, 'https://') THEN 'unwanted' WHEN coalesce(title, '') = '' THEN 'no_title' END AS early FROM products),
    f AS (SELECT url, min(seq) AS first FROM e WHERE early IS NULL GROUP BY url)
    SELECT coalesce(early, CASE WHEN seq > first THEN 'duplicate' END) AS drop_reason, count(*) AS n FROM e LEFT JOIN f USING (url) GROUP BY 1""")
def clean_drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    products = table(spark, d, "products").select("seq", "url", "title")
    return states.clean(products, "url", "title", "seq", F.col("url").startswith("https://")).groupBy("drop_reason").agg(F.count("*").alias("n"))


@query("keep_first_url", "SELECT url, min(seq) AS seq FROM products GROUP BY url")
def keep_first_url(spark: SparkSession, d: str) -> DataFrame:
    return ordering.keep_first(table(spark, d, "products").select("url", "seq"), ["url"], ["seq"])


DRAW = "('0x' || left(md5(concat_ws(':', '42', '{0}', seq)), 8))::BIGINT / 4294967296.0"


_CLONE = "['//', '/?utm_source=google', '/?ref=fb'][floor(" + DRAW.format("form") + " * 3)::INT + 1]"
_LATIN = "array_to_string(list_transform(range(0, octet_length(encode({0}))::BIGINT), lambda i: chr(('0x' || substr(hex(encode({0})), (2 * i + 1)::BIGINT, 2))::INT)), '')"
_HIT = {k: f"({DRAW.format(k)} < {r})" for k, r in states.RATES.items()}
_WHICH = f"floor({DRAW.format('field')} * 2)"
CORRUPT = f"""
    c0 AS (SELECT seq, url, CASE WHEN {_HIT['missing_field']} AND {_WHICH} = 1 THEN '' ELSE coalesce(title, '') END AS title,
        CASE WHEN {_HIT['missing_field']} AND {_WHICH} = 0 THEN '' ELSE coalesce(description, '') END AS body FROM products),
    c1 AS (SELECT seq, url, title, CASE WHEN {_HIT['boilerplate_flood']} THEN '{states.FLOOD}' || ' ' || body ELSE body END AS body FROM c0),
    c2 AS (SELECT seq, url, title, CASE WHEN {_HIT['truncation']} THEN left(body, floor({DRAW.format('length')} * 26)::INT) ELSE body END AS body FROM c1),
    c3 AS (SELECT seq, url, CASE WHEN {_HIT['mojibake']} THEN {_LATIN.format('title')} ELSE title END AS title, CASE WHEN {_HIT['mojibake']} THEN {_LATIN.format('body')} ELSE body END AS description,
        list_filter([CASE WHEN {_HIT['missing_field']} THEN 'missing_field' END, CASE WHEN {_HIT['boilerplate_flood']} THEN 'boilerplate_flood' END,
          CASE WHEN {_HIT['truncation']} THEN 'truncation' END, CASE WHEN {_HIT['mojibake']} THEN 'mojibake' END], lambda x: x IS NOT NULL) AS labels FROM c2),
    bad AS (SELECT * FROM c3 UNION ALL SELECT seq, regexp_replace(url, '/+$', '') || {_CLONE}, title, description, ['duplication'] FROM c3 WHERE {_HIT['duplication']})"""


def _corrupted(spark: SparkSession, d: str) -> DataFrame:
    return states.corrupt(table(spark, d, "products").select("seq", "url", "title", "description"), "seq", "url", "title", "description")


@query("corrupted", f"WITH {CORRUPT} SELECT seq, url, md5(title) AS title, md5(description) AS description, labels FROM bad")
def corrupted(spark: SparkSession, d: str) -> DataFrame:
    """The damaged table itself, texts by their digest."""
    return _corrupted(spark, d).withColumns({c: F.md5(c) for c in ("title", "description")})


@query("corrupt_summary", f"WITH {CORRUPT} SELECT l AS label, count(*) AS n, sum(length(description)) AS chars FROM (SELECT unnest(labels) AS l, description FROM bad) GROUP BY l")
def corrupt_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _corrupted(spark, d).select("description", F.explode("labels").alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("description")).alias("chars"))


@query("urls_with_label", f"WITH {CORRUPT} SELECT DISTINCT url FROM bad WHERE list_contains(labels, 'mojibake')")
def urls_with_label(spark: SparkSession, d: str) -> DataFrame:
    return states.urls_with(_corrupted(spark, d).select("url", F.explode("labels").alias("label")), "mojibake")


@query("shuffled_rows", "SELECT row_number() OVER (ORDER BY md5(concat_ws(':', '42', 'shuffle', seq::VARCHAR)), seq) - 1 AS place, seq FROM products")
def shuffled_rows(spark: SparkSession, d: str) -> DataFrame:
    return ordering.shuffled(table(spark, d, "products").select("seq"), ["seq"], name="place")


def _mended(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The damaged table in a drawn order, and the same mended."""
    bad = cut(ordering.shuffled(_corrupted(spark, d), ["url", "seq"]))
    return bad, states.mend(bad, "seq", "url", "title", "description", min_share=0.005)


@query("repair_scores")
def repair_scores(spark: SparkSession, d: str) -> DataFrame:
    """Damage is found again: precision, recall and F1 of each label, and of any, against the truth."""
    bad, mended = _mended(spark, d)
    truth, found = bad.select("url", F.explode("labels").alias("label")), cut(mended.select("url", F.explode("found").alias("label")))
    return states.prf(truth, found).unionByName(states.any_defect(truth, found))


@query("repaired")
def repaired(spark: SparkSession, d: str) -> DataFrame:
    return _mended(spark, d)[1].where("kept").select("url", "title", "description", "new_hash")


# sentences are told as by a split after a stop: RE2 has no look-behind
_PARTS = r"""
    s0 AS (SELECT {key}, string_split(regexp_replace(coalesce({text}, ''), '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS p FROM {table}),
    s1 AS (SELECT {key}, unnest(p) AS s, generate_subscripts(p, 1) AS pos FROM s0),
    s2 AS (SELECT *, regexp_extract_all(lower(s), '{TOK}') AS t FROM s1),
    sh AS (SELECT token FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(coalesce({text}, '')), '{TOK}'))) AS token FROM {table}) GROUP BY token
           HAVING count(*) >= 0.6 * (SELECT count(*) FROM {table} WHERE {text} <> '')),
    sg AS (SELECT {key}, pos, unnest(list_distinct(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i + 7], ' ')))) AS g FROM s2 WHERE len(t) >= 8),
    b1 AS (SELECT {key}, pos, count(r.g) * 2 >= count(*) AS bad FROM sg LEFT JOIN r USING (g) GROUP BY {key}, pos),
    b2 AS (SELECT {key}, pos, count(sh.token) >= 0.85 * count(*) AS bad FROM (SELECT {key}, pos, unnest(t) AS token FROM s2) LEFT JOIN sh USING (token) GROUP BY {key}, pos),
    kept AS (SELECT s2.{key}, trim(string_agg(s, ' ' ORDER BY s2.pos)) AS k FROM s2 LEFT JOIN b1 ON b1.{key} = s2.{key} AND b1.pos = s2.pos LEFT JOIN b2 ON b2.{key} = s2.{key} AND b2.pos = s2.pos
             WHERE len(t) > 0 AND NOT coalesce(b1.bad, false) AND NOT coalesce(b2.bad, false) GROUP BY s2.{key})"""
_BAD = "Ã[\\x{80}-\\x{BF}]|á»|áº|Æ°|Ä‘|â€"
_JUNK = "lower(trim(coalesce({0}, ''))) IN ('', 'nan', 'none', 'null', '<na>', 'na')"


@query("strip_repeated", f"WITH {GRAMS}, {_PARTS.replace('{TOK}', TOK).replace('{key}', 'doc_id').replace('{text}', 'text').replace('{table}', 'documents')} SELECT doc_id, coalesce(nullif(k, ''), text) AS text FROM documents LEFT JOIN kept USING (doc_id)")
def strip_repeated(spark: SparkSession, d: str) -> DataFrame:
    return states.strip_repeated(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id", 0.005)


@query("detected", f"""
    WITH {GRAMS.replace('documents', 'products').replace('doc_id', 'seq').replace('text', 'description')},
    v AS (SELECT seq, round(count(r.g) / count(*), 9) AS share FROM g LEFT JOIN r USING (g) GROUP BY seq),
    x AS (SELECT p.*, {_JUNK.format('title')} OR {_JUNK.format('description')} AS missing, regexp_matches(coalesce(title, ''), '{_BAD}') OR regexp_matches(coalesce(description, ''), '{_BAD}') AS garbled,
        CASE WHEN {_JUNK.format('description')} AND trim(coalesce(description, '')) <> '' THEN '' ELSE coalesce(description, '') END AS fixed FROM products p)
    SELECT x.seq, missing, garbled, CASE WHEN NOT garbled THEN length(fixed) BETWEEN 1 AND 29 END AS truncated, CASE WHEN NOT garbled THEN coalesce(share, 0) >= 0.3 END AS flooded FROM x LEFT JOIN v USING (seq)""")
def detected(spark: SparkSession, d: str) -> DataFrame:
    """The damage that `products` shows as it is. Of garbled texts, which SQL doesn't restore, only that."""
    rows = table(spark, d, "products").select("seq", "url", "title", "description")
    found = states.detect(rows, "seq", "url", "title", "description", min_share=0.005)
    has = lambda x: F.array_contains("found", x)
    sound = lambda x: F.when(~has("mojibake"), has(x))
    return found.select("seq", has("missing_field").alias("missing"), has("mojibake").alias("garbled"), sound("truncation").alias("truncated"), sound("boilerplate_flood").alias("flooded"))


# ---- retrieval

DOT = "list_inner_product(d.embedding::DOUBLE[], q.embedding::DOUBLE[])"
DENSE = f"""
    s AS (SELECT q.vec_id AS query_id, d.vec_id, round({DOT}, 6) AS score FROM embeddings d, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS hit_rank FROM s QUALIFY hit_rank <= 5)"""


def _dense(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.dense_top_k(e, queries, "vec_id", "query_id", "embedding", k)


@query("dense_topk", f"WITH {DENSE} SELECT query_id, vec_id, score, hit_rank FROM k")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d)


@query("dense_topk_threshold", f"WITH {DENSE} SELECT query_id, vec_id, score, hit_rank FROM k WHERE score >= 0.3")
def dense_topk_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d).where("score >= 0.3")


@query("abstentions", f"WITH {DENSE} SELECT DISTINCT s.query_id, s.query_id NOT IN (SELECT query_id FROM k WHERE score >= 0.35 AND vec_id <> query_id) AS abstained FROM s")
def abstentions(spark: SparkSession, d: str) -> DataFrame:
    queries = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    return retrieval.abstentions(queries, _dense(spark, d).where("score >= 0.35 and vec_id != query_id"), "query_id")


@query("knn_label_precision", f"""
    WITH {DENSE} SELECT k.query_id, round(avg((a.label = b.label)::INT), 6) AS label_precision
    FROM k JOIN embeddings a ON a.vec_id = k.vec_id JOIN embeddings b ON b.vec_id = k.query_id GROUP BY k.query_id""")
def knn_label_precision(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    hits = _dense(spark, d).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return hits.groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("own")).cast("int")), 6).alias("label_precision"))


@query("dense_prefilter_config", """
    WITH s AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_inner_product(d.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
      FROM embeddings d, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE d.label < 5)
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS hit_rank FROM s QUALIFY hit_rank <= 5""")
def dense_prefilter_config(spark: SparkSession, d: str) -> DataFrame:
    """The configuration with a filter below the ranking."""
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.run_config(retrieval.CONFIGS["dense_budget"], e, queries, "vec_id", "query_id", "embedding", F.col("label") < 5).select("query_id", "vec_id", "score", "hit_rank")


@query("bm25_topk", rf"""
    WITH docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{TOK}') AS t FROM documents),
    n AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean_len FROM docs WHERE len(t) > 0),
    p AS (SELECT doc_id, len(any_value(t)) AS doc_len, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM docs) GROUP BY doc_id, term),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    q AS (SELECT id AS query_id, unnest(list_distinct(regexp_extract_all(lower(question), '{TOK}'))) AS term FROM golden WHERE substr(id, 2)::BIGINT % 50 = 0),
    s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / mean_len))), 6) AS score
      FROM q JOIN p USING (term) JOIN f USING (term), n GROUP BY query_id, doc_id)
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS hit_rank FROM s QUALIFY hit_rank <= 10""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "golden").select(F.col("id").alias("query_id"), "question").where(F.substring("query_id", 2, 20).cast("long") % 50 == 0)
    scored = retrieval.bm25(table(spark, d, "documents").select("doc_id", "text"), asked, "doc_id", "text", "query_id", "question")
    return retrieval.top_k(scored.withColumn("score", F.round("score", 6)), "query_id", "score", "doc_id", 10)


# the questions of golden, number n of which belongs to the vector of number 50 n; texts are those of the vectors' documents
_SEARCHED = rf"""
    q AS (SELECT e.vec_id AS query_id, embedding, g.question FROM embeddings e LEFT JOIN golden g ON 50 * substr(g.id, 2)::BIGINT = e.vec_id WHERE e.vec_id % 50 = 0),
    x AS (SELECT e.vec_id, e.embedding, e.label, d.text FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id),
    s AS (SELECT query_id, vec_id, label, round(list_inner_product(x.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM x, q WHERE trim(coalesce(question, '')) <> ''),
    t AS (SELECT vec_id, label, regexp_extract_all(lower(coalesce(text, '')), '{TOK}') AS t FROM x),
    n AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean_len FROM t WHERE len(t) > 0),
    p AS (SELECT vec_id, any_value(label) AS label, len(any_value(t)) AS doc_len, term, count(*) AS tf FROM (SELECT vec_id, label, t, unnest(t) AS term FROM t) GROUP BY vec_id, term),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    a AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(question), '{TOK}'))) AS term FROM q WHERE question IS NOT NULL),
    l AS (SELECT query_id, vec_id, any_value(label) AS label, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / mean_len))), 6) AS score
      FROM a JOIN p USING (term) JOIN f USING (term), n GROUP BY query_id, vec_id)"""
_SECOND = "round(score * (1 + vec_id % 7), 6)"


def _config_sql(c: retrieval.RetrievalConfig) -> str:
    """The ranked hits of a configuration over the tables of _SEARCHED."""
    fetched = c.fetch_k if c.rerank or c.hybrid else c.top_k
    where = "label < 5" if c.prefilter else "true"
    first = lambda t: f"SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM {t} WHERE {where} QUALIFY r <= {fetched}"
    rank = lambda order, rows, cond="true": f"SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS hit_rank FROM ({rows}) WHERE {cond} QUALIFY hit_rank <= {c.top_k}"
    if c.hybrid:
        both = f"SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM ({first('s')} UNION ALL {first('l')}) GROUP BY query_id, vec_id"
        return rank("score DESC, vec_id", both)
    cond = f"score >= {c.threshold}" if c.threshold else "true"
    return rank(f"{_SECOND} DESC, r" if c.rerank else "r", first("s"), cond)


def _searched(spark: SparkSession, d: str, with_lexical: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows with vector, label and text; queries with vector and question; lexical scores, where they are asked for)"""
    rows = table(spark, d, "embeddings").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left")
    questions = table(spark, d, "golden").select((F.substring("id", 2, 20).cast("long") * 50).alias("query_id"), "question")
    queries = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding").join(questions, "query_id", "left")
    if not with_lexical:
        return rows, queries, None
    scored = retrieval.bm25(rows.select("vec_id", "text"), queries.select("query_id", "question"), "vec_id", "text", "query_id", "question")
    return rows, queries, scored.withColumn("score", F.round("score", 6))


def _search(spark: SparkSession, d: str, name: str, tables: tuple | None = None) -> DataFrame:
    rows, queries, lexical = tables or _searched(spark, d, retrieval.CONFIGS[name].hybrid)
    second = lambda hits: F.round(F.col("score") * (1 + F.col("vec_id") % 7), 6)  # noqa: E731  # stands for a model
    return retrieval.run_config(
        retrieval.CONFIGS[name], rows, queries, "vec_id", "query_id", "embedding", F.col("label") < 5, lexical, second, "question"
    ).select("query_id", "vec_id", "score", "hit_rank")


for _name, _config in retrieval.CONFIGS.items():
    query(f"config_{_name}", f"WITH {_SEARCHED} {_config_sql(_config)}")(lambda spark, d, name=_name: _search(spark, d, name))

_RELEVANT = """
    k AS (SELECT * FROM (VALUES ('baseline'), ('dense'), ('dense_threshold'), ('dense_rerank'), ('dense_budget'), ('hybrid'), ('hybrid_budget'), ('full')) AS k(config)),
    gold AS (SELECT q.query_id, e.vec_id FROM q JOIN embeddings b ON b.vec_id = q.query_id JOIN embeddings e ON e.label = b.label AND e.vec_id % 25 = 0),
    size AS (SELECT query_id, count(*) AS n FROM gold GROUP BY query_id),
    m AS (SELECT config, query_id, count(*) AS n, min(hit_rank) AS f, sum(1 / log2(hit_rank + 1.0)) AS dcg FROM hits JOIN gold USING (query_id, vec_id) GROUP BY config, query_id),
    o AS (SELECT k.config, size.query_id, coalesce(m.n / size.n, 0) AS recall_5, (coalesce(m.n, 0) > 0)::INT AS hit_5, coalesce(1 / f, 0) AS mrr_5,
        coalesce(dcg / list_sum(list_transform(range(1, least(size.n, 5) + 1), lambda i: 1 / log2(i + 1.0))), 0) AS ndcg_5 FROM k CROSS JOIN size LEFT JOIN m ON m.config = k.config AND m.query_id = size.query_id)"""


@query("search_matrix", f"WITH {_SEARCHED}, hits AS (" + " UNION ALL ".join(f"SELECT '{n}' AS config, * FROM ({_config_sql(c)})" for n, c in retrieval.CONFIGS.items()) + f"""), {_RELEVANT}
    SELECT config, (list_position(['baseline', 'dense', 'dense_threshold', 'dense_rerank', 'dense_budget', 'hybrid', 'hybrid_budget', 'full'], config) - 1)::INT AS place, count(*) AS n,
      round(avg(recall_5), 4) AS recall_5, round(avg(hit_5), 4) AS hit_5, round(avg(mrr_5), 4) AS mrr_5, round(avg(ndcg_5), 4) AS ndcg_5 FROM o GROUP BY config""")
def search_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Every configuration searched and scored: a vector is relevant to a query of its label, of every 25th vector."""
    tables = _searched(spark, d)
    tables = (tables[0], tables[1], cut(tables[2]))
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    own = labels.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    golds = own.join(labels.where("vec_id % 25 = 0"), "label").groupBy("query_id").agg(F.collect_list(F.col("vec_id").cast("string")).alias("gold"))
    cells = {n: _search(spark, d, n, tables).withColumn("url", F.col("vec_id").cast("string")) for n in retrieval.CONFIGS}
    return evaluation.in_order(evaluation.matrix(cells, golds, "query_id", "gold", "url", (5,)), "config", tuple(retrieval.CONFIGS), "place")


UNIQUE_HITS = "h AS (SELECT query_id, config, url, min(hit_rank) AS hit_rank FROM hits GROUP BY query_id, config, url)"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hits").groupBy("query_id", "config", "url").agg(F.min("hit_rank").alias("hit_rank"))


@query("hybrid_rrf", f"""
    WITH {UNIQUE_HITS}, s AS (SELECT query_id, url, round(sum(1.0::DOUBLE / (60 + hit_rank)), 9) AS score FROM h GROUP BY query_id, url)
    SELECT query_id, url, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS hit_rank FROM s QUALIFY hit_rank <= 5""")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    lists = [_hits(spark, d).where(F.col("config") == c).drop("config") for c in ("dense", "hybrid")]
    return retrieval.fuse(lists, "query_id", "url", 5)


@query("rerank", """
    WITH h AS (SELECT query_id, config, url, min(hit_rank) AS old, max(coalesce(rerank_score, -1)) AS rerank_score FROM hits GROUP BY query_id, config, url)
    SELECT query_id, config, url, rerank_score, row_number() OVER (PARTITION BY query_id, config ORDER BY rerank_score DESC, old, url) AS hit_rank FROM h QUALIFY hit_rank <= 5""")
def rerank(spark: SparkSession, d: str) -> DataFrame:
    """The hits of every configuration by the score of a second model."""
    own = table(spark, d, "hits").groupBy("query_id", "config", "url").agg(F.min("hit_rank").alias("old"), F.max(F.coalesce("rerank_score", F.lit(-1.0))).alias("s"))
    old = own.select(F.struct("query_id", "config").alias("key"), "url", "s", F.struct("old", "url").alias("hit_rank"))
    return retrieval.rerank(old, "key", F.col("s"), 5).select("key.query_id", "key.config", "url", "rerank_score", "hit_rank")


# ---- evaluation

EVAL = f"""
    {UNIQUE_HITS},
    g AS (SELECT id AS query_id, source, intent, answerable, list_distinct(coalesce(gold_urls, [])) AS gold FROM golden),
    c AS (SELECT DISTINCT config FROM hits),
    e AS (SELECT config, query_id, unnest(gold) AS url FROM g, c),
    r AS (SELECT e.config, e.query_id, h.hit_rank AS r FROM e JOIN h ON e.config = h.config AND e.query_id = h.query_id AND e.url = h.url WHERE h.hit_rank <= 5),
    m AS (SELECT config, query_id, count(*) AS n, min(r) AS f, sum(1 / log2(r + 1.0)) AS dcg FROM r GROUP BY config, query_id),
    p AS (SELECT c.config, g.query_id, g.source, g.intent, g.answerable, len(gold) AS n_gold, coalesce(m.n / nullif(len(gold), 0), 0) AS recall_5, (coalesce(m.n, 0) > 0)::INT AS hit_5,
        coalesce(1 / m.f, 0) AS mrr_5, coalesce(m.dcg / list_sum(list_transform(range(1, greatest(1, least(len(gold), 5)) + 1), lambda i: 1 / log2(i + 1.0))), 0) AS ndcg_5
      FROM g CROSS JOIN c LEFT JOIN m ON m.config = c.config AND m.query_id = g.query_id)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each golden query under each configuration (of which there are few)."""
    hits = _hits(spark, d).withColumn("key", F.concat_ws("/", "config", "query_id"))
    configs = hits.groupBy("config").agg(F.lit(1).alias("one")).agg(F.collect_list("config").alias("c"))
    golden = table(spark, d, "golden").join(F.broadcast(configs)).select(F.explode("c").alias("config"), F.col("id").alias("query_id"), "source", "intent", "answerable", "gold_urls")
    golden = golden.withColumn("key", F.concat_ws("/", "config", "query_id"))
    scores = evaluation.per_query(golden, hits, "key", "gold_urls", "url", (5,))
    return golden.drop("gold_urls").join(scores, "key").drop("key")


@query("eval_per_query", f"WITH {EVAL} SELECT config, query_id, n_gold, round(recall_5, 6) AS recall_5, hit_5, round(mrr_5, 6) AS mrr_5, round(ndcg_5, 6) AS ndcg_5 FROM p")
def eval_per_query(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("config", "query_id", "n_gold", F.round("recall_5", 6).alias("recall_5"), "hit_5", F.round("mrr_5", 6).alias("mrr_5"), F.round("ndcg_5", 6).alias("ndcg_5"))


@query("eval_means", f"""
    WITH {EVAL} SELECT config, count(*) AS n, round(avg(recall_5), 4) AS recall_5, round(avg(hit_5), 4) AS hit_5, round(avg(mrr_5), 4) AS mrr_5, round(avg(ndcg_5), 4) AS ndcg_5
    FROM p WHERE n_gold > 0 GROUP BY config""")
def eval_means(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.means(_scored(spark, d), ["config"], (5,))


@query("eval_slices", f"""
    WITH {EVAL}, x AS (SELECT unnest([{{'dim': 'source', 'value': source}}, {{'dim': 'intent', 'value': intent}},
        {{'dim': 'answerable', 'value': CASE answerable WHEN true THEN 'True' WHEN false THEN 'False' END}}]) AS s, * FROM p)
    SELECT s.dim AS dim, coalesce(s.value, '') AS value, count(*) FILTER (n_gold > 0) AS n, round(avg(recall_5) FILTER (n_gold > 0), 4) AS recall_5, round(avg(mrr_5) FILTER (n_gold > 0), 4) AS mrr_5
    FROM x GROUP BY ALL""")
def eval_slices(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.slices(_scored(spark, d), ("source", "intent", "answerable"), ("recall_5", "mrr_5"))


@query("abstention_scores", """
    WITH o AS (SELECT coalesce(answerable, false) AS a, id NOT IN (SELECT query_id FROM hits WHERE score >= 0.6 AND query_id IS NOT NULL) AS s FROM golden),
    t AS (SELECT count(*) FILTER (NOT a AND s) AS tp, count(*) FILTER (a AND s) AS fp, count(*) FILTER (NOT a) AS n FROM o),
    r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(n, 0), 0) AS rec FROM t)
    SELECT round(p, 4) AS precision, round(rec, 4) AS recall, round(coalesce(2 * p * rec / nullif(p + rec, 0), 0), 4) AS f1, n AS n_unanswerable, fp AS false_abstentions FROM r""")
def abstention_scores(spark: SparkSession, d: str) -> DataFrame:
    golden = table(spark, d, "golden").select(F.col("id").alias("query_id"), "answerable")
    silent = retrieval.abstentions(golden, table(spark, d, "hits").where("score >= 0.6"), "query_id")
    return evaluation.abstention_scores(golden.join(silent, "query_id"))


@query("latency_percentiles", """
    WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
    p AS (SELECT unnest([50.0, 95.0]) AS percent)
    SELECT percent::DOUBLE AS percent, round(value, 6) AS value FROM p JOIN r ON i = least(n - 1, round_even(percent / 100 * (n - 1), 0))""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return ordering.order_statistics(table(spark, d, "events").select("value"), "value", (50, 95))


@query("missing_gold", "SELECT DISTINCT id AS query_id, url FROM (SELECT id, unnest(gold_urls) AS url FROM golden) WHERE url NOT IN (SELECT url FROM products WHERE coalesce(title, '') <> '')")
def missing_gold(spark: SparkSession, d: str) -> DataFrame:
    golden = table(spark, d, "golden").select(F.col("id").alias("query_id"), "gold_urls")
    return evaluation.missing_gold(golden, table(spark, d, "products").where("coalesce(title, '') <> ''"), "query_id", "gold_urls", "url")


@query("state_pivot", "SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS O, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS F FROM lineitem GROUP BY l_returnflag")
def state_pivot(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    return evaluation.pivot(sums, "l_returnflag", "l_linestatus", "q", ("O", "F"))


@query("recovery_ratio", """
    WITH s AS (SELECT load_no, avg(price_parse_rate) AS v FROM quality_corrupt GROUP BY load_no),
    a AS (SELECT max(v) FILTER (load_no = 1) AS hi, max(v) FILTER (load_no = 2) AS lo, max(v) FILTER (load_no = 3) AS md FROM s)
    SELECT round(CASE WHEN hi > lo THEN (md - lo) / (hi - lo) END, 6) AS recovery FROM a""")
def recovery_ratio(spark: SparkSession, d: str) -> DataFrame:
    rates = table(spark, d, "quality_corrupt").groupBy("load_no").agg(F.avg("price_parse_rate").alias("v"))
    return evaluation.recovery(rates, "load_no", "v", 2, 1, 3).select(F.round("recovery", 6).alias("recovery"))


# ---- evaluation sets

SETS_SQL = r"""
    s AS (SELECT id, list_sort(list_distinct(list_filter(string_split_regex(strip_accents(lower(question)), '\s+'), lambda t: length(t) > 1))) AS t FROM golden),
    c AS (SELECT t, min(id) AS first FROM s GROUP BY t)"""


@query("near_dup_pairs", f"""
    WITH {SETS_SQL}, p AS (SELECT a.first AS a, b.first AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) + len(b.t) AS n FROM c a JOIN c b ON a.first < b.first)
    SELECT a, b, round(i / (n - i), 6) AS jaccard FROM p WHERE i * 1000 >= (n - i) * 800""")
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    own = evalset.token_sets(table(spark, d, "golden").select("id", "question"), "id", "question")
    classes = cut(own.groupBy("set_id", "tokens").agg(F.min("id").alias("first")))
    pairs = evalset.similar_sets(classes.select("set_id", "tokens"))
    named = lambda x: classes.select(F.col("set_id").alias(x), F.col("first").alias(f"f{x}"))
    return pairs.join(named("a"), "a").join(named("b"), "b").select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"), "jaccard")


@query("near_dup_keep", r"""
    WITH RECURSIVE s AS (SELECT id, list_sort(list_distinct(list_filter(string_split_regex(strip_accents(lower(coalesce(question, ''))), '\s+'), lambda t: length(t) > 1))) AS t, row_number() OVER (ORDER BY id) AS n FROM golden),
    k AS (SELECT 0::BIGINT AS n, []::VARCHAR[][] AS held, NULL::VARCHAR AS id, false AS kept
      UNION ALL SELECT s.n, CASE WHEN len(list_filter(held, lambda x: x = t OR len(list_intersect(x, t)) * 1000 >= (len(x) + len(t) - len(list_intersect(x, t))) * 800)) = 0 THEN list_append(held, t) ELSE held END, s.id,
        len(list_filter(held, lambda x: x = t OR len(list_intersect(x, t)) * 1000 >= (len(x) + len(t) - len(list_intersect(x, t))) * 800)) = 0 FROM k JOIN s ON s.n = k.n + 1)
    SELECT id, kept FROM k WHERE n > 0""")
def near_dup_keep(spark: SparkSession, d: str) -> DataFrame:
    """Each question and whether it is kept."""
    return evalset.near_duplicates(table(spark, d, "golden").select("id", "question"), "id", "question")[0].select("id", "kept")


@query("per_intent_cap", "SELECT id, intent FROM golden QUALIFY row_number() OVER (PARTITION BY intent ORDER BY id) <= 30")
def per_intent_cap(spark: SparkSession, d: str) -> DataFrame:
    return evalset.cap_per_group(table(spark, d, "golden").select("id", "intent"), "intent", ["id"], 30)


@query("balanced_sample", """
    WITH r AS (SELECT id, intent, row_number() OVER (PARTITION BY intent ORDER BY md5(concat_ws(':', '42', 'sample', id)), id) AS r FROM golden)
    SELECT id, intent FROM r WHERE r <= CASE intent WHEN 'product_search' THEN 20 WHEN 'policy' THEN 10 WHEN 'attribute' THEN 10 ELSE 0 END""")
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    return evalset.balanced_sample(table(spark, d, "golden").select("id", "intent"), "intent", "id", {"product_search": 0.5, "policy": 0.25, "attribute": 0.25}, 40)


@query("pool_first_wins", f"WITH {UNIQUE_HITS} SELECT query_id, url, config, hit_rank FROM h QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY config, hit_rank) = 1")
def pool_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return ordering.keep_first(_hits(spark, d), ["query_id", "url"], ["config", "hit_rank"])


@query("carry_over", "SELECT id, labelled_by, id IN (SELECT id FROM golden WHERE reviewed) AS carried FROM (SELECT id, CASE WHEN reviewed THEN labelled_by END AS labelled_by FROM golden)")
def carry_over(spark: SparkSession, d: str) -> DataFrame:
    golden = table(spark, d, "golden")
    return evalset.carry_over(golden.select("id"), golden.where("reviewed").select("id", "labelled_by"), "id")


@query("stable_ids", "SELECT id, 'q' || lpad(row_number() OVER (ORDER BY question, id)::VARCHAR, 8, '0') AS stable_id FROM golden")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return evalset.stable_ids(table(spark, d, "golden").select("id", "question"), ["question", "id"]).select("id", "stable_id")


@query("leaks_title", rf"""
    SELECT DISTINCT query_id, url FROM hits h JOIN golden g ON g.id = h.query_id,
      (SELECT 1) WHERE len(list_filter(regexp_extract_all(lower(h.title), '{TOK}'), lambda t: length(t) > 2)) > 0
      AND len(list_filter(list_filter(regexp_extract_all(lower(h.title), '{TOK}'), lambda t: length(t) > 2), lambda t: contains(lower(g.question), t)))
        >= 0.5 * len(list_filter(regexp_extract_all(lower(h.title), '{TOK}'), lambda t: length(t) > 2))""")
def leaks_title(spark: SparkSession, d: str) -> DataFrame:
    golden = table(spark, d, "golden").select(F.col("id").alias("query_id"), "question")
    return table(spark, d, "hits").join(golden, "query_id").where(evalset.leaks_title(F.col("question"), F.col("title"), 0.5)).select("query_id", "url").distinct()


# ---- citations and context

ANSWER = "coalesce(title, '') || ' [' || (hit_rank * 3)::VARCHAR || '] và [' || (hit_rank % 5 + 1)::VARCHAR || ']'"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "hits").select("query_id", "config", "url", "hit_rank", "title").distinct()
    mark = lambda x: F.concat(F.lit("["), x.cast("string"), F.lit("]"))
    return hits.withColumn("answer", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), mark(F.col("hit_rank") * 3), F.lit(" và "), mark(F.col("hit_rank") % 5 + 1))).withColumn("n_context", F.lit(5))


_CITED = rf"""
    a AS (SELECT DISTINCT query_id, config, url, hit_rank, title, {ANSWER} AS answer FROM hits),
    m AS (SELECT *, list_transform(regexp_extract_all(answer, '\[(\d{{1,2}})\]', 1), lambda x: x::INT) AS k FROM a),
    l AS (SELECT *, regexp_extract_all(answer, '\d[\d.,]{{2,}}') AS digits FROM m),
    c AS (SELECT query_id, config, url, hit_rank, title, list_sort(list_distinct(list_filter(k, lambda x: x BETWEEN 1 AND 5))) AS cited, list_sort(list_distinct(list_filter(k, lambda x: x NOT BETWEEN 1 AND 5))) AS invalid,
      list_filter([1, 2, 3, 4, 5], lambda x: NOT list_contains(k, x)) AS unused, regexp_matches(split_part(answer, chr(10), 1), '[\p{{L}}]') AS has_text FROM l)"""
DESCRIPTIVE = r"(?iu)(?<![\p{L}\p{N}_])(?:màu|gồm|cao|size)(?![\p{L}\p{N}_])"


@query("citation_report", f"WITH {_CITED} SELECT query_id, config, url, hit_rank, title, cited, invalid, unused, len(cited) > 0 AS has_citations, 0 AS n_uncited_claims, 0 AS n_uncited_descriptive, len(invalid) = 0 AS is_valid FROM c")
def citation_report(spark: SparkSession, d: str) -> DataFrame:
    """Answers whose only line has marks: no claim is uncited, so validity is that of the marks."""
    found = citations.report(_answers(spark, d), "answer", "n_context", descriptive=DESCRIPTIVE)
    return found.select("query_id", "config", "url", "hit_rank", "title", "cited", "invalid", "unused", "has_citations", "n_uncited_claims", "n_uncited_descriptive", "is_valid")


@query("citation_rates", f"""
    WITH {_CITED} SELECT count(*) AS n, round(avg((len(invalid) > 0)::INT), 4) AS invalid_index_rate, round(avg((len(cited) > 0)::INT), 4) AS citation_rate, round(avg((len(invalid) = 0)::INT), 4) AS validity_rate,
      0.0::DOUBLE AS uncited_rate, 0.0::DOUBLE AS descriptive_rate, round(avg(len(unused)), 2) AS mean_unused FROM c""")
def citation_rates(spark: SparkSession, d: str) -> DataFrame:
    return citations.rates(citations.report(_answers(spark, d), "answer", "n_context", descriptive=DESCRIPTIVE), "n_context")


@query("uncited_claims", rf"""
    WITH s AS (SELECT doc_id, list_filter(flatten(list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda b: trim(b) <> '' AND NOT regexp_matches(b, '\[\d{{1,2}}\]')),
        lambda b: string_split(regexp_replace(b, '([.!?])[ \t\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1)))), lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '\?[ \t\x0b\f\r]*$')) AS s FROM documents)
    SELECT doc_id, len(list_filter(s, lambda x: regexp_matches(trim(x), '(?:^|[^\p{{L}}\p{{N}}_])\d[\d.,]{{2,}}'))) AS n_claims,
      len(list_filter(s, lambda x: regexp_matches(trim(x), '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:màu|gồm|cao|size)(?:$|[^\p{{L}}\p{{N}}_])') AND NOT regexp_matches(trim(x), '(?:^|[^\p{{L}}\p{{N}}_])\d[\d.,]{{2,}}'))) AS n_descriptive FROM s""")
def uncited_claims(spark: SparkSession, d: str) -> DataFrame:
    """Both tiers of claims without a mark in the documents, taken as answers."""
    found = citations.report(table(spark, d, "documents").select("doc_id", "text", F.lit(1).alias("n")), "text", "n", descriptive=DESCRIPTIVE)
    return found.select("doc_id", F.col("n_uncited_claims").cast("long").alias("n_claims"), F.col("n_uncited_descriptive").cast("long").alias("n_descriptive"))


@query("strip_invalid", rf"""
    WITH a AS (SELECT DISTINCT query_id, config, url, hit_rank, title, {ANSWER} AS answer FROM hits)
    SELECT query_id, config, url, hit_rank, title, CASE WHEN hit_rank * 3 > 5 THEN replace(answer, '[' || (hit_rank * 3)::VARCHAR || ']', '') ELSE answer END AS answer FROM a""")
def strip_invalid(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).withColumn("answer", citations.strip_invalid("answer", F.lit(5))).drop("n_context")


@query("context_format", """
    WITH u AS (SELECT query_id, config, hit_rank, min(coalesce(title, '')) AS title FROM hits GROUP BY query_id, config, hit_rank)
    SELECT query_id || '/' || config AS key, string_agg('[' || hit_rank || '] ' || left(title, 300), chr(10) ORDER BY hit_rank) AS context FROM u WHERE hit_rank <= 5 GROUP BY query_id, config""")
def context_format(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "hits").groupBy("query_id", "config", "hit_rank").agg(F.min(F.coalesce("title", F.lit(""))).alias("title"))
    return citations.context(hits.withColumn("key", F.concat_ws("/", "query_id", "config")), "key", "hit_rank", "title", 5)


@query("history_last_4", """
    WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS turns FROM documents WHERE kind = 'chat' AND text <> ''),
    x AS (SELECT doc_id, turns, unnest(range(1, len(turns) + 1)) AS turn FROM t)
    SELECT doc_id, turn, array_to_string(turns[greatest(1, turn - 4):turn - 1], chr(10)) AS history FROM x""")
def history_last_4(spark: SparkSession, d: str) -> DataFrame:
    chats = table(spark, d, "documents").where("kind = 'chat' and text <> ''").select("doc_id", F.split("text", "\n").alias("turns"))
    rows = chats.select("doc_id", "turns", F.explode(F.sequence(F.lit(1), F.size("turns"))).alias("turn"))
    return rows.select("doc_id", F.col("turn").cast("long").alias("turn"), F.array_join(citations.history(F.col("turns"), F.col("turn")), "\n").alias("history"))


# ---- sinks and streams, as batches

@query("upsert_latest", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return ordering.keep_last(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"])


@query("windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    return ingest.windowed_counts(table(spark, d, "events").select("ts", "event_type"), "ts", "event_type")


@query("index_urls", "SELECT DISTINCT url FROM products WHERE url <> ''")
def index_urls(spark: SparkSession, d: str) -> DataFrame:
    return files.column_values(table(spark, d, "products"), "url")


def _valid_sql(c: str) -> str:
    t = rf"trim(regexp_replace(nfc_normalize(coalesce({c}, '')), '{SPACES}', ' ', 'g'))"
    return f"CASE WHEN lower({t}) IN ('nan', 'none', 'null', '<na>') THEN '' ELSE {t} END"


@query("validated_products", f"""
    WITH s AS (SELECT seq, replace({_valid_sql('url')}, ' ', '') AS url, {', '.join(f'{_valid_sql(c)} AS {c}' for c in HASHED[1:])}, content_hash AS given FROM products)
    SELECT * EXCLUDE (given), coalesce(nullif(given, ''), left(sha256({" || chr(31) || ".join(HASHED)}), 16)) AS content_hash FROM s""")
def validated_products(spark: SparkSession, d: str) -> DataFrame:
    return files.validate(table(spark, d, "products")).select("seq", *HASHED, "content_hash")


# ---- what an index hands out, guards, and sets of their own


@query("payloads", "SELECT seq AS id, url AS link, title AS name, price_vnd AS price FROM products")
def payloads(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.payload(table(spark, d, "products"), {"id": "seq", "link": "url", "name": "title", "price": "price_vnd"})


@query("state_texts", """
    SELECT 'baseline' AS state, seq, CASE WHEN coalesce(title, '') = '' OR coalesce(description, '') = '' THEN 'nan' ELSE concat_ws(' ', title, description) END AS text, NULL::BIGINT AS price FROM products
    UNION ALL SELECT 'clean', seq, concat_ws(' . ', nullif(title, ''), nullif(description, '')), price_vnd FROM products""")
def state_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts that two states are indexed by, each zipped with its payload by key."""
    products = table(spark, d, "products")
    out = []
    for state in ("baseline", "clean"):
        text, fields = retrieval.builders_for(state, states.baseline_text("title", "description"), states.embed_text("title", "description"), {"seq": "seq", "price": "price_vnd"}, ["price"])
        both = ordering.zip_strict(products.select("seq", text.alias("text")), retrieval.payload(products, fields), "seq")
        out.append((both if "price" in both.columns else both.withColumn("price", F.lit(None).cast("long"))).select(F.lit(state).alias("state"), "seq", "text", "price"))
    return out[0].unionByName(out[1])


@query("baseline_counts", "SELECT count(*) AS records, count(*) FILTER (coalesce(title, '') = '' OR coalesce(description, '') = '') AS nan_texts, count(*) FILTER (NOT starts_with(url, 'https://')) AS unwanted FROM products")
def baseline_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counters of the unfiltered state, once it was read."""
    rows = table(spark, d, "products").select("url", states.baseline_text("title", "description").alias("naive"))
    out, seen = states.baseline_records(rows, "naive", F.col("url").startswith("https://"))
    out.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["records"], got["nan_texts"], got["unwanted"])], "records long, nan_texts long, unwanted long")


@query("blank_questions", rf"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g')) = '' AS blank FROM documents")
def blank_questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", retrieval.is_blank("text").alias("blank"))


@query("fitting_questions", r"SELECT id, len(list_filter(string_split_regex(coalesce(question, ''), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')) BETWEEN 2 AND 8 AS fits FROM golden")
def fitting_questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "golden").select("id", evalset.within_words(F.col("question"), 2, 8).alias("fits"))


@query("questions_by_intent", "SELECT intent, count(*) AS n, list_sort(list(id)) AS keys FROM golden GROUP BY intent")
def questions_by_intent(spark: SparkSession, d: str) -> DataFrame:
    return evalset.by_group(table(spark, d, "golden").select("intent", "id"), "intent", "id")


@query("subset_flags", """
    WITH r AS (SELECT id, row_number() OVER (ORDER BY md5(concat_ws(':', '42', 'subset', id)), id) AS r FROM golden WHERE answerable)
    SELECT id, coalesce(in_ragas_subset, false) OR coalesce(r <= 20, false) AS in_ragas_subset FROM golden LEFT JOIN r USING (id)""")
def subset_flags(spark: SparkSession, d: str) -> DataFrame:
    return evalset.sticky_subset(table(spark, d, "golden").select("id", "answerable", "in_ragas_subset"), "id", "in_ragas_subset", F.col("answerable"), 20).select("id", "in_ragas_subset")


@query("gold_titles", "WITH p AS (SELECT url, min(title) AS title FROM products GROUP BY url) SELECT id, g.url, p.title FROM (SELECT id, unnest(gold_urls) AS url FROM golden) g LEFT JOIN p ON p.url = g.url")
def gold_titles(spark: SparkSession, d: str) -> DataFrame:
    golds = table(spark, d, "golden").select("id", F.explode("gold_urls").alias("url"))
    return evalset.lookup(golds, table(spark, d, "products").groupBy("url").agg(F.min("title").alias("title")), "url").select("id", "url", "title")


@query("judged_in_pool", "SELECT query_id, url, hit_rank, coalesce(hit_rank - 2 BETWEEN 1 AND 5, false) AS known FROM hits")
def judged_in_pool(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hits").select("query_id", "url", "hit_rank", evalset.in_pool(F.col("hit_rank") - 2, F.lit(5)).alias("known"))


@query("cache_misses", """
    WITH k AS (SELECT id, left(sha256('{"question":"' || question || '"}'), 24) AS key, notes, reviewed FROM golden WHERE question IS NOT NULL),
    c AS (SELECT key, max(coalesce(notes, '')) AS answer FROM k WHERE reviewed GROUP BY key)
    SELECT k.id, k.key, c.answer, c.key IS NULL AS missed FROM k LEFT JOIN c USING (key)""")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """What a cache of the reviewed questions knows of all of them, by a key over the request's fields."""
    rows = table(spark, d, "golden").where("question is not null").select("id", citations.cache_key("question").alias("key"), "notes", "reviewed")
    cache = rows.where("reviewed").groupBy("key").agg(F.max(F.coalesce("notes", F.lit(""))).alias("answer"))
    found, misses = citations.probe(rows.select("id", "key"), cache, "key", "answer")
    return found.join(misses.select("key", F.lit(True).alias("missed")), "key", "left").select("id", "key", "answer", F.coalesce("missed", F.lit(False)).alias("missed"))


_BACK, _SUBJECT = "(?i)(?:^|[^\\p{L}])(?:nó|này|đó|thế|còn|khác)(?:$|[^\\p{L}])", "(?i)(?:^|[^\\p{L}])(?:hoa|bó|giỏ|kệ|lan|hồng)(?:$|[^\\p{L}])"


@query("condensation_gate", f"""
    SELECT id, hour % 3 > 0 AND (len(string_split_regex(trim(question), '\\s+')) <= 3 OR (regexp_matches(question, '{_BACK}') AND NOT regexp_matches(question, '{_SUBJECT}'))) AS gate
    FROM (SELECT id, question, substr(id, 2)::BIGINT AS hour FROM golden WHERE question IS NOT NULL)""")
def condensation_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "golden").where("question is not null")
    return rows.select("id", citations.needs_context("question", F.substring("id", 2, 20).cast("long") % 3, _BACK, _SUBJECT).alias("gate"))


@query("answers_json", """
    WITH h AS (SELECT query_id, config, hit_rank, min(url) AS url FROM hits WHERE hit_rank <= 3 GROUP BY ALL)
    SELECT query_id, config, to_json({'answer': query_id, 'sources': list({'n': hit_rank, 'source': url} ORDER BY hit_rank), 'abstained': false})::VARCHAR AS answer
    FROM h WHERE (query_id, config) IN (SELECT (query_id, config) FROM h GROUP BY query_id, config HAVING count(*) = 3) GROUP BY query_id, config""")
def answers_json(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "hits").where("hit_rank <= 3").groupBy("query_id", "config", "hit_rank").agg(F.min("url").alias("url"))
    rows = hits.groupBy("query_id", "config").agg(F.array_sort(F.collect_list(F.struct("hit_rank", "url")))["url"].alias("urls")).where(F.size("urls") == 3)
    return rows.select("query_id", "config", citations.answer_json("query_id", F.col("urls"), F.lit(False)).alias("answer"))


@query("prompts", r"""
    WITH u AS (SELECT query_id, hit_rank, min(coalesce(title, '')) AS title FROM hits WHERE config = 'dense' AND hit_rank <= 2 GROUP BY ALL),
    c AS (SELECT query_id, string_agg('[' || hit_rank || '] ' || left(title, 300), chr(10) ORDER BY hit_rank) AS context FROM u GROUP BY query_id)
    SELECT id, CASE WHEN coalesce(context, '') = '' THEN 'Say that nothing fits.' || chr(10) || question ELSE 'Cite.' || chr(10) || context || chr(10) || question END AS prompt
    FROM golden LEFT JOIN c ON c.query_id = golden.id""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "hits").where("config = 'dense'").groupBy("query_id", "hit_rank").agg(F.min(F.coalesce("title", F.lit(""))).alias("title"))
    contexts = citations.context(hits, "query_id", "hit_rank", "title", 2)
    rows = table(spark, d, "golden").select(F.col("id").alias("query_id"), "question").join(contexts, "query_id", "left")
    return rows.select(F.col("query_id").alias("id"), citations.prompt("Cite.", F.col("question"), F.col("context"), "Say that nothing fits.").alias("prompt"))


@query("passage_rate", f"""
    WITH {GRAMS}, v AS (SELECT doc_id, count(r.g) / count(*) AS share FROM g LEFT JOIN r USING (g) GROUP BY doc_id)
    SELECT count(*) AS n_texts, round(coalesce(avg((share >= 0.3)::INT), 0), 6) AS rate FROM v""")
def passage_rate(spark: SparkSession, d: str) -> DataFrame:
    return quality.passage_rate(table(spark, d, "documents"), "text", "doc_id", 0.3, 8, 0.005).withColumn("rate", F.round("rate", 6))


_NULLS = ("title", "description", "price_raw", "price_vnd", "image")


def _ratio_sql(x: str) -> str:
    return f"""(WITH t AS (SELECT unnest(list_distinct(regexp_extract_all(lower({x}), '{TOK}'))) AS token FROM e), f AS (SELECT token, count(*) AS df FROM t GROUP BY token),
        n AS (SELECT count(*) AS n FROM e WHERE {x} <> '') SELECT round(coalesce(sum(CASE WHEN df >= 0.6 * n THEN df ELSE 0 END) / sum(df), 0), 4) FROM f, n)"""


@query("corpus_report", f"""
    WITH e AS (SELECT *, coalesce(promo, '') AS p, coalesce(description, '') AS x, concat_ws(' . ', nullif(title, ''), nullif(description, '')) AS t FROM products),
    w AS (SELECT seq, regexp_extract_all(lower(t), '{TOK}') AS t FROM e),
    g AS (SELECT seq, unnest(list_distinct(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i + 7], ' ')))) AS g FROM w WHERE len(t) >= 8),
    r AS (SELECT g FROM g GROUP BY g HAVING count(*) >= greatest(2, floor(0.005 * (SELECT count(*) FROM products)))),
    v AS (SELECT seq, count(r.g) / count(*) AS share FROM g LEFT JOIN r USING (g) GROUP BY seq),
    a AS (SELECT floor((epoch_us(TIMESTAMPTZ '2025-01-01 00:00:00+00') // 1000000 - epoch_us(crawled_at) // 1000000) / 86400)::BIGINT AS age FROM products WHERE crawled_at IS NOT NULL)
    SELECT count(*) AS documents, {', '.join(f"count(*) FILTER ({c} IS NULL OR {c}::VARCHAR = '') AS null_{c}, round(count(*) FILTER ({c} IS NULL OR {c}::VARCHAR = '') / count(*), 4) AS rate_{c}" for c in _NULLS)},
      round(count(price_vnd) / count(*), 4) AS parse_rate, count(*) FILTER (lower(trim(t)) IN ('nan', 'none', 'null', '<na>', 'na')) AS junk,
      count(*) FILTER (contains(' ' || regexp_replace(lower(t), '{SPACES}', ' ', 'g') || ' ', ' nan ')) AS nan_tokens, count(url) - count(DISTINCT url) AS duplicate_urls, count(content_hash) - count(DISTINCT content_hash) AS duplicate_hashes,
      {_ratio_sql('t')} AS boilerplate_embedded, {_ratio_sql('p')} AS boilerplate_promo, {_ratio_sql('x')} AS boilerplate_description, (SELECT round(coalesce(avg((share >= 0.3)::INT), 0), 4) FROM v) AS passage_rate,
      (SELECT min(age) FROM a) AS newest_days, (SELECT max(age) FROM a) AS oldest_days, (SELECT list_sort(list(age))[len(list(age)) // 2 + 1] FROM a) AS median_days FROM e""")
def corpus_report(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    products = table(spark, d, "products").select("seq", "url", "content_hash", "promo", "crawled_at", *_NULLS)
    return quality.corpus_report(products, "seq", "url", "content_hash", states.embed_text("title", "description"), _NULLS, ("promo", "description"), "price_vnd", "crawled_at", now, min_share=0.005)


@query("outcome_blocks", f"""
    WITH {UNIQUE_HITS}, d AS (SELECT query_id, url, hit_rank AS r FROM h WHERE config = 'dense' AND hit_rank <= 5),
    q AS (SELECT id AS query_id, list_distinct(gold_urls) AS gold FROM golden WHERE answerable AND len(gold_urls) > 0),
    i AS (SELECT list(DISTINCT url) AS held FROM products WHERE coalesce(title, '') <> ''),
    b AS (SELECT 'raw' AS block, query_id, gold FROM q UNION ALL SELECT 'restricted', query_id, list_intersect(gold, held) FROM q, i),
    e AS (SELECT block, query_id, gold, len(gold) AS n FROM b WHERE len(gold) > 0),
    m AS (SELECT block, query_id, count(*) AS k, min(r) AS f, sum(1 / log2(r + 1.0)) AS dcg FROM (SELECT block, query_id, unnest(gold) AS url FROM e) JOIN d USING (query_id, url) GROUP BY ALL)
    SELECT block, (SELECT count(*) FROM q) AS n, count(*) AS n_scored, round(avg(coalesce(k / n, 0)), 4) AS recall_5, round(avg((coalesce(k, 0) > 0)::INT), 4) AS hit_5, round(avg(coalesce(1 / f, 0)), 4) AS mrr_5,
      round(avg(coalesce(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1.0))), 0)), 4) AS ndcg_5 FROM e LEFT JOIN m USING (block, query_id) GROUP BY block""")
def outcome_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Scores against all gold, and against what the index still holds."""
    golden = table(spark, d, "golden").select(F.col("id").alias("query_id"), "gold_urls", "answerable")
    hits = _hits(spark, d).where("config = 'dense'").drop("config")
    return evaluation.outcome_blocks(golden, hits, "query_id", "gold_urls", "url", table(spark, d, "products").where("coalesce(title, '') <> ''"), (5,))


@query("latency_summary", """
    WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
    SELECT round_even(median(value), 1) AS p50, round_even(max(value) FILTER (i = least(n - 1, round_even(0.95 * (n - 1), 0))), 1) AS p95, round_even(avg(value), 1) AS mean FROM r""")
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.latency(table(spark, d, "events").select("value"), "value")


@query("evaluation_set")
def evaluation_set(spark: SparkSession, d: str) -> DataFrame:
    """An evaluation set built from the questions: reviewed rows carry over, the hits are the pool, and what was reranked well counts as gold."""
    golden = table(spark, d, "golden")
    pooled = evalset.pool([(i, _pool_of(spark, d, c)) for i, c in enumerate(("dense", "hybrid"))], "query_id", "url").select(F.col("query_id").alias("id"), "url", "title", "score")
    return evalset.build(
        golden.select("id", "question", "intent"), golden.where("reviewed").select("id", "gold_urls"), pooled, "id", "question", "intent", {"product_search": 0.5, "policy": 0.25, "attribute": 0.25}, 40, 10,
        lambda pairs: F.col("score") >= 0.6,
    )


def _pool_of(spark: SparkSession, d: str, config: str) -> DataFrame:
    return table(spark, d, "hits").where(F.col("config") == config).groupBy("query_id", "url").agg(F.min("hit_rank").alias("hit_rank"), F.max("title").alias("title"), F.max("score").alias("score"))
