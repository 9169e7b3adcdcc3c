"""The queries of this subpackage: each runs its operator with production parameters over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petalstream.llm import duplicates, encoding, packing, repeated_lines, sentences, tokenize, truncation
from petalstream.plans.session import cut
from petalstream.sources.tables import spread, table

RECORD = ("title", "price_raw", "description", "promo", "image")
PROMOTED = ("description", "promo")


def _record_keys(spark: SparkSession, d: str) -> DataFrame:
    """(key, id) of the records of both tables; the origin leads the key, and the id's lowest bit carries it through the scan."""
    products = spread(table(spark, d, "products").select("seq", "url", *RECORD)).select(F.lit("products").alias("origin"), F.col("seq").alias("id"), "url", *RECORD)
    raw = spread(table(spark, d, "raw_records").select("raw_id", "payload")).select(F.lit("raw_records").alias("origin"), F.col("raw_id").alias("id"), "payload")
    raw = duplicates.payload_members(raw, "payload")
    rows = products.unionByName(raw.select("origin", "id", "url", *RECORD))
    keyed = duplicates.with_key(rows, "url", RECORD)
    return keyed.select(F.concat_ws(duplicates.FIELD_END, "origin", "key").alias("key"), (F.shiftleft("id", 1) + (F.col("origin") == "raw_records").cast("long")).alias("id"))


def _with_origin(found: DataFrame, *ids: str) -> DataFrame:
    """The origin that the lowest bit of each id carries, and the ids without it."""
    origin = F.when(F.col(ids[0]) % 2 == 0, "products").otherwise("raw_records")
    return found.select(origin.alias("origin"), *[F.shiftright(c, 1).alias(c) for c in ids], *[c for c in found.columns if c not in ids])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Copies of one record within each origin."""
    return _with_origin(duplicates.copy_links(_record_keys(spark, d), "key", "id"), "first_id", "copy_id")


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One row for each distinct record of both origins with its number of copies."""
    return _with_origin(duplicates.collapse(_record_keys(spark, d), "key", "id"), "id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    products = spread(table(spark, d, "products").select("seq", "shop", *PROMOTED))
    lines = repeated_lines.hashed_lines(products, "shop", PROMOTED, ["seq"])
    return repeated_lines.find_lines(lines, repeated_lines.repeated_lines(lines, PROMOTED), PROMOTED, "seq")


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """`products` with the repeated lines taken out of both fields."""
    return repeated_lines.remove_lines(spread(table(spark, d, "products").select("seq", "shop", *PROMOTED)), "shop", PROMOTED)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    products = spread(table(spark, d, "products").select("seq", "shop", "description"))
    return truncation.truncated(products, "description", "seq", "shop").where("is_cut").select("seq")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    """How many descriptions of each shop were cut."""
    products = spread(table(spark, d, "products").select("seq", "shop", "description"))
    return truncation.truncation_rates(truncation.truncated(products, "description", "seq", "shop"), "shop")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    products = spread(table(spark, d, "products").select("seq", "title", "description"))
    return encoding.garbled(products, ("title", "description"), "seq").select("seq", "field")


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled values with what could be restored of them."""
    products = spread(table(spark, d, "products").select("seq", "title", "description"))
    return encoding.garbled(products, ("title", "description"), "seq")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.token_ids(spread(table(spark, d, "documents").select("doc_id", "text")), "text", "doc_id")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of 2,048 tokens of each document, or of each piece of one that is longer."""
    sizes = cut(tokenize.token_counts(spread(table(spark, d, "documents").select("doc_id", "text")), "text", "doc_id"))
    return packing.pack(sizes, "doc_id", "n_tokens")


def p7_fills(spark: SparkSession, d: str) -> DataFrame:
    """How full each container is: their number is held against the tokens of all documents over 2,048, the least possible."""
    return packing.fills(p7_containers(spark, d), "n_tokens")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(spread(table(spark, d, "documents").select("doc_id", "text")), "text", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_restored": p1_restored,
    "p2_found": p2_found,
    "p2_collapsed": p2_collapsed,
    "p3_found": p3_found,
    "p3_cleaned": p3_cleaned,
    "p4_found": p4_found,
    "p4_rates": p4_rates,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p7_fills": p7_fills,
    "p8_found": p8_found,
}

#: SQL for the queries that it can express; the others are held against brute force, public tokenizers and round trips in the tests.
ORACLES: dict[str, str] = {}


SPACE_SQL = r"\s\x0b\x1c-\x1f\x85\p{Z}"


def _fold(x: str) -> str:
    return f"nfc_normalize(replace(translate(lower(coalesce({x}, '')), 'ςſ', 'σs'), 'ß', 'ss'))"


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '[{SPACE_SQL}\\p{{P}}]+', '', 'g')"


def _member(name: str) -> str:
    """The value of a JSON member by its name in any case."""
    found = f"list_filter(json_keys(payload), lambda k: lower(k) = '{name}')[1]"
    return f"json_extract_string(payload, '$.\"' || {found} || '\"') AS {name}"


_RECORDS_SQL = f"""
    WITH ok AS (SELECT raw_id, payload FROM raw_records WHERE payload IS NOT NULL AND json_valid(payload)),
    obj AS (SELECT * FROM ok WHERE json_type(payload) = 'OBJECT'),
    r AS (
      SELECT 'products' AS origin, seq AS id, url, title, price_raw, description, promo, image FROM products
      UNION ALL SELECT 'raw_records', raw_id, {', '.join(_member(m) for m in duplicates.MEMBERS)} FROM obj),
    f AS (SELECT origin, id, {', '.join(f'{_bare(_fold(c))} AS {c}' for c in RECORD)}, string_split({_fold('url')}, '#') AS u FROM r),
    k AS (
      SELECT *, {_bare("string_split(u[1], '?')[1]")} AS path, {_bare("coalesce(array_to_string(u[2:], '#'), '')")} AS fragment,
        list_sort(list_filter(list_transform(string_split(coalesce(array_to_string(string_split(u[1], '?')[2:], '?'), ''), '&'), lambda p: {_bare('p')}), lambda p: p <> '')) AS params FROM f)"""

ORACLES["p2_found"] = f"""{_RECORDS_SQL},
    g AS (SELECT origin, id, min(id) OVER (PARTITION BY origin, path, params, fragment, {', '.join(RECORD)}) AS first_id FROM k)
    SELECT origin, first_id, id AS copy_id FROM g WHERE id > first_id"""

ORACLES["p2_collapsed"] = f"{_RECORDS_SQL} SELECT origin, min(id) AS id, count(*) AS n_copies FROM k GROUP BY origin, path, params, fragment, {', '.join(RECORD)}"

_LINES_SQL = f"""
    WITH v AS (SELECT seq, shop, 'description' AS field, description AS value FROM products UNION ALL SELECT seq, shop, 'promo', promo FROM products),
    l AS (SELECT seq, shop, field, unnest(string_split(value, chr(10))) AS line, generate_subscripts(string_split(value, chr(10)), 1) AS line_no FROM v WHERE value IS NOT NULL),
    b AS (SELECT seq, shop, field, line_no, line AS raw, {_bare(_fold('line'))} AS line FROM l),
    n AS (SELECT coalesce(shop, chr(0)) AS shop, count(*) AS n FROM products GROUP BY 1),
    c AS (SELECT coalesce(shop, chr(0)) AS shop, line, count(DISTINCT seq) AS k FROM b WHERE regexp_matches(line, '\\p{{L}}') GROUP BY 1, 2),
    s AS (SELECT c.shop, line FROM c JOIN n USING (shop) WHERE k >= 5 AND k * 20 >= n)"""

ORACLES["p3_found"] = f"{_LINES_SQL} SELECT seq, field, line_no FROM b JOIN s ON coalesce(b.shop, chr(0)) = s.shop AND b.line = s.line"

ORACLES["p3_cleaned"] = f"""{_LINES_SQL},
    k AS (SELECT seq, field, string_agg(raw, chr(10) ORDER BY line_no) AS kept FROM b LEFT JOIN s ON coalesce(b.shop, chr(0)) = s.shop AND b.line = s.line WHERE s.line IS NULL GROUP BY seq, field)
    SELECT p.seq, p.shop, CASE WHEN p.description IS NOT NULL THEN coalesce(d.kept, '') END AS description, CASE WHEN p.promo IS NOT NULL THEN coalesce(o.kept, '') END AS promo
    FROM products p LEFT JOIN k d ON d.seq = p.seq AND d.field = 'description' LEFT JOIN k o ON o.seq = p.seq AND o.field = 'promo'"""

