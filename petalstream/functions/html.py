"""Columns over HTML and XML text, by regular expressions of the JVM; malformed markup gives empty text, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from petalstream.functions.text import col, squeeze

# The entities that are undone.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def sitemap_locs(xml: Column | str) -> Column:
    """The locations of a sitemap, in order, each once."""
    found = F.regexp_extract_all(F.coalesce(col(xml), F.lit("")), F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    return F.array_distinct(found)


def child_sitemaps(xml: Column | str, needle: str = "product-sitemap") -> Column:
    """Of a sitemap index the locations that hold a text, in order, each once."""
    return F.filter(sitemap_locs(xml), lambda x: F.contains(x, F.lit(needle)))


def strip_tags(html: Column | str) -> Column:
    """Visible text: scripts, styles and tags go, entities are undone, white space is squeezed."""
    out = F.regexp_replace(F.coalesce(col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return squeeze(undo_entities(F.regexp_replace(out, r"(?s)<[^>]*>", " ")))


def undo_entities(c: Column) -> Column:
    for k, v in ENTITIES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def element(html: Column | str, tag: str, css: str | None = None) -> Column:
    """Text of the first element of a tag (with a class), else ''."""
    klass = rf"""[^>]*\bclass\s*=\s*["'][^"']*\b{css}\b[^"']*["']""" if css else ""
    inner = F.regexp_extract(F.coalesce(col(html), F.lit("")), rf"(?is)<{tag}\b{klass}[^>]*>(.*?)</{tag}\s*>", 1)
    return strip_tags(inner)


def meta(html: Column | str, name: str) -> Column:
    """Content of a meta element by its name or property, else ''."""
    h = F.coalesce(col(html), F.lit(""))
    tag = F.regexp_extract(h, rf"""(?is)<meta\b(?=[^>]*\b(?:name|property)\s*=\s*["']{name}["'])[^>]*>""", 0)
    return squeeze(undo_entities(F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*["']([^"']*)["']""", 1)))


def attribute(html: Column | str, tag: str, attr: str) -> Column:
    return F.regexp_extract(F.coalesce(col(html), F.lit("")), rf"""(?is)<{tag}\b[^>]*\b{attr}\s*=\s*["']([^"']*)["']""", 1)


def first_filled(*cols: Column) -> Column:
    """The first column that isn't empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def product(html: Column | str) -> Column:
    """A struct of title, description, price text (a reduced price first) and image of a product page."""
    h = col(html)
    reduced = element(h, "ins")
    web = lambda c: F.when(c.startswith("http"), c)
    gallery = F.regexp_extract(F.coalesce(h, F.lit("")), r"""(?is)<img\b[^>]*\bdata-large_image\s*=[^>]*>""", 0)
    image = first_filled(web(attribute(gallery, "img", "data-large_image")), web(attribute(gallery, "img", "src")), web(meta(h, "og:image")))
    return F.struct(
        first_filled(element(h, "h1", "product_title"), element(h, "h1")).alias("title"), first_filled(meta(h, "description"), element(h, "div", "short-description")).alias("description"),
        first_filled(reduced, element(h, "span", "amount")).alias("price_raw"), image.alias("image"),
    )
