"""Column builders for text; all of them are JVM-side expressions, null in gives null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python and Unicode see it together: Java's \s, the separators U+001C to U+001F, NEL and category Z.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def compose(c: Column | str) -> Column:
    """NFC. Spark has no function for it, but ships ICU, whose static method is called by reflection, without Python.

    The result is nondeterministic to Catalyst: use it in a projection, not in a filter, join or aggregate.
    """
    c = col(c)
    done = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(False))
    return F.when(c.isNotNull(), done)


def decompose(c: Column | str) -> Column:
    """NFD, as `compose`."""
    c = col(c)
    done = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(c, F.lit("")), F.lit(False))
    return F.when(c.isNotNull(), done)


def fold_case(c: Column | str) -> Column:
    """Lower case, with 'ß' as 'ss' and final sigma as sigma, so that it meets what upper case makes of them."""
    c = F.lower(col(c))
    for old, new in (("ς", "σ"), ("ſ", "s"), ("ß", "ss")):  # searches for bytes; translate would look up every character
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def fold_diacritics(c: Column | str) -> Column:
    """Lower case without marks of category Mn; letters with a stroke, such as 'đ', stay."""
    return F.regexp_replace(decompose(F.lower(col(c))), r"\p{Mn}+", "")


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(c), f"[{SPACE}]+", " "))


def bare(c: Column | str) -> Column:
    """Without white space and punctuation (category P)."""
    return F.regexp_replace(col(c), rf"[{SPACE}\p{{P}}]+", "")


# The words that stand for null.
NULL_WORDS = ("nan", "none", "null", "<na>")


def normalize_text(c: Column | str) -> Column:
    """NFC, white space squeezed; null and the words for null become the empty string."""
    c = squeeze(compose(F.coalesce(col(c), F.lit(""))))
    return F.when(F.lower(c).isin(*NULL_WORDS), "").otherwise(c)


def tokens(c: Column | str) -> Column:
    """Lower-case runs of letters, digits and underscores; null gives an empty list."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def folded_tokens(c: Column | str) -> Column:
    """Tokens of the text in lower case without marks; null gives an empty list."""
    return tokens(fold_diacritics(F.coalesce(col(c), F.lit(""))))


def normalized_body(*cols: Column | str) -> Column:
    """The texts together in lower case, composed, with white space squeezed: what two rows with one body share."""
    return squeeze(compose(F.lower(F.concat_ws(" ", *[F.coalesce(col(c), F.lit("")) for c in cols]))))


def iso_date(ts: Column | str) -> Column:
    """The date of a moment as YYYY-MM-DD; null for null."""
    return F.date_format(col(ts), "yyyy-MM-dd")


def shingles(tok: Column, size: int = 8) -> Column:
    """Distinct runs of `size` tokens; an empty list below that many.

    One overlapping match over the joined tokens: element-wise lambdas would work the tokens out anew for each run.
    """
    run = rf"(?<![^ ])(?=((?:[^ ]+ ){{{size - 1}}}[^ ]+)(?: |$))"
    return F.array_distinct(F.regexp_extract_all(F.array_join(tok, " "), F.lit(run), F.lit(1)))


def is_null_word(c: Column | str, words: tuple = (*NULL_WORDS, "na")) -> Column:
    return F.lower(F.trim(F.coalesce(col(c), F.lit("")))).isin(*words)


def canonical_url(c: Column | str) -> Column:
    """Up to '?' or '#', lower case, without trailing slashes."""
    return F.lower(F.regexp_replace(F.regexp_replace(col(c), r"[?#][\s\S]*$", ""), r"/+$", ""))


def content_hash(*cols: Column | str) -> Column:
    """First 16 hex digits of SHA-256 over the columns, joined by U+001F; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(col(c), F.lit("")) for c in cols]), 256), 1, 16)


def uuid5(c: Column | str, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """Name-based UUID (version 5) of a text under a namespace, by default that of URLs."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(col(c), "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 8))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def misdecode(c: Column | str) -> Column:
    """The text as it looks when its UTF-8 bytes are read as ISO-8859-1."""
    return F.decode(F.encode(col(c), "UTF-8"), "ISO-8859-1")


def looks_misdecoded(c: Column | str) -> Column:
    """Holds a pair of characters typical of UTF-8 read as a Western code page."""
    # The pairs.
    return F.coalesce(col(c), F.lit("")).rlike("Ã[\\x{80}-\\x{BF}]|á»|áº|Æ°|Ä‘|â€")


def redecode(c: Column | str) -> Column:
    """Undoes `misdecode` where that gives valid UTF-8 that no longer looks misdecoded; else the text as it is."""
    c = col(c)
    latin = c.rlike("^[\\x{00}-\\x{FF}]*$")
    back = F.when(latin, F.try_validate_utf8(F.encode(F.when(latin, c), "ISO-8859-1").cast("string")))
    return F.when(looks_misdecoded(c) & back.isNotNull() & ~looks_misdecoded(back), back).otherwise(c)
