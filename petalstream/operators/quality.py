"""Corpus health: document frequencies, boilerplate, repeated passages, quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from petalstream.functions.text import canonical_url, is_null_word, shingles, squeeze, tokens
from petalstream.plans.session import cut, small, written


def document_frequency(df: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, token, df): in how many texts each token stands. Counted map-side first; null and empty texts hold no token."""
    rows = df.select(*by, F.explode(F.array_distinct(tokens(text))).alias("token"))
    return rows.groupBy(*by, "token").agg(F.count("*").alias("df"))


def filled(df: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, n_texts): texts that are neither null nor empty."""
    return df.where(F.col(text).isNotNull() & (F.col(text) != "")).groupBy(*by).agg(F.count("*").alias("n_texts"))


def boilerplate_tokens(df: DataFrame, text: str, by: Sequence[str] = (), threshold: float = 0.6) -> DataFrame:
    """(*by, token, df): tokens in at least `threshold` of the non-empty texts of a group."""
    freq, n = document_frequency(df, text, by), filled(df, text, by)
    joined = freq.join(n, list(by)) if by else freq.join(F.broadcast(n))  # without groups n is one row
    return joined.where(F.col("df") >= threshold * F.col("n_texts")).select(*by, "token", "df")


def boilerplate_ratio(df: DataFrame, text: str, by: Sequence[str] = (), threshold: float = 0.6) -> DataFrame:
    """(*by, ratio): the share of boilerplate among the distinct tokens of all texts, from the frequencies alone."""
    freq, n = document_frequency(df, text, by), filled(df, text, by)
    joined = freq.join(n, list(by)) if by else freq.join(F.broadcast(n))
    part = F.sum(F.when(F.col("df") >= threshold * F.col("n_texts"), F.col("df")).otherwise(0))
    return joined.groupBy(*by).agg((part / F.sum("df")).alias("ratio"))


def passages(df: DataFrame, text: str, key: str, size: int = 8) -> DataFrame:
    """(key, h): the distinct word n-grams of each text as 64-bit hashes."""
    return df.select(key, F.explode(shingles(tokens(text), size)).alias("s")).select(key, F.xxhash64("s").alias("h"))


def frequent(grams: DataFrame, n_texts: int, min_share: float) -> DataFrame:
    """(h, df): of (key, h), what stands in at least max(2, floor(min_share x n_texts)) texts."""
    return grams.groupBy("h").agg(F.count("*").alias("df")).where(F.col("df") >= max(2, int(min_share * n_texts)))


def repeated_passages(df: DataFrame, text: str, key: str, size: int = 8, min_share: float = 0.05) -> DataFrame:
    """(h, df): n-grams in at least max(2, floor(min_share x number of texts, empty ones included)) texts."""
    return frequent(passages(df, text, key, size), df.count(), min_share)


def repeated_share(df: DataFrame, text: str, key: str, size: int = 8, min_share: float = 0.05) -> DataFrame:
    """(key, share): how much of each text's n-grams is repeated; texts without n-grams are left out. Keys must be unique. The n-grams are
    made once and written."""
    own = written(passages(df, text, key, size))
    hits = own.join(small(cut(frequent(own, df.count(), min_share))).withColumn("hit", F.lit(1)), "h", "left")
    return hits.groupBy(key).agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("share"))


def passage_rate(df: DataFrame, text: str, key: str, threshold: float = 0.3, size: int = 8, min_share: float = 0.05) -> DataFrame:
    """(n_texts, rate): of the texts that have n-grams, the share in which at least `threshold` of these are repeated; 0 for none."""
    share = repeated_share(df, text, key, size, min_share)
    return share.agg(F.count("*").alias("n_texts"), F.coalesce(F.avg((F.col("share") >= threshold).cast("int")), F.lit(0.0)).alias("rate"))


def null_words(cols: Sequence[str]) -> Column:
    """Whether any of the columns holds a word for null."""
    out = F.lit(False)
    for c in cols:
        out |= is_null_word(c)
    return out


def quality_report(df: DataFrame, key_url: str, texts: Sequence[str], hash_col: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, documents, null_<text>, null_words, duplicate_urls, duplicate_hashes): one row per group. Distinct counts come from grouping
    by value first, so that no task holds a group's values."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    base = df.groupBy(*by).agg(
        F.count("*").alias("documents"), *[F.count_if(blank(c)).alias(f"null_{c}") for c in texts], F.count_if(null_words(texts)).alias("null_words")
    )

    def surplus(c: str, name: str) -> DataFrame:
        own = df.where(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count("*").alias("n"))
        return own.groupBy(*by).agg(F.sum(F.col("n") - 1).alias(name))

    out = base
    for part, name in ((surplus(key_url, "duplicate_urls"), "duplicate_urls"), (surplus(hash_col, "duplicate_hashes"), "duplicate_hashes")):
        out = out.join(part, list(by), "left") if by else out.join(F.broadcast(part), how="left")
    return out.fillna(0, ["duplicate_urls", "duplicate_hashes"])


def url_variants(df: DataFrame, url: str) -> DataFrame:
    """(canon, n_rows, n_forms): canonical URLs that occur in more than one form."""
    forms = df.where(F.col(url).isNotNull()).groupBy(canonical_url(url).alias("canon"), F.col(url)).agg(F.count("*").alias("n"))
    return forms.groupBy("canon").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_forms")).where("n_forms > 1")


def freshness(df: DataFrame, ts: str, now: Column, by: Sequence[str] = ()) -> DataFrame:
    """(*by, newest_days, oldest_days): whole days passed at a given time."""
    age = F.floor((F.unix_seconds(now) - F.unix_seconds(F.col(ts))) / 86400)
    return df.groupBy(*by).agg(F.min(age).alias("newest_days"), F.max(age).alias("oldest_days"))


def corpus_report(
    df: DataFrame, key: str, url: str, hash_col: str, embedded: Column, nulls: Sequence[str], texts: Sequence[str], parsed: str, ts: str, now: Column,
    threshold: float = 0.6, passage: float = 0.3, min_share: float = 0.05,
) -> DataFrame:
    """One row on a state of the corpus: documents, null_<c> and rate_<c> for each of `nulls`, parse_rate, duplicate_urls and duplicate_hashes,
    boilerplate_embedded and boilerplate_<c> for each of `texts`, passage_rate, junk and nan_tokens of the embedded text, and the age in days of the
    newest, the oldest and the upper median row. `embedded` must be the text that this state is indexed by. An empty table gives documents 0 and nulls or 0 else.
    Keys must be unique. All parts are single rows, which are broadcast.
    """
    rows = df.withColumn("__e", F.coalesce(embedded, F.lit("")))
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    n = F.count(F.lit(1))
    rate = lambda x: F.round(F.try_divide(x, n), 4)
    base = rows.agg(
        n.alias("documents"), *[F.count_if(blank(c)).alias(f"null_{c}") for c in nulls], *[rate(F.count_if(blank(c))).alias(f"rate_{c}") for c in nulls],
        rate(F.count(parsed)).alias("parse_rate"), F.count_if(is_null_word("__e")).alias("junk"), F.count_if(F.concat(F.lit(" "), squeeze(F.lower("__e")), F.lit(" ")).contains(" nan ")).alias("nan_tokens"),
    )
    parts = [base]
    for c, name in ((url, "duplicate_urls"), (hash_col, "duplicate_hashes")):
        own = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
        parts.append(own.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(name)))
    for c in ("__e", *texts):
        parts.append(boilerplate_ratio(rows, c, (), threshold).select(F.round(F.coalesce("ratio", F.lit(0.0)), 4).alias("boilerplate_" + ("embedded" if c == "__e" else c))))
    parts.append(passage_rate(rows, "__e", key, passage, 8, min_share).select(F.round("rate", 4).alias("passage_rate")))
    ages = df.where(F.col(ts).isNotNull()).groupBy(F.floor((F.unix_seconds(now) - F.unix_seconds(F.col(ts))) / 86400).alias("age")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("age"))  # of the different ages in days, which are few
    ages = ages.withColumn("upto", before).withColumn("half", F.floor(F.sum("n").over(Window.partitionBy(F.lit(0))) / 2))
    parts.append(ages.agg(F.min("age").alias("newest_days"), F.max("age").alias("oldest_days"), F.min(F.when(F.col("upto") > F.col("half"), F.col("age"))).alias("median_days")))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), how="left")  # of one row each
    return out


class QualityError(ValueError):
    """A table that fails its gate."""


def assert_clean(report: DataFrame, *columns: str) -> DataFrame:
    """The report, if none of the named counts is above 0 in any of its rows; else QualityError."""
    bad = report.agg(*[F.max(c).alias(c) for c in columns]).first()
    failed = {c: bad[c] for c in columns if bad[c]}
    if failed:
        raise QualityError(f"not clean: {failed}")
    return report
