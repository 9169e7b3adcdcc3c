"""Citations in generated answers, and the context that they refer to. All of it is row-local columns; only the rates aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petalstream.functions.text import col

# A citation mark, and what makes a sentence a claim.
MARK = r"\[(\d{1,2})\]"
# The caller's domain tells what a claim is; by default, a number of three digits or more.
CLAIM = r"(?<![\p{L}\p{N}_])\d[\d.,]{2,}"


def marks(answer: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(col(answer), F.lit("")), F.lit(MARK), F.lit(1)), lambda x: x.cast("int"))


def _numbers(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def cited(answer: Column | str, n: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(marks(answer), lambda x: (x >= 1) & (x <= n))))


def invalid(answer: Column | str, n: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(marks(answer), lambda x: (x < 1) | (x > n))))


def unused(answer: Column | str, n: Column) -> Column:
    return F.array_except(_numbers(n), cited(answer, n))


def _uncited(answer: Column | str) -> Column:
    """The sentences of lines without any mark, without questions, which claim nothing."""
    lines = F.filter(F.split(F.coalesce(col(answer), F.lit("")), "\n"), lambda b: (F.trim(b) != "") & ~b.rlike(MARK))
    sentences = F.transform(F.flatten(F.transform(lines, lambda b: F.split(b, r"(?<=[.!?])\s+"))), lambda s: F.trim(s))
    return F.filter(sentences, lambda s: (s != "") & ~s.rlike(r"\?\s*\z"))


def uncited_claims(answer: Column | str, claim: str = CLAIM) -> Column:
    """Sentences with a claim in lines without any mark. At most 120 characters of each are shown."""
    return F.transform(F.filter(_uncited(answer), lambda s: s.rlike(claim)), lambda s: F.substring(s, 1, 120))


def uncited_descriptive(answer: Column | str, descriptive: str, claim: str = CLAIM) -> Column:
    """The weaker tier: sentences that describe something in lines without any mark and hold no claim."""
    return F.transform(F.filter(_uncited(answer), lambda s: s.rlike(descriptive) & ~s.rlike(claim)), lambda s: F.substring(s, 1, 120))


def strip_invalid(answer: Column | str, n: Column) -> Column:
    """The answer without marks beyond the context."""
    bad = invalid(answer, n)
    return F.aggregate(bad, F.coalesce(col(answer), F.lit("")), lambda s, x: F.regexp_replace(s, F.concat(F.lit(r"\[0?"), x.cast("string"), F.lit(r"\]")), F.lit("")))


def report(df: DataFrame, answer: str, n_context: str, claim: str = CLAIM, descriptive: str | None = None) -> DataFrame:
    """Adds cited, invalid, unused, has_citations, n_uncited_claims, n_uncited_descriptive (0 without an expression for these) and is_valid. Without context
    nothing can be uncited."""
    n = F.coalesce(F.col(n_context), F.lit(0)).cast("int")
    out = df.withColumns({"cited": cited(answer, n), "invalid": invalid(answer, n), "unused": unused(answer, n)})
    told = {"n_uncited_claims": uncited_claims(answer, claim), "n_uncited_descriptive": uncited_descriptive(answer, descriptive, claim) if descriptive else F.array()}
    out = out.withColumns({k: F.when(n > 0, F.size(v)).otherwise(0) for k, v in told.items()} | {"has_citations": F.size("cited") > 0})
    return out.withColumn("is_valid", (F.size("invalid") == 0) & (F.col("n_uncited_claims") == 0))


def rates(reports: DataFrame, n_context: str) -> DataFrame:
    """(n, invalid_index_rate, citation_rate, validity_rate, uncited_rate, descriptive_rate, mean_unused) over rows with context; nulls where there is none."""
    share = lambda c: F.round(F.avg(c.cast("int")), 4)
    return reports.where(F.col(n_context) > 0).agg(
        F.count("*").alias("n"), share(F.size("invalid") > 0).alias("invalid_index_rate"), share(F.col("has_citations")).alias("citation_rate"),
        share(F.col("is_valid")).alias("validity_rate"), share(F.col("n_uncited_claims") > 0).alias("uncited_rate"),
        share(F.col("n_uncited_descriptive") > 0).alias("descriptive_rate"), F.round(F.avg(F.size("unused")), 2).alias("mean_unused"),
    )


def context(hits: DataFrame, query_id: str, rank: str, title: str, k: int, length: int = 300) -> DataFrame:
    """(query_id, context): the first k hits of each query as a numbered list, texts cut to `length`."""
    line = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), F.substring(F.coalesce(title, F.lit("")), 1, length))
    rows = hits.where(F.col(rank) <= k).groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("l")))).alias("x"))
    return rows.select(query_id, F.array_join(F.col("x")["l"], "\n").alias("context"))


def history(turns: Column, at: Column, last: int = 4) -> Column:
    """Of an array of turns, the `last` ones before a place (from 1)."""
    start = F.greatest(F.lit(1), at - last)
    return F.slice(turns, start, F.greatest(F.lit(0), F.least(at - 1, F.lit(last))))


def prompt(rules: str, question: Column, context_text: Column, silent: str) -> Column:
    """Rules, context and question; where there is no context, what to say then."""
    return F.when(F.coalesce(context_text, F.lit("")) == "", F.concat(F.lit(silent + "\n"), question)).otherwise(F.concat(F.lit(rules + "\n"), context_text, F.lit("\n"), question))


def cache_key(*cols: Column | str) -> Column:
    """24 hex digits of SHA-256 over the fields as JSON in the order of their names: the key of a content-addressed cache."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(cols, key=str) if all(isinstance(c, str) for c in cols) else cols)), 256), 1, 24)


def probe(requests: DataFrame, cache: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(requests with what the cache has for them under `value`, those that it lacks, each key once). A key stands once in the cache; the misses are what a
    model is asked, and their answers are appended to the cache. Null keys are never found."""
    found = requests.join(cache.select(key, value), key, "left")
    return found, requests.join(cache.select(key), key, "left_anti").where(F.col(key).isNotNull()).dropDuplicates([key])


def answer_json(answer: Column | str, sources: Column, abstained: Column) -> Column:
    """An answer with its sources, numbered from 1 in their order, as one JSON text."""
    numbered = F.transform(sources, lambda s, i: F.struct((i + 1).alias("n"), s.alias("source")))
    return F.to_json(F.struct(col(answer).alias("answer"), numbered.alias("sources"), abstained.alias("abstained")))


def needs_context(question: Column | str, n_turns: Column, back: str, subject: str, words: int = 3) -> Column:
    """Whether a question leans on the turns before it: there are any, and it has at most `words` words, or it refers back and names no subject of
    its own. What refers back and what is a subject are expressions of the caller's language."""
    q = F.trim(F.regexp_replace(F.coalesce(col(question), F.lit("")), r"\s+", " "))
    few = F.size(F.filter(F.split(q, " "), lambda w: w != "")) <= words
    return (F.coalesce(n_turns, F.lit(0)) > 0) & (few | (q.rlike(back) & ~q.rlike(subject)))


def fenced_json(text: Column | str, schema: str) -> Column:
    """JSON of a model's answer, with or without a fence around it; null where it can't be read."""
    return F.from_json(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""), schema)
