"""Evaluation sets: near-duplicate questions, caps, balanced samples, pooling, carried-over labels, stable ids."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from petalstream.functions.text import fold_diacritics, tokens
from petalstream.operators.ordering import global_rank, greedy_independent, keep_first
from petalstream.operators.states import draw
from petalstream.plans.session import cut


def contains_phrase(text: Column, phrase: str) -> Column:
    """Whether the phrase stands in the text as whole tokens; an empty phrase never does."""
    hay = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    return F.lit(False) if not phrase.strip() else F.contains(hay, F.concat(F.lit(" "), F.array_join(tokens(F.lit(phrase)), " "), F.lit(" ")))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))


def within_words(text: Column, least: int = 2, most: int = 12) -> Column:
    """Whether the text has that many words between white space; null has none."""
    return word_count(text).between(least, most)


def by_group(df: DataFrame, by: str, key: str) -> DataFrame:
    """(by, n, keys): how many rows each group has and the keys of all of them, in order. A group's keys stand in one row, so it is for evaluation sets;
    the count alone is a plain aggregate."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("keys"))


def prefilter(df: DataFrame, key: str, text: str, by: str, cap: int = 30, least: int = 2, most: int = 12) -> DataFrame:
    """The questions worth labelling: of near-duplicates the first by key, of these the ones with a fitting number of words, of these the first `cap` of each group."""
    kept = near_duplicates(df.select(key, text), key, text)[0].where("kept").select(key)
    return cap_per_group(df.join(kept, key, "left_semi").where(within_words(F.col(text), least, most)), by, [key], cap)


def sticky_subset(df: DataFrame, key: str, flag: str, eligible: Column, n: int, seed: int = 42) -> DataFrame:
    """The table with the flag set for the first `n` eligible rows by a seeded draw; a flag that is set stays, whether its row is among these or not."""
    drawn = df.where(eligible).select(key).withColumn("__d", draw(seed, "subset", key)).orderBy("__d", key).limit(n).select(key, F.lit(True).alias("__in"))
    out = df.join(F.broadcast(drawn), key, "left")  # n rows
    return out.select(*[(F.coalesce(F.col(flag), F.lit(False)) | F.col("__in").isNotNull()).alias(flag) if c == flag else F.col(c) for c in df.columns])


def lookup(golds: DataFrame, candidates: DataFrame, url: str) -> DataFrame:
    """The gold rows with what is known of their URLs; unknown ones stay, with nulls."""
    return golds.join(candidates, url, "left")


def in_pool(index: Column, n: Column) -> Column:
    """Whether an index that a judge returned is one of those it was shown, from 1."""
    return F.coalesce(index.between(F.lit(1), n), F.lit(False))


def build(
    questions: DataFrame, labelled: DataFrame, candidates: DataFrame, key: str, text: str, by: str, shares: dict[str, float], target: int, subset: int, judge: Callable[[DataFrame], Column],
    seed: int = 42, cap: int = 30, leak: float = 0.8,
) -> DataFrame:
    """The evaluation set (key, text, by, gold_urls, leaks, answerable, carried, in_subset, stable_id): prefiltered questions are sampled by group and seed; rows that are labelled
    (key, gold_urls) carry over; for the others the `judge` says which of their pooled candidates (key, url, title) are gold; a set whose gold title stands in the question leaks;
    what has gold is answerable; a seeded subset of that is marked, and rows are numbered in order of their text."""
    asked = cut(balanced_sample(prefilter(questions.select(key, text, by), key, text, by, cap), by, key, shares, target, seed))
    again = asked.join(labelled.select(key, "gold_urls"), key).withColumn("carried", F.lit(True))
    pooled = candidates.join(asked.join(labelled.select(key), key, "left_anti"), key)
    judged = pooled.where(F.coalesce(judge(pooled), F.lit(False))).groupBy(key).agg(F.array_sort(F.collect_set("url")).alias("gold_urls"))
    fresh = asked.join(labelled.select(key), key, "left_anti").join(judged, key, "left").withColumn("carried", F.lit(False))
    rows = again.unionByName(fresh).withColumn("gold_urls", F.coalesce("gold_urls", F.array().cast("array<string>")))
    titles = rows.select(key, text, F.explode("gold_urls").alias("url")).join(candidates.select(key, "url", "title"), [key, "url"])
    leaking = titles.groupBy(key).agg(F.max(F.coalesce(leaks_title(F.col(text), F.col("title"), leak), F.lit(False))).alias("leaks"))
    rows = rows.join(leaking, key, "left").withColumn("leaks", F.coalesce("leaks", F.lit(False))).withColumn("answerable", F.size("gold_urls") > 0).withColumn("in_subset", F.lit(False))
    return stable_ids(sticky_subset(rows, key, "in_subset", F.col("answerable") & ~F.col("leaks"), subset, seed), [text, key])


def token_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(set_id, tokens, first, n, key list is kept apart): the distinct sets of folded tokens longer than one character."""
    folded = df.select(key, fold_diacritics(F.coalesce(text, F.lit(""))).alias("__f"))
    words = F.array_sort(F.array_distinct(F.filter(F.split("__f", r"\s+"), lambda t: F.length(t) > 1)))
    return folded.select(key, words.alias("tokens"), F.xxhash64(words).alias("set_id"))


def similar_sets(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, jaccard): all pairs of different sets (set_id, tokens), a < b, of at least that similarity.

    Two sets that similar share a token among the rarest few of each (prefix filter), so the join meets on rare tokens only, and only
    sets of fitting sizes; the tokens are compared once a pair.
    """
    n = F.size("tokens")
    freq = sets.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    ranked = sets.select("set_id", n.alias("n"), F.explode("tokens").alias("t")).join(freq, "t")
    w = Window.partitionBy("set_id").orderBy("df", "t")
    # ceil in integers: a prefix of n - ceil(threshold n) + 1 tokens
    share = int(round(threshold * 1000))
    keep = F.col("n") - F.ceil(F.col("n") * share / 1000) + 1
    prefix = ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep).select("set_id", "n", "t")
    left, right = prefix.select(F.col("set_id").alias("a"), F.col("n").alias("na"), "t"), prefix.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), "t")
    fits = (F.col("a") < F.col("b")) & (F.col("na") * 1000 >= F.col("nb") * share) & (F.col("nb") * 1000 >= F.col("na") * share)
    pairs = left.join(right, "t").where(fits).select("a", "b").distinct()
    a, b = sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("tb"))
    full = pairs.join(a, "a").join(b, "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - shared
    return full.where(shared * 1000 >= union * share).select("a", "b", F.round(shared / union, 6).alias("jaccard"))


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """((key, set_id, kept), pairs): going through the texts in order of their keys, a text is kept unless an equal or similar one was
    kept before. Equal token sets form one class, of which only the first can be kept; similarity is looked up between classes."""
    own = cut(token_sets(df, key, text))
    classes = own.groupBy("set_id", "tokens").agg(F.min(key).alias("first"))
    named = cut(classes)
    pairs = similar_sets(named.select("set_id", "tokens"), threshold)
    a, b = named.select(F.col("set_id").alias("a"), F.col("first").alias("fa")), named.select(F.col("set_id").alias("b"), F.col("first").alias("fb"))
    ordered = pairs.join(a, "a").join(b, "b").select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"))
    kept = greedy_independent(named.select("first"), "first", cut(ordered)).withColumn("__k", F.lit(True))
    out = own.join(kept, own[key] == kept["first"], "left").select(own[key], "set_id", F.coalesce("__k", F.lit(False)).alias("kept"))
    return out, pairs


def cap_per_group(df: DataFrame, by: str, order: Sequence[str], cap: int) -> DataFrame:
    """The first `cap` rows of each group; the limit is pushed below the shuffle (WindowGroupLimit), so a hot group sends few rows."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap).drop("__r")


def balanced_sample(df: DataFrame, by: str, key: str, shares: dict[str, float], target: int, seed: int = 42) -> DataFrame:
    """About target x share rows of each group, by a seeded draw. A larger target only adds rows, and no group depends on another."""
    want = {g: int(math.floor(target * s + 0.5) - (1 if (target * s) % 1 == 0.5 and math.floor(target * s) % 2 == 0 else 0)) for g, s in shares.items()}
    most = max(want.values(), default=0)
    w = Window.partitionBy(by).orderBy("__d", key)
    ranked = df.where(F.col(by).isin(*want)).withColumn("__d", draw(seed, "sample", key)).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most)
    wanted = F.coalesce(*[F.when(F.col(by) == g, n) for g, n in want.items()], F.lit(0))
    return ranked.where(F.col("__r") <= wanted).drop("__d", "__r")


def pool(lists: Sequence[tuple[int, DataFrame]], query_id: str, url: str, rank: str = "hit_rank") -> DataFrame:
    """Candidates of several states, the first of each (query, url) by position of the state and rank."""
    rows = None
    for position, hits in lists:
        part = hits.withColumn("__p", F.lit(position))
        rows = part if rows is None else rows.unionByName(part)
    return keep_first(rows, [query_id, url], ["__p", rank]).drop("__p")


def carry_over(new: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    """The labelled rows that are asked for again, and new rows without labels yet (with nulls in the other columns)."""
    again = labelled.join(new.select(key), key, "left_semi").withColumn("carried", F.lit(True))
    fresh = new.join(labelled.select(key), key, "left_anti").withColumn("carried", F.lit(False))
    return again.unionByName(fresh, allowMissingColumns=True)


def stable_ids(df: DataFrame, order: Sequence[str], prefix: str = "q", width: int = 8, name: str = "stable_id") -> DataFrame:
    """Numbers rows by the order, as 'q00000001'; ranks come from range partitions, not from one task."""
    return global_rank(df, order, "__n").withColumn(name, F.concat(F.lit(prefix), F.lpad(F.col("__n").cast("string"), width, "0"))).drop("__n")


def leaks_title(question: Column, title: Column, share: float = 0.8) -> Column:
    """Whether at least that share of the title's tokens of three or more characters stands in the question as substrings."""
    words = F.filter(tokens(title), lambda t: F.length(t) > 2)
    inside = F.filter(words, lambda t: F.contains(F.lower(question), t))
    return (F.size(words) > 0) & (F.size(inside) >= F.size(words) * share)
