"""Corpus states: clean, baseline, seeded damage with its ground truth, detection and repair, and their score."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from petalstream.functions import text as T
from petalstream.operators import quality
from petalstream.operators.ordering import greedy_distinct
from petalstream.plans.session import cut, small, written

# The names of the kinds of damage, their rates, and what clones append to a URL.
LABELS = ("missing_field", "boilerplate_flood", "truncation", "mojibake", "duplication")
RATES = {"missing_field": 0.08, "boilerplate_flood": 0.25, "truncation": 0.08, "mojibake": 0.06, "duplication": 0.05}
CLONES = ("//", "/?utm_source=google", "/?ref=fb")


def draw(seed: int, label: str, key: str) -> Column:
    """A number in [0, 1) for each key: the same whatever the partitioning, and the same in any engine that has MD5."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(label), F.col(key).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)


def clean(df: DataFrame, url: str, title: str, seq: str, is_wanted: Column) -> DataFrame:
    """Adds drop_reason: null for kept rows, else the first that applies of 'unwanted', 'no_title' and 'duplicate' (not the first row of
    its URL among those that pass the others)."""
    early = F.when(~F.coalesce(is_wanted, F.lit(False)), "unwanted").when(F.coalesce(F.col(title), F.lit("")) == "", "no_title")
    marked = df.withColumn("__early", early)
    firsts = marked.where("__early is null").groupBy(url).agg(F.min(seq).alias("__first"))
    joined = marked.join(firsts, url, "left")
    reason = F.coalesce("__early", F.when(F.col(seq) > F.col("__first"), "duplicate"))
    return joined.select(*df.columns, reason.alias("drop_reason"))


def embed_text(*cols: Column | str) -> Column:
    """The non-empty parts, joined by ' . '."""
    return F.concat_ws(" . ", *[F.nullif(T.col(c), F.lit("")) for c in cols])


def baseline_text(*cols: str) -> Column:
    """The naive form: all parts joined, and the word 'nan' as soon as one is missing."""
    missing = F.lit(False)
    for c in cols:
        missing |= F.coalesce(F.col(c), F.lit("")) == ""
    return F.when(missing, "nan").otherwise(F.concat_ws(" ", *cols))


FLOOD = (
    "Giao hoa tận nơi trong ngày, miễn phí thiệp và băng rôn cho mọi đơn hàng của tiệm chúng tôi. "
    "Quý khách vui lòng nhắn tin trước hai giờ để thợ hoa chuẩn bị chu đáo và giao đúng hẹn."
)


def baseline_records(df: DataFrame, naive: str, wanted: Column, name: str = "baseline") -> tuple[DataFrame, Observation]:
    """The table as it is, with counters that fill as it is first read: rows, texts that are the word 'nan', and rows that are not wanted."""
    seen = Observation(name)
    counts = (F.count(F.lit(1)).alias("records"), F.count_if(F.col(naive) == "nan").alias("nan_texts"), F.count_if(~F.coalesce(wanted, F.lit(False))).alias("unwanted"))
    return df.observe(seen, *counts), seen


def corrupt(
    df: DataFrame, key: str, url: str, title: str, text: str, seed: int = 42, rates: dict[str, float] | None = None, others: Sequence[str] = (), constants: Sequence[dict] = ()
) -> DataFrame:
    """The table damaged on purpose, with `labels`, the truth. A row is hit by each kind of damage on its own draw; of the text, the title and the
    `others` a missing field blanks one. Clones follow as rows with all of the damage, another form of the URL and the label 'duplication' only;
    `constants` are rows appended as they are, with a label each under 'label' and null in columns that they don't name. Null keys draw too."""
    r = RATES | (rates or {})
    hit = {k: draw(seed, k, key) < v for k, v in r.items()}
    fields = (text, title, *others)
    which = F.floor(draw(seed, "field", key) * len(fields))
    blank = lambda i: F.when(hit["missing_field"] & (which == i), F.lit("")).otherwise(F.coalesce(F.col(fields[i]), F.lit("")))
    new_body = F.when(hit["boilerplate_flood"], F.concat_ws(" ", F.lit(FLOOD), blank(0))).otherwise(blank(0))
    new_body = F.when(hit["truncation"], F.substring(new_body, F.lit(1), F.floor(draw(seed, "length", key) * 26).cast("int"))).otherwise(new_body)
    out = df.withColumns({"__b": new_body, "__h": blank(1), **{f"__o{i}": blank(i + 2) for i in range(len(others))}})
    garble = lambda c: F.when(hit["mojibake"], T.misdecode(c)).otherwise(F.col(c))
    out = out.withColumns({text: garble("__b"), title: garble("__h"), **{o: F.col(f"__o{i}") for i, o in enumerate(others)}})
    labels = F.array_compact(F.array(*[F.when(hit[k], k) for k in ("missing_field", "boilerplate_flood", "truncation", "mojibake")]))
    out = out.withColumn("labels", labels).select(*df.columns, "labels")
    form = F.element_at(F.array(*map(F.lit, CLONES)), (F.floor(draw(seed, "form", key) * len(CLONES)) + 1).cast("int"))
    clones = out.where(hit["duplication"]).withColumn(url, F.concat(F.regexp_replace(url, "/+$", ""), form)).withColumn("labels", F.array(F.lit("duplication")))
    out = out.unionByName(clones)
    if constants:
        kinds = {f.name: f.dataType for f in df.schema}
        named = [c for c in df.columns if any(c in row for row in constants)]
        rows = df.sparkSession.createDataFrame([(*(row.get(c) for c in named), [row["label"]]) for row in constants], StructType([*(StructField(c, kinds[c]) for c in named), StructField("labels", ArrayType(StringType()))]))
        out = out.unionByName(rows, allowMissingColumns=True).select(*out.columns)
    return out


def urls_with(labelled: DataFrame, label: str | None = None, url: str = "url") -> DataFrame:
    """The distinct URLs that carry a label, or any."""
    return labelled.where(F.col("label") == label if label is not None else F.col("label").isNotNull()).select(url).distinct()


def _unusable(c: str) -> Column:
    return (F.trim(F.coalesce(F.col(c), F.lit(""))) == "") | T.is_null_word(c)


def mend(
    df: DataFrame, seq: str, url: str, title: str, text: str, others: Sequence[str] = (), hashed: Sequence[str] = (),
    min_share: float = 0.05, flood: float = 0.3, short: int = 30, size: int = 8, shared_share: float = 0.6,
) -> DataFrame:
    """All rows, mended, with `found` (the damage that each showed), `kept` and `new_hash`. `seq` must be unique and not null.

    In this order: a title, text or other field that is blank or a word for null is missing, and such words are emptied; wrong encodings of title
    and text are undone; a text shorter than `short` then is truncated; one of whose n-grams a share of `flood` is repeated across the corpus loses
    its repeated sentences; and going through the rows, canonical URLs first, then short ones, then by `seq`, a row whose canonical URL or
    whose mended title and text stood in a row before it that was no duplicate itself is one. Kept is what has a title and is no duplicate; rows without
    a title still hide others. Kept rows get a new hash over url and the `hashed` fields (all mended ones without). Repeated n-grams and shared tokens are those of the texts
    as they came. Null texts are empty.
    """
    fix = lambda c: T.redecode(F.when(T.is_null_word(c), "").otherwise(F.coalesce(F.col(c), F.lit(""))))
    fields = (title, text, *others)
    missing = reduce(or_, map(_unusable, fields))
    garbled = T.looks_misdecoded(title) | T.looks_misdecoded(text)
    fixed = {c: fix(c) if c in (title, text) else F.when(T.is_null_word(c), "").otherwise(F.coalesce(F.col(c), F.lit(""))) for c in fields}
    rows = df.select(
        *[fixed[c].alias(c) if c in fixed else F.col(c) for c in df.columns], F.coalesce(F.col(text), F.lit("")).alias("__was"),
        missing.alias("__missing"), garbled.alias("__garbled"), _unusable(title).alias("__untitled"),
    )
    rows = written(rows)
    own = written(quality.passages(rows, text, seq, size))
    changed = rows.where(F.col(text) != F.col("__was"))
    before = own.join(small(cut(changed.select(seq))), seq, "left_anti").unionByName(quality.passages(changed, "__was", seq, size))
    repeated = cut(quality.frequent(before, rows.count(), min_share))
    share = own.join(small(repeated).withColumn("__hit", F.lit(1)), "h", "left").groupBy(seq).agg((F.count("__hit") / F.count("*")).alias("__share"))
    flooded = cut(share.where(F.col("__share") >= flood).select(seq))
    texts = rows.select(seq, F.col(text).alias("__t")).join(small(flooded), seq, "left_semi")
    stripped = strip_sentences(texts, "__t", seq, repeated, quality.boilerplate_tokens(rows.select("__was"), "__was", (), shared_share).select("token"), size)
    out = rows.join(stripped.select(seq, F.col("__t").alias("__stripped"), F.lit(True).alias("__flooded")), seq, "left")
    out = out.withColumn("__short", (F.length(text) > 0) & (F.length(text) < short)).withColumn(text, F.coalesce("__stripped", text))
    canon = T.canonical_url(url)
    plain = F.coalesce(F.lower(F.regexp_replace(url, "/+$", "")) == canon, F.lit(False))
    # one sortable text: canonical forms first, then short URLs, then input order
    order = F.concat(F.when(plain, "0").otherwise("1"), F.lpad(F.length(F.coalesce(url, F.lit(""))).cast("string"), 9, "0"), F.lpad(F.col(seq).cast("string"), 20, "0"))
    out = written(out.withColumns({"__order": order, "__canon": canon, "__body": T.normalized_body(title, text)}).withColumn("__body", F.md5("__body")))
    firsts = greedy_distinct(out.select("__order", "__canon", "__body"), "__order", ["__canon", "__body"]).select("__order", F.lit(True).alias("__first"))
    out = out.join(firsts, "__order", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    found = F.array_compact(F.array(
        F.when(F.col("__missing"), "missing_field"), F.when(yes("__flooded"), "boilerplate_flood"), F.when(F.col("__short"), "truncation"),
        F.when(F.col("__garbled"), "mojibake"), F.when(~yes("__first"), "duplication"),
    ))
    kept = yes("__first") & ~F.col("__untitled")
    return out.select(*df.columns, found.alias("found"), kept.alias("kept"), F.when(kept, T.content_hash(url, *(hashed or fields))).alias("new_hash"))


def detect(df: DataFrame, seq: str, url: str, title: str, text: str, **kw) -> DataFrame:
    """(seq, url, found): the damage that each row shows, by `mend`."""
    return mend(df, seq, url, title, text, **kw).select(seq, url, "found")


def repair(df: DataFrame, seq: str, url: str, title: str, text: str, hash_col: str | None = None, **kw) -> DataFrame:
    """The rows that `mend` keeps, mended, with the new hash in `hash_col`."""
    out = mend(df, seq, url, title, text, **kw).where("kept")
    return out.select(*[F.col("new_hash").alias(c) if c == hash_col else F.col(c) for c in df.columns])


def prf(truth: DataFrame, found: DataFrame, key: str = "url", labels: Sequence[str] = LABELS) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) of two tables (key, label); labels without cases score 0."""
    a = truth.select(key, "label").distinct().withColumn("t", F.lit(1))
    b = found.select(key, "label").distinct().withColumn("f", F.lit(1))
    both = a.join(b, [key, "label"], "full").groupBy("label").agg(
        F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn")
    )
    every = truth.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    out = every.join(both, "label", "left").fillna(0, ["tp", "fp", "fn"])
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def any_defect(truth: DataFrame, found: DataFrame, key: str = "url") -> DataFrame:
    """One row as of `prf`, for whether a key carries any label at all."""
    return prf(*[x.select(key, F.lit("any").alias("label")) for x in (truth, found)], key, ("any",))


def macro_f1(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg(F.round("f1", 4)).alias("macro_f1"))


def strip_sentences(df: DataFrame, text: str, key: str, repeated: DataFrame, shared: DataFrame | None = None, size: int = 8, grams: float = 0.5, share: float = 0.85) -> DataFrame:
    """The texts without sentences that have no token, at least `grams` of whose n-grams are among the repeated (h), or at least `share` of whose tokens,
    each time that they stand there, are among the shared (token). A text that would lose all of its sentences stays as it is.

    Sentences meet both sets in joins by hash; n-grams and tokens are counted in one aggregate. Keys must be unique.
    """
    parts = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=[.!?])\s+")).alias("__at", "__s")).withColumn("__tok", T.tokens("__s"))
    parts = written(parts.where(F.size("__tok") > 0))
    marked = parts.select(key, "__at", F.explode(T.shingles(F.col("__tok"), size)).alias("g")).select(key, "__at", F.xxhash64("g").alias("h"))
    marked = marked.join(small(cut(repeated.select("h"))).withColumn("__hit", F.lit(1)), "h", "left").select(key, "__at", F.lit(True).alias("__gram"), "__hit")
    if shared is not None:  # at most the mean number of tokens of a text, over the share of texts that they stand in
        words = parts.select(key, "__at", F.explode("__tok").alias("token"))
        words = words.join(small(cut(shared.select("token"))).withColumn("__hit", F.lit(1)), "token", "left")
        marked = marked.unionByName(words.select(key, "__at", F.lit(False).alias("__gram"), "__hit"))
    part = lambda is_gram: F.try_divide(F.count(F.when(F.col("__gram") == is_gram, F.col("__hit"))), F.count_if(F.col("__gram") == is_gram))
    bad = marked.groupBy(key, "__at").agg((F.coalesce(part(True), F.lit(0.0)) >= grams).alias("__a"), (F.coalesce(part(False), F.lit(0.0)) >= share).alias("__b"))
    left = parts.join(bad, [key, "__at"], "left").where(~F.coalesce(F.col("__a") | F.col("__b"), F.lit(False)))
    joined = left.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("__at", "__s")))["__s"], " ").alias("__j"))
    joined = joined.select(key, F.trim("__j").alias("__j"))
    return df.join(joined, key, "left").select(*[F.coalesce(F.nullif("__j", F.lit("")), F.col(text)).alias(text) if c == text else F.col(c) for c in df.columns])


def strip_repeated(df: DataFrame, text: str, key: str, min_share: float = 0.05, size: int = 8, shared_share: float = 0.6) -> DataFrame:
    """The texts without the sentences that are repeated across the corpus or made of its shared tokens, by `strip_sentences`."""
    shared = quality.boilerplate_tokens(df, text, (), shared_share).select("token")
    return strip_sentences(df, text, key, quality.repeated_passages(df, text, key, size, min_share), shared, size)
