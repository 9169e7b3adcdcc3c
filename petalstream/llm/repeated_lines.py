"""Lines repeated across one source: mergeable heavy-hitter summaries, exact verification, removal by broadcast sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petalstream.functions.text import SPACE, compose, fold_case
from petalstream.plans.session import cut, small, written

NO_SOURCE = "\x00"
#: Tasks whose sketches of one source meet in one task first, before those meet in turn.
MERGED = 64
#: Pieces that a line's rows are spread over where the confirmed lines are too many to broadcast.
SALTS = 64


def hashed_lines(df: DataFrame, source: str, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """*keep, __row, __source and, for each field, __lines_<field>: a 128-bit hash of the bare form of each of its lines (split at \\n).

    Two lines have the same bare form if they are equal when white space, case, punctuation and composition are ignored. A line without any
    letter has a null instead. Null: null. The whole value is composed, folded and stripped at once, which keeps its line ends; all later
    passes read the hashes, which are written once, with a number for each row. Rows without a source form one source.
    """
    named = F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)).alias("__source")
    out = df.select(*keep, named, *[compose(fold_case(f)).alias(f"__text_{f}") for f in fields])
    forms = []
    for f in fields:
        bare = F.split(F.regexp_replace(f"__text_{f}", rf"[{SPACE}\p{{P}}&&[^\n]]+", ""), "\n")
        forms.append(F.transform(bare, lambda x: F.when(x.rlike(r"\p{L}"), F.md5(x))).alias(f"__lines_{f}"))
    return written(out.select(*keep, F.monotonically_increasing_id().alias("__row"), "__source", *forms))


def repeated_lines(lines: DataFrame, fields: Sequence[str], min_rows: int = 5, min_share_pct: int = 5, tracked: int = 4000) -> DataFrame:
    """(__source, line, n_rows): hashes of the lines in at least `min_rows` rows and `min_share_pct` percent of their source's rows, from
    `hashed_lines`. Exact.

    First pass: a frequent-items sketch per source, made map-side and merged in two steps, so a source of any size sends one sketch a task
    and no task merges more than MERGED of them or their number over MERGED. A sketch that tracks M items and saw n of them misses none that
    occurs more than 7 n / M times; where that bound does not reach the threshold (over M / 140 distinct lines a row on average) all lines of
    the source become candidates. Second pass: exact counts of the candidates. An empty table gives no rows.
    """
    rows = lines.groupBy("__source").agg(F.count("*").alias("n"))
    need = F.greatest(F.lit(min_rows).cast("long"), F.ceil(F.col("n") * min_share_pct / 100)).alias("need")
    rows = small(cut(rows.select("__source", "n", need)))
    empty = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(*[F.coalesce(f"__lines_{f}", empty) for f in fields]))
    own = lines.select("__source", F.explode(every).alias("line")).where("line is not null")
    hashes = own.select("__source", F.pmod(F.spark_partition_id(), F.lit(MERGED)).alias("__p"), F.xxhash64("line").alias("h")).groupBy("__source", "__p")
    some = hashes.agg(F.expr(f"approx_top_k_accumulate(h, {tracked})").alias("state"), F.count("*").alias("n_lines"))
    sketches = some.groupBy("__source").agg(F.expr(f"approx_top_k_combine(state, {tracked})").alias("state"), F.sum("n_lines").alias("n_lines")).join(rows, "__source")
    sure = F.col("n_lines") * 7 < F.col("need") * tracked
    tops = F.when(sure, F.filter(F.expr(f"approx_top_k_estimate(state, {tracked})"), lambda x: x["count"] >= F.col("need"))["item"])
    # a null hash stands for "every line of this source"
    candidates = cut(sketches.select("__source", F.explode(F.when(sure, tops).otherwise(F.array(F.lit(None).cast("long")))).alias("h")))
    kept = own.withColumn("h", F.xxhash64("line")).join(small(candidates.where("h is not null")), ["__source", "h"], "left_semi").drop("h")
    whole = candidates.where("h is null").select("__source")
    if not whole.isEmpty():
        kept = kept.unionByName(own.join(small(whole), "__source", "left_semi"))
    counts = kept.groupBy("__source", "line").agg(F.count("*").alias("n_rows")).join(rows, "__source")
    return cut(counts.where("n_rows >= need").select("__source", "line", "n_rows"))


def _hits(lines: DataFrame, confirmed: DataFrame, fields: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(*keep, field, line_no) of the confirmed lines: a hash join with the broadcast set; where that is too large, a shuffle join in which
    each line's rows are spread by a salt, for one line may stand in all rows of a source."""
    none = F.array().cast("array<string>")

    def stands(f: str) -> Column:
        return F.transform(F.coalesce(f"__lines_{f}", none), lambda x, i: F.struct(F.lit(f).alias("field"), (i + 1).cast("long").alias("line_no"), x.alias("line")))

    each = lines.select(*keep, "__row", "__source", F.explode(F.concat(*map(stands, fields))).alias("x")).select(*keep, "__row", "__source", "x.*").where("line is not null")
    sets, on = confirmed.select("__source", "line"), ["__source", "line"]
    if (bounded := small(sets)) is not sets:
        return each.join(bounded, on, "left_semi").select(*keep, "field", "line_no")
    salted = sets.select(*on, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return each.withColumn("salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS))).join(salted, [*on, "salt"], "left_semi").select(*keep, "field", "line_no")


def find_lines(lines: DataFrame, confirmed: DataFrame, fields: Sequence[str], key: str) -> DataFrame:
    """(key, field, line_no): where the confirmed lines stand; line_no counts from 1 over all lines of the value. `lines` are those of
    `hashed_lines` with the key kept. Equal keys give their rows each."""
    return _hits(lines, confirmed, fields, [key])


def remove_lines(df: DataFrame, source: str, fields: Sequence[str], min_rows: int = 5, min_share_pct: int = 5) -> DataFrame:
    """The table with the lines repeated within a source taken out of the fields; other columns, other lines and nulls stay as they are.

    The rows are written once with the hashes of their lines; what is to go meets them by the row's number, so no source is a hot key.
    """
    lines = hashed_lines(df, source, fields, df.columns)
    hits = _hits(lines, repeated_lines(lines, fields, min_rows, min_share_pct), fields, ["__row"])
    gone = hits.groupBy("__row").agg(*[F.collect_list(F.when(F.col("field") == f, F.col("line_no").cast("int"))).alias(f"__gone_{f}") for f in fields])
    out = lines.select(*df.columns, "__row").join(gone, "__row", "left")

    def rest(f: str) -> Column:
        kept = F.filter(F.split(F.col(f), "\n"), lambda x, i: ~F.array_contains(f"__gone_{f}", i + 1))
        return F.when(F.size(f"__gone_{f}") > 0, F.array_join(kept, "\n")).otherwise(F.col(f)).alias(f)

    return out.select(*[rest(c) if c in fields else F.col(c) for c in df.columns])
