"""Text cut off by field limits: word trigrams inside texts against trigrams at ends, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petalstream.functions.text import compose
from petalstream.plans.session import cut

#: Marks that may be left where a text was cut.
CUT_MARK = r"(?:\[\s*(?:…|\.\.\.)\s*\]|…|\.\.\.)\s*$"
#: Words (letters with marks), numbers, single characters of scripts without spaces, stops and pauses, closing brackets, line ends. Quotes, list
#: marks and symbols are no tokens.
SINGLE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}ー"
# the common letters stand first in the class, for they are told by ranges
TOKEN = rf"[a-zà-öø-ɏ\u0300-\u036f\u0400-\u0481\u1e00-\u1eff[\p{{L}}\p{{M}}&&[^{SINGLE}]]]+|\p{{N}}+(?:[.,:]\p{{N}}+)*|[{SINGLE}]|[.!?。！？…,;:、，：；₫)）]|\n"
#: A text up to its last character of a token, found from the end.
UP_TO_TOKEN = r"^(?s:.*)[\p{L}\p{M}\p{N}.!?。！？…,;:、，：；₫)）]"
#: Characters that don't tell one text from another.
IGNORED = " \t\r\n\xa0.,;:!?…-–—|/*\"'“”‘’«»()[]"
# In the spaced form of a text: starts of lines, ends of lines, the text's end. None of them is a token.
START, LINE, END = "^ ^", "$", "@"
#: Each trigram whose last word is not the text's last, with " $" where a line ends after it; overlapping, by a match of no width.
INSIDE = r"(?<![^ ])(?=([^ ]+ [^ ]+ [^ ^$@][^ ]*(?: \$)?) (?!@))"


def spaced(c: Column) -> Column:
    """The lower-case tokens of a text, each after a space, with line starts, line ends and the text's end; every number is '0'."""
    numbered = F.regexp_replace(F.lower(c), r"\p{N}+(?:[.,:]\p{N}+)*", "0")
    tokens = F.array_join(F.regexp_extract_all(numbered, F.lit(TOKEN), F.lit(0)), " ")
    lines = F.regexp_replace(F.regexp_replace(tokens, r"^(?:\n ?)+|(?: ?\n)+$", ""), r"(?:\n ?)+", f"\\{LINE} {START} ")
    return F.concat_ws(" ", F.lit(START), F.nullif(lines, F.lit("")), F.lit(END))


def _marked(t: Column) -> Column:
    """Whether a mark of omission closes the text; only ends that can be one are matched."""
    end = F.rtrim(t, F.lit(" \t\n\x0b\f\r"))
    return (end.endswith("…") | end.endswith("...") | end.endswith("]")) & t.rlike(CUT_MARK)


def _unmarked(t: Column) -> Column:
    return F.when(_marked(t), F.regexp_replace(t, CUT_MARK, "")).otherwise(t)


def _key(kind: str, *cols: Column) -> Column:
    """96 bits of two independent hashes."""
    return F.struct(F.xxhash64(F.lit(kind), *cols).alias("k"), F.hash(F.lit(kind), *cols).alias("h"))


def truncated(
    df: DataFrame, text: str, key: str, source: str, least: int = 30, rare_pct: float = 1.0, stop_pct: float = 0.3, longer: int = 5, longer_times: int = 10
) -> DataFrame:
    """(key, source, is_cut) of every row; is_cut tells whether its text was cut inside a sentence, a word or a line.

    Over all texts, word trigrams are counted inside lines and at ends of lines, where equal texts count once at the text's end. The
    final trigram of a text is held against those of all other texts. The text is cut
    - if a mark of omission closes it, or
    - if its final trigram is common inside but stands at an end in under `rare_pct` percent of its occurrences; where the trigram occurs
      fewer than `least` times, its last two words decide, then its last word, or
    - if longer words that begin as its last token does follow the same two words (else, where these are new, the same word) at least
      `longer` times and `longer_times` as often as the token itself: a word broken off, or
    - if it ends in a stop or pause that follows the two words before it, seen `10 * least` times, in under `stop_pct` percent.
    Null, empty and blank texts are not cut. An empty table gives no rows. Rows keep their number: equal keys or texts stay apart.
    """
    base = df.select(F.col(key), F.col(source), compose(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    # the last trigram needs the last line with a token only; equal texts are told by their letters and digits
    ended = base.select(key, source, F.explode(F.array(F.struct(_marked(F.col("t")).alias("marked"), F.col("t").alias("t")))).alias("x")).select(key, source, "x.*")
    ended = ended.select(key, source, "marked", F.regexp_extract(F.when(F.col("marked"), F.regexp_replace("t", CUT_MARK, "")).otherwise(F.col("t")), UP_TO_TOKEN, 0).alias("t"))
    last = spaced(F.substring_index("t", "\n", -1))
    # a generator of one element keeps the optimizer from working an expression out anew for each use
    rows = ended.select(key, source, "marked", F.xxhash64(F.translate(F.lower("t"), IGNORED, "")).alias("whole"), F.explode(F.array(F.split(F.substring_index(last, " ", -4), " "))).alias("w"))
    word = lambda i, name: F.get("w", F.lit(i)).alias(name)
    some = F.size("w") > 3
    rows = cut(rows.select(key, source, "whole", (F.col("marked") & some).alias("marked"), *[F.when(some, word(i, x)).alias(x) for i, x in enumerate("abc")]))

    whole = base.select(spaced(_unmarked(F.col("t"))).alias("form"))
    inside = whole.select(F.explode(F.regexp_extract_all("form", F.lit(INSIDE), F.lit(1))).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    inside = inside.select(F.split("g", " ").alias("w"), "n")
    at_end = F.size("w") > 3
    inside = inside.select(word(0, "a"), word(1, "b"), word(2, "c"), F.when(at_end, 0).otherwise(F.col("n")).alias("i"), F.when(at_end, F.col("n")).otherwise(0).alias("t"))
    final = rows.where("c is not null").groupBy("a", "b", "c", "whole").agg(F.lit(1).alias("one"))
    ends = final.groupBy("a", "b", "c").agg(F.lit(0).cast("long").alias("i"), F.count("*").alias("t"))
    stats = inside.unionByName(ends)

    # what is asked of the counts: by one hash each, for the trigram, its shorter contexts, and for each beginning of its last word
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    # a beginning that is asked for is a final token, so only the lengths of these are tried: a few hundred numbers at any size
    lengths = sorted(r.n for r in rows.where("c is not null").select(F.length("c").alias("n")).distinct().collect())
    begun = F.transform(F.filter(F.lit(lengths).cast("array<int>"), lambda k: k < F.length("c")), lambda k: F.substring(c, F.lit(1), k))
    told = F.concat(
        F.array(_key("abc", a, b, c), _key("bc", b, c), _key("c", c), _key("ab", a, b)),
        F.transform(begun, lambda p: _key("ab-", a, b, p)), F.transform(begun, lambda p: _key("b-", b, p)),
    )
    counts = stats.select(F.explode(told).alias("q"), "i", "t").groupBy("q.k", "q.h").agg(F.sum("i").alias("i"), F.sum("t").alias("t"))
    kinds = {"abc": (a, b, c), "bc": (b, c), "c": (c,), "ab": (a, b), "ab-": (a, b, c), "b-": (b, c)}
    asked = rows.where("c is not null").select("a", "b", "c").distinct().select("a", "b", "c", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), _key(k, *v).alias("q")) for k, v in kinds.items()])).alias("x"))
    asked = asked.select("a", "b", "c", "x.kind", "x.q.k", "x.q.h").join(counts, ["k", "h"], "left")
    of = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(x))), F.lit(0))
    known = asked.groupBy("a", "b", "c").agg(*[of(k, x).alias(f"{x}_{k}") for k in kinds for x in "it"])

    def rare(kind: str) -> tuple[Column, Column]:
        others = F.col(f"t_{kind}") - 1
        return others + F.col(f"i_{kind}") >= least, others * 100 < (others + F.col(f"i_{kind}")) * rare_pct

    (has3, rare3), (has2, rare2), (has1, rare1) = rare("abc"), rare("bc"), rare("c")
    here3 = F.col("i_abc") + F.col("t_abc") - 1
    here2 = F.col("i_bc") + F.col("t_bc") - 1
    before = F.col("i_ab") + F.col("t_ab")
    on3, on2 = F.col("i_ab-") + F.col("t_ab-"), F.col("i_b-") + F.col("t_b-")
    broken = ((on3 >= longer) & (on3 >= here3 * longer_times)) | ((on3 + here3 == 0) & (on2 >= longer) & (on2 >= here2 * longer_times))
    stop = c.rlike(r"^\p{P}$") & (before >= 10 * least) & (here3 * 100 < before * stop_pct)
    ends_rarely = F.when(has3, rare3).when(has2, rare2).otherwise(has1 & rare1)
    flags = known.select("a", "b", "c", (ends_rarely | broken | stop).alias("is_cut"))
    out = rows.where("c is not null").join(flags, ["a", "b", "c"], "left").select(key, source, (F.col("marked") | F.coalesce("is_cut", F.lit(False))).alias("is_cut"))
    return out.unionByName(rows.where("c is null").select(key, source, F.lit(False).alias("is_cut")))  # null keys of a join would meet in one task


def truncation_rates(found: DataFrame, source: str) -> DataFrame:
    """(source, n_rows, n_cut, cut_share) from the rows of `truncated`."""
    out = found.groupBy(source).agg(F.count("*").alias("n_rows"), F.count_if("is_cut").alias("n_cut"))
    return out.withColumn("cut_share", F.col("n_cut") / F.col("n_rows"))
