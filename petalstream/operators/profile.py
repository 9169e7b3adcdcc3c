"""Column profiles by load: nulls, distinct values, ranges, and patterns induced by minimum description length."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from petalstream.plans.session import written

#: Token classes of an expression: code, expression of one character, and how many characters that stands for.
CLASSES = {
    "D": (r"[0-9]", 10), "H": (r"[0-9a-f]", 16), "K": (r"[0-9A-F]", 16), "L": (r"[0-9a-z]", 36), "U": (r"[0-9A-Z]", 36),
    "A": (r"[0-9A-Za-z]", 62), "W": (r"[\p{L}\p{M}\p{N}]", 300),
}
#: Character sets of a free text, with the numbers of characters they are priced at.
SETS = {"n": (r"\p{N}", 10), "a": (r"a-z", 26), "A": (r"A-Z", 26), "w": (r"\p{L}\p{M}", 150), "s": (r"\s\p{Z}", 4), "p": (r"\p{P}", 30), "o": (r"\p{S}\p{C}", 60)}
#: Tokens are told by class in values up to this length, in longer ones as words only.
FINE = 120
#: What the words of a value are made of, and what stands between them, by the codes of the character sets.
IN_WORDS, BETWEEN = "naAw", "spo"
# Marks around a repetition in a folded shape.
FOLD, UNFOLD = "\ue000", "\ue001"
ANY = ".*"
OCTET_BITS, EXPRESSION_BITS = 8.0, 8.0


def _beyond_ascii(v: Column) -> Column:
    return F.octet_length(v) > F.length(v)


def _shape(v: Column) -> Column:
    """Tokens of a value as codes, with all else as it stands; a code is escaped by none, for letters and digits occur in tokens only."""
    c = F.translate(v, "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "9" * 10 + "f" * 6 + "z" * 20 + "G" * 6 + "Z" * 20)
    c = F.when(_beyond_ascii(v), F.regexp_replace(c, r"(?<![9fzGZ])[9fzGZ]*+[\p{L}\p{M}\p{N}&&[^\x00-\x7f]][9fzGZ\p{L}\p{M}\p{N}]*+", "W")).otherwise(c)
    edge = "(?![9fzGZ])"
    for run, code in (("9+", "D"), ("[9f]+", "H"), ("[9G]+", "K"), ("[9fz]+", "L"), ("[9GZ]+", "U"), ("[9fzGZ]+", "A")):
        c = F.regexp_replace(c, f"(?<![9fzGZ]){run}{edge}", code)
    return c


def _set(v: Column, w: Column) -> Column:
    """Codes of the character sets that a value draws on; `w` is the value with each word as one letter, where what stands between is sooner found."""
    inside = {"n": r"\p{N}", "a": r"[a-z]", "A": r"[A-Z]", "w": r"[\p{L}\p{M}&&[^A-Za-z]]"}
    gaps = {"s": r"[\s\p{Z}]", "p": r"\p{P}", "o": r"[^\p{L}\p{M}\p{N}\p{P}\p{Z}\s]"}
    has = lambda c, code, x: _beyond_ascii(v) & c.rlike(x) if code == "w" else c.rlike(x)
    return F.concat(*[F.when(has(c, code, x), code).otherwise("") for c, kinds in ((v, inside), (w, gaps)) for code, x in kinds.items()])


def long_form(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """One row per value that is neither null nor empty: (*keep, column, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.column", "p.value").where("value is not null and value != ''")


def value_groups(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """(group, column, h1, h2, shape, fine, chars, length, octets, words, between, n): the distinct values of each column and load by a 128-bit hash,
    with their shape, the number of words in them and of characters between words.

    Short values have a shape of token classes, longer ones one of words, of which those in a row with a space between are one repetition. Grouping
    by load, column and value spreads a load or a column of any size; equal values are added up before the shuffle.
    """
    rows = long_form(df, columns, group)
    fine = F.length("value") <= FINE
    rows = rows.select(group, "column", "value", F.regexp_replace("value", r"[\p{L}\p{M}\p{N}]+", "W").alias("w"))
    between = F.length(F.replace("w", F.lit("W"), F.lit("")))
    rows = rows.select(
        group, "column", F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(1), F.col("value")).alias("h2"),
        F.when(fine, _shape(F.col("value"))).otherwise(F.regexp_replace(F.regexp_replace("w", "W(?: W)+", f"{FOLD}W {UNFOLD}"), r"[\t\r\f\x0b]", "\n")).alias("shape"), fine.alias("fine"), _set(F.col("value"), F.col("w")).alias("chars"),
        F.length("value").alias("length"), F.octet_length("value").alias("octets"), (F.length("w") - between).alias("words"), between.alias("between"),
    )
    return rows.groupBy(group, "column", "h1", "h2", "shape", "fine", "chars", "length", "octets", "words", "between").agg(F.count("*").alias("n"))


def _quote(ch: str) -> str:
    return "\\" + ch if ch in r"\.[]{}()*+-?^$|&#~" else r"\s" if ch in " \t\n\x0b\f\r" else ch


def expression(shape: str, length: int | None = None) -> tuple[str, float]:
    """(regular expression, mean bits of a character in tokens) of a shape; a single token of one length has that length."""
    bits = [math.log2(CLASSES[ch][1]) for ch in shape if ch in CLASSES]
    mean = sum(bits) / len(bits) if bits else 0.0
    if length is not None:
        return f"{CLASSES[shape][0]}{{{length}}}", mean
    return "".join(f"{CLASSES[ch][0]}+" if ch in CLASSES else _quote(ch) for ch in shape), mean


def phrase(shape: str) -> str:
    """Tokens joined by one separator, over and over, become a repetition: 'L-L-L' -> 'L(-L)*', with the widest class of them."""
    order = "DHKLUAW"

    def widest(m: re.Match) -> str:
        kinds = [ch for ch in m[0] if ch in CLASSES]
        return FOLD + max(kinds, key=order.index) + m[1] + UNFOLD

    for sep in ("-", " ", r"\.", "_"):
        shape = re.sub(rf"[{order}](?:({sep})[{order}])+", widest, shape)
    return shape


def _phrase_expression(p: str, word: tuple[str, float] | None = None) -> tuple[str, float]:
    """(regular expression, mean bits of a character in tokens) of a folded shape; `word` is what W stands for, if not for any word."""
    classes = CLASSES | ({"W": word} if word else {})
    out, bits = "", []
    for m in re.finditer(f"{FOLD}([{''.join(CLASSES)}])(.){UNFOLD}|(.)", p, re.S):
        if m[1]:
            one = classes[m[1]][0] + "+"
            out += f"{one}(?:{_quote(m[2])}{one})*" + "+" * bool(word)  # what a long text repeats is never given back
            bits.append(math.log2(classes[m[1]][1]) + 0.5)
        elif m[3] in classes:
            out += classes[m[3]][0] + "+"
            bits.append(math.log2(classes[m[3]][1]))
        else:
            out += _quote(m[3])
    return out, sum(bits) / len(bits) if bits else 0.0


def _words_expression(chars: str) -> str | None:
    """Words with what stands between them, over and over. What is repeated is never given back, so a long text is matched without recursion."""
    word, gap = ("".join(SETS[x][0] for x in chars if x in kinds) for kinds in (IN_WORDS, BETWEEN))
    return f"[{gap}]*[{word}]+(?:[{gap}]+[{word}]+)*+[{gap}]*" if word and gap else None


def _length_bits(mean: float) -> float:
    """What a run's length costs: the entropy of a geometric distribution with that mean."""
    p = 1 / max(1.0, mean)
    return 0.0 if p == 1 else -math.log2(p) - (1 - p) / p * math.log2(1 - p)


def _hypotheses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(column, expression, n, bits, octets, is_set): the expressions that each shape or set of characters gives rise to, with what they cost its values."""
    for b in batches:
        rows = []
        for column, kind, form, at, n, length, octets, words, between in zip(*(b[c] for c in ("column", "kind", "form", "at", "n", "length", "octets", "words", "between"))):
            options: dict[str, float] = {}
            price = lambda chars: math.log2(max(2, sum(SETS[x][1] for x in chars)))
            if kind == "set":
                options[f"[{''.join(SETS[x][0] for x in form)}]+"] = length * price(form) + n * _length_bits(length / n)
                if e := _words_expression(form):
                    inside, gaps = ([x for x in form if x in kinds] for kinds in (IN_WORDS, BETWEEN))
                    ends = words * (_length_bits((length - between) / max(1, words)) + _length_bits(between / max(1, words)))
                    options[e] = (length - between) * price(inside) + between * price(gaps) + ends + n * _length_bits(words / n)
            else:
                if kind == "words":
                    chars, _, form = form.partition("|")
                    inside = [x for x in chars if x in IN_WORDS]
                    made = [_phrase_expression(form, (f"[{''.join(SETS[x][0] for x in inside)}]", max(2, sum(SETS[x][1] for x in inside))))]
                else:
                    made = [expression(form, int(at))] if kind == "length" else [expression(form), _phrase_expression(phrase(form))]
                for i, (e, mean) in enumerate(made):
                    stands = sum(ch not in CLASSES and ch not in FOLD + UNFOLD for ch in form)
                    free = max(0, length - n * stands)
                    tokens = sum(ch in CLASSES for ch in form) if kind == "tokens" else words / n
                    code = 0 if kind == "length" else tokens * n * _length_bits(free / n / max(1, tokens))
                    options.setdefault(e, free * mean + code + i * n)
            rows += [(column, e, n, float(bits), octets, kind == "set" and e.startswith("[") and e.endswith("]+")) for e, bits in options.items()]
        yield pd.DataFrame(rows, columns=["column", "expression", "n", "bits", "octets", "is_set"])


def induce(groups: DataFrame, min_share: float = 0.1) -> dict[str, list[str]]:
    """The regular expressions of each column, by minimum description length over all its distinct values.

    Hypotheses are, from narrow to wide, a token of one length, a sequence of tokens, the same with repetitions, words with what stands between
    them over and over, and a character set. Every value of any length gives rise to all kinds but the first. A
    hypothesis costs its own length and, for each distinct value it describes, the characters left open; a value that the model doesn't
    describe is spelled out in octets, and which way a value goes costs the entropy of the shares. Each step adds the hypothesis that
    shortens the whole most, as long as it describes at least `min_share` of the distinct values that are left out so far. All
    statistics are aggregated over all values and shapes; the driver gets the expressions that describe at least `min_share` of a column's
    distinct values, which no other could be chosen before: five for each value at most, so 5 / min_share of a column.
    """
    values = groups.groupBy("column", "h1", "h2", "shape", "fine", "chars", "length", "octets", "words", "between").agg(F.sum("n").alias("n"))
    kinds = [
        F.struct(F.lit("set").alias("kind"), F.col("chars").alias("form"), F.lit(None).cast("int").alias("at")),
        F.struct(F.when(F.col("fine"), "tokens").otherwise("words").alias("kind"), F.when(F.col("fine"), F.col("shape")).otherwise(F.concat_ws("|", "chars", "shape")).alias("form"), F.lit(None).cast("int").alias("at")),
        F.when(F.col("fine") & F.col("shape").isin(*CLASSES), F.struct(F.lit("length").alias("kind"), F.col("shape").alias("form"), F.col("length").alias("at"))),
    ]
    per = values.select("column", "length", "octets", "words", "between", F.explode(F.array_compact(F.array(*kinds))).alias("k")).groupBy("column", "k.kind", "k.form", "k.at")
    per = per.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("length", "octets", "words", "between")])
    totals = {r["column"]: r.n for r in values.groupBy("column").agg(F.count("*").alias("n")).collect()}
    found: dict[str, dict[str, tuple[int, float, int, bool]]] = {c: {} for c in totals}

    def large() -> Column:
        out = F.lit(False)
        for c, total in totals.items():
            out |= (F.col("column") == c) & (F.col("n") >= min_share * total)
        return out

    # a shape of words has an expression of its own, so it can be told to be too rare here; others are added up by expression first
    made = per.where((F.col("kind") != "words") | large()).mapInPandas(_hypotheses, "column string, expression string, n long, bits double, octets long, is_set boolean").groupBy("column", "expression")
    made = made.agg(F.sum("n").alias("n"), F.sum("bits").alias("bits"), F.sum("octets").alias("octets"), F.max("is_set").alias("is_set"))
    for r in sorted(made.where(large()).collect(), key=lambda r: (-r.n, r.expression)):
        found[r["column"]][r.expression] = (r.n, r.bits, r.octets, r.is_set)
    out = {}
    for column, options in found.items():
        total = totals[column]
        chosen: list[str] = []
        while True:
            best, gain = None, 0.0
            for e, (n, bits, octets, _) in options.items():
                left = min(n, total - sum(options[c][0] for c in chosen))
                if left < min_share * total or any(_within(e, c) or _within(c, e) for c in chosen):
                    continue
                q = left / total
                entropy = 0.0 if q >= 1 else -total * (q * math.log2(q) + (1 - q) * math.log2(1 - q))
                saved = (octets * OCTET_BITS - bits) * left / n - len(e) * EXPRESSION_BITS - entropy
                if saved > gain:
                    best, gain = e, saved
            if best is None:
                break
            chosen.append(best)
            if options[best][3]:
                break  # a character set leaves nothing that a further expression could tell apart
        out[column] = chosen or [ANY]
    return out


def _within(narrow: str, wide: str) -> bool:
    """Whether an expression is another one or the same with a fixed length."""
    return narrow == wide or re.sub(r"\{\d+\}", "+", narrow) == wide


def matches(c: Column | str, expressions: Sequence[str]) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike("^(?s:" + "|".join(f"(?:{e})" for e in expressions) + r")\z")


def profile(
    df: DataFrame, group: str, texts: Sequence[str], numbers: Sequence[str] = (), contracts: dict[str, str] | None = None, expressions: dict[str, list[str]] | None = None,
    ranges: bool = False, counted: Sequence[str] = (),
) -> tuple[DataFrame, dict[str, list[str]]]:
    """((group, column, n_rows, n_null, n_missing, n_values, n_distinct, n_violations, n_contract, n_min, n_max), expressions): a profile of each column by load.

    n_null counts null and empty, n_missing null only; n_violations the values that none of the column's induced expressions describes; n_min and n_max are of
    numbers, of which moments count as microseconds since 1970. With `ranges`, v_min and v_max are the least and greatest value of texts (in code point
    order, without empty ones) as well as of numbers. A contract is the exact expression promised for a column: n_contract counts the values that break it, beside
    those that the induced expressions don't describe (null without a contract). Of `counted` columns only nulls are counted. Ranges,
    nulls and violations come from one aggregate over narrow rows; distinct values from grouping by value, so neither a large load nor
    a frequent value meets in one task. Given expressions (of an earlier load) are used as they are. An empty table gives no rows.
    """
    for c in numbers:
        if df.schema[c].dataType.typeName() in ("timestamp", "timestamp_ntz", "date"):
            df = df.withColumn(c, F.unix_micros(F.col(c).cast("timestamp")))
    if expressions is None:
        groups = written(value_groups(df, group, texts))
        found = induce(groups)
    else:  # nothing is induced, so values need no shapes
        h1, h2 = F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(1), F.col("value")).alias("h2")
        groups = long_form(df, texts, group).select(group, "column", h1, h2).groupBy(group, "column", "h1", "h2").agg(F.count("*").alias("n"))
        found = dict(expressions)
    contracts = contracts or {}
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    aggs = [F.count("*").alias("n_rows")]
    for c in (*texts, *numbers, *counted):
        aggs += [F.count_if(blank(c)).alias(f"null_{c}"), F.count_if(F.col(c).isNull()).alias(f"missing_{c}")]
    for c in texts:
        aggs.append(F.count_if(~blank(c) & ~matches(F.col(c).cast("string"), found.get(c, [ANY]))).alias(f"bad_{c}"))
    for c, e in contracts.items():
        aggs.append(F.count_if(~blank(c) & ~matches(F.col(c).cast("string"), [e])).alias(f"broken_{c}"))
    for c in numbers:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    wide = df.groupBy(group).agg(*aggs)
    none = F.lit(None).cast("long")
    each = [
        F.struct(F.lit(c).alias("column"), F.col(f"null_{c}").alias("n_null"), F.col(f"missing_{c}").alias("n_missing"), (F.col(f"bad_{c}") if c in texts else none).alias("n_violations"),
                 (F.col(f"broken_{c}") if c in contracts else none).alias("n_contract"), (F.col(f"min_{c}").cast("long") if c in numbers else none).alias("n_min"), (F.col(f"max_{c}").cast("long") if c in numbers else none).alias("n_max"))
        for c in (*texts, *numbers, *counted)
    ]
    base = wide.select(group, "n_rows", F.explode(F.array(*each)).alias("c")).select(group, "n_rows", "c.*")
    distinct = groups.groupBy(group, "column").agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n_values"))
    if numbers:
        values = long_form(df, numbers, group).groupBy(group, "column", "value").agg(F.count("*").alias("n"))
        distinct = distinct.unionByName(values.groupBy(group, "column").agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n_values")))
    joined = base.withColumn("__g", F.col(group)).join(distinct.withColumnRenamed(group, "__d"), (F.col("__g").eqNullSafe(F.col("__d"))) & (base["column"] == distinct["column"]), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = joined.select(base[group], base["column"], "n_rows", "n_null", "n_missing", zero("n_values"), zero("n_distinct"), "n_violations", "n_contract", "n_min", "n_max")
    if ranges:
        out = _with_ranges(out, df, group, texts)
    return out, found


def _with_ranges(out: DataFrame, df: DataFrame, group: str, texts: Sequence[str]) -> DataFrame:
    """Adds v_min and v_max; texts from one aggregate of a row per load, numbers from n_min and n_max."""
    value = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    wide = df.groupBy(F.col(group).alias("__r")).agg(*[f(value(c)).alias(f"{k}_{c}") for c in texts for k, f in (("min", F.min), ("max", F.max))])
    each = [F.struct(F.lit(c).alias("__c"), F.col(f"min_{c}").alias("v_min"), F.col(f"max_{c}").alias("v_max")) for c in texts]
    found = wide.select("__r", F.explode(F.array(*each)).alias("x")).select("__r", "x.*")
    joined = out.join(found, F.col(group).eqNullSafe(F.col("__r")) & (F.col("column") == F.col("__c")), "left")
    both = lambda v, n: F.coalesce(v, F.col(n).cast("string")).alias(v)
    return joined.select(*out.columns, both("v_min", "n_min"), both("v_max", "n_max"))


def coverage_changes(profiled: DataFrame, group: str, loads: DataFrame, run: str, number: str) -> DataFrame:
    """(group, column, coverage, coverage_before): the share of a column's values that its expressions describe, beside that of the
    load before it in the same run. Shares are null where a load has no values of the column."""
    share = F.try_divide(F.col("n_values") - F.col("n_violations"), F.col("n_values")).alias("coverage")
    own = profiled.where("n_violations is not null").select(group, "column", share).join(loads.select(group, run, number), group)
    w = Window.partitionBy(run, "column").orderBy(number)
    return own.select(group, "column", "coverage", F.lag("coverage").over(w).alias("coverage_before"))
