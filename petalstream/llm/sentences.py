"""Sentence boundaries by document-centred disambiguation, with corpus fallback and terminator rules by script."""

from __future__ import annotations

import re
from collections import ChainMap, Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petalstream.plans.session import written

# Terminators that always count, those that need a look at what follows, brackets and quotes.
FULL_STOPS = "。！？｡।॥؟۔።։။។"
STOPS = ".!?…"
CLOSERS = "\"'”’»›)]}」』）】》〉"
OPENERS = "\"'“‘„‚«‹([{「『（【《〈¿¡"
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "‘": "’", "‚": "‘’", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", '"': '"'}
OPENING = re.compile(f"[{re.escape(''.join(PAIRS))}]").finditer
CLOSING = {k: re.compile(f"[{re.escape(v)}]").finditer for k, v in PAIRS.items()}
LINE_END = re.compile(r"[\n\r\x0b\x0c\x85  ]+")
CLOSES_LINE = re.compile(rf"[{re.escape(CLOSERS)}]*(?:[ \t\xa0\u2000-\u200a\u202f\u3000]*(?:{LINE_END.pattern}|\Z))")
LIST_MARK = re.compile(r"\s*(?:\d{1,3}[.)．、]|[^\W\d_][.)]|[-*•·–—‣▪])(?=\s)")
LABEL = re.compile(r"\s*[^\W\d_][^\s.:：!?]{0,19}(?:\s[^\s.:：!?]{1,19}){0,2}\s?[:：]\s")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
CANDIDATE = re.compile(rf"[{re.escape(FULL_STOPS + STOPS)}]+")
THAI = "฀-๿຀-໿"
THAI_SPACE = re.compile(rf"(?<=[{THAI}])[  ]+(?=[{THAI}]|[A-ZÀ-Þ][a-zß-ɏẠ-ỿ])")
# Words that join a clause to the one before it, words that close a sentence politely, and marks after which a space is customary.
THAI_LINKS = re.compile("(?:และ|หรือ|ซึ่ง|ที่(?!นี่|นั่น|โน่น)|เพราะ|เพื่อ|โดย|จึง|ก็|ว่า|กับ|ของ|ແລະ|ຫຼື|ຊຶ່ງ|ທີ່|ເພາະ|ເພື່ອ|ໂດຍ|ຈຶ່ງ|ກໍ|ວ່າ|ກັບ|ຂອງ)")
THAI_CLOSERS = ("ค่ะ", "คะ", "ครับ", "จ้ะ", "จ้า", "ເຈົ້າ", "ຄັບ")
THAI_MARKS = ("ๆ", "ฯ", "ໆ", "ຯ")
DOTTED = re.compile(r"[^\W\d_]{1,3}(?:[.-][^\W\d_]{1,3})*\.[^\W\d_]{1,3}")
ADDRESS = re.compile(r"^\S*(?:[/@\\_]|www\.)")
DEVANAGARI = re.compile(r"[ऀ-ॿ]$")


def _before(piece: str) -> str:
    """The token in front of a full stop, without what opens it."""
    piece = piece.lstrip(OPENERS)
    return re.split(r"[(\[/“‘«\"]", piece)[-1]


def observe(text: str, put: Counter) -> None:
    """Counts of unambiguous occurrences in a text: words that start lines or follow ! and ? ("S"), capitalized words inside sentences
    ("M"), words after a number with a full stop ("D"), and what follows each token with a full stop: a line end ("end"), small letters
    or a pause ("low"), a number ("num"), or a capitalized word ("cap", with that word)."""
    for line in LINE_END.split(text):
        m = LIST_MARK.match(line)
        start = m.end() if m else 0
        m = LABEL.match(line, start)
        tokens = line[m.end() if m else start :].split()
        prev = ""
        for i, t in enumerate(tokens):
            core = t.lstrip(OPENERS)
            if core and core[0].isupper():
                m = WORD.match(core)
                word = m[0] if m else core
                bare = prev.rstrip(CLOSERS)
                if not prev or bare[-1:] in "!?":
                    put["S", word, ""] += 1
                elif prev[-1].islower() or prev[-1] == ",":
                    put["M", word, ""] += 1
                if bare.endswith(".") and not bare.endswith(".."):
                    w = _before(bare[:-1])
                    if w.isdigit():
                        put["D", word, ""] += 1
                    else:
                        put["cap", w, word] += 1
            elif prev.endswith(".") and not prev.endswith("..") and core:
                w = _before(prev[:-1])
                if not w.isdigit():
                    put["num" if core[0].isdigit() else "low" if core[0].islower() or core[0] in ",;:" else "end", w, ""] += 1
            if t.endswith((".,", ".;", ".:")) or (t.endswith(".") and i == len(tokens) - 1 and not t.endswith("..")):
                w = _before(t[:-2] if t[-1] != "." else t[:-1])
                if not w.isdigit():
                    put["end" if t[-1] == "." else "low", w, ""] += 1
            prev = t


def corpus_evidence(df: DataFrame, text: str) -> DataFrame:
    """(kind, a, b, n): the counts of `observe` over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        put: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    observe(t, put)
            if len(put) > 200_000:
                yield rows(put)
                put.clear()
        yield rows(put)

    def rows(put: Counter) -> pa.RecordBatch:
        kinds, a, b = zip(*put) if put else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(put.values(), pa.int64())], ["kind", "a", "b", "n"])

    seen = df.select(F.col(text).alias("text")).where("text is not null").mapInArrow(count, "kind string, a string, b string, n long")
    return seen.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def _tables(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, s, m, d): how words stand (starting, inside, after a number), and (a, against): the abbreviations, tokens whose full stop at least
    once in four times comes before small letters, a pause, a number or a name. What was seen less than 3 times is no evidence."""
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    words = seen.where("kind in ('S', 'M', 'D')").groupBy("a").agg(of("S").alias("s"), of("M").alias("m"), of("D").alias("d"))
    caps = seen.where("kind = 'cap'").select(F.col("a").alias("w"), F.col("b"), "n").join(words.withColumnRenamed("a", "b"), "b", "left")
    caps = caps.select(F.col("w").alias("a"), F.when(F.coalesce(F.col("s") > F.col("m"), F.lit(False)), "end").otherwise("name").alias("kind"), "n")
    tokens = seen.where("kind in ('end', 'low', 'num')").select("a", "kind", "n").unionByName(caps)
    tokens = tokens.groupBy("a").agg((of("low") + of("num") + of("name")).alias("against"), of("end").alias("with"))
    words = words.where(F.col("s") + F.col("m") + F.col("d") >= 3)
    return words, tokens.where((F.col("against") >= 3) & (F.col("against") * 4 >= F.col("against") + F.col("with"))).select("a", "against")


def _own_evidence(docs: DataFrame, words: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """(k, t, words, abbreviations): each text with those entries of the tables that splitting it can ask for, joined by shuffle.

    Entries go to texts by a hash of the text; were two texts to share it, each would get true entries that it doesn't ask for.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asker = Asker()
        for b in batches:
            hs, kinds, tokens = [], [], []
            for h, t in zip(b.column("h").to_pylist(), b.column("t").to_pylist()):
                for is_word, token in asker.asked(t):
                    hs.append(h)
                    kinds.append(is_word)
                    tokens.append(token)
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(kinds, pa.bool_()), pa.array(tokens, pa.string())], ["h", "is_word", "a"])

    none = F.lit(0).cast("long")
    entries = words.select(F.lit(True).alias("is_word"), "a", "s", "m", "d").unionByName(
        abbreviations.select(F.lit(False).alias("is_word"), "a", none.alias("s"), none.alias("m"), none.alias("d"))
    )
    hashed = docs.withColumn("h", F.xxhash64("t"))
    asked = hashed.select("h", "t").mapInArrow(ask, "h long, is_word boolean, a string").distinct()
    found = asked.join(entries.hint("shuffle_merge"), ["is_word", "a"]).groupBy("h").agg(
        F.collect_list(F.when(F.col("is_word"), F.struct("a", "s", "m", "d"))).alias("words"), F.collect_list(F.when(~F.col("is_word"), F.col("a"))).alias("abbreviations")
    )
    return hashed.join(found.hint("shuffle_merge"), "h", "left").select("k", "t", "words", "abbreviations")


class Splitter:
    """Splits one text; what its own unambiguous occurrences tell comes first, then what the corpus tells."""

    def __init__(self, words: dict | None = None, abbreviations: dict | None = None):
        self.words, self.abbreviations = words or {}, abbreviations or {}
        self.shared_words, self.shared_abbreviations = self.words, self.abbreviations

    def joined(self, words, abbreviations) -> None:
        """Adds the entries that were joined to the next text to those that all texts share."""
        more = {r["a"]: (r["s"], r["m"], r["d"]) for r in words} if words is not None else {}
        also = dict.fromkeys(abbreviations, True) if abbreviations is not None else {}
        self.words = ChainMap(more, self.shared_words) if more else self.shared_words
        self.abbreviations = ChainMap(also, self.shared_abbreviations) if also else self.shared_abbreviations

    def split(self, text: str) -> list[tuple[int, int]]:
        self.own: Counter | None = None
        self.stands: dict[str, tuple[int, int]] = {}
        self.text = text
        out: list[tuple[int, int]] = []
        at = 0
        for m in [*LINE_END.finditer(text), None]:
            end = m.start() if m else len(text)
            if end > at:
                out.extend(self._line(text[at:end], at))
            at = m.end() if m else end
        return out

    def _seen(self) -> Counter:
        if self.own is None:
            self.own = Counter()
            observe(self.text, self.own)
        return self.own

    def _starts(self, word: str) -> bool:
        """Whether a capitalized word is one that starts sentences, not a name."""
        own = self._seen()
        s, m = own["S", word, ""], own["M", word, ""]
        if s != m and s + m > 1:
            return s > m
        s, m, _ = self.words.get(word, (0, 0, 0))
        return s > m

    def _abbreviation(self, w: str) -> bool:
        """Whether a token's full stop is part of it: what the document's own unambiguous occurrences tell, else what the corpus or its form does."""
        if not w:
            return False
        goes_on, ends = self._own(w)
        if goes_on:
            return goes_on * 4 >= goes_on + ends
        if ends > 1:
            return False
        if w in self.abbreviations or (len(w) == 1 and w.isalpha()) or DOTTED.fullmatch(w):
            return True
        return "." in w and self._abbreviation(w.rpartition(".")[2])  # of a sentence that follows the last one's stop without a space

    def _own(self, w: str) -> tuple[int, int]:
        """How often the document has the token with a full stop before a small letter or a pause, and at the end of a line."""
        known = self.stands.get(w)
        if known is None:
            text, mark = self.text, w + "."
            goes_on = ends = 0
            at = text.find(mark)
            while at >= 0:
                end = at + len(mark)
                if not at or not text[at - 1].isalnum():
                    nxt = text[end : end + 3]
                    bare = nxt.lstrip(" \xa0")
                    if nxt[:1] in ",;:" and nxt or (len(bare) < len(nxt) and bare[:1].islower()):
                        goes_on += 1
                    elif CLOSES_LINE.match(text, end):
                        ends += 1
                at = text.find(mark, end)
            known = self.stands[w] = goes_on, ends
        return known

    def _line(self, line: str, base: int) -> list[tuple[int, int]]:
        m = LIST_MARK.match(line)
        i = m.end() if m else 0
        cuts: list[int] = []
        for c in [*self._stops(line, i)]:
            cuts.append(c)
        spaces = THAI_SPACE.search(line)
        if spaces:
            hidden = self._hidden(line)
            cuts += [m.start() for m in THAI_SPACE.finditer(line) if self._thai_end(line, m) and not any(a < m.start() < b for a, b in hidden)]
            cuts = sorted(set(cuts))
        out, at = [], 0
        for c in [*cuts, len(line)]:
            piece = line[at:c]
            if s := piece.strip():
                start = base + at + len(piece) - len(piece.lstrip())
                if out and not any(ch.isalnum() for ch in s):
                    out[-1] = (out[-1][0], start + len(s))  # symbols alone go with the sentence before them
                else:
                    out.append((start, start + len(s)))
            at = c
        return out

    def _thai_end(self, line: str, m: re.Match) -> bool:
        """Whether a space between letters of these scripts ends a sentence: not where a linking word or a customary space carries it on."""
        before = line[: m.start()]
        return before.endswith(THAI_CLOSERS) or not (before.endswith(THAI_MARKS) or THAI_LINKS.match(line, m.end()))

    def _hidden(self, line: str) -> list[tuple[int, int]]:
        """Stretches inside quotes and brackets that close in the same line."""
        out, n, done = [], len(line), 0
        for m in OPENING(line):
            i = m.start()
            if i < done or (line[i] in "‘\"" and i and line[i - 1].isalnum()):
                continue
            for c in CLOSING[line[i]](line, i + 1):
                j = c.start()
                if line[j] not in "’‘" or j + 1 == n or not line[j + 1].isalnum():
                    out.append((i, j))
                    done = j + 1
                    break
        return out

    def _stops(self, line: str, first: int) -> Iterator[int]:
        """Ends of sentences inside the line."""
        hidden, h = None, 0
        for m in CANDIDATE.finditer(line, first):
            if hidden is None:
                hidden = self._hidden(line)
            while h < len(hidden) and hidden[h][1] < m.start():
                h += 1
            end = m.end()
            quoted = h < len(hidden) and hidden[h][0] < m.start()
            if quoted and end < hidden[h][1] and line[end : hidden[h][1]].strip():
                continue  # speech goes on
            if quoted:
                end = hidden[h][1] + 1
            while end < len(line) and line[end] in CLOSERS and (line[end] not in "\"'" or end + 1 == len(line) or not line[end + 1].isalnum()):
                end += 1
            k = end
            while k < len(line) and line[k].isspace():
                k += 1
            if k == len(line):
                continue
            if self._ends(line, m, end, k, quoted):
                yield end

    def _ends(self, line: str, m: re.Match, end: int, k: int, quoted: bool) -> bool:
        mark, spaced = m[0], k > end
        nxt = k
        while nxt < len(line) - 1 and line[nxt] in OPENERS:
            nxt += 1
        c = line[nxt]
        if c.islower() or line[k] in ",;:，、；：%)]}”»’」』）":
            return False
        cased = c.isupper()
        if mark[-1] in FULL_STOPS:
            return not quoted or (cased and spaced)
        if quoted and not cased:
            return False
        if mark[-1] in "!?":
            return spaced or cased or not c.isascii()
        if mark[-1] == "…" or len(mark) > 1:
            return spaced and not c.isdigit()
        # a single full stop
        start = m.start()
        while start > 0 and not line[start - 1].isspace():
            start -= 1
        w = _before(line[start : m.start()])
        word = WORD.match(line, nxt)
        return self._full_stop(line, m, start, end, w, word[0] if word else "", c, spaced)

    def _full_stop(self, line: str, m: re.Match, start: int, end: int, w: str, word: str, c: str, spaced: bool) -> bool:
        """Whether a single full stop between a token and a word ends a sentence; the only place that asks the corpus."""
        cased = c.isupper()
        if not spaced:
            if end == m.end() and not cased:
                return False
            # no space after the stop: a small word in front and no address or file name around it
            return cased and len(w) > 1 and (w[-1].islower() or end > m.end()) and not self._abbreviation(w) and not ADDRESS.search(line[start:])
        if DEVANAGARI.search(w) and ("।" in self.text or self._abbreviation(w)):
            return False
        if w.isdigit():
            if c.isdigit():
                return True
            _, _, d = self.words.get(word, (0, 0, 0))
            return not (d >= 3 and not self._starts(word))
        if w and self._abbreviation(w):
            return cased and self._starts(word)
        return True


class Asker(Splitter):
    """Goes through a text as the splitter does and notes what it may ask the corpus for; which stops are ends has no bearing on the others."""

    def asked(self, text: str) -> set[tuple[bool, str]]:
        """(is a word, else an abbreviation; token)"""
        self.noted: set[tuple[bool, str]] = set()
        self.split(text)
        return self.noted

    def _full_stop(self, line: str, m: re.Match, start: int, end: int, w: str, word: str, c: str, spaced: bool) -> bool:
        self.noted |= {(False, w), (True, word)}
        return True


def sentences(df: DataFrame, text: str, key: str, floor: float = 1e-6) -> DataFrame:
    """(key, sent_start, sent_end): one row per sentence, in code points from 0, end exclusive, without white space at the ends.

    The sentences cover all but white space. A line end ends a sentence; list marks and labels go with what they open; quoted speech
    inside a sentence doesn't split it. A space between Thai or Lao letters ends one unless a linking word follows or a customary space stands there. A full stop after an abbreviation or a number ends a sentence only before a word that starts
    sentences elsewhere. Abbreviations, sentence starters and names are told by unambiguous occurrences in the document first, for and against,
    and only where it has none by the corpus: counts over all texts, at least 3 of them at any size. What makes up at least `floor` of all counts, at most 1 / floor
    entries, is broadcast; the rest, if there is any, is joined to the texts that ask for it. Null, empty and blank texts give no rows;
    equal texts count for each key.
    """
    seen = written(corpus_evidence(df, text))
    words, abbreviations = _tables(seen)
    least = (seen.agg(F.sum("n")).first()[0] or 0) * floor
    docs = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null and t != ''")
    often, named = F.col("s") + F.col("m") + F.col("d") >= least, F.col("against") >= least
    shared = df.sparkSession.sparkContext.broadcast(
        ({r.a: (r.s, r.m, r.d) for r in words.where(often).collect()}, {r.a: True for r in abbreviations.where(named).select("a").collect()})
    )
    if least > 3:  # else all is broadcast
        docs = _own_evidence(docs, words.where(~often), abbreviations.where(~named))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(*shared.value)
        for b in batches:
            at, starts, ends = [], [], []
            joined = "words" in b.schema.names
            own = zip(b.column("words").to_pylist(), b.column("abbreviations").to_pylist()) if joined else repeat((None, None))
            for i, (t, (w, a)) in enumerate(zip(b.column("t").to_pylist(), own)):
                if joined:
                    splitter.joined(w, a)
                spans = splitter.split(t)
                at += [i] * len(spans)
                starts += [s for s, _ in spans]
                ends += [e for _, e in spans]
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(at, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], [key, "sent_start", "sent_end"])

    kind = df.schema[key].dataType.simpleString()
    return docs.mapInArrow(run, f"`{key}` {kind}, sent_start long, sent_end long")
