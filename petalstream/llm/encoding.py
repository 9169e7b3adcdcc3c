"""Text decoded with the wrong character encoding: best-first search over encode, decode and unescape operations."""

from __future__ import annotations

import heapq
import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What the bytes from 0x80 of a code page stand for. The Western page keeps the bytes it leaves open as control characters.
PAGES = ("cp1252", "cp1250", "cp1251", "cp1254", "cp1258", "cp437", "cp850", "cp866", "mac_roman", "mac_cyrillic", "koi8_r", "iso8859_5", "iso8859_15")
EAST = ("cp932", "gb18030", "big5", "euc_kr", "euc_jp")
#: TCVN 5712-3, a Vietnamese page that Python has no codec for: letters by their bytes.
TCVN3 = {
    "à": 0xB5, "ả": 0xB6, "ã": 0xB7, "á": 0xB8, "ạ": 0xB9, "ă": 0xA8, "ằ": 0xBB, "ẳ": 0xBC, "ẵ": 0xBD, "ắ": 0xBE, "ặ": 0xC6, "â": 0xA9, "ầ": 0xC7,
    "ẩ": 0xC8, "ẫ": 0xC9, "ấ": 0xCA, "ậ": 0xCB, "đ": 0xAE, "è": 0xCC, "ẻ": 0xCE, "ẽ": 0xCF, "é": 0xD0, "ẹ": 0xD1, "ê": 0xAA, "ề": 0xD2, "ể": 0xD3,
    "ễ": 0xD4, "ế": 0xD5, "ệ": 0xD6, "ì": 0xD7, "ỉ": 0xD8, "ĩ": 0xDC, "í": 0xDD, "ị": 0xDE, "ò": 0xDF, "ỏ": 0xE1, "õ": 0xE2, "ó": 0xE3, "ọ": 0xE4,
    "ô": 0xAB, "ồ": 0xE5, "ổ": 0xE6, "ỗ": 0xE7, "ố": 0xE8, "ộ": 0xE9, "ơ": 0xAC, "ờ": 0xEA, "ở": 0xEB, "ỡ": 0xEC, "ớ": 0xED, "ợ": 0xEE, "ù": 0xEF,
    "ủ": 0xF1, "ũ": 0xF2, "ú": 0xF3, "ụ": 0xF4, "ư": 0xAD, "ừ": 0xF5, "ử": 0xF6, "ữ": 0xF7, "ứ": 0xF8, "ự": 0xF9, "ỳ": 0xFA, "ỷ": 0xFB, "ỹ": 0xFC,
    "ý": 0xFD, "ỵ": 0xFE, "Ă": 0xA1, "Â": 0xA2, "Đ": 0xA7, "Ê": 0xA3, "Ô": 0xA4, "Ơ": 0xA5, "Ư": 0xA6,
}
#: (page the bytes were read as, page they were written in), for pages of one byte a character: the common ones, which win over others of equal gain.
MISTAKEN = (
    ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "tcvn3"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "cp1250"),
    ("cp1252", "cp1258"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("cp1251", "koi8_r"),
    ("cp1251", "cp866"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("iso8859_5", "cp1251"), ("mac_cyrillic", "cp1251"), ("cp1258", "cp1252"), ("cp1250", "cp1258"),
)
#: UTF-8 sequences of two to four bytes, each byte as the character of the same number.
SEQUENCE = re.compile(
    "[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)
LOST = re.compile("[�\x80-\x84\x86-\x9f]")
ESCAPE = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#\d{2,7}|#[xX][0-9A-Fa-f]{2,6});|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}")
BETWEEN = re.compile("([ \n\t\r])")
BUCKETS = 1 << 20
#: Marks that stand in sound texts of all languages: alone they tell nothing of the page.
COMMON_MARKS = frozenset("…“”‘’–—„«»•‹›")
#: A change of script between two letters costs as much as this many times a doubled surprise (nats).
MIXED = 20.0


def script(ch: str) -> int:
    c = ord(ch)
    if c < 0x250 or 0x1E00 <= c < 0x1F00:
        return 1
    if 0x370 <= c < 0x400:
        return 2
    if 0x400 <= c < 0x530:
        return 3
    if 0x2E80 <= c < 0xA000 or 0xF900 <= c < 0xFB00 or 0xFF66 <= c < 0xFFA0:
        return 4
    return 5 + (c >> 7)



def _page(name: str) -> dict[str, int]:
    """Character to byte, for the bytes from 0x80."""
    if name == "tcvn3":
        return TCVN3
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if name == "cp1252":  # and what is read as ISO 8859-1
        out |= {chr(b): b for b in range(0x80, 0xA0)}
    return out


def unescape(text: str) -> str:
    """One layer of escapes undone; two escaped halves of a character beyond 16 bits become one."""
    new = ESCAPE.sub(lambda m: html.unescape(m[0]) if m[0][0] == "&" else chr(int(m[0][2:], 16)), text)
    return new if new.isascii() else new.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def layers(text: str) -> list[str]:
    """The text and what it becomes as its layers of escapes are undone, one after the other."""
    out = [text]
    while ESCAPE.search(out[-1]) and (new := unescape(out[-1])) != out[-1]:
        out.append(new)
    return out


# ---- plausibility: the corpus' own character trigrams


def _hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((a * 0x9E3779B1) ^ (b * 0x85EBCA6B) ^ (c * 0xC2B2AE35)) % 0x7FFFFFFF % BUCKETS


def _codes(text: str) -> np.ndarray:
    """Code points; white space is one space, digits are '0'."""
    x = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    x[(x >= 48) & (x <= 57)] = 48
    x[(x == 10) | (x == 13) | (x == 9)] = 32
    return x


def trigram_counts(df: DataFrame, fields: Sequence[str]) -> np.ndarray:
    """How often each trigram with a character beyond ASCII occurs in the fields, over all rows, in a table of a fixed number of buckets.

    Each task counts for itself; a row per part of the table is merged, so what is shuffled and collected doesn't grow with the data.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for column in b.columns:
                for lo in range(0, b.num_rows, 2000):
                    x = _codes(" " + " ".join(t for t in column.slice(lo, 2000).to_pylist() if t) + " ")
                    odd = x > 127
                    at = np.flatnonzero(odd[:-2] | odd[1:-1] | odd[2:])
                    total += np.bincount(_hash(x[at], x[at + 1], x[at + 2]), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    found = df.select(*fields).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


class Searcher:
    """Looks for the cheapest text reachable from a segment (a stretch without white space)."""

    def __init__(self, counts: np.ndarray, least: float = 8.0, least_pages: float = 9.0, common: float = 2e-5, budget: int = 2048):
        self.total = max(1, int(counts.sum()))
        self.price = (math.log(self.total + 1) - np.log(counts + 0.3)).tolist()
        self.common = math.log(self.total + 1) - math.log(max(3.0, self.total * common))
        self.least, self.least_pages, self.budget = least, least_pages, budget
        self.exhausted = False  # whether a search since the last look met the budget
        pages = {name: _page(name) for name in {*PAGES, "tcvn3"}}
        # to characters numbered as the bytes; other characters from 0x80 move out of the way
        self.to_bytes = {}
        for name in PAGES:
            moved = {c: 0x10F000 + c for c in range(0x80, 0x100)}
            self.to_bytes[name] = moved | {ord(ch): b for ch, b in pages[name].items()}
        sides = {}
        for name in PAGES:
            first = "".join(re.escape(ch) for ch, b in pages[name].items() if 0xC2 <= b <= 0xF4)
            next_ = "".join(re.escape(ch) for ch, b in pages[name].items() if b < 0xC0)
            sides[name] = f"[{first}][{next_}]"
        self.may = {name: re.compile(x).search for name, x in sides.items()}
        self.may_any = re.compile("|".join(sides.values())).search
        self.west = pages["cp1252"]
        self.exchanges: dict[str, list] = {}
        self.change: dict[tuple[str, str], tuple[frozenset, dict]] = {}
        every = [(read, written) for read in PAGES for written in (*PAGES, "tcvn3") if read != written]
        for read, written in sorted(every, key=lambda x: x not in MISTAKEN):
            back = {b: ch for ch, b in sorted(pages[written].items())}  # a page's own characters before control characters
            change = {ord(ch): back[b] for ch, b in pages[read].items() if b in back}
            self.change[read, written] = frozenset(map(chr, change)), change
            self.exchanges.setdefault(read, []).append((read, written))
        self.held = {read: frozenset(pages[read]) for read in PAGES}
        self.paths: dict[tuple, tuple] = {}
        self.known: dict[str, tuple | None] = {}

    def cost(self, text: str) -> tuple[float, int, float]:
        """Sum over the trigrams with a character beyond ASCII, their number, and the price of the rarest."""
        total, n, worst, price = 0.0, 0, 0.0, self.price
        a, b, before = 32, 32, 0
        for ch in text + " ":
            c = ord(ch)
            if 48 <= c <= 57:
                c = 48
            if c > 64 and ch.isalpha():
                now = 1 if c < 0x250 else script(ch)
                if before and now != before:
                    total += MIXED
                before = now
            elif c < 0x300 or c > 0x36F:
                before = 0
            if a > 127 or b > 127 or c > 127:
                p = price[((a * 0x9E3779B1) ^ (b * 0x85EBCA6B) ^ (c * 0xC2B2AE35)) % 0x7FFFFFFF % BUCKETS]
                total += p
                n += 1
                if p > worst:
                    worst = p
            a, b = b, c
        return total, n, worst

    def steps(self, text: str) -> Iterator[tuple[tuple[str, ...], str]]:
        """(operation, text) one operation away: UTF-8 read as some page, UTF-8 read as a page of two bytes, and escapes."""
        for name in PAGES if self.may_any(text) else ():
            if self.may[name](text) and (new := self.operate(("utf-8", name), text)) is not None:
                yield ("utf-8", name), new
        operations = [("utf-8", name) for name in EAST] if any(ch > "⺀" for ch in text) else []
        if sum(ch > "\x7f" for ch in text) > 2 and all(ch < "\x80" or ch in self.west for ch in text):
            operations += [(name, "cp1252") for name in EAST]
        if ESCAPE.search(text):
            operations.append(("unescape",))
        for op in operations:
            if (new := self.operate(op, text)) is not None:
                yield op, new

    def operate(self, op: tuple[str, ...], text: str) -> str | None:
        """A text with one operation undone: (encoding it was written in, page it was read as), or escapes; None if that can't be."""
        if len(op) == 1:
            return unescape(text)
        written, read = op
        try:
            if read in EAST:
                return text.encode(read).decode()
            if written in EAST:
                return bytes(self.west.get(ch) or ord(ch) for ch in text).decode(written)
        except (UnicodeError, ValueError):
            return None
        if written != "utf-8":
            return text.translate(self.change[read, written][1])
        moved = text.translate(self.to_bytes[read])
        parts, at = [], 0
        for m in SEQUENCE.finditer(moved):
            parts += [text[at : m.start()], m[0].encode("latin-1").decode()]
            at = m.end()
        return "".join(parts) + text[at:] if parts else None

    def exchanged(self, text: str, cost: tuple[float, int, float]) -> Iterator[tuple[tuple[str, str], str, float]]:
        """(operation, text, cost): what rare text becomes by each exchange of two pages of one byte that hold all of it."""
        odd = {ch for ch in text if ch > "\x7f"}
        if cost[2] <= self.common or not odd or odd <= COMMON_MARKS:
            return
        costs: dict[str, float] = {}
        for read, pairs in self.exchanges.items():
            if not odd <= self.held[read]:
                continue
            for pair in pairs:
                repertoire, change = self.change[pair]
                if odd <= repertoire:
                    new = text.translate(change)
                    c = costs.get(new)
                    if c is None:
                        c = costs[new] = self.cost(new)[0] if new.lower() != text.lower() else math.inf
                    if c < math.inf:
                        yield (pair[1], read), new, c

    def doubt(self, path: tuple) -> float:
        """What a path must gain beyond a common exchange: the more paths there are of its kind, the more likely one of them fits by chance."""
        if len(path) == 1 and (path[0][1], path[0][0]) in MISTAKEN:
            return 0.0
        return sum(self.least if op[0] == "utf-8" or op[0] in EAST or len(op) == 1 else math.log(len(self.change)) for op in path)

    def follow(self, path: tuple, text: str) -> tuple[str, bool]:
        """What a text becomes by a path, as far as its operations apply, and whether its exchanges hold all characters."""
        whole = True
        for op in path:
            if len(op) == 2 and op[0] != "utf-8" and op[0] not in EAST:
                whole = whole and {ch for ch in text if ch > "\x7f"} <= self.change[op[1], op[0]][0]
            new = self.operate(op, text)
            text = text if new is None else new
        return text, whole

    def search(self, segment: str) -> tuple[str | None, str | None, list[tuple[tuple, float]], tuple]:
        """(surely meant text, likely meant text, [(path, gain)], path of the surely meant text): what can be made of a segment by UTF-8 repairs, and by paths with an exchange of pages.

        Best first: the cheapest open text is expanded next; texts already seen (by hash) are not opened again. A text dearer than the segment
        may lead to a cheaper one, so only a budget of texts ends the search early, which sets `exhausted`. Escapes have no price: the start is
        the price without them, and all of their layers are opened. Shorter alone is no gain: of the texts reached without an exchange, that of the most common trigrams on average is taken, which must not be rarer than the old ones,
        and in a sure case more common. Exchanges start from every text reached that is not dearer than the start, and what they lead to is expanded in turn as long as it
        becomes cheaper than the start: any text can be exchanged into many, of which some fit by chance a few dear steps on.
        """
        forms = layers(segment)
        start, n, worst = self.cost(forms[-1])
        # escapes alone are no wrong encoding
        heap = [(self.cost(x)[0], x, (("unescape",),) * i) for i, x in enumerate(forms)]
        visited = {*map(hash, forms)}
        heapq.heapify(heap)
        sure = likely = None
        sure_path: tuple = ()
        mean = start / max(1, n) + 1
        reached, pages = [], []

        def expand(text: str, path: tuple, taken: set[int]) -> Iterator[tuple[str, tuple, float, int]]:
            for op, new in self.steps(text):
                if hash(new) in taken:
                    continue
                taken.add(hash(new))
                if any(unicodedata.category(ch) in ("Co", "Cn") for ch in new if ch > "\xff"):
                    continue
                c, k, _ = self.cost(new)
                yield new, (*path, op), c, k

        left = self.budget
        while heap and left:
            left -= 1
            _, text, path = heapq.heappop(heap)
            reached.append((text, path))
            for new, way, c, k in expand(text, path, visited):
                heapq.heappush(heap, (c, new, way))
                if start - c > self.least and c / max(1, k) <= mean:
                    mean, likely, sure_path = c / max(1, k), new, way
                    sure = new if mean <= start / max(1, n) - 1 else None
        while reached and sure is None and left:
            text, path = reached.pop()
            cost = self.cost(text)
            if text in forms[:-1] or cost[0] > start:
                continue
            for op, new, c in self.exchanged(text, cost):
                way = (*path, op)
                if c < min(cost[0], start):
                    pages.append((self.paths.setdefault(way, way), min(cost[0], start) - c))
                open_, taken = [(new, way)], {*visited, hash(new)}
                while open_ and left:
                    left -= 1
                    for after, on, x, k in expand(*open_.pop(), taken):
                        if x >= start:
                            continue
                        if x / max(1, k) <= start / max(1, n) - 1:
                            pages.append((self.paths.setdefault(on, on), k * start / max(1, n) - x))  # shorter alone is no gain here either
                        open_.append((after, on))
        self.exhausted |= not left
        return sure, likely, pages, self.paths.setdefault(sure_path, sure_path) if sure is not None else ()

    def judge(self, value: str) -> str | None:
        """The restored text if the value is garbled, in whole or in part, else None. What cannot be restored stays as it is."""
        now, seen = value, {value}
        while (new := self.mend(now)) is not None and new not in seen:
            seen.add(new)
            now = new
        return now if now != value or LOST.search(value) else None

    def mend(self, value: str) -> str | None:
        """The value with the operations undone that its segments, or all of them together, bear out at once, or None."""
        pieces = BETWEEN.split(value)
        segments = pieces[::2]
        found: dict[str, str] = {}
        likely: dict[str, str] = {}
        others: list[str] = []
        sums: dict[tuple, float] = {}
        ways: Counter = Counter()
        known = self.known
        quoted = "“" in value
        for s in segments:
            if s.isascii() and "&" not in s and "\\" not in s:
                continue
            if quoted and s[-1:] == "”":
                s = s[:-1]  # the mark is a byte of common pages too, but here it closes what “ opens
            try:
                r = known[s]
            except KeyError:
                if len(known) > 300_000:
                    known.clear()
                r = self.search(s)
                r = known[s] = r if any(r[:3]) else None
            if r is None:
                others.append(s)
                continue
            if r[0] is not None:
                found[s] = r[0]
                ways[r[3]] += 1
                continue
            if r[1] is not None:
                likely[s] = r[1]
            others.append(s)
            for name, gain in r[2]:
                sums[name] = sums.get(name, 0.0) + gain
        if found:
            found = likely | found
            way = max(ways, key=lambda x: (ways[x], -len(x)))
            for s in {*others} - found.keys():  # what bytes were lost from doesn't become common, but goes the way of the others
                new, _ = self.follow(way, s)
                if new != s and self.cost(new)[0] < self.cost(layers(s)[-1])[0]:
                    found[s] = new
        sums = {path: total - self.doubt(path) for path, total in sums.items()}
        for path in sorted(sums, key=sums.__getitem__, reverse=True):
            if sums[path] < self.least_pages:
                break
            made = {s: self.follow(path, s) for s in {*others} - found.keys()}
            gains = {s: self.cost(layers(s)[-1])[0] - self.cost(new)[0] for s, (new, _) in made.items()}
            # what the exchange would spoil speaks against it, unless a long stretch speaks for it
            net = sum(g for s, g in gains.items() if g > 0 or made[s][1])
            if net > 0 or sums[path] >= 5 * self.least_pages:
                found |= {s: made[s][0] for s, g in gains.items() if g > 0}
                break
        if not found:
            return None
        for i in range(0, len(pieces), 2):
            s = pieces[i]
            if quoted and s[-1:] == "”" and s not in found:
                pieces[i] = found.get(s[:-1], s[:-1]) + "”"
            else:
                pieces[i] = found.get(s, s)
        return "".join(pieces)


def garbled(df: DataFrame, fields: Sequence[str], key: str) -> DataFrame:
    """(key, field, text, restored): one row for each garbled value, with the text as far as it can be restored.

    A value is garbled if a stretch of it becomes cheaper, by its character trigrams in the whole corpus, once the encoding mistakes are
    undone: UTF-8 read as a one-byte or East Asian page, several times over or with escapes in between, or any one-byte page read as any other,
    before or after that (which the value's segments must bear out together). Replacement and C1 control characters are garbled in any case. Null, empty and ASCII values
    are never garbled. Only a table of fixed size is broadcast. Rows keep their number, equal keys included.
    """
    counts = trigram_counts(df, fields)
    shared = df.sparkSession.sparkContext.broadcast(counts.astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(shared.value)
        for b in batches:
            keys = b.column(0).to_pylist()
            for f in fields:
                rows = []
                for k, t in zip(keys, b.column(f).to_pylist()):
                    if t and not (t.isascii() and "&" not in t and "\\" not in t):
                        r = searcher.judge(t)
                        if r is not None:
                            rows.append((k, f, t, r))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], [key, "field", "text", "restored"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *fields).mapInArrow(run, f"`{key}` {kind}, field string, text string, restored string")


def restore(df: DataFrame, fields: Sequence[str], key: str) -> DataFrame:
    """The table with garbled values of the fields restored in place; needs a unique key. Other values and columns stay as they are."""
    fixed = garbled(df, fields, key).groupBy(key).agg(*[F.max(F.when(F.col("field") == f, F.col("restored"))).alias(f"__{f}") for f in fields])
    out = df.join(fixed, key, "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in df.columns])
