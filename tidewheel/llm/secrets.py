"""Secrets in texts: fixed patterns, and values that would be hard to guess.

Three patterns give the base spans. Beside them, every value in credential
context (a word for a password, a sign of assignment, a value) is priced by the
least number of guesses that builds it: a dynamic programme over all cuts into
words, dates, repeats, keyboard walks, sequences and brute-force spans takes
the cheapest sum of log10 costs. A quoted value ends at its quote, on its line;
any other at white space, less punctuation that closes it (. , ; : > and
brackets). Words, dates and the units that repeats repeat have at most SHORT
letters; a longer unit is priced by its parts each time, which is dearer, so
no secret is lost by it. A value of 10^COST guesses or more is a span
of kind guess, of the whole value, whether or not base spans overlap it;
redaction cuts the union.

Words are ranked: some usual in passwords and in prose about them, then the
at most DICTIONARY words that most documents hold. What follows a sign of assignment
is left out of that count, so that a secret that many copies repeat is no word. The dictionary is the only thing that comes to the driver.

Spans count code points, ends exclusive; the span of an assignment is the
whole match. Kinds at one start come in the order of KINDS.

Cases: null and empty texts have no spans; repeated rows and null ids are
kept; very long texts are scanned whole, and values of any length are priced
whole (costs below COST are exact, others count as infinite); an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import keep_nothing, kept, release, remove, text_of, written, written_at

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CLOSING = r"""\s.,;:>)\]}"'"""
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|code|phrase)?|pwd|secret|token|credential|api[_-]?key|access[_-]?key|auth[_-]?key)["']?\s*+(?:=>|:=|[:=])\s*+"""
    rf"""["']?((?<=")[^"\n]+(?=")|(?<=')[^'\n]+(?=')|[^\s"'](?:\S*[^{CLOSING}])?)""",
    re.I | re.A,
)
#: log10 of guesses from which a value counts as a secret.
COST = 9.0
LEAST_ASSIGN = 12
#: Bound on the words of a corpus that are ranked, the documents that a word needs, and its letters.
DICTIONARY, LEAST_DOCUMENTS, LETTERS = 1 << 16, 3, (3, 20)
#: What is assigned, whatever to, and words; and the number of them that a task holds before it hands counts on.
WORD_OR_VALUE, HELD_WORDS = re.compile(r"""[:=]\s*+(?:"[^"\n]+"|'[^'\n]+'|\S+)|([^\W\d_]{3,})"""), 200_000

# Common parts of passwords, the most usual first, and words that follow a word for a password in prose.
WORDS = (
    "password pass secret admin login welcome qwerty dragon master monkey letmein hello shadow sunshine princess football baseball "
    "iloveyou trustno superman batman michael jordan jennifer hunter ranger soccer hockey killer pepper summer winter spring autumn "
    "love test user root guest changeme default access token key example demo temp sample value none null true false string your here "
    "company office house happy flower freedom cookie cheese orange purple yellow silver golden diamond computer internet google server "
    "database system service the and for you this that "
    "required optional mandatory invalid valid expired missing empty unknown hidden public private identifier parameter generator generated "
    "number field string text type format length name change reset forgot forgotten create update delete refresh bearer based authentication "
    "authorization expires renewal provider manager store storage settings please contact never always"
).split()
LEET = str.maketrans("0134578@$!", "oieastbasi")
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
NEAR = {frozenset((a, b)) for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {
    frozenset((a, b)) for up, down in zip(ROWS, ROWS[1:], strict=False) for i, b in enumerate(down) for a in up[i : i + 2]
}
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")


def _alphabet(part: str) -> int:
    sizes = ((10, str.isdigit), (26, str.islower), (26, str.isupper))
    size = sum(n for n, test in sizes if any(test(c) for c in part))
    return size + 33 * any(not c.isalnum() for c in part) or 26


ROWS_OF = {c: i for i, row in enumerate(ROWS) for c in row}


#: Spans up to this length are priced one by one; words and dates are no longer.
SHORT = max(LETTERS[1], *map(len, WORDS))


def _reach(s: int, n: int, fits: Callable[[int], bool]) -> int:
    """The end of the run from s on in which each character fits to the one before."""
    e = s + 1
    while e < n and fits(e):
        e += 1
    return e


class _Runs:
    """Walks, sequences and repeats of more than SHORT characters in a value.

    A run is found once and expanded from its first start. A later start within
    it is expanded only where it is not dearer for all ends, which is rare, so
    the work is in proportion to the value.
    """

    def __init__(self, value: str, unit_guesses: Callable[[str], float]) -> None:
        self.value, self.n, self.unit_guesses = value, len(value), unit_guesses
        self.low = [low if len(low := c.lower()) == 1 else c for c in value]
        self.walk = self.steps = (0, 0, math.inf)  # end of the run, the start it was expanded from, the cost there
        self.turns: list[int] = []
        self.from_turn = 0
        self.periods: dict[int, int] = {}
        self.repeats: dict[tuple[int, int], tuple[int, int, float]] = {}

    def walks(self, s: int, more: float) -> Iterator[tuple[int, float]]:
        low, (end, anchor, least) = self.low, self.walk
        if s >= end - 1:
            end = _reach(s, self.n, lambda e: low[e] == low[e - 1] or frozenset((low[e - 1], low[e])) in NEAR)
            anchor, least, self.from_turn, self.turns = s, math.inf, s, [0]
            for a, c in zip(low[s : end - 2], low[s + 2 : end], strict=False):
                self.turns.append(self.turns[-1] + (frozenset((a, c)) not in NEAR and a != c and ROWS_OF.get(a) != ROWS_OF.get(c)))
            self.walk = end, s, math.inf
        if end - s <= SHORT:
            return
        before = self.turns[s - self.from_turn]
        if more >= least + math.log10((s - anchor + SHORT + 1) / (SHORT + 1)) + math.log10(4) * (before - self.turns[anchor - self.from_turn]):
            return
        self.walk = end, s, more
        for e in range(s + SHORT + 1, end + 1):
            yield e, more + math.log10(47 * (e - s)) + math.log10(4) * (1 + self.turns[e - 2 - self.from_turn] - before)

    def sequences(self, s: int, more: float) -> Iterator[tuple[int, float]]:
        low, (end, anchor, least) = self.low, self.steps
        if s >= end - 1:
            step = ord(low[s + 1]) - ord(low[s]) if s + 1 < self.n else 9
            end = s + 1
            if abs(step) <= 2 and self.value[s].isalnum():
                end = _reach(s, self.n, lambda e: ord(low[e]) - ord(low[e - 1]) == step and self.value[e].isalnum())
            anchor, least = s, math.inf
            self.steps = end, s, math.inf
        if end - s <= SHORT or more >= least + math.log10((s - anchor + SHORT + 1) / (SHORT + 1)) + 1:  # alphabets differ by less than ten times
            return
        self.steps = end, s, more
        seen: dict[str, None] = {}
        size, kinds = 0, set()
        for e in range(s, end):
            c = self.value[e]
            kind = (c.isdigit(), c.islower(), c.isupper())
            if kind not in kinds:
                kinds.add(kind)
                seen[c] = None
                size = _alphabet("".join(seen))
            if e + 1 - s > SHORT:
                yield e + 1, more + math.log10(size * (e + 1 - s) * 2)

    def _units(self, s: int) -> Iterator[tuple[int, int]]:
        """Units of at most SHORT characters that are no repeats themselves and stand at s twice or more, as (length, end of the repeats).

        While one of length p reaches to e, no other one is of e - s - p characters or fewer.
        """
        value, n, p = self.value, self.n, 1
        while p <= SHORT and s + 2 * p <= n:
            end = self.periods.get(p, 0)
            if s + 2 * p > end and value.startswith(value[s : s + p], s + p):
                end = self.periods[p] = _reach(s + 2 * p - 1, n, lambda e, p=p: value[e] == value[e - p])
            elif s + 2 * p > end:
                p += 1
                continue
            yield p, end
            p = max(p + 1, end - s - p + 1)

    def repeated(self, s: int, more: float) -> Iterator[tuple[int, float]]:
        for p, end in self._units(s):
            least_times = max(2, SHORT // p + 1)
            if s + least_times * p > end:
                continue
            ran, anchor, least = self.repeats.get((p, s % p), (0, 0, math.inf))
            if ran == end and more >= least + math.log10(((s - anchor) / p + least_times) / least_times):
                continue
            self.repeats[p, s % p] = end, s, more
            unit = more + self.unit_guesses(self.value[s : s + p])
            if unit < COST:
                for times in range(least_times, (end - s) // p + 1):
                    yield s + times * p, unit + math.log10(times)


class Prices:
    """Costs of values, with the words in the order of their ranks."""

    def __init__(self, words: Sequence[str] = ()) -> None:
        self.rank = {w: i for i, w in enumerate(dict.fromkeys([*WORDS, *words]), 1)}
        self.short: dict[str, float] = {}
        self.units: dict[str, float] = {}

    def span(self, part: str) -> float:
        """The least log10 of guesses for the part as one span, brute force apart."""
        low, best, n = part.lower(), math.inf, len(part)
        for word in {low, low.translate(LEET)}:
            if word in self.rank:
                case = sum(c.isupper() for c in part)
                extra = 0 if not case else 1 if case == n or case == 1 and part[0].isupper() else math.comb(n, case)
                best = min(best, math.log10(self.rank[word] * (1 + extra) * (1 + (word != low))))
        if n >= 4 and DATE.fullmatch(part):
            best = min(best, math.log10(150 * (1 if n == 4 else 366 * (1 + (not part.isdigit())))))
        if n >= 3:
            pairs = list(zip(low, low[1:], strict=False))
            if all(a == b or frozenset((a, b)) in NEAR for a, b in pairs):
                turns = 1 + sum(frozenset((a, c)) not in NEAR and a != c and ROWS_OF.get(a) != ROWS_OF.get(c) for a, c in zip(low, low[2:], strict=False))
                best = min(best, math.log10(47 * n * 4**turns))
            steps = {ord(b) - ord(a) for a, b in pairs}
            if len(steps) == 1 and abs(next(iter(steps))) <= 2 and part.isalnum():
                best = min(best, math.log10(_alphabet(part) * n * 2))
        for unit in range(1, min(n // 2, SHORT) + 1):
            if n % unit == 0 and part[:unit] * (n // unit) == part:
                best = min(best, self.guesses(part[:unit]) + math.log10(n // unit))
                break
        return best

    def _kept(self, memory: dict[str, float], part: str, cost: Callable[[str], float]) -> float:
        if part not in memory:
            if len(memory) >= 1 << 16:
                memory.clear()
            memory[part] = cost(part)
        return memory[part]

    def short_cost(self, part: str) -> float:
        return self._kept(self.short, part, lambda p: min(self.span(p), len(p) * math.log10(_alphabet(p))))

    def unit_guesses(self, unit: str) -> float:
        return self._kept(self.units, unit, self.guesses) if len(unit) <= SHORT else self.guesses(unit)

    def guesses(self, value: str) -> float:
        """log10 of the guesses of the cheapest cut of value into spans, or infinity from COST on; each further span doubles them."""
        n, last, runs = len(value), 0, _Runs(value, self.unit_guesses)
        best = [0.0] + [math.inf] * n
        for start in range(n):
            if start > last:  # no cut below COST comes this far
                return math.inf
            more = best[start] + (math.log10(2) if start else 0)
            if more >= COST:
                continue
            for end in range(start + 1, min(start + SHORT, n) + 1):
                cost = more + self.short_cost(value[start:end])
                if cost < COST:
                    best[end], last = min(best[end], cost), max(last, end)
            for family in (runs.walks, runs.sequences, runs.repeated):
                for end, cost in family(start, more):
                    if cost >= COST:
                        break
                    best[end], last = min(best[end], cost), max(last, end)
        return best[n]


def values(text: str) -> list[tuple[int, int]]:
    """Where the values in credential context stand."""
    return [m.span(1) for m in CONTEXT.finditer(text)]


def priced(text: str, prices: Prices) -> list[tuple[int, int, float]]:
    """Each value in credential context as (start, end, log10 of guesses)."""
    return [(a, b, prices.guesses(text[a:b])) for a, b in values(text)]


Span = tuple[str, int, int]


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def dear(prized: list[tuple[int, int, float]]) -> list[Span]:
    return [("guess", a, b) for a, b, cost in prized if cost >= COST]


def scan(text: str, prized: list[tuple[int, int, float]]) -> list[Span]:
    """All spans as (kind, start, end), by start and then kind; prized are the text's priced values."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return ordered(found + dear(prized))


def _split(spans: str) -> list[Span]:
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


COLUMNS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, priced string"
#: What one read of the texts gives: a row per document (its base spans and values in context), and rows of words with counts.
GATHERED = "word string, n long, doc_id long, base string, starts array<long>, found array<string>"
GATHERED_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]


def _counted(words: dict[str, int]) -> pa.RecordBatch:
    """Rows of words that may be ranked; the counts are cleared."""
    ranked = [w for w in words if LETTERS[0] <= len(w) <= LETTERS[1]]
    rows: list[list[object]] = [ranked, [words[w] for w in ranked], *[[None] * len(ranked)] * 4]
    words.clear()
    return _gathered_batch(rows)


def _gathered_batch(columns: Sequence[list[object]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, GATHERED_TYPES, strict=True)], [c.split()[0] for c in GATHERED.split(", ")])


def _gather(batches: Iterator[pa.RecordBatch], spans: bool) -> Iterator[pa.RecordBatch]:
    """Words and the documents that hold them, counted in parts of bounded size, and if spans are asked for what each document has."""
    keep_nothing()
    counts: Counter[str] = Counter()
    for batch in batches:
        ids, bases, starts, found = [], [], [], []
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py()
            counts.update(set(WORD_OR_VALUE.findall(text.lower())))
            if spans:
                where = values(text)
                ids.append(doc_id.as_py())
                bases.append(_joined(scan(text, [])))
                starts.append([a for a, _ in where])
                found.append([text[a:b] for a, b in where])
            if len(counts) >= HELD_WORDS:
                yield _counted(counts)
        if ids:
            yield _gathered_batch([[None] * len(ids), [None] * len(ids), ids, bases, starts, found])
    yield _counted(counts)
    release()


def _gathered(docs: DataFrame, spans: bool) -> DataFrame:
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(lambda batches: _gather(batches, spans), GATHERED)


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The words of letters that most documents hold, by falling number of documents and then by the word.

    Words of like numbers (to a 64th of a doubling) are taken together, as many
    such levels from the top as have at most size words in all. Only the
    levels' sizes, some hundreds, and these words come to the driver.
    """
    return _ranked(_gathered(docs, spans=False), size)


def _ranked(gathered: DataFrame, size: int = DICTIONARY) -> list[str]:
    counts = gathered.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n"))
    level = F.floor(F.log2("n") * 64).cast("int").alias("level")
    counts, path = written_at(counts.where(F.col("n") >= LEAST_DOCUMENTS).select("word", "n", level), "secrets-words")
    room, least = size, None
    for r in counts.groupBy("level").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect():
        room -= r["words"]
        if room < 0:
            break
        least = r["level"]
    found = counts.where(F.col("level") >= F.lit(least)).collect() if least is not None else []
    remove(gathered.sparkSession, path)
    return [r["word"] for r in sorted(found, key=lambda r: (-r["n"], r["word"]))]


def _prices(words: list[str]) -> Prices:
    return kept(("secrets", len(words), hash(tuple(words))), lambda: Prices(words))


def _price(batches: Iterator[pa.RecordBatch], words: list[str]) -> Iterator[pa.RecordBatch]:
    """From base spans and values to all spans, with the costs of the values."""
    prices = _prices(words)
    for batch in batches:
        ids, bases, starts, found = (c.to_pylist() for c in batch.columns)
        costs = [[(a, a + len(v), prices.guesses(v)) for a, v in zip(s, f, strict=True)] for s, f in zip(starts, found, strict=True)]
        rows = [ordered(_split(base) + dear(cost)) for base, cost in zip(bases, costs, strict=True)]
        counts = {k: pa.array([sum(s[0] == k for s in r) for r in rows], type=pa.int64()) for k in KINDS}
        arrays = [
            pa.array(ids, type=pa.int64()),
            *(counts[k] for k in KINDS[:3]),
            pa.array([hashlib.sha256(base.encode()).hexdigest() for base in bases], type=pa.string()),
            pa.array([_joined(r) for r in rows], type=pa.string()),
            counts["guess"],
            pa.array([",".join(f"{a}:{b}:{cost:.2f}" for a, b, cost in v) for v in costs], type=pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in COLUMNS.split(", ")])


def find(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Per row of docs: doc_id, counts by kind, the digest of the base spans, all spans, and each priced value as start:end:cost.

    words are the ranked ones of a corpus, docs' own unless given. The texts
    are read once: base spans, values and words are written, and values are
    priced from there, for prices need the words of all documents.
    """
    gathered = written(_gathered(docs, spans=True), "secrets-gathered")
    words = _ranked(gathered) if words is None else words
    rows = gathered.where(F.col("word").isNull()).select("doc_id", "base", "starts", "found")
    return rows.mapInArrow(lambda batches: _price(batches, words), COLUMNS)


def redact(text: str, prices: Prices, mark: str = "[secret]") -> str:
    """The text with its secrets replaced; of an assignment only the value goes."""
    cuts = []
    for kind, a, b in scan(text, priced(text, prices)):
        if kind == "assign":
            a = b - len(ASSIGN.match(text, a)[2])
        cuts.append((a, b))
    out, at = [], 0
    for a, b in sorted(cuts):
        if b > at:
            out += [text[at : max(a, at)], mark] if a >= at else []
            at = b
    return "".join(out) + text[at:] if cuts else text


def redacted(text: Column, words: list[str]) -> Column:
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        prices = _prices(words)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else redact(t, prices))
        release()

    return F.pandas_udf(each, "string")(text)


def redact_all(docs: DataFrame) -> DataFrame:
    """docs with secrets replaced in text and n_chars counted anew; null texts stay null. Words are ranked in docs."""
    out = docs.withColumn("text", redacted(docs["text"].cast("string"), dictionary(docs)))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out
