"""Periodic runs of words, found online by catchers over power-of-two blocks.

A run is a longest stretch of words with smallest period q (words q apart are
equal) that is at least `exponent` periods and `least` words long. Words are
appended in chunks of any size. For every level k the aligned blocks of 2**k
words that are complete are catchers: they stand for the periods q of which the
first exponent - 1 repeats always hold such a block. Each appended word ends one
suffix of 2**k words per level, which is compared with the caught block that
lies a period of the level before it (for four periods there is at most one).
Blocks and suffixes are named by hashes built from two halves, so all suffixes
of a chunk are compared at once; a hit is checked word by word.

A hit is a square in the making: its stretch is followed back to its start and
forward as far as words have come, and stays open while it reaches the last
word. Hits inside a stretch whose period divides theirs are part of it, so
repeats of a run merge into it and cost nothing. Each level looks at every word
once: n words cost n log n.

Results: one row per input row. Null and empty texts have no words and no run.
Null and repeated ids stay rows of their own, equal texts have equal runs. A text
may be one run. Ties cannot occur: start and period name a run. An empty table
gives no rows. Columns other than id and text are not read; in `collapsed` they
are kept and the text is replaced.

A task holds one piece of its rows (4 MB of text, or one longer text) as numbers.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from titleloom.functions.text import once
from titleloom.llm.common import batch, documents, pieces_of, query

EXPONENT, LEAST = 4, 6
U64 = np.uint64
_LEFT, _RIGHT = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)


class Catcher:
    """Runs of a growing sequence of numbers; no run is longer than `longest`."""

    def __init__(self, exponent: int = EXPONENT, least: int = LEAST, longest: int | None = None):
        if exponent < 2:
            raise ValueError("a run has at least two periods")
        self.exponent, self.least, self.longest = exponent, least, longest
        self.n, self.words = 0, np.zeros(1024, np.int64)
        self.names: list[tuple[int, np.ndarray]] = []  # by level: first position held, names of the blocks from there
        self.seen: dict[int, tuple[list[int], list[int]]] = {}  # by period: starts and ends, ascending
        self.open: set[int] = set()  # periods whose last stretch reaches the last word

    def periods(self, level: int) -> tuple[int, int]:
        """Smallest and largest period whose first exponent - 1 repeats hold a block of this level and of none above."""
        first = lambda k: -(-((2 << k) - 1) // (self.exponent - 1))
        return max(1, first(level)), first(level + 1) - 1

    def append(self, words: np.ndarray) -> None:
        old, self.n = self.n, self.n + len(words)
        if self.n > len(self.words):
            grown = np.zeros(max(self.n, 2 * len(self.words)), np.int64)
            grown[:old] = self.words[:old]
            self.words = grown
        self.words[old : self.n] = words
        for q in list(self.open):
            ends = self.seen[q][1]
            ends[-1] = self._forward(ends[-1] - q, ends[-1])
            if ends[-1] < self.n:
                self.open.discard(q)
        level = 0
        while (1 << level) <= self.n and (self.longest is None or self.exponent * self.periods(level)[0] <= self.longest):
            self._look(level, max(0, old - (1 << level) + 1))
            level += 1
        for k, (base, held) in enumerate(self.names):  # what later words may still be compared with
            start = max(base, self.n - (1 << k) - max(1 << k, self.periods(k)[1]) - 1)
            self.names[k] = (start, held[start - base :].copy())

    def _look(self, level: int, first: int) -> None:
        """Names of the blocks that became complete, and their comparison with the caught ones."""
        size, (low, high) = 1 << level, self.periods(level)
        many = self.n - size - first + 1
        if level == 0:
            new = _mix(self.words[first : self.n].view(U64) * _LEFT)
        else:
            base, lower = self.names[level - 1]
            a, b = lower[first - base : first - base + many], lower[first - base + size // 2 : first - base + size // 2 + many]
            new = _mix(a * _LEFT + b * _RIGHT)
        if level == len(self.names):
            self.names.append((0, new[:0]))
        base, held = self.names[level]
        held = np.concatenate([held, new]) if len(held) else new
        suffix = np.arange(first, first + many)
        for back in range(-(-(high - low + 1) // size)):
            block = (((suffix - low) >> level) - back) << level
            ok = np.flatnonzero((block >= 0) & (block >= suffix - high) & (block <= suffix - low))
            hit = ok[held[block[ok] - base] == held[suffix[ok] - base]]
            if len(hit):
                self._extend(block[hit], suffix[hit], size)
        self.names[level] = (base, held)

    def _extend(self, block: np.ndarray, suffix: np.ndarray, size: int) -> None:
        """Follow the hits that lie in no known stretch."""
        period, end = suffix - block, suffix + size
        fresh = np.ones(len(block), bool)
        for p, (starts, ends) in self.seen.items():
            at = np.searchsorted(starts, block, side="right") - 1
            fresh &= ~((at >= 0) & (np.array(ends)[at] >= end) & (period % p == 0))
        order = np.flatnonzero(fresh)
        order = order[np.lexsort((block[order], period[order]))]
        added: list[int] = []
        for s, q, e in zip(block[order].tolist(), period[order].tolist(), end[order].tolist(), strict=True):
            if any(q % p == 0 and self._inside(p, s, e) for p in added):
                continue
            stop = self._forward(s, s + q)
            if stop < e:
                continue  # names are equal, words are not
            start = self._back(s, s + q)
            starts, ends = self.seen.setdefault(q, ([], []))
            if starts and starts[-1] == start:
                continue
            starts.append(start)
            ends.append(stop)
            if stop == self.n:
                self.open.add(q)
            if q not in added:
                added.append(q)

    def _inside(self, p: int, start: int, end: int) -> bool:
        starts, ends = self.seen[p]
        at = bisect_right(starts, start) - 1
        return at >= 0 and ends[at] >= end

    def _forward(self, a: int, b: int) -> int:
        """First position from b whose word differs from the one b - a before it."""
        step, apart = 16, b - a
        while b < self.n:
            upto = min(self.n, b + step)
            unlike = self.words[b:upto] != self.words[b - apart : upto - apart]
            if unlike.any():
                return b + int(unlike.argmax())
            b, step = upto, min(4 * step, 1 << 20)
        return self.n

    def _back(self, a: int, b: int) -> int:
        """First position of the stretch before a in which words equal those b - a behind them."""
        step, apart = 16, b - a
        while a > 0:
            low = max(0, a - step)
            unlike = self.words[low:a] != self.words[low + apart : a + apart]
            if unlike.any():
                return a - int(unlike[::-1].argmax())
            a, step = low, min(4 * step, 1 << 20)
        return 0

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs of the words so far, by start and period."""
        least: dict[tuple[int, int], int] = {}
        for q, (starts, ends) in self.seen.items():
            for start, end in zip(starts, ends, strict=True):
                if end - start >= max(self.least, self.exponent * q):
                    least[start, end] = min(q, least.get((start, end), q))
        return sorted((start, end - start, q) for (start, end), q in least.items())


def runs_of(texts: list[list[bytes]], exponent: int = EXPONENT, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Runs of each list of words; all lists go through one catcher, a number of its own between them."""
    number: dict[bytes, int] = {}
    catcher = Catcher(exponent, least, max(map(len, texts), default=0))
    parts, starts, at = [], [], 0
    for k, words in enumerate(texts):
        starts.append(at)
        parts.append(np.array([number.setdefault(w, len(number)) for w in words] + [-1 - k], np.int64))
        at += len(words) + 1
    catcher.append(np.concatenate(parts)) if parts else None
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in catcher.runs():
        k = bisect_right(starts, start) - 1
        out[k].append((start - starts[k], length, period))
    return out


def kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    stay = np.ones(len(words), bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(stay).tolist()]


def _per_text(rows: DataFrame, fields: list[T.StructField], of, exponent: int, least: int) -> DataFrame:
    """The columns of rows but the last, a text, with those that of(words, runs) makes of it."""
    schema = T.StructType([*rows.schema.fields[:-1], *fields])
    arrow, at = to_arrow_schema(schema), len(rows.columns) - 1

    def per_partition(batches):
        for b in batches:
            for begin, stop in pieces_of(b.column(at)):
                part = b.slice(begin, stop - begin)
                words = [(t.as_py() or b"").split() for t in part.column(at).cast(pa.binary())]
                made = [of(w, r) for w, r in zip(words, runs_of(words, exponent, least), strict=True)]
                yield batch(arrow, [*part.columns[:at], *zip(*made, strict=True)])

    return rows.mapInArrow(per_partition, schema)


RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and text, its kept words joined by blanks."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("text", T.StringType())]
    names = RUN.fieldNames()

    def of(words, runs):
        return len(words), [dict(zip(names, r, strict=True)) for r in runs], b" ".join(kept(words, runs)).decode("utf-8", "replace")

    return _per_text(rows, fields, of, exponent, least)


def collapsed(docs: DataFrame, text_col: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """The columns of docs; texts with a run are their kept words joined by blanks, others stay as they are."""
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(text_col).alias("__text"))

    def of(words, runs):
        return (b" ".join(kept(words, runs)).decode("utf-8", "replace") if runs else None,)

    made = _per_text(rows, [T.StructField("__kept", T.StringType())], of, exponent, least)
    return made.select(*[(F.coalesce("__kept", f"c{i}") if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_runs, the run with the greatest share of length to period, and digests of all runs and of the kept words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    numbers = ["n_runs", "start", "length", "period", "exponent_milli"]
    fields = [*[T.StructField(n, T.LongType()) for n in numbers], *[T.StructField(n, T.StringType()) for n in ("runs_sha256", "collapsed_sha256")]]

    def of(words, runs):
        start, length, period = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        milli = 1000 * length // period if runs else None
        return len(runs), start, length, period, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept(words, runs))).hexdigest()

    return _per_text(rows, fields, of, EXPONENT, LEAST)


def with_repeats(text: Column, doc_id: Column) -> Column:
    """The texts of a tenth of the ids with a stretch of their words repeated to the end, as the query's contract plants it."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        every = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int")))
        return F.when(n > 0, F.array_join(every, " "))

    words = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    return F.when(h % 10 == 0, F.coalesce(once(words, planted), text)).otherwise(text)


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return digests(docs.select("doc_id", with_repeats(F.col("text"), F.col("doc_id")).alias("text")), "doc_id", "text")
