"""Document fingerprints as invertible Bloom lookup tables of paragraph digests.

Each paragraph digest is added to three cells (count, xor of digests, xor of
check values), one in each third of the table. Subtracting the tables of two
versions leaves the digests that only one of them has; peeling cells with one
digest recovers them. Where that gets stuck the tables were too small, and both
are built again with four times the cells.

A paragraph is a line; longer lines end at sentences, and those longer than
LONGEST characters are cut there, so an edit changes few digests. The n-th
repeat of a paragraph has a digest of its own.

Results: null texts are empty, and an empty text has an empty table. Two empty
texts have likeness 1. Equal texts have equal fingerprints. Ids are integers;
rows are ordered by id (nulls first), equal ids by a hash of the text; rows
alike in both are interchangeable. A single document is its own next. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from titleloom.llm.common import batch, documents, query

CELLS, GROWTH, LONGEST = 24, 4, 120
PART_BYTES, PARTS = 6_000_000, 100_000
U64 = np.uint64


def paragraphs(text: str) -> list[bytes]:
    units = []
    for line in text.split("\n"):
        if len(line) <= LONGEST:
            units.append(line)
        else:
            for s in line.split(". "):
                units.extend([s] if len(s) <= LONGEST else [s[i : i + LONGEST] for i in range(0, len(s), LONGEST)])
    return [u.encode("utf-8", "surrogatepass") for u in units if u]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def digests(text: str) -> np.ndarray:
    """64-bit digests of the paragraphs; the n-th equal one is mixed with n."""
    raw = np.sort(np.array([xxhash.xxh3_64_intdigest(u) for u in paragraphs(text)], U64))
    if len(raw) < 2:
        return _mix(raw)
    new = np.flatnonzero(np.concatenate(([True], raw[1:] != raw[:-1])))
    repeat = np.arange(len(raw)) - np.repeat(new, np.diff(np.append(new, len(raw))))
    return _mix(raw + repeat.astype(U64) * U64(0x9E3779B97F4A7C15))


class Tables:
    """One table of `cells` cells for each list of digests."""

    def __init__(self, lists: list[np.ndarray], cells: int):
        self.cells, self.n = cells, len(lists)
        self.count = np.zeros(self.n * cells, np.int64)
        self.keys = np.zeros(self.n * cells, U64)
        self.checks = np.zeros(self.n * cells, U64)
        if lists:
            owner = np.repeat(np.arange(self.n), [len(x) for x in lists])
            self.change(owner, np.concatenate(lists), np.ones(len(owner), np.int64))

    def change(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        third, check = self.cells // 3, _check(keys)
        for j in range(3):
            at = owner * self.cells + j * third + (_mix(keys + U64(j + 1)) % U64(third)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, check)

    def minus(self, other: Tables) -> Tables:
        left = Tables([], self.cells)
        left.n = self.n
        left.count, left.keys, left.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return left

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered (owner, digest, sign: 1 only in the first), and which tables were emptied."""
        found = [(np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64))]
        while True:
            at = np.flatnonzero(np.abs(self.count) == 1)
            at = at[_check(self.keys[at]) == self.checks[at]]
            if not len(at):
                break
            rows = np.empty(len(at), [("owner", np.int64), ("key", U64), ("sign", np.int64)])
            rows["owner"], rows["key"], rows["sign"] = at // self.cells, self.keys[at], self.count[at]
            rows = np.unique(rows)
            found.append((rows["owner"], rows["key"], rows["sign"]))
            self.change(rows["owner"], rows["key"], -rows["sign"])
        full = ((self.count != 0) | (self.keys != 0)).reshape(self.n, self.cells).any(axis=1)
        return *(np.concatenate(c) for c in zip(*found, strict=True)), ~full

    def text(self, row: int, size: int) -> str:
        """Number of digests and the cells of one table, as base64."""
        part = slice(row * self.cells, (row + 1) * self.cells)
        cells = self.count[part].astype("<i4").tobytes() + self.keys[part].astype("<u8").tobytes() + self.checks[part].astype("<u4").tobytes()
        return base64.b64encode(size.to_bytes(4, "little") + cells).decode()


def _check(keys: np.ndarray) -> np.ndarray:
    return _mix(keys ^ U64(0xD6E8FEB86659FD93)) >> U64(32)


def differences(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair the digests that only a has and that only b has; tables grow for the pairs that don't peel."""
    out: list = [None] * len(a)
    todo = np.arange(len(a))
    while len(todo):
        owner, keys, sign, done = Tables([a[i] for i in todo], cells).minus(Tables([b[i] for i in todo], cells)).peel()
        order = np.argsort(owner, kind="stable")
        owner, keys, sign = owner[order], keys[order], sign[order]
        ends = np.searchsorted(owner, np.arange(len(todo) + 1))
        for k in np.flatnonzero(done):
            part = slice(ends[k], ends[k + 1])
            out[todo[k]] = (keys[part][sign[part] > 0], keys[part][sign[part] < 0])
        todo, cells = todo[~done], cells * GROWTH
    return out


def likeness(a: np.ndarray, b: np.ndarray, difference: tuple[np.ndarray, np.ndarray]) -> float:
    """Shared digests among all digests of both."""
    apart = len(difference[0]) + len(difference[1])
    shared = (len(a) + len(b) - apart) // 2
    return shared / (shared + apart) if shared + apart else 1.0


def edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = [
    ("doc_id", None), ("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()),
    ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()),
]


def compare(rows: list[tuple]) -> list[tuple]:
    """Result rows of (id, text, its digests, next text, its digests)."""
    edited = [edit(t, n) for _, t, _, n, _ in rows]
    sets = [[r[2] for r in rows], [digests(t) for t in edited], [r[4] for r in rows]]
    own, other = Tables(sets[0], CELLS), Tables(sets[1], CELLS)
    to_edit, to_next = differences(sets[0], sets[1]), differences(sets[0], sets[2])
    return [
        (doc, len(text), hashlib.sha256(edited[i].encode()).hexdigest(), own.text(i, len(sets[0][i])), other.text(i, len(sets[1][i])),
         likeness(sets[0][i], sets[1][i], to_edit[i]), likeness(sets[0][i], sets[2][i], to_next[i]))
        for i, (doc, text, *_) in enumerate(rows)
    ]


def with_next(docs: DataFrame, id_col: str, text_col: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(part, ghost, key, doc_id, text) in order within each part; a part ends with a ghost, the first row of the part behind it.

    Parts are ranges of ids between quantiles, of about `part_bytes` of text, PARTS at most. The first rows of all
    parts, one small row each, pass the driver.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = min(PARTS, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), size // part_bytes))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("key"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = rows.select("key").approxQuantile("key", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = np.array(sorted({int(b) for b in bounds}), np.int64)

    @F.pandas_udf("int")
    def part_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(np.int64), side="right").astype(np.int32))

    first = F.min(F.struct("key", F.xxhash64("text").alias("h"))).alias("first")
    heads = sorted(tuple(r) for r in rows.groupBy(part_of("key").alias("part")).agg(first).select("part", "first.key", "first.h").collect())
    before = [(heads[i - 1][0], k, h) for i, (_, k, h) in enumerate(heads)]
    ghosts = spark.createDataFrame(before, "before INT, key LONG, h LONG")  # one row per part
    rows = rows.select(part_of("key").alias("part"), F.xxhash64("text").alias("h"), "key", "doc_id", "text")
    rows = rows.join(F.broadcast(ghosts), ["key", "h"], "left")
    places = F.array_compact(F.array(F.struct("part", F.lit(0).alias("ghost")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("part"), F.lit(1).alias("ghost")))))
    rows = rows.select(F.explode(places).alias("at"), "key", "h", "doc_id", "text").select("at.part", "at.ghost", "key", "h", "doc_id", "text")
    return rows.repartition(parts, "part").sortWithinPartitions("part", "ghost", "key", "h")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 500_000, most: int = 256) -> DataFrame:
    """The sketch of each document and of its edited text, and likenesses to the edited text and to the next document."""
    rows = with_next(docs, id_col, text_col)
    schema = T.StructType([T.StructField(n, t or rows.schema["doc_id"].dataType) for n, t in RESULT])
    arrow = to_arrow_schema(schema)

    def per_partition(batches):
        last, ready, held = None, [], 0
        for b in batches:
            for part, ghost, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist(), b.column(5), strict=True):
                text = text.as_py()
                own = digests(text)
                if last is not None and last[0] == part:
                    ready.append((*last[1:], text, own))
                    held += len(text)
                last = None if ghost else (part, doc, text, own)
                if len(ready) >= most or held > size:
                    yield batch(arrow, list(zip(*compare(ready), strict=True)))
                    ready, held = [], 0
        if ready:
            yield batch(arrow, list(zip(*compare(ready), strict=True)))

    return rows.mapInArrow(per_partition, schema)


@query("op8_document_fingerprints")
def op8_document_fingerprints(spark, sf_dir):
    return fingerprints(documents(spark, sf_dir))
