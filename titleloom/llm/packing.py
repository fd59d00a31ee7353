"""Packing of token sequences with a bounded number of open windows.

Each partition keeps at most `windows` open windows. A document's ids are cut
into whole windows; what is left goes into the open window that it fills best.
Where it fits in none and all windows are in use, the fullest is topped up with
its head and emitted, and the tail is placed anew. At the end of a partition
its windows are merged; the one remainder of each partition, under a window of
ids, is merged again with those of `fan_in` neighbours, and what is left of
that is cut at powers of two, so nothing is padded.

Results: one row per piece. Null texts are empty; an empty document is its end
id alone. Rows with the same id are packed as separate documents, null ids too.
An empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from titleloom.llm.common import batch, documents, query, stored
from titleloom.llm.tokens import WIDTH, encoder

WINDOW, WINDOWS, FAN_IN, END = 1024, 64, 32, 0



class Packer:
    """Windows of pieces (doc, start, ids, doc_tokens); `emit(pieces)` gets each full window."""

    def __init__(self, window: int, windows: int, emit):
        self.window, self.windows, self.emit = window, windows, emit
        self.room: list[tuple[int, int]] = []  # (free ids, window number), ascending
        self.held: dict[int, list] = {}
        self.made = 0

    def add(self, doc, ids: bytes) -> None:
        total, start = len(ids) // WIDTH, 0
        while total - start >= self.window:
            self.emit([(doc, start, ids[start * WIDTH : (start + self.window) * WIDTH], total)])
            start += self.window
        if start < total:
            self.place(doc, start, ids[start * WIDTH :], total)

    def place(self, doc, start: int, ids: bytes, total: int) -> None:
        n = len(ids) // WIDTH
        k = bisect_left(self.room, (n, -1))
        if k == len(self.room) and k == self.windows:
            free, number = self.room.pop(0)
            self.emit([*self.held.pop(number), (doc, start, ids[: free * WIDTH], total)])
            start, ids, n = start + free, ids[free * WIDTH :], n - free
            k = bisect_left(self.room, (n, -1))
        if k < len(self.room):
            free, number = self.room.pop(k)
        else:
            free, number = self.window, self.made
            self.made += 1
            self.held[number] = []
        self.held[number].append((doc, start, ids, total))
        if free == n:
            self.emit(self.held.pop(number))
        else:
            insort(self.room, (free - n, number))

    def finish(self) -> list:
        """Merge the open windows, fullest first; returns the pieces of the last, not full one."""
        order = [number for _, number in self.room]
        return merge([p for number in order for p in self.held[number]], self.window, self.emit)


def merge(pieces: list, window: int, emit) -> list:
    """Fill windows one after the other, cutting at their ends."""
    open_, free = [], window
    for doc, start, ids, total in pieces:
        while ids:
            part = ids[: free * WIDTH]
            open_.append((doc, start, part, total))
            start, ids, free = start + len(part) // WIDTH, ids[len(part) :], free - len(part) // WIDTH
            if not free:
                emit(open_)
                open_, free = [], window
    return open_


def powers(pieces: list, emit) -> None:
    """Cut a remainder into sequences whose lengths are powers of two."""
    left = sum(len(p[2]) for p in pieces) // WIDTH
    while left:
        size, full = 1 << (left.bit_length() - 1), []
        pieces = merge(pieces, size, lambda p: full.append(p) if not full else None) if left == size else _split(pieces, size, full)
        emit(full[0])
        left -= size


def _split(pieces: list, size: int, full: list) -> list:
    head, rest = [], []
    for doc, start, ids, total in pieces:
        cut = ids[: size * WIDTH]
        if cut:
            head.append((doc, start, cut, total))
            size -= len(cut) // WIDTH
        if len(ids) > len(cut):
            rest.append((doc, start + len(cut) // WIDTH, ids[len(cut) :], total))
    full.append(head)
    return rest


class _Rows:
    """Pieces as Arrow batches of bounded size; windows are numbered from `base`."""

    def __init__(self, schema: pa.Schema, base: int):
        self.schema, self.number, self.rows, self.bytes = schema, base, [], 0

    def emit(self, pieces: list, open_: bool = False) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids) // WIDTH, total, self.number, offset, ids, open_))
            offset += len(ids) // WIDTH
            self.bytes += len(ids) + 64
        self.number += 1

    def take(self, at_least: int = 0):
        if self.rows and self.bytes >= at_least:
            yield batch(self.schema, list(zip(*self.rows, strict=True)))
            self.rows, self.bytes = [], 0


def piece_schema(doc_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("doc_id", doc_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
            T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("open", T.BooleanType()),
        ]
    )


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, windows: int = WINDOWS,
    fan_in: int = FAN_IN, vocabulary: str | None = None,
) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit) of every piece.

    Sequence numbers are unique, not dense: partition and number within it.
    """
    if window & (window - 1) or window < 2:
        raise ValueError("the window must be a power of two")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = piece_schema(rows.schema["doc_id"].dataType)
    arrow = to_arrow_schema(schema)
    end = END.to_bytes(WIDTH, "little")

    def per_partition(batches):
        out = _Rows(arrow, TaskContext.get().partitionId() << 32)
        packer, encode = Packer(window, windows, out.emit), encoder(vocabulary).encode
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                packer.add(doc, encode(text.as_py() or "") + end)
                yield from out.take(8_000_000)
        left = packer.finish()
        if left:
            out.emit(left, open_=True)
        yield from out.take()

    first = stored(rows.mapInArrow(per_partition, schema), "pack")

    def per_group(key, table):
        out, base = _Rows(arrow, (1 << 62) | (key[0].as_py() << 32)), []
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        for r in table.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
            base.append((r["doc_id"], r["start"], r["ids"], r["doc_tokens"]))
        powers(merge(base, window, out.emit), out.emit)
        return pa.Table.from_batches(list(out.take()), schema=arrow)

    left = first.where("open").withColumn("group", F.floor(F.shiftright("sequence_id", 32) / fan_in).cast("long"))
    last = left.groupBy("group").applyInArrow(per_group, schema)
    return first.where("not open").unionByName(last).drop("open")


@query("op1_packing")
def op1_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
