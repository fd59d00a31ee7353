"""Shards of even size that keep linked documents together, by balanced label propagation.

Documents of equal text are linked. Labels are shards. The linked documents are
dealt evenly at first; then, in rounds, each takes up the votes of its neighbours
by a join: documents of one text and one shard vote and move as a block of any
size, so a text with a third of all rows is as many rows of the join as there are
shards. A block wants the shard in which most of its text lies (of equal votes,
the one with the smaller hash) among those that have room. A quota bounds every
shard: of the wishes between each pair of shards, 56 numbers for eight of them,
swaps and circles move, and others as far as there is room, those with most votes
first; a block is cut where the quota ends. Rounds end when no document moves or
after `rounds` of them. Without any unlinked rows only swaps are left, and a text
with more rows than a shard then stays spread.

Documents without a link, which cut nothing wherever they lie, then fill each shard
up to its quota. Quotas are the rows divided by the shards, rounded up for the
first ones: the numbers of rows of two shards differ by one at most (law "rows").
Slots number the rows of a shard.

Results: one row per input row. Null texts are empty (size 1), and all empty texts
are linked. Null and repeated ids are rows like others; ids play no part. Of equal
blocks the one with the smaller hash is taken first. An empty table gives no rows.
Other columns are not read.
Texts are equal where 128-bit hashes are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from titleloom.llm.common import documents, query, stored
from titleloom.llm.numbering import running

SHARDS, ROUNDS = 8, 12


def placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, size, text_crc32, key (of the text), part and nth (row of this key in this part); runs a write."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("key"),
    )
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.LongType()), T.StructField("nth", T.LongType())])
    arrow = to_arrow_schema(schema)

    def per_partition(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            nth = []
            for key in b.column(3).to_pylist():
                n = seen.get(key, 0)
                seen[key] = n + 1
                nth.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int64)), pa.array(nth, pa.int64())], schema=arrow)

    return stored(rows.mapInArrow(per_partition, schema), "placed")


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def _circle(left: np.ndarray) -> list[int]:
    """Shards on a circle of wishes, each wishing to the next and the last to the first; empty where there is none."""
    state = [0] * len(left)  # 1: on the path, 2: on no circle
    for start in range(len(left)):
        path = [] if state[start] else [start]
        while path:
            at = path[-1]
            state[at] = 1
            for to in np.flatnonzero(left[at]).tolist():
                if state[to] == 1:
                    return path[path.index(to) :]
                if not state[to]:
                    path.append(to)
                    break
            else:
                state[path.pop()] = 2
    return []


def flows(wishes: np.ndarray, load: list[int], quota: list[int]) -> np.ndarray:
    """The part of wishes[from, to] that may move so that every shard stays within its quota, if load does.

    Swaps between two shards and then circles of more move first, as they fill
    no shard. What is left has no circle: from its ends on, each shard takes in
    what it has room for, and room that this leaves is used behind it.
    """
    left, room = wishes.copy(), np.array(quota) - np.array(load)
    left -= np.minimum(left, left.T)
    while circle := _circle(left):
        a, b = circle, [*circle[1:], circle[0]]
        left[a, b] -= left[a, b].min()
    todo = set(range(len(left)))
    while todo:
        to = next(k for k in sorted(todo) if not left[k, sorted(todo)].any())
        todo.discard(to)
        for k in np.argsort(-left[:, to], kind="stable").tolist():
            take = min(int(left[k, to]), int(room[to]))
            left[k, to] -= take
            room[to] -= take
            room[k] += take
    return wishes - left


def _spread(first: Column, n: Column, shard: Column, shards: int) -> Column:
    """How many of the numbers first to first + n - 1 leave the remainder `shard`."""
    upto = lambda x: F.floor((x - shard + (shards - 1)) / shards)
    return upto(first + n) - upto(first)


def _loads(blocks: DataFrame, shards: int) -> list[int]:
    load = [0] * shards
    for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        load[r["shard"]] = r["n"]
    return load


def round_of(blocks: DataFrame, load: list[int], quota: list[int], shut: set[int]) -> tuple[DataFrame, int, set[int]]:
    """(blocks after one round of moves, documents moved, shards without room); blocks: key, shard, n."""
    shards = len(quota)
    own = F.struct(F.col("n"), (-F.xxhash64("key", "shard")).alias("tie"), F.col("shard"))
    votes = blocks.groupBy("key").agg(F.sort_array(F.collect_list(own), asc=False).alias("votes"))  # one entry per shard at most
    rows = blocks.join(votes, "key").withColumn("own", own)
    has_room = F.array(*[F.lit(k not in shut) for k in range(shards)])
    better = F.filter("votes", lambda v: (v > F.col("own")) & F.get(has_room, v.shard))
    best = F.get(better, F.lit(0))
    rows = rows.select("key", "shard", "n", best["shard"].alias("to"), best["n"].alias("weight"))
    rows = stored(rows, "wishes")
    asked = rows.where("to IS NOT NULL")
    wishes = np.zeros((shards, shards), np.int64)
    for r in asked.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect():  # shards x shards
        wishes[r["shard"], r["to"]] = r["n"]
    flow = flows(wishes, load, quota)
    room = np.array(quota) - (np.array(load) - flow.sum(axis=1) + flow.sum(axis=0))
    shut = {k for k in range(shards) if room[k] <= 0 and (k in shut or flow[:, k].sum() < wishes[:, k].sum())}
    if not flow.sum():
        return blocks, 0, shut
    cell = F.col("shard") * shards + F.col("to")
    in_order = running(asked.orderBy(F.desc("weight"), F.xxhash64("key", "shard"), "key", "shard"), F.col("n"), cell)
    allowed = F.get(F.array(*[F.lit(int(x)) for x in flow.ravel()]), cell.cast("int"))
    moved = in_order.withColumn("moves", F.greatest(F.lit(0), F.least(F.col("n"), allowed - F.col("before"))))
    sides = F.array(F.struct("shard", (F.col("n") - F.col("moves")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("moves").alias("n")))
    after = moved.select("key", F.explode(sides).alias("b")).select("key", "b.shard", "b.n").where("n > 0")
    after = after.unionAll(rows.where("to IS NULL").select("key", "shard", "n"))
    return stored(after.groupBy("key", "shard").agg(F.sum("n").alias("n")), "blocks"), int(flow.sum()), shut


def propagate(groups: DataFrame, quota: list[int], rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """(blocks, load): the rows of every group (key, n) dealt to shards within the quotas."""
    shards = len(quota)
    numbered = running(groups.select("key", "n"), F.col("n"), name="first")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    blocks = numbered.select("key", "first", "n", every.alias("shard"))
    blocks = stored(blocks.select("key", "shard", _spread(F.col("first"), F.col("n"), F.col("shard"), shards).alias("n")).where("n > 0"), "blocks")
    shut: set[int] = set()
    for _ in range(rounds):
        blocks, moved, now = round_of(blocks, _loads(blocks, shards), quota, shut)
        if not moved and now == shut:
            break
        shut = now
    return blocks, _loads(blocks, shards)


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, key (of the text), shard and slot of each row."""
    rows = placed(docs, id_col, text_col)
    quota = quotas(rows.count(), shards)
    # rows of one text by part: a repeated text has one row here for each part that holds it
    parts = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("m"))
    linked = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    linked = stored(linked, "groups")
    blocks, load = propagate(linked, quota, rounds)
    upto = Window.partitionBy("key").orderBy("shard")
    cuts = blocks.select("key", "shard", F.sum("n").over(upto).alias("upto"))
    cuts = cuts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("cuts"))  # one entry per shard at most
    front = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = parts.join(linked.select("key"), "key", "left_semi").select("key", "part", F.coalesce(F.sum("m").over(front), F.lit(0)).alias("front"))
    places = stored(places.join(cuts, "key"), "places")
    found = rows.join(places, ["key", "part"], "left")
    place = F.col("front") + F.col("nth")
    mine = F.get(F.filter("cuts", lambda c: c.upto > place), F.lit(0))["shard"]
    found = found.select("doc_id", "size", "text_crc32", "key", F.coalesce(mine, F.lit(-1)).alias("shard"))
    found = running(found, cell=F.col("shard"))
    free = np.array(quota) - np.array(load)
    ends = np.cumsum(free).tolist()
    fill = F.lit(shards - 1)
    for k in reversed(range(shards - 1)):
        fill = F.when(F.col("before") < ends[k], k).otherwise(fill)
    found = found.withColumn("linked", F.col("shard") >= 0).withColumn("shard", F.when(F.col("linked"), F.col("shard")).otherwise(fill).cast("int"))
    shift = F.get(F.array(*[F.lit(int(n) + int(f) - int(e)) for n, f, e in zip(load, free, ends, strict=True)]), F.col("shard"))
    slot = F.when(F.col("linked"), F.col("before")).otherwise(F.col("before") + shift)
    return found.select("doc_id", "size", "text_crc32", "key", "shard", slot.cast("long").alias("slot"))


@query("op13_balanced_shards")
def op13_balanced_shards(spark, sf_dir):
    return shard(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
