"""Importance resampling of documents towards a target, drawn by an exact distributed selection.

Features are runs of 1 to `words` consecutive words, hashed into `buckets`
buckets. With S features of all documents, s of them in a bucket, and T and t of
the target, the bucket's gain is floor(1000 * ln((t+1)(S+buckets) / ((s+1)(T+buckets)))).
One pass over the texts writes each document's buckets as an array, and with them
the bucket counts of each task; gains are then a small array that every task has,
and a document's weight is the sum over its array. Gumbel noise, fixed by the
document's id and a seed, is added: the highest scores are a draw without
replacement by weight.

The cutoff among the scores is found by weighted medians of medians. Each task
gives the median of its remaining keys, one for each block of a bounded number of
rows, and their number; the median of these, weighted by the numbers, is the next
pivot. The pass that counts the keys on either side of it gives the medians of
both sides too. At least a quarter of the keys, less the pivot, is discarded each
time, half as a rule; the last SMALL ones are sorted. Only then are the winners sorted by
ranges and numbered, so no task or driver holds more than its share.

Keys are (score, highest first; id, null last; row number), so there are no
ties. Ids are integers.

Results: one row per input row. Null and empty texts have no feature and weight
0. Rows with null or equal ids stay rows of their own; equal ids get equal
noise (a null id that of "null"), and of rows alike in id and score those read first win. A target without
features leaves gains that only tell how frequent a bucket is. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from titleloom.llm.common import LOWER, UPPER, batch, documents, query, stored
from titleloom.llm.licences import BREAKS
from titleloom.llm.numbering import running

BUCKETS, WORDS, LEAST_WORDS, SHARE, SEED = 10_000, 1, 20, (10, 100), 2024
MEMO = 500_000  # features whose bucket a task remembers
BLOCK = 1 << 20  # keys under one median
SMALL = 4096
_PLAIN = bytes.maketrans((UPPER + BREAKS).encode(), (LOWER + " " * len(BREAKS)).encode())


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_PLAIN).split()


class _Buckets(dict):
    """Bucket of a feature; holds MEMO features at most."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def features(own: list[bytes], most: int, bucket: _Buckets) -> np.ndarray:
    """Buckets of all runs of 1 to `most` words."""
    found = [bucket[w] for w in own]
    for n in range(2, most + 1):
        found += [bucket[b" ".join(own[i : i + n])] for i in range(len(own) - n + 1)]
    return np.array(found, np.int64)


def hashed(docs: DataFrame, id_col: str, text_col: str, most: int, buckets: int) -> DataFrame:
    """One row per document (row, doc_id, n_words, held: its buckets), and rows (bucket, n) of feature counts (runs a write)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = T.StructType(
        [T.StructField("row", T.LongType()), rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("held", T.BinaryType()),
         T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())]
    )
    arrow = to_arrow_schema(schema)

    def per_partition(batches):
        row, bucket, counts = TaskContext.get().partitionId() << 33, _Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            held, lengths = [], []
            for text in b.column(1):
                own = words_of(text.as_py())
                found = features(own, most, bucket)
                counts += np.bincount(found, minlength=buckets)
                held.append(found.astype("<u4").tobytes())
                lengths.append(len(own))
            none = [None] * b.num_rows
            yield batch(arrow, [range(row, row + b.num_rows), b.column(0), lengths, held, none, none])
            row += b.num_rows
        some = np.flatnonzero(counts)
        none = [None] * len(some)
        yield batch(arrow, [none, none, none, none, some, counts[some]])

    return stored(rows.mapInArrow(per_partition, schema), "features")


def bucket_counts(facts: DataFrame, buckets: int) -> np.ndarray:
    counts = np.zeros(buckets, np.int64)
    for r in facts.where("row IS NULL").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    all_s, all_t, n = int(source.sum()), int(target.sum()), len(source)
    return np.array(
        [math.floor(1000 * math.log((t + 1) * (all_s + n) / ((s + 1) * (all_t + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))) for u from the hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def weighted(facts: DataFrame, gain: np.ndarray) -> DataFrame:
    """row, doc_id, n_words, n_features and weight of each document."""
    rows = facts.where("row IS NOT NULL").select("row", "doc_id", "n_words", "held")
    numbers = [T.StructField(n, T.LongType()) for n in ("n_features", "weight")]
    schema = T.StructType([*rows.schema.fields[:3], *numbers])
    arrow = to_arrow_schema(schema)

    def per_partition(batches):
        for b in batches:
            arrays = [np.frombuffer(x.as_py(), "<u4") for x in b.column(3)]
            yield batch(arrow, [b.column(0), b.column(1), b.column(2), [len(a) for a in arrays], [int(gain[a].sum()) for a in arrays]])

    return rows.mapInArrow(per_partition, schema)


KEY = ("low", "no_id", "id", "row")
Key = tuple[int, int, int, int]


def _key() -> list[Column]:
    return [(-F.col("score")).alias("low"), F.col("doc_id").isNull().cast("long").alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("row")]


def _upto(key: Key) -> Column:
    return F.struct(*KEY) <= F.struct(*[F.lit(k).cast("long").alias(c) for k, c in zip(key, KEY, strict=True)])


def medians(keys: DataFrame, pivot: Key | None, block: int = BLOCK) -> list[tuple[bool, Key, int]]:
    """(beyond the pivot, median, number) of each block of keys; one small row per block and side passes the driver."""
    names = [("beyond", T.BooleanType()), *[(c, T.LongType()) for c in KEY], ("n", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in names])
    arrow = to_arrow_schema(schema)

    def of(keys: np.ndarray, beyond: bool):
        middle = (len(keys) - 1) // 2
        # the median score first; the other columns only where scores are equal
        low = np.partition(keys[:, 0], middle)[middle]
        equal = keys[keys[:, 0] == low]
        place = middle - int((keys[:, 0] < low).sum())
        return [beyond, *equal[np.lexsort(equal[:, :0:-1].T)[place]].tolist(), len(keys)]

    def per_partition(batches):
        held: list[list[np.ndarray]] = [[], []]
        size = [0, 0]
        out = []
        for b in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1).astype(np.int64)
            beyond = np.ones(len(rows), bool)
            if pivot is not None:
                beyond[:] = False
                equal = np.ones(len(rows), bool)
                for k, value in enumerate(pivot):
                    beyond |= equal & (rows[:, k] > value)
                    equal &= rows[:, k] == value
            for side in (0, 1):
                part = rows[beyond == bool(side)]
                held[side].append(part)
                size[side] += len(part)
                if size[side] >= block:
                    out.append(of(np.concatenate(held[side]), bool(side)))
                    held[side], size[side] = [], 0
        out += [of(np.concatenate(held[side]), bool(side)) for side in (0, 1) if size[side]]
        if out:
            yield batch(arrow, list(zip(*out, strict=True)))

    return [(r["beyond"], tuple(r[c] for c in KEY), r["n"]) for r in keys.mapInArrow(per_partition, schema).collect()]


def cutoff(keys: DataFrame, need: int, small: int = SMALL, block: int = BLOCK) -> Key | None:
    """The need-th smallest key (columns KEY), or None where there are none to take."""
    if need < 1:
        return None
    found, rest = medians(keys, None, block), keys
    while (n := sum(m[2] for m in found)) > small:
        found.sort(key=lambda m: m[1])
        upto = np.cumsum([m[2] for m in found])
        pivot = found[int(np.searchsorted(upto, n / 2))][1]
        sides = medians(rest, pivot, block)
        near = sum(m[2] for m in sides if not m[0])
        inside = need <= near
        rest = rest.where(_upto(pivot) if inside else ~_upto(pivot))
        need -= 0 if inside else near
        found = [m for m in sides if m[0] != inside]
    last = sorted(tuple(r) for r in rest.collect())  # at most `small` keys
    return last[need - 1]


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", share: tuple[int, int] = SHARE,
    least_words: int = LEAST_WORDS, words: int = WORDS, buckets: int = BUCKETS, seed: int = SEED, small: int = SMALL, block: int = BLOCK,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each document; rank is null where it is not drawn.

    Drawn are share[0] of share[1] of the documents with at least `least_words`
    words, rounded down.
    """
    facts = hashed(docs, id_col, text_col, words, buckets)
    wanted = hashed(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text).alias("text")), "id", "text", words, buckets)
    gain = gains(bucket_counts(facts, buckets), bucket_counts(wanted, buckets))
    scored = stored(weighted(facts, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    eligible = F.col("n_words") >= least_words
    keys = scored.where(eligible).select(*_key())
    last = cutoff(keys, keys.count() * share[0] // share[1], small, block)
    result = ["doc_id", "n_words", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*result, F.lit(None).cast("long").alias("rank"))
    keyed = scored.select("*", *_key()[:3])
    drawn = eligible & _upto(last)
    winners = running(keyed.where(drawn).orderBy(*KEY).select(*result), name="place")
    losers = keyed.where(~drawn).select(*result, F.lit(None).cast("long").alias("rank"))
    return winners.select(*result, (F.col("place") + 1).alias("rank")).unionAll(losers)


# crc32 by its bitwise definition over the distinct words; ids are unique in documents
_WORDS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)) x),
d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word FROM d),
q AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
b AS (SELECT word, list_transform(range(1, len(hex(word)), 2), lambda i: CAST('0x' || hex(word)[i : i + 1] AS BIGINT)) AS bytes FROM (SELECT word FROM p UNION SELECT word FROM q) x),
k AS (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM b, tab),
s AS (SELECT bucket, count(*) AS n FROM p JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM q JOIN k USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM p) + {BUCKETS}) / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM q) + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
f AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM p JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id),
h AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT AS h FROM d LEFT JOIN f USING (doc_id)),
c AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM h),
r AS (SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS n FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * {SHARE[0]} // {SHARE[1]} THEN place END AS rank FROM r"""


@query("op11_importance_resampling", ORACLE)
def op11_importance_resampling(spark, sf_dir):
    found = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
