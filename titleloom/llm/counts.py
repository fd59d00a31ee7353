"""Token totals kept by signed deltas.

A change is a row (source, lang, version, docs, tokens) with a sign: an insert
adds, a delete subtracts, a revised count subtracts the old and adds the new.
A batch is summed by its three keys before anything is stored, so totals are
sums over small tables and no document is counted again.

A batch is committed once: its rows go to a folder of their own attempt and
count only from the moment the commit row that names this attempt is there. A
batch id that is committed already is left alone when it is sent again; an
attempt that died before its commit row is never read.

Results: totals have one row per source, language and version with documents
left; null keys are groups of their own. An empty batch commits and changes
nothing. Repeated rows count as often as they stand. Null texts count as empty
(0 tokens). Columns other than those named are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from titleloom.llm.common import batch, documents, pieces_of, query, stored
from titleloom.llm.tokens import WIDTH, encoder
from titleloom.workspace import new_folder

KEYS = ["source", "lang", "version"]
DELTA = "source STRING, lang STRING, version STRING, docs LONG, tokens LONG"


def count_tokens(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The columns of docs but the text, and `tokens`, the number of byte-level BPE ids of the whole text."""
    names = [c for c in docs.columns if c not in (text_col, "tokens")]
    rows = docs.select(*names, text_col)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("tokens", T.LongType())])
    arrow = to_arrow_schema(schema)

    def per_partition(batches):
        encode = encoder(vocabulary).encode
        for b in batches:
            texts = b.column(len(names))
            for start, end in pieces_of(texts):
                part = b.slice(start, end - start)
                yield batch(arrow, [*part.columns[:-1], [len(encode(t.as_py() or "")) // WIDTH for t in texts[start:end]]])

    return rows.mapInArrow(per_partition, schema)


def signed(rows: DataFrame, sign: int, tokens: str = "tokens") -> DataFrame:
    """Rows (source, lang, version, and a count) as changes: sign 1 inserts, -1 deletes."""
    return rows.select(*KEYS, F.lit(sign).cast("long").alias("docs"), (F.col(tokens) * sign).alias("tokens"))


def revised(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Changes that put count `new` in the place of count `old`."""
    return rows.select(*KEYS, F.lit(0).cast("long").alias("docs"), (F.col(new) - F.col(old)).alias("tokens"))


class Rollup:
    """Totals under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.createDataFrame([], DELTA).withColumns({"batch_id": F.lit(""), "attempt": F.lit("")}).write.mode("append").parquet(f"{folder}/deltas")
        spark.createDataFrame([], "batch_id STRING, attempt STRING").write.mode("append").parquet(f"{folder}/commits")

    def committed(self, batch_id: str) -> bool:
        return not self._commits().where(F.col("batch_id") == batch_id).isEmpty()

    def _commits(self) -> DataFrame:
        return self.spark.read.schema("batch_id STRING, attempt STRING").parquet(f"{self.folder}/commits")

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit the batch; False, and no effect, if it is committed already."""
        if self.committed(batch_id):
            return False
        attempt = uuid.uuid4().hex
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")
        sums.withColumns({"batch_id": F.lit(batch_id), "attempt": F.lit(attempt)}).write.mode("append").parquet(f"{self.folder}/deltas")
        self.spark.range(1).select(F.lit(batch_id).alias("batch_id"), F.lit(attempt).alias("attempt")).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens; of two attempts that raced to commit a batch the smaller counts."""
        deltas = self.spark.read.schema(f"{DELTA}, batch_id STRING, attempt STRING").parquet(f"{self.folder}/deltas")
        valid = self._commits().groupBy("batch_id").agg(F.min("attempt").alias("attempt"))
        rows = deltas.join(valid, ["batch_id", "attempt"], "left_semi")
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0")


@query("op3_token_counts")
def op3_token_counts(spark, sf_dir):
    """Load with estimates, revise to exact counts, delete later copies of equal texts; two batches are sent twice."""
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir).select(
        "doc_id", "source", "lang", F.lit("byte_bpe_50k").alias("version"), F.md5(text).alias("copy_of"),
        F.ceil(F.octet_length(text) / 4).alias("estimate"), "text",
    )
    counts = stored(count_tokens(docs), "counts")
    # deleting all of a group of copies and inserting its first again needs no join and splits well
    order = F.struct(F.col("doc_id").isNull(), "doc_id", *KEYS, "tokens")
    kept = counts.groupBy("copy_of").agg(F.min(order).alias("first")).select("first.*")
    rollup = Rollup(spark, new_folder(spark, "rollup"))
    load, recount = signed(counts, 1, "estimate"), revised(counts, "estimate", "tokens")
    for name, changes in (
        ("load", load), ("recount", recount), ("load", load), ("copies", signed(counts, -1).unionByName(signed(kept, 1))), ("recount", recount),
    ):
        rollup.apply(name, changes)
    return rollup.totals()
