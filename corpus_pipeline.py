"""A corpus from raw documents to packed token sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept; between stages the rows are written to the shared folder and read
again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleloom.llm.common import documents, stored
from titleloom.llm.contamination import drop_leaked
from titleloom.llm.languages import keep_identified
from titleloom.llm.lines import drop_repeated_runs
from titleloom.llm.packing import pack
from titleloom.llm.prefixes import drop_similar


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear, learned from those with a label."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later repeats of runs of lines; n_chars follows the text."""
    cut = drop_repeated_runs(docs, removed="__removed")
    chars = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return cut.withColumns(chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 or more of its five-word shingles, with no link missed.

    SimHash fingerprints near each other by anchors give candidates, with MinHash bands
    and prefixes beside them; each is checked on its whole sets.
    """
    return drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is leaked."""
    return drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Compression sizes, components and token ids are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of the last."""
    rows = documents(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if number + 1 < len(STAGES):
            rows = stored(rows, name)
    return rows
