"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titleloom.workspace import new_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame and, where SQL can express it, its oracle."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, there again after a lost executor."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables of `stored` that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def pieces_of(texts: pa.Array, most: int = 4096, size: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Slices of a batch of texts that hold a bounded number of rows and bytes (one text at least)."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > start and (i - start >= most or held + (n or 0) > size):
            yield start, i
            start, held = i, 0
        held += n or 0
    if start < len(texts):
        yield start, len(texts)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def remainder(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; an id that is null counts as the text "null"."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % n
