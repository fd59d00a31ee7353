"""Tables that lie ready for joins on their key: bucketed and sorted by it."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from titleloom.workspace import new_folder


def write_keyed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None) -> str:
    """Write df as a table of `buckets` buckets by keys, each sorted (runs the write); returns its full name.

    Rows are dealt to their buckets before the write, so a bucket is one sorted
    file. Joins of tables with the same keys and number of buckets, on all
    keys, move neither side. The files lie in path (a new shared folder) and
    stay there; register() makes the table known to another session. Choose
    buckets for files of some hundred MB; a hot key fills one bucket.
    """
    spark = df.sparkSession
    full = f"{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    writer = dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("compression", "zstd").option("path", path or new_folder(spark, name)).saveAsTable(full)
    return full


def register(spark: SparkSession, name: str, path: str, schema: T.StructType, keys: Sequence[str], buckets: int) -> DataFrame:
    """Make a table that write_keyed left in path known as `name`."""
    by = ", ".join(f"`{k}`" for k in keys)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
