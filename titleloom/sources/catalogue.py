"""Catalogue documents and the catalogue table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleloom import schemas
from titleloom.functions import attributes as A
from titleloom.operators import quality
from titleloom.operators.rank import keyed_upsert
from titleloom.workspace import open_writers


def entries_of(documents: DataFrame, array: str, as_of: Column) -> DataFrame:
    """One row per entry of the documents' arrays; no addedAt means as_of."""
    rows = documents.select(F.inline(array))
    return rows.withColumn("addedAt", F.coalesce("addedAt", as_of.cast("timestamp")))


def curated_gate(entries: DataFrame, link_prefix: str = "magnet:?") -> DataFrame:
    return quality.gate(
        entries, ["imdbId", "title", "magnet", "quality", "seeds"],
        link="magnet", work_id="imdbId", tier="quality", seeds="seeds", link_prefix=link_prefix,
    )


def read_catalogue(
    spark: SparkSession, path: str | Sequence[str], as_of: Column, link_prefix: str = "magnet:?", multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine) entries of JSON catalogue documents.

    With multi_line a document is one file, which is then the unit of
    parallelism; without it files hold one document per line and split freely.
    Documents without the array contribute nothing. A document that does not
    parse gives one quarantined row without an entry, and no good ones: its
    failure is "document", or "document_part" where some of it could be read.
    """
    broken = "_broken"
    schema = T.StructType([*schemas.CATALOGUE.fields, T.StructField(broken, T.StringType())])
    read = spark.read.schema(schema).option("columnNameOfCorruptRecord", broken).option("multiLine", multi_line)
    documents = read.json(path)
    gated = curated_gate(entries_of(documents.where(F.col(broken).isNull()), "magnets", as_of), link_prefix)
    failure = F.when(F.size("magnets") > 0, "document_part").otherwise("document")
    lost = documents.where(F.col(broken).isNotNull()).select(failure.alias("first_failure"))
    lost = lost.withColumn("failures", F.array("first_failure"))
    return quality.good(gated), quality.quarantine(gated).unionByName(lost, allowMissingColumns=True)


def append_catalogue(df: DataFrame, path: str, partition_by: str | None = "type") -> None:
    """Append listings to the catalogue table (runs the write)."""
    writer = df.write.mode("append").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with open_writers(df.sparkSession):
        writer.parquet(path)


def load_catalogue(df: DataFrame, work_id: str, link: str, arrival: Sequence[str]) -> DataFrame:
    """Current state of an appended catalogue: ids normalised, last write wins."""
    return keyed_upsert(df.withColumn(work_id, A.base_id(F.col(work_id))), [work_id, link], arrival)


def write_table(df: DataFrame, path: str, schema, partition_by: Sequence[str] = ()) -> None:
    """Write a keyed table with exactly the given schema (runs the write)."""
    shaped = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    writer = shaped.write.mode("errorifexists").option("compression", "zstd").partitionBy(*partition_by)
    with open_writers(df.sparkSession):
        writer.parquet(path)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def item_table(df: DataFrame) -> DataFrame:
    """Shape items (see the v_item fixture) as the keyed item table."""
    return df.select(
        F.col("group_id").alias("item_id"), "content_hash", F.col("season").alias("item_index"), F.col("path").alias("title"),
        F.col("bytes").alias("size_bytes"), "work_id", "season", "episode",
        F.col("group_id").alias("alt_id"), F.col("episode").alias("alt_episode"),
    )


def attachment_table(df: DataFrame, suffix: str = ".txt") -> DataFrame:
    """Shape the items that are no media as the keyed attachment table."""
    files = item_table(df).where(F.endswith("title", F.lit(suffix)))
    return files.select("content_hash", "item_index", "item_id", "title", "size_bytes")


def listing_table(df: DataFrame) -> DataFrame:
    """Shape listings (see the v_listing fixture) as the keyed listing table."""
    return df.select(
        "content_hash", "provider", F.col("row_key").alias("source_id"), F.col("raw_title").alias("title"),
        F.col("size_bytes").cast("bigint").alias("size_bytes"),
        F.when(A.episode_id(F.col("composite_id")).isNull(), "movie").otherwise("series").alias("type"),
        F.col("arrived_at").cast("timestamp").alias("uploaded_at"),
        F.col("seeders").cast("smallint").alias("seeders"),
        A.repeated_parameter(F.col("link"), "tr").alias("trackers"),
        A.language_list(A.language_tag(F.col("raw_title"))).alias("languages"),
        A.tier(F.col("raw_title")).alias("tier"),
    )
