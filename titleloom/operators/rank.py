"""Top-k, upsert, ordering and change points.

Every order ends with a unique key, so results do not depend on arrival. Top-k
windows keep the literal limit next to the row number: Spark then cuts every
map task to k rows per group before the shuffle, so a hot group costs no more
than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleloom import rules
from titleloom.functions import attributes as A
from titleloom.workspace import new_folder


def top_k(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of every group with their row number."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def best_per_tier(
    scored: DataFrame,
    query: str = "query_id",
    key: str = "row_key",
    k: int = rules.TOP_PER_TIER,
) -> DataFrame:
    """Best k listings per query and tier, with the tier's place in tier_order."""
    order = [
        F.col("confidence").desc(), F.col("relevance_score").desc(),
        F.col("seeders").desc(), F.col("size_bytes").desc(), F.col(key).asc(),
    ]
    place = {name: i + 1 for i, name in enumerate(rules.SEARCH_TIERS)}
    kept = scored.where(F.col("tier").isin(*rules.SEARCH_TIERS))
    return top_k(kept, [query, "tier"], order, k).withColumn(
        "tier_order", A.table_value(F.col("tier"), place, len(place) + 1)
    )


def keyed_upsert(df: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """Last write wins per key; first_arrival keeps the key's first position.

    One aggregation: both extremes combine on the map side, so a key with many
    versions never gathers in one task.
    """
    at = F.struct(*[F.col(c) for c in arrival])
    values = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(last_row(df, values, arrival).alias("last"), F.min(at).alias("first_arrival"))
    return rows.select(*keys, *[F.col("last")[c].alias(c) for c in values], "first_arrival")


def last_row(df: DataFrame, values: Sequence[str], arrival: Sequence[str]) -> Column:
    """Struct of at least the values of the row that arrived last, for an aggregation.

    The arrival leads the struct, so the largest struct is the last row: max_by
    would carry the arrival a second time through the shuffle. Columns without
    an order, as maps, need it.
    """
    at = F.struct(*[F.col(c) for c in arrival])
    rest = [c for c in values if c not in arrival]
    if any(_unordered(df.schema[c].dataType) for c in rest):
        return F.max_by(F.struct(*[F.col(c) for c in values]), at)
    return F.max(F.struct(*[F.col(c) for c in (*arrival, *rest)]))


def _unordered(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_unordered(f.dataType) for f in kind.fields)
    return _unordered(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, (T.MapType, T.VariantType))


def catalogue_order(tier: Column, seeds: Column, title: Column, key: Column) -> list[Column]:
    """Tier score, seeds, then the title in Unicode collation."""
    return [
        A.table_value(tier, rules.CURATED_TIER_SCORE, 0).desc(),
        seeds.desc(),
        F.collate(title, "UNICODE").asc(),
        key.asc(),
    ]


def delivery_rank(
    df: DataFrame, request: Sequence[str], tier: str = "tier", seeders: str = "seeders",
    key: str = "row_key", k: int = rules.DELIVERY_LIMIT,
) -> DataFrame:
    """Valid tiers only, best tier first, stable in lookup order, top k per request."""
    low = F.lower(F.col(tier))
    valid = df.where(low.isin(*rules.DELIVERY_TIER_RANK))
    order = [
        A.table_value(low, rules.DELIVERY_TIER_RANK, 0).desc(),
        F.col(seeders).desc_nulls_first(),
        F.col(key).asc(),
    ]
    return top_k(valid, request, order, k)


def indexer_score(title: Column, seeds: Column) -> Column:
    return A.tier_score(title) + F.coalesce(seeds, F.lit(0)) / F.lit(100.0)


def positions_within(
    df: DataFrame, group: Sequence[str], level: Sequence[str], tie: Sequence[str | Column], name: str
) -> DataFrame:
    """Row number of every row in its group, ordered by level then tie (runs a write).

    Rows are dealt by ranges of (group, level, tie) and written to the shared
    folder with their part, so a group of any size, also one whose rows share a
    level, lies in as many parts as it needs. Rows are numbered inside (part,
    group) and shifted by the group's rows in the parts in front.
    """
    spark, order = df.sparkSession, [*group, *level, *tie]
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    path = new_folder(spark, "positions")
    ranged.write.option("compression", "zstd").parquet(path)
    dealt = spark.read.schema(ranged.schema).parquet(path)
    inner = Window.partitionBy("_part", *group).orderBy(*level, *tie)
    sizes = dealt.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(
        *[F.col(c).alias(f"_{c}") for c in group],
        F.col("_part").alias("_of"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group] + [F.col("_part") == F.col("_of")]
    numbered = dealt.withColumn("_k", F.row_number().over(inner)).join(shift, same, "inner")
    return numbered.withColumn(name, (F.col("_shift") + F.col("_k")).cast("bigint")).drop("_shift", "_part", "_of", "_k", *[f"_{c}" for c in group])


def previous_row(
    df: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str], bucket: Column,
    name: str = "previous",
) -> DataFrame:
    """Add the struct of values of the row before, per key, also for hot keys.

    lag runs inside (key, bucket); only the last row of each bucket travels to
    the next non-empty one. bucket must not decrease along the order; the result
    keeps it as _bucket. Null keys are a key, and a null bucket comes first.
    """
    keyed = df.withColumn("_bucket", bucket)
    at = F.struct(*[F.col(c) for c in order])
    row = F.struct(*[F.col(c) for c in values])
    last = keyed.groupBy(*key, "_bucket").agg(F.max_by(row, at).alias("_last"))
    carried = last.select(
        *[F.col(c).alias(f"_{c}") for c in key],
        F.col("_bucket").alias("_b"),
        F.lag("_last").over(Window.partitionBy(*key).orderBy("_bucket")).alias("_carried"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key] + [F.col("_bucket").eqNullSafe(F.col("_b"))]
    inner = Window.partitionBy(*key, "_bucket").orderBy(*order)
    return (
        keyed.join(carried, same, "inner")
        .withColumn("_first", F.row_number().over(inner) == 1)
        .withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.lag(row).over(inner)))
        .drop("_b", "_carried", "_first", *[f"_{c}" for c in key])
    )


def running_total(
    df: DataFrame, key: Sequence[str], order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Add the running sum of value per key, also for hot keys.

    df comes from previous_row: it has _bucket and is partitioned by it.
    """
    keyed = df.withColumn("_value", value)
    sums = keyed.groupBy(*key, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(
        *[F.col(c).alias(f"_{c}") for c in key],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key] + [F.col("_bucket").eqNullSafe(F.col("_b"))]
    inner = Window.partitionBy(*key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        keyed.join(shift, same, "inner")
        .withColumn(name, F.col("_shift") + F.sum("_value").over(inner))
        .drop("_bucket", "_b", "_value", "_shift", *[f"_{c}" for c in key])
    )


def change_points(
    df: DataFrame, key: str, at: Sequence[str], watched: Sequence[str], bucket: Column
) -> DataFrame:
    """Rows whose watched values differ from the row before (null-safe)."""
    seen = previous_row(df, [key], at, watched, bucket).drop("_bucket")
    same = F.lit(True)
    for c in watched:
        same = same & F.col(c).eqNullSafe(F.col("previous")[c])
    return seen.where(F.col("previous").isNull() | ~same).drop("previous")
