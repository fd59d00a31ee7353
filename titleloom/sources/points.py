"""Point reads: a few keys of a large table, without reading the rest of it."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titleloom.operators import lookup
from titleloom.workspace import new_folder

KEY_LIMIT = 10_000
ROW_GROUP_BYTES = 64 << 20
PAGE_ROWS = 1_000
PAGE_KEYS = 500


def _written(rows: DataFrame, name: str, key: str, buckets: int, row_group_bytes: int, mode: str, path: str | None) -> None:
    dealt = rows.repartition(buckets, key)
    writer = dealt.write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key)
    # the filter sizes itself: several candidates are kept until the number of keys is known
    writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    writer = writer.option("parquet.block.size", str(row_group_bytes)).option("parquet.page.row.count.limit", str(PAGE_ROWS))
    (writer.option("path", path) if path else writer).saveAsTable(name)


def write_points(rows: DataFrame, name: str, key: str, buckets: int, row_group_bytes: int = ROW_GROUP_BYTES, path: str | None = None) -> str:
    """Write rows for reads by key (runs the write); returns the table's full name.

    The table is bucketed and sorted by key, and every row group has a Bloom
    filter of its keys: a read of some keys opens the files of their buckets,
    in them the row groups that may hold one, and of these the pages of about
    PAGE_ROWS rows whose range of keys holds one. Choose buckets for files of
    some hundred MB.
    """
    full = f"{name}_{uuid.uuid4().hex}"
    _written(rows, full, key, buckets, row_group_bytes, "errorifexists", path or new_folder(rows.sparkSession, name))
    return full


def append_points(rows: DataFrame, table: str, key: str, buckets: int, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Add rows to a table of write_points with the same key and buckets (runs the write): new files, none rewritten."""
    columns = rows.sparkSession.table(table).columns
    _written(rows.select(*columns), table, key, buckets, row_group_bytes, "append", None)


def _any_of(column: Column, keys: Sequence) -> Column:
    """Whether the column is one of the keys, as a balanced tree of equalities up to PAGE_KEYS of them.

    Parquet judges pages by each equality, but by the range of a whole list.
    """
    if len(keys) > PAGE_KEYS:
        return column.isin(list(keys))
    terms = [column == F.lit(k) for k in keys]
    while len(terms) > 1:
        terms = [reduce(or_, terms[i:i + 2]) for i in range(0, len(terms), 2)]
    return terms[0]


def fetch_points(table: DataFrame, wanted: DataFrame, key: str, key_limit: int = KEY_LIMIT) -> DataFrame:
    """Rows of a table of write_points whose key is wanted (reads wanted, key_limit + 1 keys at most).

    Up to key_limit distinct keys become a filter that reaches the files; more
    are joined, which scans the key column, with the same result. Null keys
    find nothing.
    """
    distinct = wanted.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    keys = [r[0] for r in distinct.limit(key_limit + 1).collect()]
    if len(keys) > key_limit:
        return lookup.fetch(table, distinct, key)
    if not keys:
        return table.limit(0)
    return table.where(_any_of(F.col(key), keys))


def insert_points(
    spark: SparkSession, table: str, batch: DataFrame, key: str, arrival: Sequence[str], buckets: int, key_limit: int = KEY_LIMIT
) -> None:
    """Append to the table the rows of the batch with new keys, the first arrival of each (reads and writes).

    As in insert_if_absent a null key equals no stored one, so each batch that has any adds one row of it.
    """
    known = fetch_points(spark.table(table), batch, key, key_limit).select(key)
    append_points(lookup.insert_if_absent(known, batch, key, arrival), table, key, buckets)
