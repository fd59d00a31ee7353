"""Running totals over all rows of a table, with no task that sees them all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from titleloom.llm.common import stored


def running(df: DataFrame, weight: Column | None = None, cell: Column | None = None, name: str = "before") -> DataFrame:
    """df with `name`: the weights (1) of all rows of the same cell in front of each row, summed (runs a write).

    In front is what lies in an earlier partition or further up in the same one;
    sort df to number it in an order. Cells are few: each task adds up its own
    rows, and one row per task and cell shifts them. Null cells are a cell.
    """
    weight, cell = F.lit(1) if weight is None else weight, F.lit(0) if cell is None else cell
    rows = df.select("*", cell.cast("long").alias("__cell"), weight.cast("long").alias("__weight"))
    extra = [T.StructField("__part", T.LongType()), T.StructField("__local", T.LongType())]
    schema = T.StructType([*rows.schema.fields, *extra])
    arrow, width = to_arrow_schema(schema), len(rows.columns)

    def per_partition(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            cells, weights = b.column(width - 2), b.column(width - 1).to_numpy(zero_copy_only=False)
            values = cells.to_numpy(zero_copy_only=False)
            values = np.where(cells.is_null().to_numpy(zero_copy_only=False), -(1 << 62), values).astype(np.int64)
            local = np.zeros(b.num_rows, np.int64)
            for value in np.unique(values).tolist():
                at = np.flatnonzero(values == value)
                upto = seen.get(value, 0) + np.cumsum(weights[at])
                local[at], seen[value] = upto - weights[at], int(upto[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int64)), pa.array(local)], schema=arrow)

    dealt = stored(rows.mapInArrow(per_partition, schema), "running")
    sums = dealt.groupBy("__part", "__cell").agg(F.sum("__weight").alias("__sum"))
    front = Window.partitionBy("__cell").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(F.col("__part").alias("__of"), F.col("__cell").alias("__in"), F.coalesce(F.sum("__sum").over(front), F.lit(0)).alias("__shift"))
    same = (F.col("__part") == F.col("__of")) & F.col("__cell").eqNullSafe(F.col("__in"))
    joined = dealt.join(F.broadcast(shifts), same)  # one row per task and cell
    return joined.select(*df.columns, (F.col("__local") + F.col("__shift")).alias(name))
