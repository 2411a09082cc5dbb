"""Running sums and ranks over whole tables without a task that reads all rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.functions.stored import stored

#: Rows of a range: of order columns and one number each, so a range is some tens of megabytes at any size of the table.
RANGE_ROWS = 1_000_000


def running(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of whole numbers `value` over all rows before each, in the order of columns that are unique together, texts or numbers.

    df is read twice, so it should be a table or stored. Only the order and the value are moved: they are dealt in ranges of the order, sorted there, and stored; the driver adds up
    one sum for each range, and each range then goes on from what the ranges before it hold. Each row of df meets its own sum.
    """
    return df.join(placed(df, order, value, name), order)


def placed(df: DataFrame, order: list[str], value: str | None, name: str) -> DataFrame:
    """The order columns of df with the sum of `value` over all rows before each; without a value, the rank from 0."""
    part, number = "_range", "_value"
    rows = stored(df.select(*order, (F.lit(1) if value is None else F.col(value)).cast("long").alias(number)))
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    dealt = rows.repartitionByRange(ranges, *order) if ranges > 1 else rows.coalesce(1)
    dealt = stored(dealt.sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()))
    sums = sorted(tuple(r) for r in dealt.groupBy(part).agg(F.sum(number)).collect())
    before = dict(zip((p for p, _ in sums), accumulate((n or 0 for _, n in sums), initial=0), strict=False))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if total is None:
                total = before[batch.column(part)[0].as_py()]
            values = batch.column(number).fill_null(0).to_numpy(zero_copy_only=False)
            ends = total + np.cumsum(values)
            total = int(ends[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in order), pa.array(ends - values, pa.int64())], [*order, name])

    schema = T.StructType([*(T.StructField(c, dealt.schema[c].dataType) for c in order), T.StructField(name, T.LongType())])
    return dealt.mapInArrow(add, schema)
