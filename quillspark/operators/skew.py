"""Joins and ranks in which no key and no task holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillspark.operators.durable import cut, stored


def attached(df: DataFrame, table: DataFrame, key: str, hot: int = 1_000_000, n: int | None = None) -> DataFrame:
    """``df`` joined on the left to ``table``, which has one row a key.

    Keys with more than ``hot`` rows in ``df``, or a ten-thousandth of them if that is more (so 10,000 keys at most), meet theirs by a
    broadcast, without a shuffle. ``n``: how many rows ``df`` has at most, if that is known; else they are counted.
    """
    n = df.count() if n is None else n
    if n <= hot:
        return df.join(table, key, "left")
    hubs = cut(df.groupBy(key).count().where(F.col("count") > max(hot, n // 10_000)).select(key))
    marked = df.join(F.broadcast(hubs.withColumn("__hub", F.lit(True))), key, "left")
    few = F.broadcast(table.join(F.broadcast(hubs), key, "left_semi"))
    return marked.where("__hub is null").drop("__hub").join(table, key, "left").unionByName(marked.where("__hub").drop("__hub").join(few, key, "left"))


def ranked(df: DataFrame, order: Sequence[Column | str], name: str, weight: str | None = None) -> DataFrame:
    """``df``, stored, with a rank from 0 in the order of ``order`` (``weight``: the sum of that column over the rows before), which must tell all rows apart.

    Rows are sorted by range and added up as they pass; each partition starts at the total of those before it, and only a number a partition reaches one task.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    sorted_ = sorted_.withColumn("__w", (F.col(weight) if weight else F.lit(1)).cast("bigint"))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            w = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            upto = total + np.cumsum(w)
            total = int(upto[-1]) if len(upto) else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto - w, pa.int64())], [*b.schema.names, "__in"])

    rows = stored(sorted_.mapInArrow(added, StructType([*sorted_.schema.fields, StructField("__in", LongType())])))
    per = rows.groupBy("__part").agg(F.sum("__w").alias("n"))
    base = per.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    out = rows.join(F.broadcast(base), "__part")
    return out.withColumn(name, F.col("__base") + F.col("__in")).drop("__part", "__w", "__base", "__in")
