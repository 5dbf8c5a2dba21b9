"""Places and running sums within keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written


def running(df: DataFrame, key: str, order: list[Column], weight: Column | None = None, place: str = "place", before: str = "before", blocks: int | None = None) -> DataFrame:
    """df with its place (from 1) within key by order, and the sum of weight over the rows before it.

    A window over the key alone would put all rows of a key into one task. Here rows are ranged by key and
    order into blocks of about equal size; a window runs within each block, the blocks' own counts and sums
    run over the few blocks of a key, and one equi-join adds the two. order must be unique within a key."""
    w = F.lit(0) if weight is None else weight
    rows = df.withColumn("_w", w)
    ranged = rows.repartitionByRange(blocks, F.col(key), *order) if blocks else rows.repartitionByRange(F.col(key), *order)
    ranged = written(ranged.withColumn("_block", F.spark_partition_id()))
    inside = Window.partitionBy(key, "_block").orderBy(*order)
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_s"))
    sums = sums.select(
        key, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0")
    )
    local = ranged.withColumn("_k", F.row_number().over(inside)).withColumn(
        "_b", F.coalesce(F.sum("_w").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    out = local.join(sums, [key, "_block"])
    return out.select(*df.columns, (F.col("_k") + F.col("_n0")).cast("long").alias(place), (F.col("_b") + F.col("_s0")).alias(before))
