"""Places in an order, for frames and groups of any size.

A window over a group puts the group into one task. Here the rows are sorted over all tasks by range, so
the order also cuts a group of any size; each row gets its number inside its task, and the tasks' row counts,
one number each, say how many rows come before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgetide.session import scratch_path

TASK_BITS = 33  # monotonically_increasing_id has the task above these


def in_order(sorted_rows: DataFrame, name: str = "position") -> DataFrame:
    """Zero-based place of each row of a sorted frame. The numbered rows are written first, so that no recomputed
    task can number them anew."""
    spark = sorted_rows.sparkSession
    path = scratch_path(spark, "numbered")
    sorted_rows.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_task", F.shiftright("_at", TASK_BITS))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_task").agg(F.count("*").alias("_n")).select(
        "_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << TASK_BITS) - 1))
    return rows.join(before, "_task").withColumn(name, F.col("_before") + inside).drop("_at", "_task", "_before")


def ordinal(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "ordinal") -> DataFrame:
    """Zero-based place of each row in its group. Groups are not null, and `order` has no ties that matter."""
    placed = in_order(df.orderBy(*group, *order), "_place")
    first = placed.groupBy(*group).agg(F.min("_place").alias("_first"))
    return placed.join(first, list(group)).withColumn(name, F.col("_place") - F.col("_first")).drop("_place", "_first")
