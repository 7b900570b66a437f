"""Cutting the lineage of a plan in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset the one that was set on the
    context, or a temporary one in local mode, where driver and executors are one process."""
    named, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if named is None and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written to that folder: what reads it later sees the same rows in the same partitions, whatever is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def sums_before(rows: DataFrame, by: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over the rows of the same by that are before them in order (which must be total within by).
    Rows are cut into ranges, each range's sums are carried on, and a window works within ranges, so no task sees all rows
    of one by. The carried table has a row for each range and by in it."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # range bounds are sampled anew by each run of a plan, so both uses must see one run
    parts = cut(rows.withColumn("_v", value).repartitionByRange(n, by, *order).withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy(by).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    tops = parts.groupBy("_p", by).agg(F.sum("_v").alias("_s"), F.min(F.struct(*order)).alias("_first"))
    carried = tops.withColumn("_carried", F.coalesce(F.sum("_s").over(before), F.lit(0))).select("_p", by, "_carried")
    within = F.coalesce(F.sum("_v").over(Window.partitionBy("_p", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(F.broadcast(carried), ["_p", by]).withColumn(name, within + F.col("_carried")).drop("_v", "_p", "_carried")
