"""What snapshots and cells are read from and written to."""

from __future__ import annotations

import time
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.operators.snapshot import Snapshot


def export_snapshot(snapshot: Snapshot, path: str) -> None:
    """Long rows as Parquet, a folder for each dimension."""
    snapshot.long().write.mode("overwrite").partitionBy("dimension").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("dimension", "key", "metric", "value", "generated_at")


def write_cells(cells: DataFrame, path: str) -> None:
    """Cell states by dimension, in ranges of keys and sorted within files, so that reads prune by both. There are as many
    ranges as the data need, whatever the number of dimensions."""
    cells.repartitionByRange("dimension", "key").sortWithinPartitions("dimension", "key").write.mode("overwrite").partitionBy("dimension").parquet(path)


def read_cells(spark: SparkSession, path: str, metrics: list[str] | None = None, keys_only: bool = False) -> DataFrame:
    """All cells, or only some metrics' columns of them."""
    rows = spark.read.parquet(path)
    if keys_only:
        return rows.select("dimension", "key")
    return rows if metrics is None else rows.select("dimension", "key", *metrics)


def prune(spark: SparkSession, folder: str, max_files: int | None = None, max_age: timedelta | None = None, now: float | None = None, suffix: str = ".parquet") -> list[str]:
    """Deletes files and Parquet folders directly in a folder, newest first, that are older than max_age or beyond max_files;
    returns their names. The folder is anywhere Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    now = time.time() if now is None else now
    found = [(s.getModificationTime() / 1000, s.getPath()) for s in fs.listStatus(at) if s.getPath().getName().endswith(suffix)]
    found.sort(key=lambda x: (-x[0], x[1].getName()))
    gone = [p for i, (t, p) in enumerate(found) if max_age is not None and now - t > max_age.total_seconds() or max_files is not None and i >= max_files]
    for p in gone:
        fs.delete(p, True)
    return [p.getName() for p in gone]


def message_events(spark: SparkSession, n: int, seed: int = 42, start: str = "2026-01-15 00:00:00") -> DataFrame:
    """Synthetic message events: one carrier's promotional messages get rejected more in the last third."""
    pick = lambda names, s: F.element_at(F.array(*map(F.lit, names)), (F.floor(F.rand(s) * len(names)) + 1).cast("int"))
    rows = spark.range(n).select("id", pick(["mtn", "vodacom", "cellc", "telkom"], seed).alias("carrier"), pick(["promotional", "transactional", "otp"], seed + 1).alias("message_type"), F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + F.col("id") % 86400).alias("ts"), F.rand(seed + 2).alias("u"))
    bad = (F.col("carrier") == "mtn") & (F.col("message_type") == "promotional") & (F.col("id") >= n * 2 // 3)
    edge = F.when(bad, 0.20).otherwise(0.02)
    one = lambda a, b: ((F.col("u") >= a) & (F.col("u") < b)).cast("long")
    edges = [F.lit(0.0), edge, edge + 0.05, edge + 0.07, edge + 0.075, edge + 0.085]
    kinds = [one(a, b).alias(k) for k, a, b in zip(("rejectd", "expired", "undeliv", "spam", "cancelled"), edges, edges[1:])]
    return rows.select("carrier", "message_type", "ts", *kinds, (F.col("u") >= edges[-1]).cast("long").alias("delivered"), (F.rand(seed + 3) < 0.03).cast("long").alias("replies"), (F.rand(seed + 4) < 0.005).cast("long").alias("opt_outs"))


def hourly_events(spark: SparkSession, days: int, per_hour: int = 100, seed: int = 42, start: str = "2026-01-01 00:00:00") -> DataFrame:
    """Synthetic traffic by the hour: quiet nights, weekends at 60 %, a tenth more each week, and noise."""
    hours = spark.range(days * 24).withColumn("ts", F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + F.col("id") * 3600))
    shape = (1 + F.sin((F.hour("ts") - 8) * F.lit(3.141592653589793 / 12))) * F.when(F.dayofweek("ts").isin(1, 7), 0.6).otherwise(1.0) * F.pow(F.lit(1.1), F.floor(F.col("id") / 168))
    n = F.greatest(F.lit(1), F.round(per_hour * shape * (0.9 + 0.2 * F.rand(seed)))).cast("int")
    return hours.select("ts", F.explode(F.sequence(F.lit(1), n)).alias("n")).select((F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("n") % 60)).alias("ts"), F.element_at(F.array(*map(F.lit, ("voice", "sms", "data"))), (F.col("n") % 3 + 1).cast("int")).alias("channel"))
