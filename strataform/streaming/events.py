"""Event-time operators. The batch forms follow an arrival order row by row; the streaming forms are Spark's own."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataform.functions.lineage import cut
from strataform.operators.rollup import rollup
from strataform.plans.schema import RollupSchema


def window_micros(strategy: str, size_micros: int, slide_micros: int | None = None, gap_micros: int | None = None) -> int:
    """The bucket size of a strategy: every event goes to one bucket, aligned to the size, the slide (half the size by
    default) or the gap. Continuous has no buckets."""
    if strategy == "Continuous":
        return 0
    if strategy == "Tumbling":
        return size_micros
    if strategy == "Sliding":
        return slide_micros or size_micros // 2
    if strategy == "Session":
        return gap_micros or size_micros
    raise ValueError(f"strategy: {strategy!r}")


def with_lateness(events: DataFrame, ts: str, arrival: Iterable[Column], lateness_seconds: int, by: str | None = None) -> DataFrame:
    """events with late: whether the time is more than lateness_seconds before the greatest time that arrived earlier. One
    watermark for all rows is a sequence by nature: rows are cut into ranges of arrival order, the maximum of each range
    is carried on, and within a range a running maximum does the rest, so no task sees all rows."""
    order = F.struct(*arrival)
    rows = events.withColumn("_o", order).withColumn("_ts", F.col(ts).cast("timestamp"))
    if by is not None:
        best = F.max("_ts").over(Window.partitionBy(by).orderBy("_o").rowsBetween(Window.unboundedPreceding, -1))
        return rows.withColumn("late", F.coalesce(F.col("_ts") < best - F.expr(f"INTERVAL {lateness_seconds} SECONDS"), F.lit(False))).drop("_o", "_ts")
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # range bounds are sampled anew by each run of a plan, so both uses must see one run
    parts = cut(rows.repartitionByRange(n, "_o").withColumn("_p", F.spark_partition_id()))
    # ranges in order of their first row; as many rows as there are partitions
    tops = parts.groupBy("_p").agg(F.max("_ts").alias("_top"), F.min("_o").alias("_first"))
    carried = tops.withColumn("_before", F.max("_top").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1))).select("_p", "_before")
    within = F.max("_ts").over(Window.partitionBy("_p").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1))
    rows = parts.join(F.broadcast(carried), "_p").withColumn("_best", F.greatest(within, F.col("_before")))
    return rows.withColumn("late", F.coalesce(F.col("_ts") < F.col("_best") - F.expr(f"INTERVAL {lateness_seconds} SECONDS"), F.lit(False))).drop("_o", "_ts", "_p", "_before", "_best")


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Sessions by gaps, an extension beside the bucket form: key, session_start, session_end, n_events."""
    w = F.session_window(F.col(ts).cast("timestamp"), gap)
    return events.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def scavenge(cells: DataFrame, last_access: str, now: Column, ttl: str) -> DataFrame:
    """The cells that were touched within ttl before now."""
    return cells.where(F.col(last_access) >= now - F.expr(f"INTERVAL {ttl}"))


def diagnostics(events: DataFrame) -> DataFrame:
    """One row from with_lateness(): events_processed and late_event_drops."""
    return events.agg(F.count_if(~F.col("late")).alias("events_processed"), F.count_if("late").alias("late_event_drops"))


def stream_rollup(events: DataFrame, schema: RollupSchema, checkpoint: str, path: str, **options) -> StreamingQuery:
    """The rollup of a streaming DataFrame, run until it has taken everything. State is the cells alone; after each trigger the
    cells that changed are written under path, a folder a batch, which a repeated batch overwrites. stream_cells() reads them."""

    def keep(cells: DataFrame, batch: int) -> None:
        cells.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return rollup(events, schema, **options).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_cells(spark: SparkSession, path: str) -> DataFrame:
    """Each cell as the last batch that changed it left it."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in ("dimension", "key", "batch")]
    return rows.groupBy("dimension", "key").agg(F.max_by(F.struct(*values), "batch").alias("_c")).select("dimension", "key", *[F.col(f"_c.{c}").alias(c) for c in values])


def refresh_insights(events: DataFrame, schema: RollupSchema, checkpoint: str, path: str, refresh: Callable[[DataFrame], None], failed: Callable[[Exception], None], every: str | None = "500 milliseconds", **options) -> StreamingQuery:
    """Calls refresh with the cells after each trigger. What arrives while it runs waits and is taken together, so the latest
    state wins; an error of refresh goes to failed and the stream goes on. Without every it runs until all is taken."""

    def keep(cells: DataFrame, batch: int) -> None:
        cells.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        try:
            refresh(stream_cells(cells.sparkSession, path))
        except Exception as e:  # noqa: BLE001  insights never stop the counting
            failed(e)

    stream = rollup(events, schema, **options).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
    return stream.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def windowed_stream(events: DataFrame, schema: RollupSchema, ts: str, size: str, lateness: str) -> DataFrame:
    """A streaming rollup with Spark's watermark: dimension, key, window_start and metrics, for append mode."""
    from strataform.operators.rollup import _aggregates, fan_out

    carry, out = _aggregates(schema, None)
    rows = fan_out(events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness), schema.dimensions, [*carry, F.col("_ts").alias("event_ts")])
    return rows.groupBy("dimension", "key", F.window("event_ts", size).alias("w")).agg(*out).withColumn("window_start", F.col("w.start")).drop("w")
