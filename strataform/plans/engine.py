"""An engine over one schema: batches of events go in, snapshots come out."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataform.functions.lineage import cut
from strataform.operators.rollup import rollup
from strataform.operators.snapshot import Snapshot
from strataform.plans.schema import RollupSchema
from strataform.streaming.events import stream_rollup, window_micros, with_lateness


COUNTERS = ("events_processed", "memory_to_disk_spills", "ttl_evictions", "backpressure_rejections", "late_event_drops", "last_inference_ms", "insight_failures")
#: Batches whose plans are held together.
HELD = 64


@dataclass(frozen=True)
class Window:
    """strategy: Continuous, Tumbling, Sliding or Session; ts: the events' time column."""

    strategy: str = "Continuous"
    size_micros: int = 0
    slide_micros: int | None = None
    gap_micros: int | None = None
    ts: str = "ts"


@dataclass
class Engine:
    """Holds plans, not rows: nothing runs before a snapshot is read. max_batches is the back-pressure: further batches are
    refused until flush() has cut what is held; without it, batches are cut into one whenever HELD of them are held, so the
    plan stays small. Lateness is judged against the greatest time of all batches so far."""

    spark: SparkSession
    schema: RollupSchema
    window: Window = field(default_factory=Window)
    allowed_lateness_seconds: int | None = None
    max_batches: int = 0
    _batches: list[DataFrame] = field(default_factory=list)
    _uncounted: list[DataFrame] = field(default_factory=list)
    _watermark: datetime | None = None
    _counters: dict[str, float] = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))

    def add(self, events: DataFrame) -> None:
        """Takes all rows: no lateness, no back-pressure."""
        self._take(events)
        self._uncounted.append(events)

    def _take(self, events: DataFrame) -> None:
        self._batches.append(events)
        if not self.max_batches and len(self._batches) >= HELD:
            self.flush()

    def try_add(self, events: DataFrame, arrival: str | None = None) -> str:
        """Accepted, Backpressure if max_batches are held, or DroppedLate if all rows were late. Late rows are dropped and
        counted if a lateness is set; arrival names the column of their order (the event time if there is none)."""
        if self.max_batches and len(self._batches) >= self.max_batches:
            self._counters["backpressure_rejections"] += 1
            return "Backpressure"
        if self.allowed_lateness_seconds is not None:
            rows = with_lateness(events, self.window.ts, [F.col(arrival or self.window.ts)], self.allowed_lateness_seconds)
            if self._watermark is not None:
                before = F.lit(self._watermark).cast("timestamp") - F.expr(f"INTERVAL {self.allowed_lateness_seconds} SECONDS")
                rows = rows.withColumn("late", F.col("late") | F.coalesce(F.col(self.window.ts).cast("timestamp") < before, F.lit(False)))
            rows = cut(rows)
            seen = rows.agg(F.max(F.when(~F.col("late"), F.col(self.window.ts).cast("timestamp"))).alias("top"), F.count_if("late").alias("late"), F.count_if(~F.col("late")).alias("n")).first()
            self._counters["late_event_drops"] += seen.late
            self._counters["events_processed"] += seen.n
            self._watermark = max(x for x in (self._watermark, seen.top) if x is not None) if seen.top or self._watermark else None
            if seen.late and not seen.n:
                return "DroppedLate"
            self._take(rows.where("NOT late").drop("late"))
        else:
            self.add(events)
        return "Accepted"

    def flush(self) -> None:
        """One batch, written to the shared folder, instead of those that are held."""
        if self._batches:
            self._batches = [cut(self.events())]
            self.record("memory_to_disk_spills")

    def events(self) -> DataFrame:
        if not self._batches:
            raise ValueError("no events")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self._batches)

    def derive_snapshot(self, projection: set[str] | None = None) -> Snapshot:
        w = self.window
        size = window_micros(w.strategy, w.size_micros, w.slide_micros, w.gap_micros)
        rows = rollup(self.events(), self.schema, projection, window_ts=F.col(w.ts) if size else None, window_micros=size)
        return Snapshot(rows, datetime.now(timezone.utc).replace(tzinfo=None), self.schema.primary_metric)

    def clear(self) -> None:
        self._batches, self._watermark = [], None

    def record(self, counter: str, n: float = 1) -> None:
        """Adds to a counter; the length of the last inference is set."""
        self._counters[counter] = n if counter == "last_inference_ms" else self._counters[counter] + n

    def diagnostics(self) -> dict[str, float]:
        """All counters. Batches that were taken as they are get counted here, each once."""
        self._counters["events_processed"] += sum(x.count() for x in self._uncounted)
        self._uncounted = []
        return dict(self._counters)

    def stream(self, events: DataFrame, checkpoint: str, path: str) -> StreamingQuery:
        """The same rollup over a streaming DataFrame; its cells are kept under path."""
        w = self.window
        size = window_micros(w.strategy, w.size_micros, w.slide_micros, w.gap_micros)
        return stream_rollup(events, self.schema, checkpoint, path, window_ts=F.col(w.ts) if size else None, window_micros=size)
