from datetime import datetime, timedelta

from strataform.plans.engine import Engine, Window
from strataform.plans.schema import RollupSchema

T0 = datetime(2026, 1, 15, 12)


def schema():
    return RollupSchema.builder().dimension("region").count().build()


def frame(spark, *rows):
    return spark.createDataFrame([(r, t) for r, t in rows], "region string, ts timestamp")


def test_batches_windows_and_clear(spark):
    engine = Engine(spark, schema(), Window("Tumbling", 3_600_000_000))
    engine.add(frame(spark, ("east", T0)))
    engine.add(frame(spark, ("east", T0 + timedelta(hours=2)), ("east", T0 + timedelta(minutes=5))))
    want = {"east@20260115120000": 2.0, "east@20260115140000": 1.0}
    for _ in range(2):
        assert {r.key: r["count"] for r in engine.derive_snapshot().rows.collect()} == want
        engine.flush()
    engine.clear()
    engine.add(frame(spark))
    assert engine.derive_snapshot().rows.count() == 0


def test_late_rows_and_back_pressure(spark):
    engine = Engine(spark, schema(), allowed_lateness_seconds=300, max_batches=2)
    assert engine.try_add(frame(spark, ("a", T0))) == "Accepted"
    assert engine.try_add(frame(spark, ("a", T0 - timedelta(minutes=10)), ("a", T0 - timedelta(minutes=5)))) == "Accepted"
    assert engine.try_add(frame(spark, ("a", T0))) == "Backpressure"
    found = engine.diagnostics()
    assert found["events_processed"] == 2 and found["late_event_drops"] == 1 and found["backpressure_rejections"] == 1 and len(found) == 7
    assert engine.derive_snapshot().rows.first()["count"] == 2.0


def test_counters_without_lateness_and_dropped_batches(spark):
    engine = Engine(spark, schema())
    engine.add(frame(spark, ("a", T0), ("b", T0)))
    assert engine.try_add(frame(spark, ("a", T0))) == "Accepted"
    assert engine.diagnostics()["events_processed"] == 3 == engine.diagnostics()["events_processed"]
    engine.flush()
    engine.record("ttl_evictions", 2)
    engine.record("last_inference_ms", 5.5)
    assert {k: v for k, v in engine.diagnostics().items() if v} == {"events_processed": 3, "memory_to_disk_spills": 1, "ttl_evictions": 2, "last_inference_ms": 5.5}
    strict = Engine(spark, schema(), allowed_lateness_seconds=60)
    assert strict.try_add(frame(spark, ("a", T0))) == "Accepted"
    assert strict.try_add(frame(spark, ("a", T0 - timedelta(hours=1)))) == "DroppedLate"
    assert strict.diagnostics()["late_event_drops"] == 1 and strict.derive_snapshot().rows.first()["count"] == 1.0


def test_plans_stay_small(spark, monkeypatch):
    from strataform.plans import engine as plans

    monkeypatch.setattr(plans, "HELD", 3)
    engine = Engine(spark, schema())
    for _ in range(7):
        engine.add(frame(spark, ("a", T0)))
    assert len(engine._batches) < 3 and engine.derive_snapshot().rows.first()["count"] == 7.0


def test_streams(spark, tmp_path):
    """Cells as the last batch left them, and a refresh that may fail without stopping the stream."""
    from strataform.streaming import events as E

    rows, seen, failed = tmp_path / "in", [], []
    for k, batch in enumerate(([("a", T0), ("b", T0)], [("a", T0)])):
        frame(spark, *batch).coalesce(1).write.mode("append").parquet(str(rows))
        stream = spark.readStream.schema("region string, ts timestamp").parquet(str(rows))
        Engine(spark, schema()).stream(stream, str(tmp_path / "state"), str(tmp_path / "cells")).awaitTermination()
        assert {r.key: r["count"] for r in E.stream_cells(spark, str(tmp_path / "cells")).collect()} == [{"a": 1.0, "b": 1.0}, {"a": 2.0, "b": 1.0}][k]

    def refresh(cells):
        seen.append(cells.count())
        raise ValueError("no insight")

    E.refresh_insights(spark.readStream.schema("region string, ts timestamp").parquet(str(rows)), schema(), str(tmp_path / "state2"), str(tmp_path / "cells2"), refresh, failed.append, every=None).awaitTermination()
    assert seen and seen[-1] == 2 and len(failed) == len(seen)


def test_texts_and_report_file(spark, tmp_path):
    from strataform.functions import text
    from strataform.plans.interfaces import Narrator

    assert "Region east" in text.alert_body("ZScoreOutlier", "region:east", 6.0) and text.trend_text("region:east", 10, 15) == "Region east went up from 10 to 15 (+50.0%)."
    assert text.narrate(lambda p: "It is 12 now.", "?", [12.0], "plain") == "It is 12 now." and text.narrate(lambda p: "It is 99 now.", "?", [12.0], "plain") == "plain"
    assert text.narrate(lambda p: 1 / 0, "?", [12.0], "plain") == "plain"
    text.write_report(spark, "# Report é", str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text(encoding="utf-8") == "# Report é"

    class Silent:
        def tell(self, prompt):
            return ""

    assert isinstance(Silent(), Narrator)


def test_hourly_events(spark):
    from strataform.sources.store import hourly_events

    rows = hourly_events(spark, 8, 20)
    assert rows.count() > 8 * 24 and {r.channel for r in rows.select("channel").distinct().collect()} == {"voice", "sms", "data"}
