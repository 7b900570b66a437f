from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strataform.functions import scalar as S
from strataform.functions import text as T
from strataform.operators import industry as I
from strataform.operators import insights as N
from strataform.operators.rollup import rollup, rollup_grouping_sets
from strataform.operators.snapshot import Snapshot, series
from strataform.plans.schema import RollupSchema
from strataform.sources import store
from strataform.streaming import events as E

T0 = datetime(2026, 1, 15, 12)


def cells(df):
    return {(r.dimension, r.key): {k: v for k, v in r.asDict().items() if k not in ("dimension", "key")} for r in df.collect()}


def snap(spark, rows, metrics=("count",), primary="count"):
    """rows: dimension, key, values."""
    return Snapshot(spark.createDataFrame([(d, k, *map(float, v)) for d, k, *v in rows], ["dimension", "key", *metrics]), T0, primary)


def one(column, spark):
    return spark.range(1).select(column.alias("x")).first().x


def test_counts_sums_and_predicates(spark):
    df = spark.createDataFrame([("Core", 5.0, False), (" core\t", 7.0, None), ("CORE", 0.0, True)], "team string, points double, ok boolean")
    schema = RollupSchema.builder().dimension("Team", "team").count().sum("points").count_when("ok", "signal").build()
    assert cells(rollup(df, schema)) == {("team", "core"): {"count": 3.0, "points": 12.0, "signal": 1.0}}


def test_fan_out_and_grouping_sets_agree(spark):
    df = spark.createDataFrame([("Core", "a"), ("Core", "b"), (None, "b"), ("  ", "a")], "team string, status string")
    schema = RollupSchema.builder().dimension("team").dimension("status").count().build()
    want = {("team", "core"): 2.0, ("team", "unknown"): 2.0, ("status", "a"): 2.0, ("status", "b"): 2.0}
    for f in (rollup, rollup_grouping_sets):
        assert {k: v["count"] for k, v in cells(f(df, schema)).items()} == want
    assert set(cells(rollup(df, schema, dimensions={"team"}))) == {("team", "core"), ("team", "unknown")}


def test_ratio_average_and_zero_denominator(spark):
    df = spark.createDataFrame([("a", 9.0, 10.0), ("a", 990.0, 1000.0), ("b", 1.0, 0.0)], "k string, n double, d double")
    got = cells(rollup(df, RollupSchema.builder().dimension("k").ratio("n", "d", "rate").average("d", "mean").build()))
    assert got["k", "a"] == {"rate": pytest.approx(999 / 1010), "mean": 505.0} and got["k", "b"] == {"rate": 0.0, "mean": 0.0}


def test_shared_inputs_are_summed_once(spark, capsys):
    df = spark.createDataFrame([("a", 1.0, 2.0, 4.0), ("a", 2.0, 2.0, 4.0)], "k string, x double, y double, n double")
    schema = RollupSchema.builder().dimension("k").ratio("x", "n", "rx").ratio("y", "n", "ry").sum("n").max("n", "top").min("n", "low").count_when("n", "some").hyper_log_log("n", "d").build()
    rows = rollup(df, schema)
    assert cells(rows)["k", "a"] == {"rx": 0.375, "ry": 0.5, "n": 8.0, "top": 4.0, "low": 4.0, "some": 2.0, "d_unique": 1.0}
    rows.explain()
    partial = next(x for x in capsys.readouterr().out.splitlines() if "partial_sum" in x)
    assert partial.count("partial_sum") == 3


def test_white_space_of_all_kinds_is_trimmed(spark):
    kinds = [chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    keys = spark.createDataFrame([(f"{c}{c} A{c}b {c}",) for c in kinds] + [("\u200bA",), ("".join(kinds),), ("",), (None,)], "k string")
    got = [r.k for r in keys.select(S.normalize(F.col("k")).alias("k")).collect()]
    assert got == [f"a{c}b" for c in kinds] + ["\u200ba", "unknown", "unknown", "unknown"]
    by_pattern = F.lower(F.regexp_replace("k", r"(?U)^\s+|\s+$", ""))
    assert got[: len(kinds) + 1] == [r.k for r in keys.select(by_pattern.alias("k")).collect()][: len(kinds) + 1]


def test_digest_and_distinct(spark):
    df = spark.createDataFrame([("east", x) for x in (10.0, 12.0, 14.0, 16.0, 18.0, 100.0)], "region string, ms double")
    got = cells(rollup(df, RollupSchema.builder().dimension("region").percentile_digest("ms").build()))["region", "east"]
    assert got == {"ms_mean": pytest.approx(170 / 6), "ms_p50": 14.0, "ms_p95": 100.0, "ms_p99": 100.0}
    users = spark.range(102).select(F.lit("r").alias("r"), F.concat(F.lit("User-"), F.col("id") % 100).alias("u"))
    assert 95 <= cells(rollup(users, RollupSchema.builder().dimension("r").hyper_log_log("u", "users").build()))["r", "r"]["users_unique"] <= 105


def test_percentiles_are_bounded(spark, monkeypatch):
    """The sketch against exact ranks, at a small accuracy, over many distinct values of one cell."""
    from strataform.plans import schema as plans

    monkeypatch.setattr(plans, "ACCURACY", 200)
    n = 100_000
    df = spark.range(n).select(F.lit("r").alias("r"), ((F.col("id") * 7919) % n).cast("double").alias("x")).repartition(7)
    b = lambda **k: RollupSchema.builder().dimension("r").percentile_digest("x", **k).build()
    about, exact = (cells(rollup(df, b(**k)))["r", "r"] for k in ({}, {"exact": True}))
    for q, name in ((0.5, "x_p50"), (0.95, "x_p95"), (0.99, "x_p99")):
        assert exact[name] == -(-q * n // 1) - 1 and abs(about[name] - exact[name]) <= n / 200 + 1
    plan = rollup(df, b())._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_disc" not in plan and plan.count("percentile_approx") <= 3


def test_nan_makes_the_least_nan(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("b", 2.0), ("b", None)], "k string, x double")
    got = cells(rollup(df, RollupSchema.builder().dimension("k").min("x", "lo").max("x", "hi").build()))
    assert all(v != v for v in got["k", "a"].values()) and got["k", "b"] == {"lo": 2.0, "hi": 2.0}


def test_sums_before(spark):
    from strataform.functions.lineage import sums_before

    rows = [("a", i, (i * 7) % 5) for i in range(200)] + [("b", 3, 2), (None, 1, 1)]
    got = {(r.k, r.i): r.s for r in sums_before(spark.createDataFrame(rows, "k string, i long, v long").repartition(5), "k", ["i"], F.col("v"), "s").collect() if r.k}
    assert got == {(k, i): sum(v for x, j, v in rows if x == k and j < i) for k, i, _ in rows if k}


def test_projection_rules(spark):
    df = spark.createDataFrame([("east", 42.0)], "region string, amount double")
    schema = RollupSchema.builder().dimension("region").count().sum("amount", "amount_sum").percentile_digest("amount").hyper_log_log("region", "u").build()
    names = lambda p: set(rollup(df, schema, p).columns) - {"dimension", "key"}
    assert names({"COUNT", "amount_sum"}) == {"count", "amount_sum"}
    assert names({"amount"}) == set()  # a digest's own name asks for nothing
    assert names({"amount_p95", "u"}) == {"amount_p95", "u_unique"}


def test_schema_needs_parts():
    with pytest.raises(ValueError):
        RollupSchema.builder().count().build()
    with pytest.raises(ValueError):
        RollupSchema.builder().dimension("a").build()


def test_spill_of_cells_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("east", 10.0), ("west", 20.0)], "region string, amount double")
    rows = rollup(df, RollupSchema.builder().dimension("region").count().sum("amount").build())
    store.write_cells(rows, str(tmp_path / "cells"))
    assert cells(store.read_cells(spark, str(tmp_path / "cells"), ["amount"])) == {("region", "east"): {"amount": 10.0}, ("region", "west"): {"amount": 20.0}}
    store.export_snapshot(Snapshot(rows, T0), str(tmp_path / "long"))
    assert store.read_snapshot(spark, str(tmp_path / "long")).count() == 4


def test_prune(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.parquet").write_text("x")
    assert len(store.prune(spark, str(tmp_path), max_files=1)) == 3
    assert len(store.prune(spark, str(tmp_path), max_age=timedelta(seconds=-1))) == 1


def test_drivers_and_ranking(spark):
    p = snap(spark, [("channel", "sms", 100), ("channel", "email", 100)])
    c = snap(spark, [("channel", "SMS", 40), ("channel", "email", 95)])
    top = N.drivers(p, c).first()
    assert (top.total_delta, top.delta, top.cell_id) == (-65.0, -60.0, "channel:SMS")
    got = N.interesting_cells(snap(spark, [("channel", "sms", 500), ("channel", "email", 90), ("channel", "failed", 10)]), p, 3).collect()
    assert len(got) == 3 and "channel:sms" in {r.cell_id for r in got}
    multi = N.drivers_for_metrics(snap(spark, [("a", "b", 100, 1000)], ("count", "sum")), snap(spark, [("a", "b", 150, 1800)], ("count", "sum")))
    assert {r.metric: r.delta for r in multi.collect()} == {"count": 50.0, "sum": 800.0}


@pytest.mark.parametrize("p,c,found", [
    ([("sms", 100, 10), ("email", 100, 50)], [("sms", 150, 18), ("email", 50, 27.5)], 2),
    ([("a", 100000, 10000), ("b", 100000, 10000)], [("a", 200000, 22000), ("b", 1000, 110)], 0),
    ([("sms", 100, 10)], [("sms", 150, 18), ("email", 50, 27.5)], 0),
    ([("sms", 10, 1), ("email", 10, 5)], [("sms", 15, 2), ("email", 5, 3)], 0),
])
def test_simpson(spark, p, c, found):
    make = lambda rows: snap(spark, [("channel", *r) for r in rows], ("count", "signal"))
    got = N.simpsons_paradox(make(p), make(c)).collect()
    assert len(got) == found
    if found:
        assert got[0].pooled_rate_delta == pytest.approx(-0.0725) and {round(r.rate_delta, 6) for r in got} == {0.02, 0.05}


def test_shape_and_explanation(spark):
    got = N.distribution_shape(snap(spark, [("region", "east", 40, 12, 55, 120)], ("v_mean", "v_p50", "v_p95", "v_p99")), "v").first()
    assert (got.skew, got.mean_misleading, got.heavy_tail) == ("RightSkewed", True, True)
    p, c = snap(spark, [("channel", "sms", 100), ("channel", "email", 100)]), snap(spark, [("channel", "sms", 500), ("channel", "email", 90)])
    row = N.explain(c, "channel:sms", p).first()
    assert row.pv == 500 and row.share_of_dimension == pytest.approx(500 / 590) and row.percentile_rank == 0.5
    assert (row.previous_value, row.delta, row.ewma_baseline, row.sibling_z, row.share_of_total_delta) == (100.0, 400.0, pytest.approx(240.0), 0.0, pytest.approx(400 / 390))
    assert row["shape"] is None and row.comovements == [] and any("Up by 400" in x for x in row.bullets)
    with pytest.raises(KeyError):
        N.explain(c, "channel:none", p)
    alone = N.explain(c, "Channel:SMS").first()
    assert alone.delta is None and len(alone.bullets) == 1
    plan = N.explain(c, "channel:sms", p)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_explanation_with_shape_and_history(spark):
    values = {"east": [10, 20, 30, 40], "latency": [5, 5, 25, 35], "flat": [1, 1, 1, 1]}
    history = spark.createDataFrame([(i, "r", k, float(v)) for k, s in values.items() for i, v in enumerate(s)], ["snapshot_idx", "dimension", "key", "count"])
    now = snap(spark, [("r", "east", 40, 40, 12, 55, 120), ("r", "latency", 35, 1, 1, 1, 1)], ("count", "v_mean", "v_p50", "v_p95", "v_p99"))
    row = N.explain(now, "r:east", None, history, 4, "v").first()
    assert row["shape"].skew == "RightSkewed" and row["shape"].heavy_tail and row.comovements[0].correlation > 0.6
    assert any("r:latency" in x for x in row.bullets) and any("misleads" in x for x in row.bullets)
    assert N.explain(now, "r:east", None, history, 2).first().comovements == []


def test_no_window_over_a_dimension(spark):
    s = snap(spark, [("a", str(i), i % 7) for i in range(50)])
    assert "Window" not in N.surprise(s)._jdf.queryExecution().optimizedPlan().toString()
    got = {r.cell_id: r for r in N.sibling_rank(s).collect()}
    values = [i % 7 for i in range(50)]
    assert all(got[f"a:{i}"].percentile_rank == sum(v < i % 7 for v in values) / 50 and got[f"a:{i}"].share_of_dimension == pytest.approx((i % 7) / sum(values)) for i in range(50))


def test_summary_sections(spark):
    make = lambda rows: snap(spark, [("channel", *r) for r in rows], ("count", "signal"))
    got = N.analyze_summary(make([("sms", 150, 18), ("email", 50, 27.5)]), make([("sms", 100, 10), ("email", 100, 50)])).collect()
    assert [(r.kind, r.cell_id) for r in got if r.section == "simpson"] == [("SimpsonsParadox", "channel")]
    assert {r.kind for r in got if r.section == "flag"} >= {"SimpsonsParadox"} and sum(r.section == "recommended" for r in got) == 1
    assert {r.cell_id for r in got if r.section == "trend"} == {"channel:sms", "channel:email"}


def test_missing_primary_metric_is_zero(spark):
    assert {r.pv for r in snap(spark, [("a", "b", 3)], primary="none").primary().collect()} == {0.0}


def test_comovement(spark):
    values = {"east": [10, 20, 30, 40], "latency": [5, 5, 25, 35], "flat": [1, 1, 1, 1]}
    rows = [(i, "r", k, float(v)) for k, s in values.items() for i, v in enumerate(s)]
    history = spark.createDataFrame(rows, ["snapshot_idx", "dimension", "key", "count"])
    got = N.comovement(history, min_abs=0.5).collect()
    assert {got[0].cell_id, got[0].other_cell_id} == {"r:east", "r:latency"} and abs(got[0].correlation) > 0.5
    assert len(series(history).first().series) == 4


def test_windows_and_late_events(spark):
    df = spark.createDataFrame([(datetime(2026, 6, 16, 10, 15),)], "ts timestamp")
    at = lambda n: df.select(S.windowed_key(F.lit("east"), S.window_start(F.col("ts"), n)).alias("k")).first().k
    assert at(3_600_000_000) == "east@20260616100000" and at(7 * 86_400_000_000) == "east@20260615000000"
    assert at(0) == "east@20260616101500"
    assert E.window_micros("Sliding", 10) == 5 and E.window_micros("Session", 10, gap_micros=3) == 3
    import random

    noise, best, want, rows = random.Random(1), None, {}, []
    for i in range(300):
        t = T0 + timedelta(minutes=noise.randrange(600))
        want[i] = best is not None and t < best - timedelta(minutes=300)
        best = t if best is None else max(best, t)
        rows.append((i, t))
    got = E.with_lateness(spark.createDataFrame(rows, "i long, ts timestamp").repartition(5), "ts", [F.col("i")], 300 * 60)
    assert {r.i: r.late for r in got.collect()} == want


def test_windowed_stream_gives_what_batch_gives(spark, tmp_path):
    rows = [(T0 + timedelta(minutes=i), "ab"[i % 2], float(i)) for i in range(180)]
    df = spark.createDataFrame(rows, "ts timestamp, k string, v double")
    df.write.parquet(str(tmp_path / "in"))
    schema = RollupSchema.builder().dimension("k").count().sum("v").build()
    q = E.windowed_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), schema, "ts", "1 hour", "10 minutes")
    run = q.writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(90)
    got = {(r.key, r.window_start): (r["count"], r.v) for r in spark.table("hours").collect()}
    batch = rollup(df, schema, window_ts=F.col("ts"), window_micros=3_600_000_000)
    assert len(got) == batch.count() and sum(n for n, _ in got.values()) == 180


def test_campaign_report(spark):
    columns = "carrier string, message_type string, ts timestamp, delivered long, expired long, undeliv long, rejectd long, spam long, cancelled long, replies long, opt_outs long"
    rows = [("MTN", "otp", T0, 480, 6, 6, 5, 3, 0, 0, 0), ("mtn", "otp", T0, 470, 10, 10, 7, 3, 0, 0, 0)]
    snapshot = Snapshot(rollup(spark.createDataFrame(rows, columns), I.message_schema()), T0, "delivery_rate")
    before = spark.createDataFrame([("carrier", "mtn", "delivery_rate", 0.96)], "dimension string, key string, metric string, value double")
    bands = spark.createDataFrame([("mtn", "*", "delivery_rate", 0.9, 0.94, 0.97, 9)], "carrier string, message_type string, metric string, p25 double, median double, p75 double, peer_count long")
    parts = I.build_report(snapshot, before, bands)
    row = next(r for r in parts["observations"].collect() if (r.dimension, r.metric) == ("carrier", "delivery_rate"))
    assert (row.actual, row.self_expected, row.kind, row.is_material, row.is_favorable) == (0.95, 0.96, "SelfAnomaly", True, False)
    totals = parts["totals"].first()
    assert totals.failure_rate == pytest.approx(0.05) and totals.dominant_reason == "UNDELIV"  # a tie with EXPIRED
    assert "Grade B" in T.report_markdown(parts)
    spilt = rollup(spark.createDataFrame([("a", "b", T0, 80, 5, 5, 5, 5, 20, 0, 0)], columns), I.message_schema()).where("dimension = 'carrier'").first()
    assert (spilt.sent, spilt.cancelled, spilt.delivery_rate, spilt.failure_rate) == (120.0, 20.0, 0.8, 0.2)


def test_scalars(spark):
    assert one(S.sparkline(F.array(*map(F.lit, (1.0, 3.0, 5.0, 2.0, 8.0)))), spark) == " :=.@"
    assert one(S.sparkline(F.array(F.lit(2.0), F.lit(2.0))), spark) == "=="
    assert one(S.p75_between(F.lit(12.0), F.lit(55.0)), spark) == pytest.approx(35.8888888)
    assert one(S.normalize(F.lit("  Team　")), spark) == "team"
    assert [one(S.grounded(F.lit(x), F.array(F.lit(0.048))), spark) for x in ("0.048", "4.8%", "12.3%")] == [True, True, False] == [T.is_grounded(x, [0.048]) for x in ("0.048", "4.8%", "12.3%")]
    assert one(S.pearson(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))), spark) == 0.0


def test_cohorts_need_peers(spark):
    rows = [("a", float(i)) for i in range(4)] + [("b", float(i)) for i in range(5)]
    got = I.cohort_bands(spark.createDataFrame(rows, "c string, r double"), ["c"], "r").collect()
    assert [(r.c, r.p25, r.median, r.p75) for r in got] == [("b", 1.0, 2.0, 3.0)]


def test_alerts_and_cache(spark):
    rows = [("A", "x", 9.0), ("B", "x", 8.0), ("A", "y", 7.0), ("A", "z", 6.0), ("B", "w", 5.0)]
    assert [r.cell_id for r in N.select_alerts(spark.createDataFrame(rows, "kind string, cell_id string, score double")).collect()] == ["x", "y", "w"]
    cache = N.SimilarityCache()
    cache.put([3.0, 1.0], "r")
    assert cache.get([6.0, 2.0]) == "r" and cache.get([0.0, 1.0]) is None


def test_shared_cause(spark):
    """A cell that moves together with others and left its own course has a shared cause; one that stayed is as expected."""
    from strataform.operators import industry as I

    long = "dimension string, key string, metric string, value double"
    now = spark.createDataFrame([("carrier", k, "delivery_rate", v) for k, v in (("mtn", 0.5), ("cellc", 0.5), ("telkom", 0.9))], long)
    before = spark.createDataFrame([("carrier", k, "delivery_rate", 0.9) for k in ("mtn", "cellc", "telkom")], long)
    bands = spark.createDataFrame([("mtn", "*", "delivery_rate", 0.4, 0.5, 0.6, 9)], "carrier string, message_type string, metric string, p25 double, median double, p75 double, peer_count long")
    moving = spark.createDataFrame([("Carrier:MTN",), ("carrier:telkom",)], "cell_id string")
    got = {r.cell_key: (r.kind, r.is_favorable) for r in I.observations(now, before, bands, moving).collect()}
    assert {k: v[0] for k, v in got.items()} == {"mtn": "SharedCause", "cellc": "SelfAnomaly", "telkom": "SeasonalExpected"}
    assert {r.cell_key: r.kind for r in I.observations(now, before, bands).collect()}["mtn"] == "SelfAnomaly"


def test_flow_shares(spark):
    from strataform.operators import industry as I

    rows = [("carrier", "a", 100.0, 70.0, 5.0, 5.0, 8.0, 2.0, 10.0, 1.0, 1.0)]
    got = {(r.stage, r.outcome): r.share for r in I.flow_shares(spark.createDataFrame(rows, "dimension string, key string, sent double, delivered double, expired double, undeliv double, rejectd double, spam double, cancelled double, replies double, opt_outs double")).collect()}
    assert got["sent", "cancelled"] == 0.1 and got["attempted", "delivered"] == pytest.approx(70 / 90) and sum(v for (s, _), v in got.items() if s == "attempted") == pytest.approx(1)
