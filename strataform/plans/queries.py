"""The registered queries of the rollup and insight operators, each beside its SQL.

Doubles are rounded to six digits on both sides, as sums are in no fixed order."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions import scalar as S
from strataform.functions.lineage import shared_folder
from strataform.operators import industry as I
from strataform.operators import insights as N
from strataform.operators.rollup import fan_out, rollup, rollup_grouping_sets
from strataform.operators.snapshot import Snapshot, overlay, recent, series, universe
from strataform.plans.schema import RollupSchema, RollupSchemaBuilder
from strataform.sources import store
from strataform.streaming import events as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CUT = "2024-01-16"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def by_type() -> RollupSchemaBuilder:
    return RollupSchema.builder().dimension("event_type").dimension("user", "user_id")


_CELLS = """SELECT dimension, key, {agg} FROM (
SELECT 'event_type' AS dimension, event_type AS key, * FROM events UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), * FROM events) GROUP BY dimension, key"""


def _metric(name: str, build: Callable[[RollupSchemaBuilder], RollupSchemaBuilder], agg: str) -> None:
    query(_CELLS.format(agg=agg), name)(lambda spark, sf_dir: rounded(rollup(events(spark, sf_dir), build(by_type()).build())))


_metric("rollup_count", lambda b: b.count().sum("value", "value_sum").count_when("event_type = 'purchase'", "signal"), "CAST(count(*) AS DOUBLE) AS count, round(sum(value), 6) AS value_sum, CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS signal")
_metric("rollup_sum", lambda b: b.sum("value"), "round(sum(value), 6) AS value")
_metric("rollup_min_max", lambda b: b.min("value", "lo").max("value", "hi"), "round(min(value), 6) AS lo, round(max(value), 6) AS hi")
_metric("rollup_count_when", lambda b: b.count_when("value > 50", "high").count_when("CAST(NULL AS BOOLEAN)", "never"), "CAST(count(*) FILTER (value > 50) AS DOUBLE) AS high, CAST(0 AS DOUBLE) AS never")
_metric("rollup_average", lambda b: b.average("value", "mean"), "round(avg(value), 6) AS mean")
_metric("rollup_ratio", lambda b: b.ratio("value * value", "value", "weighted").ratio("value", "0 * value", "none"), "round(sum(value * value) / sum(value), 6) AS weighted, CAST(0 AS DOUBLE) AS none")
_metric("rollup_percentiles", lambda b: b.percentile_digest("value", "v"), "round(avg(value), 6) AS v_mean, " + ", ".join(f"round(quantile_disc(value, {q}), 6) AS v_{k}" for k, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))))
_metric("rollup_distinct_exact", lambda b: b.hyper_log_log("user_id", "users", exact=True), "CAST(count(DISTINCT user_id) AS DOUBLE) AS users_unique")


@query("""SELECT dimension, key, CAST(count(DISTINCT user_id) AS DOUBLE) AS users, true AS close FROM (SELECT 'event_type' AS dimension, event_type AS key, user_id FROM events UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), user_id FROM events) GROUP BY dimension, key""")
def rollup_distinct_approx(spark, sf_dir):
    b = lambda: RollupSchema.builder().dimension("event_type").dimension("day", F.date_format("ts", "yyyy-MM-dd"))
    schema = b().hyper_log_log("user_id", "approx").hyper_log_log("user_id", "exact", exact=True).build()
    return rollup(events(spark, sf_dir), schema).select("dimension", "key", F.col("exact_unique").alias("users"), (F.abs(F.col("approx_unique") - F.col("exact_unique")) <= 0.05 * F.col("exact_unique")).alias("close"))


@query("SELECT 'event_type' AS dimension, event_type AS key, event_id FROM events UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), event_id FROM events")
def rollup_fanout(spark, sf_dir):
    return fan_out(events(spark, sf_dir), by_type().count().build().dimensions, [F.col("event_id")])


@query(_CELLS.format(agg="CAST(count(*) AS DOUBLE) AS count, round(sum(value), 6) AS value"), "rollup_grouping_sets")
def _grouping_sets(spark, sf_dir):
    return rounded(rollup_grouping_sets(events(spark, sf_dir), by_type().count().sum("value").build()))


@query("SELECT 'flag_status' AS dimension, lower(l_returnflag || '|' || l_linestatus) AS key, CAST(count(*) AS DOUBLE) AS count, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6) AS discount_rate FROM lineitem GROUP BY 2")
def rollup_composite_key(spark, sf_dir):
    b = RollupSchema.builder().dimension("flag_status", F.concat_ws("|", "l_returnflag", "l_linestatus"))
    return rounded(rollup(table(spark, sf_dir, "lineitem"), b.count().ratio("l_extendedprice * l_discount", "l_extendedprice", "discount_rate").build()))


@query("""SELECT dimension, key, CAST(count(*) AS DOUBLE) AS count FROM (SELECT 'dow' AS dimension, CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS key FROM events
UNION ALL SELECT 'hod', strftime(ts, '%H') FROM events) GROUP BY dimension, key""")
def rollup_time_buckets(spark, sf_dir):
    return rollup(events(spark, sf_dir), RollupSchema.builder().dimension("dow", S.day_bucket(F.col("ts"))).dimension("hod", S.hour_bucket(F.col("ts"))).count().build())


# ---- snapshots -------------------------------------------------------------------------------------------------------


def snapshot_schema() -> RollupSchema:
    b = RollupSchema.builder().dimension("event_type").dimension("hod", S.hour_bucket(F.col("ts")))
    return b.count().count_when("value > 50", "signal").sum("value", "value_sum").percentile_digest("value", "v").build()


def snapshot(spark: SparkSession, sf_dir: str, where: str = "true", primary: str = "count", projection: set[str] | None = None) -> Snapshot:
    return Snapshot(rollup(events(spark, sf_dir).where(where), snapshot_schema(), projection), datetime(2024, 1, 31), primary)


def pair(spark: SparkSession, sf_dir: str, projection: set[str] | None = frozenset({"count", "signal", "value_sum"})) -> tuple[Snapshot, Snapshot]:
    return tuple(snapshot(spark, sf_dir, f"ts {op} TIMESTAMP '{CUT}'", projection=projection) for op in ("<", ">="))


def _snap(where: str = "true", digest: bool = False) -> str:
    more = ", avg(value) AS v_mean, " + ", ".join(f"quantile_disc(value, {q}) AS v_{k}" for k, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))
    return f"""SELECT dimension, key, dimension || ':' || key AS cell_id, CAST(count(*) AS DOUBLE) AS count, CAST(count(*) FILTER (value > 50) AS DOUBLE) AS signal, sum(value) AS value_sum{more * digest}
FROM (SELECT 'event_type' AS dimension, event_type AS key, ts, value FROM events UNION ALL SELECT 'hod', strftime(ts, '%H'), ts, value FROM events) WHERE {where} GROUP BY dimension, key"""


_PAIR = f"p AS ({_snap(f'''ts < '{CUT}' ''')}), c AS ({_snap(f'''ts >= '{CUT}' ''')})"
_PAIR_DIGEST = f"p AS ({_snap(f'''ts < '{CUT}' ''', True)}), c AS ({_snap(f'''ts >= '{CUT}' ''', True)})"
_LONG = "SELECT dimension, key, metric, round(value, 6) AS value{more} FROM s UNPIVOT (value FOR metric IN (count, signal, value_sum, v_mean, v_p50, v_p95, v_p99))"


@query(f"WITH s AS (SELECT * EXCLUDE (cell_id) FROM ({_snap(digest=True)})) " + _LONG.format(more=", TIMESTAMP '2024-01-31' AS generated_at"))
def snapshot_long(spark, sf_dir):
    return rounded(snapshot(spark, sf_dir).long()).withColumn("generated_at", F.col("generated_at").cast("timestamp_ntz"))


@query(f"SELECT dimension, key, count, round(v_p95, 6) AS v_p95 FROM ({_snap(digest=True)})")
def snapshot_projected(spark, sf_dir):
    return rounded(snapshot(spark, sf_dir, projection={"Count", "v", "v_P95"}).rows)


@query(f"SELECT dimension, key, count, round(value_sum, 6) AS value_sum FROM ({_snap()})")
def cell_state_roundtrip(spark, sf_dir):
    path = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    store.write_cells(snapshot(spark, sf_dir, projection={"count", "signal", "value_sum"}).rows, path)
    return rounded(store.read_cells(spark, path, ["count", "value_sum"]))


@query(f"SELECT dimension, key, count, signal FROM ({_snap()}) WHERE cell_id = 'event_type:click'")
def cell_lookup(spark, sf_dir):
    return snapshot(spark, sf_dir, projection={"count", "signal"}).lookup("Event_Type", "CLICK")


@query(f"WITH {_PAIR} SELECT dimension, key, count FROM p WHERE cell_id NOT IN (SELECT cell_id FROM c WHERE key < '12') UNION ALL SELECT dimension, key, count FROM c WHERE key < '12'")
def overlay_merge(spark, sf_dir):
    p, c = pair(spark, sf_dir, frozenset({"count"}))
    return overlay(p.rows, c.rows.where("key < '12'"))


@query(f"WITH {_PAIR} SELECT cell_id FROM p UNION SELECT cell_id FROM c")
def cell_universe(spark, sf_dir):
    return universe([s.rows for s in pair(spark, sf_dir, frozenset({"count"}))])


@query(f"SELECT cell_id, count AS pv FROM ({_snap()}) ORDER BY count DESC, cell_id LIMIT 14")
def top_cells(spark, sf_dir):
    return snapshot(spark, sf_dir, projection={"count"}).top(14).select("cell_id", "pv")


@query(f"SELECT cell_id, round(signal / count, 6) AS signal_rate FROM ({_snap()}) WHERE count > 0")
def signal_rate(spark, sf_dir):
    return rounded(N.signal_rate(snapshot(spark, sf_dir, projection={"count", "signal"})))


# ---- insights --------------------------------------------------------------------------------------------------------

_SURPRISE = "SELECT cell_id, count AS pv, sum(count) OVER (PARTITION BY dimension) / count(*) OVER (PARTITION BY dimension) AS expected FROM {s}"
_HISTORY = "SELECT c.cell_id, c.count AS pv, coalesce(p.count, 0) AS previous, CASE WHEN s <= 1e-6 THEN 0 ELSE (c.count - m) / s END AS z, c.count - (0.35 * c.count + 0.65 * coalesce(p.count, 0)) AS shift FROM c LEFT JOIN p USING (cell_id), (SELECT avg(count) AS m, stddev_pop(count) AS s FROM p)"
_RANKED = f"SELECT 'DeviationFromExpectation' AS kind, 0 AS o, cell_id, abs((pv - expected) / sqrt(expected + 1)) AS score FROM ({_SURPRISE.format(s='c')}) UNION ALL SELECT 'ZScoreOutlier', 1, cell_id, abs(z) FROM ({_HISTORY}) UNION ALL SELECT 'EwmaTrendShift', 2, cell_id, abs(shift) FROM ({_HISTORY})"


@query(f"WITH s AS ({_snap()}) SELECT cell_id, pv, round(expected, 6) AS expected, round((pv - expected) / sqrt(expected + 1), 6) AS residual, round(abs((pv - expected) / sqrt(expected + 1)), 6) AS score FROM ({_SURPRISE.format(s='s')})")
def surprise(spark, sf_dir):
    return rounded(N.surprise(snapshot(spark, sf_dir, projection={"count"})))


@query(f"WITH {_PAIR} SELECT cell_id, pv, CAST(previous AS DOUBLE) AS previous, round(z, 6) AS z, round(shift, 6) AS shift FROM ({_HISTORY})")
def historical_insights(spark, sf_dir):
    p, c = pair(spark, sf_dir, frozenset({"count"}))
    return rounded(N.historical(c, p))


@query(f"WITH {_PAIR} SELECT kind, cell_id, round(score, 6) AS score FROM ({_RANKED}) ORDER BY round(score, 9) DESC, o, cell_id LIMIT 10")
def interesting_cells(spark, sf_dir):
    p, c = pair(spark, sf_dir, frozenset({"count"}))
    return rounded(N.interesting_cells(c, p, 10))


@query(f"""WITH {_PAIR}, r AS (SELECT * FROM ({_RANKED}) ORDER BY round(score, 9) DESC, o, cell_id LIMIT 20),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY score DESC, kind) = 1),
k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY kind ORDER BY score DESC, cell_id) <= 2)
SELECT kind, cell_id, round(score, 6) AS score FROM k ORDER BY score DESC, kind, cell_id LIMIT 3""")
def select_alerts(spark, sf_dir):
    p, c = pair(spark, sf_dir, frozenset({"count"}))
    return rounded(N.select_alerts(N.interesting_cells(c, p, 20)))


_DRIVERS = "u AS (SELECT coalesce(c.cell_id, p.cell_id) AS cell_id, coalesce(p.{m}, 0) AS previous_value, coalesce(c.{m}, 0) AS current_value FROM p FULL JOIN c ON p.cell_id = c.cell_id), t AS (SELECT sum(previous_value) AS total_previous, sum(current_value) AS total_current FROM u)"
_DRIVER_COLUMNS = "cell_id, round(previous_value, 6) AS previous_value, round(current_value, 6) AS current_value, round(current_value - previous_value, 6) AS delta, round(coalesce((current_value - previous_value) / nullif(total_current - total_previous, 0), 0), 6) AS share_of_total_delta, round(total_previous, 6) AS total_previous, round(total_current, 6) AS total_current, round(total_current - total_previous, 6) AS total_delta"


@query(f"WITH {_PAIR}, {_DRIVERS.format(m='count')} SELECT {_DRIVER_COLUMNS} FROM u, t ORDER BY abs(current_value - previous_value) DESC, cell_id LIMIT 5")
def drivers(spark, sf_dir):
    return rounded(N.drivers(*pair(spark, sf_dir, frozenset({"count"}))))


@query(f"WITH {_PAIR} " + " UNION ALL ".join(f"SELECT * FROM (WITH {_DRIVERS.format(m=m)} SELECT '{m}' AS metric, {_DRIVER_COLUMNS} FROM u, t ORDER BY abs(current_value - previous_value) DESC, u.cell_id LIMIT 5)" for m in ("count", "signal", "value_sum")))
def drivers_multi(spark, sf_dir):
    return rounded(N.drivers_for_metrics(*pair(spark, sf_dir)))


_BEFORE = "l_shipdate < TIMESTAMP '1996-01-01'"


def _simpson_pair(spark, sf_dir) -> tuple[Snapshot, Snapshot]:
    schema = RollupSchema.builder().dimension("size", F.when(F.col("l_quantity") > 25.5, "bulk").otherwise("small")).count().sum("l_quantity", "signal").build()
    rows = table(spark, sf_dir, "lineitem")
    # a shift of the mix: all lines before and after a day, the later ones with half a piece more, and small ones twice
    later = rows.where(f"NOT coalesce({_BEFORE}, false)").withColumn("l_quantity", F.col("l_quantity") + 0.5)
    return Snapshot(rollup(rows.where(_BEFORE), schema)), Snapshot(rollup(later.unionByName(later.where("l_quantity <= 25.5")), schema))


@query("""WITH r AS (SELECT coalesce(l_shipdate < TIMESTAMP '1996-01-01', false) AS early, l_quantity AS q FROM lineitem), a AS (SELECT early, q + CASE WHEN early THEN 0 ELSE 0.5 END AS q FROM r),
s AS (SELECT early, 'size:' || CASE WHEN q > 25.5 THEN 'bulk' ELSE 'small' END AS cell_id, count(*) AS n, sum(q) AS x FROM (SELECT * FROM a UNION ALL SELECT * FROM a WHERE NOT early AND q <= 25.5) GROUP BY 1, 2),
pooled AS (SELECT sum(x) FILTER (NOT early) / sum(n) FILTER (NOT early) - sum(x) FILTER (early) / sum(n) FILTER (early) AS d, count(DISTINCT cell_id) AS k FROM s),
child AS (SELECT c.cell_id, c.x / c.n - p.x / p.n AS r FROM s c JOIN s p ON c.cell_id = p.cell_id AND NOT c.early AND p.early WHERE c.n >= 30 AND p.n >= 30 AND abs(c.x / c.n - p.x / p.n) >= 0.005),
g AS (SELECT count(*) AS n, min(sign(r)) AS lo, max(sign(r)) AS hi FROM child)
SELECT 'size' AS parent_cell_id, round(d, 6) AS pooled_rate_delta, cell_id AS child_cell_id, round(r, 6) AS rate_delta FROM child, g, pooled WHERE k >= 2 AND abs(d) >= 0.005 AND g.n >= 2 AND lo = hi AND lo <> sign(d)""")
def simpsons_paradox(spark, sf_dir):
    return rounded(N.simpsons_paradox(*_simpson_pair(spark, sf_dir)))


@query(f"""SELECT cell_id, 'v' AS metric_name, round(v_mean, 6) AS mean, round(v_p50, 6) AS median, round(v_p95, 6) AS p95, round(v_p99, 6) AS p99, skew, skew IN ('RightSkewed', 'LeftSkewed') AS mean_misleading, v_p50 > 0 AND v_p99 / greatest(v_p50, 1e-9) >= 2.5 AS heavy_tail
FROM (SELECT *, CASE WHEN v_mean <= 0 OR v_p50 <= 0 THEN 'Unknown' WHEN v_mean / v_p50 >= 1.25 THEN 'RightSkewed' WHEN v_mean / v_p50 <= 0.8 THEN 'LeftSkewed' ELSE 'Symmetric' END AS skew FROM ({_snap(digest=True)}))""")
def distribution_shape(spark, sf_dir):
    return rounded(N.distribution_shape(snapshot(spark, sf_dir), "v"))


@query(f"SELECT cell_id, round(v_p50, 6) AS p50, round(v_p50 + (v_p95 - v_p50) * 25 / 45, 6) AS p75, round(v_p95, 6) AS p95, round(v_p99, 6) AS p99 FROM ({_snap(digest=True)})")
def digest_buckets(spark, sf_dir):
    return rounded(snapshot(spark, sf_dir).rows.select(S.cell_id().alias("cell_id"), F.col("v_p50").alias("p50"), S.p75_between(F.col("v_p50"), F.col("v_p95")).alias("p75"), F.col("v_p95").alias("p95"), F.col("v_p99").alias("p99")))


@query(f"SELECT cell_id, count AS pv, round((rank() OVER (PARTITION BY dimension ORDER BY count) - 1) / count(*) OVER (PARTITION BY dimension), 6) AS percentile_rank, round(count / sum(count) OVER (PARTITION BY dimension), 6) AS share_of_dimension FROM ({_snap()})")
def sibling_rank(spark, sf_dir):
    return rounded(N.sibling_rank(snapshot(spark, sf_dir, projection={"count"})))


@query(f"""WITH {_PAIR_DIGEST}, {_DRIVERS.format(m='count')}, r AS (SELECT cell_id, dimension, key, count AS pv, (rank() OVER (PARTITION BY dimension ORDER BY count) - 1) / count(*) OVER (PARTITION BY dimension) AS percentile_rank, count / sum(count) OVER (PARTITION BY dimension) AS share_of_dimension, v_mean, v_p50, v_p95, v_p99 FROM c),
z AS (SELECT count(*) AS n, avg(count) AS m, stddev_pop(count) AS s FROM p WHERE dimension = 'event_type')
SELECT r.cell_id, r.dimension, r.key, pv, round(percentile_rank, 6) AS percentile_rank, round(share_of_dimension, 6) AS share_of_dimension, CAST(previous_value AS DOUBLE) AS previous_value, round(current_value - previous_value, 6) AS delta, round(0.35 * pv + 0.65 * previous_value, 6) AS ewma_baseline, round(CASE WHEN n > 1 THEN CASE WHEN s <= 1e-9 THEN 0 ELSE (pv - m) / s END END, 6) AS sibling_z,
round(coalesce((current_value - previous_value) / nullif(total_current - total_previous, 0), 0), 6) AS share_of_total_delta, round(v_mean, 6) AS mean, round(v_p50, 6) AS median, round(v_p95, 6) AS p95, round(v_p99, 6) AS p99, CASE WHEN v_mean <= 0 OR v_p50 <= 0 THEN 'Unknown' WHEN v_mean / v_p50 >= 1.25 THEN 'RightSkewed' WHEN v_mean / v_p50 <= 0.8 THEN 'LeftSkewed' ELSE 'Symmetric' END AS skew
FROM r JOIN u USING (cell_id), t, z WHERE r.cell_id = 'event_type:click'""")
def cell_explain(spark, sf_dir):
    """The co-movements and bullets are left out here; comovement_cell has the former, tests the latter."""
    p, c = pair(spark, sf_dir, None)
    row = N.explain(c, "event_type:click", p, digest="v")
    return rounded(row.drop("comovements", "bullets").select("*", *[f"shape.{k}" for k in ("mean", "median", "p95", "p99", "skew")]).drop("shape"))


_PARADOX = """x AS (SELECT coalesce(c.dimension, p.dimension) AS dim, c.cell_id AS cid, p.cell_id AS pid, p.count AS np, c.count AS nc, p.signal AS xp, c.signal AS xc FROM p FULL JOIN c ON p.cell_id = c.cell_id),
pooled AS (SELECT dim, sum(xc) / sum(nc) - sum(xp) / sum(np) AS d FROM x GROUP BY dim HAVING count(*) >= 2 AND sum(np) > 0 AND sum(nc) > 0),
child AS (SELECT dim, xc / nc - xp / np AS r FROM x WHERE cid IS NOT NULL AND pid IS NOT NULL AND np >= 30 AND nc >= 30),
g AS (SELECT dim, count(*) AS n, min(sign(r)) AS lo, max(sign(r)) AS hi FROM child WHERE abs(r) >= 0.005 GROUP BY dim),
paradox AS (SELECT dim, d FROM pooled JOIN g USING (dim) WHERE abs(d) >= 0.005 AND n >= 2 AND lo = hi AND lo <> sign(d))"""


@query(f"""WITH {_PAIR}, top AS (SELECT * FROM ({_RANKED}) ORDER BY round(score, 9) DESC, o, cell_id LIMIT 5), {_PARADOX}
SELECT 'anomaly' AS section, NULL AS kind, cell_id, round(min(score), 6) AS score FROM top GROUP BY cell_id
UNION ALL SELECT 'trend', NULL, cell_id, round(signal / count, 6) FROM c WHERE count > 0
UNION ALL SELECT 'flag', kind, cell_id, round(score, 6) FROM top WHERE kind <> 'EwmaTrendShift'
UNION ALL SELECT * FROM (SELECT 'recommended', kind, cell_id, round(score, 6) FROM top ORDER BY round(score, 9) DESC, o, cell_id LIMIT 1)
UNION ALL SELECT unnest(['simpson', 'flag']), 'SimpsonsParadox', dim, round(d, 6) FROM paradox""")
def analyze_summary(spark, sf_dir):
    p, c = pair(spark, sf_dir)
    return rounded(N.analyze_summary(c, p))


@query(f"SELECT i, CAST(coalesce(v[i], 0) AS FLOAT) AS v FROM (SELECT list(count ORDER BY count DESC) AS v FROM ({_snap()})), range(1, 33) t(i)")
def profile_vector(spark, sf_dir):
    rows = N.profile_vector(snapshot(spark, sf_dir, projection={"count"}))
    return rows.select(F.posexplode("vector").alias("i", "v")).select((F.col("i") + 1).cast("long").alias("i"), "v")


@query(f"WITH {_PAIR}, a AS (SELECT row_number() OVER (ORDER BY count DESC) AS i, CAST(CAST(count AS FLOAT) AS DOUBLE) AS v FROM p), b AS (SELECT row_number() OVER (ORDER BY count DESC) AS i, CAST(CAST(count AS FLOAT) AS DOUBLE) AS v FROM c) SELECT round((SELECT sum(a.v * b.v) FROM a JOIN b USING (i)) / sqrt((SELECT sum(v * v) FROM a WHERE i <= 32) * (SELECT sum(v * v) FROM b WHERE i <= 32)), 6) AS similarity")
def profile_similarity(spark, sf_dir):
    return rounded(N.profile_similarity(*pair(spark, sf_dir, frozenset({"count"}))))


# ---- history ---------------------------------------------------------------------------------------------------------


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot for each day; events of one day make the cells of one index."""
    rows = events(spark, sf_dir).withColumn("snapshot_idx", F.datediff("ts", F.lit("2024-01-01")))
    cells = fan_out(rows, RollupSchema.builder().dimension("event_type").dimension("hod", S.hour_bucket(F.col("ts"))).count().build().dimensions, [F.col("snapshot_idx")])
    return cells.groupBy("snapshot_idx", "dimension", "key").agg(F.count(F.lit(1)).cast("double").alias("count"))


_SERIES = """h AS (SELECT datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS i, dimension || ':' || key AS cell_id, count(*) AS n FROM (SELECT 'event_type' AS dimension, event_type AS key, ts FROM events UNION ALL SELECT 'hod', strftime(ts, '%H'), ts FROM events) GROUP BY 1, 2),
idx AS (SELECT DISTINCT i FROM h), f AS (SELECT cell_id, min(i) AS first_idx FROM h GROUP BY 1),
d AS (SELECT f.cell_id, f.first_idx, idx.i, row_number() OVER (PARTITION BY f.cell_id ORDER BY idx.i) AS k, CAST(coalesce(h.n, 0) AS DOUBLE) AS v FROM f CROSS JOIN idx LEFT JOIN h ON h.cell_id = f.cell_id AND h.i = idx.i),
e AS (SELECT cell_id, first_idx, k, v AS e FROM d WHERE k = 1 UNION ALL SELECT d.cell_id, d.first_idx, d.k, 0.35::DOUBLE * d.v + (1 - 0.35::DOUBLE) * e.e FROM e JOIN d ON d.cell_id = e.cell_id AND d.k = e.k + 1)"""
_COMOVE = f"""WITH RECURSIVE {_SERIES}, s AS (SELECT cell_id, min(first_idx) AS first_idx, list(e ORDER BY k) AS x FROM e GROUP BY cell_id HAVING max(abs(e)) > 1e-12 AND count(*) >= 3),
l AS (SELECT a.cell_id, b.cell_id AS other_cell_id, lag, CASE WHEN lag < 0 THEN a.x[1 - lag :] ELSE a.x[1 : len(a.x) - lag] END AS x, CASE WHEN lag < 0 THEN b.x[1 : len(b.x) + lag] ELSE b.x[1 + lag :] END AS y FROM s a JOIN s b ON (a.first_idx, a.cell_id) < (b.first_idx, b.cell_id), range(-3, 4) t(lag)),
z AS (SELECT cell_id, other_cell_id, lag, unnest(x) AS x, unnest(y) AS y FROM l),
r AS (SELECT cell_id, other_cell_id, lag, round(CASE WHEN count(*) < 2 OR count(*) * var_pop(x) <= 1e-12 OR count(*) * var_pop(y) <= 1e-12 THEN 0 ELSE covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) END, 12) AS r FROM z GROUP BY 1, 2, 3),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY cell_id, other_cell_id ORDER BY abs(round(r, 10)) DESC, lag) = 1)
SELECT cell_id, other_cell_id, round(r, 6) AS correlation, CAST(lag AS INTEGER) AS lag_snapshots FROM b WHERE abs(r) >= {{least}}"""


@query(f"WITH RECURSIVE {_SERIES} SELECT cell_id, CAST(k AS BIGINT) AS k, v FROM d")
def history_series(spark, sf_dir):
    return series(history(spark, sf_dir)).select("cell_id", F.posexplode("series").alias("k", "v")).withColumn("k", (F.col("k") + 1).cast("long"))


@query(f"WITH RECURSIVE {_SERIES} SELECT cell_id, CAST(k AS BIGINT) AS k, round(e, 6) AS e FROM e")
def ewma_series(spark, sf_dir):
    rows = series(history(spark, sf_dir)).select("cell_id", F.posexplode(S.ewma(F.col("series"), 0.35)).alias("k", "e"))
    return rounded(rows.withColumn("k", (F.col("k") + 1).cast("long")))


@query(_COMOVE.format(least=0.7) + " ORDER BY abs(r) DESC, cell_id, other_cell_id LIMIT 10")
def comovement(spark, sf_dir):
    return rounded(N.comovement(history(spark, sf_dir)))


@query("SELECT * FROM (" + _COMOVE.format(least=0.5) + " ORDER BY abs(r) DESC, cell_id, other_cell_id LIMIT 60) WHERE cell_id = 'event_type:click' OR other_cell_id = 'event_type:click' ORDER BY abs(correlation) DESC, cell_id, other_cell_id LIMIT 5")
def comovement_cell(spark, sf_dir):
    return rounded(N.comovement_of(history(spark, sf_dir), "event_type:click", 30, min_abs=0.5))


@query(f"WITH RECURSIVE {_SERIES} SELECT CAST(i AS INTEGER) AS snapshot_idx, cell_id, CAST(n AS DOUBLE) AS count FROM h WHERE i IN (SELECT i FROM idx ORDER BY i DESC LIMIT 6)")
def recent_windows(spark, sf_dir):
    return recent(history(spark, sf_dir), 6).select("snapshot_idx", S.cell_id().alias("cell_id"), "count")


@query(f"""WITH RECURSIVE {_SERIES}, m AS (SELECT cell_id, min(v) AS lo, max(v) AS hi FROM d GROUP BY 1)
SELECT cell_id, string_agg(substr(' .:-=+*#@', CAST(CASE WHEN hi = lo THEN 4 ELSE floor((v - lo) / (hi - lo) * 8) END AS INTEGER) + 1, 1), '' ORDER BY k) AS line FROM d JOIN m USING (cell_id) GROUP BY cell_id""")
def sparkline(spark, sf_dir):
    return series(history(spark, sf_dir)).select("cell_id", S.sparkline(F.col("series")).alias("line"))


@query(f"""WITH RECURSIVE {_SERIES}, m AS (SELECT cell_id, max(v) AS hi FROM d GROUP BY 1)
SELECT cell_id, string_agg(repeat('#', CAST(ceil(coalesce(v / nullif(hi, 0), 0) * 20) AS INTEGER)), chr(10) ORDER BY k) AS bars FROM d JOIN m USING (cell_id) GROUP BY cell_id""")
def histogram(spark, sf_dir):
    return series(history(spark, sf_dir)).select("cell_id", S.histogram_bars(F.col("series")).alias("bars"))


# ---- messages --------------------------------------------------------------------------------------------------------


def messages(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Message events made of line items."""
    columns = {"carrier": "l_returnflag", "message_type": "l_linestatus", "ts": "CAST(l_shipdate AS TIMESTAMP) + make_interval(0, 0, 0, 0, CAST(l_orderkey % 24 AS INT))", "delivered": "CAST(l_quantity AS BIGINT)"}
    columns |= {"expired": "CAST(l_linenumber % 3 AS BIGINT)", "undeliv": "CAST(l_partkey % 2 AS BIGINT)", "rejectd": "CASE WHEN l_returnflag = 'R' AND l_discount > 0.05 THEN 6 ELSE 0 END", "spam": "CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END", "cancelled": "CASE WHEN l_suppkey % 5 = 0 THEN 2 ELSE 0 END", "replies": "CAST(l_linenumber % 2 AS BIGINT)", "opt_outs": "CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END"}
    return table(spark, sf_dir, "lineitem").where(where).select(*[F.expr(v).alias(k) for k, v in columns.items()])


def campaign(spark: SparkSession, sf_dir: str, where: str = "true") -> Snapshot:
    """All message events; where cuts them only to compare a time with the one before."""
    return Snapshot(rollup(messages(spark, sf_dir, where), I.message_schema()), datetime(2024, 1, 31), "delivery_rate")


_MESSAGES = """SELECT lower(l_returnflag) AS carrier, lower(l_linestatus) AS message_type, CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS ts, CAST(l_quantity AS BIGINT) AS delivered, CAST(l_linenumber % 3 AS BIGINT) AS expired, CAST(l_partkey % 2 AS BIGINT) AS undeliv, CASE WHEN l_returnflag = 'R' AND l_discount > 0.05 THEN 6 ELSE 0 END AS rejectd, CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END AS spam,
CASE WHEN l_suppkey % 5 = 0 THEN 2 ELSE 0 END AS cancelled, CAST(l_linenumber % 2 AS BIGINT) AS replies, CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS opt_outs FROM lineitem WHERE {where}"""


def _campaign(where: str = "true") -> str:
    sums = ", ".join(f"CAST(sum({c}) AS DOUBLE) AS {c}" for c in I.COUNTS[1:])
    failed = "(expired + undeliv + rejectd + spam)"
    return f"""SELECT dimension, key, delivered / nullif(delivered + {failed}, 0) AS delivery_rate, {failed} / nullif(delivered + {failed}, 0) AS failure_rate, rejectd / nullif(delivered + {failed}, 0) AS rejectd_rate, spam / nullif(delivered + {failed}, 0) AS spam_rate, coalesce(replies / nullif(delivered, 0), 0) AS reply_rate, coalesce(opt_outs / nullif(delivered, 0), 0) AS opt_out_rate, delivered + {failed} + cancelled AS sent, {', '.join(I.COUNTS[1:])} FROM (
SELECT dimension, key, {sums} FROM (SELECT 'carrier' AS dimension, carrier AS key, * FROM m UNION ALL SELECT 'message_type', message_type, * FROM m UNION ALL SELECT 'carrier_message_type', carrier || '|' || message_type, * FROM m
UNION ALL SELECT 'dow', CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend' ELSE 'weekday' END, * FROM m UNION ALL SELECT 'hod', strftime(ts, '%H'), * FROM m) GROUP BY dimension, key)""".replace(" FROM m", f" FROM ({_MESSAGES.format(where=where)}) m")


_AFTER = "l_shipdate >= TIMESTAMP '1996-01-01'"
_S = f"s AS ({_campaign()})"
_S_AFTER = f"s AS ({_campaign(_AFTER)})"
_TOTALS = "t AS (SELECT *, greatest(0, sent - cancelled) AS attempted, expired + undeliv + rejectd + spam AS failed FROM (SELECT " + ", ".join(f"sum({c}) AS {c}" for c in I.COUNTS) + " FROM s WHERE dimension = 'carrier'))"
_SEGMENTS = "g AS (SELECT key, s.sent, s.delivery_rate, s.failure_rate, s.expired + s.undeliv + s.rejectd + s.spam AS failed FROM s, t WHERE dimension = 'carrier_message_type' AND s.sent >= greatest(1000, t.sent * 0.001))"
_BANDS = "SELECT lower(l_returnflag) AS carrier, lower(l_linestatus) AS message_type, l_discount AS rate FROM lineitem"


@query(f"SELECT dimension, key, {', '.join(f'round({c}, 6) AS {c}' for c in (*I.RATES, *I.COUNTS))} FROM ({_campaign()})")
def campaign_rollup(spark, sf_dir):
    return rounded(campaign(spark, sf_dir).rows)


@query(f"""WITH {_S}, {_TOTALS} SELECT {', '.join(I.COUNTS)}, attempted, failed, round(delivered / attempted, 6) AS delivery_rate, round(failed / attempted, 6) AS failure_rate, round(replies / delivered, 6) AS reply_rate, round(opt_outs / delivered, 6) AS opt_out_rate,
CASE greatest(rejectd, spam, undeliv, expired) WHEN rejectd THEN 'REJECTD' WHEN spam THEN 'SPAM' WHEN undeliv THEN 'UNDELIV' ELSE 'EXPIRED' END AS dominant_reason FROM t""")
def campaign_totals(spark, sf_dir):
    return rounded(I.campaign_totals(campaign(spark, sf_dir).rows))


@query(f"WITH {_S} SELECT dimension, key, CASE greatest(rejectd, spam, undeliv, expired) WHEN rejectd THEN 'REJECTD' WHEN spam THEN 'SPAM' WHEN undeliv THEN 'UNDELIV' ELSE 'EXPIRED' END AS reason FROM s")
def dominant_reason(spark, sf_dir):
    return campaign(spark, sf_dir).rows.select("dimension", "key", I.dominant_reason(*[F.col(c) for c in ("expired", "undeliv", "rejectd", "spam")]).alias("reason"))


@query(f"""WITH {_S}, {_TOTALS}, {_SEGMENTS} SELECT * FROM (SELECT 'worst' AS board, key, round(failure_rate, 6) AS score FROM g ORDER BY round(failure_rate, 9) DESC, key LIMIT 3) UNION ALL SELECT * FROM (SELECT 'best', key, round(delivery_rate, 6) FROM g ORDER BY round(delivery_rate, 9) DESC, key LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'top_failed', key, failed FROM g ORDER BY failed DESC, key LIMIT 1)""")
def segment_leaderboard(spark, sf_dir):
    return rounded(I.leaderboard(campaign(spark, sf_dir).rows))


@query(f"""WITH {_S}, {_TOTALS}, {_SEGMENTS}, x AS (SELECT delivered / attempted AS delivery_rate, coalesce((SELECT max(failed) FROM g), 0) / failed AS concentration FROM t)
SELECT round(delivery_rate, 6) AS delivery_rate, round(concentration, 6) AS concentration, CASE WHEN delivery_rate >= 0.98 AND concentration <= 0.5 THEN 'A' WHEN delivery_rate >= 0.95 THEN 'B' WHEN delivery_rate >= 0.9 AND concentration <= 0.7 THEN 'C' ELSE 'D' END AS grade FROM x""")
def campaign_grade(spark, sf_dir):
    return rounded(I.campaign_grade(campaign(spark, sf_dir).rows))


@query(f"WITH {_S} SELECT (SELECT key FROM s WHERE dimension = 'hod' ORDER BY round(delivery_rate, 9) DESC, key LIMIT 1) AS best_hour, (SELECT key FROM s WHERE dimension = 'hod' ORDER BY round(delivery_rate, 9), key LIMIT 1) AS worst_hour, round(max(delivery_rate), 6) AS best_rate, round(min(delivery_rate), 6) AS worst_rate FROM s WHERE dimension = 'hod'")
def hour_extremes(spark, sf_dir):
    return rounded(I.hour_extremes(campaign(spark, sf_dir).rows))


@query(f"WITH {_S} SELECT dimension, key, round(failure_rate, 6) AS failure_rate, CASE WHEN failure_rate >= 0.1 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM (SELECT * FROM s ORDER BY round(failure_rate, 9) DESC, dimension, key LIMIT 1) WHERE failure_rate >= 0.05")
def hard_rule_alert(spark, sf_dir):
    return rounded(I.hard_rule_alert(campaign(spark, sf_dir).rows))


@query("SELECT o_orderpriority AS tier, lower(o_orderstatus) AS status, " + ", ".join(f"round(quantile_disc(o_totalprice, {q}), 6) AS {k}" for k, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9))) + ", count(o_totalprice) AS peer_count FROM orders GROUP BY 1, 2 HAVING count(*) >= 5")
def cohort_band(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("tier"), F.lower("o_orderstatus").alias("status"), "o_totalprice")
    return rounded(I.cohort_bands(rows, ["tier", "status"], "o_totalprice"))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of the delivery rate by year and segment, the years as an order of segments."""
    rows = messages(spark, sf_dir, _BEFORE).withColumn("rate", F.expr("delivered / (delivered + expired + undeliv + rejectd + spam)")).withColumn("ordinal", F.year("ts").cast("long"))
    facts = I.cohort_bands(rows.where("rate IS NOT NULL"), ["ordinal", "carrier", "message_type"], "rate")
    # the order of segments is total: year, then carrier and type
    facts = facts.withColumn("ordinal", F.struct("ordinal", "carrier", "message_type"))
    return I.wildcard_bands(facts.withColumn("metric", F.lit("delivery_rate")))


_BAND_ROWS = f"""b0 AS (SELECT year(ts) AS y, carrier, message_type, quantile_disc(rate, 0.25) AS p25, quantile_disc(rate, 0.5) AS median, quantile_disc(rate, 0.75) AS p75, count(*) AS peer_count FROM (SELECT *, delivered / (delivered + expired + undeliv + rejectd + spam) AS rate FROM ({_MESSAGES.format(where=_BEFORE)})) GROUP BY 1, 2, 3 HAVING count(*) >= 5),
b AS (SELECT * FROM (SELECT c AS carrier, t AS message_type, p25, median, p75, peer_count, row_number() OVER (PARTITION BY c, t ORDER BY y DESC, carrier DESC, message_type DESC) AS r FROM (SELECT carrier AS c, message_type AS t, * FROM b0 UNION ALL SELECT carrier, '*', * FROM b0 UNION ALL SELECT '*', message_type, * FROM b0)) WHERE r = 1)"""
_LOOKED = """l AS (SELECT dimension, key, metric, value, p25, median, p75, peer_count FROM (SELECT *, CASE dimension WHEN 'carrier' THEN key WHEN 'carrier_message_type' THEN split_part(key, '|', 1) WHEN 'message_type' THEN '*' END AS bc, CASE dimension WHEN 'message_type' THEN key WHEN 'carrier_message_type' THEN split_part(key, '|', 2) WHEN 'carrier' THEN '*' END AS bt FROM (SELECT * FROM s UNPIVOT (value FOR metric IN (""" + ", ".join((*I.RATES, *I.COUNTS)) + """)))) x LEFT JOIN b ON x.bc = b.carrier AND x.bt = b.message_type AND x.metric = 'delivery_rate')"""


@query(f"WITH {_S_AFTER}, {_BAND_ROWS}, {_LOOKED} SELECT dimension, key, metric, round(value, 6) AS value, round(p25, 6) AS p25, round(median, 6) AS median, round(p75, 6) AS p75, coalesce(peer_count, 0) AS peer_count FROM l")
def benchmark_lookup(spark, sf_dir):
    return rounded(I.benchmark_lookup(campaign(spark, sf_dir, _AFTER).long().drop("generated_at"), bands(spark, sf_dir))).fillna(0, ["peer_count"])


_OBSERVED = f"""{_S_AFTER}, {_BAND_ROWS}, {_LOOKED}, h AS (SELECT dimension, key, metric, value AS self_expected FROM (SELECT * FROM ({_campaign(_BEFORE)}) UNPIVOT (value FOR metric IN ({', '.join((*I.RATES, *I.COUNTS))})))),
o AS (SELECT dimension, key AS cell_key, metric, value AS actual, self_expected, median AS cohort_median, p25 AS cohort_p25, p75 AS cohort_p75, coalesce(peer_count, 0) AS cohort_peer_count, value - coalesce(self_expected, median, 0) AS deviation FROM l LEFT JOIN h USING (dimension, key, metric)),
k AS (SELECT *, CASE WHEN abs(actual - self_expected) < 0.005 THEN 'SeasonalExpected' WHEN cohort_p25 IS NULL THEN CASE WHEN self_expected IS NULL OR abs(deviation) < 0.005 THEN 'WithinNormal' ELSE 'SelfAnomaly' END
WHEN actual BETWEEN cohort_p25 AND cohort_p75 THEN CASE WHEN self_expected IS NULL THEN 'WithinNormal' ELSE 'SelfAnomaly' END WHEN actual < cohort_p25 THEN 'BelowPeers' ELSE 'AbovePeers' END AS kind, CASE WHEN metric IN ('delivery_rate', 'reply_rate') THEN 1 WHEN metric LIKE '%rate' THEN -1 ELSE 0 END AS dir FROM o),
obs AS (SELECT * EXCLUDE (dir), abs(deviation) >= 0.005 AS is_material, CASE WHEN dir <> 0 AND kind <> 'WithinNormal' THEN deviation * dir > 0 END AS is_favorable FROM k)"""


def _observed(spark, sf_dir) -> DataFrame:
    return I.observations(campaign(spark, sf_dir, _AFTER).long(), campaign(spark, sf_dir, _BEFORE).long(), bands(spark, sf_dir))


@query(f"WITH {_OBSERVED} SELECT dimension, cell_key, metric, round(actual, 6) AS actual, round(self_expected, 6) AS self_expected, round(cohort_median, 6) AS cohort_median, round(cohort_p25, 6) AS cohort_p25, round(cohort_p75, 6) AS cohort_p75, cohort_peer_count, round(deviation, 6) AS deviation, kind, is_material, is_favorable FROM obs")
def observations(spark, sf_dir):
    return rounded(_observed(spark, sf_dir))


@query(f"WITH {_OBSERVED} SELECT o.dimension, o.cell_key, metric, round(deviation, 6) AS deviation, s.sent, round(abs(deviation) * log10(1 + s.sent), 6) AS rank FROM obs o JOIN s ON o.dimension = s.dimension AND o.cell_key = s.key WHERE is_material AND is_favorable = false ORDER BY round(abs(deviation) * log10(1 + s.sent), 9) DESC, o.dimension, o.cell_key, metric LIMIT 8")
def ranked_anomalies(spark, sf_dir):
    return rounded(I.ranked_anomalies(_observed(spark, sf_dir), campaign(spark, sf_dir, _AFTER).rows))


@query(f"""WITH {_OBSERVED} SELECT dimension, cell_key, metric, concat(array_to_string(list_transform(string_split(metric, '_'), lambda w: upper(w[1]) || w[2:]), ' '), ' of ', cell_key, CASE WHEN is_favorable THEN ' improved' WHEN NOT is_favorable THEN ' declined' ELSE ' unchanged' END, ' at ', format('{{:,.1f}}', actual * 100), ' % (', format('{{:,.1f}}', deviation * 100), ' % off), ', kind) AS text FROM obs""")
def observation_text(spark, sf_dir):
    return I.observation_text(_observed(spark, sf_dir))


@query("SELECT o_orderkey, strftime(o_orderdate, '%m-%d') IN (" + ", ".join(f"'{d}'" for d in I.HOLIDAYS) + ") AS holiday FROM orders")
def holiday_flag(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", I.is_holiday(F.col("o_orderdate")).alias("holiday"))


# ---- scalar functions ------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'unknown' ELSE lower(c_mktsegment) END AS key FROM customer")
def normalize_keys(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 7 == 0, F.when(F.col("c_custkey") % 2 == 0, "  　")).otherwise(F.concat(F.lit(" \t "), F.col("c_mktsegment"), F.lit("\n ")))
    return table(spark, sf_dir, "customer").select("c_custkey", S.normalize(raw).alias("key"))


@query("SELECT doc_id, coalesce(substr(text, 1, 512), '') AS text FROM documents")
def trim_payload(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.trim_payload(F.col("text")).alias("text"))


@query("SELECT event_id, coalesce(nullif(trim(props ->> '$.k'), ''), 'unknown') AS k, 'unknown' AS broken FROM events")
def json_key(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", S.json_key(F.col("props"), "k").alias("k"), S.json_key(F.concat(F.lit("["), F.col("props")), "k").alias("broken"))


@query("SELECT event_id, event_type || ':' || user_id || '@20240101' AS cell, event_type AS dimension, user_id || '@20240101' AS key, CAST(user_id AS VARCHAR) AS short FROM events")
def format_cell_id(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", S.cell_id(F.col("event_type"), F.concat(F.col("user_id").cast("string"), F.lit("@20240101"))).alias("cell"))
    return rows.select("event_id", "cell", S.cell_dimension(F.col("cell")).alias("dimension"), S.cell_key(F.col("cell")).alias("key"), S.strip_window(S.cell_key(F.col("cell"))).alias("short"))


@query("SELECT DISTINCT event_type AS name, upper(event_type[1]) || lower(event_type[2:]) || ' Rate' AS friendly FROM events")
def friendly_names(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("event_type").alias("name"), S.friendly(F.concat("event_type", F.lit("_rate"))).alias("friendly")).distinct()


@query("SELECT event_id, true AS same, abs(value - 7) <= 0.01 * greatest(1, abs(value)) OR abs(value * 100 - 7) <= 0 OR abs(7 - value * 100) <= 0.01 * greatest(1, abs(value)) AS seven FROM events")
def numeric_guard(spark, sf_dir):
    allowed = F.array(F.abs("value"))
    shown = F.concat(F.lit("about "), F.format_string("%.4f", F.abs("value")), F.lit(" units"))
    return events(spark, sf_dir).select("event_id", S.grounded(shown, allowed).alias("same"), S.grounded(F.lit("rose to 7"), F.array("value")).alias("seven"))


# ---- event time ------------------------------------------------------------------------------------------------------

_HOUR = 3_600_000_000
_BUCKET = "make_timestamp(epoch_us(ts) - (epoch_us(ts) + 62135596800000000) % {size})"


def _window(name: str, micros: int) -> None:
    sql = f"SELECT event_type AS key, {_BUCKET.format(size=micros)} AS window_start, CAST(count(*) AS DOUBLE) AS count FROM events GROUP BY 1, 2"

    def run(spark, sf_dir):
        start = S.window_start(F.col("ts"), micros)
        return events(spark, sf_dir).groupBy(F.col("event_type").alias("key"), start.cast("timestamp_ntz").alias("window_start")).agg(F.count(F.lit(1)).cast("double").alias("count"))

    query(sql, name)(run)


_window("window_tumbling", E.window_micros("Tumbling", 7 * 24 * _HOUR))
_window("window_sliding_bucket", E.window_micros("Sliding", 7 * _HOUR * 2))
_window("window_session_bucket", E.window_micros("Session", _HOUR, gap_micros=_HOUR // 2))


@query(f"SELECT 'event_type' AS dimension, event_type || '@' || strftime({_BUCKET.format(size=7 * _HOUR)}, '%Y%m%d%H%M%S') AS key, CAST(count(*) AS DOUBLE) AS count FROM events GROUP BY 2")
def windowed_key(spark, sf_dir):
    return rollup(events(spark, sf_dir), RollupSchema.builder().dimension("event_type").count().build(), window_ts=F.col("ts"), window_micros=7 * _HOUR)


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOURS AS session_end, count(*) AS n_events FROM s GROUP BY user_id, k""")
def window_session_true(spark, sf_dir):
    rows = E.sessions(events(spark, sf_dir), "user_id", "ts", "6 hours")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


_LATE = "SELECT *, coalesce(ts < max(ts) OVER (ORDER BY event_id + (event_id * 7919) % 13, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 30 MINUTES, false) AS late FROM events"


def _lateness(spark, sf_dir) -> DataFrame:
    return E.with_lateness(events(spark, sf_dir), "ts", [F.expr("event_id + (event_id * 7919) % 13"), F.col("event_id")], 1800)


@query(f"SELECT event_id, late FROM ({_LATE})")
def late_drop(spark, sf_dir):
    return _lateness(spark, sf_dir).select("event_id", "late")


@query(f"SELECT count(*) FILTER (NOT late) AS events_processed, count(*) FILTER (late) AS late_event_drops FROM ({_LATE})")
def diagnostics(spark, sf_dir):
    return E.diagnostics(_lateness(spark, sf_dir))


@query("SELECT CAST(user_id AS VARCHAR) AS key, CAST(count(*) AS DOUBLE) AS count FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-30' - INTERVAL 24 HOURS")
def ttl_scavenge(spark, sf_dir):
    cells = events(spark, sf_dir).groupBy(F.col("user_id").cast("string").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("count"), F.max("ts").alias("last"))
    return E.scavenge(cells, "last", F.lit("2024-01-30").cast("timestamp"), "24 HOURS").select("key", "count")


@query(_CELLS.format(agg="CAST(count(*) AS DOUBLE) AS count, round(sum(value), 6) AS value"))
def stream_rollup(spark, sf_dir):
    """The rollup as a stream over the same file, run until it has taken everything."""
    name = f"rollup_{uuid.uuid4().hex}"
    static = table(spark, sf_dir, "events")
    path = f"{sf_dir}/events.parquet"
    folder, one = (path, "*") if spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(path)).isDirectory() else (sf_dir, "events.parquet")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", one).parquet(folder)
    at = f"{shared_folder(spark)}/{name}"
    E.stream_rollup(stream, by_type().count().sum("value").build(), f"{at}/state", f"{at}/cells").awaitTermination()
    return rounded(E.stream_cells(spark, f"{at}/cells"))

