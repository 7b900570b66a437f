"""Deterministic insights on one snapshot, a pair of them, or a history.

Sums over a whole snapshot count an event once for each dimension: that is the grain of the snapshot. Every ranking has a
total order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform.functions import scalar as S
from strataform.functions.lineage import sums_before
from strataform.functions.scalar import cell_id, cosine, ewma, pearson, ratio
from strataform.operators.snapshot import Snapshot, metric_columns, series, value

ALPHA, SIGMA_FLOOR = 0.35, 1e-6
#: Bounds of skew and tail.
SKEW_RATIO, HEAVY_TAIL = 1.25, 2.5
#: Of more series than this, the ones of greatest variance are compared.
MAX_SERIES = 200
_KIND_ORDER = {"DeviationFromExpectation": 0, "ZScoreOutlier": 1, "EwmaTrendShift": 2}


def surprise(snapshot: Snapshot) -> DataFrame:
    """Each cell against the mean of its dimension: (pv - mean) / sqrt(mean + 1); dimensions that sum to 0 give none."""
    cells = snapshot.primary()
    totals = cells.groupBy("dimension").agg(F.sum("pv").alias("total"), F.count(F.lit(1)).alias("n"))  # a row for each dimension
    rows = cells.join(F.broadcast(totals), "dimension").where("total <> 0").withColumn("expected", F.col("total") / F.col("n"))
    return rows.select("cell_id", "pv", "expected", ((F.col("pv") - F.col("expected")) / F.sqrt(F.col("expected") + 1)).alias("residual")).withColumn("score", F.abs("residual"))


def historical(current: Snapshot, previous: Snapshot, alpha: float = ALPHA) -> DataFrame:
    """Each cell against all cells of the previous snapshot (z) and against its own smoothed value (shift)."""
    before = previous.primary().select(F.lower("cell_id").alias("_id"), F.col("pv").alias("prev"))
    stats = before.agg(F.avg("prev").alias("mean"), F.stddev_pop("prev").alias("sigma"))  # one row
    rows = current.primary().withColumn("_id", F.lower("cell_id")).join(before, "_id", "left").crossJoin(F.broadcast(stats))
    prev = F.coalesce("prev", F.lit(0.0))
    z = F.when(F.coalesce("sigma", F.lit(0.0)) <= SIGMA_FLOOR, F.lit(0.0)).otherwise(F.try_divide(F.col("pv") - F.col("mean"), F.col("sigma")))
    return rows.select("cell_id", "pv", prev.alias("previous"), z.alias("z"), (F.col("pv") - (F.lit(alpha) * F.col("pv") + F.lit(1 - alpha) * prev)).alias("shift"))


def interesting_cells(current: Snapshot, previous: Snapshot | None = None, top_n: int = 10) -> DataFrame:
    """kind, cell_id, score of the most striking cells: ties go by kind, then cell id."""
    kinds = [surprise(current).select(F.lit("DeviationFromExpectation").alias("kind"), "cell_id", "score")]
    if previous is not None:
        rows = historical(current, previous)
        kinds += [rows.select(F.lit("ZScoreOutlier").alias("kind"), "cell_id", F.abs("z").alias("score")), rows.select(F.lit("EwmaTrendShift").alias("kind"), "cell_id", F.abs("shift").alias("score"))]
    order = F.create_map(*[F.lit(x) for kv in _KIND_ORDER.items() for x in kv])
    return reduce(DataFrame.unionByName, kinds).orderBy(F.desc(F.round("score", 9)), order[F.col("kind")], "cell_id").limit(max(1, top_n))


def _pair(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Cells of both, by id in any case: cell_id, p, c (0 where absent)."""
    p = previous.select(F.lower("cell_id").alias("_id"), F.col("cell_id").alias("_p"), F.col("pv").alias("p"))
    c = current.select(F.lower("cell_id").alias("_id"), F.col("cell_id").alias("_c"), F.col("pv").alias("c"))
    return p.join(c, "_id", "full_outer").select(F.coalesce("_c", "_p").alias("cell_id"), F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("c", F.lit(0.0)).alias("c"))


def _contributions(rows: DataFrame, top_n: int | None, by: Sequence[str] = ()) -> DataFrame:
    """rows: by, cell_id, p, c; all of them, in no order, where top_n is None. The totals are aggregated apart, so no window
    takes all rows into one task."""
    totals = rows.groupBy(*by).agg(F.sum("p").alias("total_previous"), F.sum("c").alias("total_current"))
    rows = (rows.join(totals, list(by)) if by else rows.crossJoin(F.broadcast(totals))).withColumn("total_delta", F.col("total_current") - F.col("total_previous"))
    rows = rows.select(*by, "cell_id", F.col("p").alias("previous_value"), F.col("c").alias("current_value"), (F.col("c") - F.col("p")).alias("delta"), ratio(F.col("c") - F.col("p"), F.col("total_delta")).alias("share_of_total_delta"), "total_previous", "total_current", "total_delta")
    if top_n is None:
        return rows
    order = [F.desc(F.abs("delta")), F.col("cell_id")]
    if not by:
        return rows.orderBy(*order).limit(max(1, top_n))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= max(1, top_n)).drop("_r")


def drivers(previous: Snapshot, current: Snapshot, top_n: int = 5) -> DataFrame:
    """The cells that moved the primary metric most, with their share of the total move."""
    return _contributions(_pair(previous.primary(), current.primary()), top_n)


def drivers_for_metrics(previous: Snapshot, current: Snapshot, metrics: Sequence[str] | None = None, top_n: int = 5) -> DataFrame:
    """drivers() for each metric (by default all of both snapshots): metric and the same columns."""
    names = metrics or sorted({*previous.metrics, *current.metrics})

    def tall(s: Snapshot) -> DataFrame:
        return s.rows.select(cell_id().alias("cell_id"), F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), value(s.rows, m).alias("pv")) for m in names])))

    side = lambda df, v: df.select("metric", F.lower("cell_id").alias("_id"), F.col("cell_id").alias(f"_{v}"), F.col("pv").alias(v))
    rows = side(tall(previous), "p").join(side(tall(current), "c"), ["metric", "_id"], "full_outer")
    return _contributions(rows.select("metric", F.coalesce("_c", "_p").alias("cell_id"), F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("c", F.lit(0.0)).alias("c")), top_n, ["metric"])


def simpsons_paradox(previous: Snapshot, current: Snapshot, count: str = "count", numerator: str = "signal", min_pooled: float = 0.005, min_child: float = 0.005, min_count: float = 30) -> DataFrame:
    """parent_cell_id (the dimension), pooled_rate_delta and, for each child, child_cell_id and rate_delta: dimensions whose
    children all move one way while the pooled rate moves the other."""
    side = lambda s, v: s.rows.select(F.lower("dimension").alias("dim"), F.lower(cell_id()).alias("_id"), cell_id().alias(f"id_{v}"), value(s.rows, count).alias(f"n_{v}"), value(s.rows, numerator).alias(f"x_{v}"))
    p, c = side(previous, "p"), side(current, "c")
    rows = p.join(c.select("dim").distinct(), "dim", "left_semi").join(c, ["dim", "_id"], "full_outer")
    zero = F.lit(0.0)
    pooled = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("children"), *[F.sum(F.coalesce(f"{k}_{v}", zero)).alias(f"{k}_{v}") for k in "nx" for v in "pc"])
    pooled = pooled.where("children >= 2 AND n_p > 0 AND n_c > 0").select("dim", (F.col("x_c") / F.col("n_c") - F.col("x_p") / F.col("n_p")).alias("pooled_rate_delta"))
    pooled = pooled.where(F.abs("pooled_rate_delta") >= min_pooled)
    child = rows.where((F.col("n_p") >= min_count) & (F.col("n_c") >= min_count) & F.col("id_p").isNotNull() & F.col("id_c").isNotNull())
    child = child.select("dim", F.col("id_c").alias("child_cell_id"), (ratio(F.col("x_c"), F.col("n_c")) - ratio(F.col("x_p"), F.col("n_p"))).alias("rate_delta")).where(F.abs("rate_delta") >= min_child)
    signs = child.groupBy("dim").agg(F.count(F.lit(1)).alias("_n"), F.min(F.signum("rate_delta")).alias("_lo"), F.max(F.signum("rate_delta")).alias("_hi"))
    found = pooled.join(signs.where("_n >= 2 AND _lo = _hi"), "dim").where(F.col("_lo") != F.signum("pooled_rate_delta"))
    return found.join(child, "dim").select(F.col("dim").alias("parent_cell_id"), "pooled_rate_delta", "child_cell_id", "rate_delta")


def skew_class(mean: Column, median: Column) -> Column:
    r = F.try_divide(mean, median)
    return F.when((mean <= 0) | (median <= 0), "Unknown").when(r >= SKEW_RATIO, "RightSkewed").when(r <= 1 / SKEW_RATIO, "LeftSkewed").otherwise("Symmetric")


def distribution_shape(snapshot: Snapshot, digest: str, notable: bool = False) -> DataFrame:
    """The shape of a percentile digest in each cell; notable: only those whose mean misleads or whose tail is heavy."""
    mean, p50, p95, p99 = (value(snapshot.rows, f"{digest}_{x}") for x in ("mean", "p50", "p95", "p99"))
    rows = snapshot.rows.select(cell_id().alias("cell_id"), F.lit(digest).alias("metric_name"), mean.alias("mean"), p50.alias("median"), p95.alias("p95"), p99.alias("p99"))
    rows = rows.withColumn("skew", skew_class(F.col("mean"), F.col("median")))
    rows = rows.withColumn("mean_misleading", F.col("skew").isin("RightSkewed", "LeftSkewed")).withColumn("heavy_tail", (F.col("median") > 0) & (F.col("p99") / F.greatest("median", F.lit(1e-9)) >= HEAVY_TAIL))
    return rows.where("mean_misleading OR heavy_tail") if notable else rows


def comovement(history: DataFrame, metric: str = "count", max_lag: int = 3, top_n: int = 10, min_abs: float = 0.7, alpha: float = ALPHA, max_series: int = MAX_SERIES) -> DataFrame:
    """cell_id, other_cell_id, correlation, lag_snapshots of the pairs of smoothed series that move together; a positive lag
    means that the first leads. Ties of |r| go to the least lag. Pairs are made of max_series series at most, those of
    greatest variance, so one side is broadcast; they are ordered by first appearance, then id."""
    rows = series(history, metric).select("cell_id", "first_idx", ewma(F.col("series"), alpha).alias("s")).where(F.exists("s", lambda x: F.abs(x) > 1e-12) & (F.size("s") >= 3))
    mean = lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s)
    variance = F.aggregate("s", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / F.size("s")
    rows = rows.withColumn("m", mean(F.col("s"))).withColumn("_v", variance).orderBy(F.desc("_v"), "cell_id").limit(max_series)
    a = rows.select(F.col("cell_id").alias("cell_id"), F.struct("first_idx", "cell_id").alias("_o"), F.col("s").alias("x"))
    b = F.broadcast(rows.select(F.col("cell_id").alias("other_cell_id"), F.struct("first_idx", "cell_id").alias("_p"), F.col("s").alias("y")))

    def shifted(lag: Column) -> Column:
        n = F.greatest(F.size("x") - F.abs(lag), F.lit(0))
        left, right = F.slice("x", F.greatest(F.lit(0), -lag) + 1, n), F.slice("y", F.greatest(F.lit(0), lag) + 1, n)
        return S.bound(F.struct(left.alias("x"), right.alias("y")), lambda p: F.struct(F.round(pearson(p["x"], p["y"]), 12).alias("r"), lag.alias("lag")))

    lags = F.transform(F.sequence(F.lit(-max_lag), F.lit(max_lag)), shifted)
    better = lambda best, x: F.when(F.abs(x["r"]) > F.abs(best["r"]), x).otherwise(best)
    best = F.aggregate("lags", F.struct(F.lit(0.0).alias("r"), F.lit(0).alias("lag")), better)
    pairs = a.join(b, F.col("_o") < F.col("_p")).withColumn("lags", lags).withColumn("best", best)
    pairs = pairs.select("cell_id", "other_cell_id", F.col("best.r").alias("correlation"), F.col("best.lag").alias("lag_snapshots")).where(F.abs("correlation") >= min_abs)
    return pairs.orderBy(F.desc(F.abs("correlation")), "cell_id", "other_cell_id").limit(max(1, top_n))


def comovement_of(history: DataFrame, cell: str, n_snapshots: int, metric: str = "count", max_lag: int = 3, top_n: int = 5, min_abs: float = 0.6) -> DataFrame:
    """The pairs of one cell among the first 2 * n_snapshots of comovement()."""
    rows = comovement(history, metric, max_lag, 2 * n_snapshots, min_abs)
    return rows.where((F.lower("cell_id") == cell.lower()) | (F.lower("other_cell_id") == cell.lower())).orderBy(F.desc(F.abs("correlation")), "cell_id", "other_cell_id").limit(top_n)


def sibling_rank(snapshot: Snapshot) -> DataFrame:
    """percentile_rank (share of cells of the dimension strictly below) and share_of_dimension of each cell."""
    cells = snapshot.primary()
    totals = cells.groupBy("dimension").agg(F.sum("pv").alias("_total"), F.count(F.lit(1)).alias("_n"))  # a row for each dimension
    values = cells.groupBy("dimension", "pv").agg(F.count(F.lit(1)).alias("_same"))
    below = sums_before(values, "dimension", ["pv"], F.col("_same"), "_below").select("dimension", "pv", "_below")
    rows = cells.join(below, ["dimension", "pv"]).join(F.broadcast(totals), "dimension")
    return rows.select("cell_id", "pv", (F.col("_below") / F.col("_n")).alias("percentile_rank"), ratio(F.col("pv"), F.col("_total")).alias("share_of_dimension"))


_NO_PAIRS = "array<struct<cell_id string, other_cell_id string, correlation double, lag_snapshots int>>"


def explain(current: Snapshot, cell: str, previous: Snapshot | None = None, history: DataFrame | None = None, n_snapshots: int = 0, digest: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """One row about a cell: cell_id, dimension, key, pv, its percentile_rank and share_of_dimension among its siblings; against
    the previous snapshot previous_value, delta, ewma_baseline, sibling_z (null for fewer than two siblings then) and
    share_of_total_delta; shape (of a digest's distribution); comovements (from a history of three snapshots or more, as
    for comovement_of()); bullets, what these say in words. What isn't asked for is null or empty. An unknown cell is a
    KeyError. Siblings are aggregated, none of them is sorted or collected."""
    found = current.lookup(cell)
    if found.isEmpty():
        raise KeyError(f"no cell {cell!r} in the snapshot")
    own = found.select("dimension", "key", cell_id().alias("cell_id"), value(found, current.primary_metric).alias("pv")).limit(1)
    siblings = current.primary().select(F.col("dimension").alias("_d"), F.col("pv").alias("_pv"))
    among = siblings.join(F.broadcast(own.select(F.col("dimension").alias("_d"), F.col("pv").alias("_own"))), "_d")
    among = among.agg(F.count_if(F.col("_pv") < F.col("_own")).alias("_below"), F.count(F.lit(1)).alias("_n"), F.sum("_pv").alias("_total"))
    one = lambda a, b: a.crossJoin(F.broadcast(b))  # noqa: E731  both of one row
    row = one(own, among).select("cell_id", "dimension", "key", "pv", (F.col("_below") / F.col("_n")).alias("percentile_rank"), ratio(F.col("pv"), F.col("_total")).alias("share_of_dimension"))
    none = F.lit(None).cast("double")
    if previous is None:
        row = row.withColumns(dict.fromkeys(("previous_value", "delta", "ewma_baseline", "sibling_z", "share_of_total_delta"), none))
    else:
        before = previous.primary().where(F.lower("dimension") == cell.partition(":")[0].lower()).agg(F.count(F.lit(1)).alias("_n"), F.avg("pv").alias("_m"), F.stddev_pop("pv").alias("_s"))
        z = F.when(F.col("_n") > 1, F.when(F.col("_s") <= 1e-9, F.lit(0.0)).otherwise(F.try_divide(F.col("pv") - F.col("_m"), F.col("_s"))))
        moved = _contributions(_pair(previous.primary(), current.primary()), None).where(F.lower("cell_id") == cell.lower()).select("previous_value", "delta", "share_of_total_delta")
        row = one(one(row, before), moved).withColumns({"sibling_z": z, "ewma_baseline": F.lit(alpha) * F.col("pv") + F.lit(1 - alpha) * F.col("previous_value")}).drop("_n", "_m", "_s")
    shape = F.lit(None)
    if digest is not None:
        rows = distribution_shape(Snapshot(found, current.generated_at, current.primary_metric), digest).limit(1)
        row, shape = one(row, rows.select(F.struct(*rows.columns[1:]).alias("_shape"))), F.col("_shape")
    pairs = F.array().cast(_NO_PAIRS)
    if history is not None and n_snapshots >= 3:
        together = comovement_of(history, cell, n_snapshots).agg(F.collect_list(F.struct("cell_id", "other_cell_id", "correlation", "lag_snapshots")).alias("_pairs"))  # five at most
        row, pairs = one(row, together), F.col("_pairs")
    row = row.withColumns({"shape": shape, "comovements": pairs})
    percent = lambda c: F.concat(F.format_number(c * 100, 1), F.lit(" %"))
    number = lambda c: F.format_number(c, 2)
    says = [
        F.concat(F.lit("At "), number("pv"), F.lit(", above "), percent(F.col("percentile_rank")), F.lit(" of its siblings, "), percent(F.col("share_of_dimension")), F.lit(" of the dimension.")),
        F.when(F.col("delta").isNotNull(), F.concat(F.when(F.col("delta") < 0, "Down").otherwise("Up"), F.lit(" by "), number(F.abs("delta")), F.lit("; smoothed it stands at "), number("ewma_baseline"), F.lit("."))),
        F.when(F.abs("sibling_z") >= 2, F.concat(number("sibling_z"), F.lit(" deviations from its siblings of before."))),
        F.when(F.abs("share_of_total_delta") > 0, F.concat(percent(F.col("share_of_total_delta")), F.lit(" of the whole change comes from it."))),
        F.when(F.col("shape.heavy_tail") | F.col("shape.mean_misleading"), F.concat(F.lit("Its mean misleads: half are below "), number("shape.median"), F.lit("."))) if digest is not None else F.lit(None).cast("string"),
        F.when(F.size("comovements") > 0, F.concat(F.lit("It moves with "), F.array_join(F.transform("comovements", lambda p: F.when(F.lower(p["cell_id"]) == cell.lower(), p["other_cell_id"]).otherwise(p["cell_id"])), ", "), F.lit("."))),
    ]
    out = "cell_id dimension key pv percentile_rank share_of_dimension previous_value delta ewma_baseline sibling_z share_of_total_delta shape comovements".split()
    return row.select(*out, F.array_compact(F.array(*says)).alias("bullets"))


def signal_rate(snapshot: Snapshot, count: str = "count", signal: str = "signal") -> DataFrame:
    """signal / count of the cells that have a count."""
    n = value(snapshot.rows, count)
    return snapshot.rows.where(n > 0).select(cell_id().alias("cell_id"), (value(snapshot.rows, signal) / n).alias("signal_rate"))


def analyze_summary(current: Snapshot, previous: Snapshot | None = None, top_n: int = 5) -> DataFrame:
    """section, kind, cell_id, score. anomaly: the lowest score of each cell among the top insights; trend: signal rates;
    simpson: paradoxes, with the move of the pooled rate; flag: the insights and paradoxes that need a look, by kind;
    recommended: the insight to read first, none if there is none."""
    none = F.lit(None).cast("string")
    insights = interesting_cells(current, previous, top_n)
    top = insights.groupBy("cell_id").agg(F.min("score").alias("score")).select(F.lit("anomaly").alias("section"), none.alias("kind"), "cell_id", "score")
    out = top.unionByName(signal_rate(current).select(F.lit("trend").alias("section"), none.alias("kind"), "cell_id", F.col("signal_rate").alias("score")))
    out = out.unionByName(insights.where(F.col("kind") != "EwmaTrendShift").select(F.lit("flag").alias("section"), "kind", "cell_id", "score"))
    out = out.unionByName(interesting_cells(current, previous, 1).select(F.lit("recommended").alias("section"), "kind", "cell_id", "score"))
    if previous is not None:
        found = simpsons_paradox(previous, current).select(F.lit("SimpsonsParadox").alias("kind"), F.col("parent_cell_id").alias("cell_id"), F.col("pooled_rate_delta").alias("score")).distinct()
        out = out.unionByName(found.select(F.inline(F.array(*[F.struct(F.lit(x).alias("section"), "kind", "cell_id", "score") for x in ("simpson", "flag")]))))
    return out


def profile_vector(snapshot: Snapshot, size: int = 32) -> DataFrame:
    """vector: the greatest primary values in descending order, padded with zeros."""
    top = snapshot.primary().select("pv").orderBy(F.desc("pv")).limit(size).agg(F.sort_array(F.collect_list(F.col("pv").cast("float")), asc=False).alias("v"))
    return top.select(F.concat("v", F.array_repeat(F.lit(0.0).cast("float"), F.lit(size) - F.size("v"))).alias("vector"))


def profile_similarity(a: Snapshot, b: Snapshot, size: int = 32) -> DataFrame:
    return profile_vector(a, size).select(F.col("vector").alias("a")).crossJoin(profile_vector(b, size).select(F.col("vector").alias("b"))).select(cosine(F.col("a"), F.col("b")).alias("similarity"))


def select_alerts(insights: DataFrame, per_kind: int = 2, total: int = 3) -> DataFrame:
    """The best insight of each cell, per_kind of a kind at most, total in all."""
    order = [F.desc("score"), F.col("kind"), F.col("cell_id")]
    best = insights.withColumn("_r", F.row_number().over(Window.partitionBy("cell_id").orderBy(*order))).where("_r = 1")
    some = best.withColumn("_r", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).where(F.col("_r") <= per_kind)
    return some.drop("_r").orderBy(*order).limit(total)


class SimilarityCache:
    """Results by the profile of their snapshot: one whose vector has a cosine of threshold or more to a kept one is
    taken for it. Bounded, first in first out; it ignores everything else that the result came from."""

    def __init__(self, threshold: float = 0.99, size: int = 64) -> None:
        self.threshold, self.size, self._kept = threshold, size, []

    def get(self, vector: Sequence[float]):
        for kept, result in self._kept:
            dot, a, b = (sum(x * y for x, y in zip(p, q)) for p, q in ((vector, kept), (vector, vector), (kept, kept)))
            if a > 1e-12 and b > 1e-12 and dot / (a * b) ** 0.5 >= self.threshold:
                return result
        return None

    def put(self, vector: Sequence[float], result) -> None:
        self._kept = [*self._kept, (tuple(vector), result)][-self.size :]


__all__ = [name for name in dir() if not name.startswith("_") and name not in ("annotations", "reduce", "metric_columns")]
