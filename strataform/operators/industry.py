"""Campaign reports: message events rolled up, cells classified against their own history and peer bands, and the report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform.functions.lineage import cut
from strataform.functions.scalar import day_bucket, hour_bucket, ratio
from strataform.operators.snapshot import Snapshot, value
from strataform.plans.schema import RollupSchema, percentiles

MATERIALITY = 0.005
#: The direction of each rate; other metrics are neutral.
HIGHER_IS_BETTER = ("delivery_rate", "reply_rate")
LOWER_IS_BETTER = ("failure_rate", "rejectd_rate", "spam_rate", "opt_out_rate")
RATES = ("delivery_rate", "failure_rate", "rejectd_rate", "spam_rate", "reply_rate", "opt_out_rate")
COUNTS = ("sent", "delivered", "expired", "undeliv", "rejectd", "spam", "cancelled", "replies", "opt_outs")
#: Month and day of South African holidays.
HOLIDAYS = ("01-01", "03-21", "04-27", "05-01", "06-16", "08-09", "09-24", "12-16", "12-25", "12-26")


def message_schema() -> RollupSchema:
    """Of events with carrier, message_type, ts and the counters delivered, expired, undeliv, rejectd, spam, cancelled,
    replies, opt_outs."""
    failed = "expired + undeliv + rejectd + spam"
    attempted = f"delivered + {failed}"
    b = RollupSchema.builder().dimension("carrier").dimension("message_type")
    b = b.dimension("carrier_message_type", F.concat_ws("|", "carrier", "message_type")).dimension("dow", day_bucket(F.col("ts"))).dimension("hod", hour_bucket(F.col("ts")))
    b = b.ratio("delivered", attempted, "delivery_rate").ratio(failed, attempted, "failure_rate").ratio("rejectd", attempted, "rejectd_rate").ratio("spam", attempted, "spam_rate")
    b = b.ratio("replies", "delivered", "reply_rate").ratio("opt_outs", "delivered", "opt_out_rate").sum(f"{attempted} + cancelled", "sent")
    for name in COUNTS[1:]:
        b = b.sum(name)
    return b.primary("delivery_rate").build()


def cohort_bands(facts: DataFrame, by: Sequence[str], rate: str, min_peers: int = 5) -> DataFrame:
    """p25, median, p75, p90 and peer_count of a rate in each cohort of min_peers or more; discrete percentiles, from a sketch."""
    ranks = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    rows = facts.groupBy(*by).agg(*[c.alias(k) for k, c in zip(ranks, percentiles(rate, ranks.values()))], F.count(rate).alias("peer_count"))
    return rows.where(F.col("peer_count") >= min_peers)


def wildcard_bands(segments: DataFrame) -> DataFrame:
    """segments: ordinal, carrier, message_type, metric and band columns. Adds (carrier, *) and (*, message_type), where the
    last segment by ordinal wins."""
    band = [c for c in segments.columns if c not in ("ordinal", "carrier", "message_type")]
    keys = F.array(*[F.struct(c.alias("carrier"), m.alias("message_type")) for c, m in ((F.lower("carrier"), F.lower("message_type")), (F.lower("carrier"), F.lit("*")), (F.lit("*"), F.lower("message_type")))])
    rows = segments.select("ordinal", *band, F.inline(keys))
    return rows.groupBy("carrier", "message_type", "metric").agg(F.max_by(F.struct(*[c for c in band if c != "metric"]), "ordinal").alias("b")).select("carrier", "message_type", "metric", "b.*")


def band_key(dimension: Column, key: Column) -> tuple[Column, Column]:
    """The carrier and message type whose band a cell has; null for other dimensions."""
    d = F.lower(dimension)
    pair = d == "carrier_message_type"
    carrier = F.when(d == "carrier", F.lower(key)).when(pair, F.lower(F.substring_index(key, "|", 1))).when(d == "message_type", "*")
    kind = F.when(d == "message_type", F.lower(key)).when(pair, F.lower(F.substring_index(key, "|", -1))).when(d == "carrier", "*")
    return carrier, kind


def benchmark_lookup(long: DataFrame, bands: DataFrame) -> DataFrame:
    """Each cell and metric of a long snapshot with its band, if any."""
    carrier, kind = band_key(F.col("dimension"), F.col("key"))
    rows = long.withColumns({"_c": carrier, "_t": kind})
    b = bands.select(F.col("carrier").alias("_c"), F.col("message_type").alias("_t"), F.col("metric").alias("_m"), "p25", "median", "p75", "peer_count")
    return rows.join(b, (rows["_c"] == b["_c"]) & (rows["_t"] == b["_t"]) & (F.lower(rows["metric"]) == b["_m"]), "left").select(*long.columns, "p25", "median", "p75", "peer_count")


def classify(actual: Column, self_expected: Column, p25: Column, p75: Column, deviation: Column, shared: Column, floor: float) -> Column:
    """The kind of an observation; the first rule that holds counts."""
    self_ok = self_expected.isNull() | (F.abs(actual - self_expected) < floor)
    return (
        F.when(self_expected.isNotNull() & (F.abs(actual - self_expected) < floor), "SeasonalExpected")
        .when(shared & (deviation != 0), "SharedCause")
        .when(p25.isNull(), F.when(self_expected.isNull() | (F.abs(deviation) < floor), "WithinNormal").otherwise("SelfAnomaly"))
        .when(actual.between(p25, p75), F.when(self_ok, "WithinNormal").otherwise("SelfAnomaly"))
        .when(actual < p25, "BelowPeers")
        .otherwise("AbovePeers")
    )


def observations(current: DataFrame, history: DataFrame, bands: DataFrame, moving: DataFrame | None = None, floor: float = MATERIALITY) -> DataFrame:
    """One row for each cell and metric. current: long snapshot; history: the latest earlier one, long; moving: cell_id of
    cells that move together with others (given from three snapshots on)."""
    key = [F.lower("dimension").alias("_d"), F.lower("key").alias("_k"), F.lower("metric").alias("_m")]
    before = history.select(*key, F.col("value").alias("self_expected"))
    rows = benchmark_lookup(current.select("dimension", "key", "metric", F.col("value").alias("actual")), bands).withColumns({"_d": F.lower("dimension"), "_k": F.lower("key"), "_m": F.lower("metric")})
    rows = rows.join(before, ["_d", "_k", "_m"], "left")
    shared = F.lit(False)
    if moving is not None:
        rows = rows.join(moving.select(F.lower("cell_id").alias("_cell")).distinct().withColumn("_shared", F.lit(True)), F.concat_ws(":", "_d", "_k") == F.col("_cell"), "left")
        shared = F.coalesce("_shared", F.lit(False))
    deviation = F.col("actual") - F.coalesce("self_expected", "median", F.lit(0.0))
    kind = classify(F.col("actual"), F.col("self_expected"), F.col("p25"), F.col("p75"), deviation, shared, floor)
    direction = F.when(F.col("_m").isin(*HIGHER_IS_BETTER), 1).when(F.col("_m").isin(*LOWER_IS_BETTER), -1).otherwise(0)
    rows = rows.withColumns({"deviation": deviation, "kind": kind, "_dir": direction})
    good = F.when((F.col("_dir") != 0) & (F.col("kind") != "WithinNormal"), F.col("deviation") * F.col("_dir") > 0)
    return rows.select("dimension", F.col("key").alias("cell_key"), "metric", "actual", "self_expected", F.col("median").alias("cohort_median"), F.col("p25").alias("cohort_p25"), F.col("p75").alias("cohort_p75"), F.coalesce("peer_count", F.lit(0)).cast("long").alias("cohort_peer_count"), "deviation", "kind", (F.abs("deviation") >= floor).alias("is_material"), good.alias("is_favorable"))


def dominant_reason(expired: Column, undeliv: Column, rejectd: Column, spam: Column) -> Column:
    """The reason of most failures; ties go to REJECTD, SPAM, UNDELIV, EXPIRED in this order."""
    top = F.greatest(rejectd, spam, undeliv, expired)
    return F.when(rejectd == top, "REJECTD").when(spam == top, "SPAM").when(undeliv == top, "UNDELIV").otherwise("EXPIRED")


def campaign_totals(snapshot: DataFrame) -> DataFrame:
    """One row: sums over the carrier dimension, and what follows from them."""
    rows = snapshot.where(F.lower("dimension") == "carrier").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in COUNTS])
    rows = rows.withColumns({"attempted": F.greatest(F.lit(0.0), F.col("sent") - F.col("cancelled")), "failed": F.col("expired") + F.col("undeliv") + F.col("rejectd") + F.col("spam")})
    part = lambda a, b: F.when(F.col(b) <= 0, F.lit(0.0)).otherwise(ratio(F.col(a), F.col(b)))
    rows = rows.withColumns({"delivery_rate": part("delivered", "attempted"), "failure_rate": part("failed", "attempted"), "reply_rate": part("replies", "delivered"), "opt_out_rate": part("opt_outs", "delivered")})
    return rows.withColumn("dominant_reason", dominant_reason(*[F.col(c) for c in ("expired", "undeliv", "rejectd", "spam")]))


def segments(snapshot: DataFrame) -> DataFrame:
    """Carrier and message type cells with at least max(1000, 0.1 % of all) sent."""
    total = campaign_totals(snapshot).select(F.greatest(F.lit(1000.0), F.col("sent") * 0.001).alias("_floor"), F.col("failure_rate").alias("_rate"))  # one row
    rows = snapshot.where(F.lower("dimension") == "carrier_message_type").crossJoin(F.broadcast(total)).where("sent >= _floor")
    failed = F.col("expired") + F.col("undeliv") + F.col("rejectd") + F.col("spam")
    return rows.select("key", "sent", "delivery_rate", "failure_rate", F.when(F.col("_rate") <= 0, 0.0).otherwise(ratio(F.col("failure_rate"), F.col("_rate"))).alias("failure_index"), failed.alias("failed"), "rejectd", "spam", "expired", "undeliv")


def leaderboard(snapshot: DataFrame, n: int = 3) -> DataFrame:
    """board, key, score: the worst and best segments and the one with most failures."""
    rows = segments(snapshot)
    top = lambda name, by, k: rows.orderBy(F.desc(F.round(by, 9)), "key").limit(k).select(F.lit(name).alias("board"), "key", F.col(by).alias("score"))
    return top("worst", "failure_rate", n).unionByName(top("best", "delivery_rate", n)).unionByName(top("top_failed", "failed", 1))


def worst_by_reason(snapshot: DataFrame) -> DataFrame:
    """reason, key, rate: the segment with the greatest rate of each reason."""
    rows = segments(snapshot).withColumn("_a", F.col("sent"))
    rate = {"REJECTD": F.col("rejectd"), "SPAM": F.col("spam"), "UNDELIV+EXPIRED": F.col("undeliv") + F.col("expired")}
    rows = rows.select("key", F.inline(F.array(*[F.struct(F.lit(k).alias("reason"), ratio(v, F.col("_a")).alias("rate")) for k, v in rate.items()])))
    return rows.groupBy("reason").agg(F.max_by("key", F.struct(F.round("rate", 9), F.col("key"))).alias("key"), F.max("rate").alias("rate"))


def grade(delivery_rate: Column, concentration: Column) -> Column:
    return F.when((delivery_rate >= 0.98) & (concentration <= 0.5), "A").when(delivery_rate >= 0.95, "B").when((delivery_rate >= 0.90) & (concentration <= 0.7), "C").otherwise("D")


def campaign_grade(snapshot: DataFrame) -> DataFrame:
    """One row: delivery_rate, concentration (share of failures in the top segment) and grade."""
    top = segments(snapshot).agg(F.max("failed").alias("_top"))
    rows = campaign_totals(snapshot).crossJoin(F.broadcast(top))
    part = F.when(F.col("_top").isNull() | (F.col("failed") <= 0), F.lit(0.0)).otherwise(ratio(F.col("_top"), F.col("failed")))
    return rows.select("delivery_rate", part.alias("concentration")).withColumn("grade", grade(F.col("delivery_rate"), F.col("concentration")))


def ranked_anomalies(found: DataFrame, snapshot: DataFrame, n: int = 8) -> DataFrame:
    """Material unfavourable observations by |deviation| * log10(1 + sent)."""
    sent = snapshot.select(F.lower("dimension").alias("_d"), F.lower("key").alias("_k"), value(snapshot, "sent").alias("sent"))
    rows = found.where(F.col("is_material") & (F.col("is_favorable") == F.lit(False)))
    rows = rows.join(sent, (F.lower("dimension") == F.col("_d")) & (F.lower("cell_key") == F.col("_k")), "left").withColumn("sent", F.coalesce("sent", F.lit(0.0)))
    rows = rows.select("dimension", "cell_key", "metric", "deviation", "sent", (F.abs("deviation") * F.log10(F.greatest("sent", F.lit(0.0)) + 1)).alias("rank"))
    return rows.orderBy(F.desc(F.round("rank", 9)), "dimension", "cell_key", "metric").limit(n)


def flow_shares(snapshot: DataFrame) -> DataFrame:
    """stage, outcome, share: how what was sent splits into cancelled and attempted, and that into delivered and the reasons."""
    t = campaign_totals(snapshot)
    parts = [("sent", "cancelled"), ("sent", "attempted"), *(("attempted", x) for x in ("delivered", "expired", "undeliv", "rejectd", "spam"))]
    return t.select(F.inline(F.array(*[F.struct(F.lit(a).alias("stage"), F.lit(b).alias("outcome"), F.when(F.col(a) <= 0, F.lit(0.0)).otherwise(ratio(F.col(b), F.col(a))).alias("share")) for a, b in parts])))


def hour_extremes(snapshot: DataFrame) -> DataFrame:
    """One row: the hours of best and worst delivery; ties go to the earlier hour."""
    rows = snapshot.where(F.lower("dimension") == "hod").withColumn("_r", F.round("delivery_rate", 9))
    return rows.agg(F.min_by("key", F.struct(-F.col("_r"), F.col("key"))).alias("best_hour"), F.min_by("key", F.struct("_r", "key")).alias("worst_hour"), F.max("delivery_rate").alias("best_rate"), F.min("delivery_rate").alias("worst_rate"))


def hard_rule_alert(snapshot: DataFrame) -> DataFrame:
    """The cell of the greatest failure rate, if that is 5 % or more."""
    top = snapshot.orderBy(F.desc(F.round("failure_rate", 9)), "dimension", "key").limit(1).where("failure_rate >= 0.05")
    return top.select("dimension", "key", "failure_rate", F.when(F.col("failure_rate") >= 0.1, "CRITICAL").otherwise("WARNING").alias("severity"))


def is_holiday(date: Column, days: Sequence[str] = HOLIDAYS) -> Column:
    return F.date_format(date, "MM-dd").isin(*days)


def observation_text(found: DataFrame) -> DataFrame:
    """A sentence for each observation."""
    how = F.when(F.col("is_favorable"), "improved").when(~F.col("is_favorable"), "declined").otherwise("unchanged")
    percent = lambda c: F.concat(F.format_number(c * 100, 1), F.lit(" %"))
    text = F.concat_ws(" ", F.initcap(F.replace("metric", F.lit("_"), F.lit(" "))), F.lit("of"), F.col("cell_key"), how, F.lit("at"), percent(F.col("actual")), F.concat(F.lit("("), percent(F.col("deviation")), F.lit(" off),")), F.col("kind"))
    return found.select("dimension", "cell_key", "metric", text.alias("text"))


def build_report(snapshot: Snapshot, history: DataFrame, bands: DataFrame, moving: DataFrame | None = None) -> dict[str, DataFrame]:
    """All parts of a campaign report by name."""
    rows = cut(snapshot.rows)  # every part reads the cells, which are rolled up once
    snapshot = Snapshot(rows, snapshot.generated_at, snapshot.primary_metric)
    found = observations(snapshot.long(), history, bands, moving)
    return {"observations": found, "totals": campaign_totals(rows), "leaderboard": leaderboard(rows), "reasons": worst_by_reason(rows), "anomalies": ranked_anomalies(found, rows), "hours": hour_extremes(rows), "grade": campaign_grade(rows), "flow": flow_shares(rows)}
