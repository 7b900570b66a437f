"""Snapshots: the cells of a rollup at a time, alone, in pairs and in a history."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.functions.scalar import cell_id


def metric_columns(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c.lower() not in ("dimension", "key", "generated_at", "snapshot_idx")]


def value(rows: DataFrame, metric: str):
    """A metric of a snapshot by its name in any case; 0 where there is none."""
    name = next((c for c in metric_columns(rows) if c.lower() == metric.lower()), None)
    return F.lit(0.0) if name is None else F.coalesce(rows[name].cast("double"), F.lit(0.0))


@dataclass(frozen=True)
class Snapshot:
    rows: DataFrame
    generated_at: datetime | None = None
    primary_metric: str = "count"

    @cached_property
    def metrics(self) -> list[str]:
        return metric_columns(self.rows)

    def primary(self) -> DataFrame:
        """dimension, key, cell_id, pv: the primary metric of each cell."""
        return self.rows.select("dimension", "key", cell_id().alias("cell_id"), value(self.rows, self.primary_metric).alias("pv"))

    def lookup(self, cell: str, key: str | None = None) -> DataFrame:
        """The cell by id or by dimension and key, in any case."""
        wanted = cell if key is None else f"{cell}:{key}"
        return self.rows.where(F.lower(cell_id()) == wanted.lower())

    def of_dimension(self, dimension: str) -> DataFrame:
        return self.rows.where(F.lower("dimension") == dimension.lower())

    def long(self) -> DataFrame:
        """dimension, key, metric, value, generated_at."""
        at = F.lit(self.generated_at).cast("timestamp")
        return self.rows.unpivot(["dimension", "key"], self.metrics, "metric", "value").select("dimension", "key", "metric", F.col("value").cast("double").alias("value"), at.alias("generated_at"))

    def top(self, n: int) -> DataFrame:
        """The n cells with the greatest primary metric."""
        return self.primary().orderBy(F.desc("pv"), "cell_id").limit(max(1, n))


def overlay(cold: DataFrame, hot: DataFrame) -> DataFrame:
    """Cells of cold with those of hot put over them."""
    return cold.join(hot, ["dimension", "key"], "left_anti").unionByName(hot)


def universe(snapshots: Sequence[DataFrame]) -> DataFrame:
    """The ids of all cells, each once."""
    out = None
    for s in snapshots:
        ids = s.select(cell_id().alias("cell_id"))
        out = ids if out is None else out.unionByName(ids)
    return out.distinct()


def series(history: DataFrame, metric: str = "count") -> DataFrame:
    """history: snapshots as rows with snapshot_idx. cell_id and series, an array with a value for each snapshot in order,
    0 where the cell was absent. The number of snapshots is small; their indexes travel as one row."""
    idx = history.select("snapshot_idx").distinct().agg(F.sort_array(F.collect_set("snapshot_idx")).alias("idx"))
    values = history.select(cell_id().alias("cell_id"), "snapshot_idx", value(history, metric).alias("v"))
    cells = values.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("snapshot_idx", "v"))).alias("m"), F.min("snapshot_idx").alias("first_idx"))
    dense = F.transform("idx", lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return cells.crossJoin(F.broadcast(idx)).select("cell_id", dense.alias("series"), "first_idx")


def recent(history: DataFrame, count: int) -> DataFrame:
    """The last count snapshots by order of arrival (snapshot_idx), not by time."""
    last = history.select("snapshot_idx").distinct().orderBy(F.desc("snapshot_idx")).limit(count)
    return history.join(F.broadcast(last), "snapshot_idx", "left_semi")
