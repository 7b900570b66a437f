"""The rollup: events fanned out over declared dimensions and aggregated per cell."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.scalar import normalize, window_start, windowed_key
from strataform.plans.schema import Dimension, RollupSchema


def fan_out(events: DataFrame, dimensions: Iterable[Dimension], carry: Iterable[Column] = (), start: Column | None = None) -> DataFrame:
    """A row for each event and dimension: dimension, key and the carried columns. start: of a window that the key names."""
    key = (lambda k: windowed_key(k, F.col("_start"))) if start is not None else (lambda k: k)
    dims = list(dimensions)
    flat = events.select(*[normalize(d.key).alias(f"_k{i}") for i, d in enumerate(dims)], *([start.alias("_start")] if start is not None else []), *carry)
    names = [c for c in flat.columns if not c.startswith(("_k", "_start"))]
    cells = F.array(*[F.struct(F.lit(d.name).alias("dimension"), key(F.col(f"_k{i}")).alias("key")) for i, d in enumerate(dims)])
    return flat.select(F.inline(cells), *names)


def _aggregates(schema: RollupSchema, projection: set[str] | None) -> tuple[list[Column], list[Column]]:
    """Columns to carry, and the aggregates over them. What several metrics read in the same way is carried once, so equal
    aggregates (a denominator of several ratios) are one to the planner."""
    carry, called, out = [], {}, []
    for metric, names in schema.selected(projection):
        inputs = []
        for selector, column in zip(metric.inputs, metric.input_columns()):
            read = (metric.read_as(), id(selector))
            if read not in called:
                called[read] = f"m{len(called)}"
                carry.append(column.alias(called[read]))
            inputs.append(called[read])
        out += metric.aggregates(inputs, names)
    return carry, out


def rollup(events: DataFrame, schema: RollupSchema, projection: set[str] | None = None, dimensions: set[str] | None = None, window_ts: Column | None = None, window_micros: int = 0) -> DataFrame:
    """The cells of all dimensions (or those named, which then are the only ones fanned out to): dimension, key and a
    column for each metric of the projection. Combined before the shuffle, which has a row for each cell and task."""
    dims = [d for d in schema.dimensions if dimensions is None or d.name in dimensions]
    carry, out = _aggregates(schema, projection)
    start = window_start(window_ts, window_micros) if window_ts is not None else None
    cells = fan_out(events, dims, carry, start).groupBy("dimension", "key")
    return cells.agg(*out) if out else cells.count().select("dimension", "key")


def rollup_grouping_sets(events: DataFrame, schema: RollupSchema, projection: set[str] | None = None) -> DataFrame:
    """The same cells as rollup(), as grouping sets of one dimension each."""
    carry, out = _aggregates(schema, projection)
    keys = [f"_k{i}" for i in range(len(schema.dimensions))]
    flat = events.select(*[normalize(d.key).alias(k) for d, k in zip(schema.dimensions, keys)], *carry)
    which = F.lit(None).cast("string")
    for d, k in zip(schema.dimensions, keys):
        which = F.when(F.col(k).isNotNull(), F.lit(d.name)).otherwise(which)
    rows = flat.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(*out)
    return rows.select(which.alias("dimension"), F.coalesce(*[F.col(k) for k in keys]).alias("key"), *[c for c in rows.columns if c not in keys])
