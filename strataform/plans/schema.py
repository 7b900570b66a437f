"""What a rollup computes: named dimensions and metrics over the columns of an event table."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataform.functions.scalar import normalize, ratio

KINDS = ("Count", "Sum", "Min", "Max", "CountWhen", "Average", "Ratio", "TDigest", "HyperLogLog")
QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
#: A percentile sketch errs by one rank in so many and holds about so many values at most, whatever a cell's rows are; up to
#: half of it in rows it is exact.
ACCURACY = 200_000


def percentiles(column: str, ranks: Iterable[float], exact: bool = False) -> list[Column]:
    """Discrete percentiles of a column: from one sketch for all ranks, or exact ones, which hold a group's distinct values."""
    ranks = list(ranks)
    if exact:
        return [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})") for q in ranks]
    sketch = f"percentile_approx({column}, array({', '.join(map(str, ranks))}), {ACCURACY})"
    return [F.expr(f"{sketch}[{i}]") for i in range(len(ranks))]


def mean_name(name: str) -> str:
    return f"{name}_mean"


def percentile_name(name: str, p: int) -> str:
    return f"{name}_p{p}"


def unique_name(name: str) -> str:
    return f"{name}_unique"


@dataclass(frozen=True)
class Dimension:
    name: str
    key: Column = field(compare=False)


@dataclass(frozen=True)
class Metric:
    """inputs: the columns that the kind reads; exact: percentiles and distinct counts without error, in memory that grows with
    a cell's distinct values."""

    name: str
    kind: str
    inputs: tuple[Column, ...] = field(default=(), compare=False)
    exact: bool = False

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"kind of metric {self.name!r}: {self.kind!r}")

    def outputs(self) -> list[str]:
        if self.kind == "TDigest":
            return [mean_name(self.name), *(f"{self.name}_{q}" for q in QUANTILES)]
        return [unique_name(self.name)] if self.kind == "HyperLogLog" else [self.name]

    def wanted(self, projection: set[str] | None) -> list[str]:
        """Outputs under a projection of lower-case names. A digest gives only derived names that are asked for, a
        distinct count its one output for either name."""
        if projection is None:
            return self.outputs()
        if self.kind == "HyperLogLog":
            return self.outputs() if {self.name.lower(), unique_name(self.name).lower()} & projection else []
        return [x for x in self.outputs() if x.lower() in projection]

    def aggregates(self, inputs: list[str], names: list[str]) -> list[Column]:
        """The aggregates behind names, over columns that are called as inputs says."""
        x, y = [*map(F.col, inputs), F.lit(None), F.lit(None)][:2]
        if self.kind == "Count":
            out = {self.name: F.count(F.lit(1))}
        elif self.kind == "CountWhen":
            out = {self.name: F.count_if(F.coalesce(x.cast("boolean"), F.lit(False)))}
        elif self.kind == "Ratio":
            out = {self.name: ratio(F.sum(x.cast("double")), F.sum(y.cast("double")))}
        elif self.kind == "HyperLogLog":
            out = {unique_name(self.name): F.count_distinct(x) if self.exact else F.expr(f"hll_sketch_estimate(hll_sketch_agg({inputs[0]}, 14))")}
        elif self.kind == "TDigest":
            found = percentiles(inputs[0], QUANTILES.values(), self.exact)
            out = {mean_name(self.name): F.avg(x)} | {f"{self.name}_{k}": c for k, c in zip(QUANTILES, found)}
        elif self.kind == "Min":  # one NaN makes it NaN, as it does a maximum
            out = {self.name: F.when(F.bool_or(F.isnan(x)), F.lit(float("nan"))).otherwise(F.min(x))}
        else:
            out = {self.name: {"Sum": F.sum, "Max": F.max, "Average": F.avg}[self.kind](x)}
        return [F.coalesce(out[n].cast("double"), F.lit(0.0)).alias(n) for n in names]

    def read_as(self) -> str:
        return {"HyperLogLog": "string", "CountWhen": "boolean"}.get(self.kind, "double")

    def input_columns(self) -> list[Column]:
        return [normalize(c) if self.kind == "HyperLogLog" else c.cast(self.read_as()) for c in self.inputs]


@dataclass(frozen=True)
class RollupSchema:
    """At least one dimension and one metric. Of metrics with one name the last counts."""

    dimensions: tuple[Dimension, ...]
    metrics: tuple[Metric, ...]
    primary_metric: str = "count"

    def __post_init__(self) -> None:
        if not self.dimensions or not self.metrics:
            raise ValueError("a rollup needs a dimension and a metric")

    @staticmethod
    def builder() -> RollupSchemaBuilder:
        return RollupSchemaBuilder()

    def selected(self, projection: set[str] | None) -> list[tuple[Metric, list[str]]]:
        lower = None if projection is None else {x.lower() for x in projection}
        last = {m.name: m for m in self.metrics}
        return [(m, names) for m in last.values() if (names := m.wanted(lower))]


class RollupSchemaBuilder:
    """Selectors are columns, or SQL expressions as strings; those with the same string are computed once."""

    def __init__(self) -> None:
        self._parsed: dict[str, Column] = {}
        self._dimensions: list[Dimension] = []
        self._metrics: list[Metric] = []
        self._primary = "count"

    def _column(self, selector: Column | str) -> Column:
        if not isinstance(selector, str):
            return selector
        if selector not in self._parsed:
            self._parsed[selector] = F.expr(selector)
        return self._parsed[selector]

    def dimension(self, name: str, key: Column | str | None = None) -> RollupSchemaBuilder:
        self._dimensions.append(Dimension(name.strip().lower() or "unknown", self._column(name if key is None else key)))
        return self

    def _metric(self, kind: str, name: str | None, *inputs: Column | str, exact: bool = False) -> RollupSchemaBuilder:
        if name is None:
            if not isinstance(inputs[0], str):
                raise ValueError("a metric over an expression needs a name")
            name = inputs[0]
        self._metrics.append(Metric(name, kind, tuple(map(self._column, inputs)), exact))
        return self

    def count(self, name: str = "count") -> RollupSchemaBuilder:
        return self._metric("Count", name)

    def sum(self, selector: Column | str, name: str | None = None) -> RollupSchemaBuilder:
        return self._metric("Sum", name, selector)

    def min(self, selector: Column | str, name: str | None = None) -> RollupSchemaBuilder:
        return self._metric("Min", name, selector)

    def max(self, selector: Column | str, name: str | None = None) -> RollupSchemaBuilder:
        return self._metric("Max", name, selector)

    def count_when(self, predicate: Column | str, name: str) -> RollupSchemaBuilder:
        return self._metric("CountWhen", name, predicate)

    def average(self, selector: Column | str, name: str | None = None) -> RollupSchemaBuilder:
        return self._metric("Average", name, selector)

    def ratio(self, numerator: Column | str, denominator: Column | str, name: str) -> RollupSchemaBuilder:
        return self._metric("Ratio", name, numerator, denominator)

    def percentile_digest(self, selector: Column | str, name: str | None = None, exact: bool = False) -> RollupSchemaBuilder:
        """The memory of a cell is bounded unless exact."""
        return self._metric("TDigest", name, selector, exact=exact)

    def hyper_log_log(self, selector: Column | str, name: str | None = None, exact: bool = False) -> RollupSchemaBuilder:
        return self._metric("HyperLogLog", name, selector, exact=exact)

    def primary(self, name: str) -> RollupSchemaBuilder:
        self._primary = name
        return self

    def build(self) -> RollupSchema:
        return RollupSchema(tuple(self._dimensions), tuple(self._metrics), self._primary)
