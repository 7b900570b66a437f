"""What a domain plugs into the reports. Every part is optional to a report but the schema; tables are DataFrames, so an
implementation may read them from wherever Spark does."""

from __future__ import annotations

from datetime import date
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame

from strataform.operators.snapshot import Snapshot
from strataform.plans.schema import RollupSchema


@runtime_checkable
class Domain(Protocol):
    """An industry: how its events are rolled up, and what its report is made of."""

    name: str

    def schema(self) -> RollupSchema: ...

    def report(self, snapshot: Snapshot, history: DataFrame) -> dict[str, DataFrame]: ...


@runtime_checkable
class Bands(Protocol):
    """Peer bands: carrier, message_type, metric, p25, median, p75, peer_count."""

    def bands(self) -> DataFrame: ...


@runtime_checkable
class History(Protocol):
    """Earlier snapshots as long rows, the latest first."""

    def recent(self, count: int) -> list[DataFrame]: ...

    def append(self, snapshot: Snapshot) -> None: ...


@runtime_checkable
class Calendar(Protocol):
    def is_holiday(self, day: Column) -> Column: ...


@runtime_checkable
class Seasonality(Protocol):
    """What share of a usual day's volume a day is expected to have."""

    def factor(self, day: date) -> float: ...


@runtime_checkable
class Narrator(Protocol):
    """A text about a few rows of a report; callers fall back to a template where it isn't grounded in the numbers."""

    def tell(self, prompt: str) -> str: ...


@runtime_checkable
class CellStore(Protocol):
    """Where cells are kept; sources.store has the one over Parquet."""

    def write(self, cells: DataFrame) -> None: ...

    def read(self, metrics: list[str] | None = None, keys_only: bool = False) -> DataFrame: ...
