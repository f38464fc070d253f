"""Table kinds: a DataFrame plus the names of its key columns.

The kind is metadata only; reinterpreting a table never touches its rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

HOUR = 3_600
DAY = 86_400


@dataclass(frozen=True)
class Table:
    """A frame with its id, time, duration, value and unit columns."""

    df: DataFrame
    ids: tuple[str, ...]
    time: str | None = None
    dur: str | None = None
    value: str | None = None
    unit: str | None = None
    interval: int | None = None

    @property
    def kind(self) -> str:
        if self.time is None:
            return "id"
        return "ts" if self.dur is None else "win"

    @property
    def meta_vars(self) -> list[str]:
        return [*self.ids, *[c for c in (self.time, self.dur) if c]]

    @property
    def data_vars(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.meta_vars]

    def as_id(self) -> "Table":
        return replace(self, time=None, dur=None, interval=None)

    def as_ts(self, time: str | None = None, interval: int = HOUR) -> "Table":
        return replace(self, time=time or self.time, dur=None, interval=interval)

    def as_win(self, dur: str, time: str | None = None) -> "Table":
        return replace(self, time=time or self.time, dur=dur)

    def with_frame(self, df: DataFrame) -> "Table":
        return replace(self, df=df)

    def rename(self, mapping: dict[str, str]) -> "Table":
        """Rename columns and follow the renames in the metadata."""
        new = lambda c: mapping.get(c, c) if c else c
        return Table(
            self.df.withColumnsRenamed(mapping),
            tuple(new(c) for c in self.ids),
            new(self.time), new(self.dur), new(self.value), new(self.unit), self.interval,
        )


def nan_to_null(df: DataFrame) -> DataFrame:
    """One missing marker only: NaN compares as a number in Spark."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def significant(df: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Flag rows of a p-value table below ``alpha``."""
    return df.withColumn("significant", F.coalesce(F.col(p) < alpha, F.lit(False)))


def filter_significant(df: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    return df.where(F.col(p) < alpha)


def names(columns: str | list[str] | tuple[str, ...]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
