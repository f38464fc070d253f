"""Time arithmetic in whole seconds since an origin."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from staygrid.schema import as_column

# Seconds per unit, by unit name.
SECONDS = {"secs": 1, "mins": 60, "hours": 3_600, "days": 86_400, "weeks": 604_800}


def secs(n: float) -> int:
    return int(n)


def mins(n: float) -> int:
    return int(n * 60)


def hours(n: float) -> int:
    return int(n * 3_600)


def days(n: float) -> int:
    return int(n * 86_400)


def weeks(n: float) -> int:
    return int(n * 604_800)


def ms_as_mins(x: str | Column) -> Column:
    """Milliseconds to minutes."""
    return as_column(x) / F.lit(60_000)


def min_as_secs(x: str | Column) -> Column:
    return (as_column(x) * 60).cast("long")


def floor_to(t: str | Column, step: int) -> Column:
    """Floor to the interval; works for times before the origin too."""
    return F.floor(as_column(t) / F.lit(step)) * F.lit(step)


def seconds_between(origin: str | Column, t: str | Column) -> Column:
    """Whole seconds from ``origin`` to ``t``, floored also for earlier times."""
    micros = F.timestamp_diff("MICROSECOND", as_column(origin), as_column(t))
    return F.floor(micros / F.lit(1_000_000))


def hours_since(origin: str | Column, t: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", as_column(origin), as_column(t)) / F.lit(3_600_000_000)


def change_unit(x: str | Column, unit: str, new: str) -> Column:
    """Convert a duration between the units of ``SECONDS``."""
    return as_column(x) * F.lit(SECONDS[unit]) / F.lit(SECONDS[new])


def combine_date_time(time: str | Column, date: str | Column, shift: int = 43_200) -> Column:
    """The time where it is known, else the date moved by ``shift`` seconds."""
    return F.coalesce(as_column(time), F.timestamp_add("SECOND", F.lit(shift), as_column(date)))
