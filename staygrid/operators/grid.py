"""Regular time grids: flooring, gap filling, window expansion, regularity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from staygrid.functions.times import floor_to
from staygrid.operators import stats
from staygrid.operators.aggregate import aggregator, by_counts, default_aggregator
from staygrid.operators.rolling import create_intervals, fill_na, following, previous, sessions
from staygrid.schema import HOUR


def floor_times(df: DataFrame, times: list[str], step: int) -> DataFrame:
    return df.withColumns({c: floor_to(c, step) for c in times})


def change_interval(
    df: DataFrame, ids: list[str], time: str, step: int, how: str | dict[str, str] | None = "default",
    other_times: list[str] | None = None, order: list[str] | None = None, fill: bool = False, method: str = "none",
) -> DataFrame:
    """Floor all time columns and reduce to one row per id and interval.

    ``how`` is an aggregate name or a map per column; ``"default"`` chooses by
    type, and ``None`` keeps all rows. Non-numeric columns take the first value.
    """
    other_times = other_times or []
    order = order or [time]
    floored = df.withColumns({c: floor_to(c, step) for c in other_times})
    if how is None:
        out = floored.withColumn(time, floor_to(time, step))
    else:
        aggs = []
        for c in df.columns:
            if c in ids or c == time:
                continue
            kind = default_aggregator(df.schema[c].dataType)
            if isinstance(how, dict):
                f = how.get(c, "first")
            else:
                f = kind if how == "default" or kind == "first" else how
            value = F.col(c).cast("long") if f == "sum" and kind == "sum" else F.col(c)
            aggs.append(aggregator(f, value, order).alias(c))
        out = floored.groupBy(*ids, floor_to(time, step).alias("_slot")).agg(*aggs).withColumnRenamed("_slot", time)
        out = out.select(*df.columns)
    return fill_gaps(out, ids, time, step, method=method) if fill else out


def fill_gaps(
    df: DataFrame, ids: list[str], time: str, step: int, limits: DataFrame | tuple[int, int] | None = None,
    method: str = "none", start: str = "start", end: str = "end",
) -> DataFrame:
    """Complete grid per series; times must already lie on the grid.

    Without ``limits`` each row is stretched up to its next row, so no grid is
    joined. With limits (per id, or one pair for all) the grid is generated and
    the data joined to it. Methods: ``none``, ``ffill``, ``bfill``,
    ``interpolate``, ``zero``.
    """
    values = [c for c in df.columns if c not in ids and c != time]
    if limits is None:
        ahead = following(df, ids, time, {"_next": time})
        until = F.greatest(F.coalesce(F.col("_next") - step, F.col(time)), F.col(time))
        steps = F.posexplode(F.sequence(F.col(time), until, F.lit(step))).alias("_pos", "_slot")
        stretched = ahead.select(*ids, *values, steps)
        filled = stretched.select(
            *ids, F.col("_slot").alias(time), *[F.when(F.col("_pos") == 0, F.col(c)).alias(c) for c in values]
        )
    else:
        if isinstance(limits, tuple):
            limits = df.select(*ids).distinct().withColumns({start: F.lit(limits[0]), end: F.lit(limits[1])})
        span = limits.where(F.col(start) <= F.col(end))
        grid = span.select(*ids, F.explode(F.sequence(F.col(start), F.col(end), F.lit(step))).alias(time))
        filled = grid.join(df, [*ids, time], "left")
    if method == "none":
        return filled.select(*df.columns)
    numeric = [f.name for f in df.schema if f.name in values and default_aggregator(f.dataType) == "median"]
    if method == "zero":
        return filled.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in numeric}).select(*df.columns)
    return fill_na(filled, ids, time, numeric if method == "interpolate" else values, method).select(*df.columns)


def grid_limits(
    df: DataFrame, ids: list[str], time: str, stays: DataFrame | None = None, start: str = "start", end: str = "end",
    step: int = HOUR,
) -> DataFrame:
    """Grid bounds per id: the stay window where known, else the data extent."""
    extent = df.groupBy(*ids).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    if stays is None:
        return extent.select(*ids, F.col("_lo").alias(start), F.col("_hi").alias(end))
    known = stays.groupBy(*ids).agg(
        floor_to(F.min(start), step).alias("_in"), floor_to(F.max(end), step).alias("_out")
    )
    return extent.join(known, ids, "left").select(
        *ids, F.coalesce("_in", "_lo").alias(start), F.coalesce("_out", "_hi").alias(end)
    )


def expand(df: DataFrame, start: str, end: str, step: int, out: str | None = None, floored: bool = False) -> DataFrame:
    """One row per step from start to end, the end included; reversed windows are dropped.

    Start times stay as they are unless ``floored``, which floors both ends.
    """
    lo, hi = (floor_to(start, step), floor_to(end, step)) if floored else (F.col(start), F.col(end))
    keep = [c for c in df.columns if c not in (start, end)]
    return df.where(F.col(end) >= F.col(start)).select(
        *keep, F.explode(F.sequence(lo, hi, F.lit(step))).alias(out or start)
    )


def expand_windows(df: DataFrame, ids: list[str], start: str, dur: str, value: str, step: int = HOUR) -> DataFrame:
    """Grid points covered by windows of positive duration, from the floored start."""
    lo = floor_to(start, step)
    hi = lo + step * F.greatest(F.ceil((F.col(start) + F.col(dur) - lo) / step) - 1, F.lit(0))
    return df.where(F.col(dur) > 0).select(
        *ids, F.explode(F.sequence(lo, hi, F.lit(step))).alias(start), value
    ).distinct()


def expand_intervals(
    df: DataFrame, ids: list[str], order: str | list[str], value: str, group: list[str] | None = None,
    fine: int = 60, step: int = HOUR, overhang: int = HOUR, unit: str | None = None,
) -> DataFrame:
    """Charted rates to one value per interval: each value holds until the next row.

    Every row covers the points ``fine`` seconds apart up to its end. The result
    is the median over those points; points are counted per interval and not
    generated.
    """
    group = group or []
    time = [order] if isinstance(order, str) else list(order)
    ends = create_intervals(df, [*ids, *group], time, overhang=overhang, max_len=None, end="_end", shorten=fine)
    s, e = F.col(time[0]), F.col("_end")
    slots = ends.withColumn("_slot", F.explode(F.sequence(floor_to(s, step), floor_to(e, step), F.lit(step))))
    lo = F.greatest(F.ceil((F.col("_slot") - s) / fine), F.lit(0))
    hi = F.floor((F.least(e, F.col("_slot") + step - 1) - s) / fine)
    weight = hi - lo + 1
    weighted = slots.withColumn("_points", weight).where("_points > 0")
    slot = F.col("_slot").alias(time[0])
    middle = by_counts(weighted.drop(time[0]), [*ids, slot], value, {"_median": "median"}, True, F.col("_points"), [unit] if unit else None, base=df)
    return middle.withColumnRenamed("_median", value)


# --- regularity ------------------------------------------------------------------

def has_gaps(df: DataFrame, ids: list[str], time: str, step: int) -> DataFrame:
    """Per series: does the row count differ from a full grid."""
    expected = F.floor((F.max(time) - F.min(time)) / step) + 1
    return df.groupBy(*ids).agg(((F.count(time) >= 2) & (F.count(time) != expected)).alias("has_gaps"))


def any_gaps(df: DataFrame, ids: list[str], time: str, step: int) -> DataFrame:
    return has_gaps(df, ids, time, step).agg(F.coalesce(F.bool_or("has_gaps"), F.lit(False)).alias("has_gaps"))


def is_regular(df: DataFrame, ids: list[str], time: str, step: int) -> DataFrame:
    """Per series: unique times without gaps."""
    per_time = df.groupBy(*ids, time).agg(F.count(F.lit(1)).alias("_n"))
    expected = F.floor((F.max(time) - F.min(time)) / step) + 1
    return per_time.groupBy(*ids).agg(((F.max("_n") == 1) & (F.count(F.lit(1)) == expected)).alias("is_regular"))


def obeys_interval(df: DataFrame, ids: list[str], time: str, step: int) -> DataFrame:
    """One row: are all steps inside series whole multiples of ``step``."""
    from_first = df.groupBy(*ids, (F.col(time) % step).alias("_phase")).agg(F.lit(1).alias("_one"))
    phases = from_first.groupBy(*ids).agg(F.count("_one").alias("_phases"))
    return phases.agg((F.coalesce(F.max("_phases"), F.lit(1)) == 1).alias("obeys_interval"))


def detect_interval(df: DataFrame, ids: list[str], time: str, default: int = HOUR) -> DataFrame:
    """One row: the smallest positive step inside a series."""
    gaps = previous(df.select(*ids, time), ids, time, {"_before": time})
    step = F.col(time) - F.col("_before")
    return gaps.agg(F.coalesce(F.min(F.when(step > 0, step)), F.lit(default)).cast("long").alias("interval"))


def infer_interval(df: DataFrame, ids: list[str], time: str, unit: int = HOUR) -> DataFrame:
    """One row: the median step, rounded to ``unit`` and at least one unit."""
    gaps = previous(df.select(*ids, time), ids, time, {"_before": time})
    steps = gaps.select((F.col(time) - F.col("_before")).cast("double").alias("_step")).where("_step IS NOT NULL")
    return stats.quantiles(steps, [], "_step", {"_median": 0.5}).select(
        F.greatest(F.bround(F.col("_median") / unit, 0) * unit, F.lit(float(unit))).cast("long").alias("interval")
    )


# --- durations --------------------------------------------------------------------

def duration(df: DataFrame, start: str, end: str, out: str = "dur") -> DataFrame:
    return df.withColumn(out, F.col(end) - F.col(start))


def group_duration(
    df: DataFrame, ids: list[str], start: str, end: str, group: list[str] | None = None, out: str = "dur",
    unit: str | None = None, whole_hours: bool = True, drop_negative: bool = False,
) -> DataFrame:
    """Extent of each group of rows: whole hours between the floored ends, or seconds."""
    group = group or []
    lo, hi = F.min(start), F.max(end)
    length = F.floor(hi / HOUR) - F.floor(lo / HOUR) if whole_hours else hi - lo
    aggs = [lo.alias(start), length.alias(out)] + ([F.min(unit).alias(unit)] if unit else [])
    result = df.groupBy(*ids, *group).agg(*aggs)
    return result.where(F.col(out) >= 0) if drop_negative else result


def session_duration(df: DataFrame, ids: list[str], order: str | list[str], gap: int, out: str = "dur") -> DataFrame:
    """Hours covered by each run of rows without a gap over ``gap``."""
    time = order if isinstance(order, str) else order[0]
    runs = sessions(df, ids, order, gap, "_run")
    return runs.groupBy(*ids, "_run").agg(
        F.min(time).alias(time), ((F.max(time) - F.min(time)) / HOUR).alias("_hours")
    ).select(*ids, time, F.col("_hours").alias(out))


def to_window(df: DataFrame, length: int, out: str = "dur") -> DataFrame:
    return df.withColumn(out, F.lit(length))


def flag_rows(df: DataFrame, ids: list[str], value: str, time: str, out: str) -> DataFrame:
    """Rows with a time in the value column: that becomes the time, the value true."""
    return df.where(F.col(value).isNotNull()).select(*ids, F.col(value).alias(time), F.lit(True).alias(out))


def distribute_amount(
    df: DataFrame, ids: list[str], start: str, end: str, amount: str, step: int = HOUR, floored: bool = True,
) -> DataFrame:
    """Amount over a window as an hourly rate on every grid point of it.

    Windows that end before they start are dropped and empty ones last one hour.
    ``floored`` measures between floored ends.
    """
    rows = df.where((F.col(end) >= F.col(start)) & F.col(amount).isNotNull())
    lo, hi = (floor_to(start, step), floor_to(end, step)) if floored else (F.col(start), F.col(end))
    hi = F.when(hi == lo, lo + step).otherwise(hi)
    rate = F.col(amount) / ((hi - lo) / HOUR)
    grid = F.sequence(floor_to(lo, step), floor_to(hi, step), F.lit(step))
    return rows.select(*ids, F.explode(grid).alias(start), rate.alias(amount)).withColumn("unit", F.lit("units/hr"))


def any_infusion(
    df: DataFrame, ids: list[str], time: str, durations: list[str], out: str = "vaso_ind", step: int = HOUR,
    compat: bool = False,
) -> DataFrame:
    """Grid points covered by the longest of several infusion durations.

    With ``compat`` the duration itself is the end of the window.
    """
    longest = F.greatest(*durations) if len(durations) > 1 else F.col(durations[0])
    rows = df.withColumn("_dur", longest).where("_dur >= 0")
    hi = F.col("_dur") if compat else F.col(time) + F.col("_dur")
    lo = (F.floor(F.col(time) / step) if not compat else (F.col(time) / step).cast("long")) * step
    rows = rows.where(hi >= lo)
    return rows.select(*ids, F.explode(F.sequence(lo, floor_to(hi, step), F.lit(step))).alias(time)).distinct().withColumn(
        out, F.lit(True)
    )


def any_rate(rates: list[tuple[DataFrame, str]], ids: list[str], time: str, out: str = "vaso_ind") -> DataFrame:
    """Flag per time: is any rate above zero."""
    stacked: DataFrame | None = None
    for df, c in rates:
        part = df.select(*ids, time, F.coalesce(F.col(c) > 0, F.lit(False)).alias(out))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy(*ids, time).agg(F.bool_or(out).alias(out))
