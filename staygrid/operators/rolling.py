"""Rolling statistics, carrying forward and back, sessions and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from staygrid.operators import stats
from staygrid.operators.aggregate import aggregator
from staygrid.operators.slices import Acc, framed, numbered, row_framed, scan, totals
from staygrid.schema import HOUR, names

_FRAME_FUNCTIONS = {
    "max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum, "count": F.count, "std": F.stddev_samp,
    "first": F.first, "last": F.last, "max_or_na": F.max, "min_or_na": F.min,
}


def slide(
    df: DataFrame, ids: list[str], time: str, before: int, after: int = 0,
    aggs: dict[str, tuple[str, str]] | None = None, full_window: bool = False, width: int | None = None,
) -> DataFrame:
    """Aggregates over ``[t - before, t + after]`` of each row, both ends included.

    ``aggs`` maps an output to (function, column). ``full_window`` keeps only
    rows whose whole look-back lies inside the series.
    """
    out = framed(
        df, ids, time, before, after,
        {o: (lambda w, f=f, c=c: _FRAME_FUNCTIONS[f](c).over(w)) for o, (f, c) in (aggs or {}).items()},
        width,
    )
    if not full_window:
        return out
    return totals(out, ids, {"_t0": F.min(time)}).where(F.col(time) - F.col("_t0") >= before).drop("_t0")


def slide_at(
    df: DataFrame, ids: list[str], time: str, points: list[int], before: int, after: int = 0,
    aggs: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """The same at given time points; a point without rows gives no row."""
    at = F.array(*[F.lit(int(p)) for p in points])
    t = F.col(time)
    hit = F.filter(at, lambda p: (t >= p - F.lit(before)) & (t <= p + F.lit(after)))
    return (
        df.withColumn("_point", F.explode(hit))
        .groupBy(*ids, F.col("_point").alias(time))
        .agg(*[aggregator(f, c, [time]).alias(o) for o, (f, c) in (aggs or {}).items()])
    )


def slide_windows(df: DataFrame, ids: list[str], time: str, value: str, size: int, step: int | None = None) -> DataFrame:
    """Windows of ``size`` every ``step`` from the first time; the last one must fit."""
    step = step or size
    extent = totals(df, ids, {"_t0": F.min(time), "_t1": F.max(time)})
    offset = F.col(time) - F.col("_t0")
    lowest = F.greatest(F.floor((offset - size) / step) + 1, F.lit(0))
    highest = F.least(F.floor(offset / step), F.floor((F.col("_t1") - F.col("_t0") - size) / step))
    return (
        extent.where(highest >= lowest)
        .withColumn("_k", F.explode(F.sequence(lowest, highest)))
        .groupBy(*ids, (F.col("_t0") + F.col("_k") * step).alias("window_start"))
        .agg(
            F.count(F.lit(1)).alias("n_obs"),
            F.avg(value).alias(f"{value}_mean"),
            F.stddev_samp(value).alias(f"{value}_std"),
            F.min(value).alias(f"{value}_min"),
            F.max(value).alias(f"{value}_max"),
        )
        .withColumn("window_end", F.col("window_start") + size)
    )


# --- neighbours -----------------------------------------------------------------

def previous(df: DataFrame, ids: list[str], order: str | list[str], columns: dict[str, str], cell: Column | None = None) -> DataFrame:
    """Columns of the row before: ``columns`` maps output to input."""
    return _neighbour(df, ids, order, columns, cell, reverse=False)


def following(df: DataFrame, ids: list[str], order: str | list[str], columns: dict[str, str], cell: Column | None = None) -> DataFrame:
    return _neighbour(df, ids, order, columns, cell, reverse=True)


def _neighbour(df, ids, order, columns, cell, reverse):
    row = F.struct(*[F.col(c) for c in columns.values()])
    found = scan(df, ids, order, [Acc("_near", "last", row)], cell, reverse=reverse, exclusive=True)
    return found.select(
        *[c for c in df.columns if c not in columns],
        *[F.col(f"_near.{c}").alias(o) for o, c in columns.items()],
    )


# --- carrying -------------------------------------------------------------------

def locf(
    df: DataFrame, ids: list[str], order: str | list[str], columns: list[str], max_gap: int | None = None
) -> DataFrame:
    """Last observation carried forward within a series.

    With ``max_gap`` values do not cross a gap between adjacent rows longer than
    it. The gap test looks at rows, not at the distance to the observation.
    """
    return _carry(df, ids, names(order), columns, max_gap, reverse=False)


def locb(
    df: DataFrame, ids: list[str], order: str | list[str], columns: list[str], max_gap: int | None = None
) -> DataFrame:
    """Next observation carried backward, with the same gap rule."""
    return _carry(df, ids, names(order), columns, max_gap, reverse=True)


def _carry(df, ids, order, columns, max_gap, reverse):
    time = order[0]
    if max_gap is None:
        return scan(df, ids, order, [Acc(c, "last", F.col(c)) for c in columns], reverse=reverse).select(*df.columns)
    # a row starts a new run when no row lies within max_gap before it
    near = (1, max_gap) if reverse else (-max_gap, -1)
    reach = (0, max_gap) if reverse else (max_gap, 0)
    runs = framed(df, ids, time, *reach, {"_near": lambda w: F.count(F.lit(1)).over(w)}, frame=near)
    accs = [Acc("_break", "last", F.when(F.col("_near") == 0, F.col(time)))]
    accs += [
        Acc(f"_seen_{c}", "last", F.when(F.col(c).isNotNull(), F.struct(F.col(time).alias("at"), F.col(c).alias("v"))))
        for c in columns
    ]
    found = scan(runs, ids, order, accs, reverse=reverse)

    def carried(c: str) -> Column:
        at = F.col(f"_seen_{c}.at")
        same_run = (at <= F.col("_break")) if reverse else (at >= F.col("_break"))
        return F.coalesce(F.col(c), F.when(same_run, F.col(f"_seen_{c}.v"))).alias(c)

    return found.select(*[carried(c) if c in columns else c for c in df.columns])


def locf_window(
    df: DataFrame, ids: list[str], time: str, columns: list[str] | dict[str, str], window: int = 24 * HOUR
) -> DataFrame:
    """Last original value at most ``window`` back; filled values are not carried on.

    A dict maps outputs to inputs and keeps the inputs. The last value is carried
    along the slice and its age tested, so the cost does not grow with the window.
    """
    outs = columns if isinstance(columns, dict) else {c: c for c in columns}

    def seen(c: str):
        value = F.when(F.col(c).isNotNull(), F.struct(F.col(time).alias("at"), F.col(c).alias("v")))
        return lambda w: F.last(value, ignorenulls=True).over(w)

    found = framed(
        df, ids, time, window, 0, {f"_seen_{o}": seen(c) for o, c in outs.items()}, frame=(Window.unboundedPreceding, 0)
    )
    fresh = {o: F.when(F.col(time) - F.col(f"_seen_{o}.at") <= window, F.col(f"_seen_{o}.v")) for o in outs}
    return found.select(
        *[fresh[c].alias(c) if c in outs else c for c in df.columns],
        *[fresh[o].alias(o) for o in outs if o not in df.columns],
    )


def fill_na(
    df: DataFrame, ids: list[str], order: str | list[str], columns: list[str], method: str = "ffill",
    value=None, limit: int | None = None, max_gap: int | None = None,
) -> DataFrame:
    """Replace missing values per series.

    Methods: ``ffill``, ``bfill`` (with ``limit`` rows or ``max_gap``),
    ``interpolate`` (linear by row position), ``const``, ``mean``, ``median``, ``mode``.
    """
    order = names(order)
    if method == "const":
        if value is None:
            raise ValueError("const needs a value")
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns})
    if method in ("ffill", "bfill") and limit is None:
        return _carry(df, ids, order, columns, max_gap, reverse=method == "bfill")
    if method in ("ffill", "bfill", "interpolate"):
        return _fill_by_row(df, ids, order, columns, method, limit)
    if method == "mean":
        found = totals(df, ids, {f"_fill_{c}": F.avg(c) for c in columns})
    elif method == "median":
        found = df
        for c in columns:
            found = found.join(stats.quantiles(df, ids, c, {f"_fill_{c}": 0.5}), ids, "left")
    elif method == "mode":
        found = df
        for c in columns:
            found = found.join(stats.mode(df, ids, c, f"_fill_{c}"), ids, "left")
    else:
        raise ValueError(f"unknown method: {method}")
    return found.withColumns({c: F.coalesce(F.col(c), F.col(f"_fill_{c}")) for c in columns}).select(*df.columns)


def _fill_by_row(df, ids, order, columns, method, limit):
    rows = numbered(df, ids, order, "_row")

    def seen(c):
        return F.when(F.col(c).isNotNull(), F.struct(F.col("_row").alias("row"), F.col(c).alias("v")))

    if method != "bfill":
        rows = scan(rows, ids, order, [Acc(f"_back_{c}", "last", seen(c)) for c in columns])
    if method != "ffill":
        rows = scan(rows, ids, order, [Acc(f"_ahead_{c}", "last", seen(c)) for c in columns], reverse=True)

    def filled(c):
        row, back, ahead = F.col("_row"), F.col(f"_back_{c}"), F.col(f"_ahead_{c}")
        if method == "ffill":
            new = F.when(row - back.row <= limit, back.v)
        elif method == "bfill":
            new = F.when(ahead.row - row <= limit, ahead.v)
        else:
            line = back.v + (ahead.v - back.v) * (row - back.row) / (ahead.row - back.row)
            new = F.coalesce(line, back.v)
            if limit is not None:
                near = F.coalesce(row - back.row <= limit, F.lit(False)) | F.coalesce(ahead.row - row <= limit, F.lit(False))
                new = F.when(near, F.coalesce(line, back.v, ahead.v))
        return F.coalesce(F.col(c), new).alias(c)

    return rows.select(*[filled(c) if c in columns else c for c in df.columns])


# --- differences ----------------------------------------------------------------

def delta_cummin(df: DataFrame, ids: list[str], order: str | list[str], value: str, out: str = "delta") -> DataFrame:
    """Rise above the lowest value so far."""
    found = scan(df, ids, order, [Acc("_low", "min", F.col(value))])
    return found.withColumn(out, F.col(value) - F.col("_low")).drop("_low")


def delta_start(df: DataFrame, ids: list[str], order: str | list[str], value: str, out: str = "delta") -> DataFrame:
    """Change from the first known value of the series."""
    position = F.when(F.col(value).isNotNull(), F.struct(*names(order)))
    found = totals(df, ids, {"_first": F.min_by(value, position)})
    return found.withColumn(out, F.col(value) - F.col("_first")).drop("_first")


def delta_min(df: DataFrame, ids: list[str], order: str | list[str], value: str, rows: int = 24, out: str = "delta") -> DataFrame:
    """Rise above the lowest of the current and the ``rows - 1`` rows before."""
    found = row_framed(df, ids, order, rows - 1, 0, {"_low": lambda w: F.min(value).over(w)})
    return found.withColumn(out, F.col(value) - F.col("_low")).drop("_low")


def delta_group_min(df: DataFrame, ids: list[str], value: str, out: str = "delta") -> DataFrame:
    """Rise above the lowest value of the whole series."""
    return totals(df, ids, {"_low": F.min(value)}).withColumn(out, F.col(value) - F.col("_low")).drop("_low")


def increments(df: DataFrame, ids: list[str], order: str | list[str], value: str) -> DataFrame:
    """Cumulative volume to increments: the first stays, drops count as 0."""
    found = previous(df, ids, order, {"_before": value})
    step = F.greatest(F.col(value) - F.col("_before"), F.lit(0.0))
    return found.withColumn(value, F.coalesce(step, F.col(value))).drop("_before")


def padded_capped_diff(df: DataFrame, ids: list[str], order: str | list[str], padding: int, cap: int, out: str = "diff") -> DataFrame:
    """Time since the row before, ``padding`` for the first, at most ``cap``."""
    time = names(order)[0]
    found = previous(df, ids, order, {"_before": time})
    diff = F.coalesce(F.col(time) - F.col("_before"), F.lit(padding))
    return found.withColumn(out, F.least(diff, F.lit(cap))).drop("_before")


# --- sessions and intervals -------------------------------------------------------

def sessions(df: DataFrame, ids: list[str], order: str | list[str], max_gap: int = 6 * HOUR, out: str = "grp") -> DataFrame:
    """Number runs of rows without a gap over ``max_gap``, from 0."""
    order = names(order)
    gaps = previous(df, ids, order, {"_before": order[0]})
    gaps = gaps.withColumn("_gap", F.when(F.col(order[0]) - F.col("_before") > max_gap, 1))
    return scan(gaps, ids, order, [Acc(out, "count", F.col("_gap"))]).drop("_before", "_gap")


def create_intervals(
    df: DataFrame, ids: list[str], order: str | list[str], overhang: int = HOUR, max_len: int | None = 6 * HOUR,
    end: str = "end", shorten: int = 0,
) -> DataFrame:
    """End time of each row: the next row, ``overhang`` for the last, at most ``max_len``.

    ``shorten`` is taken off every length, never below zero.
    """
    time = names(order)[0]
    found = following(df, ids, order, {"_next": time})
    length = F.coalesce(F.col("_next") - F.col(time), F.lit(overhang))
    if max_len is not None:
        length = F.least(length, F.lit(max_len))
    length = F.greatest(length - shorten, F.lit(0))
    return found.withColumn(end, F.col(time) + length).drop("_next")


def record_durations(
    df: DataFrame, ids: list[str], order: str | list[str], padding: int = 4 * HOUR, max_gap: int = 12 * HOUR, out: str = "dur"
) -> DataFrame:
    """Time to the next record as duration; ``padding`` for the last and across long gaps."""
    time = names(order)[0]
    found = following(df, ids, order, {"_next": time})
    diff = F.coalesce(F.col("_next") - F.col(time), F.lit(padding))
    return found.withColumn(out, F.when(diff > max_gap, F.lit(padding)).otherwise(diff)).drop("_next")


# --- checks -----------------------------------------------------------------------

def is_sorted(df: DataFrame, ids: list[str], sequence: str, time: str) -> DataFrame:
    """Per series: does time never fall along ``sequence``."""
    found = previous(df, ids, sequence, {"_before": time})
    return found.groupBy(*ids).agg(F.bool_and(F.coalesce(F.col("_before") <= F.col(time), F.lit(True))).alias("is_sorted"))


def time_consistency(df: DataFrame, ids: list[str], time: str, max_gap: int = 30 * 24 * HOUR) -> DataFrame:
    """Series with gaps over ``max_gap``: how many and the longest."""
    found = previous(df, ids, time, {"_before": time}).withColumn("_gap", F.col(time) - F.col("_before"))
    return found.where(F.col("_gap") > max_gap).groupBy(*ids).agg(
        F.lit("large_time_gap").alias("issue"), F.count(F.lit(1)).alias("n_occurrences"), F.max("_gap").alias("max_gap")
    )
