"""Matching rows of two series by the nearest time, without pairing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from staygrid.functions.scalars import number
from staygrid.operators.rolling import slide
from staygrid.operators.slices import SLICE, Acc, scan
from staygrid.schema import HOUR

_SIDE, _FOUND = "_side", "_found"


def _stack(left: DataFrame, right: DataFrame, ids: list[str], time: str, columns: list[str]) -> DataFrame:
    """Both series in one frame; right rows carry their values in a struct."""
    found = F.struct(F.col(time).alias("at"), *[F.col(c) for c in columns])
    marked = right.where(F.col(time).isNotNull()).select(*ids, time, F.lit(0).alias(_SIDE), found.alias(_FOUND))
    return left.withColumn(_SIDE, F.lit(1)).unionByName(marked, allowMissingColumns=True)


def asof(
    left: DataFrame, right: DataFrame, ids: list[str], time: str, columns: list[str],
    direction: str = "backward", tolerance: int | None = None, matched_time: str | None = None,
) -> DataFrame:
    """Each left row with the ``columns`` of its nearest right row.

    ``direction`` is ``backward`` (at or before), ``forward`` (at or after) or
    ``nearest`` (an equal distance takes the earlier row). Rows without a match
    keep nulls. With a tolerance, right rows are copied into the slices they can
    reach and one window per slice finds the match; without one a two-level scan
    carries it along the series.
    """
    stacked = _stack(left, right, ids, time, columns)
    back = direction in ("backward", "nearest")
    ahead = direction in ("forward", "nearest")
    order = [time, _SIDE, _FOUND]
    if tolerance is None:
        matched = stacked
        if back:
            matched = scan(matched, ids, order, [Acc("_back", "last", F.col(_FOUND))])
        if ahead:
            # right rows of the same time come before the left row in both directions
            flipped = matched.withColumn(_SIDE, -F.col(_SIDE))
            matched = scan(flipped, ids, order, [Acc("_ahead", "last", F.col(_FOUND))], reverse=True)
        own = F.abs(F.col(_SIDE)) == 1
    else:
        width = max(4 * tolerance, 1)
        t, is_right = F.col(time), F.col(_SIDE) == 0
        lo = F.when(is_right & F.lit(ahead), t - tolerance).otherwise(t)
        hi = F.when(is_right & F.lit(back), t + tolerance).otherwise(t)
        spread = stacked.withColumn(SLICE, F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
        seen = []
        if back:
            w = Window.partitionBy(*ids, SLICE).orderBy(time, _SIDE, _FOUND)
            seen.append(F.last(_FOUND, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_back"))
        if ahead:
            w = Window.partitionBy(*ids, SLICE).orderBy(F.col(time).desc(), F.col(_SIDE), F.col(_FOUND).desc())
            seen.append(F.last(_FOUND, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_ahead"))
        matched = spread.select("*", *seen)
        own = F.col(_SIDE) == 1
    hit = _pick(time, back, ahead, tolerance)
    return matched.where(own).select(
        *left.columns,
        *[hit[c].alias(c) for c in columns],
        *([hit["at"].alias(matched_time)] if matched_time else []),
    )


def _pick(time: str, back: bool, ahead: bool, tolerance: int | None) -> Column:
    t = F.col(time)

    def within(name: str, distance: Column) -> Column:
        c = F.col(name)
        return c if tolerance is None else F.when(distance <= tolerance, c)

    b = within("_back", t - F.col("_back.at")) if back else None
    a = within("_ahead", F.col("_ahead.at") - t) if ahead else None
    if b is None or a is None:
        return a if b is None else b
    closer_ahead = (a["at"] - t) < (t - b["at"])
    return F.when(F.coalesce(closer_ahead, b.isNull()), a).otherwise(b)


# --- oxygen ratios ------------------------------------------------------------------

def oxygen_ratio(
    o2: DataFrame, fio2: DataFrame, ids: list[str], time: str, o2_col: str = "po2", fio2_col: str = "fio2",
    mode: str = "match_vals", window: int = 2 * HOUR, fix_na_fio2: bool = True, out: str = "pafi",
) -> DataFrame:
    """``100 * o2 / fio2`` at each oxygen value.

    Modes: ``match_vals`` equal times, ``extreme_vals`` nearest within the
    window, ``fill_gaps`` last one before. Missing inspired oxygen counts as 21 %.
    """
    left, right = o2.select(*ids, time, o2_col), fio2.select(*ids, time, fio2_col)
    if mode == "match_vals":
        joined = left.join(right, [*ids, time], "left")
    elif mode == "extreme_vals":
        joined = asof(left, right, ids, time, [fio2_col], "nearest", window)
    elif mode == "fill_gaps":
        joined = asof(left, right, ids, time, [fio2_col])
    else:
        raise ValueError(f"unknown mode: {mode}")
    return _ratio(joined, ids, time, o2_col, fio2_col, fix_na_fio2, out)


def _ratio(df, ids, time, o2_col, fio2_col, fix_na_fio2, out):
    a, f = number(df, o2_col), number(df, fio2_col)
    if fix_na_fio2:
        f = F.coalesce(f, F.lit(21.0))
    return df.where(a.isNotNull() & (f > 0)).select(*ids, time, (a * 100 / f).alias(out))


def match_fio2(
    o2: DataFrame, fio2: DataFrame, ids: list[str], time: str, o2_col: str = "po2", fio2_col: str = "fio2",
    mode: str = "match_vals", window: int = 2 * HOUR, fix_na_fio2: bool = True,
) -> DataFrame:
    """Pairs of oxygen and inspired oxygen values.

    ``match_vals`` matches each side to the last value of the other within the
    window. ``extreme_vals`` takes the lowest oxygen and highest inspired oxygen
    of the window at every time of either; ``fill_gaps`` does so on an hourly grid.
    """
    left, right = o2.select(*ids, time, o2_col), fio2.select(*ids, time, fio2_col)
    columns = [*ids, time, o2_col, fio2_col]
    if mode == "match_vals":
        by_o2 = asof(left, right, ids, time, [fio2_col], "backward", window)
        by_fio2 = asof(right, left, ids, time, [o2_col], "backward", window)
        # inspired oxygen rows only count for series that have oxygen values at all
        by_fio2 = by_fio2.join(left.select(*ids).distinct(), ids, "left_semi")
        pairs = by_o2.select(*columns).unionByName(by_fio2.select(*columns)).distinct()
    else:
        none = F.lit(None).cast("double")
        both = left.withColumn(fio2_col, none).unionByName(right.withColumn(o2_col, none))
        both = both.groupBy(*ids, time).agg(F.min(o2_col).alias(o2_col), F.max(fio2_col).alias(fio2_col))
        if mode == "fill_gaps":
            from staygrid.operators.grid import fill_gaps

            both = fill_gaps(both, ids, time, HOUR)
        pairs = slide(both, ids, time, window, 0, {o2_col: ("min", o2_col), fio2_col: ("max", fio2_col)})
    if fix_na_fio2:
        pairs = pairs.withColumn(fio2_col, F.coalesce(F.col(fio2_col), F.lit(21.0)))
    return pairs.select(*columns)


def driving_pressure(plateau: DataFrame, peep: DataFrame, ids: list[str], time: str, plateau_col: str = "plateau_pres",
                     peep_col: str = "peep", window: int = HOUR) -> DataFrame:
    """Plateau minus end-expiratory pressure nearest in time; only positive results."""
    pairs = asof(plateau.select(*ids, time, plateau_col), peep.select(*ids, time, peep_col), ids, time, [peep_col], "nearest", window)
    return pairs.select(*ids, time, (F.col(plateau_col) - F.col(peep_col)).alias("driving_pres")).where("driving_pres > 0")


def ventilation_windows(
    starts: DataFrame, ends: DataFrame | None, ids: list[str], time: str,
    match_win: int = 6 * HOUR, min_length: int = 1_800, compat: bool = False,
) -> DataFrame:
    """Windows from start events to the next end event within ``match_win``.

    A start without an end lasts ``match_win``; with ``compat`` it lasts its own
    start time plus ``match_win``. Shorter windows than ``min_length`` are dropped.
    """
    open_length = F.col(time) + match_win if compat else F.lit(match_win)
    if ends is None:
        windows = starts.select(*ids, time).withColumn("dur", open_length)
    else:
        windows = asof(starts.select(*ids, time), ends.select(*ids, time), ids, time, [], "forward", match_win, "_end")
        windows = windows.withColumn("dur", F.coalesce(F.col("_end") - F.col(time), open_length)).drop("_end")
    return windows.where(F.col("dur") >= min_length)
