"""Moving tables between patient, hospital and stay identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from staygrid.operators.aggregate import aggregator
from staygrid.schema import names


def _map(id_map: DataFrame, from_id: str, to_id: str) -> DataFrame:
    return id_map.select(from_id, to_id).distinct()


def upgrade_id(df: DataFrame, id_map: DataFrame, from_id: str, to_id: str, keep_old: bool = False) -> DataFrame:
    """One to many: every row repeats for each new id; unmapped rows keep a null id."""
    out = df.join(_map(id_map, from_id, to_id), from_id, "left")
    return out if keep_old else out.drop(from_id)


def downgrade_id(
    df: DataFrame, id_map: DataFrame, from_id: str, to_id: str, how: dict[str, str] | None = None,
    keep_old: bool = False, order: list[str] | None = None,
) -> DataFrame:
    """Many to one: numbers are averaged, other columns take the first value."""
    joined = df.join(_map(id_map, from_id, to_id), from_id, "left")
    if how is None:
        how = {
            f.name: "mean" if isinstance(f.dataType, T.NumericType) else "first"
            for f in df.schema if f.name not in (from_id, to_id)
        }
    order = order or [from_id]
    keys = [to_id, from_id] if keep_old else [to_id]
    return joined.groupBy(*keys).agg(*[aggregator(f, c, order).alias(c) for c, f in how.items()])


def change_id(
    df: DataFrame, id_map: DataFrame, from_id: str, to_id: str, direction: str, keep_old: bool = False,
    how: dict[str, str] | None = None, order: list[str] | None = None,
) -> DataFrame:
    """Convert ids ``up`` (to the finer id), ``down`` (to the coarser one) or to the ``same`` level, as the id hierarchy says."""
    if direction not in ("up", "down", "same"):
        raise ValueError(f"unknown direction: {direction}")
    if direction == "down":
        return downgrade_id(df, id_map, from_id, to_id, how, keep_old, order)
    return upgrade_id(df, id_map, from_id, to_id, keep_old)


def shift_time(df: DataFrame, time: str, offset: str, direction: str = "subtract") -> DataFrame:
    """Move times by the offset between two id origins."""
    t, by = F.col(time), F.col(offset)
    return df.withColumn(time, t - by if direction == "subtract" else t + by)


def id_map(windows: DataFrame, id_var: str, win_var: str, in_time: str = "start", out_time: str = "end") -> DataFrame:
    """Map between two id systems with the window of the second."""
    return windows.select(
        id_var, win_var, F.col(f"{win_var}_start").alias(in_time), F.col(f"{win_var}_end").alias(out_time)
    ).distinct()


def id_origin(df: DataFrame, ids: str | list[str], time: str, out: str = "origin") -> DataFrame:
    """First time of each id."""
    return df.groupBy(*names(ids)).agg(F.min(time).alias(out))


def id_windows(levels: list[tuple[DataFrame, str, str, str]], links: DataFrame) -> DataFrame:
    """Window of every id system for each row of the id hierarchy.

    ``levels`` lists (table, id, start, end) and ``links`` holds all id columns.
    """
    out = links.distinct()
    for table, key, start, end in levels:
        span = table.groupBy(key).agg(F.min(start).alias(f"{key}_start"), F.max(end).alias(f"{key}_end"))
        out = out.join(span, key, "left")
    return out


def stay_windows(
    df: DataFrame, ids: list[str], start: str, end: str, interval: int | None = None,
    left_closed: bool = True, right_closed: bool = True, tick: int = 1,
) -> DataFrame:
    """Extent of each stay, optionally cut into windows of ``interval``.

    The last window ends with the stay. Open ends move in by one ``tick``.
    """
    span = df.groupBy(*ids).agg(F.min(start).alias(start), F.max(end).alias(end)).where(
        F.col(start).isNotNull() & F.col(end).isNotNull()
    )
    if interval is None:
        return span
    lo, hi, cut = F.col(start), F.col(end), F.col("_cut")
    # an open start moves the first cut in, and the following windows with it
    moved = 0 if left_closed else tick
    cuts = span.where(lo < hi).withColumn("_cut", F.explode(F.sequence(lo, hi - 1, F.lit(interval))))
    cuts = cuts.where((cut == lo) | (cut + moved < hi))
    window_end = F.least(F.when(cut == lo, cut).otherwise(cut + moved) + interval, hi)
    if not right_closed:
        window_end = F.when(window_end == hi, window_end - tick).otherwise(window_end)
    return cuts.select(*ids, (cut + moved).alias(start), window_end.alias(end))


def convert_id(df: DataFrame, mapping: DataFrame, from_id: str, to_id: str) -> DataFrame:
    """Replace the id column through a stay table; unmapped rows are dropped."""
    return df.join(_map(mapping, from_id, to_id), from_id).drop(from_id)


def expand_wanted(wanted: DataFrame, links: DataFrame, have: str, to: str) -> DataFrame:
    """A patient list in another id system."""
    return links.join(wanted.select(have).distinct(), have, "left_semi").select(to).distinct()


def id_lookup(df: DataFrame, ids: list[str]) -> DataFrame:
    return df.select(*ids).distinct()


def weights(df: DataFrame, ids: list[str], weight: str, order: list[str], keep: str = "first") -> DataFrame:
    """One known weight per id: the first or last in ``order``."""
    return df.groupBy(*ids).agg(aggregator(keep, weight, order).alias(weight))


def add_weight(df: DataFrame, weight: DataFrame, ids: list[str], column: str = "weight", default: float | None = None) -> DataFrame:
    """Attach the weight by id, with an optional default."""
    out = df.join(weight.select(*ids, column), ids, "left")
    return out if default is None else out.withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def align_ids(
    tables: dict[str, DataFrame], to_id: str, mapping: DataFrame, from_id: str, time: str | None = None
) -> dict[str, DataFrame]:
    """All tables in one id system and with times as whole seconds."""
    out = {}
    for name, df in tables.items():
        if to_id not in df.columns:
            df = convert_id(df, mapping, from_id, to_id)
        if time and time in df.columns:
            df = df.withColumn(time, F.col(time).cast("long"))
        out[name] = df
    return out
