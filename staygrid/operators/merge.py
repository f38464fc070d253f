"""Bringing concept tables together on id and time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from staygrid.operators.aggregate import aggregator
from staygrid.schema import Table


def to_long(tables: dict[str, DataFrame], ids: list[str], time: str, dtype: str = "double") -> DataFrame:
    """Stack concept tables as (id, t, concept, value)."""
    parts = [
        df.select(*ids, time, F.lit(name).alias("concept"), F.col(name).cast(dtype).alias("value"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def merge_wide(
    tables: dict[str, DataFrame], ids: list[str], time: str, static: dict[str, DataFrame] | None = None, how: str = "max"
) -> DataFrame:
    """Full outer merge of many concept tables with a single shuffle.

    Tables are stacked and pivoted, not joined one after the other. ``static``
    tables (one row per id) are then attached to every time of the id.
    """
    wide = to_long(tables, ids, time).groupBy(*ids, time).pivot("concept", list(tables)).agg(aggregator(how, "value"))
    for df in (static or {}).values():
        wide = wide.join(df, ids, "left")
    return wide


def merge_full(tables: list[DataFrame], on: list[str], how: str = "full") -> DataFrame:
    """Successive joins on the keys, for tables with several columns each."""
    return reduce(lambda a, b: a.join(b, on, how), tables)


def time_grid(tables: list[DataFrame], ids: list[str], time: str) -> DataFrame:
    """Every (id, time) of any table; ids known only from static tables get a null time."""
    timed = [t.select(*ids, time) for t in tables if time in t.columns]
    static = [t.select(*ids) for t in tables if time not in t.columns]
    grid = reduce(DataFrame.unionByName, timed).dropna().distinct() if timed else None
    if not static:
        return grid
    ids_only = reduce(DataFrame.unionByName, static).dropna().distinct()
    null_time = F.lit(None).cast("long").alias(time)
    if grid is None:
        return ids_only.select(*ids, null_time)
    return grid.unionByName(ids_only.join(grid.select(*ids).distinct(), ids, "left_anti").select(*ids, null_time))


def align_to_grid(tables: dict[str, DataFrame], grid: DataFrame, ids: list[str], time: str) -> dict[str, DataFrame]:
    """Each concept on the grid; static concepts repeat over all times."""
    return {n: grid.join(t, [*ids, time] if time in t.columns else ids, "left") for n, t in tables.items()}


def merge_concepts(
    tables: dict[str, DataFrame], ids: list[str], time: str, static: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Concepts on their common grid, wide, one row per id and time.

    Ids that only have static values keep one row with a null time.
    """
    static = static or {}
    wide = merge_wide(tables, ids, time)
    if not static:
        return wide
    lonely = time_grid([wide.select(*ids, time), *static.values()], ids, time).where(F.col(time).isNull())
    rows = wide.unionByName(lonely, allowMissingColumns=True)
    return reduce(lambda a, b: a.join(b, ids, "left"), static.values(), rows)


def row_bind(tables: list[DataFrame], fill: bool = True) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), tables)


def column_bind(tables: list[DataFrame], on: list[str]) -> DataFrame:
    """Side by side on the key columns; rows have no position to bind by."""
    return reduce(lambda a, b: a.join(b, on), tables)


def unmerge(df: DataFrame, meta: list[str]) -> dict[str, DataFrame]:
    """A wide table back to one table per data column, without missing rows."""
    return {c: df.select(*meta, c).dropna(subset=[c]) for c in df.columns if c not in meta}


def add_concept(
    df: DataFrame, concept: DataFrame, ids: list[str], time: str | None, column: str, how: str = "median"
) -> DataFrame:
    """Attach another concept at the same id and time."""
    keys = [*ids, time] if time and time in concept.columns else list(ids)
    one = concept.groupBy(*keys).agg(aggregator(how, column, keys).alias(column))
    return df.join(one, keys, "left")


def bind_tables(tables: list[Table], fill: bool = True) -> Table:
    """Row-bind tables, renaming the key columns to those of the first."""
    first = tables[0]
    frames = [first.df]
    for t in tables[1:]:
        pairs = dict(zip(t.ids, first.ids))
        if t.time and first.time:
            pairs[t.time] = first.time
        frames.append(t.df.withColumnsRenamed({k: v for k, v in pairs.items() if k != v}))
    return first.with_frame(row_bind(frames, fill))
