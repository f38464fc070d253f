"""Grouped aggregation; every aggregate combines on the map side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from staygrid.functions.times import floor_to
from staygrid.operators.slices import SLICE, crowded, of_crowded, value_slice

FINE = 1 << 16  # value slices in an octave, where a group is spread over the cluster

AGGREGATES = {
    "mean": F.avg,
    "median": F.median,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "prod": F.product,
    "var": F.var_samp,
    "std": F.stddev_samp,
    "count": F.count,
    "any": F.bool_or,
    "all": F.bool_and,
}


def aggregator(how: str, column: str | Column, order: list[str] | None = None) -> Column:
    """Aggregate column; ``first`` and ``last`` need an explicit order."""
    if how in ("first", "last"):
        if not order:
            raise ValueError(f"{how} needs order columns")
        c = F.col(column) if isinstance(column, str) else column
        position = F.when(c.isNotNull(), F.struct(*order))
        return F.min_by(c, position) if how == "first" else F.max_by(c, position)
    return AGGREGATES[how](column)


def default_aggregator(dtype: T.DataType) -> str:
    """Median for numbers, sum for booleans, first for the rest."""
    if isinstance(dtype, T.BooleanType):
        return "sum"
    return "median" if isinstance(dtype, T.NumericType) else "first"


def aggregate_by(
    df: DataFrame, by: list[str], how: str | dict[str, str], columns: list[str] | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    columns = columns or [c for c in df.columns if c not in by]
    chosen = how if isinstance(how, dict) else dict.fromkeys(columns, how)
    return df.groupBy(*by).agg(*[aggregator(f, c, order).alias(c) for c, f in chosen.items()])


def aggregate_series(
    df: DataFrame, ids: list[str], time: str | None, value: str, how: str | None = None,
    unit: str | None = None, order: list[str] | None = None,
) -> DataFrame:
    """One value per id and time; the default depends on the value's type."""
    dtype = df.schema[value].dataType
    how = how or default_aggregator(dtype)
    c = F.col(value).cast("long") if how == "sum" and isinstance(dtype, T.BooleanType) else F.col(value)
    if how == "median" and not unit:
        out = by_counts(df, [*ids, *([time] if time else [])], value, {"_median": how}, keep_empty=True)
        return out.withColumnRenamed("_median", value)
    aggs = [aggregator(how, c, order or ([time] if time else None)).alias(value)]
    if unit:
        aggs.append(aggregator("first", unit, order or [value]).alias(unit))
    return df.groupBy(*ids, *([time] if time else [])).agg(*aggs)


def item_grid(
    df: DataFrame, ids: list[str], time: str, item: str, value: str, step: int, how: str = "median",
    items: list | None = None, lo: float | None = None, hi: float | None = None,
) -> DataFrame:
    """Item-long table to one value per id, interval and item, in one scan."""
    if items is not None:
        df = df.where(F.col(item).isin(list(items)))
    if lo is not None:
        df = df.where(F.col(value) >= lo)
    if hi is not None:
        df = df.where(F.col(value) <= hi)
    keys = [*ids, floor_to(time, step).alias(time), item]
    if how == "median":
        return by_counts(df, keys, value, {"_median": how}).withColumnRenamed("_median", value)
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(aggregator(how, value, [time]).alias(value))


def wide_grid(df: DataFrame, ids: list[str], time: str, values: list[str], step: int, how: str = "median") -> DataFrame:
    """Wide table to one row per id and interval; medians go through counts per value."""
    slot = floor_to(time, step).alias(time)
    if how != "median":
        return df.groupBy(*ids, slot).agg(*[aggregator(how, c, [time]).alias(c) for c in values])
    keys = [*ids, time]
    long = df.select(*ids, slot, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(keys, values, "_name", "_value")
    medians = by_counts(long, [*keys, "_name"], "_value", {"_median": "median"}, keep_empty=True, base=df)
    return medians.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == c, F.col("_median"))).alias(c) for c in values])


# Aggregates that follow from the distinct values of a group and their counts.
BY_COUNTS = {"median", "min", "max", "sum", "mean", "count"}


def by_counts(
    df: DataFrame, keys: list[str | Column], value: str, outs: dict[str, str], keep_empty: bool = False,
    weight: Column | None = None, least: list[str] | None = None, rows: int | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """Grouped aggregates including exact medians.

    ``outs`` maps an output to one of ``BY_COUNTS``; groups without a value are
    dropped unless ``keep_empty``. A row counts ``weight`` (a whole number) times.
    Of the columns ``least`` the smallest value of a group is kept.

    The values of a group are gathered for its median: at most ``ROWS`` values,
    because first keys that have more rows than that take another way. There the
    distinct values are counted over the whole cluster, the counts of value
    slices run on in each group, and only the slice or two that hold its middle
    are opened. First keys are counted in ``base``, a table of no fewer rows for
    each group, where that is cheaper than ``df``.
    """
    least = least or []
    frame = df.select(*keys, value, *([weight.alias("_w")] if weight is not None else []), *least)
    if not keep_empty:
        frame = frame.where(F.col(value).isNotNull())
    keys = frame.columns[: len(keys)]
    names = [*keys, *outs, *least]
    v, w = F.col(value), F.when(F.col(value).isNotNull(), F.col("_w") if weight is not None else F.lit(1))
    aggs = {
        "min": F.min(v), "max": F.max(v), "sum": F.sum(v if weight is None else v * w), "count": F.sum(w) if weight is not None else F.count(v),
        "mean": F.avg(v) if weight is None else F.try_divide(F.sum(v * w), F.sum(w)),
        "median": F.sort_array(F.collect_list(v if weight is None else F.when(w > 0, F.struct(v.alias("v"), w.alias("w"))))),
    }
    direct = [*[aggs[how].alias(out) for out, how in outs.items()], *[F.min(c).alias(c) for c in least]]
    if "median" not in outs.values():
        return frame.groupBy(*keys).agg(*direct).select(*names)
    many = crowded(frame if base is None else base, keys[:1], rows)
    usual = of_crowded(frame, many, keys[:1], others=True).groupBy(*keys).agg(*direct)
    middle = _middle if weight is None else _weighted_middle
    usual = usual.withColumns({out: middle(out) for out, how in outs.items() if how == "median"}).select(*names)
    return usual.unionByName(_spread(of_crowded(frame, many, keys[:1]), keys, value, w, outs, least).select(*[F.col(f.name).cast(f.dataType) for f in usual.schema]))


def _middle(values: str) -> Column:
    """The middle of a sorted array, the mean of two where it has an even number."""
    n = F.size(values)
    at = lambda place: F.get(values, F.floor(place).cast("int")).cast("double")
    return (at((n - 1) / 2) + at(n / 2)) / 2


def _weighted_middle(items: str) -> Column:
    """The same of values that count several times each: an array of structs of value and weight, sorted."""
    total = F.aggregate(items, F.lit(0).cast("long"), lambda sum_, x: sum_ + x["w"])
    at = (total - 1) / 2

    def step(seen: Column, x: Column) -> Column:
        upto, value = seen["upto"] + x["w"], x["v"].cast("double")
        return F.struct(upto.alias("upto"), F.coalesce(seen["low"], F.when(upto > F.floor(at), value)).alias("low"),
                        F.coalesce(seen["high"], F.when(upto > F.ceil(at), value)).alias("high"))

    none = F.lit(None).cast("double")
    found = F.aggregate(items, F.struct(F.lit(0).cast("long").alias("upto"), none.alias("low"), none.alias("high")), step, lambda seen: (seen["low"] + seen["high"]) / 2)
    return F.when(F.size(items) == 1, F.get(F.col(items), F.lit(0))["v"].cast("double")).otherwise(found)


def _spread(df: DataFrame, keys: list[str], value: str, weight: Column, outs: dict[str, str], least: list[str]) -> DataFrame:
    """The same for groups of any size: no task sees more of a group than its value slices, or the values of one slice."""
    v, n = F.col(value), F.col("_n")
    counts = df.groupBy(*keys, value).agg(F.coalesce(F.sum(weight), F.lit(0)).alias("_n"), *[F.min(c).alias(c) for c in least])
    counts = counts.withColumn(SLICE, value_slice(value, FINE))
    cells = counts.groupBy(*keys, SLICE).agg(
        F.sum(n).alias("_n"), F.sum(v * n).alias("_sum"), F.min(v).alias("_min"), F.max(v).alias("_max"), *[F.min(c).alias(c) for c in least])
    along = Window.partitionBy(*keys).orderBy(SLICE)
    group = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = {"_sum": F.sum("_sum"), "_min": F.min("_min"), "_max": F.max("_max"), **{c: F.min(c) for c in least}}
    cells = cells.select(*keys, SLICE, (F.sum(n).over(along.rowsBetween(Window.unboundedPreceding, 0)) - n).alias("_before"), n, F.sum(n).over(group).alias("_size"),
                         *[c.over(group).alias(name) for name, c in totals.items()])
    at = (F.col("_size") - 1) / 2
    holds = lambda before, size: ((before + size > F.floor(at)) & (before <= F.ceil(at))) | (F.col("_size") == 0)
    middle = cells.where(holds(F.col("_before"), n)).drop("_n").withColumnsRenamed({c: f"_of_{c}" for c in [*keys, SLICE]})
    opened = counts.drop(*least).join(middle, same([*keys, SLICE]))
    inside = Window.partitionBy(*keys, SLICE).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    opened = opened.withColumn("_low", F.col("_before") + F.sum(n).over(inside) - n).where(holds(F.col("_low"), n))
    one = lambda c: F.max(c)
    aggs = {
        "median": (F.min(v) + F.max(v)) / 2, "min": one("_min"), "max": one("_max"), "sum": F.when(one("_size") > 0, one("_sum")), "count": one("_size"),
        "mean": F.try_divide(one("_sum"), one("_size")),
    }
    return opened.groupBy(*keys).agg(*[aggs[how].alias(out) for out, how in outs.items()], *[one(c).alias(c) for c in least]).select(*keys, *outs, *least)


def same(keys: list[str]) -> Column:
    """Equality of the keys and of their copies, whose names begin with ``_of_``; nulls are equal."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])


def one_unique(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value of a group if it has exactly one, else null."""
    lo, hi = F.min(value), F.max(value)
    return df.groupBy(*by).agg(F.when(lo == hi, lo).alias(value))


def collapse(df: DataFrame, ids: list[str], time: str, start: str = "start", end: str = "end",
             extra: dict[str, Column] | None = None) -> DataFrame:
    """Extent of each series, with further aggregates."""
    return df.groupBy(*ids).agg(
        F.min(time).alias(start), F.max(time).alias(end), *[c.alias(k) for k, c in (extra or {}).items()]
    )


def to_wide(df: DataFrame, keys: list[str], item: str, value: str, items: list, how: str = "median") -> DataFrame:
    """Pivot over a given item list (no extra job to find the items)."""
    if how == "median":  # one value is left for each item, and the empty items keep their row
        df, how = by_counts(df, [*keys, item], value, {"_median": how}, keep_empty=True).withColumnRenamed("_median", value), "max"
    return df.groupBy(*keys).pivot(item, list(items)).agg(aggregator(how, value, keys))


def with_unit(df: DataFrame, keys: list[str], value: str, how: str, unit: str, new_unit: str) -> DataFrame:
    if how == "median":
        out = by_counts(df, keys, value, {"_median": how}, keep_empty=True).withColumnRenamed("_median", value)
    else:
        out = df.groupBy(*keys).agg(aggregator(how, value, keys).alias(value))
    return out.withColumn(unit, F.lit(new_unit))


# --- aggregates behind charts ---------------------------------------------------

def trajectory(df: DataFrame, time: str, value: str) -> DataFrame:
    """Mean and spread of a score over all series at each time."""
    return df.where(F.col(value).isNotNull()).groupBy(time).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        (F.lit(1.96) * F.stddev_samp(value) / F.sqrt(F.count(value))).alias("ci"),
    )


def lab_matrix(df: DataFrame, ids: list[str], time: str, item: str, value: str, items: list, normalize: bool = True) -> DataFrame:
    """Item by time matrix per series, min-max scaled per item."""
    cells = df.where(F.col(item).isin(list(items))).groupBy(*ids, time, item).agg(F.avg(value).alias(value))
    if normalize:
        extent = cells.groupBy(*ids, item).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        cells = cells.join(extent, [*ids, item]).withColumn(
            value, F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.5))
        )
    return cells.groupBy(*ids, time).pivot(item, list(items)).agg(F.max(value))
