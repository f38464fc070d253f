"""Row and column selection, ordering, uniqueness and set comparison."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from staygrid.schema import names


@dataclass(frozen=True)
class Filter:
    """A pushed-down predicate: ``op`` is ``eq``, ``in``, ``between`` or ``regex``."""

    column: str
    op: str
    value: Any

    def predicate(self) -> Column:
        c = F.col(self.column)
        if self.op == "eq":
            return c == F.lit(self.value)
        if self.op == "in":
            return c.isin(list(self.value))
        if self.op == "between":
            lo, hi = self.value
            return c.between(lo, hi)
        if self.op == "regex":
            return F.coalesce(c.rlike("(?i)" + self.value), F.lit(False))
        raise ValueError(f"unknown filter: {self.op}")


def apply_filters(df: DataFrame, *filters: Filter) -> DataFrame:
    for f in filters:
        df = df.where(f.predicate())
    return df


def select_ids(df: DataFrame, wanted: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of the wanted ids; the id list stays a frame, however long."""
    return df.join(wanted.select(*names(on)).distinct(), names(on), "left_semi")


def filter_rows(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.where(condition)


def keep_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def drop_columns(df: DataFrame, columns: list[str], skip_absent: bool = True) -> DataFrame:
    missing = set(columns) - set(df.columns)
    if missing and not skip_absent:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.drop(*columns)


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def add_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def remove_na(df: DataFrame, columns: list[str] | None = None, how: str = "any") -> DataFrame:
    return df.dropna(how, subset=columns)


def remove_gaps(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Drop rows that carry no data besides their keys."""
    return df.dropna("all", subset=columns or [c for c in df.columns if c not in keys])


def filter_time(df: DataFrame, time: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    if lo is not None:
        df = df.where(F.col(time) >= lo)
    return df if hi is None else df.where(F.col(time) <= hi)


def cast_column(df: DataFrame, column: str, dtype: str) -> DataFrame:
    """Cast; values that do not fit become null."""
    return df.withColumn(column, F.col(column).try_cast(dtype))


def unique_column_names(df: DataFrame) -> DataFrame:
    """Number repeated column names: ``x, x`` becomes ``x, x_1``."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        out.append(c if c not in seen else f"{c}_{seen[c]}")
        seen[c] = seen.get(c, 0) + 1
    return df.toDF(*out)


def in_icu(df: DataFrame, stays: DataFrame, patient: str, stay: str) -> DataFrame:
    """Rows of patients with a stay, repeated for each of their stays."""
    return df.drop(stay).join(stays.select(patient, stay).distinct(), patient)


def all_ids(df: DataFrame, on: str | list[str]) -> DataFrame:
    return df.select(*names(on)).dropna().distinct()


def sample_ids(df: DataFrame, on: str, n: int, seed: int | None = None) -> DataFrame:
    """The first ``n`` ids in order, or ``n`` ids in a seeded hash order."""
    ids = all_ids(df, on)
    order = F.col(on) if seed is None else F.xxhash64(F.col(on), F.lit(seed))
    return ids.orderBy(order, F.col(on)).limit(n)


def concept_rows(
    df: DataFrame, item: str, value: str, items: list | None = None, pattern: str | None = None,
    lo: float | None = None, hi: float | None = None,
) -> DataFrame:
    """Rows of one concept: by item list or pattern, within value bounds."""
    if items is not None:
        df = df.where(F.col(item).isin(list(items)))
    if pattern is not None:
        df = apply_filters(df, Filter(item, "regex", pattern))
    if lo is not None:
        df = df.where(F.col(value) >= lo)
    return df if hi is None else df.where(F.col(value) <= hi)


# --- ordering, uniqueness, sets ------------------------------------------------

def sort_rows(df: DataFrame, by: list[str], ascending: bool | list[bool] = True) -> DataFrame:
    return df.orderBy(*by, ascending=ascending)


def ranked(df: DataFrame, by: list[str], ascending: list[bool], block: Column, out: str = "rank") -> DataFrame:
    """Row number in the order of ``by`` over the whole table, without sorting it in one task.

    ``block`` is a monotone expression of the first column (such as its whole thousands) that cuts the order into parts of
    bearable size; only the parts' counts are ordered together.
    """
    order = [F.col(c).asc() if up else F.col(c).desc() for c, up in zip(by, ascending)]
    rows = df.withColumn("_block", block)
    along = F.col("_block").asc() if ascending[0] else F.col("_block").desc()
    counts = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col("_block").alias("_part"), (F.sum("_n").over(Window.orderBy(along)) - F.col("_n")).alias("_before"))
    inside = rows.withColumn("_inside", F.row_number().over(Window.partitionBy("_block").orderBy(*order)))
    joined = inside.join(before, F.col("_block").eqNullSafe(F.col("_part")))
    return joined.withColumn(out, (F.col("_before") + F.col("_inside")).cast("long")).drop("_block", "_part", "_before", "_inside")


def repeated_keys(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).count().where("count > 1")


def is_unique(df: DataFrame, by: list[str]) -> DataFrame:
    """One row: whether the keys are unique."""
    return df.groupBy(*by).count().agg(F.coalesce(F.max("count") <= 1, F.lit(True)).alias("is_unique"))


def unique_rows(df: DataFrame, by: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """One row per key, the first or last in ``order``; pre-aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    pick = F.min_by if keep == "first" else F.max_by
    best = df.groupBy(*by).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*by, "_row.*").select(*df.columns)


def not_in(x: DataFrame, options: DataFrame, on: list[str]) -> DataFrame:
    return x.join(options, on, "left_anti")


def is_subset(x: DataFrame, options: DataFrame, on: list[str]) -> DataFrame:
    """One row: whether every key of ``x`` occurs in ``options``."""
    return not_in(x, options, on).agg((F.count(F.lit(1)) == 0).alias("is_subset"))


def is_disjoint(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
    return x.join(y, on, "left_semi").agg((F.count(F.lit(1)) == 0).alias("is_disjoint"))


def differences(x: DataFrame, y: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, duplicates counted."""
    y = y.select(*x.columns)
    left = x.groupBy(*x.columns).agg(F.count(F.lit(1)).alias("_n"))
    right = y.groupBy(*x.columns).agg((-F.count(F.lit(1))).alias("_n"))
    return left.unionByName(right).groupBy(*x.columns).agg(F.sum("_n").alias("surplus")).where("surplus <> 0")


def all_equal(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row: whether two tables hold the same rows."""
    return differences(x, y).agg((F.count(F.lit(1)) == 0).alias("all_equal"))
