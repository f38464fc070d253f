"""Exact distribution statistics that never gather a whole group in one place.

Values are first counted per distinct value; ranks then come from a running sum
of the counts, cut into value slices.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from staygrid.operators.slices import Acc, scan, value_slice
from staygrid.schema import as_column

_ALL = "_all"


def _grouped(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn(_ALL, F.lit(1)), [_ALL])


def with_side(df: DataFrame, side: DataFrame, by: list[str]) -> DataFrame:
    """Columns of a per-group side; a side of one row is a scalar, not a join."""
    if by:
        return df.join(side, list(by))
    row = side.select(F.struct(*side.columns)).scalar()
    return df.withColumns({c: row[c] for c in side.columns})


def beside(*frames: DataFrame) -> DataFrame:
    """One-row frames with different columns, side by side."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for df in frames for c in df.columns])


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))


def quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles per group with linear interpolation; ``probs`` maps output to probability."""
    df, keys = _grouped(df, by)
    counts = value_counts(df, keys, value)
    ranked = scan(counts, by, value, [Acc("_upto", "sum", F.col("_n"))], value_slice(value))
    ranked = with_side(ranked, counts.groupBy(*by).agg(F.sum("_n").alias("_size")), by)
    picks, outs = [], []
    for i, (name, p) in enumerate(probs.items()):
        at = (F.col("_size") - 1) * F.lit(float(p))
        picks += [
            F.min(F.when(F.col("_upto") > F.floor(at), F.col(value))).alias(f"_lo{i}"),
            F.min(F.when(F.col("_upto") > F.ceil(at), F.col(value))).alias(f"_hi{i}"),
            F.max(at - F.floor(at)).alias(f"_part{i}"),
        ]
        outs.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_part{i}")).alias(name))
    return ranked.groupBy(*keys).agg(*picks).select(*by, *outs)


def mode(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Most frequent value per group, the smallest of equals."""
    df, keys = _grouped(df, by)
    best = value_counts(df, keys, value).groupBy(*keys).agg(
        F.min_by(value, F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias(out)
    )
    return best.select(*by, out)


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column, one row each."""
    long = df.select(*columns).unpivot([], columns, "variable", "value").where("value IS NOT NULL")
    moments = long.groupBy("variable").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quarters = quantiles(long, ["variable"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return moments.join(quarters, "variable").select(
        "variable", "count", "mean", "std", "min", "q25", "median", "q75", "max"
    )


def erfc(x: str | Column) -> Column:
    """Complementary error function for ``x >= 0``, relative error below 1.2e-7."""
    z = as_column(x)
    t = 1.0 / (1.0 + 0.5 * z)
    # fixed values: Chebyshev coefficients of the published fit
    coefficients = [
        -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
        0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
    ]
    poly = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        poly = poly * t + F.lit(c)
    return t * F.exp(-z * z + poly)


def two_sided_p(z: str | Column) -> Column:
    return F.least(erfc(F.abs(as_column(z)) / math.sqrt(2.0)), F.lit(1.0))


def rank_sum_test(df: DataFrame, by: list[str], value: str, in_first: Column) -> DataFrame:
    """Mann-Whitney U of two groups, with tie correction and continuity correction.

    ``in_first`` is true for rows of the first group, false for the second.
    """
    df, keys = _grouped(df, by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count_if(in_first).alias("_n1"), F.count_if(~in_first).alias("_n2")
    ).withColumn("_n", F.col("_n1") + F.col("_n2"))
    ranked = scan(counts, by, value, [Acc("_before", "sum", F.col("_n"))], value_slice(value), exclusive=True)
    rank = F.coalesce(F.col("_before"), F.lit(0)) + (F.col("_n") + 1) / 2.0
    n = F.col("_n").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("_n1") * rank).alias("_r1"),
        F.sum("_n1").alias("n1"), F.sum("_n2").alias("n2"),
        F.sum(n * n * n - n).alias("_ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    size = n1 + n2
    u1 = F.col("_r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12.0 * (size + 1 - F.try_divide(F.col("_ties"), size * (size - 1))))
    z = F.try_divide(F.greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5, spread)
    return sums.select(*by, "n1", "n2", u1.alias("u"), z.alias("z")).withColumn(
        "p_value", F.when(F.col("z") < 0, F.lit(1.0)).otherwise(two_sided_p("z"))
    )


def chi_square_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square statistic of a 2x2 table with Yates' correction."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    gap = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    return F.try_divide(n * gap * gap, (a + b) * (c + d) * (a + c) * (b + d))


def chi_square_p(statistic: str | Column) -> Column:
    """p-value with one degree of freedom."""
    return F.least(erfc(F.sqrt(as_column(statistic) / 2.0)), F.lit(1.0))


def kde(
    df: DataFrame, by: list[str], value: str, points: int = 200, pad: float = 0.1,
    extent: tuple[float, float] | None = None, trim: tuple[float, float] | None = None,
    min_rows: int = 2,
) -> DataFrame:
    """Gaussian density per group on an even grid, Scott bandwidth.

    The grid covers the range plus ``pad`` of it on each side, or ``extent``.
    ``trim`` first drops values outside two quantiles. Work is one kernel per
    distinct value and grid point, added up before any shuffle.
    """
    df, keys = _grouped(df, by)
    if trim is not None:
        edges = quantiles(df, by, value, {"_qlo": trim[0], "_qhi": trim[1]})
        df = with_side(df, edges, by).where(F.col(value).between(F.col("_qlo"), F.col("_qhi"))).drop("_qlo", "_qhi")
    counts = value_counts(df, keys, value)
    v = F.col(value).cast("double")
    shape = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.stddev_samp(v).alias("_sd"), F.min(v).alias("_lo"), F.max(v).alias("_hi")
    ).where(F.col("_rows") >= min_rows)
    if extent is None:
        margin = (F.col("_hi") - F.col("_lo")) * pad
        lo, hi = F.col("_lo") - margin, F.col("_hi") + margin
    else:
        lo, hi = F.lit(float(extent[0])), F.lit(float(extent[1]))
    width = F.col("_sd") * F.pow(F.col("_rows").cast("double"), F.lit(-0.2))
    shape = shape.select(*by, "_rows", width.alias("_h"), lo.alias("_from"), ((hi - lo) / (points - 1)).alias("_step"))
    known = with_side(counts, shape, by).where(F.col("_rows").isNotNull())
    spread = known.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("_from") + F.col("point") * F.col("_step")
    u = (x - v) / F.col("_h")
    return spread.groupBy(*keys, "point").agg(
        F.max(x).alias("x"),
        (F.sum(F.col("_n") * F.exp(-0.5 * u * u)) / (F.max("_rows") * F.max("_h") * math.sqrt(2 * math.pi))).alias("density"),
    ).select(*by, "point", "x", "density")


def histogram(df: DataFrame, by: list[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts in ``bins`` equal bins from ``lo`` to ``hi``; the last bin is closed."""
    v = F.col(value)
    width = (hi - lo) / bins
    place = F.least(F.floor((v - lo) / width), F.lit(bins - 1))
    return (
        df.where((v >= lo) & (v <= hi))
        .groupBy(*by, place.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin_start", F.lit(float(lo)) + F.col("bin") * F.lit(width))
    )
