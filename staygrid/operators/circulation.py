"""Circulatory failure events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from staygrid.functions import scores
from staygrid.functions.scalars import is_true
from staygrid.operators.slices import row_framed, totals

# fixed values: share of the window that must meet a criterion
SHARE = 2.0 / 3.0


def circ_failure(
    df: DataFrame, ids: list[str], time: str, lact: str = "lact", map: str = "map", norepi: str | None = "norepi_rate",
    epi: str | None = "epi_rate", vaso: str | None = "vaso_rate", level1: list[str] | None = None,
    window: int = 45, grid: int = 5, rolling: bool = True, short: str = "point",
) -> DataFrame:
    """Event level of each row by a centred window of rows.

    A level needs two thirds of the window with raised lactate and two thirds
    with low pressure or drugs. ``short`` says what holds for a series with fewer
    rows than the window: the level of the single row (``point``) or, as for any
    other, of the rows its window has (``window``).
    """
    has = lambda c: c is not None and c in df.columns
    known = lambda condition: F.coalesce(condition, F.lit(False))
    strong = [F.col(c) for c in (norepi, epi) if has(c)]

    def any_of(conditions):
        out = F.lit(False)
        for c in conditions:
            out = out | known(c)
        return out

    flagged = df.withColumns({
        "lactate_elevated": known(F.col(lact) >= 2.0),
        "map_low": known(F.col(map) <= 65.0),
        "level1_drugs": any_of([F.col(c) > 0 for c in (level1 or []) if has(c)]),
        "level2_drugs": any_of([(c > 0) & (c < 0.1) for c in strong]),
        "level3_drugs": any_of([c >= 0.1 for c in strong] + ([F.col(vaso) > 0] if has(vaso) else [])),
    })
    point = (
        F.when(~F.col("lactate_elevated"), 0).when(F.col("level3_drugs"), 3).when(F.col("level2_drugs"), 2)
        .when(F.col("map_low") | F.col("level1_drugs"), 1).otherwise(0)
    )
    if not rolling:
        return flagged.withColumn("circ_event", point).withColumn("circ_failure", F.col("circ_event") > 0)
    rows = window // grid
    half = rows // 2
    low = (F.col("map_low") | F.col("level1_drugs") | F.col("level2_drugs") | F.col("level3_drugs")).cast("int")
    around = row_framed(flagged, ids, time, half, half, {
        "_low": lambda w: F.avg(low).over(w),
        "_lact": lambda w: F.avg(F.col("lactate_elevated").cast("int")).over(w),
        "_l2": lambda w: F.max("level2_drugs").over(w),
        "_l3": lambda w: F.max("level3_drugs").over(w),
    })
    met = (F.col("_low") >= SHARE) & (F.col("_lact") >= SHARE)
    windowed = F.when(~met, 0).when(F.col("_l3"), 3).when(F.col("_l2"), 2).otherwise(1)
    level = windowed
    if short == "point":
        around = totals(around, ids, {"_rows": F.count(F.lit(1))})
        level = F.when(F.col("_rows") < rows, point).otherwise(windowed)
    return around.withColumn("circ_event", level).withColumn("circ_failure", F.col("circ_event") > 0).drop("_low", "_lact", "_l2", "_l3", "_rows")


def circ_incidence(df: DataFrame, ids: list[str], time: str, min_level: int = 1) -> DataFrame:
    """First event of at least ``min_level`` per id, with its level."""
    return df.where(F.col("circ_event") >= min_level).groupBy(*ids).agg(
        F.min(time).alias("first_circ_failure_time"), F.min_by("circ_event", time).alias("first_event_level")
    )


def circ_summary(df: DataFrame, ids: list[str]) -> DataFrame:
    """One row of counts and shares; rows are first reduced per id."""
    levels = (0, 1, 2, 3)
    per_id = df.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("rows"),
        F.bool_or(is_true("circ_failure")).alias("any"),
        *[F.count_if(F.col("circ_event") == e).alias(f"e{e}") for e in levels],
    )
    total = F.sum("rows")
    return per_id.agg(
        total.alias("total_observations"),
        F.count(F.lit(1)).alias("total_patients"),
        F.count_if("any").alias("patients_with_circ_failure"),
        *[F.sum(f"e{e}").alias(f"event_{e}_count") for e in levels],
        *[(F.sum(f"e{e}") * 100.0 / total).alias(f"event_{e}_pct") for e in levels],
        ((total - F.sum("e0")) / total).alias("circ_failure_rate"),
    )


def circ_point_event(df: DataFrame, lact: str, map: str, **drugs: str) -> DataFrame:
    """Event level of each row on its own."""
    return df.withColumn("circ_event", scores.circ_failure_event(lact, map, **drugs))
