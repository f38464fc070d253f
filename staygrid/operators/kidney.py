"""Urine output and kidney injury staging."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from staygrid.functions import scores
from staygrid.operators.slices import Acc, fill_framed, framed, row_framed
from staygrid.schema import DAY, HOUR

DEFAULT_WEIGHT = 70.0


def urine24(
    urine: DataFrame, ids: list[str], time: str, value: str = "urine", step: int = HOUR, min_rows: int = 12,
    compat: bool = False,
) -> DataFrame:
    """Urine of the last 24 hours, scaled up where less than a day is covered.

    Works on a gap-free grid with missing output as 0; fewer than ``min_rows``
    points give null. With ``compat`` the grid ends at the length of the series
    instead of its last time.
    """
    rows = urine.select(*ids, time, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias(value))
    per_day = DAY // step
    end = F.max(time) - F.min(time) if compat else F.max(time)
    found = fill_framed(rows, ids, time, step, per_day - 1, [Acc("_sum", "sum", F.col(value)), Acc("_rows", "count", F.lit(1))], end)
    found = found.withColumn("_sum", F.coalesce("_sum", F.lit(0.0)))
    return found.select(
        *ids, time, F.when(F.col("_rows") >= min_rows, F.col("_sum") * float(per_day) / F.col("_rows")).alias("urine24")
    )


def urine_rate(
    urine: DataFrame, weight: DataFrame, ids: list[str], time: str, hours: int, value: str = "urine",
    weight_col: str = "weight", step: int = HOUR, min_hours: int | None = None,
) -> DataFrame:
    """mL/kg/h over the last ``hours`` rows of the interval; needs half of them.

    Stays without a positive weight are dropped.
    """
    min_hours = min_hours if min_hours is not None else max(1, hours // 2)
    rows = max(1, int(hours * HOUR / step))
    needed = max(1, int(min_hours * HOUR / step))
    known = urine.join(weight.select(*ids, weight_col), ids).where(F.col(weight_col) > 0)
    found = row_framed(known, ids, time, rows - 1, 0, {
        "_sum": lambda w: F.sum(value).over(w), "_known": lambda w: F.count(value).over(w),
    })
    rate = F.when(F.col("_known") >= needed, F.col("_sum") / (F.col(weight_col) * float(hours)))
    return found.select(*ids, time, rate.alias(f"uo_{hours}h"))


def urine_per_kg_hour(urine: DataFrame, weight: DataFrame, ids: list[str], time: str, value: str = "urine",
                      weight_col: str = "weight", hours: float = 1.0) -> DataFrame:
    """Urine divided by weight and interval length."""
    joined = urine.join(weight.select(*ids, weight_col), ids, "left")
    return joined.select(*ids, time, F.try_divide(F.col(value), F.col(weight_col) * hours).alias("urine_mlkgph"))


def creatinine_stages(crea: DataFrame, ids: list[str], time: str, value: str = "crea") -> DataFrame:
    """Lowest creatinine of the past two and seven days, and the stage it implies.

    The current time is excluded; values outside (0, 150] are dropped.
    """
    rows = crea.select(*ids, time, F.col(value).cast("double").alias("crea")).where((F.col("crea") > 0) & (F.col("crea") <= 150))
    found = framed(rows, ids, time, 7 * DAY, 0, {
        "creat_low_past_48hr": lambda w: F.min("crea").over(w.rangeBetween(-2 * DAY, -1)),
        "creat_low_past_7day": lambda w: F.min("crea").over(w.rangeBetween(-7 * DAY, -1)),
    }, width=7 * DAY)
    return found.withColumn("aki_stage_creat", scores.aki_stage_creat("crea", "creat_low_past_48hr", "creat_low_past_7day"))


def urine_stages(
    urine: DataFrame, weight: DataFrame, ids: list[str], time: str, value: str = "urine", weight_col: str = "weight"
) -> DataFrame:
    """Urine rates over the past 6, 12 and 24 hours and the stage they imply.

    The rate divides by the covered time (one hour at least) and by the weight,
    70 kg where none is known.
    """
    per_id = weight.groupBy(*ids).agg(F.max(weight_col).alias("_kg"))
    rows = urine.select(*ids, time, F.col(value).cast("double").alias("_ml"))
    exprs = {}
    for h in (6, 12, 24):
        back = h * HOUR - 1
        exprs[f"_sum{h}"] = lambda w, b=back: F.sum("_ml").over(w.rangeBetween(-b, 0))
        exprs[f"_from{h}"] = lambda w, b=back: F.min(time).over(w.rangeBetween(-b, 0))
    found = framed(rows, ids, time, DAY, 0, exprs).join(per_id, ids, "left")
    kg = F.when(F.col("_kg") > 0, F.col("_kg")).otherwise(F.lit(DEFAULT_WEIGHT))

    def rate(h: int):
        covered = F.greatest((F.col(time) - F.col(f"_from{h}")) / HOUR, F.lit(1.0))
        return (F.coalesce(F.col(f"_sum{h}"), F.lit(0.0)) / (kg * covered)).alias(f"uo_rt_{h}hr")

    out = found.select(*ids, time, *[rate(h) for h in (6, 12, 24)])
    return out.withColumn("aki_stage_uo", scores.aki_stage_uo("uo_rt_6hr", "uo_rt_12hr", "uo_rt_24hr"))


def aki_stages(
    crea: DataFrame, ids: list[str], time: str, urine: DataFrame | None = None, weight: DataFrame | None = None,
    rrt: DataFrame | None = None,
) -> DataFrame:
    """Stage by creatinine, urine output and replacement therapy; the highest counts.

    Therapy only counts at times that have a creatinine or urine row.
    """
    keys = [*ids, time]
    out = creatinine_stages(crea, ids, time)
    if urine is not None and weight is not None:
        out = out.join(urine_stages(urine, weight, ids, time), keys, "full")
    else:
        out = out.withColumn("aki_stage_uo", F.lit(0))
    on_rrt = F.lit(False)
    if rrt is not None:
        active = rrt.groupBy(*keys).agg(F.bool_or(F.col("rrt").cast("boolean")).alias("_rrt"))
        out, on_rrt = out.join(active, keys, "left"), F.coalesce(F.col("_rrt"), F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.withColumns({
        "aki_stage_creat": F.when(on_rrt, F.lit(3)).otherwise(zero("aki_stage_creat")),
        "aki_stage_uo": zero("aki_stage_uo"),
        "aki_stage_rrt": F.when(on_rrt, 3).otherwise(0),
    }).withColumn("aki_stage", F.greatest("aki_stage_creat", "aki_stage_uo"))
    return out.withColumn("aki", F.col("aki_stage") > 0).drop("_rrt")


def aki_incidence(stages: DataFrame, ids: list[str], time: str) -> DataFrame:
    """First time with kidney injury and highest stage per id."""
    return stages.where("aki").groupBy(*ids).agg(
        F.min(time).alias("first_aki_time"), F.max("aki_stage").alias("max_aki_stage")
    )


def aki_summary(stages: DataFrame, ids: list[str]) -> DataFrame:
    """Patients, rate and stage distributions as (metric, stage, value) rows."""
    per_id = stages.groupBy(*ids).agg(
        F.bool_or("aki").alias("aki"), F.max("aki_stage").alias("stage"), F.count(F.lit(1)).alias("rows")
    )
    none = F.lit(None).cast("int")
    whole = per_id.agg(
        F.count(F.lit(1)).cast("double").alias("n_patients"),
        F.sum("rows").cast("double").alias("n_measurements"),
        F.count_if("aki").cast("double").alias("aki_patients"),
        F.avg(F.col("aki").cast("double")).alias("aki_rate"),
    ).unpivot([], ["n_patients", "n_measurements", "aki_patients", "aki_rate"], "metric", "value")
    by_row = stages.groupBy(F.col("aki_stage").cast("int").alias("stage")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    by_id = per_id.groupBy(F.col("stage").cast("int").alias("stage")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return (
        whole.select("metric", none.alias("stage"), "value")
        .unionByName(by_row.select(F.lit("measurements").alias("metric"), "stage", "value"))
        .unionByName(by_id.select(F.lit("patients").alias("metric"), "stage", "value"))
    )
