"""Organ failure scores over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from staygrid.functions import scores
from staygrid.functions.scalars import any_known
from staygrid.operators.grid import fill_gaps
from staygrid.operators.rolling import locf_window
from staygrid.operators.slices import Acc, fill_framed
from staygrid.schema import HOUR

SOFA = ["sofa_resp", "sofa_coag", "sofa_liver", "sofa_cardio", "sofa_cns", "sofa_renal"]
SOFA2 = ["sofa2_resp", "sofa2_coag", "sofa2_liver", "sofa2_cardio", "sofa2_cns", "sofa2_renal"]


def component(df: DataFrame, name: str, inputs: list[str], make) -> DataFrame:
    """Add one component, only where any of its inputs is known."""
    given = [c for c in inputs if c in df.columns]
    return df.withColumn(name, F.when(any_known(*given), make(df)))


def organ_score(
    df: DataFrame, ids: list[str], time: str, parts: list[str], out: str, window: int = 24 * HOUR, step: int = HOUR,
    worst: str = "max", keep_components: bool = False, full_window: bool = False, compat: bool = False,
) -> DataFrame:
    """Sum of the worst value of each component over the look-back window.

    ``df`` holds the components on (id, t). The grid between first and last time
    is completed first; with ``compat`` it ends at the length of the series.
    """
    present = [p for p in parts if p in df.columns]
    rows = df.select(*ids, time, *present).where(any_known(*present))
    end = F.max(time) - F.min(time) if compat else F.max(time)
    if window > 0:
        accs = [Acc(p, worst, F.col(p)) for p in present] + [Acc("_points", "count", F.lit(1))]
        grid = fill_framed(rows, ids, time, step, window // step, accs, end)
        grid = grid.where(F.col("_points") > window // step) if full_window else grid
    else:
        limits = rows.groupBy(*ids).agg(F.min(time).alias("start"), end.alias("end")) if compat else None
        grid = fill_gaps(rows, ids, time, step, limits)
    total: Column = F.lit(0)
    for p in present:
        total = total + F.coalesce(F.col(p), F.lit(0))
    return grid.select(*ids, time, *(present if keep_components else []), total.cast("int").alias(out))


def sofa_score(df: DataFrame, ids: list[str], time: str, **kwargs) -> DataFrame:
    return organ_score(df, ids, time, SOFA, "sofa", **kwargs)


def sofa2_score(df: DataFrame, ids: list[str], time: str, **kwargs) -> DataFrame:
    return organ_score(df, ids, time, SOFA2, "sofa2", **kwargs)


def warning_score(
    df: DataFrame, ids: list[str], time: str, out: str, inputs: list[str], make, window: int | None = 24 * HOUR
) -> DataFrame:
    """A score of the last known inputs, each at most ``window`` old."""
    rows = df.select(*ids, time, *inputs)
    carried = locf_window(rows, ids, time, inputs, window) if window else rows
    return carried.select(*ids, time, make.alias(out))


def qsofa(df: DataFrame, ids: list[str], time: str, window: int | None = 24 * HOUR) -> DataFrame:
    return warning_score(df, ids, time, "qsofa", ["sbp", "resp", "gcs"], scores.qsofa("sbp", "resp", "gcs"), window)


def sirs(df: DataFrame, ids: list[str], time: str, window: int | None = 24 * HOUR) -> DataFrame:
    inputs = ["temp", "hr", "resp", "pco2", "wbc", "bnd"]
    present = [c for c in inputs if c in df.columns]
    optional = {c: c for c in ("pco2", "wbc", "bnd") if c in present}
    return warning_score(df, ids, time, "sirs", present, scores.sirs("temp", "hr", "resp", **optional), window)


def gcs(
    df: DataFrame, ids: list[str], time: str, intubated: DataFrame | None = None, window: int = 6 * HOUR,
    use_total: bool = True, set_na_max: bool = True, sed_impute: str = "max",
) -> DataFrame:
    """Total coma scale of the last known parts; ``use_total`` trusts a recorded total."""
    inputs = [c for c in ("egcs", "vgcs", "mgcs", "tgcs") if c in df.columns]
    carried = locf_window(df.select(*ids, time, *inputs), ids, time, inputs, window)
    flag = None
    if intubated is not None:
        tubes = intubated.where(F.col("ett_gcs").cast("boolean")).select(*ids, time).distinct().withColumn("ett_gcs", F.lit(True))
        carried, flag = carried.join(tubes, [*ids, time], "left"), "ett_gcs"
    total = "tgcs" if use_total and "tgcs" in inputs else None
    value = scores.gcs_total("egcs", "vgcs", "mgcs", total, flag, set_na_max, sed_impute)
    return carried.select(*ids, time, value.alias("gcs")).where("gcs IS NOT NULL")
