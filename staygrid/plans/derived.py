"""Derived concepts on the wide grid.

A derivation adds a column to the wide (id, t) frame. It is known only where
one of its direct inputs is known, so it looks the same whatever else was
loaded. Derivations with a time axis of their own return a frame of new rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from staygrid.functions import scores
from staygrid.functions.scalars import any_known, is_true, sum_known
from staygrid.operators import kidney, organ, sepsis
from staygrid.operators.asof import ventilation_windows
from staygrid.operators.grid import any_infusion, expand_windows
from staygrid.operators.intervals import sustained_rate
from staygrid.operators.rolling import locf_window
from staygrid.schema import HOUR


@dataclass(frozen=True)
class Context:
    """What a derivation may need besides its inputs."""

    ids: list[str]
    time: str
    step: int = HOUR
    window: int = 24 * HOUR
    compat: bool = False
    options: dict | None = None

    def option(self, name: str, default):
        return (self.options or {}).get(name, default)


# (wide, context, name, parts) -> wide with the column, or (frame of rows) for row derivations
Derivation = Callable[[DataFrame, Context, str, list[str]], DataFrame]
COLUMNS: dict[str, Derivation] = {}
ROWS: dict[str, Derivation] = {}
APART = {"sep3", "sep3_sofa2"}  # row derivations that read each of their parts by itself, so the rows of the parts need not meet


def register(name: str, f: Derivation, rows: bool = False) -> None:
    """Add a derivation of one's own."""
    (ROWS if rows else COLUMNS)[name] = f
    APART.discard(name)


def _column(name: str):
    return lambda f: COLUMNS.setdefault(name, f)


def _rows(name: str):
    return lambda f: ROWS.setdefault(name, f)


def _add(wide: DataFrame, name: str, inputs: list[str], value: Column) -> DataFrame:
    given = [c for c in inputs if c in wide.columns]
    return wide.withColumn(name, F.when(any_known(*given), value)) if given else wide.withColumn(name, F.lit(None).cast("double"))


def _get(wide: DataFrame, name: str, dtype: str = "double") -> Column:
    return F.col(name) if name in wide.columns else F.lit(None).cast(dtype)


def _opt(wide: DataFrame, name: str) -> str | None:
    return name if name in wide.columns else None


def _carried(wide: DataFrame, ctx: Context, columns: list[str], window: int) -> tuple[DataFrame, dict[str, str]]:
    """Last known values at most ``window`` old, under temporary names."""
    temp = {c: f"_last_{c}" for c in columns if c in wide.columns}
    return locf_window(wide, ctx.ids, ctx.time, {t: c for c, t in temp.items()}, window), temp


def _oxygen(o2: str):
    def derive(wide: DataFrame, ctx: Context, name: str, parts: list[str]) -> DataFrame:
        out, last = _carried(wide, ctx, [o2, "fio2"], ctx.option("match_win", 2 * HOUR))
        fio2 = F.coalesce(_get(out, last.get("fio2", "")), F.lit(21.0))
        ratio = F.when(fio2 > 0, _get(out, last.get(o2, "")) * 100 / fio2)
        return _add(out, name, [o2, "fio2"], ratio).drop(*last.values())

    return derive


register("pafi", _oxygen("po2"))
register("safi", _oxygen("o2sat"))


@_column("sum_components")
def _sum(wide, ctx, name, parts):
    return _add(wide, name, parts, sum_known(*[_get(wide, p) for p in parts]))


@_column("gcs")
def _gcs(wide, ctx, name, parts):
    inputs = [c for c in ("egcs", "vgcs", "mgcs", "tgcs") if c in wide.columns]
    out, last = _carried(wide, ctx, inputs, ctx.option("valid_win", 6 * HOUR))
    col = lambda c: _get(out, last.get(c, ""))
    total = col("tgcs") if ctx.option("use_total", True) else None
    value = scores.gcs_total(
        col("egcs"), col("vgcs"), col("mgcs"), total, _opt(out, "ett_gcs"),
        ctx.option("set_na_max", True), ctx.option("sed_impute", "max"),
    )
    return _add(out, name, inputs, value).drop(*last.values())


def _plain(name: str, make: Callable[[DataFrame], Column]) -> None:
    register(name, lambda wide, ctx, out, parts: _add(wide, out, parts, make(wide)))


_plain("avpu", lambda w: scores.avpu(_get(w, "gcs")))
_plain("bmi", lambda w: scores.bmi(_get(w, "weight"), _get(w, "height")))
_plain("supp_o2", lambda w: scores.supp_o2(_get(w, "vent_ind"), _get(w, "fio2")).cast("int"))
_plain("norepi_equiv", lambda w: scores.norepi_equiv(
    *[_get(w, c) for c in ("epi_rate", "norepi_rate", "dopa_rate", "adh_rate", "phn_rate")]))
_plain("rrt_criteria", lambda w: scores.rrt_criteria(
    _get(w, "crea"), *[_get(w, c) for c in ("uo_6h", "potassium", "ph", "bicarb")]).cast("int"))
_plain("sofa_resp", lambda w: scores.sofa_resp(_get(w, "pafi"), _opt(w, "vent_ind")))
_plain("sofa_coag", lambda w: scores.sofa_coag(_get(w, "plt")))
_plain("sofa_liver", lambda w: scores.sofa_liver(_get(w, "bili")))
_plain("sofa_cardio", lambda w: scores.sofa_cardio(
    _get(w, "map"), *[_get(w, c) for c in ("dopa60", "norepi60", "dobu60", "epi60")]))
_plain("sofa_cns", lambda w: scores.sofa_cns(_get(w, "gcs")))
_plain("sofa_renal", lambda w: scores.sofa_renal(_get(w, "crea"), _get(w, "urine24")))
_plain("sofa2_resp", lambda w: scores.sofa2_resp(
    _get(w, "pafi"), _opt(w, "spo2"), _opt(w, "fio2"), _opt(w, "adv_resp"), _opt(w, "ecmo"), _opt(w, "ecmo_indication")))
_plain("sofa2_coag", lambda w: scores.sofa2_coag(_get(w, "plt")))
_plain("sofa2_liver", lambda w: scores.sofa2_liver(_get(w, "bili")))
_plain("sofa2_cardio", lambda w: scores.sofa2_cardio(
    _get(w, "map"), *[_opt(w, c) for c in ("norepi60", "epi60", "dopa60", "dobu60", "other_vaso", "mech_circ_support")]))
_plain("sofa2_cns", lambda w: scores.sofa2_cns(
    _get(w, "gcs"), *[_opt(w, c) for c in ("delirium_tx", "delirium_positive", "motor_response")]))
_plain("sofa2_renal", lambda w: scores.sofa2_renal(
    _get(w, "crea"), _opt(w, "rrt"), None, *[_opt(w, c) for c in ("uo_6h", "uo_12h", "uo_24h", "potassium", "ph", "bicarb")]))


def _vital(make: Callable[[DataFrame, Callable[[str], Column]], Column], inputs: list[str], window: bool = True):
    def derive(wide: DataFrame, ctx: Context, name: str, parts: list[str]) -> DataFrame:
        if not window:
            return _add(wide, name, inputs, make(wide, lambda c: _get(wide, c)))
        out, last = _carried(wide, ctx, inputs, ctx.window)
        value = make(out, lambda c: _get(out, last.get(c, "")))
        return _add(out, name, inputs, value).drop(*last.values())

    return derive


register("qsofa_score", _vital(lambda w, c: scores.qsofa(c("sbp"), c("resp"), c("gcs")), ["sbp", "resp", "gcs"]))
register("sirs_score", _vital(
    lambda w, c: scores.sirs(c("temp"), c("hr"), c("resp"), c("pco2"), c("wbc"), c("bnd")),
    ["temp", "hr", "resp", "pco2", "wbc", "bnd"]))
register("news_score", _vital(
    lambda w, c: scores.news(c("resp"), c("temp"), c("sbp"), c("hr"), c("o2sat"), c("supp_o2"), _get(w, "avpu", "string")),
    ["resp", "o2sat", "supp_o2", "temp", "sbp", "hr", "avpu"], window=False))
register("mews_score", _vital(
    lambda w, c: scores.mews(c("sbp"), c("hr"), c("resp"), c("temp"), _get(w, "avpu", "string")),
    ["sbp", "hr", "resp", "temp", "avpu"], window=False))


# --- derivations with rows of their own ---------------------------------------------

# Derivations that give nothing unless all their parts are there; the others work with what a source has.
WHOLE = {"urine24", "uo_6h", "uo_12h", "uo_24h", "vaso60", "sep3", "sep3_sofa2"}


def possible(rule: str, parts: tuple[str, ...], present: list[str]) -> bool:
    """Whether a derivation with rows of its own has what it needs."""
    if rule == "susp_inf":
        return "abx" in present
    return (all if rule in WHOLE else any)(p in present for p in parts)


def _known(wide: DataFrame, ctx: Context, *columns: str) -> DataFrame:
    have = [c for c in columns if c in wide.columns]
    return wide.select(*ctx.ids, ctx.time, *have).where(any_known(*have))


@_rows("urine24")
def _urine24(wide, ctx, name, parts):
    return kidney.urine24(_known(wide, ctx, "urine"), ctx.ids, ctx.time, "urine", ctx.step, compat=ctx.compat)


def _urine_rate(hours: int):
    def derive(wide, ctx, name, parts):
        urine = _known(wide, ctx, "urine")
        weight = wide.where(F.col("weight").isNotNull()).groupBy(*ctx.ids).agg(F.min_by("weight", ctx.time).alias("weight"))
        return kidney.urine_rate(urine, weight, ctx.ids, ctx.time, hours, step=ctx.step)

    return derive


for _h in (6, 12, 24):
    register(f"uo_{_h}h", _urine_rate(_h), rows=True)


@_rows("vaso60")
def _vaso60(wide, ctx, name, parts):
    """Durations are in hours on the grid."""
    rate, dur = parts
    durations = _known(wide, ctx, dur).withColumn(dur, (F.col(dur) * HOUR).cast("long"))
    return sustained_rate(_known(wide, ctx, rate), durations, ctx.ids, ctx.time, rate, dur, name, step=ctx.step)


@_rows("vaso_ind")
def _vaso_ind(wide, ctx, name, parts):
    have = [p for p in parts if p in wide.columns]
    rows = _known(wide, ctx, *have).withColumns({p: (F.col(p) * HOUR).cast("long") for p in have})
    return any_infusion(rows, ctx.ids, ctx.time, have, name, ctx.step, ctx.compat).withColumn(name, F.lit(1))


@_rows("vent_ind")
def _vent_ind(wide, ctx, name, parts):
    """Recorded ventilation if there is any, else windows between start and end events."""
    if "mech_vent" in wide.columns:
        return _known(wide, ctx, "mech_vent").select(*ctx.ids, ctx.time, F.lit(1).alias(name))
    starts = _known(wide, ctx, "vent_start").where(is_true("vent_start"))
    ends = _known(wide, ctx, "vent_end").where(is_true("vent_end")) if "vent_end" in wide.columns else None
    windows = ventilation_windows(
        starts, ends, ctx.ids, ctx.time, ctx.option("match_win", 6 * HOUR), ctx.option("min_length", 1_800), ctx.compat
    ).withColumn(name, F.lit(1))
    return expand_windows(windows, ctx.ids, ctx.time, "dur", name, ctx.step)


def _organ(parts_list: list[str]):
    def derive(wide, ctx, name, parts):
        return organ.organ_score(wide, ctx.ids, ctx.time, parts_list, name, ctx.window, ctx.step, compat=ctx.compat)

    return derive


register("sofa_score", _organ(organ.SOFA), rows=True)
register("sofa2_score", _organ(organ.SOFA2), rows=True)


@_rows("susp_inf")
def _susp_inf(wide, ctx, name, parts):
    abx = _known(wide, ctx, "abx").where(F.col("abx") > 0)
    samp = _known(wide, ctx, "samp") if "samp" in wide.columns else None
    diagnosed = _known(wide, ctx, "infection_icd").where(F.col("infection_icd") > 0) if "infection_icd" in wide.columns else None
    mode = ctx.option("si_mode", "auto")
    return sepsis.susp_inf(abx, samp, ctx.ids, ctx.time, mode, diagnosed=diagnosed).select(*ctx.ids, ctx.time, F.lit(1).alias(name))


@_rows("sep3_sofa2")
def _sep3_sofa2(wide, ctx, name, parts):
    infection = _known(wide, ctx, "susp_inf").where(F.col("susp_inf") > 0)
    found = sepsis.sep3_sofa2(
        _known(wide, ctx, "sofa2"), infection, ctx.ids, ctx.time, "sofa2",
        ctx.option("si_window", "first"), ctx.option("delta", "cummin"), ctx.option("sofa_thresh", 2),
    )
    return found.select(*ctx.ids, ctx.time, F.lit(1).alias(name))


@_rows("sep3")
def _sep3(wide, ctx, name, parts):
    score = "sofa2" if "sofa2" in parts else "sofa"
    infection = _known(wide, ctx, "susp_inf").where(F.col("susp_inf") > 0)
    found = sepsis.sep3(
        _known(wide, ctx, score), infection, ctx.ids, ctx.time, score,
        ctx.option("si_window", "first"), ctx.option("delta", "cummin"), ctx.option("sofa_thresh", 2),
    )
    return found.select(*ctx.ids, ctx.time, F.lit(1).alias(name))
