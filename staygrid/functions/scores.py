"""Clinical scores as column expressions over one aligned row.

A missing input never raises a score, except where a function says otherwise.
All functions take columns and return columns, so a whole panel of scores is
one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from staygrid.functions.scalars import is_true
from staygrid.schema import as_column

Col = str | Column


def _known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _or_none(c: Col | None, dtype: str = "double") -> Column:
    return F.lit(None).cast(dtype) if c is None else as_column(c)


def _flag(c: Col | None) -> Column:
    return F.lit(False) if c is None else is_true(c)


def _dose(c: Col | None) -> Column:
    return F.lit(0.0) if c is None else F.coalesce(as_column(c), F.lit(0.0))


def _highest(*levels: tuple[Column, int]) -> Column:
    """Points of the first level that holds, 0 if none does."""
    chain = F
    for condition, points in levels:
        chain = chain.when(_known(condition), F.lit(points))
    return chain.otherwise(F.lit(0))


def band(x: Col, breaks: list[tuple[float, int]], above: int) -> Column:
    """Points by upper bounds: the first ``x <= bound`` wins, else ``above``; null gives 0."""
    v = as_column(x)
    chain = F.when(v.isNull(), F.lit(0))
    for bound, points in breaks:
        chain = chain.when(v <= bound, F.lit(points))
    return chain.otherwise(F.lit(above))


def map_breaks(x: Col, values: list[float], breaks: list[float]) -> Column:
    """Value by the first break not exceeded, the last value beyond; null stays null."""
    v = as_column(x)
    chain = F.when(v.isNull(), F.lit(None).cast("double"))
    for value, bound in zip(values, breaks):
        chain = chain.when(v <= bound, F.lit(float(value)))
    return chain.otherwise(F.lit(float(values[-1])))


# --- SOFA -------------------------------------------------------------------

def sofa_resp(pafi: Col, vent_ind: Col | None = None) -> Column:
    """P/F ratio; below 200 counts as 200 without ventilation."""
    p = as_column(pafi)
    adjusted = F.when(_known(p < 200) & ~_flag(vent_ind), F.lit(200.0)).otherwise(p)
    return _highest((adjusted < 100, 4), (adjusted < 200, 3), (adjusted < 300, 2), (adjusted < 400, 1))


def sofa_coag(plt: Col) -> Column:
    p = as_column(plt)
    return _highest((p < 20, 4), (p < 50, 3), (p < 100, 2), (p < 150, 1))


def sofa_liver(bili: Col) -> Column:
    b = as_column(bili)
    return _highest((b >= 12, 4), (b >= 6, 3), (b >= 2, 2), (b >= 1.2, 1))


def sofa_cardio(map: Col, dopa60: Col | None = None, norepi60: Col | None = None,
                dobu60: Col | None = None, epi60: Col | None = None) -> Column:
    """Drug rates in ug/kg/min."""
    dopa, norepi, dobu, epi = _dose(dopa60), _dose(norepi60), _dose(dobu60), _dose(epi60)
    return _highest(
        ((dopa > 15) | (epi > 0.1) | (norepi > 0.1), 4),
        ((dopa > 5) | (epi > 0) | (norepi > 0), 3),
        ((dopa > 0) | (dobu > 0), 2),
        (as_column(map) < 70, 1),
    )


def sofa_cns(gcs: Col) -> Column:
    """A missing coma scale stays missing."""
    g = as_column(gcs)
    return F.when(g.isNotNull(), _highest((g < 6, 4), (g < 10, 3), (g < 13, 2), (g < 15, 1)))


def sofa_renal(crea: Col, urine24: Col | None = None) -> Column:
    c, u = as_column(crea), _or_none(urine24)
    return _highest(
        (_known(c >= 5) | _known(u < 200), 4),
        (_known(c >= 3.5) | _known(u < 500), 3),
        (c >= 2, 2),
        (c >= 1.2, 1),
    )


# --- SOFA-2 -----------------------------------------------------------------

def sofa2_resp(pafi: Col, spo2: Col | None = None, fio2: Col | None = None, adv_resp: Col | None = None,
               ecmo: Col | None = None, ecmo_indication: Col | None = None) -> Column:
    """P/F ratio, or S/F (below 98 % saturation) where P/F is missing.

    ``fio2`` is the divisor of S/F as given.
    """
    pf = as_column(pafi)
    safi = F.lit(None).cast("double")
    if spo2 is not None and fio2 is not None:
        safi = F.when(as_column(spo2) < 98, F.try_divide(as_column(spo2), as_column(fio2)))
    by_sf = pf.isNull() & safi.isNotNull()
    ratio = F.coalesce(pf, safi)
    support = _flag(adv_resp)
    bypass = _flag(ecmo)
    if ecmo is not None and ecmo_indication is not None:
        bypass = bypass & _known(as_column(ecmo_indication) == "respiratory")

    def below(pf_cut: float, sf_cut: float) -> Column:
        return _known(ratio <= pf_cut) | (by_sf & _known(ratio <= sf_cut))

    return _highest(
        ((below(75, 120) & support) | bypass, 4),
        (below(150, 200) & support, 3),
        (below(225, 250), 2),
        (ratio <= 300, 1),
    )


def sofa2_coag(plt: Col) -> Column:
    p = as_column(plt)
    return _highest((p <= 50, 4), (p <= 80, 3), (p <= 100, 2), (p <= 150, 1))


def sofa2_liver(bili: Col) -> Column:
    b = as_column(bili)
    return _highest((b > 12, 4), (b > 6, 3), (b > 3, 2), (b > 1.2, 1))


def sofa2_cardio(map: Col, norepi60: Col | None = None, epi60: Col | None = None, dopa60: Col | None = None,
                 dobu60: Col | None = None, other_vaso: Col | None = None,
                 mech_circ_support: Col | None = None, map_only: bool = False) -> Column:
    """Summed noradrenaline and adrenaline dose; dopamine bands only without them.

    ``map_only`` scores by pressure alone (60, 50, 40 mmHg), for places without drugs.
    """
    pressure = as_column(map)
    if map_only:
        return _highest((pressure < 40, 4), (pressure < 50, 3), (pressure < 60, 2), (pressure < 70, 1))
    dose = _dose(norepi60) + _dose(epi60)
    dopa = F.when(dose == 0, _dose(dopa60)).otherwise(F.lit(0.0))
    other = _flag(other_vaso) | (_dose(dobu60) > 0)
    low = (dose > 0) & (dose <= 0.2)
    medium = (dose > 0.2) & (dose <= 0.4)
    return _highest(
        ((dose > 0.4) | (dopa > 40) | (medium & other) | _flag(mech_circ_support), 4),
        (medium | (dopa > 20) | (low & other), 3),
        (low | (dopa > 0) | other, 2),
        (pressure < 70, 1),
    )


def sofa2_cns(gcs: Col, delirium_tx: Col | None = None, delirium_positive: Col | None = None,
              motor_response: Col | None = None) -> Column:
    """Coma scale bands; treated or positive delirium lifts 15 to one point.

    With ``motor_response`` its bands stand in where the coma scale is missing.
    """
    g = as_column(gcs)
    points = _highest(
        ((g >= 3) & (g <= 5), 4), ((g >= 6) & (g <= 8), 3), ((g >= 9) & (g <= 12), 2), ((g >= 13) & (g <= 14), 1),
        ((g == 15) & (_flag(delirium_tx) | _flag(delirium_positive)), 1),
    )
    if motor_response is None:
        return points
    m = as_column(motor_response)
    by_motor = _highest((m <= 3, 4), (m == 4, 3), (m == 5, 2), (m == 6, 1))
    return F.when(g.isNull(), by_motor).otherwise(points)


def rrt_criteria(crea: Col, uo_6h: Col | None = None, potassium: Col | None = None,
                 ph: Col | None = None, bicarb: Col | None = None) -> Column:
    """Kidney injury or oliguria, with high potassium or metabolic acidosis."""
    injury = _known(as_column(crea) > 1.2) | _known(_or_none(uo_6h) < 0.3)
    crisis = _known(_or_none(potassium) >= 6.0) | _known((_or_none(ph) <= 7.2) & (_or_none(bicarb) <= 12))
    return injury & crisis


def sofa2_renal(crea: Col, rrt: Col | None = None, rrt_need: Col | None = None, uo_6h: Col | None = None,
                uo_12h: Col | None = None, uo_24h: Col | None = None, potassium: Col | None = None,
                ph: Col | None = None, bicarb: Col | None = None) -> Column:
    """Creatinine, duration of low urine output, and replacement therapy or its criteria."""
    c, u6, u12, u24 = as_column(crea), _or_none(uo_6h), _or_none(uo_12h), _or_none(uo_24h)
    need = _flag(rrt_need) if rrt_need is not None else rrt_criteria(crea, uo_6h, potassium, ph, bicarb)
    return _highest(
        (_flag(rrt) | need, 4),
        (_known(c > 3.5) | _known(u24 < 0.3) | _known(u12 == 0), 3),
        (_known((c > 2.0) & (c <= 3.5)) | _known(u12 < 0.5), 2),
        (_known((c > 1.2) & (c <= 2.0)) | (_known(u6 < 0.5) & ~_known(u12 < 0.5)), 1),
    )


# --- warning scores ----------------------------------------------------------

def sirs(temp: Col, hr: Col, resp: Col, pco2: Col | None = None, wbc: Col | None = None,
         bnd: Col | None = None) -> Column:
    t, w = as_column(temp), _or_none(wbc)
    return (
        _highest(((t < 36) | (t > 38), 1))
        + _highest((as_column(hr) > 90, 1))
        + _highest((_known(as_column(resp) > 20) | _known(_or_none(pco2) < 32), 1))
        + _highest((_known((w < 4) | (w > 12)) | _known(_or_none(bnd) > 10), 1))
    )


def qsofa(sbp: Col, resp: Col, gcs: Col) -> Column:
    return (
        _highest((as_column(sbp) <= 100, 1)) + _highest((as_column(resp) >= 22, 1)) + _highest((as_column(gcs) <= 13, 1))
    )


def apache_ii_partial(age: Col, temp: Col) -> Column:
    """Age and temperature points only; the age points of all steps passed add up."""
    a, t = as_column(age), as_column(temp)
    age_points = _highest((a >= 75, 16), (a >= 65, 10), (a >= 55, 5), (a >= 45, 2))
    heat = _highest(
        (t >= 41, 4), (t >= 39, 3), (t >= 38.5, 1), (t >= 36, 0), (t >= 34, 1), (t >= 32, 2), (t >= 30, 3), (t < 30, 4)
    )
    return age_points + heat


def avpu(gcs: Col) -> Column:
    """Consciousness letter of a coma scale: 3 U, 4-9 P, 10-13 V, 14-15 A."""
    g = as_column(gcs)
    return (
        F.when(g <= 2, F.lit(None).cast("string")).when(g <= 3, "U").when(g <= 9, "P").when(g <= 13, "V").when(g <= 15, "A")
    )


def _coarse_avpu(gcs: Col) -> Column:
    """Letter used by the warning scores when only the coma scale is given."""
    g = as_column(gcs)
    return F.when(g < 9, "U").when(g < 13, "P").when(g < 15, "V").otherwise("A")


def _letter(avpu: Col | None, gcs: Col | None) -> Column:
    if avpu is not None:
        return as_column(avpu)
    return F.lit("A") if gcs is None else _coarse_avpu(gcs)


def news_parts(resp: Col, temp: Col, sbp: Col, hr: Col, o2sat: Col | None = None, supp_o2: Col | None = None,
               avpu: Col | None = None, gcs: Col | None = None, unknown_avpu_scores: bool = False) -> dict[str, Column]:
    """Sub-scores of NEWS. An unknown letter scores 0, or 3 with ``unknown_avpu_scores``."""
    letter = _letter(avpu, gcs)
    alert = F.coalesce(letter == "A", F.lit(not unknown_avpu_scores))
    return {
        "resp_comp": band(resp, [(8, 3), (11, 1), (20, 0), (24, 2)], 3),
        "o2sat_comp": F.lit(0) if o2sat is None else band(o2sat, [(91, 3), (93, 2), (95, 1)], 0),
        "temp_comp": band(temp, [(35, 3), (36, 1), (38.4, 0), (39, 1)], 2),
        "sbp_comp": band(sbp, [(90, 3), (100, 2), (110, 1), (219, 0)], 3),
        "hr_comp": band(hr, [(40, 3), (50, 1), (90, 0), (110, 1), (130, 2)], 3),
        "supp_o2_comp": F.when(_flag(supp_o2), 2).otherwise(0),
        "avpu_comp": F.when(alert, 0).otherwise(3),
    }


def mews_parts(sbp: Col, hr: Col, resp: Col, temp: Col, avpu: Col | None = None, gcs: Col | None = None) -> dict[str, Column]:
    letter = _letter(avpu, gcs)
    return {
        "sbp_comp": band(sbp, [(70, 3), (80, 2), (100, 1), (199, 0)], 2),
        "hr_comp": band(hr, [(40, 2), (50, 1), (100, 0), (110, 1), (129, 2)], 3),
        "resp_comp": band(resp, [(9, 2), (14, 0), (20, 1), (29, 2)], 3),
        "temp_comp": band(temp, [(35, 2), (38.4, 0)], 2),
        "avpu_comp": _highest((letter == "V", 1), (letter == "P", 2), (letter == "U", 3)),
    }


def _sum(parts: dict[str, Column]) -> Column:
    total = F.lit(0)
    for part in parts.values():
        total = total + part
    return total


def news(*args, **kwargs) -> Column:
    return _sum(news_parts(*args, **kwargs))


def mews(*args, **kwargs) -> Column:
    return _sum(mews_parts(*args, **kwargs))


# --- kidney and circulation --------------------------------------------------

def aki_stage_creat(crea: Col, low_48h: Col, low_7d: Col) -> Column:
    c, l48, l7 = as_column(crea), as_column(low_48h), as_column(low_7d)
    acute = _known(l48 <= 3.7) | _known(c >= l7 * 1.5)
    return _highest(
        (_known(c >= l7 * 3.0) | (_known(c >= 4.0) & acute), 3),
        (c >= l7 * 2.0, 2),
        (_known(c >= l7 * 1.5) | _known(c >= l48 + 0.3), 1),
    )


def aki_stage_uo(uo_6h: Col, uo_12h: Col, uo_24h: Col) -> Column:
    u6, u12, u24 = as_column(uo_6h), as_column(uo_12h), as_column(uo_24h)
    return _highest((_known(u24 < 0.3) | _known(u12 == 0), 3), (u12 < 0.5, 2), (u6 < 0.5, 1))


def circ_failure_event(lact: Col, map: Col, norepi_rate: Col | None = None, epi_rate: Col | None = None,
                       vaso_rate: Col | None = None, level1_drug: Col | None = None) -> Column:
    """Event level 0 to 3 of one time point: raised lactate with low pressure or drugs."""
    n, e, v = _or_none(norepi_rate), _or_none(epi_rate), _or_none(vaso_rate)
    raised = _known(as_column(lact) >= 2.0)
    return _highest(
        (raised & (_known(n >= 0.1) | _known(e >= 0.1) | _known(v > 0)), 3),
        (raised & (_known((n > 0) & (n < 0.1)) | _known((e > 0) & (e < 0.1))), 2),
        (raised & (_known(as_column(map) <= 65.0) | _flag(level1_drug)), 1),
    )


# --- single measures ---------------------------------------------------------

def bmi(weight: Col, height: Col) -> Column:
    """kg over metres squared, null outside 10 to 100."""
    metres = as_column(height) / 100.0
    value = F.try_divide(as_column(weight), metres * metres)
    return F.when((value >= 10) & (value <= 100), value)


def norepi_equiv(epi: Col | None = None, norepi: Col | None = None, dopa: Col | None = None,
                 adh: Col | None = None, phn: Col | None = None) -> Column:
    """Noradrenaline equivalent of all given rates; null when none is known."""
    weights = [(epi, 1.0), (norepi, 1.0), (dopa, 1.0 / 150.0), (adh, 2.5), (phn, 0.1)]
    given = [(as_column(c), w) for c, w in weights if c is not None]
    total = F.lit(0.0)
    for c, w in given:
        total = total + F.coalesce(c * F.lit(w), F.lit(0.0))
    return F.when(F.coalesce(*[c for c, _ in given]).isNotNull(), total)


def supp_o2(vent_ind: Col, fio2: Col) -> Column:
    return is_true(vent_ind) | _known(as_column(fio2) > 21)


def gcs_total(egcs: Col, vgcs: Col, mgcs: Col, tgcs: Col | None = None, intubated: Col | None = None,
              set_na_max: bool = True, sed_impute: str = "max") -> Column:
    """Total coma scale from a recorded total (3 or more) or its parts.

    Missing parts count as their maximum (4, 5, 6) with ``set_na_max``; intubated
    rows count as 15 with ``sed_impute="max"``.
    """
    total = _or_none(tgcs)
    if intubated is not None and sed_impute == "max":
        total = F.when(_flag(intubated), F.lit(15.0)).otherwise(total)
    total = F.when(total >= 3, total)

    def part(c: Col, highest: float) -> Column:
        return F.coalesce(as_column(c), F.lit(highest)) if set_na_max else as_column(c)

    summed = part(egcs, 4.0) + part(mgcs, 6.0) + part(vgcs, 5.0)
    return F.coalesce(total, summed, F.lit(15.0)) if set_na_max else F.coalesce(total, summed)


def blood_cell_ratio(count: Col, wbc: Col) -> Column:
    """Absolute count to percent of white cells."""
    return F.try_divide(as_column(count) * 100.0, as_column(wbc))


def blood_cell_count(percent: Col, wbc: Col) -> Column:
    return as_column(percent) / 100.0 * as_column(wbc)


def age_at(birth: Col, admission: Col, cap: float = 90.0) -> Column:
    """Years between two dates, capped."""
    years = F.datediff(as_column(admission).cast("date"), as_column(birth).cast("date")) / F.lit(365.25)
    return F.least(years, F.lit(cap))


def age_text(x: Col) -> Column:
    """Age from text where the oldest are written ``> 89``."""
    return F.when(as_column(x) == "> 89", F.lit(90.0)).otherwise(as_column(x).try_cast("double"))
