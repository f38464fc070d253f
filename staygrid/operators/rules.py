"""Named source rules: how one source's raw rows become a concept's values.

A concept spec names a rule and its parameters; ``apply_rule`` runs it. Rules
marked row-wise only rewrite columns, so many concepts of one table can share a
scan. The others change the rows (windows, groups, grids).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from staygrid.functions import scalars, scores, units
from staygrid.operators import grid, rates, rolling
from staygrid.operators.aggregate import aggregator
from staygrid.schema import HOUR


@dataclass(frozen=True)
class Roles:
    """Which column plays which part in a source table."""

    ids: tuple[str, ...]
    time: str
    value: str = "value"
    unit: str = "unit"
    item: str = "item"
    stop: str = "stop"
    dur: str = "dur"
    group: tuple[str, ...] = ()
    weight: str = "weight"
    rate_unit: str = "rate_unit"
    aux: str = "aux"


Rule = Callable[..., DataFrame]
RULES: dict[str, Rule] = {}
ROW_WISE: dict[str, set[str]] = {}  # rule -> the parts it rewrites


def rule(name: str, row_wise: bool = False, touches: tuple[str, ...] = ("value",)) -> Callable[[Rule], Rule]:
    def add(f: Rule) -> Rule:
        RULES[name] = f
        if row_wise:
            ROW_WISE[name] = set(touches)
        return f

    return add


def register_rule(name: str, f: Rule, row_wise: bool = False, touches: tuple[str, ...] = ("value",)) -> None:
    """Add a rule of one's own: ``f(df, roles, **params) -> DataFrame``."""
    rule(name, row_wise, touches)(f)


# rule -> (role, concept whose values it reads, whether they belong to a time and not to the stay)
HELPERS = {
    **{name: ("weight", "weight", False) for name in ("mimic_kg_rate", "eicu_rate_kg", "aumc_rate_kg", "hirid_rate_kg", "sic_rate_kg")},
    "blood_cell_ratio": ("aux", "wbc", True),
}


def helpers(spec: dict) -> set[tuple[str, str, bool]]:
    """Columns of other concepts that a rule spec reads."""
    if spec["rule"] == "combine_callbacks":
        return set().union(*[helpers(step) for step in spec["rules"]])
    return {HELPERS[spec["rule"]]} if spec["rule"] in HELPERS else set()


def rewrites(spec: dict) -> set[str] | None:
    """The parts a row-wise rule spec rewrites, None if it changes rows."""
    if spec["rule"] != "combine_callbacks":
        return ROW_WISE.get(spec["rule"])
    steps = [rewrites(step) for step in spec["rules"]]
    return None if None in steps else set().union(*steps)


def apply_rule(df: DataFrame, roles: Roles, name: str, **params) -> DataFrame:
    return RULES[name](df, roles, **params)


def _set(df: DataFrame, roles: Roles, column) -> DataFrame:
    return df.withColumn(roles.value, column)


# --- values, row by row ---------------------------------------------------------

@rule("identity_callback", True)
def _identity(df, r):
    return df


@rule("eicu_age", True)
def _eicu_age(df, r):
    return _set(df, r, scores.age_text(r.value))


@rule("mimic_age", True)
def _mimic_age(df, r, cap=90.0):
    """Days to years."""
    return _set(df, r, F.least(F.col(r.value) / 365.25, F.lit(float(cap))))


@rule("percent_as_numeric", True)
def _percent(df, r):
    return _set(df, r, scalars.percent_as_number(r.value))


@rule("set_val", True)
def _set_val(df, r, value=True):
    return _set(df, r, F.lit(value))


@rule("comp_na", True)
def _comp_na(df, r, op, value):
    return _set(df, r, scalars.comp_na(r.value, op, value))


@rule("binary_op", True)
def _binary_op(df, r, op, value):
    return _set(df, r, scalars.binary_op(scalars.number(df, r.value), op, value))


@rule("floor", True)
def _floor(df, r):
    return _set(df, r, F.floor(r.value))


@rule("ceiling", True)
def _ceiling(df, r):
    return _set(df, r, F.ceil(r.value))


@rule("round", True)
def _round(df, r, digits=0):
    return _set(df, r, F.bround(r.value, digits))


@rule("apply_map", True)
def _apply_map(df, r, mapping, column=None):
    value = F.col(column or r.value)
    text = all(isinstance(k, str) for k in mapping)  # as in a dictionary file, whatever the column's type
    return _set(df, r, scalars.apply_map(value.cast("string") if text else value, mapping))


@rule("convert_unit", True, ("value", "unit"))
def _convert_unit(df, r, op, by, new_unit, pattern=None):
    return units.convert_where(df, r.value, r.unit, lambda v: scalars.binary_op(v, op, by), new_unit, pattern)


@rule("sub_trans", True)
def _sub_trans(df, r, pattern, replacement):
    return _set(df, r, scalars.sub_trans(r.value, pattern, replacement))


@rule("dex_to_10", True)
def _dex_to_10(df, r, factors):
    return _set(df, r, rates.dextrose_factor(r.item, r.value, factors))


@rule("aumc_rate", True, ("unit",))
def _aumc_rate(df, r):
    return df.withColumn(r.unit, rates.composed_unit(r.unit, r.rate_unit))


@rule("aumc_bxs", True)
def _aumc_bxs(df, r):
    return _set(df, r, F.when(F.col(r.aux) == "-", -F.col(r.value)).otherwise(F.col(r.value)))


@rule("aumc_rass", True)
def _aumc_rass(df, r):
    return _set(df, r, F.substring(r.value, 1, 2).try_cast("int"))


@rule("aumc_death", True)
def _aumc_death(df, r, within=72 * HOUR):
    """Value is the discharge time, the time is the death: did it follow within 72 hours."""
    return _set(df, r, F.coalesce(F.col(r.time) - F.col(r.value) < within, F.lit(False)))


@rule("sic_death", True, ("value", "time"))
def _sic_death(df, r):
    """Value is the offset of death: it becomes the time, floored to the hour."""
    return df.withColumns({r.time: F.floor(F.col(r.value) / HOUR) * HOUR, r.value: F.col(r.value).isNotNull()})


@rule("mimic_sampling", True, ("value", "time"))
def _mimic_sampling(df, r):
    """Time is the exact one where known, else the date plus 12 hours; value is whether an organism was found."""
    return df.withColumns({
        r.time: F.coalesce(F.col(r.aux), F.col(r.time) + 12 * HOUR), r.value: F.col(r.value).isNotNull(),
    })


@rule("mimic_abx_presc", True, ("value", "time"))
def _mimic_abx_presc(df, r):
    return df.withColumns({r.time: F.col(r.time) + 12 * HOUR, r.value: F.lit(True)})


@rule("eicu_adx")
def _eicu_adx(df, r):
    """Admission path to ``med``, ``surg`` or ``other``; other paths are dropped."""
    part = lambda i: F.trim(F.get(F.split(r.value, r"\|"), F.lit(i)))
    kind = F.when(F.coalesce(part(4).isin("Genitourinary", "Transplant"), F.lit(False)), "other").when(
        part(2) == "Operative", "surg"
    ).otherwise("med")
    rows = df.where((part(1) == "All Diagnosis") & part(2).isNotNull())
    return _set(rows, r, kind)


@rule("blood_cell_ratio", True)
def _blood_cell_ratio(df, r):
    """The joined white cell count is in the aux column."""
    return _set(df, r, scores.blood_cell_ratio(r.value, r.aux))


@rule("mimic_kg_rate", True)
def _mimic_kg_rate(df, r):
    return rates.rate_over_weight(df, r.value, r.weight)


@rule("mimv_rate", True, ("value", "unit"))
def _mimv_rate(df, r, amount="amount", amount_unit="amount_unit"):
    return rates.rate_or_amount(df, r.value, r.unit, r.dur, amount, amount_unit)


@rule("ts_to_win_tbl", True, ("dur",))
def _ts_to_win(df, r, length):
    return grid.to_window(df, length, r.dur)


@rule("eicu_dex_med")
def _eicu_dex_med(df, r, max_minutes=720):
    return rates.dextrose_bolus(df, r.value, r.dur, max_minutes)


@rule("eicu_dex_inf", True, ("value", "unit", "dur"))
def _eicu_dex_inf(df, r, interval=HOUR):
    return df.withColumns({r.value: scalars.number(df, r.value), r.dur: F.lit(interval), r.unit: F.lit("ml/hr")})


@rule("vent_flag")
def _vent_flag(df, r):
    """The value is a time: it becomes the row's time."""
    return df.where(F.col(r.value).isNotNull()).withColumns({r.time: F.col(r.value), r.value: F.lit(True)})


@rule("combine_callbacks")
def _combine(df, r, rules):
    for step in rules:
        step = dict(step)
        df = apply_rule(df, r, step.pop("rule"), **step)
    return df


# --- groups, windows and grids -----------------------------------------------------

@rule("aggregate_fun")
def _aggregate_fun(df, r, how, unit=None):
    out = df.groupBy(*r.ids, r.time).agg(aggregator(how, r.value, [r.time]).alias(r.value))
    return out if unit is None else out.withColumn(r.unit, F.lit(unit))


@rule("hirid_death")
def _hirid_death(df, r, dead="dead"):
    """Last observation time of ids whose status (aux) says dead."""
    gone = df.where(F.lower(r.aux) == dead)
    return gone.groupBy(*r.ids).agg(F.max(r.time).alias(r.time)).withColumn(r.value, F.lit(True))


@rule("grp_mount_to_rate")
def _grp_mount(df, r, min_dur, extra_dur=0):
    return rates.group_amount_to_rate(df, list(r.ids), r.time, list(r.group), r.value, min_dur, extra_dur, r.unit)


@rule("grp_amount_to_rate")
def _grp_amount(df, r, unit):
    return rates.amount_to_rate(df, list(r.ids), r.time, list(r.group), r.value, r.unit, unit)


@rule("mimic_rate_mv")
def _rate_mv(df, r):
    return rates.expand_rate(df, list(r.ids), r.time, r.stop, r.value)


@rule("mimic_dur_inmv")
def _dur_inmv(df, r):
    return grid.group_duration(df, list(r.ids), r.time, r.stop, list(r.group), r.value)


@rule("mimic_dur_incv")
def _dur_incv(df, r):
    return grid.group_duration(df, list(r.ids), r.time, r.time, list(r.group), r.value)


@rule("aumc_dur")
def _aumc_dur(df, r):
    return grid.group_duration(df, list(r.ids), r.time, r.stop, list(r.group), r.value)


@rule("hirid_duration")
def _hirid_duration(df, r):
    return grid.group_duration(df, list(r.ids), r.time, r.time, list(r.group), r.value, drop_negative=True)


@rule("mimic_rate_cv")
def _rate_cv(df, r):
    return grid.expand_intervals(df, list(r.ids), r.time, r.value, list(r.group), fine=HOUR)


@rule("eicu_duration")
def _eicu_duration(df, r, gap=HOUR):
    return grid.session_duration(df, list(r.ids), r.time, gap, r.value)


@rule("eicu_rate_kg")
def _eicu_rate_kg(df, r, ml_to_mcg):
    return rates.rate_per_kg(df, list(r.ids), r.time, r.value, r.item, r.weight, ml_to_mcg)


@rule("eicu_rate_units")
def _eicu_rate_units(df, r, ml_to_mcg, mcg_to_units):
    return rates.rate_in_units(df, list(r.ids), r.time, r.value, r.item, ml_to_mcg, mcg_to_units)


@rule("aumc_rate_kg")
def _aumc_rate_kg(df, r, weight_relative=None):
    return rates.dose_per_kg(df, list(r.ids), r.time, r.stop, r.value, r.unit, r.rate_unit, r.weight, weight_relative)


@rule("aumc_rate_units")
def _aumc_rate_units(df, r, mcg_to_units):
    return rates.dose_in_units(df, list(r.ids), r.time, r.stop, r.value, r.unit, r.rate_unit, mcg_to_units)


@rule("hirid_vent")
def _hirid_vent(df, r, padding=4 * HOUR, max_gap=12 * HOUR):
    return rolling.record_durations(df, list(r.ids), r.time, padding, max_gap, r.dur)


@rule("hirid_urine")
def _hirid_urine(df, r):
    return rolling.increments(df, list(r.ids), r.time, r.value).withColumn(r.unit, F.lit("mL"))


@rule("hirid_rate_kg")
def _hirid_rate_kg(df, r, interval=HOUR):
    return rates.infusion_rate_per_kg(df, list(r.ids), r.time, r.value, r.unit, list(r.group), r.weight, interval)


@rule("hirid_rate")
def _hirid_rate(df, r, to_unit):
    return rates.infusion_rate(df, list(r.ids), r.time, r.value, r.unit, list(r.group), to_unit)


@rule("sic_dur")
def _sic_dur(df, r):
    return rates.longest_infusion(df, list(r.ids), r.time, r.stop, list(r.group), r.value)


@rule("sic_rate_kg")
def _sic_rate_kg(df, r):
    return rates.amount_per_kg(df, list(r.ids), r.time, r.stop, r.value, r.weight)


@rule("distribute_amount")
def _distribute(df, r):
    return grid.distribute_amount(df, list(r.ids), r.time, r.stop, r.value)


@rule("create_intervals")
def _create_intervals(df, r, overhang=HOUR, max_len=6 * HOUR):
    return rolling.create_intervals(df, [*r.ids, *r.group], r.time, overhang, max_len, r.stop)
