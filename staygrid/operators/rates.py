"""Dose rates: parsing units, scaling per minute and kilogram, spreading over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from staygrid.functions.scalars import apply_map, extract_unit, number, to_number
from staygrid.functions.times import floor_to
from staygrid.functions.units import convert_units
from staygrid.operators.aggregate import by_counts
from staygrid.operators.grid import expand, expand_intervals
from staygrid.operators.rolling import previous
from staygrid.schema import HOUR, names

DEFAULT_WEIGHT = 70.0


def _unit(c: str | Column) -> Column:
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def _weight(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(DEFAULT_WEIGHT))


# --- rates named in the drug text -----------------------------------------------

def per_kg_minute(value: Column, unit: Column, weight: Column, ml_to_mcg: float) -> Column:
    """Rate in mcg/kg/min from a unit such as ``mg/hr`` or ``ml/hr``; unknown units give null."""
    u = F.lower(F.trim(unit))
    v = F.when(u.contains("/hr"), value / 60).otherwise(value)
    v = (
        F.when(u.startswith("mg/"), v * 1000)
        .when(u.startswith("ml/"), v * ml_to_mcg)
        .when(u.startswith("nanograms/"), v / 1000)
        .otherwise(v)
    )
    v = F.when(u.contains("/kg/"), v).otherwise(v / weight)
    unusable = u.isNull() | u.startswith("units/") | u.isin("unknown", "ml", "")
    return F.when(~unusable, v)


def drug_unit(text: str | Column) -> Column:
    """Unit of a drug text: the closing brackets, or the text if it is itself a unit."""
    c = F.col(text) if isinstance(text, str) else text
    inside = F.nullif(F.regexp_extract(c, r"\(([^)]+)\)$", 1), F.lit(""))
    bare = F.when(c.contains("/") | F.lower(c).isin("mg", "mcg", "ml", "units"), c)
    return F.coalesce(inside, bare)


def rate_per_kg(
    df: DataFrame, ids: list[str], order: str | list[str], value: str, drug: str, weight: str, ml_to_mcg: float
) -> DataFrame:
    """Charted drug rates in mcg/kg/min, one value per hour."""
    rate = per_kg_minute(number(df, value), drug_unit(drug), _weight(weight), ml_to_mcg)
    rows = df.withColumn(value, rate).where(F.col(value).isNotNull())
    return expand_intervals(rows, ids, order, value)


def rate_in_units(
    df: DataFrame, ids: list[str], order: str | list[str], value: str, drug: str, ml_to_mcg: float, mcg_to_units: float
) -> DataFrame:
    """Charted drug rates in units/min, one value per hour; per-kilogram rates are dropped."""
    u, v = F.lower(F.coalesce(extract_unit(drug), F.lit(""))), number(df, value)
    v = F.when(u.endswith("/hr"), v / 60).otherwise(v)
    v = (
        F.when(u.contains("/kg/"), F.lit(None).cast("double"))
        .when(u.startswith("mg/"), v * 1000 * mcg_to_units)
        .when(u.startswith("ml/"), v * ml_to_mcg * mcg_to_units)
        .when(u.startswith("mcg/"), v * mcg_to_units)
        .otherwise(v)
    )
    return expand_intervals(df.withColumn(value, v).where(F.col(value).isNotNull()), ids, order, value)


# --- dose and rate unit in columns of their own -----------------------------------

# Factor to micrograms per mass unit, and to one minute per rate unit.
MASS_FACTOR = {
    "mg": 1e3, "milligram": 1e3, "milligrams": 1e3, "g": 1e6, "gram": 1e6, "grams": 1e6,
    "µg": 1.0, "μg": 1.0, "ug": 1.0, "microgram": 1.0, "micrograms": 1.0, "mcg": 1.0, "mcgs": 1.0,
}
MINUTES = {
    "uur": 60.0, "u": 60.0, "hour": 60.0, "hours": 60.0, "h": 60.0,
    "dag": 1440.0, "dagen": 1440.0, "day": 1440.0, "days": 1440.0, "d": 1440.0,
    "sec": 1 / 60, "seconde": 1 / 60, "second": 1 / 60, "seconds": 1 / 60, "s": 1 / 60, "min": 1.0,
}


def to_micrograms(value: Column, unit: str | Column) -> Column:
    return value * F.coalesce(apply_map(_unit(unit), MASS_FACTOR), F.lit(1.0))


def per_minute(value: Column, rate_unit: str | Column, interval_minutes: float = 60.0) -> Column:
    """Rate per minute; a dose without a rate unit is spread over the interval."""
    u = _unit(rate_unit)
    known = F.coalesce(apply_map(u, MINUTES), F.lit(1.0))
    return value / F.when(u.isNull() | u.isin("nan", "none", "nat", ""), F.lit(interval_minutes)).otherwise(known)


def dose_per_kg(
    df: DataFrame, ids: list[str], start: str, stop: str, value: str, unit: str, rate_unit: str, weight: str,
    weight_relative: str | None = None, step: int = HOUR,
) -> DataFrame:
    """Doses with stop times in mcg/kg/min on the hours they cover."""
    rows = df.where(F.col(unit).isNotNull() & F.col(rate_unit).isNotNull())
    rate = per_minute(to_micrograms(number(df, value), unit), rate_unit)
    relative = F.coalesce(F.col(weight_relative).cast("boolean"), F.lit(False)) if weight_relative else F.lit(False)
    kilograms = F.coalesce(F.col(weight), F.lit(DEFAULT_WEIGHT))
    rate = F.when(~relative & (kilograms > 0), rate / kilograms).otherwise(rate)
    rows = rows.select(*ids, start, stop, rate.alias(value)).where(F.col(value).isNotNull() & (F.col(stop) > F.col(start)))
    return expand(rows, start, stop, step, floored=True).withColumn("unit", F.lit("mcg/kg/min"))


def dose_in_units(
    df: DataFrame, ids: list[str], start: str, stop: str, value: str, unit: str, rate_unit: str, mcg_to_units: float,
    step: int = HOUR,
) -> DataFrame:
    """Doses with stop times in units/min on the hours they cover."""
    mass = apply_map(_unit(unit), MASS_FACTOR)
    v = number(df, value)
    rate = per_minute(F.when(mass.isNotNull(), v * mass * mcg_to_units).otherwise(v), rate_unit)
    rows = df.select(*ids, start, stop, rate.alias(value)).where(F.col(value).isNotNull() & (F.col(stop) > F.col(start)))
    return expand(rows, start, stop, step, floored=True).withColumn("unit", F.lit("units/min"))


def composed_unit(unit: str, rate_unit: str) -> Column:
    return F.concat_ws("/", F.col(unit), F.col(rate_unit))


# --- given doses per infusion -------------------------------------------------------

def infusion_rate_per_kg(
    df: DataFrame, ids: list[str], time: str, value: str, unit: str, group: list[str], weight: str,
    interval: int = HOUR, spread: bool = True,
) -> DataFrame:
    """Given doses in mg or ug summed per infusion and interval, as mcg/kg/min."""
    u = _unit(unit)
    micro = F.when(u == "mg", number(df, value) * 1000).when(u.isin("µg", "ug", "mcg", "μg"), number(df, value))
    rows = df.withColumn(value, micro).where(F.col(value).isNotNull())
    kilograms = F.coalesce(F.max(weight), F.lit(DEFAULT_WEIGHT))
    dose = rows.groupBy(*ids, *group, floor_to(time, interval).alias(time)).agg(
        (F.sum(value) / (interval / 60.0) / kilograms).alias(value)
    )
    return expand_intervals(dose, ids, time, value, group) if spread else dose


def infusion_rate(df: DataFrame, ids: list[str], time: str, value: str, unit: str, group: list[str], to_unit: str) -> DataFrame:
    """Doses summed per infusion, hour and unit, per minute. What converts is given in ``to_unit``, the rest in its own unit."""
    rows = convert_units(df, value, unit, to_unit)
    out = rows.groupBy(*ids, *group, floor_to(time, HOUR).alias(time), unit).agg((F.sum(value) / 60.0).alias(value))
    return out.withColumn(unit, F.concat(F.col(unit), F.lit("/min")))


# --- rates from amounts --------------------------------------------------------------

def expand_rate(df: DataFrame, ids: list[str], start: str, stop: str, value: str, unit: str | None = None, step: int = HOUR) -> DataFrame:
    """A rate on every hour from its floored start to its floored stop."""
    return expand(df.select(*ids, start, stop, value, *([unit] if unit else [])), start, stop, step, floored=True)


def rate_or_amount(df: DataFrame, rate: str, unit: str, dur: str, amount: str, amount_unit: str) -> DataFrame:
    """Fill a missing rate from the amount and the duration in seconds."""
    missing = F.col(rate).isNull()
    return df.withColumns({
        unit: F.when(missing, F.concat(F.col(amount_unit), F.lit("/hour"))).otherwise(F.col(unit)),
        rate: F.coalesce(F.col(rate), F.try_divide(F.col(amount), F.nullif(F.col(dur), F.lit(0)) / HOUR)),
    })


def amount_to_rate(
    df: DataFrame, ids: list[str], order: str | list[str], group: list[str], value: str, unit: str, new_unit: str
) -> DataFrame:
    """Hourly rate from the change of an amount within (id, group).

    The first row of a group has no rate and is dropped; the only row of a group
    stays with a null.
    """
    time = names(order)[0]
    keys = [*ids, *group]
    found = previous(df, keys, order, {"_t": time, "_v": value})
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    rate = F.try_divide(F.col(value) - F.col("_v"), (F.col(time) - F.col("_t")) / HOUR)
    return (
        found.join(sizes, keys)
        .where(F.col("_t").isNotNull() | (F.col("_rows") == 1))
        .withColumns({value: rate, unit: F.lit(new_unit)})
        .select(*df.columns)
    )


def group_amount_to_rate(
    df: DataFrame, ids: list[str], time: str, group: list[str], value: str, min_dur: int, extra_dur: int,
    unit: str | None = None,
) -> DataFrame:
    """Total amount of each group over its duration, per hour."""
    length = F.max(time) - F.min(time)
    length = F.when(length == 0, F.lit(min_dur)).otherwise(length) + extra_dur
    aggs = [F.min(time).alias(time), length.alias("dur"), F.try_divide(F.sum(value), length / HOUR).alias(value)]
    if unit:
        aggs.append(F.concat(F.min(unit), F.lit("/hr")).alias(unit))
    return df.groupBy(*ids, *group).agg(*aggs)


def dextrose_factor(item: str, value: str, factors: dict) -> Column:
    """Value scaled by the item's concentration relative to the standard one."""
    return F.col(value) * F.coalesce(apply_map(item, {k: float(v) for k, v in factors.items()}), F.lit(1.0))


def dextrose_bolus(df: DataFrame, value: str, dur: str, max_minutes: float | None = 720) -> DataFrame:
    """Bolus text such as ``25 g`` to ml/hr; ``dur`` in seconds. Rows over ``max_minutes`` are no boluses; None keeps all."""
    text = F.regexp_replace(F.trim(F.col(value)), r"\s+", " ")
    number = to_number(F.regexp_replace(F.split(text, " ", 2)[0], r"^(.+-|Manual)", ""))
    mass = F.coalesce(F.get(F.split(text, " ", 2), F.lit(1)).rlike(r"(?i)^m?g.*m?"), F.lit(False))
    minutes = F.coalesce(F.col(dur) / 60.0, F.lit(1.0))
    minutes = F.when(minutes > 0, minutes).otherwise(F.lit(1.0))
    return df.withColumns({
        "_minutes": minutes, "_ml": F.when(mass, number * 2).otherwise(number),
    }).where(F.lit(True) if max_minutes is None else F.col("_minutes") <= max_minutes).withColumns({
        value: F.col("_ml") / F.col("_minutes") * 5.0 * 60.0,
        "unit": F.lit("ml/hr"),
        dur: F.col("_minutes") * 60.0,
    }).drop("_minutes", "_ml")


def rate_over_weight(df: DataFrame, rate: str, weight: str) -> DataFrame:
    return df.withColumn(rate, F.try_divide(F.col(rate), F.col(weight)))


def amount_per_kg(
    df: DataFrame, ids: list[str], start: str, stop: str, value: str, weight: str, scale: float = 1e6, step: int = HOUR
) -> DataFrame:
    """Amounts scaled per kilogram on the hours they cover, median per hour."""
    v = number(df, value)
    per_kg = F.when(F.col(weight) > 0, v * scale / F.col(weight)).otherwise(v)
    rows = df.where(F.col(stop) > F.col(start)).select(*ids, start, stop, per_kg.alias(value))
    hours = expand(rows, start, stop, step, floored=True)
    return by_counts(hours, [*ids, start], value, {"_median": "median"}, keep_empty=True).withColumnRenamed("_median", value)


def longest_infusion(df: DataFrame, ids: list[str], start: str, stop: str, group: list[str], out: str = "dur") -> DataFrame:
    """Whole hours of the longest infusion per id, dated at the id's first start."""
    each = df.groupBy(*ids, *group).agg(
        F.floor(F.min(start) / HOUR).alias("_from"), F.floor(F.max(stop) / HOUR).alias("_to")
    )
    return each.groupBy(*ids).agg(
        F.min("_from").alias(start), F.max(F.col("_to") - F.col("_from")).alias(out)
    )
