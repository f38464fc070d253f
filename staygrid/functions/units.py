"""Unit conversion as data: one linear map per unit pair and substance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from staygrid.functions.scalars import apply_map
from staygrid.schema import as_column

# One line per pair, ``from to factor offset substance``;
# result = value * factor + offset. The way back is derived.
_FORWARD = """
celsius fahrenheit 1.8 32 -
celsius kelvin 1 273.15 -
c f 1.8 32 -
mmol/l mg/dl 18.016 0 -
mg/dl umol/l 88.4 0 -
mmol/l mg/dl 2.8 0 urea
mmol/l mg/dl 9.0 0 lactate
mg/dl umol/l 17.1 0 bilirubin
g/dl g/l 10 0 -
k/ul 10^9/l 1 0 -
k/ul 10^9/l 1 0 platelet
mmhg kpa 0.133322 0 -
kg lb 2.20462 0 -
inch cm 2.54 0 -
l ml 1000 0 -
fraction % 100 0 fio2
g mg 1000 0 -
mg ug 1000 0 -
ug ng 1000 0 -
mg ng 1000000 0 -
min sec 60 0 -
hour min 60 0 -
day hour 24 0 -
week day 7 0 -
mmol/l mg/dl 2.8 0 bun
g/dl g/l 10 0 protein
mmol/l mg/dl 4.0 0 calcium
mmol/l mg/dl 2.4 0 magnesium
meq/l mg/dl 1.2 0 magnesium
mmol/l mg/dl 3.1 0 phosphate
mmol/l mg/dl 38.67 0 cholesterol
mmol/l mg/dl 88.57 0 triglyceride
l/min ml/min 1000 0 -
ml/min ml/h 60 0 -
kcal kj 4.184 0 -
"""

# Spellings of each unit.
ALIASES = {
    "fahrenheit": ["f", "deg f", "°f"],
    "celsius": ["c", "deg c", "°c", "centigrade"],
    "kelvin": ["k"],
    "mg/dl": ["mg/100ml", "mg%", "mg per dl"],
    "mmol/l": ["mmol/dl", "mm"],
    "umol/l": ["µmol/l", "micromol/l"],
    "g/dl": ["g/100ml", "g%"],
    "g/l": ["grams/l"],
    "k/ul": ["k/µl", "thou/ul", "x10^3/µl"],
    "10^9/l": ["x10^9/l", "giga/l"],
    "mmhg": ["mm hg", "torr"],
    "kpa": ["kilopascal"],
    "kg": ["kilogram"],
    "lb": ["lbs", "pound", "pounds"],
    "cm": ["centimeter", "centimeters"],
    "inch": ["in", "inches", '"'],
    "ml": ["milliliter", "milliliters"],
    "l": ["liter", "liters"],
    "%": ["percent", "pct"],
    "fraction": ["decimal"],
    "mg": ["milligram", "milligrams"],
    "g": ["gram", "grams"],
    "ug": ["µg", "microgram", "micrograms"],
    "min": ["minute", "minutes"],
    "hour": ["hr", "hours", "hrs"],
    "day": ["days", "d"],
    "sec": ["second", "seconds", "s"],
    "week": ["weeks", "wk", "wks"],
    "ng": ["nanogram", "nanograms"],
    "meq/l": ["meq/dl", "milliequivalent/l"],
    "kcal": ["kilocalorie", "kilocalories", "cal"],
    "kj": ["kilojoule", "kilojoules"],
}

_SPELLINGS = {alias: unit for unit, aliases in ALIASES.items() for alias in aliases}


def conversion_rows() -> list[tuple[str, str, str | None, float, float]]:
    """(from, to, substance, factor, offset) in both directions."""
    rows = []
    for line in _FORWARD.strip().splitlines():
        source, target, factor, offset, substance = line.split()
        f, o, s = float(factor), float(offset), None if substance == "-" else substance
        rows += [(source, target, s, f, o), (target, source, s, 1.0 / f, -o / f)]
    return rows


def conversion_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        conversion_rows(), "from_unit string, to_unit string, substance string, factor double, shift double"
    )


def normal_unit(unit: str) -> str:
    text = unit.lower().strip()
    return text if text in ALIASES else _SPELLINGS.get(text, text)


def normal_unit_column(unit: str | Column) -> Column:
    text = F.lower(F.trim(as_column(unit)))
    return F.coalesce(apply_map(text, _SPELLINGS), text)


def find_conversion(source: str, target: str, substance: str | None = None) -> tuple[float, float] | None:
    """Factor and offset between two units; a substance rule wins over a general one."""
    a, b = normal_unit(source), normal_unit(target)
    if a == b:
        return 1.0, 0.0
    rules = {(r[0], r[1], r[2]): (r[3], r[4]) for r in conversion_rows()}
    wanted = substance.lower() if substance else None
    return rules.get((a, b, wanted)) or rules.get((a, b, None))


def can_convert(source: str, target: str, substance: str | None = None) -> bool:
    return find_conversion(source, target, substance) is not None


def convert(x: str | Column, source: str, target: str, substance: str | None = None) -> Column:
    rule = find_conversion(source, target, substance)
    if rule is None:
        raise ValueError(f"no conversion from {source} to {target}")
    return as_column(x) * F.lit(rule[0]) + F.lit(rule[1])


def convert_units(df: DataFrame, value: str, unit: str, target: str, substance: str | None = None) -> DataFrame:
    """Convert rows of mixed units to ``target``; unknown units stay as they are.

    The table of conversions has a fixed size (about 70 rows), hence the broadcast.
    """
    wanted = normal_unit(target)
    rules = [
        (a, f, o) for a, b, s, f, o in conversion_rows()
        if b == wanted and (s is None or (substance and s == substance.lower()))
    ]
    special = {a for a, b, s, _, _ in conversion_rows() if b == wanted and s and substance and s == substance.lower()}
    rows = {a: (f, o) for a, f, o in rules if a not in special}
    rows |= {a: (f, o) for a, b, s, f, o in conversion_rows()
             if a in special and b == wanted and s == (substance or "").lower()}
    rows[wanted] = (1.0, 0.0)
    table = df.sparkSession.createDataFrame(
        [(a, f, o) for a, (f, o) in rows.items()], "_unit string, _factor double, _shift double"
    )
    return (
        df.withColumn("_unit", normal_unit_column(unit))
        .join(F.broadcast(table), "_unit", "left")
        .withColumn(value, F.coalesce(F.col(value) * F.col("_factor") + F.col("_shift"), F.col(value)))
        .withColumn(unit, F.when(F.col("_factor").isNotNull(), F.lit(target)).otherwise(F.col(unit)))
        .select(*df.columns)
    )


# The substance of a concept, where a unit pair means different factors for different substances.
SUBSTANCES = {
    "glu": "glucose", "crea": "creatinine", "lact": "lactate", "bili": "bilirubin", "bili_dir": "bilirubin", "bun": "bun", "ca": "calcium",
    "mg": "magnesium", "phos": "phosphate", "plt": "platelet", "fio2": "fio2",
}
# Rules of the table without a substance that hold for one substance only.
_MOLAR = {frozenset(("mmol/l", "mg/dl")): "glucose", frozenset(("mg/dl", "umol/l")): "creatinine"}
# What stands for "no unit" in a unit column.
UNITLESS = ("", "none", "geen", "null", "na", "n/a", "-")


def unit_key(unit: str) -> str:
    """A spelling without case, blanks and punctuation other than the percent and degree signs; both micro signs are u."""
    return "".join(c for c in unit.lower().replace("µ", "u").replace("μ", "u") if c.isascii() and c.isalnum() or c in "%°")


def unit_key_column(unit: str | Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(as_column(unit)), "µμ", "uu"), "[^a-z0-9%°]", "")


def unit_steps(units: list[str], concept: str | None = None) -> dict[str, tuple[float, float, float, float]]:
    """``unit_key`` of every spelling that leads to ``units[0]``, with ``before``, ``factor``, ``divisor`` and ``after``:
    result = (value + before) * factor / divisor + after.

    A way back subtracts and divides, so it gives the numbers of the formula as written and not those of a rounded reciprocal.
    Paths over the conversion table may have several steps (ng to mg to g). Molar steps are taken for the concept's substance only.
    The further ``units`` are other names of the first.
    """
    substance = SUBSTANCES.get(concept or "")
    steps: dict[str, list[tuple[str, tuple[float, float, float, float]]]] = {}
    rows = [(line.split()[:2], line.split()[4], float(line.split()[2]), float(line.split()[3])) for line in _FORWARD.strip().splitlines()]
    rows = [(a, b, None if s == "-" else s, f, o) for (a, b), s, f, o in rows]
    both = [r for a, b, s, f, o in rows for r in ((a, b, s, (0.0, f, 1.0, o)), (b, a, s, (-o, 1.0, f, 0.0)))]
    own = {(a, b) for a, b, s, _ in both if s is not None and s == substance}
    for a, b, s, step in both:
        general = s is None and (a, b) not in own and _MOLAR.get(frozenset((a, b)), substance) == substance
        if general or (s is not None and s == substance):
            steps.setdefault(b, []).append((a, step))
    found = {normal_unit(units[0]): (0.0, 1.0, 1.0, 0.0)}
    todo = list(found)
    while todo:
        unit = todo.pop(0)
        before, factor, divisor, after = found[unit]
        for a, (b1, f1, d1, a1) in steps.get(unit, ()):
            if a not in found:
                found[a] = (b1, f1 * factor, d1 * divisor, (a1 + before) * factor / divisor + after)
                todo.append(a)
    spelled = {unit_key(name): rule for unit, rule in reversed(found.items()) for name in [*ALIASES.get(unit, ()), unit]}
    return {**spelled, **{unit_key(u): (0.0, 1.0, 1.0, 0.0) for u in units}}


def unit_graph(units: list[str], concept: str | None = None) -> dict[str, tuple[float, float]]:
    """The same as factor and offset."""
    return {key: (f / d, b * f / d + a) for key, (b, f, d, a) in unit_steps(units, concept).items()}


def convert_where(
    df: DataFrame, value: str, unit: str, change, new_unit: str, pattern: str | None = None, ignore_case: bool = True
) -> DataFrame:
    """Apply ``change`` to the value and set the unit where the unit matches."""
    hit = F.lit(True) if pattern is None else F.coalesce(
        F.col(unit).rlike(("(?i)" if ignore_case else "") + pattern), F.lit(False)
    )
    return df.withColumns({
        value: F.when(hit, change(F.col(value))).otherwise(F.col(value)),
        unit: F.when(hit, F.lit(new_unit)).otherwise(F.col(unit)),
    })


def celsius_to_fahrenheit(x): return convert(x, "celsius", "fahrenheit")
def fahrenheit_to_celsius(x): return convert(x, "fahrenheit", "celsius")
def glucose_mg_to_mmol(x): return convert(x, "mg/dl", "mmol/l")
def glucose_mmol_to_mg(x): return convert(x, "mmol/l", "mg/dl")
def creatinine_mg_to_umol(x): return convert(x, "mg/dl", "umol/l")
def creatinine_umol_to_mg(x): return convert(x, "umol/l", "mg/dl")
def lactate_mg_to_mmol(x): return convert(x, "mg/dl", "mmol/l", "lactate")
def lactate_mmol_to_mg(x): return convert(x, "mmol/l", "mg/dl", "lactate")
def mmhg_to_kpa(x): return convert(x, "mmhg", "kpa")
def kpa_to_mmhg(x): return convert(x, "kpa", "mmhg")


def vaso_rate(rate: str | Column, unit: str | Column, weight: str | Column) -> Column:
    """Infusion rate in ug/kg/min; null for a unit that cannot be converted."""
    r, w = as_column(rate), as_column(weight)
    u = F.regexp_replace(F.lower(as_column(unit)), r"[\s]", "")
    u = F.regexp_replace(F.regexp_replace(u, "^(mcg|μg|µg)", "ug"), "hr$", "h")
    return (
        F.when(u == "ug/kg/min", r)
        .when(u == "ug/min", F.try_divide(r, w))
        .when(u == "mg/h", F.try_divide(r * 1000.0, w * 60.0))
        .when(u == "mg/kg/h", r * (1000.0 / 60.0))
    )


def fio2_percent(x: str | Column) -> Column:
    """Inspired oxygen in percent; values up to 1 are fractions."""
    v = as_column(x)
    return F.when(v <= 1, v * 100).otherwise(v)
