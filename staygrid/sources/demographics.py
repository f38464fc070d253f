"""Demographics of each source in one shape: patient_id, age, gender, los_hours,
survived, first_icu_stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from staygrid.functions.scalars import apply_map
from staygrid.sources.tables import TableReader

COLUMNS = ["patient_id", "age", "gender", "los_hours", "survived", "first_icu_stay"]

# Middle of each age group, and sex labels.
AGE_GROUPS = {"18-39": 28.5, "40-49": 44.5, "50-59": 54.5, "60-69": 64.5, "70-79": 74.5, "80+": 85.0}
SEX = {"Man": "M", "Vrouw": "F", "Male": "M", "Female": "F", "M": "M", "F": "F"}


def _initial(c: str) -> Column:
    return F.upper(F.substring(c, 1, 1))


def _years(birth: str, at: str) -> Column:
    return F.floor(F.timestamp_diff("SECOND", F.col(birth), F.col(at)) / 86_400) / 365.25


def _hours(start: str, end: str) -> Column:
    return F.timestamp_diff("SECOND", F.col(start), F.col(end)) / 3_600


def first_stays(stays: DataFrame, patient: str, stay: str, intime: str) -> DataFrame:
    """The earliest stay of each patient; no per-patient sort."""
    return stays.groupBy(patient).agg(F.min_by(stay, F.struct(intime, stay)).alias("_first_stay"))


def _mimic(read: TableReader, stay: str, cap_age: bool) -> DataFrame:
    stays, patients, admissions = read("icustays"), read("patients"), read("admissions")
    df = stays.join(patients, "subject_id", "left").join(admissions, ["subject_id", "hadm_id"], "left")
    df = df.join(first_stays(stays, "subject_id", stay, "intime"), "subject_id", "left")
    if "anchor_age" in df.columns:
        age = F.col("anchor_age").cast("double")
        if "anchor_year" in df.columns:
            age = age + (F.year("intime") - F.col("anchor_year"))
    else:
        age = _years("dob", "intime")
    if cap_age:
        age = F.least(age, F.lit(90.0))
    los = F.col("los") * 24 if "los" in df.columns else _hours("intime", "outtime")
    alive = F.col("hospital_expire_flag") == 0 if "hospital_expire_flag" in df.columns else F.col("deathtime").isNull()
    return df.select(
        F.col(stay).alias("patient_id"), age.alias("age"), _initial("gender").alias("gender"),
        los.cast("double").alias("los_hours"), alive.alias("survived"), (F.col(stay) == F.col("_first_stay")).alias("first_icu_stay"),
    )


def miiv(read: TableReader) -> DataFrame:
    return _mimic(read, "stay_id", cap_age=False)


def mimic3(read: TableReader) -> DataFrame:
    return _mimic(read, "icustay_id", cap_age=True)


def eicu(read: TableReader) -> DataFrame:
    df = read("patient")
    age = F.regexp_replace(F.regexp_replace(F.col("age").cast("string"), "> ", ""), ">89", "90").try_cast("double")
    status = "hospitaldischargestatus" if "hospitaldischargestatus" in df.columns else "unitdischargestatus"
    return df.select(
        F.col("patientunitstayid").alias("patient_id"), age.alias("age"), _initial("gender").alias("gender"),
        (F.col("unitdischargeoffset") / 60).alias("los_hours"),
        F.coalesce(F.lower(status) != "expired", F.lit(True)).alias("survived"),
        (F.col("unitvisitnumber") == 1).alias("first_icu_stay"),
    )


def aumc(read: TableReader) -> DataFrame:
    df = read("admissions")
    df = df.join(first_stays(df, "patientid", "admissionid", "admittedat"), "patientid", "left")
    died = F.coalesce(F.lower("destination").rlike("died|death|deceased"), F.lit(False))
    return df.select(
        F.col("admissionid").alias("patient_id"), apply_map("agegroup", AGE_GROUPS).alias("age"),
        F.coalesce(apply_map("gender", SEX), _initial("gender")).alias("gender"),
        ((F.col("dischargedat") - F.col("admittedat")) / 3_600_000).alias("los_hours"),
        (~died).alias("survived"), (F.col("admissionid") == F.col("_first_stay")).alias("first_icu_stay"),
    )


def hirid(read: TableReader) -> DataFrame:
    df = read("general_table")
    los = _hours("admissiontime", "dischargetime") if "dischargetime" in df.columns else F.lit(None).cast("double")
    alive = F.lower("discharge_status") == "alive" if "discharge_status" in df.columns else F.lit(None).cast("boolean")
    return df.select(
        F.col("patientid").alias("patient_id"), F.col("age").cast("double").alias("age"), apply_map("sex", SEX).alias("gender"),
        los.alias("los_hours"), alive.alias("survived"), F.lit(True).alias("first_icu_stay"),
    )


def sic(read: TableReader) -> DataFrame:
    df = read("cases")
    sex = F.coalesce(apply_map(F.col("Sex").cast("string"), {"0": "F", "1": "M", **SEX}))
    return df.select(
        F.col("CaseID").alias("patient_id"), F.col("Age").cast("double").alias("age"), sex.alias("gender"),
        (F.col("TimeOfStay") / 60).alias("los_hours"), F.col("OffsetOfDeath").isNull().alias("survived"),
        F.lit(True).alias("first_icu_stay"),
    )


LOADERS = {"miiv": miiv, "mimic": miiv, "mimic3": mimic3, "eicu": eicu, "aumc": aumc, "hirid": hirid, "sic": sic}


def demographics(source: str, read: TableReader) -> DataFrame:
    return LOADERS[source](read).select(*COLUMNS)
