"""Named groups of concepts."""

from __future__ import annotations

# Concepts per module, and the kinds that need their own handling.
MODULES = {
    "demo": ["age", "bmi", "height", "sex", "weight"],
    "outcome": ["death", "los_icu", "qsofa", "sirs", "sofa", "sofa_cardio", "sofa_cns", "sofa_coag", "sofa_liver",
                "sofa_renal", "sofa_resp"],
    "vital": ["dbp", "etco2", "hr", "map", "sbp", "temp"],
    "neu": ["avpu", "egcs", "gcs", "mgcs", "rass", "vgcs"],
    "output": ["urine", "urine24"],
    "resp": ["ett_gcs", "mech_vent", "o2sat", "sao2", "pafi", "resp", "safi", "supp_o2", "vent_ind"],
    "lab": ["alb", "alp", "alt", "ast", "bicar", "bili", "bili_dir", "bun", "ca", "ck", "ckmb", "cl", "crea", "crp",
            "glu", "k", "mg", "na", "phos", "tnt"],
    "blood": ["be", "cai", "fio2", "hbco", "lact", "methb", "pco2", "ph", "po2", "tco2"],
    "hematology": ["bnd", "esr", "fgn", "hgb", "inr_pt", "lymph", "mch", "mchc", "mcv", "neut", "plt", "ptt", "wbc"],
    "med": ["abx", "adh_rate", "cort", "dex", "dobu_dur", "dobu_rate", "dobu60", "epi_dur", "epi_rate", "ins",
            "norepi_dur", "norepi_equiv", "norepi_rate", "vaso_ind"],
}
VITALS = ["hr", "sbp", "dbp", "resp", "temp", "spo2"]
LABS = ["wbc", "hgb", "plt", "crea", "bili", "lact"]
STATIC = {"age", "sex", "bmi", "height", "weight", "los_icu", "los_hosp", "adm"}


def module_concepts(module: str) -> list[str]:
    return list(MODULES.get(module, []))


def find_module(concept: str) -> str | None:
    return next((m for m, names in MODULES.items() if concept in names), None)
