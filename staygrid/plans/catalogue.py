"""The built-in concept catalogue: names, units, bounds and derivations.

Where a source keeps a concept (tables, items, rules) comes from a dictionary
file or is added in code; see ``staygrid.plans.spec``.
"""

from __future__ import annotations

from staygrid.plans.spec import Catalogue, Concept

# Category | name | class | unit | low | high | target | aggregate | derived by.
# Bounds are inclusive and apply after aggregation.
_ROWS = """
blood gas | be | num | mEq/L | -25 | 25 | - | - | -
blood gas | cai | num | mmol/L | 0.5 | 2 | - | - | -
blood gas | fio2 | num | % | 21 | 100 | - | - | -
blood gas | hbco | num | - | - | - | - | - | -
blood gas | lact | num | mmol/L | 0 | 50 | - | - | -
blood gas | methb | num | % | 0 | 100 | - | - | -
blood gas | pco2 | num | mmHg | 10 | 150 | - | - | -
blood gas | ph | num | - | 6.8 | 8 | - | - | -
blood gas | po2 | num | mmHg | 40 | 600 | - | - | -
blood gas | tco2 | num | mEq/L | 5 | 60 | - | - | -
cardiovascular | mech_circ_support | lgl | - | - | - | - | - | -
cardiovascular | other_vaso | lgl | - | - | - | - | - | -
chemistry | alb | num | g/dL | 0 | 6 | - | - | -
chemistry | alp | num | IU/L | 0 | - | - | - | -
chemistry | alt | num | IU/L | 0 | - | - | - | -
chemistry | ast | num | IU/L | 0 | - | - | - | -
chemistry | bicar | num | mEq/L | 5 | 50 | - | - | -
chemistry | bicarb | num | mEq/L | 5 | 50 | - | - | -
chemistry | bili | num | mg/dL | 0 | 100 | - | - | -
chemistry | bili_dir | num | mg/dL | 0 | 50 | - | - | -
chemistry | bun | num | mg/dL | 0 | 200 | - | - | -
chemistry | ca | num | mg/dL | 4 | 20 | - | - | -
chemistry | ck | num | IU/L | 0 | - | - | - | -
chemistry | ckmb | num | ng/mL | 0 | - | - | - | -
chemistry | cl | num | mEq/L | 80 | 130 | - | - | -
chemistry | crea | num | mg/dL | 0 | 15 | - | - | -
chemistry | crp | num | mg/L | 0 | - | - | - | -
chemistry | glu | num | mg/dL | 0 | 1000 | - | - | -
chemistry | k | num | mEq/L | 0 | 10 | - | - | -
chemistry | mg | num | mg/dL | 0.5 | 5 | - | - | -
chemistry | na | num | mEq/L | 110 | 165 | - | - | -
chemistry | phos | num | mg/dL | 0 | 40 | - | - | -
chemistry | potassium | num | mEq/L | 0 | 10 | - | - | -
chemistry | tnt | num | ng/mL | 0 | - | - | - | -
chemistry | tri | num | ng/mL | 0 | - | - | - | -
demographics | adm | fct | - | - | - | id_tbl | - | -
demographics | age | num | years | 0 | 100 | id_tbl | - | -
demographics | bmi | rec | - | - | - | id_tbl | - | bmi(weight, height)
demographics | height | num | cm | 10 | 230 | id_tbl | - | -
demographics | sex | fct | - | - | - | id_tbl | - | -
demographics | weight | num | kg | 1 | 500 | id_tbl | - | -
hematology | basos | num | % | 0 | 50 | - | - | -
hematology | bnd | num | % | - | - | - | - | -
hematology | eos | num | % | 0 | 50 | - | - | -
hematology | esr | num | mm/hr | 0 | 200 | - | - | -
hematology | fgn | num | mg/dL | 0 | 1500 | - | - | -
hematology | hba1c | num | % | - | - | - | - | -
hematology | hct | num | % | 15 | 60 | - | - | -
hematology | hgb | num | g/dL | 4 | 18 | - | - | -
hematology | inr_pt | num | - | - | - | - | - | -
hematology | lymph | num | % | 0 | 100 | - | - | -
hematology | mch | num | pg | 0 | - | - | - | -
hematology | mchc | num | % | 20 | 50 | - | - | -
hematology | mcv | num | fL | 50 | 150 | - | - | -
hematology | neut | num | % | 0 | 100 | - | - | -
hematology | plt | num | K/uL | 5 | 1200 | - | - | -
hematology | pt | num | sec | 0 | - | - | - | -
hematology | ptt | num | sec | 0 | - | - | - | -
hematology | rbc | num | m/uL | 0 | 20 | - | - | -
hematology | rdw | num | % | 0 | 100 | - | - | -
hematology | wbc | num | K/uL | 0 | - | - | - | -
medications | abx | lgl | - | - | - | - | max | -
medications | adh_rate | num | units/min | - | - | - | - | -
medications | cort | lgl | - | - | - | - | - | -
medications | dex | unt/num | ml/hr | 0 | - | win_tbl | - | -
medications | dobu60 | rec | - | - | - | - | - | vaso60(dobu_rate, dobu_dur)
medications | dobu_dur | num | - | - | - | - | max | -
medications | dobu_rate | num | mcg/kg/min | 0 | 50 | - | - | -
medications | dopa_dur | num | - | - | - | - | max | -
medications | dopa_rate | num | mcg/kg/min | 0 | 50 | - | - | -
medications | epi_dur | num | - | - | - | - | max | -
medications | epi_rate | num | mcg/kg/min | 0 | 1.5 | - | - | -
medications | ins | num | units/hr | 0 | - | - | - | -
medications | norepi_dur | num | - | - | - | - | max | -
medications | norepi_equiv | rec | - | - | - | - | - | norepi_equiv(epi_rate, norepi_rate, dopa_rate, adh_rate, phn_rate)
medications | norepi_rate | num | mcg/kg/min | 0 | 3 | - | max | -
medications | phn_rate | num | mcg/kg/min | - | - | - | - | -
medications | vaso_ind | rec | - | - | - | - | - | vaso_ind(dopa_dur, norepi_dur, dobu_dur, epi_dur)
microbiology | samp | lgl | - | - | - | - | - | -
neurological | avpu | rec | - | - | - | - | - | avpu(gcs)
neurological | egcs | num | - | 1 | 4 | - | - | -
neurological | gcs | rec | - | - | - | - | - | gcs(egcs, mgcs, vgcs, tgcs, ett_gcs)
neurological | mgcs | num | - | 1 | 6 | - | - | -
neurological | rass | num | - | -5 | 4 | - | - | -
neurological | tgcs | rec | - | 3 | 15 | - | - | sum_components(egcs, mgcs, vgcs)
neurological | vgcs | num | - | 1 | 5 | - | - | -
neurology | delirium_positive | lgl | - | - | - | - | - | -
neurology | delirium_tx | lgl | - | - | - | - | - | -
neurology | motor_response | num | score | 1 | 6 | - | - | -
neurology | sedated_gcs | num | score | 3 | 15 | - | - | -
outcome | death | lgl | - | - | - | - | - | -
outcome | dopa60 | rec | - | - | - | - | - | vaso60(dopa_rate, dopa_dur)
outcome | epi60 | rec | - | - | - | - | - | vaso60(epi_rate, epi_dur)
outcome | infection_icd | lgl | - | - | - | - | - | -
outcome | los_hosp | num | days | 0 | - | id_tbl | - | -
outcome | los_icu | num | days | 0 | - | id_tbl | - | -
outcome | mews | rec | - | - | - | - | - | mews_score(sbp, hr, resp, temp, avpu)
outcome | news | rec | - | - | - | - | - | news_score(resp, o2sat, supp_o2, temp, sbp, hr, avpu)
outcome | norepi60 | rec | - | - | - | - | - | vaso60(norepi_rate, norepi_dur)
outcome | qsofa | rec | - | - | - | - | - | qsofa_score(gcs, sbp, resp)
outcome | sep3 | rec | - | - | - | - | - | sep3(sofa, susp_inf)
outcome | sep3_sofa2 | rec | - | - | - | - | - | sep3_sofa2(sofa2, susp_inf)
outcome | sirs | rec | - | - | - | - | - | sirs_score(temp, hr, resp, pco2, wbc, bnd)
outcome | sofa | rec | - | - | - | - | - | sofa_score(sofa_resp, sofa_coag, sofa_liver, sofa_cardio, sofa_cns, sofa_renal)
outcome | sofa2 | rec | - | - | - | - | - | sofa2_score(sofa2_resp, sofa2_coag, sofa2_liver, sofa2_cardio, sofa2_cns, sofa2_renal)
outcome | sofa2_cardio | rec | - | - | - | - | - | sofa2_cardio(map, norepi60, epi60, dopa60, dobu60, other_vaso, mech_circ_support)
outcome | sofa2_cns | rec | - | - | - | - | - | sofa2_cns(gcs, delirium_tx, delirium_positive, motor_response)
outcome | sofa2_coag | rec | - | - | - | - | min | sofa2_coag(plt)
outcome | sofa2_liver | rec | - | - | - | - | max | sofa2_liver(bili)
outcome | sofa2_renal | rec | - | - | - | - | - | sofa2_renal(crea, rrt, uo_6h, uo_12h, uo_24h, potassium, ph, bicarb)
outcome | sofa2_resp | rec | - | - | - | - | - | sofa2_resp(pafi, spo2, fio2, adv_resp, ecmo, ecmo_indication)
outcome | sofa_cardio | rec | - | - | - | - | - | sofa_cardio(map, dopa60, norepi60, dobu60, epi60)
outcome | sofa_cns | rec | - | - | - | - | - | sofa_cns(gcs)
outcome | sofa_coag | rec | - | - | - | - | min | sofa_coag(plt)
outcome | sofa_liver | rec | - | - | - | - | max | sofa_liver(bili)
outcome | sofa_renal | rec | - | - | - | - | - | sofa_renal(crea, urine24)
outcome | sofa_resp | rec | - | - | - | - | - | sofa_resp(pafi, vent_ind)
outcome | susp_inf | rec | - | - | - | - | - | susp_inf(abx, samp, infection_icd)
output | uo_12h | rec | - | - | - | - | - | uo_12h(urine, weight)
output | uo_24h | rec | - | - | - | - | - | uo_24h(urine, weight)
output | uo_6h | rec | - | - | - | - | - | uo_6h(urine, weight)
output | urine | num | mL | 0 | 2000 | - | sum | -
output | urine24 | rec | - | - | - | - | - | urine24(urine)
renal | rrt | lgl | - | - | - | - | - | -
renal | rrt_criteria | lgl | - | - | - | id_tbl | - | rrt_criteria(crea, uo_6h, potassium, ph, bicarb)
respiratory | adv_resp | lgl | - | - | - | - | - | -
respiratory | ecmo | lgl | - | - | - | - | - | -
respiratory | ecmo_indication | chr | - | - | - | - | - | -
respiratory | ett_gcs | lgl | - | - | - | win_tbl | - | -
respiratory | mech_vent | fct | - | - | - | win_tbl | - | -
respiratory | o2sat | num | % | 50 | 100 | - | - | -
respiratory | pafi | rec | - | - | - | - | - | pafi(po2, fio2)
respiratory | resp | num | insp/min | 0 | 120 | - | - | -
respiratory | safi | rec | - | - | - | - | - | safi(o2sat, fio2)
respiratory | sao2 | num | % | 50 | 100 | - | - | -
respiratory | spo2 | num | % | 50 | 100 | - | - | -
respiratory | supp_o2 | rec | - | - | - | - | - | supp_o2(vent_ind, fio2)
respiratory | vent_end | lgl | - | - | - | - | - | -
respiratory | vent_ind | rec | - | - | - | win_tbl | - | vent_ind(vent_start, vent_end, mech_vent)
respiratory | vent_start | lgl | - | - | - | - | - | -
vitals | dbp | num | mmHg | 0 | 200 | - | - | -
vitals | etco2 | num | mmHg | 10 | 60 | - | - | -
vitals | hr | num | bpm | 0 | 300 | - | - | -
vitals | map | num | mmHg | 0 | 250 | - | - | -
vitals | sbp | num | mmHg | 0 | 300 | - | - | -
vitals | temp | num | C | 32 | 42 | - | - | -
"""


def _number(text: str) -> float | None:
    return None if text == "-" else float(text)


def _text(text: str) -> str | None:
    return None if text == "-" else text


def builtin() -> Catalogue:
    """All built-in concepts, without sources."""
    concepts = []
    for line in _ROWS.strip().splitlines():
        category, name, kind, unit, low, high, target, aggregate, derived = [x.strip() for x in line.split("|")]
        rule, parts = None, ()
        if derived != "-":
            rule, _, inner = derived.partition("(")
            parts = tuple(p.strip() for p in inner.rstrip(")").split(",") if p.strip())
        concepts.append(Concept(
            name, category=category, kind=kind, units=() if unit == "-" else (unit,), low=_number(low), high=_number(high),
            target=_text(target), aggregate=_text(aggregate), derived=rule, parts=parts,
        ))
    return Catalogue({c.name: c for c in concepts})
