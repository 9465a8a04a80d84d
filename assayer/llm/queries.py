"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, hmm, infill, langid, licenses, mixing, periods, quality, repeats, secrets, simhash, toxicity


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.query,
        "op2_bpe": bpe.query,
        "op3_licenses": licenses.query,
        "op4_repeats": repeats.query,
        "op5_hmm": hmm.query,
        "op6_quality": quality.query,
        "op7_toxicity": toxicity.query,
        "op8_simhash": simhash.query,
        "op9_secrets": secrets.query,
        "op10_langid": langid.query,
        "op11_infill": infill.query,
        "op12_periods": periods.query,
        "op13_mixing": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.SQL, "op3_licenses": licenses.SQL, "op4_repeats": repeats.SQL, "op11_infill": infill.SQL}
