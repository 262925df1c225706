"""Queries of this subpackage by name, and their DuckDB statements where SQL expresses them."""

from __future__ import annotations

from . import (
    bpe,
    decontaminate,
    fingerprints,
    html_text,
    jaccard_join,
    langid,
    packing,
    periodic_runs,
    quality,
    secrets,
    token_counts,
    toxicity,
    vector_codes,
)

QUERIES = {
    "op1_secret_scans": secrets.query,
    "op2_html_extraction": html_text.query,
    "op3_quality": quality.query,
    "op4_fingerprints": fingerprints.query,
    "op5_language_id": langid.query,
    "op6_toxicity": toxicity.query,
    "op7_jaccard_join": jaccard_join.query,
    "op8_packing": packing.query,
    "op9_token_counts": token_counts.query,
    "op10_decontamination": decontaminate.query,
    "op11_vector_codes": vector_codes.query,
    "op12_bpe": bpe.query,
    "op13_periodic_runs": periodic_runs.query,
}

ORACLES: dict[str, str] = {
    "op2_html_extraction": html_text.ORACLE,
}
