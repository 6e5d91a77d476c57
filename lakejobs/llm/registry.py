"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from lakejobs.llm import decontaminate, hmm, htmltext, minmax, neighbours, periodic, pieces, quality, secrets, simhash, substrings, tokencount, whitening

QUERIES = {
    "op1_token_counts": tokencount.query,
    "op2_quality": quality.query,
    "op3_hmm_scoring": hmm.query,
    "op4_simhash": simhash.query,
    "op5_secret_scans": secrets.query,
    "op6_decontamination": decontaminate.query,
    "op7_suffix_dedup": substrings.query,
    "op8_sentencepiece": pieces.query,
    "op9_html_extraction": htmltext.query,
    "op10_nearest_neighbours": neighbours.query,
    "op11_periodic_runs": periodic.query,
    "op12_minmax_hash": minmax.query,
    "op13_whitening": whitening.query,
}
ORACLES = {
    "op5_secret_scans": secrets.ORACLE_SQL,
    "op6_decontamination": decontaminate.ORACLE_SQL,
}
