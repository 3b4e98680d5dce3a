"""The registered query of each training-data operator, and SQL where it can express one."""

from __future__ import annotations

from . import fingerprints, jaccard_join, lm_scoring, media, merkle, mixing, packing, periodic_runs, suffix_dedup, token_counts, token_files, toxicity, warc


def queries() -> dict:
    return {"op6_media_columns": media.query, "op9_source_mixing": mixing.query, "op10_token_files": token_files.query, "op7_best_fit_packing": packing.query, "op5_ppm_scoring": lm_scoring.query, "op8_jaccard_join": jaccard_join.query, "op1_suffix_dedup": suffix_dedup.query, "op2_toxicity": toxicity.query, "op3_fingerprints": fingerprints.query, "op4_warc_index": warc.query, "op11_periodic_runs": periodic_runs.query, "op12_merkle_manifest": merkle.query, "op13_token_counts": token_counts.query}


def oracle_sql() -> dict:
    return {"op9_source_mixing": mixing.SQL, "op4_warc_index": warc.SQL, "op8_jaccard_join": jaccard_join.SQL, "op11_periodic_runs": periodic_runs.SQL, "op12_merkle_manifest": merkle.SQL}
