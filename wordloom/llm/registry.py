"""The queries of the llm operators, and SQL for those that SQL can express."""

from . import chaining, decontam, licenses, lines, minhash, packing, quality, sharding, suffix, tokens

QUERIES = {
    "op1_collinear_chains": chaining.op1,
    "op2_min_slack_packing": packing.op2,
    "op3_quality_rules": quality.op3,
    "op4_minhash_near_dedup": minhash.op4,
    "op5_induced_suffixes": suffix.op5,
    "op6_simhash_decontamination": decontam.op6,
    "op7_jump_sharding": sharding.op7,
    "op8_best_fit_matrices": tokens.op8,
    "op9_fuzzy_lines": lines.op9,
    "op10_license_digests": licenses.op10,
}

ORACLE_SQL: dict[str, str] = {
    "op4_minhash_near_dedup": minhash.SQL,
    "op6_simhash_decontamination": decontam.SQL,
    "op10_license_digests": licenses.SQL,
}
