"""The registered corpus queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewash.llm import decontaminate, epsilon_grid, licenses, line_dedup, main_text, packing, quality, runs, sharding, simhash, token_files, top_k, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_token_files": token_files.op3_token_files,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_sharding": sharding.op5_sharding,
    "op6_exact_top_k": top_k.op6_exact_top_k,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_html_extraction": main_text.op9_html_extraction,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op11_embedding_near_dedup": epsilon_grid.op11_embedding_near_dedup,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

#: The others are checked against brute force in tests/llm: their results hang on tokenizers, hashes or trained weights.
ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op6_exact_top_k": top_k.ORACLE,
    "op8_benchmark_decontamination": decontaminate.ORACLE,
    "op11_embedding_near_dedup": epsilon_grid.ORACLE,
}
