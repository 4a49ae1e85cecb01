"""The queries and SQL of this subpackage, by the names the entry file registers."""

from __future__ import annotations

from . import bpe, cohorts, decontaminate, exact, lines, lm, minhash, pii, quality, secrets, spelling, substrings, urlfilter

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_suffix_array_dedup": substrings.op2_suffix_array_dedup,
    "op3_minhash_near_dedup": minhash.op3_minhash_near_dedup,
    "op4_pii": pii.op4_pii,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_brown_class_lm": lm.op7_brown_class_lm,
    "op8_quality_importance_resampling": quality.op8_quality_importance_resampling,
    "op9_exact_dedup": exact.op9_exact_dedup,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    "op11_cohort_retention": cohorts.op11_cohort_retention,
    "op12_url_filter": urlfilter.op12_url_filter,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": lines.OP1_SQL,
    "op9_exact_dedup": exact.OP9_SQL,
    "op11_cohort_retention": cohorts.OP11_SQL,
    "op13_spelling_variants": spelling.OP13_SQL,
}
