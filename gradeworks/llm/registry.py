"""The queries of this subpackage by name, with their SQL where SQL can express them."""

from gradeworks.catalog.base import Query
from gradeworks.llm import (
    bpe,
    context_mixing,
    decontamination,
    exact_dedup,
    language_id,
    line_dedup,
    nearest,
    periodic_runs,
    simhash,
    substring_dedup,
    token_counts,
    token_files,
    whitening,
)

QUERIES = [
    Query("op1_line_dedup", line_dedup.op1_line_dedup, line_dedup.OP1_SQL),
    Query("op2_decontamination", decontamination.op2_decontamination),
    Query("op3_token_files", token_files.op3_token_files),
    Query("op4_token_counts", token_counts.op4_token_counts),
    Query("op5_language_id", language_id.op5_language_id),
    Query("op6_bpe", bpe.op6_bpe),
    Query("op7_substring_dedup", substring_dedup.op7_substring_dedup),
    Query("op8_nearest", nearest.op8_nearest),
    Query("op9_simhash", simhash.op9_simhash),
    Query("op10_context_mixing", context_mixing.op10_context_mixing),
    Query("op11_whitening", whitening.op11_whitening),
    Query("op12_exact_dedup", exact_dedup.op12_exact_dedup, exact_dedup.OP12_SQL),
    Query("op13_periodic_runs", periodic_runs.op13_periodic_runs),
]
