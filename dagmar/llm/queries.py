"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from dagmar.llm import best_fit, content_sort, exact_topk, language_id, license_scan, merkle, ngram_lm, pareto_mix, separator_scan, simhash

QUERIES = {
    "op1_separator_scan": separator_scan.op1,
    "op2_merkle_fixity": merkle.op2,
    "op3_pareto_mix": pareto_mix.op3,
    "op4_content_sort": content_sort.op4,
    "op5_best_fit": best_fit.op5,
    "op6_language_id": language_id.op6,
    "op7_simhash": simhash.op7,
    "op8_license_scan": license_scan.op8,
    "op9_exact_topk": exact_topk.op9,
    "op10_ngram_lm": ngram_lm.op10,
}

ORACLES = {
    "op2_merkle_fixity": merkle.OP2_SQL,
    "op3_pareto_mix": pareto_mix.OP3_SQL,
    "op4_content_sort": content_sort.OP4_SQL,
    "op9_exact_topk": exact_topk.OP9_SQL,
}
