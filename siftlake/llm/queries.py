"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from siftlake.llm import bitsliced, dedup_exact, langid, licenses, lm, mixing, packing, prefix_trie, repair, secrets, simhash, token_files, toxicity


def queries() -> dict:
    return {
        "op1_bitsliced_topk": bitsliced.op1_bitsliced_topk,
        "op2_gru_scores": lm.op2_gru_scores,
        "op3_token_files": token_files.op3_token_files,
        "op4_cross_parsing": langid.op4_cross_parsing,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_simhash_pigeonring": simhash.op6_simhash_pigeonring,
        "op7_exact_dedup": dedup_exact.op7_exact_dedup,
        "op8_best_two_fit": packing.op8_best_two_fit,
        "op9_pareto_mixing": mixing.op9_pareto_mixing,
        "op10_toxicity_cnn": toxicity.op10_toxicity_cnn,
        "op11_secret_spans": secrets.op11_secret_spans,
        "op12_structure_repair": repair.op12_structure_repair,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_bitsliced_topk": bitsliced.OP1_SQL,
        "op7_exact_dedup": dedup_exact.OP7_SQL,
        "op9_pareto_mixing": mixing.OP9_SQL,
        "op12_structure_repair": repair.OP12_SQL,
        "op13_prefix_trie": prefix_trie.OP13_SQL,
    }
