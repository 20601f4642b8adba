"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import best_fit, binary_ids, bpe, conversations, katz, language_id, manifest, merkle, ngram_join, packing, pii, token_counts, topk


def queries() -> dict:
    """By name, functions of a session and a folder of tables."""
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_merkle": merkle.op2_merkle,
        "op3_packing": packing.op3_packing,
        "op4_pii": pii.op4_pii,
        "op5_byte_bpe": bpe.op5_byte_bpe,
        "op6_ngram_join": ngram_join.op6_ngram_join,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_katz": katz.op8_katz,
        "op9_top_k": topk.op9_top_k,
        "op10_binary_ids": binary_ids.op10_binary_ids,
        "op11_best_fit": best_fit.op11_best_fit,
        "op12_manifest": manifest.op12_manifest,
        "op13_repair": conversations.op13_repair,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that DuckDB can express."""
    return {"op9_top_k": topk.OP9_SQL, "op12_manifest": manifest.OP12_SQL, "op13_repair": conversations.OP13_SQL}
