"""Queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from lodestrand.llm import byte_bpe, exact_dedup, hard_negatives, language, mpeg_audio, near_dedup, packing, parity_join, personal, secrets, substring_dedup, token_counts, whitening


def queries() -> dict:
    return {
        "op1_mpeg_audio": mpeg_audio.op1_mpeg_audio,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_byte_bpe": byte_bpe.op3_byte_bpe,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_personal_data": personal.op6_personal_data,
        "op7_language_id": language.op7_language_id,
        "op8_secret_scan": secrets.op8_secret_scan,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "op11_embedding_whitening": whitening.op11_embedding_whitening,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_ngram_jaccard_join": parity_join.op13_ngram_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.OP4_SQL}
