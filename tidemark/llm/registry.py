"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from . import chat, chunks, decontaminate, hmm, infill, mixing, neighbours, ngram_join, pieces, quality, secrets, tokencount, whitening

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_quality": quality.op2_quality,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_embedding_near_dedup": neighbours.op4_embedding_near_dedup,
    "op5_token_counts": tokencount.op5_token_counts,
    "op6_ngram_jaccard": ngram_join.op6_ngram_jaccard,
    "op7_chat_format": chat.op7_chat_format,
    "op8_mixing": mixing.op8_mixing,
    "op9_fingerprints": chunks.op9_fingerprints,
    "op10_lm_scores": hmm.op10_lm_scores,
    "op11_whitening": whitening.op11_whitening,
    "op12_decontamination": decontaminate.op12_decontamination,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}

ORACLES = {
    "op1_secret_scan": secrets.OP1_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op12_decontamination": decontaminate.OP12_SQL,
    "op13_fill_in_middle": infill.OP13_SQL,
}
