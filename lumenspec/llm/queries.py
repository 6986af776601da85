"""The queries of this subpackage and the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from . import ann, chat, divergence, jaccard, language, merkle, mixing, packing, repetition, sharding, tokens, topk, toxicity

QUERIES: dict[str, Callable] = {
    f.__name__: f
    for f in (
        mixing.op1_mixing,
        topk.op2_top_k,
        tokens.op3_token_output,
        language.op4_language_id,
        sharding.op5_sharding,
        jaccard.op6_ngram_jaccard,
        packing.op7_packing,
        chat.op8_chat_perspectives,
        toxicity.op9_toxicity,
        ann.op10_ann_graph,
        merkle.op11_merkle_manifest,
        divergence.op12_source_divergence,
        repetition.op13_quality_repetition,
    )
}

ORACLES: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op2_top_k": topk.ORACLE,
    "op6_ngram_jaccard": jaccard.ORACLE,
    "op8_chat_perspectives": chat.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
    "op13_quality_repetition": repetition.ORACLE,
}
