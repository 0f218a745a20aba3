"""The ``opN_*`` queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

from . import ann, bpe, chat, decontamination, lexical, links, minhash, mixing, pii, quality, tokens, toxicity, whitening

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_pii": pii.op2_pii,
    "op3_minhash": minhash.op3_minhash,
    "op4_mixing": mixing.op4_mixing,
    "op5_url_filters": links.op5_url_filters,
    "op6_nearest_neighbours": ann.op6_nearest_neighbours,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_token_counts": tokens.op10_token_counts,
    "op11_decontamination": decontamination.op11_decontamination,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_lexical_search": lexical.op13_lexical_search,
}

ORACLES = {
    "op1_chat_formatting": chat.oracle(),
    "op5_url_filters": links.oracle(),
    "op9_quality_rules": quality.oracle(),
    "op11_decontamination": decontamination.oracle(),
    "op13_lexical_search": lexical.oracle(),
}
