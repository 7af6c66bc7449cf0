"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lumigraph.llm import decontaminate, embed_dedup, line_dedup, mixing, ngram_join, pii, piece_codec, quality, secrets, spelling, token_align, toxicity, url_filter

MODULES = {
    "op1_ngram_join": ngram_join,
    "op2_embedding_dedup": embed_dedup,
    "op3_secret_scan": secrets,
    "op4_toxicity": toxicity,
    "op5_line_dedup": line_dedup,
    "op6_pii": pii,
    "op7_url_filter": url_filter,
    "op8_decontamination": decontaminate,
    "op9_mixing": mixing,
    "op10_quality": quality,
    "op11_piece_codec": piece_codec,
    "op12_spelling_variants": spelling,
    "op13_token_align": token_align,
}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict:
    return {name: module.SQL for name, module in MODULES.items() if module.SQL}
