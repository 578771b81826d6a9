"""The query of each operator over its whole table, and their SQL twins."""

from __future__ import annotations

from splitlab.llm import (
    alignment, bpe, cross_polytope, decontaminate, html_text, line_labels, mixing, order_minhash, packing, phrases, pii, rans, toxicity,
)

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_toxicity": toxicity.query,
    "op3_html_text": html_text.query,
    "op4_cross_polytope": cross_polytope.query,
    "op5_byte_bpe": bpe.query,
    "op6_order_minhash": order_minhash.query,
    "op7_pii": pii.query,
    "op8_token_files": rans.query,
    "op9_best_fit_shards": packing.query,
    "op10_line_quality": line_labels.query,
    "op11_aligned_tokens": alignment.query,
    "op12_decontaminate": decontaminate.query,
    "op13_phrases": phrases.query,
}

ORACLES = {
    "op1_mix_sources": mixing.SQL,
    "op12_decontaminate": decontaminate.SQL,
    "op13_phrases": phrases.SQL,
}
