"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from spanwright.llm import best_fit, chroma, fingerprints, html_text, ngram_join, packing, pieces, prefix_trie, secrets, suffix_dedup, toxicity, url_filter, whitening

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_packing": packing.op2_packing,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_pieces": pieces.op4_pieces,
    "op5_html_text": html_text.op5_html_text,
    "op6_chroma": chroma.op6_chroma,
    "op7_secrets": secrets.op7_secrets,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_best_fit": best_fit.op11_best_fit,
    "op12_whitening": whitening.op12_whitening,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLES = {"op10_url_filter": url_filter.OP10_SQL, "op13_prefix_trie": prefix_trie.OP13_SQL}
