"""The operators' queries, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import ann, bpe, clustering, html_extract, lm, negatives, ngram_join, packing, pii, quality, repeats, token_output, url_filter

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.query,
    "op2_html_extraction": html_extract.query,
    "op3_nearest_neighbours": ann.query,
    "op4_best_fit_packing": packing.query,
    "op5_quality_rules": quality.query,
    "op6_url_filters": url_filter.query,
    "op7_pii": pii.query,
    "op8_token_output": token_output.query,
    "op9_lm_scoring": lm.query,
    "op10_byte_bpe": bpe.query,
    "op11_centroid_clustering": clustering.query,
    "op12_hard_negatives": negatives.query,
    "op13_suffix_array_dedup": repeats.query,
}
SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.SQL,
    "op6_url_filters": url_filter.SQL,
    "op11_centroid_clustering": clustering.SQL,
    "op12_hard_negatives": negatives.SQL,
    "op13_suffix_array_dedup": repeats.SQL,
}
