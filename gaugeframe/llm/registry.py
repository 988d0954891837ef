"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from . import clustering, decontaminate, divergence, licenses, line_dedup, neighbours, ngram_join, packing, quality, secret_scan, token_tree, toxicity, url_filter

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.query,
    "op2_template_decontamination": decontaminate.query,
    "op3_ordinal_quality": quality.query,
    "op4_multi_index_hashing": neighbours.query,
    "op5_kneser_ney_toxicity": toxicity.query,
    "op6_edit_aware_token_counts": token_tree.query,
    "op7_bloom_cascade_url_filter": url_filter.query,
    "op8_linear_grouping_packing": packing.query,
    "op9_randomness_secret_scan": secret_scan.query,
    "op10_site_spread_line_dedup": line_dedup.query,
    "op11_license_signatures": licenses.query,
    "op12_source_divergence_audit": divergence.query,
    "op13_hamerly_clustering": clustering.query,
}

ORACLE_SQL = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE_SQL,
    "op7_bloom_cascade_url_filter": url_filter.ORACLE_SQL,
    "op10_site_spread_line_dedup": line_dedup.ORACLE_SQL,
    "op12_source_divergence_audit": divergence.ORACLE_SQL,
    "op13_hamerly_clustering": clustering.ORACLE_SQL,
}
