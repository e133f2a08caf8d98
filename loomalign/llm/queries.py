"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import cross_polytope, embedding_dedup, html_text, mixing, ngram_join, packing, periodic_runs, quality_knn, quality_rules, substring_dedup, toxicity, url_rules, whitening


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1,
        "op2_html_text": html_text.op2,
        "op3_substring_dedup": substring_dedup.op3,
        "op4_packing": packing.op4,
        "op5_toxicity": toxicity.op5,
        "op6_mixing": mixing.op6,
        "op7_quality_knn": quality_knn.op7,
        "op8_ngram_join": ngram_join.op8,
        "op9_embedding_dedup": embedding_dedup.op9,
        "op10_url_rules": url_rules.op10,
        "op11_cross_polytope": cross_polytope.op11,
        "op12_whitening": whitening.op12,
        "op13_periodic_runs": periodic_runs.op13,
    }


def oracle_sql() -> dict:
    return {
        "op3_substring_dedup": substring_dedup.SQL,
        "op6_mixing": mixing.SQL,
        "op8_ngram_join": ngram_join.SQL,
        "op9_embedding_dedup": embedding_dedup.SQL,
        "op10_url_rules": url_rules.SQL,
    }
