"""Queries and SQL of this subpackage, by the names under which they are registered."""

from __future__ import annotations

from . import byte_bpe, decontaminate, divergence, exact_dedup, html_text, licenses, ngram_jaccard, packing, quality, secrets, suffix_dedup, vector_codes, warc

QUERIES = {
    "op1_byte_bpe": byte_bpe.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_licenses": licenses.query,
    "op4_quality": quality.query,
    "op5_ngram_jaccard": ngram_jaccard.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_warc": warc.query,
    "op8_decontaminate": decontaminate.query,
    "op9_html_text": html_text.query,
    "op10_secrets": secrets.query,
    "op11_packing": packing.query,
    "op12_vector_codes": vector_codes.query,
    "op13_divergence": divergence.query,
}

ORACLE_SQL = {
    "op3_licenses": licenses.ORACLE,
    "op5_ngram_jaccard": ngram_jaccard.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op7_warc": warc.ORACLE,
    "op10_secrets": secrets.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
