"""The queries of the numbered operators, with DuckDB SQL where SQL can express one."""

from __future__ import annotations

from fieldaudit.llm import ann, bpe, fill_middle, html_extract, near_dup, packing, periodic_runs, quality_classifier, quality_rules, secret_scan, substring_dedup, url_filter, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_html_extraction": html_extract.query,
    "op3_url_filter": url_filter.query,
    "op4_best_fit_packing": packing.query,
    "op5_warc_revisits": warc.query,
    "op6_nearest_neighbours": ann.query,
    "op7_ngram_jaccard_join": near_dup.query,
    "op8_quality_rules": quality_rules.query,
    "op9_bpe_roundtrip": bpe.query,
    "op10_quality_classifier": quality_classifier.query,
    "op11_secret_scan": secret_scan.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_fill_in_middle": fill_middle.query,
}

ORACLE_SQL = {
    "op5_warc_revisits": warc.SQL,
    "op7_ngram_jaccard_join": near_dup.SQL,
    "op8_quality_rules": quality_rules.SQL,
    "op13_fill_in_middle": fill_middle.SQL,
}
