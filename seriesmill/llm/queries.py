"""The training-data operators' registered queries and their DuckDB counterparts."""

from . import classifier, decontamination, jaccard_join, lm_scoring, mixing, quality_rules, substring_dedup, suffix_dedup, url_filter, warc

MODULES = (substring_dedup, suffix_dedup, mixing, classifier, lm_scoring, quality_rules, url_filter, jaccard_join, warc, decontamination)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
