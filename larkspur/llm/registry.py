"""All queries of the subpackage and their SQL."""

from larkspur.llm import exact_dedup, jaccard_join, line_dedup, mixing, packing, quality_rules, substring_dedup, suffix_dedup, token_files, toxicity

MODULES = (quality_rules, line_dedup, mixing, exact_dedup, packing, token_files, toxicity, substring_dedup, suffix_dedup, jaccard_join)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
