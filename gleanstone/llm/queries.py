"""All queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from gleanstone.llm import corpus_queries, label_queries, leak_queries, pair_queries, text_queries, time_queries

QUERIES = {
    "p2_found": label_queries.p2_found,
    "p2_raters": label_queries.p2_raters,
    "p2_agreement": label_queries.p2_agreement,
    "p3_found": pair_queries.p3_found,
    "p3_defects": pair_queries.p3_defects,
    "p4_found": time_queries.p4_found,
    "p5_found": time_queries.p5_found,
    "p6_found": text_queries.p6_found,
    "p7_found": leak_queries.p7_found,
    "p8_mixes": corpus_queries.p8_mixes,
    "p8_selection": corpus_queries.p8_selection,
    "p8_checked": corpus_queries.p8_checked,
    "p9_found": corpus_queries.p9_found,
    "p9_statistics": corpus_queries.p9_statistics,
}
SQL = {
    "p2_agreement": label_queries.AGREEMENT_SQL,
    "p4_found": time_queries.P4_SQL,
    "p5_found": time_queries.P5_SQL,
    "p8_checked": corpus_queries.CHECKED_SQL,
}
