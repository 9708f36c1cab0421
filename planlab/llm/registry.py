"""Registered queries of this package: name -> (callable(spark, directory), checking SQL or None)."""

from __future__ import annotations

import corpus_pipeline
from planlab.llm import audit, chats, language, leaks, licences, mixing, near, phrases, quality, rules, substrings, tongues, urls

QUERIES = {
    "op1_url_filters": (urls.op1_url_filters, urls.OP1_SQL),
    "op2_preferences": (chats.op2_preferences, None),
    "op3_substring_dedup": (substrings.op3_substring_dedup, None),
    "op4_decontamination": (leaks.op4_decontamination, None),
    "op5_language_scores": (language.op5_language_scores, None),
    "op6_licence_scan": (licences.op6_licence_scan, None),
    "op7_quality_classifier": (quality.op7_quality_classifier, None),
    "op8_near_duplicates": (near.op8_near_duplicates, None),
    "op9_mixing": (mixing.op9_mixing, None),
    "op10_quality_rules": (rules.op10_quality_rules, rules.OP10_SQL),
    "op11_filter_audit": (audit.op11_filter_audit, audit.OP11_SQL),
    "op12_language_id": (tongues.op12_language_id, None),
    "op13_collocations": (phrases.op13_collocations, phrases.OP13_SQL),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
