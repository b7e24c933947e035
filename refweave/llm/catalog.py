"""Queries of the training-data operators, by name, and their DuckDB equivalents."""

from refweave.llm import decontamination, license_scan, lm_scoring, mixing, ngram_join, pii, quality_classifier, quality_rules, toxicity, warc

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_pii": pii.op7_pii,
    "op8_warc": warc.op8_warc,
    "op9_mixing": mixing.op9_mixing,
    "op10_ngram_join": ngram_join.op10_ngram_join,
}
ORACLES = {
    "op1_license_scan": license_scan.ORACLE,
    "op2_quality_rules": quality_rules.ORACLE,
    "op5_decontamination": decontamination.ORACLE,
    "op8_warc": warc.ORACLE,
    "op10_ngram_join": ngram_join.ORACLE,
}
