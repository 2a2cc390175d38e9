"""The registered queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from clipflow.llm import bpe, decontaminate, filter_audit, license_scans, packing, periodic_runs, quality_classifier, quality_rules, secret_scans, sharding, simhash, url_filters, warc

QUERIES = {
    "op1_vector_packing": sharding.query,
    "op2_quality_rules": quality_rules.query,
    "op3_secret_scans": secret_scans.query,
    "op4_bpe": bpe.query,
    "op5_benchmark_decontamination": decontaminate.query,
    "op6_simhash_near_dedup": simhash.query,
    "op7_license_scans": license_scans.query,
    "op8_url_filters": url_filters.query,
    "op9_warc": warc.query,
    "op10_quality_classifier": quality_classifier.query,
    "op11_filter_audit": filter_audit.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_best_fit_packing": packing.query,
}

ORACLES: dict[str, str] = {"op5_benchmark_decontamination": decontaminate.ORACLE, "op11_filter_audit": filter_audit.ORACLE}
