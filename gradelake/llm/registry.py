"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradelake.llm import (
    audit, centroids, embeddings, html, language, licenses, lm, mixing, packing, quality, simhash,
    tokens, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.op1,
    "op2_license_scans": licenses.op2,
    "op3_html_extraction": html.op3,
    "op4_language_id": language.op4,
    "op5_simhash_near_dedup": simhash.op5,
    "op6_mixing_sources": mixing.op6,
    "op7_embedding_near_dedup": embeddings.op7,
    "op8_token_counts": tokens.op8,
    "op9_lm_scoring": lm.op9,
    "op10_best_fit_packing": packing.op10,
    "op11_centroid_clustering": centroids.op11,
    "op12_warc": warc.op12,
    "op13_filter_audit": audit.op13,
}

ORACLES: dict[str, str] = {
    "op2_license_scans": licenses.oracle(),
    "op12_warc": warc.ORACLE,
    "op13_filter_audit": audit.ORACLE,
}
