"""The queries of this subpackage and their DuckDB counterparts, by name."""

from __future__ import annotations

from . import (
    byte_bpe,
    exact_dedup,
    license_scan,
    near_dedup,
    packing,
    quality_classifier,
    quality_rules,
    toxicity,
    url_filter,
    warc,
)

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_quality_rules": quality_rules.op2,
    "op3_url_filter": url_filter.op3,
    "op4_near_dedup": near_dedup.op4,
    "op5_exact_dedup": exact_dedup.op5,
    "op6_byte_bpe": byte_bpe.op6,
    "op7_warc": warc.op7,
    "op8_license_scan": license_scan.op8,
    "op9_quality_classifier": quality_classifier.op9,
    "op10_packing": packing.op10,
}

ORACLE_SQL = {
    "op5_exact_dedup": exact_dedup.SQL,
    "op7_warc": warc.SQL,
}
