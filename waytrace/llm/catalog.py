"""The registered queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

from waytrace.llm import language_model, merkle, mixing, packing, quality, secret_ledger, simhash, url_filters, warc, webp

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_packing": packing.op2_packing,
    "op3_webp": webp.op3_webp,
    "op4_mixing": mixing.op4_mixing,
    "op5_ppm": language_model.op5_ppm,
    "op6_merkle": merkle.op6_merkle,
    "op7_secret_scans": secret_ledger.op7_secret_scans,
    "op8_warc": warc.op8_warc,
    "op9_simhash": simhash.op9_simhash,
    "op10_quality": quality.op10_quality,
}
ORACLES = {
    "op1_url_filters": url_filters.ORACLE,
    "op7_secret_scans": secret_ledger.ORACLE,
    "op8_warc": warc.ORACLE,
}
