"""One query for each operator, and DuckDB SQL where it can express the result."""

from __future__ import annotations

from lumigrid.llm import bpe, chat, decontaminate, fingerprints, langid, license_scan, manifest, sharding, simhash, toxicity, url_filter, vector_codes, warc

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_simhash": simhash.op2_simhash,
    "op3_warc": warc.op3_warc,
    "op4_bpe": bpe.op4_bpe,
    "op5_shards": sharding.op5_shards,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_licenses": license_scan.op8_licenses,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_language": langid.op10_language,
    "op11_chat": chat.op11_chat,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_manifest": manifest.op13_manifest,
}
ORACLES = {
    "op8_licenses": license_scan.ORACLE_SQL,
    "op9_url_filter": url_filter.ORACLE_SQL,
    "op11_chat": chat.ORACLE_SQL,
    "op12_vector_codes": vector_codes.ORACLE_SQL,
    "op13_manifest": manifest.ORACLE_SQL,
}
