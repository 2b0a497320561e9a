"""Queries and DuckDB twins of this subpackage."""

from __future__ import annotations

from pairlight.llm import bpe, chat, cobucket, decontaminate, html_text, near_dedup, packing, repair, sharding, simhash, substrings, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_substring_dedup": substrings.query,
    "op3_warc": warc.query,
    "op4_benchmark_decontamination": decontaminate.query,
    "op5_chat_formatting": chat.query,
    "op6_document_fingerprints": simhash.query,
    "op7_sharding": sharding.query,
    "op8_bpe_encoding": bpe.query,
    "op9_minhash_near_dedup": near_dedup.query,
    "op10_html_extraction": html_text.query,
    "op11_packing": packing.query,
    "op12_conversation_repair": repair.query,
    "op13_cobucketed_pair": cobucket.query,
}

ORACLES = {
    "op2_substring_dedup": substrings.ORACLE,
    "op3_warc": warc.ORACLE,
    "op4_benchmark_decontamination": decontaminate.ORACLE,
    "op5_chat_formatting": chat.ORACLE,
    "op9_minhash_near_dedup": near_dedup.ORACLE,
    "op12_conversation_repair": repair.ORACLE,
}
