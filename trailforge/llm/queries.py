"""Registered queries of the corpus operators: thin digests over whole tables."""

from __future__ import annotations

from . import byte_bpe, chat, line_dedup, multiset_hash, packing, pii, secrets, simhash, topk, toxicity

QUERIES: dict = {
    "op1_chat_format": chat.query,
    "op2_packing": packing.query,
    "op3_simhash_dedup": simhash.query,
    "op4_byte_bpe": byte_bpe.query,
    "op5_secret_scan": secrets.query,
    "op6_pii": pii.query,
    "op7_multiset_hash": multiset_hash.query,
    "op8_line_dedup": line_dedup.query,
    "op9_exact_topk": topk.query,
    "op10_toxicity": toxicity.query,
}
ORACLES: dict = {
    "op1_chat_format": chat.ORACLE,
    "op9_exact_topk": topk.ORACLE,
}
