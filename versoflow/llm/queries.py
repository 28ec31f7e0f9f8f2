"""Queries of the operators on training text and their oracle SQL."""

from __future__ import annotations

from versoflow.llm import lookalikes, ocr_noise, packing, spam, tokenizer

QUERIES = {
    "p1_found": ocr_noise.p1_found,
    "p1_paragraphs": ocr_noise.p1_paragraphs,
    "p4_found": lookalikes.p4_found,
    "p4_canonical": lookalikes.p4_canonical,
    "p6_ids": tokenizer.p6_ids,
    "p7_containers": packing.p7_containers,
    "p7_fill": packing.p7_fill,
    "p8_found": spam.p8_found,
    "p8_evidence": spam.p8_evidence,
}

#: None of these can be said in SQL; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {}
