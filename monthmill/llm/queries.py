"""Collects the registered queries of the subpackage."""

from monthmill.llm import (
    decontaminate, exact_dedup, line_dedup, lm_score, merkle, mixing, pii, quality, sentencepieces, simhash, toxicity, warc, whitening,
)
from monthmill.llm.common import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "decontaminate", "exact_dedup", "line_dedup", "lm_score", "merkle", "mixing", "pii", "quality",
    "sentencepieces", "simhash", "toxicity", "warc", "whitening",
]
