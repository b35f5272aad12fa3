"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import (
    chat_format,
    decontaminate,
    language_id,
    minhash_dedup,
    quality_classifier,
    quality_rules,
    sentencepiece_codec,
    sharding,
    suffix_dedup,
    token_output,
)
from .oracle import ORACLES

QUERIES = {
    f.__name__: f
    for f in (
        minhash_dedup.op1_minhash_dedup, language_id.op2_language_id, quality_classifier.op3_quality_classifier, sentencepiece_codec.op4_sentencepiece,
        sharding.op5_sharding, token_output.op6_token_output, decontaminate.op7_benchmark_decontamination, quality_rules.op8_quality_rules,
        chat_format.op9_chat_format, suffix_dedup.op10_suffix_dedup,
    )
}

__all__ = ["ORACLES", "QUERIES"]
