"""The training-data queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprint, jaccard, langid, lexical, merkle, mixing, neardup, pii, quality, repeats, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_neardup": neardup.op2_neardup,
    "op3_fingerprint": fingerprint.op3_fingerprint,
    "op4_mixing": mixing.op4_mixing,
    "op5_pii": pii.op5_pii,
    "op6_repeats": repeats.op6_repeats,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_bpe": bpe.op8_bpe,
    "op9_topk": topk.op9_topk,
    "op10_language": langid.op10_language,
    "op11_jaccard": jaccard.op11_jaccard,
    "op12_lexical": lexical.op12_lexical,
    "op13_manifest": merkle.op13_manifest,
}

ORACLES: dict[str, str] = {
    "op2_neardup": neardup.OP2_SQL,
    "op9_topk": topk.OP9_SQL,
    "op11_jaccard": jaccard.OP11_SQL,
    "op12_lexical": lexical.OP12_SQL,
    "op13_manifest": merkle.OP13_SQL,
}
