"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseloom.llm import audit, chat, fim, fingerprint, jaccard, lines, mixing, packing, pipeline, quality, secrets, suffixes, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_mixing": mixing.op2_mixing,
    "op3_jaccard": jaccard.op3_jaccard,
    "op4_topk": topk.op4_topk,
    "op5_lines": lines.op5_lines,
    "op6_suffixes": suffixes.op6_suffixes,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_secrets": secrets.op8_secrets,
    "op9_fingerprint": fingerprint.op9_fingerprint,
    "op10_chat": chat.op10_chat,
    "op11_divergence": audit.op11_divergence,
    "op12_quality": quality.op12_quality,
    "op13_fim": fim.op13_fim,
    "pipeline": pipeline.run,
}

ORACLES: dict[str, str] = {
    "op4_topk": topk.OP4_SQL,
    "op5_lines": lines.OP5_SQL,
    "op6_suffixes": suffixes.OP6_SQL,
    "op8_secrets": secrets.OP8_SQL,
    "op10_chat": chat.OP10_SQL,
    "op11_divergence": audit.OP11_SQL,
    "op13_fim": fim.OP13_SQL,
}
