
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = ("local", "vllm", "mlx", "hf")
_REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    """[UDF-1, UDF-3, UDF-6] A provider: prompts (prompt_key, prompt) to (prompt_key, reply)."""

    def add(f):
        _REGISTRY[name] = f
        return f

    return add


def provider(name: str) -> Callable[..., DataFrame]:
    return _REGISTRY[name]


@register("recorded")
def recorded(prompts: DataFrame, replies: DataFrame) -> DataFrame:
    """[SRC-26] Replies by key; a prompt without one has a null reply."""
    return prompts.join(replies.select("prompt_key", "reply"), "prompt_key", "left")


@register("mock")
def mock(prompts: DataFrame, reply: str = "OK") -> DataFrame:
    """[SRC-26] The same reply to all."""
    return prompts.withColumn("reply", F.lit(reply))


def infer_provider(model: Column, stated: Column | None = None) -> Column:
    """[PRJ-42, PRJ-43] The stated provider, else by the model's name, else local."""
    low = F.lower(model)
    by_name = F.when(low.startswith("gpt") | low.startswith("o1"), "openai").when(low.startswith("claude"), "anthropic").when(F.contains(low, F.lit("/")), "hf").otherwise("local")
    return by_name if stated is None else F.coalesce(F.when(F.trim(stated) != "", F.lower(stated)), by_name)


def is_local(name: Column) -> Column:
    """[FLT-23]"""
    return F.lower(name).isin(*LOCAL)
