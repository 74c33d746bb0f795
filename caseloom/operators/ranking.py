
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_by(df: DataFrame, by: Sequence[str], score: str, tie: str, k: int) -> DataFrame:
    """[SRT-1..4] The k best rows of each group, ties to the smaller tie column; rank from 1."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_values(df: DataFrame, value: str, k: int) -> DataFrame:
    """[SRT-5, SRT-7, MSC-21] The k commonest values, ties to the smaller."""
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)


def argmax_in_pool(scores: Column, arms: Sequence[str], pool: Column) -> Column:
    """[SRT-8, SRT-9, ML-4] struct(arm, value): the best feasible arm of a map of scores; the first in order wins ties; null without one."""
    ranked = [F.when(F.array_contains(pool, a) & F.try_element_at(scores, F.lit(a)).isNotNull(), F.struct(F.try_element_at(scores, F.lit(a)).alias("value"), F.lit(-i).alias("o"), F.lit(a).alias("arm"))) for i, a in enumerate(arms)]
    best = F.array_max(F.array(*ranked))
    return F.when(best.isNotNull(), F.struct(best["arm"].alias("arm"), best["value"].alias("value")))


def responder_pool(responder: Column, full: Sequence[str], reduced: Sequence[str]) -> Column:
    """[FLT-19, AGG pools] The arms that are open to a responder, or to others."""
    return F.when(F.coalesce(responder, F.lit(False)), F.array(*map(F.lit, full))).otherwise(F.array(*map(F.lit, reduced)))


def hash_uniform(*parts: Column) -> Column:
    """[FN-45, MSC-35] A stable number in [0, 1) from text: the first 13 hex digits of SHA-256."""
    digest = F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def stable_hash(text: Column) -> Column:
    """[FN-45] The first 64 bits of SHA-256 as a whole number."""
    return F.conv(F.substring(F.sha2(text.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_pick(text: Column, n: Column | int) -> Column:
    """[ML-16, ML-17, PRJ-20] stable_hash modulo n."""
    return (stable_hash(text) % (F.lit(n) if isinstance(n, int) else n)).cast("int")


def softmax(scores: Column, temperature: float = 1.0, floor: float = 1e-6) -> Column:
    """[FN-46] An array's shares, shifted by its maximum, none below the floor before they are made to sum to 1."""
    top = F.array_max(scores)
    raw = F.transform(scores, lambda x: F.greatest(F.exp((x - top) / F.lit(temperature)), F.lit(floor)))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def draw(shares: Column, uniform: Column) -> Column:
    """[ML-14, ML-15] The place whose running sum first exceeds a number in [0, 1)."""
    sums = F.transform(shares, lambda _, i: F.aggregate(F.slice(shares, F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x))
    hit = F.array_min(F.filter(F.transform(sums, lambda s, i: F.when(s > uniform, i)), lambda i: i.isNotNull()))
    return F.coalesce(hit, F.size(shares) - 1)


def sampled_axes(key: Column, axes: dict[str, Sequence[str]], seed: int) -> Column:
    """[MSC-33, MSC-34] A struct with a hashed choice on each axis; the same for a key on every path."""
    return F.struct(*[F.element_at(F.array(*map(F.lit, v)), hash_pick(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(a)), len(v)) + 1).alias(a) for a, v in axes.items()])
