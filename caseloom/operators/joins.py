"""

No side is broadcast by hint: the planner and AQE choose by measured size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rules_side_by_side(q: DataFrame, a: DataFrame, key: str = "encounter_id") -> DataFrame:
    """[JN-1] Inner join of two rule tables, other columns with _q and _a."""
    named = lambda df, end: df.select(key, *[F.col(c).alias(f"{c}{end}") for c in df.columns if c != key])
    return named(q, "_q").join(named(a, "_a"), key)


def override_left(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """[JN-2] The table's value wins wherever it has the key, even when null there."""
    side = table.select(F.col(key), F.col(value).alias("new_"), F.lit(True).alias("has_"))
    return df.join(side, key, "left").withColumn(value, F.when(F.col("has_"), F.col("new_")).otherwise(F.col(value))).drop("new_", "has_")


def in_list_order(df: DataFrame, ids: DataFrame, key: str, order: str) -> DataFrame:
    """[JN-3] Rows in the order of a list (pos, id): last row of a repeated key, repeats in the list twice, missing ones skipped."""
    from caseloom.sources.readers import last_by_key

    return ids.join(last_by_key(df, key, order), ids["id"] == F.col(key)).drop("id").orderBy("pos")


def first_match(df: DataFrame, condition: Column, *order: str) -> DataFrame:
    """[JN-4]"""
    return df.where(condition).orderBy(*order).limit(1)


def pending(todo: DataFrame, done: DataFrame, keys: Sequence[str], condition: Column | None = None) -> DataFrame:
    """[JN-5, JN-6, JN-7, SET-5, MSC-24, ST-8] Rows whose keys the finished log (or a part of it) lacks."""
    return todo.join((done.where(condition) if condition is not None else done).select(*keys).distinct(), list(keys), "left_anti")


def reuse_or_compute(todo: DataFrame, stored: DataFrame, key: str, compute) -> DataFrame:
    """[JN-8, JN-9, ST-9] Stored rows pass through, the others are computed."""
    have = stored.join(todo.select(key), key, "left_semi")
    return have.unionByName(compute(todo.join(stored.select(key), key, "left_anti")), allowMissingColumns=True)


def policy_outcomes(policy: DataFrame, grid: DataFrame) -> DataFrame:
    """[JN-10] Outcome of each case under its chosen arms; null where the grid lacks it. grid: case_id, A1, A2, y, seq.

    Null outcomes don't count; of several the last does [AGG-32].
    """
    known = grid.where("y is not null").groupBy("case_id", "A1", "A2").agg(F.max(F.struct("seq", "y")).alias("m")).select("case_id", F.col("A1").alias("pi1"), F.col("A2").alias("pi2"), F.col("m.y").alias("y"))
    return policy.join(known, ["case_id", "pi1", "pi2"], "left")


def join_as_text(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """[JN-11] Keys are compared as text, whatever their types."""
    return a.withColumn(key, F.col(key).cast("string")).join(b.withColumn(key, F.col(key).cast("string")), key)


def grid_of(cases: DataFrame, a1: Sequence[str], a2: Sequence[str]) -> DataFrame:
    """[JN-12, PRJ-31] Every case with every pair of arms: an explode of literals, not a join."""
    pairs = F.array(*[F.struct(F.lit(x).alias("A1"), F.lit(y).alias("A2"), F.lit(f"{x}_{y}").alias("path_id")) for x in a1 for y in a2])
    return cases.withColumn("p", F.explode(pairs)).select(*cases.columns, "p.A1", "p.A2", "p.path_id")


def ordered_pairs(agents: Sequence[str]) -> list[tuple[str, str]]:
    """[JN-13] All pairs of different agents, of which there are few."""
    return [(a, b) for a in agents for b in agents if a != b]


def cross_readings(rows: DataFrame, agents: Sequence[str], source: str = "agent") -> DataFrame:
    """[JN-13] Each row once per other agent (column reader)."""
    return rows.withColumn("reader", F.explode(F.filter(F.array(*map(F.lit, agents)), lambda a: a != F.col(source))))


def zip_by_position(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """[JN-15] Rows of two frames side by side by their places in the order; the longer one's rest is dropped."""
    from caseloom.sources.readers import numbered

    return numbered(a, order).join(numbered(b.select(*[F.col(c).alias(f"{c}_b") for c in b.columns]), f"{order}_b"), "n")


def zip_shorter(a: Column, b: Column) -> Column:
    """[JN-16] Pairs of two arrays to the shorter one's end."""
    return F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), F.lit(1), F.least(F.size(a), F.size(b)))


def labelled(values: Column, labels: Column, wanted: str) -> Column:
    """[JN-17, FN-41] Values whose label is wanted; none when the lengths differ."""
    kept = F.transform(F.filter(F.arrays_zip(values.alias("v"), labels.alias("l")), lambda x: F.lower(F.trim(x["l"])) == wanted), lambda x: x["v"])
    return F.when(F.size(values) == F.size(labels), kept).otherwise(F.array().cast("array<string>"))


def complete(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """[JN-18, SET-6, MSC-43, MSC-44] One row: whether something is expected and all of it done."""
    left = expected.select(key).distinct().join(done.select(F.col(key), F.lit(1).alias("d_")).distinct(), key, "left")
    return left.agg((F.coalesce(F.count("*"), F.lit(0)) > 0).alias("any"), F.count_if(F.col("d_").isNull()).alias("missing")).select((F.col("any") & (F.col("missing") == 0)).alias("complete"), "missing")


def union_to(frames: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """[SET-1, SET-2, SET-3] Union by name, then the stated columns, absent ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in columns])


def jaccard(a: Column, b: Column) -> Column:
    """[SET-9] Shared over all elements; null for two empty arrays."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def overlapping(small: DataFrame, large: DataFrame, small_key: str, large_key: str, words: str, share: float) -> DataFrame:
    """[FN-21] Pairs of rows of which the large side has at least a share of the small one's words: both keys, hits, n_words.

    A row of n words that finds m = ceil(share * n) of them must find one of its n - m + 1
    rarest, so rows meet on these alone; frequent words make no candidates unless a row has
    nothing rarer. Words are arrays without repeats. Keys are unique on each side.
    """
    from caseloom.sources.shared import kept

    large = kept(large.select(large_key, words), "words")
    each = large.select(large_key, F.explode(words).alias("w_"))
    often = each.groupBy("w_").agg(F.count("*").alias("df_"))
    mine = small.select(small_key, F.size(words).alias("n_words"), F.explode(words).alias("w_")).join(often, "w_", "left")
    rare = Window.partitionBy(small_key).orderBy(F.coalesce("df_", F.lit(0)), "w_")
    least = F.ceil(F.lit(share) * F.col("n_words") - 1e-9)
    prefix = mine.withColumn("r_", F.row_number().over(rare)).where((F.col("r_") <= F.col("n_words") - least + 1) & F.col("df_").isNotNull())
    met = prefix.select(small_key, "w_").join(each, "w_").select(small_key, large_key).distinct()
    both = met.join(small.select(small_key, F.col(words).alias("a_")), small_key).join(large.withColumnRenamed(words, "b_"), large_key)
    out = both.select(small_key, large_key, F.size(F.array_intersect("a_", "b_")).cast("long").alias("hits"), F.size("a_").cast("long").alias("n_words"))
    return out.where(F.col("hits") >= F.lit(share) * F.col("n_words"))


def first_by(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """[AGG-31] The first value of each key."""
    return df.groupBy(key).agg(F.min(F.struct(order, value)).alias("m")).select(key, F.col(f"m.{value}").alias(value))


def one_per_category(df: DataFrame, category: str, order: str, n: int) -> DataFrame:
    """[WIN-8] The first row of each category, in order, at most n."""
    w = Window.partitionBy(category).orderBy(order)
    return df.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_").orderBy(order).limit(n)
