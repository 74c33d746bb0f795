
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.sources import schemas


def accuracy(correct: Column) -> list[Column]:
    """[AGG-1, AGG-2, AGG-8, AGG-15, AGG-17, AGG-36, MSC-8, MSC-52] n counts all rows, the mean the rows with an outcome."""
    return [F.count("*").alias("n"), F.count(correct).alias("n_scored"), F.avg(correct.cast("int")).alias("mean_correct")]


def accuracy_without_failures(correct: Column, failed: Column) -> list[Column]:
    """[AGG-16] n counts all rows, the denominator those whose judge's reply could be read."""
    ok = ~F.coalesce(failed, F.lit(False))
    return [F.count("*").alias("n"), F.count_if(ok).alias("n_scored"), F.try_divide(F.count_if(ok & correct), F.count_if(ok)).alias("accuracy")]


def values_frame(spark: SparkSession, name: str, values: Sequence[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))


def with_all_levels(grouped: DataFrame, levels: DataFrame, keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """[AGG-3, AGG-4, AGG-5, AGG-7, AGG-9] Every level has a row; counts of absent ones are 0, their means null."""
    out = levels.join(grouped, list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})


def normalize_category(category: Column, known: Sequence[str] = schemas.CATEGORIES) -> Column:
    """[PRJ-6] A known category, else Other."""
    return F.when(category.isin(*known), category).otherwise("Other")


def map_category(category: Column, mapping: dict[str, str], default: str = "Other") -> Column:
    """[PRJ-5, FN-42] The category's name in the analysis, else the default."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(table, category), F.lit(default))


def cell_table(df: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """[AGG-10] Size and mean of every cell; a null key is a cell."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(y).alias("mean_y"))


def modal(value: str, keys: Sequence[str], df: DataFrame) -> DataFrame:
    """[AGG-12, AGG-13] The commonest non-null value of each group, ties to the smallest; '' where all are null."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    ranked = counts.groupBy(*keys).agg(F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col("c")).alias("c"), F.col(value).alias("v")))).alias("m"))
    return ranked.select(*keys, F.coalesce("m.v", F.lit("")).alias(f"modal_{value}"))


def agreement(df: DataFrame, pairs: Sequence[tuple[str, str]], both: bool = True) -> DataFrame:
    """[AGG-14] Share of rows on which two columns agree, per pair and on all pairs."""
    same = [(F.col(a) == F.col(b)) for a, b in pairs]
    cols = [F.avg(s.cast("int")).alias(f"agree_{i + 1}") for i, s in enumerate(same)]
    if both:
        together = same[0]
        for s in same[1:]:
            together = together & s
        cols.append(F.avg(together.cast("int")).alias("agree_all"))
    return df.agg(F.count("*").alias("n"), *cols)


def matrix(df: DataFrame, rows: str, columns: str, levels: Sequence[str], correct: Column) -> DataFrame:
    """[AGG-18] Accuracy by source (rows) and reader (columns); null where there is no row."""
    return df.withColumn("c_", correct.cast("int")).groupBy(rows).pivot(columns, list(levels)).agg(F.avg("c_"))


def frequencies(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """[AGG-19, AGG-22, AGG-35] Counts by each key alone and overall, in one pass over the data."""
    sets = [[k] for k in keys] + [[]]
    grouped = df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    name = F.element_at(F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit((2 ** len(keys) - 1) - 2 ** (len(keys) - 1 - i)), F.lit(k))], F.lit(2 ** len(keys) - 1), F.lit("all")), F.col("gid").cast("int"))
    return grouped.select(name.alias("dimension"), F.coalesce(*[F.col(k).cast("string") for k in keys]).alias("level"), "n")


def grid_audit(df: DataFrame, case: str, path: str, expected_paths: int) -> DataFrame:
    """[AGG-21, SET distinct] Per case: rows, distinct paths, repeated paths, and whether it is whole."""
    by_path = df.groupBy(case, path).agg(F.count("*").alias("c"))
    out = by_path.groupBy(case).agg(F.sum("c").alias("n_rows"), F.count(path).alias("n_paths"), F.count_if((F.col("c") > 1) & F.col(path).isNotNull()).alias("n_repeated"))
    return out.withColumn("ok", (F.col("n_paths") == expected_paths) & (F.col("n_repeated") == 0))


def vote(df: DataFrame, keys: Sequence[str], is_answer: Column, letter: str) -> DataFrame:
    """[AGG-25, FLT-29, UDF-2] Answers win only by strictly more than half; the modal letter (ties to the smallest) and the share."""
    counts = df.groupBy(*keys).agg(F.count_if(is_answer).alias("answers"), F.count_if(~is_answer).alias("questions"))
    top = modal(letter, keys, df.where(is_answer))
    out = counts.join(top, list(keys), "left")
    return out.withColumns({"commits": F.col("answers") > F.col("questions"), "confidence": F.try_divide("answers", F.col("answers") + F.col("questions"))})


def yes_majority(vote_column: Column) -> Column:
    """[AGG-26, FLT-27, FLT-28] More yes than no; a tie is no."""
    return F.count_if(vote_column == "YES") > F.count_if(vote_column == "NO")


def representative(df: DataFrame, keys: Sequence[str], score: str, order: str, reply: str) -> DataFrame:
    """[AGG-27, AGG-28] Mean score, the first score nearest to it, and the last reply with that score; no scores give 0."""
    means = df.groupBy(*keys).agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_score"))
    near = df.join(means, list(keys)).where(F.col(score).isNotNull())
    pick = near.groupBy(*keys).agg(F.min(F.struct(F.abs(F.col(score) - F.col("mean_score")).alias("d"), F.col(order).alias("o"), F.col(score).alias("s"))).alias("m")).select(*keys, F.col("m.s").alias("picked"))
    last = near.join(pick, list(keys)).where(F.col(score) == F.col("picked")).groupBy(*keys).agg(F.max(F.struct(order, reply)).alias("r")).select(*keys, F.col(f"r.{reply}").alias("reply"))
    return means.join(pick, list(keys), "left").join(last, list(keys), "left").withColumn("picked", F.coalesce("picked", F.lit(0.0)))


def usage(df: DataFrame, key: str) -> DataFrame:
    """[AGG-29, AGG-37] Tokens and time by role."""
    return df.groupBy(key).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("latency").alias("latency"))


def run_summary(df: DataFrame, agent: str) -> DataFrame:
    """[AGG-20, AGG-24] Mean turns and capped runs by agent; either name of the end flag counts."""
    capped = ~F.coalesce("dialogue_ended", "ended_by_patient", F.lit(False))
    return df.groupBy(agent).agg(F.count("*").alias("n"), F.avg("n_turns").alias("mean_turns"), F.count_if(capped).alias("n_capped"))


def coverage_rate(covered: Column, total: Column, empty: float | None = 0.0) -> Column:
    """[AGG-23, AGG-30, MSC-3] Covered over all facts; without facts 0 (sessions) or null (scoring)."""
    return F.coalesce(F.try_divide(covered, total), F.lit(empty).cast("double"))


def violations(rules: dict[str, Column]) -> Column:
    """[AGG-33, MSC-54] Names of the rules that a row breaks."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]), lambda x: x.isNotNull())


def varying_within(df: DataFrame, key: str, value: Column) -> DataFrame:
    """[AGG-34] Keys with more than one value (all rows are compared)."""
    return df.groupBy(key).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_")).where("not lo_ <=> hi_").select(key)
