
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions import text as fx


def paired_history(messages: DataFrame, conv: str, turn: str, role: str, content: str, asker: str = "doctor", answerer: str = "patient") -> DataFrame:
    """[WIN-1, PRJ-38] Each question with the answer that comes next; a later question replaces one still open."""
    said = messages.where((F.trim(content) != "") & ((F.col(role) == answerer) | ((F.col(role) == asker) & F.contains(F.col(content), F.lit("?")))))
    w = Window.partitionBy(conv).orderBy(turn)
    nxt = said.withColumn("next_role", F.lead(role).over(w)).withColumn("answer", F.lead(content).over(w))
    return nxt.where((F.col(role) == asker) & (F.col("next_role") == answerer)).select(conv, turn, F.col(content).alias("question"), "answer")


def asked_before(messages: DataFrame, conv: str, turn: str, role: str, content: str, asker: str = "doctor", conclusion: str = fx.DIAGNOSIS_MARKER) -> DataFrame:
    """[WIN-2, WIN-3, FN-2] Questions with their normal form and how often it was asked before; blank forms count 0."""
    q = messages.where((F.col(role) == asker) & F.contains(F.col(content), F.lit("?")) & ~F.contains(F.upper(content), F.lit(conclusion)))
    q = q.withColumn("norm", fx.normalize_question(F.col(content)))
    w = Window.partitionBy(conv, "norm").orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return q.withColumn("prior", F.when(F.col("norm") == "", 0).otherwise(F.count("*").over(w)))


def blocked(messages: DataFrame, conv: str, turn: str, role: str, content: str, asker: str = "doctor", answerer: str = "patient", cap: int = 2) -> DataFrame:
    """[WIN-3, WIN-4, FLT-18] Questions asked cap times before, or whose last answer before told nothing."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(1, Window.unboundedFollowing)
    reply = F.first(F.when(F.col(role) == answerer, F.col(content)), ignorenulls=True).over(w)
    q = asked_before(messages.withColumn("reply", reply), conv, turn, role, content, asker)
    before = Window.partitionBy(conv, "norm").orderBy(turn)
    q = q.withColumn("refused", F.coalesce(fx.is_uninformative(F.lag("reply").over(before)) & (F.lag("reply").over(before).isNotNull()), F.lit(False)))
    return q.withColumn("blocked", (F.col("prior") >= cap) | (F.col("refused") & (F.col("norm") != "")))


def running_accuracy(df: DataFrame, by: str | None, order: list[str], correct: Column) -> DataFrame:
    """[WIN-5, AGG-24] Mean of the outcomes so far, in each group (or in all, on one task)."""
    w = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running", F.avg(correct.cast("double")).over(w))


def recent_distinct(df: DataFrame, key: str, value: str, order: str, n: int = 12) -> DataFrame:
    """[WIN-6] The first occurrence of each value, of which the last n stay."""
    once = df.withColumn("r_", F.row_number().over(Window.partitionBy(key, value).orderBy(order))).where("r_ = 1")
    return once.withColumn("e_", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("e_") <= n).drop("r_", "e_")


def first_evidence(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """[WIN-7, FLT-13] The first row of each key over ordered batches."""
    return df.withColumn("r_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("r_ = 1").drop("r_")


def rotate_pick(candidates: Column, free: Column, start: Column) -> Column:
    """[WIN-10, FN-36..38] The first free candidate from an offset on, wrapping; null when all are blocked."""
    n = F.size(candidates)
    turned = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(candidates, F.pmod(i + start, n)))
    return F.when(n > 0, F.get(F.filter(turned, lambda c: F.array_contains(free, c)), F.lit(0)))


def rotation_start(turn: Column, n: Column) -> Column:
    """[FN-37] pmod(max(0, turn - 1), n)."""
    return F.pmod(F.greatest(F.lit(0), turn - 1), n)


def unique_question(given: Column, regenerated: Column, fallback: Column, from_facts: Column, is_blocked) -> Column:
    """[FN-36] struct(question, reason): the first of given, regenerated (array), fallback and fact question that isn't blocked."""
    again = F.get(F.filter(regenerated, lambda q: ~is_blocked(q)), F.lit(0))
    free = lambda c: c.isNotNull() & ~is_blocked(c)
    return (
        F.when(free(given), F.struct(given.alias("question"), F.lit("given").alias("reason")))
        .when(again.isNotNull(), F.struct(again.alias("question"), F.lit("regenerated").alias("reason")))
        .when(free(fallback), F.struct(fallback.alias("question"), F.lit("fallback").alias("reason")))
        .when(free(from_facts), F.struct(from_facts.alias("question"), F.lit("fact").alias("reason")))
        .otherwise(F.struct(given.alias("question"), F.lit("exhausted").alias("reason")))
    )


def last_letter(df: DataFrame, key: str, turn: str, letter: str) -> DataFrame:
    """[WIN-12] The last committed letter."""
    return df.where(F.col(letter).isNotNull()).groupBy(key).agg(F.max(F.struct(turn, letter)).alias("m")).select(key, F.col(f"m.{letter}").alias(letter))


def stage_confidence(scores: Column, default: float = 0.5) -> Column:
    """[WIN-11] struct(final, mean); both the default without scores."""
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    has = F.coalesce(F.size(scores) > 0, F.lit(False))
    return F.struct(F.when(has, F.try_element_at(scores, F.lit(-1))).otherwise(default).alias("final"), F.when(has, mean).otherwise(default).alias("mean"))


def first_conclusion(turns: Column, is_final, final_label: Column, label_of) -> Column:
    """[WIN-13, ST-9] struct(at, revised): place (from 0) of the first turn with a diagnosis, and whether its label isn't the final one."""
    marks = F.transform(turns, lambda t, i: F.when(is_final(t), i))
    at = F.array_min(F.filter(marks, lambda i: i.isNotNull()))
    return F.struct(at.alias("at"), F.when(at.isNotNull(), label_of(F.get(turns, at)) != final_label).alias("revised"))
