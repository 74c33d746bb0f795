
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import joins, metrics
from caseloom.plans import encounters, policy
from caseloom.plans import estimators as est
from caseloom.sources import schemas, shared

# Fixed values of the log and of the summary: they must be these for right results.
COLUMNS = ("metric", "strategy", "path_id", "forced_a1", "forced_a2", "case_category", "n", "avg_correctness", "V_hat_in_sample", "cases_missing_path", "error")
BASELINE, GRID, LOOP = "baseline", "smart_grid", "smart_adaptive_loop"
NO_BASELINE, NO_GRID, NO_LOOP = "baseline file missing", "no grid rows for benchmark cohort", "adaptive file missing or empty"
#: The cohorts that a run takes when its configuration names none.
COHORT_SIZE, CLOSED_FROM, CLOSED_TO = 50, 100, 150

_TYPES = {"n": "long", "avg_correctness": "double", "V_hat_in_sample": "double", "cases_missing_path": "long"}
CELLS2, CELLS1 = est.CellMeans(("case_category", "R1_responder", "A1")), est.CellMeans(("case_category",))


def case_id(i: Column) -> Column:
    return F.concat(F.lit("medqa_"), F.lpad(i.cast("string"), 4, "0"))


def cohort(spark: SparkSession, ids: Sequence[str] | None = None, *, closed: bool = False) -> DataFrame:
    """[MSC-25, MSC-27] case_id and its place: the configured ids, else the first 50 cases, or for the closed loop those from 100 to 149."""
    if ids:
        return spark.createDataFrame(list(enumerate(ids)), "place long, case_id string")
    lo, hi = (CLOSED_FROM, CLOSED_TO) if closed else (0, COHORT_SIZE)
    return spark.range(lo, hi).select((F.col("id") - lo).alias("place"), case_id(F.col("id")).alias("case_id"))


def grid_paths(pairs: Sequence[Sequence[str]] | None = None) -> list[tuple[str, str]]:
    """[MSC-26] The configured pairs of arms (others than pairs are passed over), else all nine."""
    some = [(str(p[0]), str(p[1])) for p in pairs or () if isinstance(p, list | tuple) and len(p) == 2]
    return some or [(a, b) for a in schemas.A1_ARMS for b in schemas.A2_ARMS]


def logged(enc: DataFrame, mode: str) -> DataFrame:
    """[MSC-28] Keys of finished encounters of a run mode: case_id, and path_id for the grid; empty ones don't count."""
    keys = ["case_id", *(["path_id"] if mode == GRID else [])]
    df = enc.where(F.col("run_mode") == mode)
    for k in keys:
        df = df.where(F.coalesce(F.col(k), F.lit("")) != "")
    return df.select(*keys).distinct()


def _rows(df: DataFrame, **literals: str | None) -> DataFrame:
    """The summary's columns, those that a block lacks null."""
    for name, value in literals.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(_TYPES.get(c, "string")).alias(c) for c in COLUMNS])


def _mean(correct: Column) -> list[Column]:
    return [F.count("*").alias("n"), F.avg(correct.cast("int")).alias("avg_correctness")]


def summary_table(
    enc: DataFrame, cases: DataFrame, closed_cases: DataFrame | None = None, *, stage2: est.StageModel | None = None, stage1: est.StageModel | None = None, order: str = "seq",
) -> DataFrame:
    """[MSC-10, SET-2, AGG-2, AGG-4..9, FLT-2..6, MSC-9] Baseline, fixed paths, fitted policy and closed loop, each also by category: 1 + 8 + 9 + 72 + 1 + 8 + 1 + 8 rows.

    enc: logged encounters with a column of their order. cases and closed_cases: case_id, a
    row a case. A grid row counts for a path by its id or by both forced arms, for both if
    these differ. The policy is fitted to the valid grid rows of the cohort; a case counts as
    missing without grid rows, or where its arms have no outcome in the grid, of several the
    last. Where the fit fails its message is in the rows. Means of nothing are null; every
    category and path has its row. Unknown and null categories are Other.
    """
    spark, correct = enc.sparkSession, F.col("outcome.diag_correct")
    rows = enc.withColumn("category", metrics.normalize_category(F.col("case_category")))
    mine = cases.select("case_id").distinct()
    inside = rows.join(mine, "case_id", "left_semi")
    base, grid = inside.where(F.col("run_mode") == BASELINE), inside.where(F.col("run_mode") == GRID)
    loop = (rows.join(closed_cases.select("case_id").distinct(), "case_id", "left_semi") if closed_cases is not None else inside).where(F.col("run_mode") == LOOP)
    cats = metrics.values_frame(spark, "category", schemas.CATEGORIES)

    def block(df: DataFrame, name: str, strategy: str, error: str | None) -> list[DataFrame]:
        whole = df.agg(*_mean(correct)).withColumn("error", F.when(F.col("n") == 0, F.lit(error)))
        by = metrics.with_all_levels(df.groupBy("category").agg(*_mean(correct)), cats, ["category"], ["n"])
        return [_rows(whole, metric=name, strategy=strategy), _rows(by.withColumn("case_category", F.col("category")), metric=f"category_{name}", strategy=strategy)]

    own = F.filter(F.array(*[F.struct(F.lit(a).alias("a1"), F.lit(b).alias("a2")) for a, b in grid_paths()]), lambda p: (F.col("path_id") == F.concat_ws("_", p["a1"], p["a2"])) | ((F.col("forced_a1") == p["a1"]) & (F.col("forced_a2") == p["a2"])))
    walked = grid.withColumn("p", F.explode(own)).select("category", correct.alias("y"), F.col("p.a1").alias("A1"), F.col("p.a2").alias("A2"))  # [FLT-6]
    cell = walked.groupBy("A1", "A2", "category").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("int")).alias("hits"), F.count("y").alias("scored"))
    cells = metrics.with_all_levels(cell, joins.grid_of(cats, schemas.A1_ARMS, schemas.A2_ARMS), ["A1", "A2", "category"], ["n", "hits", "scored"])
    rate = F.try_divide("hits", "scored").alias("avg_correctness")
    named = [F.concat_ws("->", "A1", "A2").alias("strategy"), F.concat_ws("_", "A1", "A2").alias("path_id"), F.col("A1").alias("forced_a1"), F.col("A2").alias("forced_a2")]
    totals = cells.groupBy("A1", "A2").agg(*[F.sum(c).alias(c) for c in ("n", "hits", "scored")])
    fixed = [_rows(totals.select(*named, "n", rate), metric="static_path"), _rows(cells.select(*named, F.col("category").alias("case_category"), "n", rate), metric="category_static_path")]

    first = joins.first_by(inside.where(F.col("run_mode").isin(BASELINE, GRID)).withColumn("o_", F.struct(F.when(F.col("run_mode") == BASELINE, 0).otherwise(1), order)), "case_id", "o_", "category")  # [AGG-31]
    known = cases.select("case_id").join(first, "case_id", "left")
    flat = shared.kept(encounters.flatten(grid.withColumn("o_", F.col(order)), keep=("o_",)), "flat")  # every pass of the fit reads it
    try:
        fit = policy.fit_q(flat, stage2=stage2, stage1=stage1)
        value, error = float(fit.value), None
        chosen = policy.policy_of(fit, flat, "o_")
        seen = grid.select("case_id", F.col("stage1_arm").alias("A1"), F.col("stage2_arm").alias("A2"), correct.cast("int").alias("y"), F.col(order).alias("seq"))
        hits = shared.kept(known.join(joins.policy_outcomes(chosen, seen).select("case_id", "y"), "case_id", "left"), "hits")  # a row a case, read twice
    except (ValueError, np.linalg.LinAlgError) as e:
        value, error = None, NO_GRID if not flat.head(1) else str(e)
        hits = known.withColumn("y", F.lit(None).cast("int"))
    got = [F.count("y").alias("n"), F.avg("y").alias("avg_correctness"), F.count_if(F.col("y").isNull()).alias("cases_missing_path")]
    whole = hits.agg(*got)
    whole = whole.withColumn("V_hat_in_sample", F.lit(value)) if error != NO_GRID else whole.withColumn("cases_missing_path", F.lit(None))
    by = metrics.with_all_levels(hits.groupBy("category").agg(*got), cats, ["category"], ["n", "cases_missing_path"]).withColumn("case_category", F.col("category"))
    adaptive = [_rows(whole, metric="qlearning_adaptive", strategy="pi_hat", error=error), _rows(by, metric="category_adaptive", strategy="pi_hat", error=error)]
    blocks = [*block(base, "baseline", "baseline", NO_BASELINE), *fixed, *adaptive, *block(loop, "closed_loop_adaptive", "pi_hat_online", NO_LOOP)]
    return joins.union_to(blocks, COLUMNS)
