"""

Fits are normal equations and Newton steps over moment matrices that are summed in the
cluster (``estimators``); the driver solves them. Stage models are arguments.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.operators import ranking
from caseloom.plans import encounters as enc
from caseloom.plans import estimators as est
from caseloom.sources import schemas

RESPONDER_POOL = ("A2a", "A2b", "A2c")
OTHER_POOL = ("A2a", "A2b")


@dataclass
class Linear:
    """[ML-1, ML-2, MSC-15..18] Coefficients with the intercept last; predictions are held to 0..1."""

    weights: list[float]
    logistic: bool = False

    def raw(self, x: Column) -> Column:
        w = F.array(*map(F.lit, self.weights[:-1]))
        return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(float(self.weights[-1])), lambda s, v: s + v)

    def predict(self, x: Column) -> Column:
        r = self.raw(x)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 / (1 + F.exp(-r)) if self.logistic else r))

    @property
    def n_parameters(self) -> int:
        return len(self.weights)


def ridge(df: DataFrame, x: Column, y: Column, alpha: float = 1.0) -> Linear:
    """[ML-1, ML-9] Sum of squares plus alpha times the squared coefficients; the intercept is free. One pass, one matrix to the driver."""
    rows = df.select(x.alias("x"), y.cast("double").alias("y")).where("y is not null")
    one = rows.select(F.size("x").alias("k")).first()
    if one is None:
        raise ValueError("no rows to fit")
    d = one["k"] + 1

    def add(c: dict[str, np.ndarray]) -> np.ndarray:
        z = np.column_stack([c["x"].astype(float), np.ones(len(c["x"]))])
        return np.concatenate([(z.T @ z).ravel(), z.T @ c["y"]])

    total = est.tree_sum(rows, add, d * d + d)
    penalty = np.eye(d) * alpha
    penalty[-1, -1] = 0
    return Linear(np.linalg.lstsq(total[: d * d].reshape(d, d) + penalty, total[d * d :], rcond=None)[0].tolist())


def pool() -> Column:
    """[FLT-19]"""
    return ranking.responder_pool(F.col("R1_responder"), RESPONDER_POOL, OTHER_POOL)


def with_states(df: DataFrame) -> DataFrame:
    """The states as arrays (s1, s2), computed once; everything else reads them."""
    return df.withColumn("s1", F.array(*[c.cast("double") for c in enc.state1()])).withColumn("s2", F.array(*[c.cast("double") for c in enc.state2()]))


def counterfactual(arm: str) -> Column:
    """s2 with another stage-1 arm: its last three elements are the arm's dummies."""
    k = len(schemas.A1_ARMS)
    return F.concat(F.slice("s2", F.lit(1), F.size("s2") - k), F.array(*[F.lit(float(a == arm)) for a in schemas.A1_ARMS]))


def _state2(a1: str | None) -> Column:
    return F.col("s2") if a1 is None else counterfactual(a1)


STAGE1 = est.Stage("A1", schemas.A1_ARMS, lambda _: F.col("s1"))
STAGE2 = est.Stage("A2", schemas.A2_ARMS, _state2)


@dataclass
class Fit:
    q1: est.Fitted
    q2: est.Fitted
    rules: DataFrame  # encounter_id, case_id, case_category, R1_responder, R2_level, A1, A2, pi1, pi2, value
    value: float


def _best_ahead(df: DataFrame, q2: est.Fitted, name: str) -> DataFrame:
    """A struct(arm, value): the stage-1 arm whose best feasible stage-2 value, at the state with that arm, is highest."""
    for a in schemas.A1_ARMS:
        df = q2.with_values(df, f"if_{a}", a)
        df = df.withColumn(f"if_{a}", ranking.argmax_in_pool(F.col(f"if_{a}"), schemas.A2_ARMS, pool())["value"])
    ahead = F.create_map(*[x for a in schemas.A1_ARMS for x in (F.lit(a), F.col(f"if_{a}"))])
    return df.withColumn(name, ranking.argmax_in_pool(ahead, schemas.A1_ARMS, F.array(*map(F.lit, schemas.A1_ARMS)))).drop(*[f"if_{a}" for a in schemas.A1_ARMS])


def fit_q(df: DataFrame, *, alpha: float = 1.0, use_logistic: bool = True, stage2: est.StageModel | None = None, stage1: est.StageModel | None = None) -> Fit:
    """[ML-3, ML-4, ML-5, ST-7, SRT-10, UDF-5] Backward induction; either stage's model may be given.

    Stage 2 regresses the outcome on state and arm. A row's pi2 is its best feasible arm at
    its own A1; pi1 the stage-1 arm whose best feasible stage-2 value (at the state with that
    arm) is highest, and the mean of that value is the policy's. Stage 1 regresses the best
    feasible stage-2 value at the row's own A1.
    """
    rows = with_states(df)
    q2 = (stage2 or (est.Logistic(alpha) if use_logistic else est.Ridge(alpha))).fit(rows, STAGE2, "Y")
    rows = q2.with_values(rows, "own2").withColumn("best2", ranking.argmax_in_pool(F.col("own2"), schemas.A2_ARMS, pool()))
    rows = rows.withColumn("after", F.col("best2.value"))
    q1 = (stage1 or est.Ridge(alpha)).fit(rows, STAGE1, "after")
    rows = _best_ahead(rows, q2, "best1")
    kept = [c for c in ("R2_level",) if c in df.columns]
    rules = rows.select("encounter_id", "case_id", "case_category", "R1_responder", *kept, "A1", "A2", F.col("best1.arm").alias("pi1"), F.col("best2.arm").alias("pi2"), F.col("best1.value").alias("value"))
    value = rules.agg(F.avg("value")).first()[0]
    if value is None:
        raise ValueError("no rows to fit")
    return Fit(q1, q2, rules, value)


def value_of_pair(df: DataFrame, q2: est.Fitted, a1: str, a2: str) -> DataFrame:
    """[ML-6] Mean value of a fixed pair over the rows to which a2 is open; null when there are none."""
    rows = q2.with_values(with_states(df).where(F.array_contains(pool(), a2)), "at", a1)
    return rows.agg(F.avg(F.try_element_at("at", F.lit(a2))).alias("value")).select(F.lit(a1).alias("A1"), F.lit(a2).alias("A2"), "value")


def static_values(df: DataFrame, fit: Fit) -> DataFrame:
    """[JN-14, SRT-5] The fixed pairs and how far the policy is above each, best first: one pass over the rows."""
    rows = with_states(df)
    for a in schemas.A1_ARMS:
        rows = fit.q2.with_values(rows, f"if_{a}", a)
    means = [
        F.avg(F.when(F.array_contains(pool(), b), F.try_element_at(f"if_{a}", F.lit(b)))).alias(f"{a}_{b}") for a in schemas.A1_ARMS for b in schemas.A2_ARMS
    ]
    pairs = F.array(*[F.struct(F.lit(a).alias("A1"), F.lit(b).alias("A2"), F.col(f"{a}_{b}").alias("value")) for a in schemas.A1_ARMS for b in schemas.A2_ARMS])
    out = rows.agg(*means).select(F.explode(pairs).alias("p")).select("p.*")
    return out.withColumn("gain", F.lit(fit.value) - F.col("value")).orderBy(F.desc_nulls_last("value"), "A1", "A2")


def fold_of(key: Column, folds: int, seed: int) -> Column:
    """[SET-7] A stable fold of a key."""
    return ranking.hash_pick(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), folds)


def cross_fitted_value(df: DataFrame, folds: int = 5, *, alpha: float = 1.0, use_logistic: bool = True, seed: int = 0, stage2: est.StageModel | None = None) -> float | None:
    """[ML-7, MSC-12] Mean value of each fold's best arms under a model of the other folds.

    Linear models are fitted for all folds together, in the passes that one fit takes. Another
    stage-2 model (stage2) is fitted a fold at a time. No rows give null.
    """
    if stage2 is None:
        model = est.Logistic(alpha) if use_logistic else est.Ridge(alpha)
        return PolicyValue(model, est.Folds(folds, seed)).values(df, est.Same())[0]
    df = df.withColumn("fold", fold_of(F.col("encounter_id"), folds, seed))
    parts = None
    for k in range(folds):
        q2 = stage2.fit(with_states(df.where(F.col("fold") != k)), STAGE2, "Y")
        part = _best_ahead(with_states(df.where(F.col("fold") == k)), q2, "best1").select(F.col("best1.value").alias("v"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.agg(F.avg("v")).first()[0]


def _a_moments(rows: DataFrame, arms: int, width: int, nu: np.ndarray | None = None) -> np.ndarray:
    """Of rows (x, arm, y, share): without nu, sums of x x' and x y and rows of the reference arm and of all; with nu, of each other arm's (x z, 1), z its indicator less its share."""
    d = width + (nu is not None)
    n = 2 if nu is None else arms - 1

    def add(c: dict[str, np.ndarray]) -> np.ndarray:
        x, y, out = c["x"].astype(float), c["y"].astype(float), np.zeros((n, d * d + d + 1))
        for i in range(n):
            if nu is None:
                own = (c["arm"] == 0) if i == 0 else np.ones(len(x), bool)
                u, t = x[own], y[own]
            else:
                z = (c["arm"] == i + 1).astype(float) - c["share"][:, i + 1].astype(float)
                own = np.abs(z) > 1e-6
                u, t = np.column_stack([x[own] * z[own, None], np.ones(own.sum())]), (y - x @ nu)[own]
            out[i] = np.concatenate([(u.T @ u).ravel(), u.T @ t, [len(u)]])
        return out.ravel()

    return est.tree_sum(rows, add, n * (d * d + d + 1)).reshape(n, -1)


def _blips(df: DataFrame, stage: est.Stage, y: str, share: Callable[[str], Column], alpha: float) -> list[Linear]:
    """[ML-9] A baseline by least squares on the reference arm (on all rows where it has too few), then for each other arm a ridge blip; their sums, by arm."""
    place = F.array_position(F.array(*map(F.lit, stage.arms)), F.col(stage.arm)) - 1
    rows = df.select(stage.state(None).alias("x"), F.coalesce(place, F.lit(-1)).cast("int").alias("arm"), F.col(y).cast("double").alias("y"), F.array(*[share(a).cast("double") for a in stage.arms]).alias("share")).where("y is not null").persist()
    try:
        one = rows.select(F.size("x").alias("k")).first()
        if one is None:
            raise ValueError("no rows to fit")
        p = one["k"]
        base = _a_moments(rows, len(stage.arms), p)
        own = base[0] if base[0, -1] >= max(p, 3) else base[1]
        nu = np.linalg.pinv(own[: p * p].reshape(p, p)) @ own[p * p : -1]
        out = [Linear([*nu.tolist(), 0.0])]
        for row in _a_moments(rows, len(stage.arms), p, nu):
            d, psi = p + 1, np.zeros(p)
            if row[-1] > p:
                penalty = np.eye(d) * alpha
                penalty[-1, -1] = 0
                psi = np.linalg.lstsq(row[: d * d].reshape(d, d) + penalty, row[d * d : -1], rcond=None)[0][:p]  # the blip has no intercept
            out.append(Linear([*(nu + psi).tolist(), 0.0]))
        return out
    finally:
        rows.unpersist()


def known_share(a: str) -> Column:
    """[ML-11] The design's chance of a stage-2 arm: even over the open ones, 0 for others."""
    return F.when(F.array_contains(pool(), a), 1.0 / F.size(pool())).otherwise(0.0)


def fit_a(df: DataFrame, *, alpha: float = 1.0, share2: Callable[[str], Column] = known_share, share1: Callable[[str], Column] | None = None) -> DataFrame:
    """[ML-8, ML-10, SRT-9, UDF-8] A-learning with linear blips; propensities are functions of the arm: encounter_id, pi1, pi2, value."""
    arms1, arms2 = schemas.A1_ARMS, schemas.A2_ARMS

    def best(df: DataFrame, models: list[Linear], arms: Sequence[str], x: str, open_: Column, name: str) -> DataFrame:
        w = np.array([m.weights[:-1] for m in models])

        @F.pandas_udf("array<double>")
        def score(states: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(states.to_numpy()) @ w.T))

        return df.withColumn(name, ranking.argmax_in_pool(F.map_from_arrays(F.array(*map(F.lit, arms)), score(F.col(x))), arms, open_))

    rows = with_states(df)
    rows = best(rows, _blips(rows, STAGE2, "Y", share2, alpha), arms2, "s2", pool(), "best2").withColumn("after", F.col("best2.value"))
    first = _blips(rows, STAGE1, "after", share1 or (lambda _: F.lit(1.0 / len(arms1))), alpha)
    rows = best(rows, first, arms1, "s1", F.array(*map(F.lit, arms1)), "best1")
    return rows.select("encounter_id", F.col("best1.arm").alias("pi1"), F.col("best2.arm").alias("pi2"), F.col("best1.value").alias("value"))


def coefficients(fit: Fit, spark: SparkSession) -> DataFrame:
    """[ML-12] Of the stages whose models are linear."""
    known = [(s, m) for s, m in (("stage1", fit.q1), ("stage2", fit.q2)) if isinstance(m, est.LinearFit)]
    return spark.createDataFrame([(s, i, float(w)) for s, m in known for i, w in enumerate(m.coefficients)], "stage string, place int, coefficient double")


def policy_of(fit: Fit, df: DataFrame, order: str = "encounter_id") -> DataFrame:
    """[ML-13] A row per case: pi1 by the stage-1 model at its first row, pi2 over all arms (no pool) at its first row under pi1, or its first row of all."""
    all1, all2 = (F.array(*map(F.lit, x)) for x in (schemas.A1_ARMS, schemas.A2_ARMS))
    seen = F.struct(order, *[c for c in df.columns if c != order])
    firsts = df.groupBy("case_id").agg(F.min(seen).alias("first"), *[F.min(F.when(F.col("A1") == a, seen)).alias(f"first_{a}") for a in schemas.A1_ARMS])
    keep = ["case_id", *[f"first_{a}" for a in schemas.A1_ARMS]]
    one = fit.q1.with_values(with_states(firsts.select("first", *[F.col(f"first_{a}") for a in schemas.A1_ARMS], "first.*")), "m1")
    one = one.withColumn("pi1", ranking.argmax_in_pool(F.col("m1"), schemas.A1_ARMS, all1)["arm"]).select("pi1", "first", *keep)
    under = F.coalesce(*[F.when(F.col("pi1") == a, F.col(f"first_{a}")) for a in schemas.A1_ARMS], F.col("first"))
    rows = one.withColumn("row", under).select("pi1", "row.*").withColumn("A1", F.col("pi1"))
    rows = fit.q2.with_values(with_states(rows), "m2")
    return rows.select("case_id", "pi1", ranking.argmax_in_pool(F.col("m2"), schemas.A2_ARMS, all2)["arm"].alias("pi2"))


def assign(df: DataFrame, scores: Column, arms: Sequence[str], open_: Column, seed: int, temperature: float = 1.0) -> DataFrame:
    """[ML-14..17, FN-46] A softmax draw among the open arms (propensity kept); equal scores give a uniform draw."""
    known = F.filter(F.array(*map(F.lit, arms)), lambda a: F.array_contains(open_, a))
    shares = ranking.softmax(F.transform(known, lambda a: F.coalesce(F.try_element_at(scores, a), F.lit(0.0))), temperature)
    at = ranking.draw(shares, ranking.hash_uniform(F.lit(seed), F.col("case_id")))
    return df.withColumns({"arm": F.get(known, at), "propensity": F.get(shares, at)})


def sample_report(df: DataFrame, n_parameters: int) -> DataFrame:
    """[AGG-11] Key and value diagnostics, long form."""
    cells = df.groupBy("A1", "A2").agg(F.count("*").alias("c")).agg(F.count("*").alias("cells"), F.min("c").alias("least"))
    whole = df.agg(F.count("*").alias("n"), F.avg("Y").alias("mean")).join(cells, F.lit(True))
    return whole.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("n", "n_per_parameter", "cells", "least_cell", "mean_y"))), F.array(F.col("n").cast("double"), F.col("n") / n_parameters, F.col("cells").cast("double"), F.col("least").cast("double"), F.col("mean")))).alias("key", "value"))


class Statistic(Protocol):
    """[UDF-4] A statistic of weighted rows: a value for each weighting, nan where it fails. It sums over rows; no resample is built."""

    def values(self, df: DataFrame, weights: est.Weights) -> list[float]: ...


@dataclass
class Mean:
    """The weighted mean of a column; nulls don't count."""

    column: str
    key: str = "encounter_id"

    def values(self, df: DataFrame, weights: est.Weights) -> list[float]:
        rows = df.select(F.col(self.column).cast("double").alias("y"), F.array(*est.key_words(F.col(self.key))).alias("key")).where("y is not null")

        def add(c: dict[str, np.ndarray]) -> np.ndarray:
            w = weights.fit(c["key"])
            return np.concatenate([w.T @ c["y"], w.sum(axis=0)])

        total = est.tree_sum(rows, add, 2 * weights.count)
        with np.errstate(invalid="ignore", divide="ignore"):
            return (total[: weights.count] / total[weights.count :]).tolist()


@dataclass
class PolicyValue:
    """[MSC-11, MSC-12] Value of the policy that a stage-2 model gives, in-sample or (with folds) of each fold under a model of the others.

    All weightings are fitted together: a pass for a ridge, one a Newton step for a logistic
    model, then one for the values of each row's best feasible arms.
    """

    model: est.Ridge | est.Logistic
    folds: est.Folds | None = None

    def values(self, df: DataFrame, weights: est.Weights) -> list[float]:
        arms, k1 = len(schemas.A2_ARMS), len(schemas.A1_ARMS)
        if self.folds is not None:
            weights = self.folds if isinstance(weights, est.Same) else est.FoldedResamples(weights, self.folds)
        rows = est._inputs(with_states(df).withColumn("open", F.transform(F.array(*map(F.lit, schemas.A2_ARMS)), lambda a: F.array_contains(pool(), a).cast("double"))), STAGE2, "Y", "encounter_id", "open").persist()
        try:
            one = rows.select(F.size("x").alias("k")).first()
            if one is None:
                return [float("nan")] * (weights.count // (self.folds.count if self.folds else 1))
            beta = est.by_arm(self.model.solve(rows.drop("open"), arms, one["k"], weights), arms)  # weightings x arms x d
            links = self.model.links

            def add(c: dict[str, np.ndarray]) -> np.ndarray:
                w, x = weights.test(c["key"]), c["x"].astype(float)
                flat = np.concatenate([beta[..., :-1 - k1], beta[..., -1:]], axis=-1)  # without the stage-1 dummies
                base = np.column_stack([x[:, :-k1], np.ones(len(x))]) @ flat.reshape(-1, flat.shape[-1]).T
                base = base.reshape(len(x), weights.count, arms)
                closed, best = c["open"].astype(float)[:, None, :] == 0, np.full((len(x), weights.count), -np.inf)
                for i in range(k1):
                    raw = base + beta[None, :, :, -1 - k1 + i]
                    v = np.clip(1 / (1 + np.exp(-np.clip(raw, -500, 500))) if links else raw, 0, 1)
                    best = np.maximum(best, np.where(closed, -np.inf, v).max(axis=2))
                return np.concatenate([(w * best).sum(axis=0), w.sum(axis=0)])

            total = est.tree_sum(rows, add, 2 * weights.count).reshape(2, -1)
        finally:
            rows.unpersist()
        if self.folds is not None:
            total = total.reshape(2, -1, self.folds.count).sum(axis=2)
        with np.errstate(invalid="ignore", divide="ignore"):
            return (total[0] / total[1]).tolist()


def replicates(df: DataFrame, statistic: Statistic, n_boot: int, *, m: int | None = None, seed: int = 0) -> DataFrame:
    """[INF-1, INF-2] (replicate, draw): the statistic of n_boot resamples of about n rows, or m; a failing one is null.

    Each row is drawn a Poisson number of times, hashed by its key, so that a resample is the
    same on any cluster and its size is n (or m) on average. n_boot rows reach the driver.
    """
    rate = 1.0 if m is None else m / max(df.count(), 1)
    draws = statistic.values(df, est.Resamples(n_boot, rate, seed))
    return df.sparkSession.createDataFrame([(i, None if np.isnan(v) else float(v)) for i, v in enumerate(draws)], "replicate long, draw double")


def subsample_size(n: int) -> int:
    """[FN-47]"""
    return max(2, int(n**0.75))


def interval(draws: DataFrame, point: float, *, alpha: float = 0.05, kind: str = "percentile", m: int | None = None, n: int | None = None) -> DataFrame:
    """[INF-1..3] percentile, m_out_of_n (deviations scaled by the root of m / n), or projection (2 * point - draws)."""
    d = F.col("draw")
    if kind == "m_out_of_n":
        d = F.lit(point) + (d - F.lit(point)) * F.lit(float(np.sqrt((m or 1) / (n or 1))))
    elif kind == "projection":
        d = F.lit(2 * point) - d
    q = F.percentile(d, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return draws.where("draw is not null and not isnan(draw)").agg(F.lit(point).alias("point"), q.alias("q"), F.count("*").alias("n_draws")).select("point", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "n_draws")


def of_events(events: DataFrame) -> DataFrame:
    """A row like simulate's for each user, from all of its events.

    The last event is stage 2: its type gives the arm (within the pool), its value the
    outcome. The first one's type is the stage-1 arm. Category, responder and the other
    features are of the events before the last.
    """
    types = ("click", "error", "purchase", "signup", "view")
    value = F.coalesce("value", F.lit(0.0))
    at = F.struct("event_id", F.coalesce("event_type", F.lit("")).alias("type"), value.alias("value"))
    u = events.groupBy("user_id").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"), F.sum(value).alias("total"), F.count_distinct("event_type").alias("kinds"), *[F.count_if(F.col("event_type") == x).alias(f"n_{x}") for x in types])
    seen = {x: (F.col(f"n_{x}") - (F.col("last.type") == x).cast("long")).cast("int") for x in types}
    before = F.col("n") - 1
    arm = lambda t, arms: F.when(t.isin("click", "error"), arms[0]).when(t.isin("purchase", "signup"), arms[1]).otherwise(arms[2])
    often = F.array_max(F.array(*[F.struct(c.alias("c"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (c, k) in enumerate(zip(seen.values(), schemas.CATEGORIES, strict=False))]))["k"]
    u = u.withColumn("R1_responder", F.coalesce(F.try_divide(F.col("total") - F.col("last.value"), before) >= 50, F.lit(False)))
    a2 = arm(F.col("last.type"), schemas.A2_ARMS)
    key = F.coalesce(F.col("user_id").cast("string"), F.lit(""))
    part = {f"R1_{c}": seen[x] for c, x in zip(("OPQRST", "red_flags", "pmh", "meds", "social"), types, strict=True)}
    return u.select(
        F.concat(F.lit("e"), key).alias("encounter_id"), F.concat(F.lit("c"), key).alias("case_id"), often.alias("case_category"), F.lit("").alias("chief_complaint"), F.lit(0).alias("seed"),
        arm(F.col("first.type"), schemas.A1_ARMS).alias("A1"), F.when(F.array_contains(pool(), a2), a2).otherwise(OTHER_POOL[0]).alias("A2"), before.cast("int").alias("R1_total"), "R1_responder",
        *[c.alias(k) for k, c in part.items()], before.cast("int").alias("stage1_turns"), F.element_at(F.array(*map(F.lit, enc.LITERACY)), (F.col("kinds") % len(enc.LITERACY) + 1).cast("int")).alias("literacy_id"),
        (F.col("last.value") > 50).cast("int").alias("Y"),
    )


def try_fit(df: DataFrame) -> tuple[Fit | None, str | None]:
    """[MSC-9] The fit, or what went wrong."""
    try:
        return fit_q(df), None
    except (ValueError, np.linalg.LinAlgError) as e:
        return None, str(e)


def sweep(fit: Fit, df: DataFrame, column: str, values: Sequence[float]) -> DataFrame:
    """[INF-7] Mean stage-2 value of each arm as one state column takes each value."""
    swept = df.withColumn(column, F.explode(F.array(*map(F.lit, values))))
    swept = fit.q2.with_values(with_states(swept), "m2")
    return swept.select(column, F.explode("m2").alias("arm", "value")).groupBy(column, "arm").agg(F.avg("value").alias("value"))


def rank_within(df: DataFrame, by: str, order: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order)))
