"""

Everything that reads rows is a sum over them: moment matrices of (state, 1) by arm, one set
for each of many weightings of the rows (resamples, folds, or the rows as they are). Tasks
sum their rows, a tree of small groups sums the tasks, and one array comes to the driver,
whatever the numbers of rows and tasks. No resample and no fold is ever built.

A stage model has ``fit(df, stage, y)``; what it returns has ``with_values(df, name, a1)``,
which adds a map from arm to predicted value, at another stage-1 arm if one is given.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.sources import shared

FAN = 64
#: Rows of a table of cells that is broadcast; a larger one is joined as Spark sees fit.
MAX_CELLS = 100_000
_MASK = np.uint64(0xFFFFFFFF)


# --- sums over rows -----------------------------------------------------------------------


def tree_sum(df: DataFrame, add: Callable[[dict[str, np.ndarray]], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of add(columns as arrays), which must give size doubles.

    A task holds one such array. Tasks are summed in groups of one in FAN, in order of task,
    then the groups; the driver gets one array. No rows give zeros.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for b in batches:
            if len(b):
                cols = {}
                for n, c in zip(names, b.columns, strict=True):
                    wide = pa.types.is_list(c.type)
                    cols[n] = c.flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) if wide else c.to_numpy(zero_copy_only=False)
                part = add(cols)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["task", "sums"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("task")
        total = np.zeros(size)
        for x in frame["sums"]:
            total += np.frombuffer(x)
        return pd.DataFrame({"task": [int(frame["task"].iloc[0])], "sums": [total.tobytes()]})

    parts = df.mapInArrow(run, "task int, sums binary")
    some = parts.groupBy((F.col("task") % FAN).alias("g")).applyInPandas(merge, "task int, sums binary")
    row = some.groupBy().applyInPandas(merge, "task int, sums binary").collect()
    return np.frombuffer(row[0]["sums"]).copy() if row else np.zeros(size)


# --- weights ------------------------------------------------------------------------------


def key_words(key: Column) -> list[Column]:
    """Two 32-bit words of a row's key, from SHA-256 of its text; what hashed weights are made of."""
    digest = F.sha2(key.cast("string"), 256)
    return [F.conv(F.substring(digest, a, 8), 16, 10).cast("long") for a in (1, 9)]


def mixed(words: np.ndarray, stream: np.ndarray) -> np.ndarray:
    """A 32-bit number for each row (words: rows x 2) and stream, by multiply and shift; whole-number steps that SQL can state too."""

    def mix(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = ((x >> np.uint64(16)) ^ x) * np.uint64(0x45D9F3B) & _MASK
        return (x >> np.uint64(16)) ^ x

    x = mix((words[:, :1].astype(np.uint64) + stream[None, :].astype(np.uint64) * np.uint64(2654435761)) & _MASK)
    return mix(x ^ words[:, 1:].astype(np.uint64))


def poisson_steps(rate: float) -> np.ndarray:
    """Whole numbers t_k below 2^32: a uniform 32-bit number at or above k of them is a Poisson draw of k."""
    steps, p, total, k = [], float(np.exp(-rate)), 0.0, 0
    while total < 1 - 2**-33 and k < 1000:
        total += p
        steps.append(int(total * 2**32))
        k += 1
        p *= rate / k
    return np.array([s for s in steps if s < 2**32], np.uint64)


class Weights(Protocol):
    """count weightings of the rows: fit(words) and test(words) give rows x count."""

    count: int

    def fit(self, words: np.ndarray) -> np.ndarray: ...

    def test(self, words: np.ndarray) -> np.ndarray: ...


@dataclass
class Same:
    """The rows as they are."""

    count: int = 1

    def fit(self, words: np.ndarray) -> np.ndarray:
        return np.ones((len(words), 1))

    test = fit


@dataclass
class Folds:
    """[SET-7] Fold k of the rows is tested by a fit on the others."""

    count: int = 5
    seed: int = 0

    def of(self, words: np.ndarray) -> np.ndarray:
        return (mixed(words, np.array([1_000_003 + self.seed]))[:, 0] % np.uint64(self.count)).astype(int)

    def test(self, words: np.ndarray) -> np.ndarray:
        return (self.of(words)[:, None] == np.arange(self.count)[None, :]).astype(float)

    def fit(self, words: np.ndarray) -> np.ndarray:
        return 1 - self.test(words)


@dataclass
class Resamples:
    """[INF-1, INF-2] Poisson numbers of times that each row is drawn, with mean rate (m / n) a row; hashed by key, the same on any cluster."""

    count: int
    rate: float = 1.0
    seed: int = 0

    def fit(self, words: np.ndarray) -> np.ndarray:
        draws = mixed(words, self.seed * 100_003 + np.arange(self.count))
        return np.searchsorted(poisson_steps(self.rate), draws, side="right").astype(float)

    test = fit


@dataclass
class FoldedResamples:
    """[MSC-12] Folds within resamples: weighting r * folds + k fits resample r without fold k and tests it on the fold."""

    resamples: Resamples
    folds: Folds

    @property
    def count(self) -> int:
        return self.resamples.count * self.folds.count

    def _times(self, words: np.ndarray, fold: np.ndarray) -> np.ndarray:
        return (self.resamples.fit(words)[:, :, None] * fold[:, None, :]).reshape(len(words), -1)

    def fit(self, words: np.ndarray) -> np.ndarray:
        return self._times(words, self.folds.fit(words))

    def test(self, words: np.ndarray) -> np.ndarray:
        return self._times(words, self.folds.test(words))


# --- stages and their moments -------------------------------------------------------------


@dataclass(frozen=True)
class Stage:
    """A decision: its arm column, the arms (the first is the reference), and the state array, at the observed or another stage-1 arm."""

    arm: str
    arms: Sequence[str]
    state: Callable[[str | None], Column]


def _inputs(df: DataFrame, stage: Stage, y: str, key: str, *more: str) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, stage.arms)), F.col(stage.arm)) - 1
    return df.select(stage.state(None).alias("x"), place.cast("int").alias("arm"), F.col(y).cast("double").alias("y"), F.array(*key_words(F.col(key))).alias("key"), *more).where("y is not null and arm >= 0")


@dataclass
class Moments:
    """By weighting and arm: sums of z z' and z t, z = (state, 1), and of the weights (of the losses in a Newton step)."""

    gram: np.ndarray  # weightings x arms x d x d
    side: np.ndarray  # weightings x arms x d
    rows: np.ndarray  # weightings x arms

    def full(self) -> tuple[np.ndarray, np.ndarray]:
        """Normal equations of the contrast design (state, state times each arm but the first, 1), per weighting."""
        b, a, d, _ = self.gram.shape
        k = d - 1
        size = k * a + 1
        g, s = np.zeros((b, size, size)), np.zeros((b, size))
        at = [slice(k * i, k * (i + 1)) for i in range(a)]
        for i in range(a):
            m = self.gram[:, i]
            for p in {0, i}:
                for q in {0, i}:
                    g[:, at[p], at[q]] += m[:, :k, :k]
                g[:, at[p], -1] += m[:, :k, -1]
                g[:, -1, at[p]] += m[:, -1, :k]
                s[:, at[p]] += self.side[:, i, :k]
            g[:, -1, -1] += m[:, -1, -1]
            s[:, -1] += self.side[:, i, -1]
        return g, s


def moments(rows: DataFrame, arms: int, width: int, weights: Weights, beta: np.ndarray | None = None) -> Moments:
    """Of rows (x, arm, y, key); with beta (weightings x arms x d) those of a Newton step of the logistic loss."""
    d = width + 1
    n = weights.count * arms

    def add(c: dict[str, np.ndarray]) -> np.ndarray:
        w = weights.fit(c["key"])
        z = np.column_stack([c["x"].astype(float), np.ones(len(w))])
        out = np.zeros((n, d * d + d + 1))
        for i in range(arms):
            own = c["arm"] == i
            if not own.any():
                continue
            zi, yi, wi = z[own], c["y"][own].astype(float), w[own]
            for b in range(weights.count):
                u, t = wi[:, b], yi
                row, h = out[b * arms + i], u
                row[-1] = u.sum()
                if beta is not None:
                    raw = np.clip(zi @ beta[b, i], -500, 500)
                    p = 1 / (1 + np.exp(-raw))
                    t, h = yi - p, u * p * (1 - p)
                    row[-1] = (u * (np.logaddexp(0, raw) - yi * raw)).sum()
                row[: d * d] = ((zi * h[:, None]).T @ zi).ravel()
                row[d * d : -1] = zi.T @ (u * t)
        return out.ravel()

    total = tree_sum(rows, add, n * (d * d + d + 1)).reshape(weights.count, arms, -1)
    return Moments(total[..., : d * d].reshape(weights.count, arms, d, d), total[..., d * d : -1], total[..., -1])


def by_arm(full: np.ndarray, arms: int) -> np.ndarray:
    """Coefficients of the contrast design as those of (state, 1) for each arm: weightings x arms x d."""
    k = (full.shape[1] - 1) // arms
    out = np.repeat(np.concatenate([full[:, :k], full[:, -1:]], axis=1)[:, None, :], arms, axis=1)
    for i in range(1, arms):
        out[:, i, :k] += full[:, k * i : k * (i + 1)]
    return out


# --- models -------------------------------------------------------------------------------


class Fitted(Protocol):
    n_parameters: int

    def with_values(self, df: DataFrame, name: str, a1: str | None = None) -> DataFrame: ...


class StageModel(Protocol):
    """[UDF-5] What fit_q takes as an argument for either stage."""

    def fit(self, df: DataFrame, stage: Stage, y: str) -> Fitted: ...


@dataclass
class LinearFit:
    """[ML-2, MSC-16..18] Values held to 0..1; coefficients of the contrast design, the intercept last."""

    stage: Stage
    coefficients: np.ndarray
    links: bool = False
    converged: bool = True

    @property
    def n_parameters(self) -> int:
        """The intercept counts for the linear model only."""
        return len(self.coefficients) - self.links

    def with_values(self, df: DataFrame, name: str, a1: str | None = None) -> DataFrame:
        w, links, arms = by_arm(np.asarray(self.coefficients)[None], len(self.stage.arms))[0], self.links, list(self.stage.arms)

        @F.pandas_udf("array<double>")
        def score(states: pd.Series) -> pd.Series:
            x = np.stack(states.to_numpy())
            raw = x @ w[:, :-1].T + w[:, -1]
            return pd.Series(list(np.clip(1 / (1 + np.exp(-np.clip(raw, -500, 500))) if links else raw, 0, 1)))

        return df.withColumn(name, F.map_from_arrays(F.array(*map(F.lit, arms)), score(self.stage.state(a1))))


def _width(df: DataFrame, stage: Stage) -> int:
    """The state's length, from one row."""
    one = df.select(F.size(stage.state(None)).alias("k")).first()
    if one is None:
        raise ValueError("no rows to fit")
    return one["k"]


@dataclass
class Ridge:
    """[ML-1] Sum of squares plus alpha times the squared coefficients; the intercept is free."""

    alpha: float = 1.0
    key: str = "encounter_id"

    def solve(self, rows: DataFrame, arms: int, width: int, weights: Weights) -> np.ndarray:
        """Coefficients for each weighting, from one pass."""
        gram, side = moments(rows, arms, width, weights).full()
        if not gram[:, -1, -1].any():
            raise ValueError("no rows to fit")
        penalty = np.eye(gram.shape[1]) * self.alpha
        penalty[-1, -1] = 0
        return np.stack([np.linalg.lstsq(g + penalty, s, rcond=None)[0] for g, s in zip(gram, side, strict=True)])

    links = False

    def fit(self, df: DataFrame, stage: Stage, y: str) -> LinearFit:
        return LinearFit(stage, self.solve(_inputs(df, stage, y, self.key), len(stage.arms), _width(df, stage), Same())[0])


@dataclass
class Logistic:
    """[ML-1] Sum of logistic losses plus alpha / 2 times the squared coefficients of features scaled by their standard deviations.

    A pass a Newton step, all weightings together; a step that makes the objective worse is
    halved. Ends when no coefficient would move by 1e-8, or after max_steps, which is warned
    of and kept in ``converged``.
    """

    alpha: float = 1.0
    key: str = "encounter_id"
    max_steps: int = 40
    links: bool = field(default=True, init=False)
    converged: bool = field(default=True, init=False)

    def solve(self, rows: DataFrame, arms: int, width: int, weights: Weights) -> np.ndarray:
        gram, _ = moments(rows, arms, width, weights).full()
        n = gram[:, -1, -1]
        if not n.any():
            raise ValueError("no rows to fit")
        safe = np.where(n > 0, n, 1)
        var = np.diagonal(gram, axis1=1, axis2=2)[:, :-1] / safe[:, None] - (gram[:, -1, :-1] / safe[:, None]) ** 2
        sd = np.sqrt(np.maximum(var, 0))
        scale = np.concatenate([np.where(sd > 1e-12, 1 / np.where(sd > 1e-12, sd, 1), 0), np.ones((len(n), 1))], axis=1)
        w, penalty = np.zeros(scale.shape), np.eye(scale.shape[1]) * self.alpha
        penalty[-1, -1] = 0
        step, share, best = np.zeros_like(w), np.ones(len(w)), np.full(len(w), np.inf)
        self.converged = False
        for _ in range(self.max_steps):
            trial = w + share[:, None] * step
            sums = moments(rows, arms, width, weights, by_arm(trial * scale, arms))
            hess, grad = sums.full()
            moved = 0.0
            for b in np.flatnonzero(n):
                now = sums.rows[b].sum() + 0.5 * trial[b] @ penalty @ trial[b]
                if now > best[b] + 1e-9 * abs(best[b]):
                    share[b] /= 2
                else:
                    w[b], best[b], share[b] = trial[b], now, 1.0
                    step[b] = np.linalg.solve(hess[b] * scale[b][:, None] * scale[b][None, :] + penalty + 1e-9 * np.eye(len(penalty)), grad[b] * scale[b] - penalty @ w[b])
                moved = max(moved, float(share[b] * np.abs(step[b]).max()))
            if moved < 1e-8:
                self.converged = True
                break
        if not self.converged:
            warnings.warn(f"logistic fit: still moving by {moved:.1e} after {self.max_steps} steps", stacklevel=2)
        return w * scale

    def fit(self, df: DataFrame, stage: Stage, y: str) -> LinearFit:
        rows = _inputs(df, stage, y, self.key).persist()  # read once a step; recomputed if lost
        try:
            w = self.solve(rows, len(stage.arms), _width(df, stage), Same())[0]
        finally:
            rows.unpersist()
        return LinearFit(stage, w, links=True, converged=self.converged)


@dataclass
class CellMeans:
    """The saturated model: the mean outcome of each cell and arm, rounded so that ties are ties on any cluster.

    A cell without rows of an arm takes the arm's mean, an arm without rows the mean of all.
    by: the cell's columns; A1 among them is what a counterfactual changes.
    """

    by: Sequence[str]
    places: int = 9

    def fit(self, df: DataFrame, stage: Stage, y: str) -> CellFit:
        seen = df.where(F.col(y).isNotNull() & F.col(stage.arm).isin(*stage.arms))
        means = seen.groupBy(*self.by, F.col(stage.arm).alias("arm_")).agg(F.sum(F.col(y).cast("double")).alias("s_"), F.count("*").alias("c_"))
        mean = lambda s, c: F.round(s / c, self.places)
        cells = shared.kept(means.groupBy(*self.by).agg(F.map_from_entries(F.collect_list(F.struct("arm_", mean(F.col("s_"), F.col("c_"))))).alias("own_")), "cells")  # a row a cell, an entry an arm
        arms = means.groupBy("arm_").agg(F.sum("s_").alias("s_"), F.sum("c_").alias("c_")).collect()  # a row an arm
        if not arms:
            raise ValueError("no rows to fit")
        whole = round(sum(r["s_"] for r in arms) / sum(r["c_"] for r in arms), self.places)
        return CellFit(stage, tuple(self.by), cells, cells.count(), {r["arm_"]: round(r["s_"] / r["c_"], self.places) for r in arms}, whole)


@dataclass
class CellFit:
    stage: Stage
    by: tuple[str, ...]
    cells: DataFrame
    n_cells: int
    arm_means: dict[str, float]
    mean: float

    @property
    def n_parameters(self) -> int:
        return self.n_cells * len(self.stage.arms)

    def with_values(self, df: DataFrame, name: str, a1: str | None = None) -> DataFrame:
        table = self.cells.select(*[F.col(c).alias(f"{c}_cell") for c in self.by], "own_")
        mine = lambda c: F.lit(a1) if c == "A1" and a1 is not None else F.col(c)
        same = F.lit(True)
        for c in self.by:
            same = same & mine(c).eqNullSafe(F.col(f"{c}_cell"))
        out = df.join(F.broadcast(table) if self.n_cells <= MAX_CELLS else table, same, "left")
        value = [F.coalesce(F.try_element_at("own_", F.lit(a)), F.lit(float(self.arm_means.get(a, self.mean)))) for a in self.stage.arms]
        return out.withColumn(name, F.map_from_arrays(F.array(*map(F.lit, self.stage.arms)), F.array(*value))).drop("own_", *[f"{c}_cell" for c in self.by])
