import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.plans import encounters, policy, queries
from caseloom.plans import estimators as est
from caseloom.sources import schemas
from tests import simulated


def test_ridge_matches_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)], "x array<double>, y double")
    z = np.column_stack([x, np.ones(200)])
    want = np.linalg.solve(z.T @ z + np.diag([1, 1, 1, 0]), z.T @ y)
    assert np.allclose(policy.ridge(df, F.col("x"), F.col("y")).weights, want)


def test_fit_respects_pools_and_value_is_the_mean(spark):
    df = simulated.simulate(spark, 120, 4)
    fit = policy.fit_q(df, use_logistic=False)
    got = fit.rules.toPandas()
    assert len(got) == 120 and set(got.loc[~got.R1_responder, "pi2"]) <= set(policy.OTHER_POOL)
    assert abs(got.value.mean() - fit.value) < 1e-12 and got.value.between(0, 1).all()
    assert policy.policy_of(fit, df).count() == 120


def test_one_hot_and_counterfactual(spark):
    df = policy.with_states(simulated.simulate(spark, 5, 1))
    r = df.select(policy.counterfactual("A1b").alias("c"), "s2", "s1").first()
    assert len(r["s1"]) == 11 and len(r["s2"]) == 22 and r["c"][-3:] == [0.0, 1.0, 0.0] and r["c"][:-3] == r["s2"][:-3]


def test_intervals(spark):
    df = simulated.simulate(spark, 60, 2).select("encounter_id", "Y")
    draws = policy.replicates(df, policy.Mean("Y"), 20)
    again = policy.replicates(df.repartition(7), policy.Mean("Y"), 20)
    assert sorted(map(tuple, draws.collect())) == sorted(map(tuple, again.collect()))
    r = policy.interval(draws, 0.4).first()
    assert r["low"] <= r["high"] and r["n_draws"] == 20


def test_literacy_fallbacks(spark):
    blocks = [
        {"vocabulary_register": "Functional "}, {"language_level": "advanced"}, {}, {"persona_id": "low_literacy", "vocabulary_register": "critical"}, {"persona_id": "literacy_X"},
        {"persona_id": "random", "axes": '{"jargon_comprehension": "interactive"}'}, {"vocabulary_register": "plain"},
    ]
    df = spark.createDataFrame([(b,) for b in blocks], "p map<string,string>")
    want = ["literacy_F", "literacy_C", None, "literacy_F", "literacy_X", "literacy_I", None]
    assert [r[0] for r in df.select(encounters.literacy_of(F.col("p"))).collect()] == want
    assert [r[0] for r in df.select(encounters.literacy_of(F.lit(None).cast("map<string,string>"), F.col("p"))).collect()] == want


def test_state_levels(spark):
    df = spark.createDataFrame([("Neuro",), (" Pulmonology",), ("Psychiatry",), (None,)], "case_category string").withColumn("literacy_id", F.lit(None).cast("string")).withColumn("chief_complaint", F.lit("ab"))
    got = [r.asDict() for r in df.select(*encounters.state1()).collect()]
    assert [[k for k, v in r.items() if v] for r in got] == [[f"cat_{c}", "chief_complaint_len"] for c in ("Neurology", "Pulmonology", "Other", "Other")]


def contrast(frame, arm, arms, alpha=1.0):
    """Ridge coefficients of the contrast design, by brute force."""
    x = np.stack(frame["s2"].to_numpy())
    z = np.column_stack([x, *[x * (frame[arm] == a).to_numpy()[:, None] for a in arms[1:]], np.ones(len(x))])
    return np.linalg.solve(z.T @ z + np.diag([alpha] * (z.shape[1] - 1) + [0]), z.T @ frame["Y"].to_numpy(float))


def best_value(frame, w):
    k, best = 22, []
    for _, r in frame.iterrows():
        values = []
        for i in range(3):
            x = np.array([*r["s2"][:-3], *np.eye(3)[i]])
            for j in range(3 if r["R1_responder"] else 2):
                values.append(np.clip(x @ w[:k] + (x @ w[k * j : k * (j + 1)] if j else 0) + w[-1], 0, 1))
        best.append(max(values))
    return np.array(best)


def test_weighted_sums_are_the_fits_of_resamples_and_folds(spark):
    df = simulated.simulate(spark, 150, 6)
    frame = policy.with_states(df).toPandas()
    inside = policy.PolicyValue(est.Ridge())
    assert abs(inside.values(df, est.Same())[0] - policy.fit_q(df, use_logistic=False).value) < 1e-9
    assert abs(policy.PolicyValue(est.Logistic()).values(df, est.Same())[0] - policy.fit_q(df).value) < 1e-6
    words = np.array([[int(hashlib.sha256(e.encode()).hexdigest()[a : a + 8], 16) for a in (0, 8)] for e in frame.encounter_id])
    draw, fold = est.Resamples(3, 0.8, 7), est.Folds(4, 1)
    times, of = draw.fit(words).astype(int), fold.of(words)
    got, crossed = inside.values(df, draw), policy.PolicyValue(est.Ridge(), fold).values(df, draw)
    for b in range(3):
        again = frame.loc[np.repeat(np.arange(len(frame)), times[:, b])]
        assert abs(got[b] - best_value(again, contrast(again, "A2", schemas.A2_ARMS)).mean()) < 1e-6
        values = []
        for k in range(4):
            own = np.repeat(of, times[:, b]) == k
            values.append(best_value(again[own], contrast(again[~own], "A2", schemas.A2_ARMS)))
        assert abs(crossed[b] - np.concatenate(values).mean()) < 1e-6
    assert 0 < policy.cross_fitted_value(df) < 1


def test_poisson_weights_have_the_distribution(spark):
    words = np.array([[int(hashlib.sha256(str(i).encode()).hexdigest()[a : a + 8], 16) for a in (0, 8)] for i in range(20_000)])
    w = est.Resamples(4, 1.0, 3).fit(words)
    assert np.allclose(w.mean(0), 1, atol=0.03) and np.allclose(w.var(0), 1, atol=0.06) and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(w.T) - np.eye(4)).max() < 0.03
    assert abs(est.Resamples(1, 0.05).fit(words).mean() - 0.05) < 0.01


def test_logistic_ends_where_the_gradient_is_zero(spark):
    df = simulated.simulate(spark, 150, 8)
    fit = est.Logistic().fit(policy.with_states(df), policy.STAGE2, "Y")
    frame = policy.with_states(df).toPandas()
    x = np.stack(frame["s2"].to_numpy())
    z = np.column_stack([x, *[x * (frame["A2"] == a).to_numpy()[:, None] for a in schemas.A2_ARMS[1:]]])
    sd = z.std(axis=0)
    w = np.asarray(fit.coefficients)
    resid = frame["Y"].to_numpy(float) - 1 / (1 + np.exp(-(z @ w[:-1] + w[-1])))
    keep = sd > 1e-9
    assert fit.converged and abs(resid.sum()) < 1e-5 and np.abs((z / np.where(keep, sd, 1)).T @ resid - w[:-1] * sd)[keep].max() < 1e-4
    with pytest.warns(UserWarning, match="still moving"):
        assert not est.Logistic(max_steps=1).fit(policy.with_states(df), policy.STAGE2, "Y").converged
    assert fit.n_parameters == 66 and est.Ridge().fit(policy.with_states(df), policy.STAGE2, "Y").n_parameters == 67


class Favourite:
    """A stage model that likes one arm."""

    def __init__(self, arm):
        self.arm, self.n_parameters = arm, 0

    def fit(self, df, stage, y):
        self.stage = stage
        return self

    def with_values(self, df, name, a1=None):
        return df.withColumn(name, F.map_from_arrays(F.array(*map(F.lit, self.stage.arms)), F.array(*[F.lit(0.9 if a == self.arm else 0.2) for a in self.stage.arms])))


def test_stage_models_are_arguments(spark):
    df = simulated.simulate(spark, 60, 3)
    fit = policy.fit_q(df, stage2=Favourite("A2c"), stage1=Favourite("A1b"))
    rules = fit.rules.toPandas()
    assert set(rules.loc[rules.R1_responder, "pi2"]) == {"A2c"} and set(rules.loc[~rules.R1_responder, "pi2"]) == {"A2a"}
    assert {r["pi1"] for r in policy.policy_of(fit, df).collect()} == {"A1b"} and {r["pi2"] for r in policy.policy_of(fit, df).collect()} == {"A2c"}


def test_cell_means_and_fixed_pairs(spark):
    df = simulated.simulate(spark, 200, 5)
    fit = policy.fit_q(df, stage2=est.CellMeans(("case_category", "R1_responder", "A1")), stage1=est.CellMeans(("case_category",)))
    f = df.toPandas()
    cell = f.groupby(["case_category", "R1_responder", "A1", "A2"]).Y.mean().round(9).to_dict()
    arm = f.groupby("A2").Y.mean().round(9).to_dict()
    q = lambda c, r, a, b: cell.get((c, r, a, b), arm[b])
    for x in fit.rules.collect():
        open_ = policy.RESPONDER_POOL if x["R1_responder"] else policy.OTHER_POOL
        at = lambda a, x=x, open_=open_: [q(x["case_category"], x["R1_responder"], a, b) for b in open_]
        assert x["pi2"] == open_[int(np.argmax(at(x["A1"])))] and abs(x["value"] - max(max(at(a)) for a in schemas.A1_ARMS)) < 1e-9
        assert x["pi1"] == schemas.A1_ARMS[int(np.argmax([max(at(a)) for a in schemas.A1_ARMS]))]
    for r in policy.static_values(df, fit).collect():
        rows = f[f.R1_responder] if r["A2"] == "A2c" else f
        want = np.mean([q(c, s, r["A1"], r["A2"]) for c, s in zip(rows.case_category, rows.R1_responder, strict=True)])
        assert abs(r["value"] - want) < 1e-9 and abs(policy.value_of_pair(df, fit.q2, r["A1"], r["A2"]).first()["value"] - want) < 1e-9
    assert 0 < policy.cross_fitted_value(df, stage2=est.CellMeans(("case_category", "A1"))) < 1
    assert policy.sweep(fit, df, "R1_responder", [True, False]).count() == 6


def test_advantages_are_those_of_brute_force(spark):
    df = simulated.simulate(spark, 160, 9)
    f = policy.with_states(df).toPandas()
    pools = [policy.RESPONDER_POOL if r else policy.OTHER_POOL for r in f.R1_responder]

    def stage(h, arms, levels, y, share):
        h = np.stack(h.to_numpy())
        ref = (arms == levels[0]).to_numpy()
        own = ref if ref.sum() >= max(h.shape[1], 3) else np.ones(len(h), bool)
        nu = np.linalg.lstsq(h[own], y[own], rcond=None)[0]
        out = {levels[0]: h @ nu}
        for a in levels[1:]:
            z = (arms == a).to_numpy(float) - share(a)
            m = np.abs(z) > 1e-6
            x, t = h[m] * z[m, None], (y - h @ nu)[m]
            xc = x - x.mean(0)
            out[a] = h @ nu + h @ np.linalg.solve(xc.T @ xc + np.eye(h.shape[1]), xc.T @ (t - t.mean()))
        return out

    v2 = stage(f["s2"], f["A2"], schemas.A2_ARMS, f["Y"].to_numpy(float), lambda a: np.array([a in p and 1 / len(p) for p in pools], float))
    after = np.array([max(v2[a][i] for a in p) for i, p in enumerate(pools)])
    v1 = stage(f["s1"], f["A1"], schemas.A1_ARMS, after, lambda a: np.full(len(f), 1 / 3))
    want = {e: (max(schemas.A1_ARMS, key=lambda a: v1[a][i]), max(pools[i], key=lambda a: v2[a][i]), max(v1[a][i] for a in schemas.A1_ARMS)) for i, e in enumerate(f.encounter_id)}
    got = policy.fit_a(df).collect()
    assert len(got) == len(want)
    for r in got:
        pi1, pi2, value = want[r["encounter_id"]]
        assert (r["pi1"], r["pi2"]) == (pi1, pi2) and abs(r["value"] - value) < 1e-6
    other = policy.fit_a(df, share2=lambda a: F.lit(0.0)).count()  # propensities are arguments
    assert other == len(want)


def test_policies_read_every_event(spark):
    d = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{d}/events.parquet")
    rows = policy.of_events(events)
    assert rows.agg({"R1_total": "sum"}).first()[0] + rows.count() == events.count()
    got = queries.policy_rules(spark, d).toPandas()
    assert got.n.sum() == events.select("user_id").distinct().count()


def test_the_optimum_is_recovered_more_often_with_more_rows(spark):
    out = simulated.recovery(spark, (40, 400), 2)
    assert [(r["n"], r["repeat"]) for r in out] == [(40, 0), (40, 1), (400, 0), (400, 1)] and all(r["error"] is None for r in out)
    assert sum(r["agree_2"] for r in out[2:]) > 1.0
