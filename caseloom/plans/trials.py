"""Registered queries of the trial's own results: logged encounters, their summary, and policies whose fits have a closed form.

Encounters are made of the events by rule, the same in both languages, with the nesting,
the run modes and the gaps of real logs, so that flattening, completion and lookups run on
the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import metrics
from caseloom.plans import estimators as est
from caseloom.plans import policy, summary
from caseloom.plans.queries import query, t
from caseloom.sources import schemas

_NAMES = (*schemas.CATEGORIES, "Surgery")
_BY_USER = ("case_category", "R1_responder", "A1")


def encounters_of_events(events: DataFrame) -> DataFrame:
    """Each event as a logged encounter of its user's case.

    The run mode, the arms, the responder flag and which of path id and forced arms are
    there follow from the event's number, the outcome from its value (one in eleven is null).
    Turns are nested: three of stage 1, two of stage 2. A user's category is one of nine, the
    last unknown to the summary.
    """
    i = F.col("event_id")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    mode = F.when(i % 10 == 0, summary.BASELINE).when(i % 10 == 1, summary.LOOP).otherwise(summary.GRID)
    a1, a2 = pick(schemas.A1_ARMS, F.floor(i / 10) % 3), pick(schemas.A2_ARMS, F.floor(i / 30) % 3)
    none = F.lit(None).cast("string")
    total = (i % 11).cast("int")
    part = lambda k: ((i + k) % 3).cast("int")
    turn = lambda n, stage, arm: F.struct(F.lit(n).alias("turn"), F.lit(stage).alias("stage"), arm.alias("arm"), F.lit("d").alias("doctor"), F.lit("p").alias("patient"), F.lit(0.5).alias("confidence"))
    return events.select(
        F.concat(F.lit("e"), i).alias("encounter_id"), F.concat(F.lit("case_"), "user_id").alias("case_id"), pick(_NAMES, F.col("user_id") % len(_NAMES)).alias("case_category"), F.coalesce("event_type", F.lit("")).alias("chief_complaint"),
        F.lit(0).alias("seed"), mode.alias("run_mode"), a1.alias("stage1_arm"), a2.alias("stage2_arm"), F.when(i % 4 != 0, F.concat_ws("_", a1, a2)).otherwise(none).alias("path_id"), F.when(i % 4 != 1, a1).otherwise(none).alias("forced_a1"), F.when(i % 4 != 1, a2).otherwise(none).alias("forced_a2"),
        F.when(total >= 6, "responder").otherwise("non-responder").alias("stage2_pool"),
        F.struct(total.alias("total"), (total >= 6).alias("responder"), *[part(k).alias(n) for k, n in enumerate(("OPQRST", "red_flags", "past_medical_history", "medications_allergies", "social_family_history"))]).alias("R1"),
        F.struct(F.lit(0.5).alias("final_confidence"), F.lit(0.5).alias("avg_confidence"), F.lit("low").alias("confidence_level")).alias("R2"),
        F.struct(F.when(i % 11 != 3, F.coalesce("value", F.lit(0.0)) > 50).alias("diag_correct"), F.lit(False).alias("red_flag_miss"), F.lit(False).alias("dangerous_advice")).alias("outcome"),
        F.create_map(F.lit("persona_id"), F.lit("default")).alias("persona"), F.lit(None).cast("map<string,string>").alias("literacy_persona"), F.array(*[turn(n, 1, a1) for n in (1, 2, 3)], *[turn(n, 2, a2) for n in (4, 5)]).alias("trajectory"), i.alias("seq"),
    )


_LOG = f"""l AS (SELECT event_id AS seq, 'case_' || user_id AS case_id, list_extract([{", ".join(f"'{c}'" for c in _NAMES)}], CAST(user_id % {len(_NAMES)} + 1 AS INTEGER)) AS raw, CASE event_id % 10 WHEN 0 THEN '{summary.BASELINE}' WHEN 1 THEN '{summary.LOOP}' ELSE '{summary.GRID}' END AS run_mode,
  list_extract(['A1a', 'A1b', 'A1c'], CAST((event_id // 10) % 3 + 1 AS INTEGER)) AS A1, list_extract(['A2a', 'A2b', 'A2c'], CAST((event_id // 30) % 3 + 1 AS INTEGER)) AS A2, event_id % 11 >= 6 AS R1_responder, CASE WHEN event_id % 11 <> 3 THEN coalesce(value, 0) > 50 END AS ok
  FROM events WHERE 'case_' || user_id IN (SELECT 'case_' || c_custkey FROM customer)),
r AS (SELECT *, CASE WHEN raw = 'Surgery' THEN 'Other' ELSE raw END AS cat FROM l)"""
#: Backward induction on cell means over f(case_category, R1_responder, A1, A2, Y): q2, q1, and the rule of every cell of category and responder (h).
_SATURATED = """
arms1 AS (SELECT unnest(['A1a', 'A1b', 'A1c']) AS A1), arms2 AS (SELECT unnest(['A2a', 'A2b', 'A2c']) AS A2),
c2 AS (SELECT case_category, R1_responder, A1, A2, round(sum(Y) / count(*), 9) AS v FROM f GROUP BY ALL), m2 AS (SELECT A2, round(sum(Y) / count(*), 9) AS v FROM f GROUP BY 1), w2 AS (SELECT round(sum(Y) / count(*), 9) AS v FROM f),
k AS (SELECT DISTINCT case_category, R1_responder FROM f UNION SELECT DISTINCT case_category, NOT R1_responder FROM f),
q2 AS (SELECT k.*, arms1.A1, arms2.A2, coalesce(c2.v, m2.v, w2.v) AS v FROM k CROSS JOIN arms1 CROSS JOIN arms2 CROSS JOIN w2 LEFT JOIN c2 ON c2.case_category = k.case_category AND c2.R1_responder = k.R1_responder AND c2.A1 = arms1.A1 AND c2.A2 = arms2.A2 LEFT JOIN m2 ON m2.A2 = arms2.A2),
b2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_category, R1_responder, A1 ORDER BY v DESC, A2) AS i FROM q2 WHERE R1_responder OR A2 <> 'A2c') WHERE i = 1),
aft AS (SELECT f.*, b2.v AS aft FROM f JOIN b2 USING (case_category, R1_responder, A1)),
c1 AS (SELECT case_category, A1, round(sum(aft) / count(*), 9) AS v FROM aft GROUP BY ALL), m1 AS (SELECT A1, round(sum(aft) / count(*), 9) AS v FROM aft GROUP BY 1), w1 AS (SELECT round(sum(aft) / count(*), 9) AS v FROM aft),
q1 AS (SELECT g.case_category, arms1.A1, coalesce(c1.v, m1.v, w1.v) AS v FROM (SELECT DISTINCT case_category FROM f) g CROSS JOIN arms1 CROSS JOIN w1 LEFT JOIN c1 ON c1.case_category = g.case_category AND c1.A1 = arms1.A1 LEFT JOIN m1 ON m1.A1 = arms1.A1),
h AS (SELECT * FROM (SELECT case_category, R1_responder, A1 AS pi1, v, row_number() OVER (PARTITION BY case_category, R1_responder ORDER BY v DESC, A1) AS i FROM b2) WHERE i = 1)"""


@query(f"""WITH {_LOG},
f AS (SELECT seq, case_id, raw AS case_category, R1_responder, A1, A2, CAST(ok AS INTEGER) AS Y FROM r WHERE run_mode = '{summary.GRID}' AND ok IS NOT NULL), {_SATURATED},
fst AS (SELECT case_id, arg_min(case_category, seq) AS case_category FROM f GROUP BY 1),
p1 AS (SELECT * FROM (SELECT case_id, q1.A1 AS pi1, row_number() OVER (PARTITION BY case_id ORDER BY v DESC, q1.A1) AS i FROM fst JOIN q1 USING (case_category)) WHERE i = 1),
ref AS (SELECT * FROM (SELECT f.case_id, f.case_category, f.R1_responder, pi1, row_number() OVER (PARTITION BY f.case_id ORDER BY f.A1 <> pi1, seq) AS i FROM f JOIN p1 USING (case_id)) WHERE i = 1),
p2 AS (SELECT * FROM (SELECT case_id, pi1, q2.A2 AS pi2, row_number() OVER (PARTITION BY case_id ORDER BY v DESC, q2.A2) AS i FROM ref JOIN q2 ON q2.case_category = ref.case_category AND q2.R1_responder = ref.R1_responder AND q2.A1 = pi1) WHERE i = 1),
hit AS (SELECT case_id, A1 AS pi1, A2 AS pi2, arg_max(CAST(ok AS INTEGER), seq) AS y FROM r WHERE run_mode = '{summary.GRID}' AND ok IS NOT NULL GROUP BY 1, 2, 3),
fc AS (SELECT case_id, arg_min(cat, (CASE WHEN run_mode = '{summary.BASELINE}' THEN 0 ELSE 1 END, seq)) AS cat FROM r WHERE run_mode <> '{summary.LOOP}' GROUP BY 1),
ad AS (SELECT c.case_id, cat, y FROM (SELECT 'case_' || c_custkey AS case_id FROM customer) c LEFT JOIN fc USING (case_id) LEFT JOIN p2 USING (case_id) LEFT JOIN hit USING (case_id, pi1, pi2)),
cats AS (SELECT unnest([{", ".join(f"'{c}'" for c in schemas.CATEGORIES)}]) AS cat), pairs AS (SELECT * FROM arms1, arms2),
vh AS (SELECT avg(h.v) AS v FROM f JOIN h USING (case_category, R1_responder)),
g AS (SELECT * FROM r WHERE run_mode = '{summary.GRID}'),
o AS (SELECT 'baseline' AS metric, 'baseline' AS strategy, NULL AS path_id, NULL AS A1, NULL AS A2, NULL AS cat, count(*) AS n, avg(ok::INT) AS y, NULL AS vh, NULL AS miss FROM r WHERE run_mode = '{summary.BASELINE}'
UNION ALL SELECT 'category_baseline', 'baseline', NULL, NULL, NULL, cats.cat, count(seq), avg(ok::INT), NULL, NULL FROM cats LEFT JOIN r ON r.cat = cats.cat AND run_mode = '{summary.BASELINE}' GROUP BY cats.cat
UNION ALL SELECT 'static_path', p.A1 || '->' || p.A2, p.A1 || '_' || p.A2, p.A1, p.A2, NULL, count(seq), avg(ok::INT), NULL, NULL FROM pairs p LEFT JOIN g USING (A1, A2) GROUP BY p.A1, p.A2
UNION ALL SELECT 'category_static_path', p.A1 || '->' || p.A2, p.A1 || '_' || p.A2, p.A1, p.A2, cats.cat, count(seq), avg(ok::INT), NULL, NULL FROM pairs p CROSS JOIN cats LEFT JOIN g ON g.A1 = p.A1 AND g.A2 = p.A2 AND g.cat = cats.cat GROUP BY p.A1, p.A2, cats.cat
UNION ALL SELECT 'qlearning_adaptive', 'pi_hat', NULL, NULL, NULL, NULL, count(y), avg(y), any_value(vh.v), count(*) - count(y) FROM ad, vh
UNION ALL SELECT 'category_adaptive', 'pi_hat', NULL, NULL, NULL, cats.cat, count(y), avg(y), NULL, count(case_id) - count(y) FROM cats LEFT JOIN ad ON ad.cat = cats.cat GROUP BY cats.cat
UNION ALL SELECT 'closed_loop_adaptive', 'pi_hat_online', NULL, NULL, NULL, NULL, count(*), avg(ok::INT), NULL, NULL FROM r WHERE run_mode = '{summary.LOOP}'
UNION ALL SELECT 'category_closed_loop_adaptive', 'pi_hat_online', NULL, NULL, NULL, cats.cat, count(seq), avg(ok::INT), NULL, NULL FROM cats LEFT JOIN r ON r.cat = cats.cat AND run_mode = '{summary.LOOP}' GROUP BY cats.cat)
SELECT metric, strategy, path_id, A1 AS forced_a1, A2 AS forced_a2, cat AS case_category, n, round(y, 9) AS avg_correctness, round(vh, 6) AS "V_hat_in_sample", CAST(miss AS BIGINT) AS cases_missing_path, CAST(NULL AS VARCHAR) AS error FROM o""")
def summary_metrics(spark: SparkSession, d: str) -> DataFrame:
    """MSC-10, AGG-2, AGG-4..9, SET-2, FLT-2..6, PRJ-1, ML-13: the 108 rows over an encounter per event, cases of all customers, the policy fitted on cell means."""
    cases = t(spark, d, "customer").select(F.concat(F.lit("case_"), "c_custkey").alias("case_id"))
    out = summary.summary_table(encounters_of_events(t(spark, d, "events")), cases, cases, stage2=summary.CELLS2, stage1=summary.CELLS1)
    return out.withColumns({"avg_correctness": F.round("avg_correctness", 9), "V_hat_in_sample": F.round("V_hat_in_sample", 6)})


_FLAT = """u AS (SELECT user_id, arg_min(type, event_id) AS ft, arg_max(type, event_id) AS lt, arg_max(v, event_id) AS lv, count(*) AS n, sum(v) AS total, count(*) FILTER (type = 'click') AS s1, count(*) FILTER (type = 'error') AS s2, count(*) FILTER (type = 'purchase') AS s3,
  count(*) FILTER (type = 'signup') AS s4, count(*) FILTER (type = 'view') AS s5 FROM (SELECT *, coalesce(event_type, '') AS type, coalesce(value, 0) AS v FROM events) GROUP BY 1),
b AS (SELECT user_id, ft, lt, lv, n, total, s1 - (lt = 'click')::INT AS s1, s2 - (lt = 'error')::INT AS s2, s3 - (lt = 'purchase')::INT AS s3, s4 - (lt = 'signup')::INT AS s4, s5 - (lt = 'view')::INT AS s5 FROM u),
a AS (SELECT 'e' || user_id AS encounter_id, CASE WHEN s1 >= greatest(s2, s3, s4, s5) THEN 'Cardiology' WHEN s2 >= greatest(s3, s4, s5) THEN 'Neuro' WHEN s3 >= greatest(s4, s5) THEN 'GI' WHEN s4 >= s5 THEN 'Pulm' ELSE 'Infectious' END AS case_category,
  CASE WHEN ft IN ('click', 'error') THEN 'A1a' WHEN ft IN ('purchase', 'signup') THEN 'A1b' ELSE 'A1c' END AS A1, coalesce((total - lv) / nullif(n - 1, 0) >= 50, false) AS R1_responder, CASE WHEN lt IN ('click', 'error') THEN 'A2a' WHEN lt IN ('purchase', 'signup') THEN 'A2b' ELSE 'A2c' END AS raw2, (lv > 50)::INT AS Y FROM b),
f AS (SELECT encounter_id, case_category, R1_responder, A1, CASE WHEN raw2 = 'A2c' AND NOT R1_responder THEN 'A2a' ELSE raw2 END AS A2, Y FROM a)"""


def _fit(spark: SparkSession, d: str) -> tuple[DataFrame, policy.Fit]:
    df = policy.of_events(t(spark, d, "events"))
    return df, policy.fit_q(df, stage2=est.CellMeans(_BY_USER), stage1=est.CellMeans(("case_category",)))


@query(f"""WITH {_FLAT}, {_SATURATED},
x AS (SELECT f.case_category, f.R1_responder, h.pi1, h.v, b2.A2 AS pi2 FROM f JOIN h USING (case_category, R1_responder) JOIN b2 ON b2.case_category = f.case_category AND b2.R1_responder = f.R1_responder AND b2.A1 = f.A1),
p AS (SELECT * FROM (SELECT case_category, R1_responder, pi2, row_number() OVER (PARTITION BY case_category, R1_responder ORDER BY count(*) DESC, pi2) AS i FROM x GROUP BY 1, 2, 3) WHERE i = 1)
SELECT case_category, R1_responder, count(*) AS n, round(avg(v), 6) AS mean_value, any_value(pi1) AS modal_pi1, any_value(p.pi2) AS modal_pi2 FROM x JOIN p USING (case_category, R1_responder) GROUP BY 1, 2""")
def saturated_policy(spark: SparkSession, d: str) -> DataFrame:
    """ML-3..5, UDF-5, AGG-12: rules of cell means over a row per user of all events, summarised by category and responder."""
    _, fit = _fit(spark, d)
    keys = ["case_category", "R1_responder"]
    out = fit.rules.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    for p in ("pi1", "pi2"):
        out = out.join(metrics.modal(p, keys, fit.rules), keys)
    return out


@query(f"""WITH {_FLAT}, {_SATURATED}, vh AS (SELECT avg(h.v) AS v FROM f JOIN h USING (case_category, R1_responder))
SELECT q2.A1, q2.A2, round(avg(q2.v), 6) AS value, round(any_value(vh.v) - avg(q2.v), 6) AS gain FROM vh, f JOIN q2 ON q2.case_category = f.case_category AND q2.R1_responder = f.R1_responder AND (f.R1_responder OR q2.A2 <> 'A2c') GROUP BY 1, 2""")
def fixed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """ML-6, JN-14, SRT-5: the nine pairs of arms and how far the policy is above each."""
    df, fit = _fit(spark, d)
    return policy.static_values(df, fit).withColumns({"value": F.round("value", 6), "gain": F.round("gain", 6)})


@query(f"""WITH {_FLAT}, {_SATURATED}
SELECT s.R1_responder, q2.A2 AS arm, round(avg(q2.v), 6) AS value FROM (SELECT unnest([false, true]) AS R1_responder) s CROSS JOIN f JOIN q2 ON q2.case_category = f.case_category AND q2.R1_responder = s.R1_responder AND q2.A1 = f.A1 GROUP BY 1, 2""")
def responder_sweep(spark: SparkSession, d: str) -> DataFrame:
    """INF-7: mean value of each stage-2 arm as the responder flag takes either value."""
    df, fit = _fit(spark, d)
    return policy.sweep(fit, df, "R1_responder", [False, True]).withColumn("value", F.round("value", 6))


@query(f"""WITH {_FLAT}, z AS (SELECT *, CAST(CAST('0x' || substr(sha256('0:' || encounter_id), 1, 16) AS UBIGINT) % 5 AS INTEGER) AS fold FROM f), folds AS (SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INTEGER) AS k),
tr AS (SELECT k, z.* FROM folds JOIN z ON fold <> k), arms1 AS (SELECT unnest(['A1a', 'A1b', 'A1c']) AS A1), arms2 AS (SELECT unnest(['A2a', 'A2b', 'A2c']) AS A2),
c2 AS (SELECT k, case_category, R1_responder, A1, A2, round(sum(Y) / count(*), 9) AS v FROM tr GROUP BY ALL), m2 AS (SELECT k, A2, round(sum(Y) / count(*), 9) AS v FROM tr GROUP BY ALL), w2 AS (SELECT k, round(sum(Y) / count(*), 9) AS v FROM tr GROUP BY 1),
best AS (SELECT z.encounter_id, max(coalesce(c2.v, m2.v, w2.v)) AS v FROM z JOIN w2 ON w2.k = z.fold CROSS JOIN arms1 CROSS JOIN arms2 LEFT JOIN c2 ON c2.k = fold AND c2.case_category = z.case_category AND c2.R1_responder = z.R1_responder AND c2.A1 = arms1.A1 AND c2.A2 = arms2.A2 LEFT JOIN m2 ON m2.k = fold AND m2.A2 = arms2.A2
  WHERE z.R1_responder OR arms2.A2 <> 'A2c' GROUP BY 1)
SELECT round(avg(v), 6) AS value FROM best""")
def saturated_crossfit(spark: SparkSession, d: str) -> DataFrame:
    """ML-7, SET-7: mean value of each fold's best arms under cell means of the other four."""
    value = policy.cross_fitted_value(policy.of_events(t(spark, d, "events")), stage2=est.CellMeans(_BY_USER))
    return spark.createDataFrame([(value,)], "value double").withColumn("value", F.round("value", 6))


_BOOT, _RATE = 64, 1.0
_STEP = lambda x: f"((xor({x} >> 16, {x}) * 73244475) & 4294967295)"


@query(f"""WITH e AS (SELECT event_id, value, CAST('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) AS w1, CAST('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 9, 8) AS BIGINT) AS w2 FROM events WHERE value IS NOT NULL),
s AS (SELECT *, CAST(unnest(range({_BOOT})) AS BIGINT) AS b FROM e), x0 AS (SELECT *, (w1 + b * 2654435761) & 4294967295 AS x FROM s), x1 AS (SELECT *, {_STEP("x")} AS y FROM x0), x2 AS (SELECT *, {_STEP("y")} AS z FROM x1), x3 AS (SELECT *, xor(xor(z >> 16, z), w2) AS u FROM x2),
x4 AS (SELECT *, {_STEP("u")} AS y2 FROM x3), x5 AS (SELECT *, {_STEP("y2")} AS z2 FROM x4), x6 AS (SELECT b, value, xor(z2 >> 16, z2) AS r FROM x5),
w AS (SELECT b, value, {" + ".join(f"(r >= {int(k)})::INT" for k in est.poisson_steps(_RATE))} AS times FROM x6),
d AS (SELECT b, sum(times * value) / sum(times) AS draw FROM w GROUP BY 1), p AS (SELECT avg(value) AS point FROM events)
SELECT kind, round(any_value(point), 6) AS point, round(CASE kind WHEN 'percentile' THEN quantile_cont(draw, 0.025) ELSE 2 * any_value(point) - quantile_cont(draw, 0.975) END, 6) AS low,
  round(CASE kind WHEN 'percentile' THEN quantile_cont(draw, 0.975) ELSE 2 * any_value(point) - quantile_cont(draw, 0.025) END, 6) AS high, count(*) AS n_draws FROM d, p, (SELECT unnest(['percentile', 'projection']) AS kind) GROUP BY 1""")
def bootstrap_mean(spark: SparkSession, d: str) -> DataFrame:
    """INF-1, INF-3, UDF-4: intervals of the mean value of all events from 64 hashed resamples, in one pass."""
    e = t(spark, d, "events")
    draws = policy.replicates(e, policy.Mean("value", "event_id"), _BOOT)
    point = policy.Mean("value", "event_id").values(e, est.Same())[0]
    both = [policy.interval(draws, point, kind=k).withColumn("kind", F.lit(k)) for k in ("percentile", "projection")]
    return both[0].unionByName(both[1]).select("kind", *[F.round(c, 6).alias(c) for c in ("point", "low", "high")], "n_draws")
