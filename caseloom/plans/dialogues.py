"""Registered queries of ordered decisions and coverage over whole conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import text as fx
from caseloom.operators import folds
from caseloom.plans import encounters
from caseloom.plans.queries import query, t
from caseloom.streaming import coverage

_LIKES = ("1. Likes clicks", "Do you like views?", "", "Errs")


def _sql_form(c: str) -> str:
    return rf"rtrim(lower(ltrim(regexp_replace(regexp_replace({c}, '(?i)\[RETRIEVAL QUERY:[^\]]*\]\s*', '', 'g'), '\s+', ' ', 'g'))), '?.! ')"


_UNTOLD = "|".join(fx.UNINFORMATIVE).replace("'", "''")
_FREE = "({q} = '' OR (len(list_filter(f.asked, lambda x: x = {q})) < 2 AND NOT list_contains(f.refused, {q})))"
_POOL = ", ".join("'" + q.replace("'", "''") + "'" for q in folds.FALLBACKS)
_FACTS = "['Can you tell me whether this applies to you: Likes clicks?', 'Do you like views?', 'Can you tell me whether this applies to you: Errs?']"


@query(rf"""WITH RECURSIVE p AS (SELECT user_id AS conv, event_id AS turn, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, 'Is it a ' || event_type || '?' AS q0, '[Retrieval query: x] is it  A ' || event_type || ' ?!' AS q1, 'Any ' || event_type || ' ' || (event_id % 3) || '?' AS q2,
  CASE WHEN value < 40 THEN 'I don''t know, ' || props ELSE 'It was ' || value END AS reply FROM events),
n AS (SELECT *, {_sql_form("q0")} AS n0, {_sql_form("q1")} AS n1, {_sql_form("q2")} AS n2, regexp_matches(reply, '(?i){_UNTOLD}') OR trim(reply) = '' AS untold FROM p),
pool AS (SELECT [{_POOL}] AS qs, {_FACTS} AS fs), forms AS (SELECT qs, fs, list_transform(qs, lambda c: {_sql_form("c")}) AS qn, list_transform(fs, lambda c: {_sql_form("c")}) AS fn FROM pool),
f AS (SELECT DISTINCT conv, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS turn, CAST([] AS VARCHAR[]) AS asked, CAST([] AS VARCHAR[]) AS refused, '' AS q, '' AS reason FROM p
UNION ALL SELECT c.conv, c.k, c.turn, list_append(c.asked, c.own), CASE WHEN c.untold THEN list_append(list_filter(c.refused, lambda x: x <> c.own), c.own) ELSE list_filter(c.refused, lambda x: x <> c.own) END, c.q, c.reason FROM (
  SELECT b.conv, b.k, b.turn, b.asked, b.refused, b.untold,
   CASE WHEN b.ok0 THEN 'given' WHEN b.ok1 OR b.ok2 THEN 'llm_regen' WHEN b.fb IS NOT NULL THEN 'fallback_pool' WHEN b.ff IS NOT NULL THEN 'atomic_fact' ELSE 'exhausted' END AS reason,
   CASE WHEN b.ok0 THEN b.q0 WHEN b.ok1 THEN b.q1 WHEN b.ok2 THEN b.q2 WHEN b.fb IS NOT NULL THEN b.qs[b.fb] WHEN b.ff IS NOT NULL THEN b.fs[b.ff] ELSE b.q0 END AS q,
   CASE WHEN b.ok0 THEN b.n0 WHEN b.ok1 THEN b.n1 WHEN b.ok2 THEN b.n2 WHEN b.fb IS NOT NULL THEN b.qn[b.fb] WHEN b.ff IS NOT NULL THEN b.fn[b.ff] ELSE b.n0 END AS own FROM (
    SELECT f.conv, n.k, n.turn, f.asked, f.refused, n.untold, n.q0, n.q1, n.q2, n.n0, n.n1, n.n2, qs, fs, qn, fn, {_FREE.format(q="n.n0")} AS ok0, {_FREE.format(q="n.n1")} AS ok1, {_FREE.format(q="n.n2")} AS ok2,
     list_filter(list_transform(range(len(qs)), lambda i: CAST((n.k - 1 + i) % len(qs) + 1 AS BIGINT)), lambda j: len(list_filter(f.asked, lambda x: x = qn[j])) < 2 AND NOT list_contains(f.refused, qn[j]))[1] AS fb,
     list_filter(list_transform(range(len(fs)), lambda i: CAST((n.k - 1 + i) % len(fs) + 1 AS BIGINT)), lambda j: len(list_filter(f.asked, lambda x: x = fn[j])) < 2 AND NOT list_contains(f.refused, fn[j]))[1] AS ff
    FROM f JOIN n ON n.conv = f.conv AND n.k = f.k + 1 CROSS JOIN forms) b) c)
SELECT conv, turn, q AS asked, reason FROM f WHERE k > 0""")
def unique_questions(spark: SparkSession, d: str) -> DataFrame:
    """FN-36..38, WIN-3, WIN-4, WIN-10, FLT-18: a question proposed at each event of a user, replaced when it was asked or refused before."""
    kind = F.col("event_type")
    e = t(spark, d, "events").select(
        F.col("user_id").alias("conv"), F.col("event_id").alias("turn"), F.concat(F.lit("Is it a "), kind, F.lit("?")).alias("given"),
        F.array(F.concat(F.lit("[Retrieval query: x] is it  A "), kind, F.lit(" ?!")), F.concat(F.lit("Any "), kind, F.lit(" "), (F.col("event_id") % 3).cast("string"), F.lit("?"))).alias("regenerated"),
        F.when(F.col("value") < 40, F.concat(F.lit("I don't know, "), "props")).otherwise(F.concat(F.lit("It was "), F.col("value").cast("string"))).alias("reply"), F.array(*map(F.lit, _LIKES)).alias("facts"),
    )
    return folds.unique_questions(e, "conv", "turn").select("conv", "turn", "asked", "reason")


_FOUND = ("Culture shows growth", "Has a cough", "Fever for days", "Pain in the knee")


def _has(c: str, terms) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(c, x.lower().replace("'", "''")) for x in terms) + ")"


_DELTA = """SELECT conv_id, turn AS pos, CASE (conv_id + turn) % 9 WHEN 8 THEN 'x' ELSE CAST((conv_id + turn) % 9 - 1 AS VARCHAR) END AS index, CASE (conv_id + turn) % 7 WHEN 0 THEN 'not sure about that' WHEN 1 THEN 'yes' WHEN 2 THEN 'The CULTURE  showed growth' WHEN 3 THEN 'zebras quarrel quietly elsewhere'
  WHEN 4 THEN ' Not sure, but the culture showed growth ' ELSE coalesce(text, '') END AS evidence FROM conversations"""


@query(rf"""WITH c AS (SELECT conv_id, 'I am not sure, but the culture showed growth. ' || coalesce(string_agg(text, ' ' ORDER BY turn, text), '') AS said FROM conversations GROUP BY 1),
d AS (SELECT x.*, TRY_CAST(index AS INTEGER) AS i, lower(trim(regexp_replace(said, '\s+', ' ', 'g'))) AS said, lower(trim(regexp_replace(evidence, '\s+', ' ', 'g'))) AS e FROM ({_DELTA}) x JOIN c USING (conv_id)),
w AS (SELECT *, list_filter(regexp_extract_all(e, '\w+'), lambda w: length(w) > 2) AS ws FROM d),
k AS (SELECT * FROM w WHERE i BETWEEN 1 AND {len(_FOUND)} AND length(trim(evidence)) >= 6 AND (contains(said, e) OR (len(ws) > 0 AND len(list_filter(ws, lambda w: contains(said, w))) >= 0.8 * len(ws)))
  AND NOT ({_has("e", fx.EVASIVE)} AND NOT ({_has("e", fx.SUBSTANTIVE)} AND len(regexp_extract_all(e, '\w+')) >= 6)) AND (i <> 1 OR {_has("e", fx.LAB_EVIDENCE)})),
f AS (SELECT conv_id, i, min(pos) AS pos FROM k GROUP BY 1, 2), t AS (SELECT DISTINCT conv_id, turn FROM conversations),
s AS (SELECT t.conv_id, t.turn, list_sort(list(f.i) FILTER (f.i IS NOT NULL)) AS cov FROM t LEFT JOIN f ON f.conv_id = t.conv_id AND f.pos <= t.turn GROUP BY 1, 2)
SELECT conv_id, turn, coalesce(array_to_string(cov, ','), '') AS covered, array_to_string(list_filter([1, 2, 3, 4], lambda i: NOT coalesce(list_contains(cov, i), false)), ',') AS uncovered, round(coalesce(len(cov), 0) / {len(_FOUND)}, 6) AS coverage_rate FROM s""")
def coverage_deltas(spark: SparkSession, d: str) -> DataFrame:
    """FLT-13, FLT-9..12, WIN-7, SET-4, ST-1: a judge's proposals of covered facts, cleaned, and what is covered after every turn."""
    m = t(spark, d, "conversations")
    n, k = (F.col("conv_id") + F.col("turn")) % 9, (F.col("conv_id") + F.col("turn")) % 7
    said = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"))
    said = said.select("conv_id", F.concat(F.lit("I am not sure, but the culture showed growth. "), F.array_join(F.transform("m", lambda x: x["text"]), " ")).alias("said"))
    evidence = F.when(k == 0, "not sure about that").when(k == 1, "yes").when(k == 2, "The CULTURE  showed growth").when(k == 3, "zebras quarrel quietly elsewhere").when(k == 4, " Not sure, but the culture showed growth ").otherwise(F.coalesce("text", F.lit("")))
    delta = m.select("conv_id", F.col("turn").alias("pos"), F.when(n == 8, "x").otherwise((n - 1).cast("string")).alias("index"), evidence.alias("evidence")).join(said, "conv_id")
    facts = F.array(*map(F.lit, _FOUND))
    kept = encounters.coverage_delta(delta, facts, F.array().cast("array<int>"), F.col("said"))
    found = kept.groupBy(F.col("conv_id").alias("encounter_id"), F.col("pos").alias("turn")).agg(F.collect_list("i").alias("indices"))
    turns = m.select(F.col("conv_id").alias("encounter_id"), "turn").distinct().join(found, ["encounter_id", "turn"], "left").withColumn("total", F.lit(len(_FOUND)))
    out = coverage.coverage_batch(turns)
    return out.select(F.col("encounter_id").alias("conv_id"), "turn", F.array_join("covered", ",").alias("covered"), F.array_join(coverage.uncovered(F.col("covered"), F.col("total")), ",").alias("uncovered"), F.round("coverage_rate", 6).alias("coverage_rate"))
