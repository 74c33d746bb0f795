"""Registered queries over cases, results and encounters as they are logged: made of the tables by rule, written and read back where files are the point."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import replies
from caseloom.functions import text as fx
from caseloom.operators import metrics
from caseloom.plans import analysis, encounters, policy
from caseloom.plans import estimators as est
from caseloom.plans.queries import longs, query, t
from caseloom.plans.trials import _FLAT
from caseloom.sources import readers, schemas, shared, sinks


@query("""WITH p AS (SELECT p_partkey AS k, p_name, p_brand, p_type, p_partkey % 5 <> 0 AS said, CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'E' END AS idx FROM part WHERE p_partkey >= 2),
f AS (SELECT *, 'A ' || (k % 90 + 1) || '-year-old ' || CASE WHEN k % 2 = 1 THEN 'woman' ELSE 'man' END || ' has ' || p_name || '.' AS s1 FROM p)
SELECT CAST(k AS VARCHAR) AS case_id, CASE WHEN said THEN s1 ELSE 'Why ' || p_brand || '?' END AS chief_complaint, CASE WHEN k % 7 = 0 THEN 33 WHEN said THEN CAST(k % 90 + 1 AS BIGINT) END AS age_years, CASE WHEN k % 7 = 0 THEN 'other' WHEN said AND k % 2 = 1 THEN 'female' WHEN said THEN 'male' END AS gender,
  md5(CASE WHEN said THEN s1 || ' Next sentence. More.' ELSE 'Why ' || p_brand || '? End.' END) AS record, CASE WHEN k % 3 = 0 THEN 'atom' ELSE p_name || ';b' END AS facts, CASE idx WHEN 'A' THEN p_brand WHEN 'B' THEN p_type WHEN 'E' THEN 'x' ELSE 'ans' || k END AS answer, idx AS letter,
  'A: ' || p_brand || chr(10) || 'B: ' || p_type AS options, CASE WHEN k % 10 = 0 THEN 'hub' ELSE 'local' END AS source, CASE idx WHEN 'A' THEN p_brand WHEN 'B' THEN p_type ELSE '' END AS option FROM f""")
def case_records(spark: SparkSession, d: str) -> DataFrame:
    """SRC-1, SRC-2, SRC-4, SRC-5, SRC-18, SRC-19, SNK-1, SNK-4, PRJ-11..16, PRJ-18, PRJ-39, FN-23: a raw case per part in two files of lines, the second appended to, read as the configured source."""
    k, name = F.col("p_partkey"), F.col("p_name")
    none = F.lit(None)
    stated = F.concat(F.lit("A "), (k % 90 + 1).cast("string"), F.lit("-year-old "), F.when(k % 2 == 1, "woman").otherwise("man"), F.lit(" has "), name, F.lit(". Next sentence."))
    raw = t(spark, d, "part").select(
        k.alias("id"), F.concat(F.lit("Why "), "p_brand", F.lit("? End.")).alias("question"), F.when(k % 5 != 0, F.array(stated, F.lit("More."))).alias("context"), F.create_map(F.lit("A"), "p_brand", F.lit("B"), "p_type", F.lit("E"), F.lit("x")).alias("options"),
        F.concat(F.lit("ans"), k).alias("answer"), F.when(k % 4 == 0, "a").when(k % 4 == 1, "B").when(k % 4 == 2, "E").alias("answer_idx"), F.array(F.concat(F.lit("1. "), name), F.lit(" "), F.lit("2) b")).alias("facts"), F.when(k % 3 == 0, F.array(F.lit("3. atom"))).alias("atomic_facts"),
        F.when(k % 7 == 0, F.struct(F.lit("33").alias("age"), F.lit("other").alias("gender"))).otherwise(none).alias("patient"), F.when(k % 10 == 0, "hub").alias("_source"),
    )
    paths = [shared.scratch(spark, n) for n in ("hub", "craft")]
    sinks.write_jsonl(raw.where("id % 2 = 0"), paths[0])
    sinks.write_jsonl(raw.where("id % 2 = 1 AND id % 3 = 0"), paths[1])
    sinks.write_jsonl(raw.where("id % 2 = 1 AND id % 3 <> 0"), paths[1], append=True)
    cases = readers.load_cases(spark, {"paths": paths, "id_min": 2})
    cases = cases.withColumn("option", fx.option_text(F.col("options"), F.col("ground_truth_idx")))
    return longs(cases.select(
        "case_id", "chief_complaint", "age_years", "gender", F.md5("full_record").alias("record"), F.array_join("atomic_facts", ";").alias("facts"), F.col("ground_truth_answer").alias("answer"), F.col("ground_truth_idx").alias("letter"),
        fx.format_options(F.col("options")).alias("options"), "source", "option",
    ))


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS case_id, chr(CAST(65 + o_orderkey % 4 AS INTEGER)) AS letter, chr(CAST(65 + o_orderkey % 3 AS INTEGER)) AS gold, o_comment AS said FROM (SELECT *, o_orderpriority || ' ' || o_orderstatus AS o_comment FROM orders)),
r AS (SELECT *, CASE WHEN contains(said, 'A') THEN 'A' WHEN contains(said, 'B') THEN 'B' WHEN contains(said, 'C') THEN 'C' WHEN contains(said, 'D') THEN 'D' END AS got FROM o)
SELECT case_id, CASE WHEN k % 3 <> 0 THEN 'init ' || k WHEN k % 6 <> 0 THEN 'ctx ' || k ELSE '' END AS known, CASE WHEN k % 5 = 0 THEN '' ELSE 'q1=a1|q2=a2' END AS history, ['f0 ' || k, 'f1', 'f2'][CAST(CAST('0x' || substr(sha256('11:' || case_id), 1, 16) AS UBIGINT) % 3 AS INTEGER) + 1] AS one,
  CASE WHEN k % 2 = 0 THEN 'f0 ' || k || ',f1' ELSE '' END AS important, CAST(3 AS BIGINT) AS n_all, CAST(0 AS BIGINT) AS n_none, letter = gold AS source_correct, got AS responder_letter, got = gold AS correct FROM r""")
def scored_results(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-17, PRJ-20..22, PRJ-37, PRJ-40, JN-16, MSC-41, MSC-47, MSC-48: interactive results as scoring cases, facts chosen in four modes, and another reader's letters."""
    k = F.col("o_orderkey")
    letter = lambda n: F.char(F.lit(65) + k % n)
    none = F.lit(None).cast("string")
    texts = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    results = t(spark, d, "orders").select(
        k.alias("id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("reply"),
        F.struct(letter(4).alias("letter_choice"), texts("q1", "q2", "q3").alias("questions"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(texts("a1", "a2")).alias("answers")).alias("interactive_system"),
        F.struct(F.lit("which?").alias("question"), F.create_map(F.lit("A"), F.lit("x")).alias("options"), letter(3).alias("correct_answer_idx"), F.lit("x").alias("correct_answer"), F.when(k % 3 != 0, F.concat(F.lit("init "), k)).otherwise(none).alias("initial_info"),
                 F.when(k % 6 != 0, F.array(F.concat(F.lit("ctx "), k), F.lit("more"))).alias("context"), texts(F.concat(F.lit("f0 "), k), "f1", "f2").alias("facts")).alias("info"),
    )
    importance = F.when(F.col("case_id").cast("long") % 2 == 0, texts("most important", "Most Important ", "low")).otherwise(texts("most important", "low", "low"))
    cases = encounters.scoring_case(results)
    chosen = {m: encounters.select_facts(F.col("facts"), importance, m, F.col("case_id"), 11) for m in ("none", "one", "important", "all")}
    made = cases.select("case_id", "known", F.array_join(F.transform("history", lambda h: F.concat(h["a"], F.lit("="), h["b"])), "|").alias("history"), F.array_join(chosen["one"], ",").alias("one"), F.array_join(chosen["important"], ",").alias("important"), F.size(chosen["all"]).alias("n_all"), F.size(chosen["none"]).alias("n_none"))
    records = cases.select("case_id", F.lit("A").alias("agent"), F.lit("B").alias("reader"), "letter", F.col("ground_truth_idx").alias("gold"))
    read = encounters.cross_result(records, results.select(F.col("id").cast("string").alias("case_id"), F.lit("B").alias("reader"), "reply"), replies.grade)
    return longs(made.join(read.select("case_id", "source_correct", "responder_letter", "correct"), "case_id"))


_CUES = (("greets", r"(?i)\b(?:hello|hi)\b"), ("asks", r"\?"), ("numbers", r"\d"), ("capitals", r"^[A-Z]"))
_JARGON = {"even": ("tion", "ing"), "odd": ("the", "que", "de")}


@query(r"""WITH c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'doctor' WHEN 'assistant' THEN 'patient' ELSE role END AS role, coalesce(text, '') AS x FROM conversations),
p AS (SELECT conv_id, min(turn) AS told FROM c WHERE role = 'patient' GROUP BY 1), o AS (SELECT c.conv_id, string_agg(x, ' ' ORDER BY turn) AS opening FROM c LEFT JOIN p USING (conv_id) WHERE role = 'doctor' AND (told IS NULL OR turn < told) GROUP BY 1),
g AS (SELECT conv_id, string_agg(x, ' ' ORDER BY turn) FILTER (role = 'patient') AS patient, string_agg(x, ' ' ORDER BY turn) FILTER (role = 'doctor') AS doctor, min_by(x, turn) AS first FROM c GROUP BY 1),
h AS (SELECT g.*, coalesce(opening, '') AS opening, lower(first) AS low, 'A: one' || chr(10) || 'B: two' AS opts FROM g LEFT JOIN o USING (conv_id))
SELECT conv_id, md5(coalesce(patient, '')) AS patient, md5(coalesce(doctor, '')) AS doctor, md5('known' || CASE WHEN conv_id % 2 = 0 THEN chr(10) || 'cough' ELSE '' END || chr(10) || conv_id % 90 || chr(10) || 'why?' || chr(10) || 'one two' || CASE WHEN trim(opening) <> '' THEN chr(10) || opening ELSE '' END) AS corpus,
  array_to_string(list_filter([CASE WHEN regexp_matches(first, '(?i)\b(?:hello|hi)\b') THEN 'greets' END, CASE WHEN regexp_matches(first, '\?') THEN 'asks' END, CASE WHEN regexp_matches(first, '\d') THEN 'numbers' END, CASE WHEN regexp_matches(first, '^[A-Z]') THEN 'capitals' END], lambda x: x IS NOT NULL), ',') AS cues,
  CASE WHEN conv_id % 2 = 0 THEN CASE WHEN contains(low, 'tion') THEN 'tion' WHEN contains(low, 'ing') THEN 'ing' END ELSE CASE WHEN contains(low, 'the') THEN 'the' WHEN contains(low, 'que') THEN 'que' WHEN contains(low, 'de') THEN 'de' END END AS jargon,
  regexp_matches(first, '(?i)\b(?:temperature|blood pressure|pulse|lab|x-ray|exam|test results?)\b') AS objective, length(first) >= 120 OR len(regexp_split_to_array(trim(first), '[.!?]\s')) > 2 AS narrative, opts FROM h""")
def dialogue_texts(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-23, PRJ-33, PRJ-34, FLT-16, FLT-17, FN-23, FN-25, FN-39b: what either side said, all that is known before the first answer, and what the first turn is like."""
    m = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") == "user", "doctor").when(F.col("role") == "assistant", "patient").otherwise(F.col("role")).alias("role"), F.coalesce("text", F.lit("")).alias("content")))).alias("m"))
    options, even = F.create_map(F.lit("B"), F.lit("two"), F.lit("A"), F.lit("one")), F.col("conv_id") % 2 == 0
    ordered = F.create_map(F.lit("A"), F.lit("one"), F.lit("B"), F.lit("two"))
    df = m.withColumn("first", F.get("m", F.lit(0))["content"])
    corpus = fx.context_corpus(F.lit("known"), F.when(even, "cough").otherwise(" "), F.col("conv_id") % 90, F.lit(None).cast("string"), F.lit("why?"), ordered, F.col("m"))
    return df.select(
        "conv_id", F.md5(fx.said_by(F.col("m"), "patient")).alias("patient"), F.md5(fx.said_by(F.col("m"), "doctor")).alias("doctor"), F.md5(corpus).alias("corpus"), F.array_join(fx.communication_cues(F.col("first"), _CUES), ",").alias("cues"),
        fx.first_jargon(F.col("first"), F.when(even, "even").otherwise("odd"), _JARGON).alias("jargon"), fx.is_objective_question(F.col("first")).alias("objective"), fx.is_narrative(F.col("first")).alias("narrative"), fx.format_options(options).alias("opts"),
    )


@query("""WITH s AS (SELECT conv_id, turn, CASE WHEN turn < 2 THEN 1 ELSE 2 END AS stage, text, role FROM conversations),
g AS (SELECT conv_id, max(turn) AS total, count(*) FILTER (stage = 1) AS s1, count(*) FILTER (stage = 2) AS s2, count(*) FILTER (stage = 2 AND turn % 2 = 0) AS n_conf, max_by(turn, turn) FILTER (stage = 2 AND turn % 2 = 0) AS last, bool_or(contains(coalesce(text, ''), 'ing')) FILTER (r <= 3) AS mock FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM s) GROUP BY 1)
SELECT conv_id % 4 AS grp, count(*) AS n, sum(total)::BIGINT AS turns, sum(s1)::BIGINT AS stage1, sum(s2)::BIGINT AS stage2, sum(n_conf)::BIGINT AS confidences, round(sum(coalesce(last / 100, 0)), 6) AS last_confidence, count(*) FILTER (coalesce(mock, false)) AS mocks, count(*) FILTER (conv_id % 3 <> 0) AS valid,
  count(*) FILTER (conv_id % 5 <> 1) AS scored, round(avg(CASE WHEN conv_id % 5 <> 1 THEN (conv_id % 2)::DOUBLE END), 9) AS accuracy, round(avg(CASE WHEN total % 4 <> 0 THEN least(total, 4) / 4 END), 9) AS coverage FROM g GROUP BY 1""")
def rebuilt_encounters(spark: SparkSession, d: str) -> DataFrame:
    """MSC-7, MSC-8, MSC-29..32, ST-10, FLT-1, FLT-15, AGG-15, AGG-17, AGG-23, AGG-36: encounters from headers and logged turns, which of them are valid or mock, accuracy and coverage by group."""
    c = t(spark, d, "conversations")
    i = F.col("conv_id")
    heads = c.select("conv_id").distinct().select(
        i.alias("encounter_id"), i.alias("case_id"), F.lit("Other").alias("case_category"), F.lit("A1a").alias("stage1_arm"), F.lit("A2b").alias("stage2_arm"), F.struct(F.lit(1).alias("total")).alias("R1"),
        F.when(i % 3 != 0, F.struct(F.lit(0.5).alias("final_confidence"))).alias("R2"), F.struct(F.when(i % 5 != 1, i % 2 == 1).alias("diag_correct")).alias("outcome"),
    )
    stage = F.when(F.col("turn") < 2, 1).otherwise(2)
    turns = c.select(i.alias("encounter_id"), "turn", stage.alias("stage"), F.lit("A1a").alias("arm"), F.when(F.col("role") != "assistant", F.col("text")).alias("doctor"), F.when(F.col("role") == "assistant", F.col("text")).alias("patient"), F.when((stage == 2) & (F.col("turn") % 2 == 0), F.col("turn") / 100).alias("confidence"))
    enc = encounters.encounters_of_turns(heads, turns).withColumn("grp", F.col("encounter_id") % 4)
    size = lambda s: F.size(F.filter("trajectory", lambda x: x["stage"] == s))
    here = F.lit(True)
    for c_ in encounters.REQUIRED:
        here = here & F.col(c_).isNotNull()
    covered = F.when(F.col("total_turns") % 4 != 0, metrics.coverage_rate(F.least("total_turns", F.lit(4)), F.lit(4), None))
    scored = metrics.accuracy(F.col("outcome.diag_correct"))
    return enc.groupBy("grp").agg(
        F.count("*").alias("n"), F.sum("total_turns").alias("turns"), F.sum(size(1)).alias("stage1"), F.sum(size(2)).alias("stage2"), F.sum(F.size("stage2_confidences")).alias("confidences"), F.round(F.sum(F.coalesce(F.try_element_at("stage2_confidences", F.lit(-1)), F.lit(0.0))), 6).alias("last_confidence"),
        F.count_if(encounters.is_mock("ing")).alias("mocks"), F.count_if(here).alias("valid"), scored[1].alias("scored"), F.round(scored[2], 9).alias("accuracy"), F.round(F.avg(covered), 9).alias("coverage"),
    )


_W = [round(0.03 * ((i * 7) % 11), 2) for i in range(33)] + [0.05]


@query(f"""WITH {_FLAT}, k AS (SELECT 'e' || user_id AS encounter_id, count(DISTINCT event_type) % 3 AS lit FROM events GROUP BY 1), w AS (SELECT CAST({_W} AS DOUBLE[]) AS w),
x AS (SELECT f.encounter_id, CASE case_category WHEN 'Cardiology' THEN 1 WHEN 'Neuro' THEN 4 ELSE 7 END AS cat, CAST(8 + lit AS INTEGER) AS lit FROM f JOIN k USING (encounter_id)),
v AS (SELECT encounter_id, w[cat] + w[lit] + w[34] AS a, w[cat] + w[lit] + w[11 + cat] + w[11 + lit] + w[34] AS b, w[cat] + w[lit] + w[22 + cat] + w[22 + lit] + w[34] AS c FROM x, w)
SELECT encounter_id, round(least(1, greatest(0, a)), 9) AS "A1a", round(least(1, greatest(0, b)), 9) AS "A1b", round(least(1, greatest(0, c)), 9) AS "A1c" FROM v""")
def predicted_values(spark: SparkSession, d: str) -> DataFrame:
    """ML-2, PRJ-8, PRJ-10, MSC-16..18: the values of all stage-1 arms by stated coefficients of the contrast design, for a row per user of all events."""
    fit = est.LinearFit(policy.STAGE1, np.array(_W))
    out = fit.with_values(policy.with_states(policy.of_events(t(spark, d, "events"))), "v")
    return out.select("encounter_id", *[F.round(F.try_element_at("v", F.lit(a)), 9).alias(a) for a in schemas.A1_ARMS])


@query(f"""WITH {_FLAT}, c AS (SELECT A1, A2, count(*) AS n FROM f GROUP BY 1, 2), s AS (SELECT count(*) AS n, avg(Y) AS y FROM f), g AS (SELECT count(*) AS cells, min(n) AS least FROM c),
k AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT case_category, R1_responder, A1 FROM f)) * 3 AS p2, (SELECT count(DISTINCT case_category) FROM f) * 3 AS p1)
SELECT unnest(['n_encounters', 'stage1_n_design_cols', 'stage1_n_over_p', 'stage2_n_design_cols', 'stage2_n_over_p', 'n_arm_cells', 'min_cell_count', 'mean_Y', 'warning_high_dimensional']) AS metric,
  unnest([n::DOUBLE, p1, round(n / p1, 3), p2, round(n / p2, 3), cells, least, round(y, 4), (n < p2)::INT]) AS value FROM s, g, k""")
def sample_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11, MSC-18: sizes of the sample, of the designs and of the cells of arms."""
    df = policy.of_events(t(spark, d, "events"))
    fit = policy.fit_q(df, stage2=est.CellMeans(("case_category", "R1_responder", "A1")), stage1=est.CellMeans(("case_category",)))
    return analysis.diagnostics(df, fit)
