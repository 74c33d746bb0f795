"""More registered queries: several operators each, called on the supplied tables, with the SQL that gives the same rows.

Replies, cases and encounters are made of the tables' columns by rule (``reply_of``, ``user_rows``),
the same in both languages, so that parsers meet their formats and joins their edge cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import replies
from caseloom.functions import text as fx
from caseloom.operators import joins, metrics, ranking, windows
from caseloom.plans import encounters, policy
from caseloom.plans.queries import longs, query, t
from caseloom.sources import readers, schemas

OPTIONS = {"A": "alpha", "B": "beta", "C": "gamma"}
_T = "regexp_replace(replace(coalesce(text, ''), chr(10), ' '), '[^ -~]', '', 'g')"
_REPLY = f"""SELECT conv_id, turn, CASE (conv_id + turn) % 7
 WHEN 0 THEN 'REASON: ' || {_T} || chr(10) || 'ANSWER: ' || chr(CAST(65 + conv_id % 8 AS INTEGER))
 WHEN 1 THEN 'answer ' || chr(CAST(65 + conv_id % 8 AS INTEGER)) || chr(10) || 'because ' || {_T}
 WHEN 2 THEN 'ANSWER: ABSTAIN' || chr(10) || {_T} WHEN 3 THEN {_T} || chr(10) || 'QUESTION: is it ' || turn || '?'
 WHEN 4 THEN 'Very confident, 0.' || (conv_id % 90 + 10) || ' of 1' WHEN 5 THEN {_T} || chr(10) || 'so: "beta", or gamma?' ELSE {_T} END AS r FROM conversations"""


def reply_of(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, r: a reply made of each turn's text, in one of seven layouts."""
    said = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "\n", " "), "[^ -~]", "")
    letter = F.char(F.lit(65) + F.col("conv_id") % 8)
    n = (F.col("conv_id") + F.col("turn")) % 7
    r = (
        F.when(n == 0, F.concat(F.lit("REASON: "), said, F.lit("\nANSWER: "), letter)).when(n == 1, F.concat(F.lit("answer "), letter, F.lit("\nbecause "), said))
        .when(n == 2, F.concat(F.lit("ANSWER: ABSTAIN\n"), said)).when(n == 3, F.concat(said, F.lit("\nQUESTION: is it "), F.col("turn").cast("string"), F.lit("?")))
        .when(n == 4, F.concat(F.lit("Very confident, 0."), (F.col("conv_id") % 90 + 10).cast("string"), F.lit(" of 1"))).when(n == 5, F.concat(said, F.lit('\nso: "beta", or gamma?'))).otherwise(said)
    )
    return t(spark, d, "conversations").select("conv_id", "turn", r.alias("r"))


_FIELD = r"nullif(trim(regexp_extract({r}, '(?im)^{label}\s*:?\s*(.+)$', 1)), '')"
_ASKED = """trim(translate(string_split(list_filter(list_transform(string_split({r}, chr(10)), lambda x: trim(x)), lambda x: contains(x, '?'))[-1], ':')[-1], chr(34) || chr(39), ''))"""
_CHOICE = (
    "CASE WHEN trim({r}) IN ('A', 'B', 'C', 'D') THEN trim({r}) ELSE list_filter(list_transform(string_split({r}, chr(10)), lambda x: CASE "
    + " ".join(f"WHEN contains(lower(x), '{v}') THEN '{k}'" for k, v in OPTIONS.items())
    + " "
    + " ".join(f"WHEN list_contains(string_split_regex(regexp_replace(x, '[,.;@#()?!''/&:$]+', ' ', 'g'), '\\s+'), '{k}') THEN '{k}'" for k in OPTIONS)
    + " END), lambda x: x IS NOT NULL)[1] END"
)


@query(f"""WITH c AS ({_REPLY}), f AS (SELECT *, {_FIELD.format(r="trim(r)", label="ANSWER")} AS answer, {_FIELD.format(r="trim(r)", label="QUESTION")} AS asked FROM c),
g AS (SELECT *, regexp_matches(trim(r), '(?im)^ABSTAIN\\s*$') OR coalesce(upper(answer) = 'ABSTAIN', false) AS gives_up FROM f),
h AS (SELECT *, CASE WHEN NOT gives_up THEN coalesce({_CHOICE.format(r="answer")}, {_CHOICE.format(r="trim(r)")}) END AS letter FROM g)
SELECT conv_id, turn, answer, md5({_FIELD.format(r="trim(r)", label="REASON")}) AS reason, letter, {_CHOICE.format(r="r")} AS picked, md5({_ASKED.format(r="r")}) AS atomic,
  CASE WHEN NOT gives_up AND letter IS NULL THEN md5(CASE WHEN contains(asked, '?') THEN asked ELSE {_ASKED.format(r="trim(r)")} END) END AS question, trim(r) <> '' AND letter IS NULL AS abstain FROM h""")
def reply_structures(spark: SparkSession, d: str) -> DataFrame:
    """FN-4, FN-5, FN-6, FN-7, FN-12, MSC-39, MSC-40: structured replies, choices and questions."""
    options = F.create_map(*[F.lit(x) for kv in OPTIONS.items() for x in kv])
    r = F.col("r")
    df = reply_of(spark, d).withColumn("s", replies.structured_reply(r, options))
    return df.select(
        "conv_id", "turn", replies.labeled_field(F.trim(r), "ANSWER").alias("answer"), F.md5("s.reason").alias("reason"), "s.letter", replies.choice(r, options).alias("picked"),
        F.md5(replies.atomic_question(r)).alias("atomic"), F.md5("s.question").alias("question"), "s.abstain",
    )


_UP, _LOW = "upper(trim(r))", "regexp_replace(lower(r), '[.,;:]', '', 'g')"
_LETTER = f"CASE WHEN {_UP} IN ('A', 'B', 'C', 'D', 'E', 'F', 'G') THEN {_UP} " + " ".join(f"WHEN regexp_extract({_UP}, '{p}', 1) <> '' THEN regexp_extract({_UP}, '{p}', 1)" for p in replies.LETTER_PATTERNS) + " END"


@query(f"""WITH c AS ({_REPLY}), f AS (SELECT *, {_LETTER} AS letter FROM c)
SELECT conv_id, turn, letter, CASE WHEN contains({_LOW}, 'yes') THEN 'YES' ELSE 'NO' END AS vote, TRY_CAST(regexp_extract_all(r, '\\d+\\.\\d+')[-1] AS DOUBLE) AS confidence,
  CAST(CASE {" ".join(f"WHEN contains({_LOW}, '{p}') THEN {s}" for p, s in replies.LIKERT_PHRASES)} ELSE 0 END AS BIGINT) AS scale,
  CASE WHEN letter IS NOT NULL THEN letter = chr(CAST(65 + conv_id % 4 AS INTEGER)) END AS right_letter, contains(r, '[DIAGNOSIS]') AS concluded FROM f""")
def reply_scores(spark: SparkSession, d: str) -> DataFrame:
    """FN-8, FN-9, FN-10, FN-11, FN-33, FN-39d: letters, votes, confidences and scales."""
    r = F.col("r")
    df = reply_of(spark, d).withColumn("letter", replies.ranked_letter(r))
    gold = F.char(F.lit(65) + F.col("conv_id") % 4)
    return longs(df.select("conv_id", "turn", "letter", replies.yes_no(r).alias("vote"), replies.confidence(r).alias("confidence"), replies.likert(r).alias("scale"), replies.letter_correct(F.col("letter"), gold).alias("right_letter"), replies.has_conclusion(r).alias("concluded")))


@query(f"""WITH c AS (SELECT conv_id, turn, {_T} AS x FROM conversations)
SELECT conv_id, turn, md5(trim(x || ' end')) AS kept, md5(trim(x)) AS fenced, md5(trim(x)) AS asked, md5('say ' || trim(x)) AS stripped, md5('[RETRIEVAL RESULT]' || chr(10) || x || chr(10) || chr(10) || 'b' || chr(10) || '[/RETRIEVAL RESULT]') AS block,
  CASE turn % 3 WHEN 0 THEN '医生' WHEN 1 THEN '检查员' ELSE '医生' END AS role, md5(trim(x)) AS content, chr(CAST(65 + conv_id % 4 AS INTEGER)) AS grade, 'fits' AS analysis FROM c""")
def reply_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """FN-13, FN-14, FN-15, FN-16, FN-17, FN-27, FN-29: what is added to a text by each format is taken off again."""
    x = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "\n", " "), "[^ -~]", "")
    n = F.col("turn") % 3
    prefix = F.when(n == 0, "<对医生讲>").when(n == 1, "<对检查员讲>").otherwise("")
    plain = F.translate(F.col("x"), "[]`", "   ")
    df = t(spark, d, "conversations").select("conv_id", "turn", x.alias("x"), prefix.alias("prefix"))
    rubric = F.concat(F.lit("# 诊断结果\n## 分析\nfits\n## 选项\n"), F.char(F.lit(65) + F.col("conv_id") % 4), F.lit("\n# 治疗方案\n## 选项\nD"))
    found = replies.addressee(F.concat("prefix", "x"))
    sections = replies.rubric_sections(rubric)
    return df.withColumn("plain", plain).select(
        "conv_id", "turn", F.md5(replies.strip_thinking(F.concat(F.lit("<think>a\nb</think>"), "x", F.lit(" end<think>c")))).alias("kept"), F.md5(replies.strip_fence(F.concat(F.lit("```json\n"), "x", F.lit("\n```")))).alias("fenced"),
        F.md5(F.when(F.trim("x") == "", F.lit("")).otherwise(fx.retrieval_query(F.concat(F.lit("so [Retrieval Query: "), "x", F.lit("] ok"))))).alias("asked"),
        F.md5(fx.strip_markers(F.concat(F.lit("[RETRIEVAL QUERY: q] say "), F.trim("x")))).alias("stripped"), F.md5(fx.passages_block(F.array(F.col("x"), F.lit("b")))).alias("block"),
        found["role"].alias("role"), F.md5(found["content"]).alias("content"), sections["diagnosis_choice"].alias("grade"), sections["diagnosis_analysis"].alias("analysis"),
    )


_ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"
_PLAIN = "regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g')"


@query(f"""WITH c AS (SELECT doc_id, {_PLAIN} AS x FROM documents), f AS (SELECT *, lower(x) AS low, string_split(x, '.') AS ss, len(regexp_extract_all(lower(x), '\\w+')) AS n FROM c)
SELECT doc_id, trim(x) = '' OR regexp_matches(x, '(?i){"|".join(p.replace("'", "''") for p in fx.UNINFORMATIVE)}') AS says_nothing,
  {_ANY("low", fx.EVASIVE)} AND NOT ({_ANY("low", fx.SUBSTANTIVE)} AND n >= 6) AS evasive, {_ANY("low", fx.LAB_FACTS)} AS lab, {_ANY("low", fx.LAB_EVIDENCE)} AS lab_evidence,
  md5(array_to_string(list_filter(list_transform(ss, lambda s: trim(s)), lambda s: s <> '')[1:12], '|')) AS facts,
  md5(array_to_string(list_transform(list_filter(list_transform(ss, lambda s: trim(s)), lambda s: s <> '')[1:12], lambda s: CASE WHEN ends_with(s, '?') THEN s ELSE 'Can you tell me whether this applies to you: ' || s || '?' END), '|')) AS questions,
  md5(array_to_string(list_filter(regexp_extract_all(low, '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({", ".join(f"'{w}'" for w in fx.STOPWORDS)})), ' ')) AS tokens,
  CASE WHEN contains(x, ' the ') THEN md5(CASE WHEN strpos(x, ' the ') > 21 THEN '...' ELSE '' END || substr(x, greatest(strpos(x, ' the ') - 20, 1), least(strpos(x, ' the ') + 4 + 80, length(x)) - greatest(strpos(x, ' the ') - 20, 1) + 1) || CASE WHEN strpos(x, ' the ') + 4 + 80 < length(x) THEN '...' ELSE '' END) END AS around FROM f""")
def fact_functions(spark: SparkSession, d: str) -> DataFrame:
    """FLT-8, FLT-9, FLT-11, FLT-12, FN-3, FN-19, FN-20, FN-34, MSC-38: predicates and splits of whole texts."""
    x = F.col("x")
    df = t(spark, d, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "").alias("x"))
    facts = fx.decompose(x)
    return df.select(
        "doc_id", fx.is_uninformative(x).alias("says_nothing"), fx.is_evasive(x).alias("evasive"), fx.is_lab(x).alias("lab"), fx.is_lab_evidence(x).alias("lab_evidence"),
        F.md5(F.array_join(facts, "|")).alias("facts"), F.md5(F.array_join(F.when(F.size(facts) > 0, fx.fact_questions(facts)).otherwise(facts), "|")).alias("questions"),
        F.md5(F.array_join(fx.content_tokens(x), " ")).alias("tokens"), F.md5(fx.snippet(x, F.lit(" the "))).alias("around"),
    )


_NUMBERED = "['1. ' || x, '2) ' || y, '3.', '4. order ' || x, 'obtain ' || y]"


@query(f"""WITH c AS (SELECT item_id, item_id % 120 AS age, regexp_replace(replace(text, chr(10), ' '), '[^ -~]', '', 'g') AS x FROM benchmark), f AS (SELECT item_id, age, trim(x) AS x, 'y' || item_id AS y FROM c)
SELECT item_id, md5(x || '|' || y || '|order ' || x || '|obtain ' || y) AS clean, md5(x || chr(10) || y || chr(10) || 'order ' || x || chr(10) || 'obtain ' || y) AS block, md5('1. ' || x || '|2) ' || y || '|3.|4. order ' || x) AS scorable,
  md5('2) ' || y || '|1. ' || x) AS selected, md5(x) AS labelled, CAST(0 AS BIGINT) AS mismatched, true AS quoted, false AS unquoted, CASE WHEN age BETWEEN 1 AND 119 THEN age END AS years, CAST(age AS VARCHAR) AS stated,
  CASE WHEN age < 13 THEN 'child_parent' WHEN age <= 17 THEN 'teen' WHEN age >= 65 THEN 'older_adult' ELSE 'adult' END AS voice, CASE WHEN age < 18 OR age >= 70 THEN 'low_literacy' ELSE 'default' END AS persona,
  least(greatest(age + 28, 30), 45) AS parent, CASE item_id % 3 WHEN 0 THEN 'daughter' WHEN 1 THEN 'son' ELSE 'child' END AS child, CASE item_id % 2 WHEN 0 THEN 'female' ELSE 'male' END AS sex, 'a cough.' AS opening,
  age || '-year-old, female, presenting with cough' AS safe, 'B' AS doctor, CAST(round_even(100.0 * age / 120, 0) AS INTEGER) || '% (n=' || item_id || ')' AS cell FROM f""")
def case_functions(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-12, PRJ-13, PRJ-19, PRJ-27, PRJ-28, PRJ-29, PRJ-30, PRJ-32, PRJ-41, MSC-45, FLT-7, FLT-10, FN-30, FN-31, FN-32, FN-35, FN-39c, FN-41, JN-17: facts and demographics of cases."""
    x = F.trim(F.regexp_replace(F.translate("text", "\n", " "), "[^ -~]", ""))
    df = t(spark, d, "benchmark").select("item_id", (F.col("item_id") % 120).alias("age"), x.alias("x"), F.concat(F.lit("y"), F.col("item_id").cast("string")).alias("y"))
    facts = F.array(F.concat(F.lit("1. "), "x"), F.concat(F.lit("2) "), "y"), F.lit("3."), F.concat(F.lit("4. order "), "x"), F.concat(F.lit("obtain "), "y"))
    sentence = F.concat(F.lit("A "), F.col("age").cast("string"), F.lit("-year-old "), F.when(F.col("item_id") % 2 == 0, "woman").otherwise("boy"), F.lit(" has it"))
    age, n = F.col("age"), F.col("item_id") % 3
    df = df.withColumn("facts", facts)
    labels = F.array(F.lit(" Top "), F.lit("low"))
    return longs(
        df.select(
            "item_id", F.md5(F.array_join(fx.normalize_facts(F.col("facts")), "|")).alias("clean"), F.md5(fx.facts_block(F.col("facts"))).alias("block"), F.md5(F.array_join(fx.scorable_facts(F.col("facts")), "|")).alias("scorable"),
            F.md5(F.array_join(fx.select_by_numbers(F.lit("2, x, 9, 1,"), F.col("facts")), "|")).alias("selected"), F.md5(F.array_join(joins.labelled(F.array("x", "y"), labels, "top"), "|")).alias("labelled"),
            F.size(joins.labelled(F.array("x"), labels, "top")).alias("mismatched"), fx.quoted_from(F.col("x"), F.concat(F.lit("so "), F.col("x"))).alias("quoted"), fx.quoted_from(F.lit("zzqq xxyy"), F.col("x")).alias("unquoted"),
            fx.parse_age(age).cast("long").alias("years"), fx.age_of(sentence).alias("stated"), fx.voice_band(age).alias("voice"), fx.demographic_persona(age).alias("persona"), fx.parent_age(age).alias("parent"),
            fx.child_word(F.when(n == 0, "Female").when(n == 1, "male")).alias("child"), fx.sex_of(sentence).alias("sex"), fx.first_sentence(F.lit("\n a cough. Worse at 38.5 now.\nx")).alias("opening"),
            fx.safe_opening(age, F.lit("female"), F.lit("cough")).alias("safe"), fx.doctor_letter(F.lit("doctor_b")).alias("doctor"), fx.cell_text(age.cast("decimal(3,0)") / F.lit(120).cast("decimal(3,0)"), F.col("item_id")).alias("cell"),
        )
    )


# A row for each user of all events: the columns that the analysis table has.
_USERS = """SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS buys, count(*) FILTER (event_type = 'error') AS errors, user_id % 3 AS g,
  ['Neuro', ' Pulmonology', 'Psychiatry', 'Infectious Disease', 'Nowhere'][1 + user_id % 5] AS category, ['A1a', 'A1b', 'A1c'][1 + user_id % 3] AS A1, ['A2a', 'A2b', 'A2c'][1 + (user_id // 3) % 3] AS A2 FROM events GROUP BY user_id"""


def user_rows(spark: SparkSession, d: str) -> DataFrame:
    """user_id, n, clicks, buys, errors, g, category, A1, A2."""
    of = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    counts = [F.count_if(F.col("event_type") == v).alias(k) for k, v in (("clicks", "click"), ("buys", "purchase"), ("errors", "error"))]
    u = F.col("user_id")
    return t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), *counts).withColumns({
        "g": u % 3, "category": of(("Neuro", " Pulmonology", "Psychiatry", "Infectious Disease", "Nowhere"), u % 5), "A1": of(schemas.A1_ARMS, u % 3), "A2": of(schemas.A2_ARMS, F.floor(u / 3) % 3),
    })


_CATEGORY = "CASE trim(category) WHEN 'Neuro' THEN 'Neurology' WHEN 'Pulmonology' THEN 'Pulmonology' WHEN 'Infectious Disease' THEN 'Infectious_Disease' ELSE 'Other' END"


@query(f"""WITH u AS ({_USERS}), f AS (SELECT *, {_CATEGORY} AS c, CASE g WHEN 0 THEN 'literacy_F' WHEN 1 THEN 'literacy_C' END AS lit FROM u)
SELECT user_id, c AS category, CASE WHEN category IN ('Neuro', 'Psychiatry') THEN category ELSE 'Other' END AS metric_category, lit AS literacy, CASE g WHEN 0 THEN 'default' WHEN 1 THEN 'random' ELSE 'default' END AS persona_id,
  {", ".join(f"CAST(c = '{c}' AS BIGINT) AS cat_{c}" for c in encounters.FEATURE_CATEGORIES)}, {", ".join(f"CAST(coalesce(lit = '{v}', false) AS BIGINT) AS {v}" for v in encounters.LITERACY)},
  length(category) AS chief_complaint_len, CAST(clicks AS DOUBLE) AS R1_total, CAST(clicks >= 6 AS DOUBLE) AS R1_responder, CAST(A1 = 'A1a' AS BIGINT) AS A1_a, CAST(A1 = 'A1b' AS BIGINT) AS A1_b, CAST(A1 = 'A1c' AS BIGINT) AS A1_c FROM f""")
def state_features(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-2, PRJ-3, PRJ-4, PRJ-5, PRJ-6, PRJ-7, PRJ-8, PRJ-9, MSC-13, MSC-22, MSC-23, MSC-36, FN-42: state features of a row per user."""
    block = F.when(F.col("g") == 0, F.create_map(F.lit("vocabulary_register"), F.lit(" Functional"))).when(F.col("g") == 1, F.create_map(F.lit("persona_id"), F.lit("random"), F.lit("axes"), F.lit('{"language_level": "advanced"}'))).otherwise(F.create_map(F.lit("vocabulary_register"), F.lit("plain")))
    df = user_rows(spark, d).withColumn("block", block).withColumn("literacy_id", encounters.literacy_of(F.lit(None).cast("map<string,string>"), F.col("block")))
    df = df.withColumns({"case_category": F.col("category"), "chief_complaint": F.col("category"), "R1_total": F.col("clicks"), "R1_responder": F.col("clicks") >= 6, "stage1_turns": F.lit(None).cast("int"), **{f"R1_{k}": F.lit(0) for k in ("red_flags", "OPQRST", "pmh", "meds", "social")}})
    keep = [*[f"cat_{c}" for c in encounters.FEATURE_CATEGORIES], *encounters.LITERACY, "chief_complaint_len", "R1_total", "R1_responder", "A1_a", "A1_b", "A1_c"]
    mapped = metrics.map_category(F.trim("category"), encounters.FEATURE_MAP)
    states = df.select("user_id", mapped.alias("mapped"), metrics.normalize_category(F.col("category")).alias("metric_category"), F.col("literacy_id").alias("literacy"), encounters.persona_of(F.col("block"))["persona_id"].alias("persona_id"), *encounters.state2())
    return longs(states.select("user_id", F.col("mapped").alias("category"), "metric_category", "literacy", "persona_id", *keep))


@query(f"""WITH u AS (SELECT *, clicks / n AS rate FROM ({_USERS}))
SELECT user_id, CAST(round_even(10 * rate, 0) AS BIGINT) AS total, rate >= 0.25 AS responder, round(round_even(least(1.0, greatest(0.0, 3 * rate - 0.2)), 4), 4) AS final, CASE WHEN round_even(least(1.0, greatest(0.0, 3 * rate - 0.2)), 4) >= 0.7 THEN 'high' ELSE 'low' END AS level,
  CASE WHEN rate >= 0.25 AND buys > 2 THEN 'high_correct' WHEN rate >= 0.25 THEN 'high_wrong' ELSE 'low' END AS kind, CASE WHEN errors > 0 THEN buys / errors ELSE 0 END AS coverage, CASE WHEN errors > 0 THEN buys / errors END AS scored,
  CAST(CASE WHEN g = 0 THEN 0 ELSE clicks END AS BIGINT) AS rubric, CASE WHEN g = 1 THEN true WHEN g = 0 THEN false ELSE clicks >= 6 END AS rubric_responder, errors > 3 AND buys > 2 AS correct, errors > 3 AND clicks > 2 AS missed, g = 0 OR (n >= 10 AND rate >= 0.2) AS may_finish,
  n < 8 AS keeps_on, rate < 0.8 AS keeps_asking, CASE WHEN g <> 1 THEN A1 END AS committed, array_to_string(list_filter(generate_series(1, 6), lambda i: i <> 1 + g)[1:2], ',') AS mocked, 'A2a,A2b' || CASE WHEN clicks >= 6 THEN ',A2c' ELSE '' END AS pool FROM u""")
def encounter_functions(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-24, PRJ-25, PRJ-26, PRJ-35, PRJ-36, FN-44, FN-48, AGG-30, MSC-2, MSC-3, FLT-19, FLT-20, FLT-21, FLT-24, FLT-25, FLT-30, FLT-31: scores and gates of a row per user."""
    df = user_rows(spark, d).withColumn("rate", F.col("clicks") / F.col("n"))
    r1 = encounters.r1_from_coverage(F.col("rate"), F.col("clicks"), F.col("n"), 0.25)
    r2 = encounters.r2_from_coverage(3 * F.col("rate") - 0.2)
    level = F.when(F.col("rate") >= 0.25, "high").otherwise("low")
    rubric = replies.rubric_total(F.when(F.col("g") == 0, "none").otherwise(F.col("clicks").cast("string")), F.when(F.col("g") == 1, True).when(F.col("g") == 0, False))
    judged = F.struct((F.col("buys") > 2).alias("diag_correct"), F.lit(False).alias("dangerous_advice"), F.lit(None).cast("boolean").alias("appropriate_management"))
    out = encounters.outcome(F.when(F.col("errors") > 3, "flu").otherwise(" "), judged, F.col("clicks") > 2, F.lit("low"), F.lit(None).cast("boolean"))
    fixed = df.withColumn("history", F.sequence(F.lit(1), F.col("n"))).withColumn("score", F.col("rate"))
    return longs(
        fixed.select(
            "user_id", r1["total"].alias("total"), r1["responder"].alias("responder"), F.round(r2["final_confidence"], 4).alias("final"), r2["confidence_level"].alias("level"), encounters.r2_category(level, F.col("buys") > 2).alias("kind"),
            metrics.coverage_rate(F.col("buys"), F.col("errors")).alias("coverage"), metrics.coverage_rate(F.col("buys"), F.col("errors"), None).alias("scored"), rubric["total"].alias("rubric"), rubric["responder"].alias("rubric_responder"),
            out["diag_correct"].alias("correct"), out["red_flag_miss"].alias("missed"), encounters.may_finish(F.col("rate"), F.col("n") >= 10, F.when(F.col("g") == 0, True), 0.2).alias("may_finish"), encounters.abstains("fixed", depth=8).alias("keeps_on"),
            encounters.abstains("numeric").alias("keeps_asking"), encounters.commits(F.col("g"), F.col("A1")).alias("committed"), F.array_join(encounters.mock_delta(F.lit(2), F.array((F.col("g") + 1).cast("int")), F.lit(6)), ",").alias("mocked"),
            F.array_join(ranking.responder_pool(F.col("clicks") >= 6, policy.RESPONDER_POOL, policy.OTHER_POOL), ",").alias("pool"),
        )
    )


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS n FROM lineitem")
def row_numbers(spark: SparkSession, d: str) -> DataFrame:
    """WIN-9: every row's place in a global order."""
    return readers.numbered(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY c_custkey) AS n, c_custkey FROM customer), b AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS n, s_suppkey FROM supplier)
SELECT c_custkey, s_suppkey FROM a JOIN b USING (n)""")
def zipped_rows(spark: SparkSession, d: str) -> DataFrame:
    """JN-15: customers and suppliers side by side, to the end of the shorter."""
    zipped = joins.zip_by_position(t(spark, d, "customer").select(F.col("c_custkey").alias("k")), t(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), "k")
    return zipped.select(F.col("k").alias("c_custkey"), F.col("k_b").alias("s_suppkey"))


@query("""WITH s AS (SELECT doc_id, quality FROM labels WHERE toxic = 0), x AS (
SELECT doc_id, quality, 'stored' AS how FROM s JOIN documents USING (doc_id) UNION ALL SELECT doc_id, NULL, 'computed' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s))
SELECT how, count(*) AS n, sum(doc_id) AS ids, sum(quality) AS quality FROM x GROUP BY how""")
def reused_rows(spark: SparkSession, d: str) -> DataFrame:
    """JN-8, JN-9, ST-9, SET-1, SET-3: stored rows pass through, the others are computed."""
    stored = t(spark, d, "labels").where("toxic = 0").select("doc_id", "quality", F.lit("stored").alias("how"))
    out = joins.reuse_or_compute(t(spark, d, "documents").select("doc_id"), stored, "doc_id", lambda df: df.select("doc_id", F.lit("computed").alias("how")))
    return joins.union_to([out], ["doc_id", "quality", "how"]).groupBy("how").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"), F.sum("quality").alias("quality"))


@query("""SELECT (SELECT count(*) FROM documents) > 0 AND (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) = 0 AS complete,
(SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing, (SELECT min(doc_id) FROM documents WHERE lang = 'de') AS first_de,
(SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS joined""")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    """JN-4, JN-11, JN-18, SET-6, MSC-43, MSC-44: what is expected and not done, a first match, and keys joined as text."""
    docs, labels = t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels").select("doc_id", "quality")
    first = joins.first_match(docs, F.col("lang") == "de", "doc_id").agg(F.max("doc_id").alias("first_de"))
    joined = joins.join_as_text(docs, labels.withColumn("doc_id", F.col("doc_id").cast("decimal(20,0)")), "doc_id").agg(F.count("*").alias("joined"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(joins.complete(docs, labels, "doc_id")).join(one(first), "one").join(one(joined), "one").select("complete", "missing", "first_de", "joined")


@query("""WITH m AS (SELECT source, sum(n_chars) AS c, count(*) AS n, avg(n_chars) AS mean, count(*) FILTER (doc_id % 3 <> 0) AS capped FROM documents GROUP BY source),
v AS (SELECT source, count(*) FILTER (quality = 1) > count(*) FILTER (quality = 0) AS yes FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT m.source, m.n AS calls, c AS tokens, mean AS mean_turns, capped AS n_capped, yes AS majority FROM m LEFT JOIN v ON m.source IS NOT DISTINCT FROM v.source""")
def usage_and_votes(spark: SparkSession, d: str) -> DataFrame:
    """AGG-20, AGG-24, AGG-26, AGG-29, AGG-37, FLT-27, FLT-28: totals, mean turns, capped runs and majorities by agent."""
    docs = t(spark, d, "documents").select("doc_id", "source", F.col("n_chars").alias("n_turns"), F.col("n_chars").alias("tokens"), F.lit(0.0).alias("latency"), (F.col("doc_id") % 3 == 0).alias("dialogue_ended"), F.lit(None).cast("boolean").alias("ended_by_patient"))
    votes = docs.join(t(spark, d, "labels"), "doc_id").withColumn("vote", F.when(F.col("quality") == 1, "YES").otherwise("NO")).groupBy("source").agg(metrics.yes_majority(F.col("vote")).alias("majority"))
    used, runs = metrics.usage(docs, "source").select("source", "calls", "tokens"), metrics.run_summary(docs, "source").select("source", "mean_turns", "n_capped")
    same = lambda df, k: df.withColumnRenamed("source", k)
    out = used.join(same(runs, "s1"), F.col("source").eqNullSafe(F.col("s1"))).join(same(votes, "s2"), F.col("source").eqNullSafe(F.col("s2")), "left")
    return out.select("source", "calls", "tokens", "mean_turns", "n_capped", "majority")


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN CAST(event_id % 10 AS DOUBLE) END AS s FROM events), m AS (SELECT user_id, coalesce(avg(s), 0) AS mean FROM e GROUP BY user_id),
p AS (SELECT user_id, arg_min(s, (abs(s - mean), event_id)) AS picked FROM e JOIN m USING (user_id) WHERE s IS NOT NULL GROUP BY user_id), l AS (SELECT user_id, max(event_id) AS reply FROM e JOIN p USING (user_id) WHERE s = picked GROUP BY user_id)
SELECT user_id, round(mean, 9) AS mean_score, coalesce(picked, 0) AS picked, CAST(reply AS VARCHAR) AS reply FROM m LEFT JOIN p USING (user_id) LEFT JOIN l USING (user_id)""")
def representative_scores(spark: SparkSession, d: str) -> DataFrame:
    """AGG-27, AGG-28: each user's mean score, the first score nearest to it and the last event with that score."""
    e = t(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", (F.col("event_id") % 10).cast("double")).alias("s"), F.col("event_id").cast("string").alias("reply"))
    return metrics.representative(e, ["user_id"], "s", "event_id", "reply").select("user_id", F.round("mean_score", 9).alias("mean_score"), "picked", "reply")


@query("""WITH e AS (SELECT user_id, list(event_type ORDER BY event_id) AS ts, list(event_id % 7 ORDER BY event_id) AS xs FROM events GROUP BY user_id),
f AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'purchase' GROUP BY user_id), q AS (SELECT user_id, min(event_id) AS ev FROM events GROUP BY user_id, event_type), z AS (SELECT user_id, count(*) AS kinds, sum(ev) AS firsts FROM q GROUP BY user_id)
SELECT user_id, CAST(xs[-1] AS DOUBLE) AS final, round(list_avg(xs), 9) AS mean, CAST(list_position(ts, 'purchase') - 1 AS BIGINT) AS at, CASE WHEN list_contains(ts, 'purchase') THEN 'purchase' <> ts[-1] END AS revised, CASE WHEN last IS NOT NULL THEN 'L' || last % 4 END AS letter,
  CASE user_id % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'b' ELSE 'd' END AS rotated, pmod.p AS start, kinds, firsts FROM e LEFT JOIN f USING (user_id) JOIN z USING (user_id), LATERAL (SELECT greatest(0, user_id % 9 - 1) % 4 AS p) pmod""")
def dialogue_windows(spark: SparkSession, d: str) -> DataFrame:
    """WIN-7, WIN-10, WIN-11, WIN-12, WIN-13, FN-37: last scores, first conclusions, letters, rotations and first evidence by user."""
    events = t(spark, d, "events").select("user_id", "event_id", "event_type")
    lists = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("turns"))
    letters = windows.last_letter(events.withColumn("letter", F.when(F.col("event_type") == "purchase", F.concat(F.lit("L"), (F.col("event_id") % 4).cast("string")))), "user_id", "event_id", "letter")
    firsts = windows.first_evidence(events, ["user_id", "event_type"], ["event_id"]).groupBy("user_id").agg(F.count("*").alias("kinds"), F.sum("event_id").alias("firsts"))
    scores = windows.stage_confidence(F.transform("turns", lambda x: (x["event_id"] % 7).cast("double")))
    found = windows.first_conclusion(F.col("turns"), lambda x: x["event_type"] == "purchase", F.element_at("turns", -1)["event_type"], lambda x: x["event_type"])
    pool = F.array(*map(F.lit, "abcd"))
    free = F.array(F.lit("b"), F.lit("d"))
    out = lists.join(letters, "user_id", "left").join(firsts, "user_id").select(
        "user_id", scores["final"].alias("final"), F.round(scores["mean"], 9).alias("mean"), found["at"].alias("at"), found["revised"].alias("revised"), "letter",
        windows.rotate_pick(pool, free, F.col("user_id") % 3).alias("rotated"), windows.rotation_start(F.col("user_id") % 9, F.lit(4)).alias("start"), "kinds", "firsts",
    )
    return longs(out)


@query(f"""WITH u AS ({_USERS}), s AS (SELECT *, [exp((x - m) / 0.5) for x in [clicks / n, buys / n, errors / n]] AS raw FROM (SELECT *, greatest(clicks / n, buys / n, errors / n) AS m FROM u)),
p AS (SELECT user_id, [r / list_sum(raw) for r in raw] AS p, CAST('0x' || substr(sha256('7:' || user_id), 1, 13) AS UBIGINT) / 4503599627370496.0 AS h FROM s)
SELECT user_id, round(p[1], 9) AS p1, round(p[2], 9) AS p2, round(h, 9) AS u, CAST(CASE WHEN p[1] > h THEN 0 WHEN p[1] + p[2] > h THEN 1 ELSE 2 END AS BIGINT) AS drawn FROM p""")
def drawn_arms(spark: SparkSession, d: str) -> DataFrame:
    """ML-14, ML-15, FN-45, FN-46, MSC-35: an arm drawn from each user's softmax shares by a stable number."""
    df = user_rows(spark, d)
    shares = ranking.softmax(F.array(*[F.col(c) / F.col("n") for c in ("clicks", "buys", "errors")]), 0.5)
    df = df.withColumn("p", shares).withColumn("u", ranking.hash_uniform(F.lit("7"), F.col("user_id")))
    return longs(df.select("user_id", F.round(F.col("p")[0], 9).alias("p1"), F.round(F.col("p")[1], 9).alias("p2"), F.round("u", 9).alias("u"), ranking.draw(F.col("p"), F.col("u")).alias("drawn")))


@query("""WITH d AS (SELECT doc_id, lang, n_chars FROM documents), f AS (SELECT *, TRY_CAST(CAST(doc_id AS VARCHAR) AS BIGINT) AS i FROM d), r AS (SELECT * FROM f WHERE i BETWEEN 5 AND 400 ORDER BY i LIMIT 90)
SELECT count(*) AS n, sum(doc_id) AS ids, (SELECT sum(doc_id) FROM (SELECT doc_id FROM d ORDER BY sha256('3:' || doc_id), doc_id LIMIT 50)) AS drawn, (SELECT sum(n_chars) FROM (SELECT n_chars FROM d ORDER BY doc_id LIMIT 25)) AS prefix,
(SELECT count(*) FROM d WHERE lang IS NOT NULL) AS written, (SELECT sum(doc_id) FROM d WHERE doc_id BETWEEN 100 AND 300) AS subset FROM r""")
def sources_and_sinks(spark: SparkSession, d: str) -> DataFrame:
    """SRC-8, SRC-11, SRC-12, SRC-14, SRC-17, SRT-6, SRT-11, MSC-46, SNK-3, SNK-5, SNK-6: rows written as JSON lines (all, a subset, by category) and read back; ranges, seeded and plain prefixes (the limits are the feature)."""
    from caseloom.sources import shared, sinks

    docs = t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    paths = [shared.scratch(spark, name) for name in ("all", "subset", "by-category")]
    sinks.write_jsonl(docs, paths[0])
    sinks.write_subset(docs.withColumnRenamed("doc_id", "id"), paths[1], None, id_min=100, id_max=300)
    sinks.write_by_category(docs.where("lang is not null"), paths[2], "lang")
    schema = "doc_id long, lang string, n_chars long"
    back = readers.read_jsonl(spark, paths[0], schema)
    subset = readers.read_jsonl(spark, paths[1], "id long, n_chars long", strict=False)
    written = spark.read.schema("doc_id long").json(paths[2])
    one = lambda df, *aggs: df.agg(*aggs).withColumn("one", F.lit(1))
    total = lambda c, name: F.sum(c).alias(name)
    out = one(readers.cases_in_range(back, 5, 400, 90, "doc_id"), F.count("*").alias("n"), total("doc_id", "ids"))
    for part in (
        one(readers.seeded_prefix(back, "doc_id", 3, 50), total("doc_id", "drawn")), one(readers.first_in_order(back, 25, "doc_id"), total("n_chars", "prefix")),
        one(written, F.count("*").alias("written")), one(subset, total("id", "subset")),
    ):
        out = out.join(part, "one")
    return out.drop("one")
