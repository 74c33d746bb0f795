from pyspark.sql import functions as F

from caseloom.functions import replies
from caseloom.functions import text as fx


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'map<string,string>' if isinstance(v, dict) else 'int'}" for k, v in values.items()))
    out = row.select(col.alias("x")).first()["x"]
    return out.asDict() if hasattr(out, "asDict") else out


def test_question_normal_form(spark):
    f = fx.normalize_question(F.col("q"))
    assert one(spark, f, q="[RETRIEVAL QUERY: chest  pain] Where  does it\thurt??! ") == "where does it hurt"
    assert one(spark, f, q=None) == ""


def test_uninformative_and_evasive(spark):
    assert one(spark, fx.is_uninformative(F.col("q")), q="I don't know.") and one(spark, fx.is_uninformative(F.col("q")), q=None)
    assert one(spark, fx.is_evasive(F.col("q")), q="not sure")
    assert not one(spark, fx.is_evasive(F.col("q")), q="not sure when, the swollen elbow came in May")
    assert one(spark, fx.is_evasive(F.col("q")), q="I am unsure, pain?")
    assert not one(spark, fx.is_uninformative(F.col("q")), q="since Monday")


def test_red_flags_and_quotes(spark):
    miss = fx.red_flag_missed(F.col("c"), F.col("f"))
    assert one(spark, miss, c="Chest hurts", f=["chest pain", "weight loss"])
    assert not one(spark, miss, c="Chest hurts, lost weight", f=["chest pain", "weight loss"])
    assert not one(spark, miss, c="x", f=[])
    assert one(spark, fx.quoted_from(F.col("e"), F.col("c")), e="Fever since  Monday", c="I have had fever since monday night")
    assert not one(spark, fx.quoted_from(F.col("e"), F.col("c")), e="high fever and chills", c="I feel fine")
    assert one(spark, fx.quoted_from(F.col("e"), F.col("c")), e="cough, at night", c="a cough that comes at night")
    assert not one(spark, fx.quoted_from(F.col("e"), F.col("c")), e="anything", c="")


def test_facts(spark):
    assert one(spark, fx.normalize_facts(F.col("f")), f=["1. a", "2) b", "3."]) == ["a", "b"]
    assert one(spark, fx.select_by_numbers(F.col("r"), F.col("f")), r="2, 9, x, 1", f=["a", "b"]) == ["b", "a"]
    assert one(spark, fx.fact_in_context(F.col("f"), F.col("c")), f="patient smokes cigarettes daily", c="He smokes cigarettes daily.")
    assert not one(spark, fx.fact_in_context(F.col("f"), F.col("c")), f="the wbc is 9", c="the wbc is 9")
    assert one(spark, fx.fact_questions(F.col("f")), f=["1. a cough", "Is it wet?", " "]) == ["Can you tell me whether this applies to you: a cough?", "Is it wet?"]
    assert one(spark, fx.is_lab_evidence(F.col("f")), f="they took a specimen") and not one(spark, fx.is_lab(F.col("f")), f="they took a specimen")


def test_snippet_and_demographics(spark):
    s = one(spark, fx.snippet(F.col("c"), F.col("n")), c="a" * 50 + "needle" + "b" * 200, n="needle")
    assert s.startswith("...") and s.endswith("...") and "needle" in s
    assert one(spark, fx.snippet(F.col("c"), F.col("n")), c="abc", n="zz") is None
    assert one(spark, fx.age_of(F.col("c")), c="A 45-year-old woman") == "45" and one(spark, fx.sex_of(F.col("c")), c="A 45-year-old woman") == "female"
    assert one(spark, fx.parse_age(F.col("c")), c="130 years") is None


def test_reply_parsers(spark):
    opts = {"A": "Asthma", "B": "Gout"}
    assert one(spark, replies.choice(F.col("r"), F.col("o")), r="B", o=opts) == "B"
    assert one(spark, replies.choice(F.col("r"), F.col("o")), r="It is B/A.", o=opts) == "A"
    assert one(spark, replies.choice(F.col("r"), F.col("o")), r="b", o=opts) is None
    assert one(spark, replies.choice(F.col("r"), F.col("o")), r="It may be gout.", o=opts) == "B"
    assert one(spark, replies.choice(F.col("r"), F.col("o")), r="nothing", o=opts) is None
    got = one(spark, replies.structured_reply(F.col("r"), F.col("o")), r="REASON: x\nANSWER: A\nABSTAIN: no", o=opts)
    assert got == {"letter": "A", "question": None, "reason": "x", "abstain": False}
    got = one(spark, replies.structured_reply(F.col("r"), F.col("o")), r="REASON x\nANSWER: ABSTAIN\nQUESTION: How long?", o=opts)
    assert got == {"letter": None, "question": None, "reason": "x", "abstain": True}
    got = one(spark, replies.structured_reply(F.col("r"), F.col("o")), r="REASON: x\nQUESTION: How long?", o=opts)
    assert got == {"letter": None, "question": "How long?", "reason": "x", "abstain": True}
    assert one(spark, replies.labeled_field(F.col("r"), "ANSWER"), r="answer B") == "B"
    assert one(spark, replies.atomic_question(F.col("r")), r='Q1: "Any fever?"\nthanks') == "Any fever?"
    assert one(spark, replies.ranked_letter(F.col("r")), r="The answer is (C).") == "C"
    assert one(spark, replies.ranked_letter(F.col("r")), r="My pick would be B.") == "B" and one(spark, replies.ranked_letter(F.col("r")), r="f") == "F"
    assert one(spark, replies.ranked_letter(F.col("r")), r="none here") is None
    assert one(spark, replies.yes_no(F.col("r")), r="Hm.") == "NO" and one(spark, replies.yes_no(F.col("r")), r="No... y.es") == "YES"
    assert one(spark, replies.confidence(F.col("r")), r="0.85 of 1 at most") == 0.85
    assert one(spark, replies.likert(F.col("r")), r="Somewhat, confident") == 4 and one(spark, replies.likert(F.col("r")), r="very unconfident") == 1
    assert one(spark, replies.likert(F.col("r")), r="neither confident nor unconfident") == 3 and one(spark, replies.likert(F.col("r")), r="confident") == 0
    assert one(spark, replies.confidence(F.col("r")), r="first 0.3 then 0.75") == 0.75 and one(spark, replies.confidence(F.col("r")), r="none") is None
    assert one(spark, replies.likert(F.col("r")), r="Very confident") == 5 and one(spark, replies.likert(F.col("r")), r="?") == 0
    assert one(spark, replies.strip_thinking(F.col("r")), r="<think>a</think>b<think>c") == "b" and one(spark, replies.strip_thinking(F.col("r")), r=None) == ""
    assert one(spark, replies.verdict(F.col("r")), r="correct") and not one(spark, replies.verdict(F.col("r")), r="Incorrect; correct is B")
    assert one(spark, replies.lenient_json(F.col("r"), "a int"), r='noise ```json {"a": 3}``` tail') == {"a": 3}
    assert one(spark, replies.addressee(F.col("r")), r=" <对检查员讲> labs") == {"role": "检查员", "content": "labs"}
    assert one(spark, replies.addressee(F.col("r")), r="labs") == {"role": "医生", "content": "labs"}
    assert one(spark, replies.addressee(F.col("r"), {"doctor": "<d>", "nurse": "<n>"}), r="<n>labs") == {"role": "nurse", "content": "labs"}


def test_rubric_and_markers(spark):
    text = "# 症状\n## 分析\nfits well\n## 选项\nB. mostly\n# 诊断结果\n## 选项\nA"
    got = one(spark, replies.rubric_sections(F.col("r")), r=text)
    assert (got["sympton_analysis"], got["sympton_choice"], got["diagnosis_analysis"], got["diagnosis_choice"], got["test_choice"]) == ("fits well", "B", None, "A", None)
    said = "[Retrieval Query: fever in adults] What now?"
    assert one(spark, fx.retrieval_query(F.col("q")), q=said) == "fever in adults" and one(spark, fx.strip_markers(F.col("q")), q=said) == "What now?"
    assert one(spark, fx.retrieval_query(F.col("q")), q="no marker") is None
    assert one(spark, fx.passages_block(F.col("q")), q=["a", "b"]) == "[RETRIEVAL RESULT]\na\n\nb\n[/RETRIEVAL RESULT]"
    assert one(spark, replies.has_conclusion(F.col("q")), q="so: [DIAGNOSIS] flu") and not one(spark, replies.has_conclusion(F.col("q")), q="[diagnosis] flu")


def test_first_sentence_and_ages(spark):
    assert one(spark, fx.first_sentence(F.col("c")), c="\n Temp 38.5 since May. Then worse.\nMore.") == "Temp 38.5 since May."
    assert one(spark, fx.first_sentence(F.col("c")), c=None) == ""
    bands = [one(spark, fx.voice_band(F.col("a")), a=a) for a in (12, 13, 17, 18, 64, 65)]
    assert bands == ["child_parent", "teen", "teen", "adult", "adult", "older_adult"]
    assert [one(spark, fx.demographic_persona(F.col("a")), a=a) for a in (17, 18, 69, 70)] == ["low_literacy", "default", "default", "low_literacy"]


def test_transcript_stops_at_the_shorter_list(spark):
    assert one(spark, fx.transcript(F.col("q"), F.col("a")), q=["x?", "y?"], a=["z"]) == "Q1: x?\nA1: z"


def test_cells_round_exact_halves_to_even(spark, tmp_path):
    from decimal import Decimal

    import duckdb

    from caseloom.plans import catalog, queries

    d = spark.createDataFrame([(Decimal("0.575"),), (Decimal("0.585"),), (None,)], "s decimal(6,3)")
    assert [r[0] for r in d.select(fx.cell_text(F.col("s"), F.lit(3))).collect()] == ["58% (n=3)", "58% (n=3)", "— (n=3)"]
    items = spark.range(1, 241).select(F.col("id").alias("item_id"), F.lit("The patient has a cough.").alias("text"))
    items.coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["case_functions"]).project("item_id, cell").fetchall()
    got = catalog.case_functions(spark, str(tmp_path)).select("item_id", "cell").collect()
    assert sorted(map(tuple, got)) == sorted(want)
