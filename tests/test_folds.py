import random
import re
import time

from pyspark.sql import functions as F

from caseloom.functions import text as fx
from caseloom.operators import folds

SCHEMA = "conv string, turn int, given string, regenerated array<string>, reply string, facts array<string>, g_ int"


def form(q):
    return re.sub(r"\s+", " ", re.sub(r"(?i)\[RETRIEVAL QUERY:[^\]]*\]\s*", "", q or "")).strip().lower().rstrip("?.! ")


def brute(rows, cap=2):
    """The whole history looked through again at every turn."""
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        history = []

        def is_open(q):
            f = form(q)
            if not f:
                return True
            if sum(form(x) == f for k, x in history if k == "q" and "?" in x and "[DIAGNOSIS]" not in x.upper()) >= cap:  # noqa: B023
                return False
            last = None
            for i, (k, x) in enumerate(history):  # noqa: B023
                if k == "q" and "?" in x and form(x) == f:
                    last = next((y for j, y in history[i + 1 :] if j == "a"), last)  # noqa: B023
            return last is None or not (last.strip() == "" or re.search("|".join(fx.UNINFORMATIVE), last, re.I))

        for n, (_, turn, given, again, reply, facts, _) in enumerate(sorted((r for r in rows if r[0] == conv), key=lambda r: r[1]), 1):
            bare = [re.sub(r"^\d+\.\s*", "", x.strip()) for x in facts or [] if x.strip()]
            asks = [x if x.endswith("?") else fx.FACT_QUESTION.format(x) for x in bare]
            turned = lambda p, n=n: [p[(n - 1 + i) % len(p)] for i in range(len(p))]
            options = [(given, "given"), *[(x, "llm_regen") for x in (again or [])[:3]], *[(x, "fallback_pool") for x in turned(folds.FALLBACKS)], *[(x, "atomic_fact") for x in turned(asks)]]
            q, why = next(((q, w) for q, w in options if is_open(q)), (given, "exhausted"))
            history.append(("q", q or ""))
            if reply is not None:
                history.append(("a", reply))
            out.append((conv, turn, q, why))
    return sorted(out, key=repr)


def test_decisions_are_those_of_the_whole_history(spark):
    rng = random.Random(3)
    said = ["Fever?", "fever ??", "[retrieval query: x]  Fever?", "Any pain?", "no question", "", "[Diagnosis] flu?", folds.FALLBACKS[0], None, "When did it start?"]
    replies = ["I don't know.", "yes", "", None, "no idea, sorry", "three days", None]
    rows = [(rng.choice("ab") if i % 3 else "c", i, rng.choice(said), rng.choice([None, [], rng.choices(said[:-2], k=rng.randint(0, 5))]), rng.choice(replies), rng.choice([None, ["1. has fever", " ", "Is it bad?"]]), 1) for i in range(220)]
    rows += [(None, 1, "Fever?", None, "I don't know", None, 1), (None, 2, "Fever?", None, None, None, 1)]
    out = folds.unique_questions(spark.createDataFrame(rows, SCHEMA), "conv", "turn")
    assert out.columns == [*SCHEMA.replace(",", "").split()[::2], "asked", "reason"]
    got = sorted(((r["conv"], r["turn"], r["asked"], r["reason"]) for r in out.collect()), key=repr)
    assert got == brute(rows)
    assert {r[3] for r in got} == {"given", "llm_regen", "fallback_pool", "atomic_fact", "exhausted"}
    assert folds.unique_questions(spark.createDataFrame([], SCHEMA), "conv", "turn").count() == 0


def ask(spark, pairs, last, **more):
    rows = [("x", i, q, None, a, None, 0) for i, (q, a) in enumerate(pairs)] + [("x", 99, last, more.get("again"), None, more.get("facts"), 0)]
    return folds.unique_questions(spark.createDataFrame(rows, SCHEMA), "conv", "turn").where("turn = 99").first()


def test_golden_cases(spark):
    dup = folds.FALLBACKS[0]
    third = ask(spark, [(dup, "Fever."), (dup, "Still fever.")], dup)
    assert form(third["asked"]) != form(dup) and "?" in third["asked"] and third["reason"] == "fallback_pool"
    unknown = ask(spark, [("When did your symptoms start?", "I don't know.")], "When did your symptoms start?")
    assert form(unknown["asked"]) != "when did your symptoms start"
    once = ask(spark, [("When did your knee pain start?", "I don't know. Why does that matter?")], "When did your knee pain start?", again=["Any rash?"])
    assert (once["asked"], once["reason"]) == ("Any rash?", "llm_regen")
    care = folds.FALLBACKS[2]
    assert form(ask(spark, [(care, "Nothing else."), (care, "Still nothing.")], care)["asked"]) != form(care)
    assert ask(spark, [("Any joint pain?", "yes")], "ANY joint pain??")["reason"] == "given"


def test_a_very_long_conversation_takes_time_in_proportion(spark):
    rows = spark.range(60_000).select(F.lit("x").alias("conv"), F.col("id").cast("int").alias("turn"), F.concat(F.lit("q"), (F.col("id") % 7000).cast("string"), F.lit("?")).alias("given"), F.array().cast("array<string>").alias("regenerated"), F.lit("yes").alias("reply"), F.array().cast("array<string>").alias("facts"))
    start = time.perf_counter()
    assert folds.unique_questions(rows, "conv", "turn").where("reason = 'given'").count() == 14_000
    assert time.perf_counter() - start < 60


def test_uncertain_replies_never_repeat(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("conv"), F.col("id").alias("turn"))
    pool = F.array(*map(F.lit, ("I'm not sure.", "No idea.", "Hard to say.")))
    got = folds.uncertain_replies(df, "conv", "turn", pool, F.col("turn")).orderBy("conv", "turn").collect()
    assert len(got) == 200 and all(a["reply_"] != b["reply_"] for a, b in zip(got, got[1:], strict=False) if a["conv"] == b["conv"]) and len({r["reply_"] for r in got}) == 3
    one = folds.uncertain_replies(df, "conv", "turn", F.array(F.lit("No idea.")), F.col("turn"))
    assert {r["reply_"] for r in one.collect()} == {"No idea."}
