
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators import joins, metrics
from caseloom.sources import schemas

# Fixed values of the log format: they must be these for right results.
#: Categories of the state features, and the names that logs use for them; others are Other.
FEATURE_CATEGORIES = ("Cardiology", "Pulmonology", "Gastroenterology", "Neurology", "Infectious_Disease", "Endocrinology", "Other")
FEATURE_MAP = {
    "Cardiology": "Cardiology", "Pulmonology": "Pulmonology", "Gastroenterology": "Gastroenterology", "Neurology": "Neurology", "Neuro": "Neurology", "Infectious_Disease": "Infectious_Disease",
    "Infectious Disease": "Infectious_Disease", "Endocrinology": "Endocrinology", "Pediatrics": "Other", "Psychiatry": "Other", "Other": "Other",
}
LITERACY = ("literacy_F", "literacy_I", "literacy_C")
REGISTERS = {
    "functional": "literacy_F", "interactive": "literacy_I", "critical": "literacy_C", "f": "literacy_F", "i": "literacy_I", "c": "literacy_C",
    "basic": "literacy_F", "intermediate": "literacy_I", "advanced": "literacy_C",
}
PRESETS = {"literacy_F": "literacy_F", "literacy_I": "literacy_I", "literacy_C": "literacy_C", "low_literacy": "literacy_F", "default": "literacy_I"}
AXES = ("vocabulary_register", "jargon_comprehension", "language_level")
PERSONA_DEFAULTS = {"persona_id": "default", "vocabulary_register": "interactive", "jargon_comprehension": "interactive", "personality": "neutral", "recall": "high", "emotional_state": "calm"}
REQUIRED = ("encounter_id", "case_id", "case_category", "stage1_arm", "stage2_arm", "R1", "R2", "outcome", "trajectory")


def register_to_literacy(value: Column) -> Column:
    """[PRJ-4] A register's or level's name to a literacy; null for unknown ones."""
    table = F.create_map(*[F.lit(x) for kv in REGISTERS.items() for x in kv])
    return F.try_element_at(table, F.lower(F.trim(value)))


def literacy_of(*blocks: Column) -> Column:
    """[PRJ-2, PRJ-3] From persona maps, the first that tells: the preset's id, a register, or a register under axes (JSON text); null if none does."""
    presets = F.create_map(*[F.lit(x) for kv in PRESETS.items() for x in kv])

    def one(block: Column) -> Column:
        at = lambda k: F.try_element_at(block, F.lit(k))
        named = F.coalesce(F.try_element_at(presets, at("persona_id")), F.when(at("persona_id").startswith("literacy_"), at("persona_id")))
        return F.coalesce(named, *[register_to_literacy(at(k)) for k in AXES], *[register_to_literacy(F.get_json_object(at("axes"), f"$.{k}")) for k in AXES])

    return F.coalesce(*map(one, blocks))


def persona_of(block: Column) -> Column:
    """[MSC-36] A persona map with every field, defaults where one is missing."""
    return F.struct(*[F.coalesce(F.try_element_at(block, F.lit(k)), F.lit(v)).alias(k) for k, v in PERSONA_DEFAULTS.items()])


def valid(raw: Column | None = None) -> Column:
    """[FLT-1] All parts are there. With the raw line, an outcome key that is null counts as there."""
    ok = F.lit(True)
    for c in REQUIRED:
        ok = ok & F.col(c).isNotNull()
    if raw is None:
        return ok & F.col("outcome.diag_correct").isNotNull()
    return ok & F.get_json_object(raw, "$.outcome").rlike(r'"diag_correct"\s*:')


def flatten(enc: DataFrame, raw: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """[PRJ-1, MSC-14] One row of 24 columns per valid encounter, and those to keep."""
    turns = lambda s: F.size(F.filter("trajectory", lambda t: t["stage"] == s))
    df = enc.where(valid(F.col(raw) if raw else None))
    return df.select(
        "encounter_id", "case_id", "case_category", "chief_complaint", "seed", F.col("stage1_arm").alias("A1"), F.col("stage2_arm").alias("A2"), "stage2_pool",
        F.coalesce("R1.total", F.lit(0)).alias("R1_total"), F.coalesce("R1.responder", F.lit(False)).alias("R1_responder"),
        *[F.coalesce(F.col(f"R1.{a}"), F.lit(0)).alias(f"R1_{b}") for a, b in (("OPQRST", "OPQRST"), ("red_flags", "red_flags"), ("past_medical_history", "pmh"), ("medications_allergies", "meds"), ("social_family_history", "social"))],
        F.coalesce("R2.final_confidence", F.lit(0.5)).alias("R2_final_conf"), F.coalesce("R2.avg_confidence", F.lit(0.5)).alias("R2_avg_conf"), F.coalesce("R2.confidence_level", F.lit("low")).alias("R2_level"),
        turns(1).alias("stage1_turns"), turns(2).alias("stage2_turns"), literacy_of(F.col("literacy_persona"), F.col("persona")).alias("literacy_id"),
        F.col("outcome.diag_correct").cast("int").alias("Y"), F.col("outcome.red_flag_miss").alias("outcome_red_flag_miss"), F.col("outcome.dangerous_advice").alias("outcome_dangerous"), *keep,
    )


def one_hot(value: Column, levels: Sequence[str], prefix: str) -> list[Column]:
    """[PRJ-7] A 0/1 column for every level, whether it occurs or not."""
    return [F.coalesce((value == lv).cast("int"), F.lit(0)).alias(f"{prefix}_{lv}") for lv in levels]


def state1() -> list[Column]:
    """[PRJ-8, MSC-13, MSC-22] Category, literacy and complaint length: 11 columns."""
    category = metrics.map_category(F.trim(F.coalesce("case_category", F.lit("Other"))), FEATURE_MAP)
    literacy = [F.coalesce((F.col("literacy_id") == v).cast("int"), F.lit(0)).alias(v) for v in LITERACY]
    return [*one_hot(category, FEATURE_CATEGORIES, "cat"), *literacy, F.length(F.coalesce("chief_complaint", F.lit(""))).alias("chief_complaint_len")]


def state2(arm: str | None = None) -> list[Column]:
    """[PRJ-9, MSC-23] state1, what stage 1 left, and the stage-1 arm (or a counterfactual one): 22 columns, missing counts as 0."""
    seen = ("R1_total", "R1_responder", "R1_red_flags", "R1_OPQRST", "R1_pmh", "R1_meds", "R1_social", "stage1_turns")
    arms = [F.coalesce(((F.lit(arm) if arm else F.col("A1")) == a).cast("int"), F.lit(0)).alias(f"A1_{a[-1]}") for a in schemas.A1_ARMS]
    return [*state1(), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in seen], *arms]


def design(state: Sequence[Column], arm: Column, arms: Sequence[str], reference: str) -> Column:
    """[PRJ-10] State and, for each arm but the reference, state times its dummy: an array of doubles."""
    base = [c.cast("double") for c in state]
    dummies = [(arm == a).cast("double") for a in arms if a != reference]
    return F.array(*base, *[d * c for d in dummies for c in base])


def r1_from_coverage(rate: Column, count: Column, total: Column, threshold: float = 0.6) -> Column:
    """[PRJ-24, FLT-31] struct(total, responder, ...): ten times the rate, rounded half to even."""
    return F.struct(F.bround(rate * 10, 0).cast("int").alias("total"), (rate >= threshold).alias("responder"), rate.alias("coverage_rate"), count.alias("coverage_count"), total.alias("total_facts"))


def r2_from_coverage(rate: Column, high: float = 0.7) -> Column:
    """[PRJ-25, FN-44, FN-48] struct(final, level), clamped to 0..1 and four places."""
    c = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate)), 4)
    return F.struct(c.alias("final_confidence"), F.when(c >= high, "high").otherwise("low").alias("confidence_level"))


def r2_category(level: Column, correct: Column) -> Column:
    """[PRJ-26]"""
    return F.when((level == "high") & correct, "high_correct").when(level == "high", "high_wrong").otherwise("low")


def outcome(diagnosis: Column, judged: Column, missed: Column, r2: Column, mcq: Column) -> Column:
    """[PRJ-36] The judged fields with the rest; no diagnosis makes all of them false."""
    has = F.coalesce(F.trim(diagnosis) != "", F.lit(False))
    flag = lambda f: F.when(has, F.coalesce(judged[f], F.lit(False))).otherwise(False).alias(f)
    return F.struct(flag("diag_correct"), flag("dangerous_advice"), flag("appropriate_management"), F.when(has, missed).otherwise(False).alias("red_flag_miss"), r2.alias("R2_category"), mcq.alias("mcq_correct"))


def select_facts(facts: Column, importance: Column, mode: str, case_id: Column, seed: int) -> Column:
    """[PRJ-20, PRJ-21] none, one (by a hash of seed and case), important (exactly two so labelled, else none), or all."""
    from caseloom.operators.ranking import hash_pick

    if mode == "none":
        return F.array().cast("array<string>")
    if mode == "all":
        return facts
    if mode == "one":
        return F.when(F.size(facts) > 0, F.array(F.get(facts, hash_pick(F.concat_ws(":", F.lit(str(seed)), case_id.cast("string")), F.greatest(F.size(facts), F.lit(1)))))).otherwise(F.array().cast("array<string>"))
    if mode == "important":
        kept = joins.labelled(facts, importance, "most important")
        return F.when(F.size(kept) == 2, kept).otherwise(F.array().cast("array<string>"))
    raise ValueError(f"no such mode: {mode}")


def scoring_case(results: DataFrame) -> DataFrame:
    """[PRJ-17, PRJ-22, PRJ-37, MSC-41, MSC-48] A scoring case from an interactive result."""
    return results.select(
        F.col("id").cast("string").alias("case_id"), F.col("info.question").alias("question"), F.col("info.options").alias("options"), F.col("info.correct_answer_idx").alias("ground_truth_idx"), F.col("info.correct_answer").alias("ground_truth_answer"),
        F.coalesce("info.initial_info", F.get("info.context", F.lit(0)), F.lit("")).alias("known"), F.col("info.facts").alias("facts"),
        joins.zip_shorter(F.col("interactive_system.questions"), F.col("interactive_system.answers")).alias("history"), F.col("interactive_system.letter_choice").alias("letter"),
    )


def coverage_delta(delta: DataFrame, facts: Column, seen: Column, conversation: Column) -> DataFrame:
    """[FLT-13, WIN-7] Accepted rows of a judge's delta (conv_id, pos, index, evidence): new, in range, quoted (if there is a conversation), not evasive, fit for laboratory facts; first per index."""
    from caseloom.functions import text as fx
    from caseloom.operators.windows import first_evidence

    index = F.col("index").cast("string").try_cast("int")
    df = delta.withColumn("i", index).where(F.col("i").between(1, F.size(facts)) & ~F.array_contains(seen, F.col("i")))
    e = F.trim(F.coalesce("evidence", F.lit("")))
    quoted = conversation.isNull() | fx.quoted_from(e, conversation)
    df = df.where((F.length(e) >= 6) & ~fx.is_evasive(e) & quoted & (~fx.is_lab(F.get(facts, F.col("i") - 1)) | fx.is_lab_evidence(e)))
    return first_evidence(df, ["conv_id", "i"], ["pos"])


def mock_delta(n_turns: Column, covered: Column, total: Column) -> Column:
    """[MSC-2] The next uncovered indices, one per answer."""
    open_ = F.when(total > 0, F.array_except(F.sequence(F.lit(1), total), covered)).otherwise(F.array().cast("array<int>"))
    return F.slice(open_, F.lit(1), n_turns)


def may_finish(rate: Column, min_turns_met: Column, force: Column, threshold: float) -> Column:
    """[FLT-20, FLT-21] Forced, or enough turns and coverage."""
    return F.coalesce(force, F.lit(False)) | (min_turns_met & (rate >= threshold))


def abstains(rule: str, *, depth: int = 10, threshold: float | None = None) -> Column:
    """[FLT-24..26, UDF-2] Whether a strategy asks on: fixed (history shorter than depth), numeric or scale (score below the threshold)."""
    if rule == "fixed":
        return F.size("history") < depth
    return F.col("score") < (threshold or (0.8 if rule == "numeric" else 4.0))


def commits(stage: Column, letter: Column, suppress: bool = True) -> Column:
    """[FLT-30] A committed letter, withheld in stage 1."""
    return F.when((stage == 1) & F.lit(suppress), F.lit(None).cast("string")).otherwise(letter)


def is_mock(marker: str = "[mock]") -> Column:
    """[FLT-15] The marker in one of the first three turns."""
    return F.exists(F.slice("trajectory", 1, 3), lambda t: F.contains(F.coalesce(t["doctor"], F.lit("")), F.lit(marker)) | F.contains(F.coalesce(t["patient"], F.lit("")), F.lit(marker)))


def cross_result(records: DataFrame, replies: DataFrame, parse) -> DataFrame:
    """[PRJ-40, MSC-47] Each record with a responder's letter and whether it is right."""
    from caseloom.functions.replies import letter_correct

    df = records.join(replies.select("case_id", "reader", "reply"), ["case_id", "reader"])
    df = df.withColumn("responder_letter", parse(F.col("reply")))
    return df.select("case_id", "agent", "reader", F.col("letter").alias("source_letter"), letter_correct(F.col("letter"), F.col("gold")).alias("source_correct"), "responder_letter", "gold", letter_correct(F.col("responder_letter"), F.col("gold")).alias("correct"))


def encounters_of_turns(heads: DataFrame, turns: DataFrame) -> DataFrame:
    """[ST-10, ST-11, MSC-29..32, MSC-7] Encounter rows from headers and logged turns: ordered trajectory, totals, confidences."""
    order = F.array_sort(F.collect_list(F.struct("turn", "stage", "arm", "doctor", "patient", "confidence")))
    log = turns.groupBy("encounter_id").agg(order.alias("trajectory"), F.max("turn").alias("total_turns"))
    return heads.join(log, "encounter_id", "left").withColumns({"trajectory_id": F.concat_ws("->", "stage1_arm", "stage2_arm"), "stage2_confidences": F.transform(F.filter("trajectory", lambda t: (t["stage"] == 2) & t["confidence"].isNotNull()), lambda t: t["confidence"])})
