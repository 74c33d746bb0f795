"""

A conversation's rows are dealt to one task and sorted by turn; a task goes through its rows
once and keeps a state per conversation, never the conversation. Texts are brought to their
compared forms by column functions first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import text as fx

# Fixed values of the log format: they must be these for right results.
#: Questions that are asked when all else is blocked, in their order.
FALLBACKS = (
    "Could you tell me more about your symptoms?",
    "Could you tell me more about any tests or treatments you have had for this problem?",
    "Is there any other test result or treatment detail from your recent care that we have not discussed yet?",
    "When did your symptoms start?",
    "Have you been started on any antibiotics or other medications for these symptoms?",
    "Was any fluid taken from a swollen joint for testing, and what were the results?",
    "Do you know whether the bacteria from your cultures ferment maltose?",
    "Have you had any recent sexual partners or new partners before these symptoms began?",
    "Have you noticed any rash, eye redness, or sore throat along with these symptoms?",
)
#: How a question came to be asked.
GIVEN, REGENERATED, FALLBACK, FACT, EXHAUSTED = "given", "llm_regen", "fallback_pool", "atomic_fact", "exhausted"


def _open(form: str, asked: dict[str, int], refused: set[str], cap: int) -> bool:
    """Not asked cap times before, and not last answered by nothing; a blank form is always open."""
    return not form or (asked.get(form, 0) < max(cap, 1) and form not in refused)


def _rotated(forms: Sequence[str], start: int, asked: dict[str, int], refused: set[str], cap: int) -> int | None:
    """The first open candidate from a place on, wrapping."""
    n = len(forms)
    return next(((start + i) % n for i in range(n) if _open(forms[(start + i) % n], asked, refused, cap)), None)


def unique_questions(
    turns: DataFrame, conv: str, turn: str, *, given: str = "given", regenerated: str = "regenerated", reply: str = "reply", facts: str = "facts", cap: int = 2, fallbacks: Sequence[str] = FALLBACKS, retries: int = 3,
) -> DataFrame:
    """[FN-36, FN-38, FN-37, WIN-3, WIN-4, WIN-10, FLT-18] Each turn with the question that is asked (asked) and how it was found (reason).

    turns: a row a turn with the proposed question, the proposals to fall back on (array, of
    which retries are looked at), the conversation's facts (array) and the reply to what is
    asked, which may be null (none yet: the next reply of the conversation answers it too). A
    proposal is blocked when a question of its form was asked cap times before, or when the
    last reply after it told nothing. Then come the other proposals, the fallbacks and
    questions on the facts, both from the turn's place on, and if all are blocked the proposal
    itself. Questions without a question mark, or with a diagnosis, are asked but not counted.
    Turns of one conversation need different places; a null conversation is one. A turn of a
    null question has a blank form. An empty table gives no rows. Other columns stay.
    """
    work = {n: _free(turns, f"{n}_") for n in ("g", "r", "f", "fq", "told", "at")}
    form = lambda c: fx.normalize_question(c)  # noqa: E731  of one parameter, as transform counts them
    some = F.slice(F.coalesce(F.col(regenerated), F.array().cast("array<string>")), 1, retries)
    questions = fx.fact_questions(F.coalesce(F.col(facts), F.array().cast("array<string>")))
    df = turns.withColumn(work["fq"], questions).withColumns({
        work["g"]: form(F.col(given)), work["r"]: F.transform(some, form), work["f"]: F.transform(F.col(work["fq"]), form),
        work["told"]: F.when(F.col(reply).isNotNull(), ~fx.is_uninformative(F.col(reply))),
    })
    pool = turns.sparkSession.range(1).select(F.array(*[form(F.lit(q)) for q in fallbacks])).first()[0] if fallbacks else []
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema.fields) + ", asked string, reason string"
    names, diagnosis = list(turns.columns), fx.DIAGNOSIS_MARKER

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, started = None, False
        asked: dict[str, int] = {}
        refused: set[str] = set()
        waiting: set[str] = set()
        n = 0
        for frame in frames:
            chosen, reasons = [], []
            for c, g, q, r, rq, f, fq, told in zip(frame[conv], frame[work["g"]], frame[given], frame[work["r"]], frame[regenerated], frame[work["f"]], frame[work["fq"]], frame[work["told"]], strict=True):
                key = None if c is None or c != c else c
                if not started or key != now:
                    now, started, asked, refused, waiting, n = key, True, {}, set(), set(), 0
                n += 1
                again = next((i for i, x in enumerate(r) if _open(x, asked, refused, cap)), None)
                if _open(g, asked, refused, cap):
                    text, own, why = q, g, GIVEN
                elif again is not None:
                    text, own, why = rq[again], r[again], REGENERATED
                elif (i := _rotated(pool, (n - 1) % max(len(pool), 1), asked, refused, cap)) is not None:
                    text, own, why = fallbacks[i], pool[i], FALLBACK
                elif (i := _rotated(f, (n - 1) % max(len(f), 1), asked, refused, cap)) is not None:
                    text, own, why = fq[i], f[i], FACT
                else:
                    text, own, why = q, g, EXHAUSTED
                if text and "?" in text and own:
                    waiting.add(own)
                    if diagnosis not in text.upper():
                        asked[own] = asked.get(own, 0) + 1
                if told is not None and told == told:
                    (refused.difference_update if told else refused.update)(waiting)
                    waiting = set()
                chosen.append(text)
                reasons.append(why)
            yield frame[names].assign(asked=chosen, reason=reasons)

    dealt = df.repartition(F.col(conv)).sortWithinPartitions(conv, turn)
    return dealt.mapInPandas(run, out_schema)


def _free(df: DataFrame, base: str) -> str:
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def uncertain_replies(df: DataFrame, conv: str, turn: str, pool: Column, key: Column) -> DataFrame:
    """[MSC-37] A stock reply (reply_) for each row, drawn by a hash of the key, never the one before it in the conversation while the pool has another."""
    size = F.size(pool)
    draw = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long")
    df = df.withColumns({"pool_": pool, "draw_": draw})
    names = [c for c in df.columns if c not in ("pool_", "draw_")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names) + ", reply_ string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, started, last = None, False, None
        for frame in frames:
            out = []
            for c, options, d in zip(frame[conv], frame["pool_"], frame["draw_"], strict=True):
                c = None if c is None or c != c else c
                if not started or c != now:
                    now, started, last = c, True, None
                left = [x for x in options if x != last] or list(options)
                last = left[int(d) % len(left)] if left else None
                out.append(last)
            yield frame[names].assign(reply_=out)

    return df.where(size >= 0).repartition(F.col(conv)).sortWithinPartitions(conv, turn).mapInPandas(run, schema)
