
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the log format: they must be these for right results.
#: Where a letter stands in an upper-cased reply, most telling first.
LETTER_PATTERNS = (r"\b(?:ANSWER|CHOICE|LETTER)\s*[:\-]\s*([A-G])\b", r"\b([A-G])\s*[.):]\s*", r"\b([A-G])\b")
CONFIDENCE_PATTERN = r"\d+\.\d+"
#: Phrases of the five-point scale, in the order in which they are looked for.
LIKERT_PHRASES = (
    ("very confident", 5), ("somewhat confident", 4), ("neither confident nor unconfident", 3), ("neither confident or unconfident", 3),
    ("somewhat unconfident", 2), ("very unconfident", 1),
)
#: Heads of a rubric's sections and of the two parts of each.
RUBRIC_SECTIONS = {"sympton": "症状", "test": "医学检查项目", "diagnosis": "诊断结果", "basis": "诊断依据", "treatment": "治疗方案"}
RUBRIC_ANALYSIS, RUBRIC_CHOICE = "分析", "选项"
#: Prefixes that name who is spoken to; without one it is the first.
ADDRESSEES = {"医生": "<对医生讲>", "检查员": "<对检查员讲>"}
CONCLUSION_MARKER = "[DIAGNOSIS]"
#: Marks that part the words of a line when a lone letter is looked for.
LETTER_MARKS = r"[,.;@#()?!'/&:$]+"


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x))


def atomic_question(reply: Column) -> Column:
    """[FN-4, MSC-40] The last line with a question mark, what follows its last colon, without quotes; null without one."""
    line = F.try_element_at(F.filter(_lines(reply), lambda x: F.contains(x, F.lit("?"))), F.lit(-1))
    return F.trim(F.translate(F.try_element_at(F.split(line, ":"), F.lit(-1)), "\"'", ""))


def choice(reply: Column, options: Column) -> Column:
    """[FN-5, FN-12] A letter: the reply itself if it is A to D; else by line the first option whose text stands there, else the first option whose letter stands alone.

    Options are taken by letter; one without a text is found by its letter only.
    """
    whole = F.trim(reply)
    entries = F.array_sort(F.map_entries(options))

    def in_line(line: Column) -> Column:
        low, words = F.lower(line), F.split(F.regexp_replace(line, LETTER_MARKS, " "), r"\s+")
        by_text = F.filter(entries, lambda e: (e["value"] != "") & F.contains(low, F.lower(e["value"])))
        by_letter = F.filter(entries, lambda e: F.array_contains(words, e["key"]))
        return F.coalesce(F.get(by_text, F.lit(0))["key"], F.get(by_letter, F.lit(0))["key"])

    by_line = F.filter(F.transform(_lines(reply), in_line), lambda x: x.isNotNull())
    return F.when(whole.isin("A", "B", "C", "D"), whole).otherwise(F.get(by_line, F.lit(0)))


def labeled_field(reply: Column, label: str) -> Column:
    """[FN-7] What follows LABEL on its line, with or without a colon; null when absent or blank."""
    found = F.trim(F.regexp_extract(reply, rf"(?imd)^{label}\s*:?\s*(.+)$", 1))
    return F.when(found != "", found)


def structured_reply(reply: Column, options: Column) -> Column:
    """[FN-6, MSC-39] struct(letter, question, reason, abstain).

    A line that says only ABSTAIN, or the answer ABSTAIN, abstains and gives nothing else but
    the reason. Else a letter from the answer's line or from the whole; else a question, with
    which it abstains, as it does with neither. A blank reply neither answers nor abstains.
    """
    text = F.trim(F.coalesce(reply, F.lit("")))
    answer, asked = labeled_field(text, "ANSWER"), labeled_field(text, "QUESTION")
    gives_up = text.rlike(r"(?imd)^ABSTAIN\s*$") | F.coalesce(F.upper(answer) == "ABSTAIN", F.lit(False))
    letter = F.when(~gives_up, F.coalesce(choice(answer, options), choice(text, options)))
    question = F.when(~gives_up & letter.isNull(), F.when(F.contains(asked, F.lit("?")), asked).otherwise(atomic_question(text)))
    return F.struct(letter.alias("letter"), question.alias("question"), labeled_field(text, "REASON").alias("reason"), ((text != "") & letter.isNull()).alias("abstain"))


def ranked_letter(reply: Column, valid: Sequence[str] = tuple("ABCDEFG"), patterns: Sequence[str] = LETTER_PATTERNS) -> Column:
    """[FN-8] The upper-cased reply if it is a valid letter, else by pattern, most telling first; of each pattern only the first hit is tested."""
    up = F.upper(F.trim(F.coalesce(reply, F.lit(""))))
    hits = [up, *[F.regexp_extract(up, p, 1) for p in patterns]]
    return F.coalesce(*[F.when(h.isin(*valid), h) for h in hits])


def yes_no(reply: Column, neither: str | None = "NO") -> Column:
    """[FN-9] YES if yes stands in the reply, in any case and with its stops off; NO if no does; else what neither gives."""
    low = F.translate(F.lower(F.coalesce(reply, F.lit(""))), ".,;:", "")
    return F.when(F.contains(low, F.lit("yes")), "YES").when(F.contains(low, F.lit("no")), "NO").otherwise(F.lit(neither))


def confidence(reply: Column) -> Column:
    """[FN-10] The last number with a decimal point; null without one (no random stand-in)."""
    return F.try_element_at(F.regexp_extract_all(reply, F.lit(CONFIDENCE_PATTERN), F.lit(0)), F.lit(-1)).try_cast("double")


def likert(reply: Column, phrases: Sequence[tuple[str, int]] = LIKERT_PHRASES) -> Column:
    """[FN-11] The score of the first phrase of the list that stands in the reply; 0 without one."""
    low = F.translate(F.lower(F.coalesce(reply, F.lit(""))), ".,;:", "")
    out = F.lit(0)
    for phrase, score in reversed(phrases):
        out = F.when(F.contains(low, F.lit(phrase)), score).otherwise(out)
    return out


def strip_thinking(reply: Column) -> Column:
    """[FN-16] Reasoning blocks off, an unclosed one to the end; null is empty."""
    closed = F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?is)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(closed, r"(?is)<think>.*$", ""))


def strip_fence(reply: Column) -> Column:
    """[FN-17] A code fence around the whole off."""
    return F.trim(F.regexp_replace(F.trim(reply), r"(?s)^```[A-Za-z]*\s*\n?(.*?)\n?```$", "$1"))


def lenient_json(reply: Column, schema: T.StructType | str, default: Column | None = None) -> Column:
    """[FN-40] The reply without fences as JSON, else its outermost braces, else the default."""
    bare = strip_fence(reply)
    block = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.trim(c).startswith("{"), F.from_json(c, schema))
    out = F.coalesce(ok(bare), ok(block))
    return out if default is None else F.coalesce(out, default)


def verdict(reply: Column) -> Column:
    """[FN-26] CORRECT, unless INCORRECT stands in the reply."""
    up = F.upper(F.coalesce(reply, F.lit("")))
    return ~F.contains(up, F.lit("INCORRECT")) & F.contains(up, F.lit("CORRECT"))


def grade(reply: Column) -> Column:
    """[FN-28] The first of A, B, C, D that stands anywhere, by alphabet."""
    return F.coalesce(*[F.when(F.contains(reply, F.lit(g)), F.lit(g)) for g in "ABCD"])


def rubric_sections(reply: Column, sections: dict[str, str] | None = None) -> Column:
    """[FN-27] struct with each section's analysis and grade; null where a head or part is missing.

    A section runs from its head (# name) to the next head or three blank lines, a part from
    its head (## name) to the next or a blank line.
    """

    def part(name: str) -> Column:
        return rf"(?s)## {name}\n(.*?)(?=\n## |\n\n|\z)"

    fields = []
    for key, head in (RUBRIC_SECTIONS if sections is None else sections).items():
        body = F.regexp_extract(reply, rf"(?s)# {head}\n(.*?)(?=\n# |\n\n\n\n|\z)", 1)
        analysis, picked = (F.when(body.rlike(part(p)), F.trim(F.regexp_extract(body, part(p), 1))) for p in (RUBRIC_ANALYSIS, RUBRIC_CHOICE))
        fields += [analysis.alias(f"{key}_analysis"), grade(picked).alias(f"{key}_choice")]
    return F.struct(*fields)


def addressee(reply: Column, prefixes: dict[str, str] | None = None) -> Column:
    """[FN-29] struct(role, content) by the prefix; without one the first role is meant. Prefixes go wherever they stand."""
    prefixes = ADDRESSEES if prefixes is None else prefixes
    text = F.trim(reply)
    role, content = F.lit(next(iter(prefixes))), text
    for name, prefix in reversed(prefixes.items()):
        role = F.when(text.startswith(prefix), name).otherwise(role)
        content = F.replace(content, F.lit(prefix), F.lit(""))
    return F.struct(role.alias("role"), F.trim(content).alias("content"))


def has_conclusion(reply: Column, marker: str = CONCLUSION_MARKER) -> Column:
    """[FN-39d] The marker as it stands."""
    return F.contains(reply, F.lit(marker))


def letter_correct(letter: Column, gold: Column) -> Column:
    """[FN-33] Null when either is missing."""
    return F.when(letter.isNotNull() & gold.isNotNull(), F.upper(letter) == F.upper(gold))


def rubric_total(scores: Column, reply_responder: Column, threshold: int = 6) -> Column:
    """[PRJ-35] struct(total, responder): total as int, 0 on failure; the reply's own flag counts first."""
    total = F.coalesce(scores.try_cast("int"), F.lit(0))
    return F.struct(total.alias("total"), F.coalesce(reply_responder, total >= threshold).alias("responder"))
