
from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the log format: they must be these for right results.
RETRIEVAL_QUERY = r"(?i)\[RETRIEVAL QUERY:\s*(.+?)\]"
RETRIEVAL_MARKER = r"(?i)\[RETRIEVAL QUERY:[^\]]*\]\s*"
RETRIEVAL_RESULT = ("[RETRIEVAL RESULT]\n", "\n\n", "\n[/RETRIEVAL RESULT]")
DIAGNOSIS_MARKER = "[DIAGNOSIS]"
FACT_QUESTION = "Can you tell me whether this applies to you: {}?"
#: Replies that say nothing.
UNINFORMATIVE = (
    r"\bi\s+don'?t\s+know\b", r"\bi\s+do\s+not\s+know\b", r"\bnot\s+(?:totally\s+)?sure\b", r"\bcan'?t\s+remember\b", r"\bcannot\s+remember\b", r"\bno\s+idea\b",
    r"\bwhy\s+does\s+that\s+matter\b", r"\bwhy\s+do\s+you\s+need\b", r"\bwhy\s+do\s+you\s+want\b", r"\bi\s+haven'?t\s+noticed\b", r"\bi\s+have\s+not\s+noticed\b",
)
#: Evidence that is no evidence, unless one of the substantive words and six words or more are there.
EVASIVE = (
    "not sure", "don't know", "do not know", "i'm not sure", "no idea", "can't say", "cannot say", "unsure", "unclear", "no answer", "don't think", "do not think", "don't think so",
    "haven't noticed", "have not noticed", "not certain", "i'm not certain", "why does that matter", "why are you asking", "why is that important",
)
LAB_FACTS = (
    "culture", "maltose", "capsule", "ferment", "lab ", "laboratory", "imaging", "x-ray", "xray", " mri", " ct ", "gram stain", "gram-negative", "gram positive", "fluid shows",
    "test result", "blood work", "wbc", "cbc",
)
LAB_EVIDENCE = (
    "culture", "lab", "test", "result", "positive", "negative", "bacteria", "ferment", "maltose", "capsule", "gram", "fluid", "scan", "imaging", "x-ray", "xray", "mri", "ct ",
    "specimen", "grown", "showed",
)
SUBSTANTIVE = (*LAB_EVIDENCE, "fever", "pain", "swollen", "urination", " pee", "knee", "joint", "antibiotic", "medication", "started", "inflamm")
ORDERS = r"(?i)^\s*(?:order|obtain|schedule|refer|prescribe|consult)\b"
#: Words that tell nothing of a fact.
STOPWORDS = (
    "the", "and", "for", "with", "that", "this", "from", "have", "has", "had", "been", "were", "was", "are", "is", "she", "her", "his", "him", "they", "them", "their",
    "patient", "presents", "comes", "because", "during", "over", "last", "past", "about", "into", "onto", "also", "than", "then", "when", "while", "after", "before",
    "being", "does", "did", "not", "any", "all", "but", "who", "whom", "which", "what", "there", "here", "very", "more", "most", "some", "such", "only", "other", "into",
    "out", "up", "down", "of", "to", "in", "on", "at", "by", "an", "or", "as", "a",
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, however often and in whichever lambda it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether a text has any of the terms, in any case."""
    return F.lower(text).rlike("|".join(re.escape(t.lower()) for t in terms)) if terms else F.lit(False)


def normalize_question(text: Column, marker: str = RETRIEVAL_MARKER) -> Column:
    """[FN-1] The retrieval marker off, white space single, lower case, closing marks off."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), marker, "")
    return F.rtrim(F.lower(F.ltrim(F.regexp_replace(bare, r"(?U)\s+", " "))), F.lit("?.! "))


def normalize_fact(text: Column) -> Column:
    """[FN-18] White space single, ends trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def strip_fact_index(text: Column) -> Column:
    """[PRJ-19, MSC-45] A leading number with its mark off."""
    return F.trim(F.regexp_replace(text, r"^\s*\d+\s*[.):-]\s*", ""))


def normalize_facts(facts: Column) -> Column:
    """[PRJ-19] All facts without numbers, empty ones dropped."""
    return F.filter(F.transform(facts, strip_fact_index), lambda x: x != "")


def content_tokens(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """[FN-19] Lower-case letters and digits, more than two, not a stop word."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stopwords))


def strip_markers(text: Column, marker: str = RETRIEVAL_MARKER) -> Column:
    """[FN-14] Internal markers off."""
    return F.trim(F.regexp_replace(text, marker, ""))


def retrieval_query(text: Column, marker: str = RETRIEVAL_QUERY) -> Column:
    """[FN-13] What the first retrieval marker asks for; null without one."""
    return F.when(text.rlike(marker), F.trim(F.regexp_extract(text, marker, 1)))


def passages_block(passages: Column, marks: tuple[str, str, str] = RETRIEVAL_RESULT) -> Column:
    """[FN-15] Passages between delimiters."""
    before, between, after = marks
    return F.concat(F.lit(before), F.array_join(passages, between), F.lit(after))


def is_uninformative(text: Column, patterns: Sequence[str] = UNINFORMATIVE) -> Column:
    """[FLT-8] A blank reply or one of the stock phrases."""
    said = F.trim(F.coalesce(text, F.lit("")))
    return (said == "") | said.rlike("(?i)" + "|".join(patterns))


def is_evasive(evidence: Column, phrases: Sequence[str] = EVASIVE, markers: Sequence[str] = SUBSTANTIVE) -> Column:
    """[FLT-9] An evasive phrase, unless a substantive word comes with six words or more."""
    words = F.size(F.regexp_extract_all(evidence, F.lit(r"(?U)\w+"), F.lit(0)))
    return contains_any(evidence, phrases) & ~(contains_any(evidence, markers) & (words >= 6))


def is_lab(text: Column, hints: Sequence[str] = LAB_FACTS) -> Column:
    """[FLT-11] A fact of the laboratory or of imaging."""
    return contains_any(text, hints)


def is_lab_evidence(text: Column, hints: Sequence[str] = LAB_EVIDENCE) -> Column:
    """[FLT-12] Evidence that can stand for such a fact."""
    return contains_any(text, hints)


def scorable_facts(facts: Column, orders: str = ORDERS) -> Column:
    """[FLT-7] Facts that aren't a physician's orders."""
    return F.filter(facts, lambda f: ~f.rlike(orders))


def quoted_from(evidence: Column, conversation: Column, share: float = 0.8) -> Column:
    """[FLT-10] The evidence stands in what was said, or enough of its words longer than two do; false if nothing was said."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))

    def told(x: Column) -> Column:
        e, c = x["e"], x["c"]
        words = F.filter(F.regexp_extract_all(e, F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.length(w) > 2)
        return (c != "") & (F.contains(c, e) | bound(words, lambda ws: (F.size(ws) > 0) & (F.size(F.filter(ws, lambda w: F.contains(c, w))) >= F.lit(share) * F.size(ws))))

    return bound(F.struct(plain(evidence).alias("e"), plain(conversation).alias("c")), told)


def red_flag_missed(conversation: Column, flags: Column) -> Column:
    """[FLT-14] Some flag has none of its words longer than two in the conversation."""
    words = lambda f: F.filter(F.split(F.lower(f), r"\s+"), lambda w: F.length(w) > 2)
    return F.coalesce(bound(F.lower(conversation), lambda low: F.exists(flags, lambda f: ~F.exists(words(f), lambda w: F.contains(low, w)))), F.lit(False))


def snippet(corpus: Column, needle: Column, before: int = 20, after: int = 80) -> Column:
    """[FN-20] The surroundings of the first match, with ellipses where cut; null without a match."""
    at = F.call_function("locate", needle, corpus)
    start = F.greatest(at - before, F.lit(1))
    stop = F.least(at + F.length(needle) - 1 + after, F.length(corpus))
    cut = F.substring(corpus, start, stop - start + 1)
    out = F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(stop < F.length(corpus), "...").otherwise(""))
    return F.when(at > 0, out)


def fact_in_context(fact: Column, corpus: Column, case_age: Column | None = None, share: float = 0.6, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """[FN-21, MSC-1] Laboratory facts never match; the case's age does; else enough content words stand in the corpus."""
    has = lambda x: (F.size(x["t"]) > 0) & (F.size(F.filter(x["t"], lambda w: F.contains(x["c"], w))) >= F.lit(share) * F.size(x["t"]))
    enough = bound(F.struct(F.lower(corpus).alias("c"), content_tokens(fact, stopwords).alias("t")), has)
    out = F.when(is_lab(fact), False)
    if case_age is not None:
        age = F.regexp_extract(fact, r"(?i)\b(\d{1,3})[- ]?(?:years?|yo|y/o)\b", 1)
        out = out.when((age != "") & (age == case_age.cast("string")), True)
    return out.otherwise(enough)


def category_by_keywords(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str = "Other") -> Column:
    """[PRJ-11] The first rule, in order, of which a keyword stands in the text."""
    out = F.lit(default)
    for name, words in reversed(rules):
        out = F.when(contains_any(text, words), F.lit(name)).otherwise(out)
    return out


def age_of(text: Column) -> Column:
    """[PRJ-12] A stated age in years as text; null without one."""
    found = F.regexp_extract(text, r"(?i)\b(\d{1,3})[- ]?(?:years?[- ]?old|yo|y/o)\b", 1)
    return F.when(found != "", found)


def sex_of(text: Column) -> Column:
    """[PRJ-12] Female words are looked for first."""
    return F.when(text.rlike(r"(?i)\b(?:woman|female|girl|she|her)\b"), "female").when(text.rlike(r"(?i)\b(?:man|male|boy|he|his)\b"), "male")


def parse_age(age: Column) -> Column:
    """[PRJ-28, FN-30] The first number, if 1 to 119."""
    n = F.regexp_extract(age.cast("string"), r"(\d+)", 1).try_cast("int")
    return F.when(n.between(1, 119), n)


def first_sentence(text: Column, most: int = 400) -> Column:
    """[PRJ-13] The first sentence of the first line that isn't blank: up to a stop followed by white space; at most so many characters."""
    line = F.get(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    return F.substring(F.coalesce(F.split(line, r"(?<=[.!?])\s+")[0], F.lit("")), 1, most)


def voice_band(age: Column) -> Column:
    """[PRJ-29] Whose voice speaks at an age."""
    return F.when(age < 13, "child_parent").when(age <= 17, "teen").when(age >= 65, "older_adult").otherwise("adult")


def parent_age(child_age: Column) -> Column:
    """[PRJ-30] 30 to 45."""
    return F.least(F.greatest(child_age + 28, F.lit(30)), F.lit(45))


def child_word(sex: Column) -> Column:
    """[PRJ-41]"""
    low = F.lower(F.coalesce(sex, F.lit("")))
    return F.when(low == "female", "daughter").when(low == "male", "son").otherwise("child")


def demographic_persona(age: Column) -> Column:
    """[PRJ-27] Under 18 or from 70 on the persona of low literacy, else the default."""
    return F.when((age < 18) | (age >= 70), "low_literacy").otherwise("default")


def first_jargon(text: Column, level: Column, terms: dict[str, Sequence[str]]) -> Column:
    """[PRJ-34] The first term of the level's list that stands in the text; null without one."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for name, words in terms.items():
        listed = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
        out = F.when(level == name, F.get(F.filter(listed, lambda t: F.contains(low, t)), F.lit(0))).otherwise(out)
    return out


def communication_cues(text: Column, cues: Sequence[tuple[str, str]]) -> Column:
    """[PRJ-33] Names of the patterns that the text matches, in order."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in cues]), lambda x: x.isNotNull())


def is_objective_question(text: Column, pattern: str = r"(?i)\b(?:temperature|blood pressure|pulse|lab|x-ray|exam|test results?)\b") -> Column:
    """[FLT-16]"""
    return text.rlike(pattern)


def is_narrative(text: Column, least: int = 120) -> Column:
    """[FLT-17] A long complaint, or one of several sentences."""
    return (F.length(text) >= least) | (F.size(F.split(F.trim(text), r"[.!?]\s")) > 2)


def transcript(questions: Column, answers: Column, opening: Column | None = None) -> Column:
    """[FN-22, JN-16] Numbered questions and answers, to the shorter list's end."""
    n = F.least(F.size(questions), F.size(answers))
    pairs = F.slice(F.arrays_zip(questions.alias("q"), answers.alias("a")), F.lit(1), n)
    lines = F.transform(pairs, lambda x, i: F.concat(F.lit("Q"), (i + 1).cast("string"), F.lit(": "), x["q"], F.lit("\nA"), (i + 1).cast("string"), F.lit(": "), x["a"]))
    body = F.array_join(lines, "\n")
    return body if opening is None else F.concat_ws("\n", opening, body)


def role_lines(messages: Column) -> Column:
    """[FN-24, FN-39] role: content, a line each."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def said_by(messages: Column, role: str, between: str = " ") -> Column:
    """[FN-25, FN-39b] What one role said, joined."""
    return F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: m["content"]), between)


def context_corpus(known: Column, complaint: Column, age: Column, sex: Column, question: Column, options: Column, messages: Column, asker: str = "doctor", answerer: str = "patient") -> Column:
    """[PRJ-23] All that is known before the first answer, lines without blanks."""
    until = F.coalesce(F.array_position(F.transform(messages, lambda m: m["role"]), answerer).cast("int"), F.lit(0))
    opening = F.when(until > 0, F.slice(messages, F.lit(1), F.greatest(until - 1, F.lit(0)))).otherwise(messages)
    said = F.transform(F.filter(opening, lambda m: m["role"] == asker), lambda m: m["content"])
    pieces = F.array(known, complaint, age.cast("string"), sex, question, F.array_join(F.map_values(options), " "), F.array_join(said, " "))
    return F.array_join(F.filter(pieces, lambda p: p.isNotNull() & (F.trim(p) != "")), "\n")


def format_options(options: Column) -> Column:
    """[FN-23] A letter and its text on each line, by letter."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def facts_block(facts: Column) -> Column:
    """[FN-39c] Facts a line each, without numbers."""
    return F.array_join(normalize_facts(facts), "\n")


def decompose(text: Column, most: int = 12) -> Column:
    """[FN-34, MSC-38] Sentences at full stops, blanks dropped, at most so many."""
    return F.slice(F.filter(F.transform(F.split(text, r"\."), lambda x: F.trim(x)), lambda s: s != ""), 1, most)


def select_by_numbers(reply: Column, facts: Column) -> Column:
    """[FN-35] Facts by a comma list of numbers from 1; other parts and numbers out of range are dropped."""
    numbers = F.transform(F.split(F.coalesce(reply, F.lit("")), ","), lambda x: F.trim(x).try_cast("int"))
    return F.transform(F.filter(numbers, lambda i: i.between(1, F.size(facts))), lambda i: F.get(facts, i - 1))


def fact_questions(facts: Column, form: str = FACT_QUESTION) -> Column:
    """[FN-3] A question for each fact that isn't blank, without its number; a fact that is a question stays."""
    before, after = form.split("{}")
    bare = F.transform(F.filter(F.transform(facts, lambda x: F.trim(x)), lambda f: f != ""), lambda f: F.regexp_replace(f, r"^\d+\.\s*", ""))
    return F.transform(bare, lambda f: F.when(f.endswith("?"), f).otherwise(F.concat(F.lit(before), f, F.lit(after))))


def safe_opening(age: Column, sex: Column, complaint: Column) -> Column:
    """[PRJ-32] Demographics and the complaint, nothing else."""
    return F.concat_ws(", ", F.concat(age.cast("string"), F.lit("-year-old")), sex, F.concat(F.lit("presenting with "), complaint))


def cell_text(share: Column, n: Column) -> Column:
    """[FN-32] Per cent and count; a dash and the count without a share, a dash without a count. Halves go to the even number: of a decimal share as it is written, of a double as its product with 100 comes out."""
    return F.when(n.isNull(), "—").when(share.isNull(), F.format_string("— (n=%d)", n)).otherwise(F.format_string("%.0f%% (n=%d)", F.bround(share * 100, 0).cast("double"), n))


def doctor_letter(key: Column) -> Column:
    """[FN-31]"""
    return F.upper(F.regexp_replace(key, "^doctor_", ""))


def option_text(options: Column, letter: Column) -> Column:
    """[PRJ-39, PRJ-16] The option of a letter, '' when there is none: keys and letter by their first character in upper case, A to D only."""
    first = lambda c: F.substring(F.upper(c), 1, 1)
    known = F.filter(F.map_entries(options), lambda e: first(e["key"]).isin(*"ABCD"))
    return F.coalesce(bound(first(letter), lambda x: F.try_element_at(F.filter(known, lambda e: first(e["key"]) == x), F.lit(-1))["value"]), F.lit(""))


def joined(values: Column, separator: str = " ") -> Column:
    """[FN-43] struct(n, first, text) of an array of texts: its length, its first element ('' without one) and all of it as one text."""
    some = F.coalesce(values, F.array().cast("array<string>"))
    return F.struct(F.size(some).alias("n"), F.coalesce(F.get(some, F.lit(0)), F.lit("")).alias("first"), F.array_join(some, separator).alias("text"))


def iso_time(at: Column) -> Column:
    """[FN-49] A time as ISO text, in the session's time zone and without it, with microseconds only where it has some."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(at, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(at, "SSSSSS"))).otherwise(""))


def encounter_id(at: Column) -> Column:
    """[FN-49] An encounter's id from the time it began at."""
    return F.concat(F.lit("enc_"), F.date_format(at, "yyyyMMdd_HHmmss_SSSSSS"))
