"""Chat formatting by columnar byte assembly, and reading the result back.

Rows of a conversation are put together without a loop over turns: each batch's segment
lengths (opening, header, content, footer) give cumulative offsets, and headers and contents
are scattered by index into one preallocated buffer, which becomes the Arrow column.

Template: ``<s>``, then per turn a header and a footer by role::

    user       [INST] TEXT [/INST]
    assistant  [ANS] TEXT</s>
    system     <<SYS>> TEXT <</SYS>>
    others     [ROLE]NAME[/ROLE]TEXT[/END]

In contents and names a backslash goes before every backslash and before every control
string, so that a control string without one is always the template's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import common

OPENING = "<s>"
ROLES = {"user": ("[INST] ", " [/INST]"), "assistant": ("[ANS] ", "</s>"), "system": ("<<SYS>> ", " <</SYS>>")}
CONTROL = ("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "[ROLE]", "[/ROLE]", "[/END]")
_CONTROL = "|".join(re.escape(c) for c in CONTROL)
_TOKEN = re.compile(rf"\\(?:\\|{_CONTROL})|{_CONTROL}")
_ESCAPED = re.compile(rf"\\(\\|{_CONTROL})")
TRAINED = "assistant"

FORMATTED = "formatted string, loss_spans array<struct<start: long, end: long>>"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern=rf"(\\|{_CONTROL})", replacement=r"\\\1")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _flat(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and where each string begins in them (and the end)."""
    a = a.cast(pa.large_string())
    offsets = np.frombuffer(a.buffers()[1], "<i8", len(a) + 1, a.offset * 8)
    data = a.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def _scatter(out: np.ndarray, at: np.ndarray, source: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
    """Copy source[begin[i]:begin[i] + length[i]] to out[at[i]:] for all i at once."""
    total = int(length.sum())
    if total:
        step = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(at, length) + step] = source[np.repeat(begin, length) + step]


def assemble(first: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Formatted conversations and their loss spans (bytes); first: at which rows a conversation begins."""
    kinds = roles.dictionary_encode()
    names, code = kinds.dictionary.to_pylist(), kinds.indices.to_numpy(zero_copy_only=False)
    other = escape(pa.array(names, pa.string())).to_pylist()
    marks = [ROLES.get(n) or (f"[ROLE]{e}[/ROLE]", "[/END]") for n, e in zip(names, other, strict=True)]
    (heads, head_at), (feet, foot_at) = (_flat(pa.array([m[i] for m in marks], pa.string())) for i in (0, 1))
    body, body_at = _flat(escape(texts))
    n_open, n_body = len(OPENING) * first.astype(np.int64), np.diff(body_at)
    n_head, n_foot = np.diff(head_at)[code], np.diff(foot_at)[code]
    ends = np.cumsum(n_open + n_head + n_body + n_foot)
    at = ends - (n_open + n_head + n_body + n_foot)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = np.flatnonzero(first)
    _scatter(out, at[starts], np.frombuffer(OPENING.encode(), np.uint8), np.zeros(len(starts), np.int64), n_open[starts])
    at = at + n_open
    _scatter(out, at, heads, head_at[:-1][code], n_head)
    at = at + n_head
    _scatter(out, at, body, body_at[:-1], n_body)
    _scatter(out, at + n_body, feet, foot_at[:-1][code], n_foot)
    base = np.append((ends - (n_open + n_head + n_body + n_foot))[starts], len(out))
    formatted = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(base.astype("<i8")), pa.py_buffer(out)).cast(pa.string())
    conv = np.cumsum(first) - 1
    mine = np.flatnonzero(code == names.index(TRAINED)) if TRAINED in names else np.zeros(0, np.int64)
    spans = pa.StructArray.from_arrays([pa.array(at[mine] - base[conv[mine]]), pa.array(at[mine] + n_body[mine] - base[conv[mine]])], ["start", "end"])
    counts = np.bincount(conv[mine], minlength=len(starts))
    return formatted, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), spans)


def format_chats(conversations: DataFrame, *, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (byte ranges of what is trained on).

    Turns are in order of turn, then role, then text; nulls come first. A null text is
    empty, a null role is the role named by the empty string. Rows with a null conv_id are
    one conversation. Repeated rows are turns of their own. Any text round-trips, control
    strings and backslashes too. An empty table gives no rows. Other columns are not read.
    A conversation is one string, so it must fit in 2 GB; a task holds one batch and one
    conversation at a time.
    """
    key = conversations.schema[conv_column]
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(key.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(b: pa.Table) -> pa.RecordBatch:
            keys = b.column(0).combine_chunks()
            first = new(keys)
            formatted, spans = assemble(first, b.column(1).combine_chunks(), b.column(2).combine_chunks())
            return pa.RecordBatch.from_arrays([keys.filter(pa.array(first)).cast(kind), formatted, spans], names=[conv_column, "formatted", "loss_spans"])

        def new(keys: pa.Array) -> np.ndarray:
            code = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            return np.append(True, code[1:] != code[:-1]) if len(code) else np.zeros(0, bool)

        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            last = int(np.flatnonzero(new(t.column(0).combine_chunks()))[-1]) if t.num_rows else 0
            if last:  # the last conversation may go on in the next batch
                yield out(t.slice(0, last))
            held = t.slice(last)
        if held is not None and held.num_rows:
            yield out(held.combine_chunks())

    rows = conversations.select(F.col(conv_column), F.coalesce(F.col(role_column).cast("string"), F.lit("")).alias("role_"), common.text_of(F.col(text_column).cast("string")).alias("text_"), F.col(turn_column).alias("turn_"))
    rows = rows.repartition(F.col(conv_column)).sortWithinPartitions(conv_column, "turn_", "role_", "text_")
    return rows.select(conv_column, "role_", "text_").mapInArrow(run, f"{conv_column} {key.dataType.simpleString()}, {FORMATTED}")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    marks = [m for m in _TOKEN.finditer(formatted) if m[0][0] != "\\"]
    turns, i = [], 1
    by_head = {h.strip(): (role, h, f) for role, (h, f) in ROLES.items()}
    while i < len(marks):
        m = marks[i]
        if m[0] == "[ROLE]":
            turns.append((unescape(formatted[m.end() : marks[i + 1].start()]), unescape(formatted[marks[i + 1].end() : marks[i + 2].start()])))
            i += 3
        else:
            role, head, foot = by_head[m[0]]
            end = marks[i + 1].start() - (len(foot) - len(foot.strip()))
            turns.append((role, unescape(formatted[m.start() + len(head) : end])))
            i += 2
    return turns


def read_chats(formatted: DataFrame, *, conv_column: str = "conv_id") -> DataFrame:
    """Formatted conversations back to turns (array of role, text) and trained (all text under the loss mask)."""
    key = formatted.schema[conv_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column(1).to_pylist(), b.column(2).to_pylist()
            turns = [[{"role": r, "text": t} for r, t in parse(x)] for x in texts]
            trained = ["".join(unescape(raw[s["start"] : s["end"]].decode()) for s in ss) for raw, ss in ((x.encode(), ss) for x, ss in zip(texts, spans, strict=True))]
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(turns, kind), pa.array(trained, pa.string())], names=[conv_column, "formatted", "turns", "trained"])

    rows = formatted.select(conv_column, "formatted", "loss_spans")
    return rows.mapInArrow(run, f"{conv_column} {key}, formatted string, turns array<struct<role: string, text: string>>, trained string")


#: A conversation made of the template's own control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from every formatted conversation."""
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    back = read_chats(format_chats(rows))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = r"regexp_replace(t, '(\\|<<SYS>>|<</SYS>>|<s>|</s>|\[INST\]|\[/INST\]|\[ANS\]|\[ROLE\]|\[/ROLE\]|\[/END\])', '\\\1', 'g')"
OP10_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length({_ESC}) + CASE r WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 WHEN 'system' THEN 17
    ELSE 19 + length({_ESC.replace("(t,", "(r,")}) END AS n
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
