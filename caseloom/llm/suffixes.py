"""Passages that repeat across documents, from a sparse suffix array.

Of all suffixes (one a word) only those stay that begin at a minimiser: the smallest hash of
26 words among 25 neighbouring ones. Any two equal passages of 50 words hold a minimiser at
the same place. The suffixes are sorted by their first four words, then by a hash of their
first 26, in range partitions; neighbours with the same 26 words from different documents
are matches. Each match is then extended to the left and right: the passages of 50 words
around a matched minimiser, one for each place where such a passage can begin, are sorted
and compared with their neighbours in the same way, and those that another document has too
are joined to the longest passages. Extending along the one nearest neighbour alone would
miss a passage whose left part one document shares and whose right part another.

Sorting by (content, document) in ranges leaves no key in one task, however common: of what
stands at the edges of the ranges, a few rows each, one more small comparison decides.
Documents with the same words are one in all this; where there are several, all of each is
a repeated passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import common
from caseloom.llm import shingles as S

MIN_WORDS = 50
_B = 0x9E3779B97F4A7C15
_B_INVERSE = pow(_B, -1, 1 << 64)


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, from prefix sums of a polynomial modulo 2**64."""
    n = len(h)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _B, np.uint64)]))
    back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _B_INVERSE, np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:n], dtype=np.uint64)])
    return S._mixed((sums[k:] - sums[: n - k + 1]) * back[: n - k + 1])


def _documents(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, part in S.slices(texts):
        h, counts = S.words(part)
        end = 0
        for c in counts.tolist():
            yield h[end : end + c]
            end += c


def minimisers(h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of runs of least // 2 + 1 words, for each window of least words the place of its smallest run)."""
    k = least // 2 + 1
    runs = _runs(h, k)
    window = np.lib.stride_tricks.sliding_window_view(runs, least - k + 1)
    return runs, np.argmin(window, axis=1) + np.arange(len(window))


def _neighbours(records: DataFrame, by: list[str], name: str) -> DataFrame:
    """doc, at of the records (by.., doc, at; longs) whose ``by`` another document has too: sorted, each compared with its neighbours."""
    width = len(by)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: np.ndarray | None = None  # the key that the range begins with
        rest = np.zeros((0, width + 2), np.int64)  # rows of the last key, while they are of one document
        known = False  # whether the last key is known to have several documents

        def batch(rows: np.ndarray, edge: bool) -> pa.RecordBatch:
            columns = [pa.array(np.full(len(rows), edge)), *[pa.array(np.ascontiguousarray(rows[:, j])) for j in range(width + 2)]]
            return pa.RecordBatch.from_arrays(columns, names=["edge", *by, "doc", "at"])

        def mark(rows: np.ndarray) -> np.ndarray:
            """Two rows with no place that tell other ranges of a key with several documents."""
            two = rows[[0, -1]].copy()
            two[:, -1] = -1
            two[1, -2] = two[0, -2] ^ 1
            return two

        for b in batches:
            rows = np.column_stack([c.to_numpy() for c in b.columns])
            if not len(rows):
                continue
            if first is None:
                first = rows[0, :width].copy()
            if len(rest):
                rows = np.concatenate([rest, rows])
            elif known and not (rows[0, :width] == last).all():
                known = False
            new = np.append(True, (rows[1:, :width] != rows[:-1, :width]).any(axis=1))
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(rows))
            several = rows[begin, width] != rows[end - 1, width]
            several[0] |= known
            edge = np.zeros(len(begin), bool)
            edge[0] = (rows[0, :width] == first).all()
            size = end - begin
            matched = np.repeat(several, size)
            if several[0] and edge[0] and not known:
                yield batch(mark(rows[: end[0]]), True)
            yield batch(rows[matched], False)
            if edge[0] and not several[0] and len(begin) > 1:
                yield batch(rows[: end[0]], True)
            last = rows[-1, :width].copy()
            known = bool(several[-1])
            rest = rows[:0] if known else rows[begin[-1] :]
            tail = rows[begin[-1] :][[0, -1]]
        if first is not None:
            yield batch(mark(tail) if known else rest, True)

    ranges = records.select(*by, "doc", "at").repartitionByRange(*by, "doc").sortWithinPartitions(*by, "doc")
    found = common.kept(ranges.mapInArrow(compare, "edge boolean, " + ", ".join(f"{c} long" for c in [*by, "doc", "at"])), name)
    edges = found.where("edge")
    shared = edges.groupBy(*by).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select(*by)
    late = edges.where("at >= 0").join(shared, by, "left_semi")
    return found.where("NOT edge").unionByName(late).select("doc", "at")


def merged_spans(starts: np.ndarray, least: int) -> list[dict[str, int]]:
    starts = np.unique(starts)
    cut = np.flatnonzero(np.diff(starts) > least)  # windows that overlap or touch are one passage
    return [{"start": int(a), "end": int(b) + least} for a, b in zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)], strict=True)]


def repeated_passages(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per passage: doc_id, start_word, end_word (exclusive), copies (documents with all the same words).

    A passage is a longest run of words that is covered by runs of min_words words (A-Z
    lower-cased) which also stand in another document; a document that others repeat whole
    is one passage. Repeats inside one document alone don't count. Null, empty and shorter
    texts have no passages. Rows with equal words repeat each other, whatever their ids;
    null ids pass through. Whole texts are compared; other columns are not read.
    """
    least = min_words
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), common.text_of(F.col(text_column).cast("string")).alias("t"))
    rows = rows.withColumn("doc", F.xxhash64("t"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(len(h), *S.digest(h)) for h in _documents(b.column(1))]
            cols = list(zip(*out, strict=True)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array(c, pa.int64()) for c in cols]], names=["id", "doc", "n", "d1", "d2"])

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches:
            heads, keys, owners, places = [], [], [], []
            for h, doc in zip(_documents(b.column(0)), b.column(1).to_pylist(), strict=True):
                if len(h) >= least and doc not in seen:
                    seen.add(doc)
                    runs, at = minimisers(h, least)
                    at = np.unique(at)
                    head = np.zeros(len(at), np.uint64)
                    for j in range(4):
                        head = (head << np.uint64(16)) | (h[at + j] >> np.uint64(48))
                    heads.append(head)
                    keys.append(runs[at])
                    owners.append(np.full(len(at), doc, np.int64))
                    places.append(at)
            if len(seen) > 500_000:
                seen.clear()
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (heads, keys, owners, places)], names=["head", "key", "doc", "at"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, owners, places = [], [], []
            for h, doc, matched in zip(_documents(b.column(0)), b.column(1).to_pylist(), b.column(2), strict=True):
                _, at = minimisers(h, least)
                place = np.flatnonzero(np.isin(at, matched.values.to_numpy()))
                keys.append(_runs(h, least)[place])
                owners.append(np.full(len(place), doc, np.int64))
                places.append(place)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(places))], names=["key", "doc", "at"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([merged_spans(x.values.to_numpy(), least) for x in b.column(1)], kind)], names=["doc", "spans"])

    signed = rows.select("id", "t", "doc").mapInArrow(sign, f"id {kind}, doc long, n long, d1 long, d2 long")
    signed = common.kept(signed.where(F.col("n") >= least), "signed")
    matched = _neighbours(rows.select("t", "doc").mapInArrow(suffixes, "head long, key long, doc long, at long"), ["head", "key"], "suffixes")
    pick = signed.groupBy("doc").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("pick"))  # one row of each text
    matched = matched.groupBy("doc").agg(F.collect_set("at").alias("matched")).join(pick, "doc")
    found = rows.alias("x").join(matched.alias("y"), F.expr("x.doc = y.doc AND x.id <=> y.pick.id")).select("x.t", "x.doc", "y.matched").mapInArrow(windows, "key long, doc long, at long")
    places = _neighbours(found, ["key"], "windows").groupBy("doc").agg(F.collect_set("at").alias("at"))
    own = places.mapInArrow(spans, "doc long, spans array<struct<start: bigint, end: bigint>>")

    classes = signed.groupBy("n", "d1", "d2").agg(F.count("*").alias("copies"), F.min("doc").alias("doc"))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n").alias("end")))
    classes = classes.join(own, "doc", "left")
    classes = classes.withColumn("spans", F.when(F.col("copies") > 1, whole).otherwise(F.col("spans"))).where("spans is not null")
    out = signed.join(classes, ["n", "d1", "d2"]).select("id", "copies", F.explode("spans").alias("s"))
    return out.select(F.col("id").alias(id_column), F.col("s.start").alias("start_word"), F.col("s.end").alias("end_word"), "copies")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that other documents have too."""
    return repeated_passages(common.table(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), c AS (SELECT ws, count(*) AS copies FROM w WHERE len(ws) >= {MIN_WORDS} GROUP BY ws),
p AS (SELECT doc_id, ws, copies, unnest(generate_series(1, len(ws) - {MIN_WORDS - 1})) AS i FROM w JOIN c USING (ws)),
h AS (SELECT doc_id, copies, md5(CAST(ws AS VARCHAR)) AS own, i, md5(array_to_string(ws[i:i + {MIN_WORDS - 1}], ' ')) AS k FROM p),
r AS (SELECT k FROM h GROUP BY k HAVING count(DISTINCT own) > 1),
x AS (SELECT doc_id, copies, i FROM h WHERE k IN (SELECT k FROM r)),
g AS (SELECT *, CASE WHEN i - lag(i) OVER v <= {MIN_WORDS} THEN 0 ELSE 1 END AS b FROM x WHERE copies = 1 WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM g)
SELECT doc_id, min(i) - 1 AS start_word, max(i) + {MIN_WORDS - 1} AS end_word, copies FROM s GROUP BY doc_id, copies, n
UNION ALL
SELECT doc_id, 0, len(ws), copies FROM w JOIN c USING (ws) WHERE copies > 1
"""
