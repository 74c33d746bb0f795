"""Source divergence audit: how far the term shares of a language's sources lie apart, by dense term blocks.

Terms are counted per source inside the tasks, so that what is shuffled is bounded by distinct
terms, not by words. A language's kept terms are dealt to blocks by hash. A task holds one
block of one pair of source tiles as int64 matrices, sources by terms, takes all pairs of
rows by broadcasting, and returns a partial pair matrix and, per source, a heap of its most
over-used terms. Partial matrices are summed by aggregation and heaps merged by rank.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.llm import common

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Terms of a block and sources of a tile: a tile is at most 256 x about 4096 int64.
BLOCK_TERMS = 4096
TILE = 256
#: Cells of a broadcast difference of all pairs, and entries that a counting task holds.
CELLS = 4_000_000
HELD = 300_000
SALTS = 32
#: Bytes that stand in a term, lower-cased; all others part terms.
_TABLE = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and code points from 128 on in UTF-8 text; only A-Z is lower-cased."""
    return text.translate(_TABLE).split()


def shares(counts: np.ndarray, total: int, terms: int, smoothing: int = SMOOTHING) -> np.ndarray:
    """1 + floor(10^9 * (count + s) / (total + s * terms)), exactly, by long division in three digits of a thousand."""
    whole = total + smoothing * terms
    rest, out = counts.astype(np.int64) + smoothing, np.zeros(len(counts), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest %= whole
    return out + 1


def count_terms(docs: DataFrame) -> DataFrame:
    """docs: lang, source, t. Rows (lang, source, term, count, docs), several for a term of a source: one a task and time that its counts were passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (count, seen) in held.items():
                words = list(count)
                for lo in range(0, len(words), 100_000):
                    part = words[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([count[w] for w in part], pa.int64()), pa.array([seen[w] for w in part], pa.int64())],
                        names=["lang", "source", "term", "count", "docs"],
                    )

        for b in batches:
            lang, source, text = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            for i in range(len(b)):
                words = terms_of(text[i].as_py())
                count, seen = held.setdefault((lang[i], source[i]), [Counter(), Counter()])
                size -= len(count)
                count.update(words)
                seen.update(set(words))
                size += len(count)
                if size > HELD:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    return docs.select("lang", "source", F.col("t").cast("binary").alias("t")).mapInArrow(run, "lang string, source string, term string, count long, docs long")


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows (lang, source, term, count, whole, first) of terms in at least min_docs of their language's documents; whole counts the language, first marks one row of each term."""
    # summed by source first: a frequent term then has a row a source, not a row a source and task
    by = count_terms(docs).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    own = Window.partitionBy("lang", "term")
    by = by.withColumns({"df": F.sum("docs").over(own), "whole": F.sum("count").over(own), "first": (F.row_number().over(own.orderBy("source")) == 1).cast("int")})
    return by.where(F.col("df") >= min_docs).select("lang", "source", "term", "count", "whole", "first")


def group_sizes(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """A row per (lang, source): g (its place in the language), n (its kept words), lang_n, terms (kept in the language), groups."""
    sums = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.sum("first").alias("v"))
    own = Window.partitionBy("lang")
    out = groups.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    return out.select(
        "lang", "source", (F.row_number().over(own.orderBy("source")) - 1).cast("int").alias("g"), "n", F.sum("n").over(own).alias("lang_n"), F.sum("v").over(own).alias("terms"), F.count("*").over(own).cast("int").alias("groups"),
    )


def _tile(key: tuple, frame: pd.DataFrame, top: int, size: int) -> pd.DataFrame:
    """One block of one pair of tiles: partial pair sums, and on the diagonal the heaps."""
    lang, _, a, b = key
    v, lang_n = int(frame["terms"].iloc[0]), int(frame["lang_n"].iloc[0])
    heads = frame[frame["term"].isna()].drop_duplicates("g").sort_values("g")
    of = {int(g): i for i, g in enumerate(heads["g"])}
    rows = frame[frame["term"].notna()]
    codes, words = pd.factorize(rows["term"])
    at = rows["g"].map(of).to_numpy(dtype=np.int64)
    counts = np.zeros((len(of), len(words)), np.int64)
    counts[at, codes] = rows["count"].to_numpy(np.int64)
    p = np.stack([shares(counts[i], int(n), v) if len(words) else np.zeros(0, np.int64) for i, n in enumerate(heads["n"])])
    tiles = heads["g"].to_numpy() // size
    left, right = np.flatnonzero(tiles == a), np.flatnonzero(tiles == b)
    pairs = np.zeros((len(left), len(right)), np.int64)
    wide = max(1, CELLS // max(1, len(left) * len(right)))
    for lo in range(0, len(words), wide):
        x, y = p[left, lo : lo + wide], p[right, lo : lo + wide]
        pairs += np.abs(x[:, None, :] - y[None, :, :]).sum(axis=2)
    ids = heads["g"].to_numpy()
    out = [(lang, int(ids[i]), b, pairs[k].tolist(), len(words), None, None) for k, i in enumerate(left)]
    if a != b:
        out += [(lang, int(ids[j]), a, pairs[:, k].tolist(), len(words), None, None) for k, j in enumerate(right)]
    elif len(words):
        whole = np.zeros(len(words), np.int64)
        whole[codes] = rows["whole"].to_numpy(np.int64)
        q = shares(whole, lang_n, v)
        for i in range(len(ids)):
            over = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            best = heapq.nsmallest(top, ((int(q[j] - p[i, j]), words[j]) for j in over))
            out += [(lang, int(ids[i]), None, None, None, w, -f) for f, w in best]
    return pd.DataFrame(out, columns=["lang", "g", "tile", "sums", "seen", "term", "value"])


def audit_sources(
    docs: DataFrame, *, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block_terms: int = BLOCK_TERMS, tile: int = TILE,
) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: distances to the language's other sources, and the terms that a source uses most above its language.

    Null text, language and source are read as ''. A source without kept terms still has its
    pairs; a language without kept terms has pairs of 0 and no terms; a language of one source
    has no pairs. Repeated rows are documents of their own. Ties of value go to the smaller
    item by UTF-8. Any number of sources: matrices are tiles. Very long texts are counted
    whole. Other columns, whatever their names, are not read. An empty table gives no rows.
    Exact while a language has fewer than 9 * 10^15 words.
    """
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_column, "lang"), (source_column, "source"), (text_column, "t"))])
    counts = common.kept(kept_counts(own, min_docs), "counts")
    sizes = common.kept(group_sizes(own.select("lang", "source").distinct(), counts), "sizes")
    # a language may hold most rows: its sources' sizes are copied to salts, and rows find them by source and salt
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    blocks = F.greatest(F.ceil(F.col("terms") / block_terms), F.lit(1)).cast("int")
    tiles = F.ceil(F.col("groups") / tile).cast("int")
    rows = counts.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "source", "salt"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "term"), blocks).cast("int"))
    heads = sizes.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    heads = heads.withColumns({"term": F.lit(None).cast("string"), "count": F.lit(None).cast("long"), "whole": F.lit(None).cast("long")})
    cols = ["lang", "block", "g", "term", "count", "whole", "n", "lang_n", "terms", "groups"]
    both = rows.select(*cols).unionByName(heads.select(*cols))
    mine = F.floor(F.col("g") / tile).cast("int")
    both = both.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    both = both.withColumns({"a": F.least(mine, "other"), "b": F.greatest(mine, "other")})

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _tile(key, frame, top, tile)

    schema = "lang string, g int, tile int, sums array<long>, seen long, term string, value long"
    parts = common.kept(both.select("lang", "block", "a", "b", "g", "term", "count", "whole", "n", "lang_n", "terms").groupBy("lang", "block", "a", "b").applyInPandas(one, schema), "parts")
    summed = parts.where("sums is not null").select("lang", "g", "tile", "seen", F.posexplode("sums").alias("k", "part"))
    summed = summed.groupBy("lang", "g", (F.col("tile") * tile + F.col("k")).alias("h")).agg(F.sum("part").alias("part"), F.sum("seen").alias("seen"))
    zero = F.when(F.col("terms") > 0, F.expr(f"{SCALE * SMOOTHING}L div (n + {SMOOTHING}L * terms)")).otherwise(F.lit(0))
    left = sizes.select("lang", "g", "source", "terms", zero.alias("z"))
    right = sizes.select("lang", F.col("g").alias("h"), F.col("source").alias("item"), zero.alias("z_other"))
    unseen = (F.col("terms") - F.col("seen")) * F.abs(F.col("z") - F.col("z_other"))
    pairs = summed.where("g <> h").join(left, ["lang", "g"]).join(right, ["lang", "h"]).select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("part") + unseen).alias("value"))
    terms = parts.where("term is not null").join(left, ["lang", "g"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).unionByName(terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and over-used terms of all documents."""
    return audit_sources(common.table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, i, count(*) AS c FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(c) AS lc FROM c GROUP BY 1, 2 HAVING count(DISTINCT i) >= 30),
s AS (SELECT lang, source, term, sum(c.c) AS c FROM c JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(lc) AS n FROM k GROUP BY 1),
n AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN s USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(s.c, 0) AS c, 1 + (1000000000 * (CAST(coalesce(s.c, 0) AS HUGEINT) + 5)) // (n.n + 5 * v.v) AS p, 1 + (1000000000 * (CAST(k.lc AS HUGEINT) + 5)) // (v.n + 5 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 50"""
