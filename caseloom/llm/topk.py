"""Exact top-k inner products by columnar branch-and-bound.

Candidates are packed into vertical blocks (one row of the block per dimension). A block
meets a block of queries once: scores accumulate a few dimensions at a time, and after each
step a query keeps only the candidates whose partial score plus the largest product the
remaining dimensions allow (the product of the remaining norms) still reaches its k-th best
score so far. What survives all dimensions has its exact score.

Queries go out in rounds of at most ``query_bytes``: a round is a broadcast of that bound,
which every task of the candidates' scan searches, block by block, beginning each block with
the k-th best scores of those before. So no row is copied, whatever the number of queries,
and nothing is joined. Beyond one round the candidates' blocks are written once and scanned
by each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.llm import common

_STEP = 8
_LONG = (-(1 << 63), (1 << 63) - 1)


def _packed(size: int):
    """mapInArrow function: rows (id, values) to blocks of ``size`` (n, dims, ids, values), values one dimension after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []

        def block() -> pa.RecordBatch:
            dims = max((len(r) for r in rows), default=0)
            values = np.zeros((len(rows), dims))
            for i, r in enumerate(rows):
                values[i, : len(r)] = r
            out = pa.RecordBatch.from_arrays(
                [pa.array([len(rows)]), pa.array([dims]), pa.array([np.array(ids, dtype="<i8").tobytes()], pa.binary()), pa.array([np.ascontiguousarray(values.T, dtype="<f8").tobytes()], pa.binary())],
                names=["n", "dims", "ids", "vals"],
            )
            ids.clear()
            rows.clear()
            return out

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                rows.append(v.values.to_numpy(zero_copy_only=False))
                if len(ids) == size:
                    yield block()
        if ids:
            yield block()

    return run


_BLOCK = "n long, dims long, ids binary, vals binary"


def _unpacked(n: int, dims: int, ids: bytes, vals: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vals, "<f8").reshape(dims, n)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def bound_search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, found: list) -> None:
    """Improve found (per query: scores, ids) with the candidates c (dims x n); q is dims x queries."""
    dims = max(len(q), len(c))
    q, c = (np.vstack([x, np.zeros((dims - len(x), x.shape[1]))]) if len(x) < dims else x for x in (q, c))
    starts = list(range(0, dims, _STEP)) or [0]
    rest = lambda x: np.sqrt(np.stack([(x[min(s + _STEP, dims) :] ** 2).sum(axis=0) for s in starts]))
    c_rest, q_rest = rest(c), rest(q)
    probe = np.unique(np.linspace(0, c.shape[1] - 1, min(c.shape[1], 8 * k)).astype(int))
    for lo in range(0, q.shape[1], 256):
        part = slice(lo, min(lo + 256, q.shape[1]))
        first = q[: starts[1] if len(starts) > 1 else dims, part].T @ c[: starts[1] if len(starts) > 1 else dims]
        sampled = q[:, part].T @ c[:, probe]
        for j in range(part.stop - part.start):
            i = lo + j
            scores, ids = found[i]
            own = c_ids != q_ids[i]
            floor = scores[-1] if len(scores) == k else -np.inf
            seen = sampled[j][own[probe]]
            if len(seen) >= k:
                floor = max(floor, np.partition(seen, len(seen) - k)[len(seen) - k])
            alive, partial = np.flatnonzero(own), first[j][own]
            for s, start in enumerate(starts):
                if s:
                    stop = min(start + _STEP, dims)
                    partial = partial + q[start:stop, i] @ c[start:stop, alive]
                most = q_rest[s, i] * c_rest[s, alive]
                keep = partial + most * (1 + 1e-9) + 1e-6 >= floor
                if not keep.all():
                    alive, partial = alive[keep], partial[keep]
            found[i] = _best(np.concatenate([scores, partial]), np.concatenate([ids, c_ids[alive]]), k)


def _exact_search(q_ids, q, c_ids, c, k, found) -> None:
    """The same for components so large that doubles can't hold the products: whole integers, held to the range of a long."""
    whole = lambda x: [[int(v) for v in col] for col in x.T]
    qs, cs = whole(q), whole(c)
    for i, a in enumerate(qs):
        rows = list(zip(*found[i], strict=True))
        rows += [(min(max(sum(x * y for x, y in zip(a, b, strict=False)), _LONG[0]), _LONG[1]), int(n)) for b, n in zip(cs, c_ids, strict=True) if n != q_ids[i]]
        rows.sort(key=lambda r: (-int(r[0]), int(r[1])))
        found[i] = (np.array([int(r[0]) for r in rows[:k]], dtype=object), np.array([int(r[1]) for r in rows[:k]], dtype=np.int64))


def _search(k: int, asked):
    """mapInArrow function: blocks of candidates to each query's k best among a task's; asked: broadcast blocks of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [_unpacked(*row) for row in asked.value]
        found = [[(np.zeros(0), np.zeros(0, np.int64)) for _ in ids] for ids, _ in queries]
        high = [float(np.abs(q).max(initial=0)) for _, q in queries]
        for b in batches:
            for r in b.to_pylist():
                c_ids, c = _unpacked(r["n"], r["dims"], r["ids"], r["vals"])
                most = float(np.abs(c).max(initial=0))
                for (q_ids, q), best, top in zip(queries, found, high, strict=True):
                    small = top * most * max(len(q), len(c)) < 2**52
                    (bound_search if small and all(f[0].dtype != object for f in best) else _exact_search)(q_ids, q, c_ids, c, k, best)
        for (q_ids, _), best in zip(queries, found, strict=True):
            rows = [(int(q), int(i), int(s)) for q, (scores, ids) in zip(q_ids, best, strict=True) for s, i in zip(scores, ids, strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["query_id", "vec_id", "score"])

    return run


def quantised(vectors: Column, scale: float) -> Column:
    """floor(scale * x), x as double; null where the vector is null or has a null or non-finite component."""
    doubles = vectors.cast("array<double>")
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vectors.isNotNull() & ~bad, F.transform(doubles, lambda x: F.rint(x * F.lit(scale)) - F.when(F.rint(x * F.lit(scale)) > x * F.lit(scale), F.lit(1.0)).otherwise(F.lit(0.0))))


def top_k(
    candidates: DataFrame, queries: DataFrame, k: int = 10, *, id_column: str = "vec_id", vector_column: str = "embedding",
    scale: float = 1024.0, block: int = 4096, query_block: int = 2048, query_bytes: int = 1 << 25,
) -> DataFrame:
    """The k best candidates of each query: query_id, rank (from 1), vec_id, score (long).

    Components become floor(scale * x). A query is never its own candidate (rows with its
    id). Vectors that are null, or hold null or non-finite components, and rows with a null
    id take no part; a shorter vector counts as padded with zeros. Ties go to the smaller
    id. Repeated candidate rows are each listed. Several query rows of one id are one query:
    its list is the best of all their scores, where a candidate may stand once for each.
    Fewer candidates than k are all listed; without candidates or queries there are no rows.
    A score beyond the range of a long is its nearest end, so such scores tie. Other columns
    are not read.
    """

    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_column).cast("long").alias("id"), quantised(F.col(vector_column), scale).alias("v")).where("id is not null and v is not null")

    spark = candidates.sparkSession
    asked = usable(queries)
    count, dims = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    per_round = max(1, query_bytes // (8 * max(1, dims)))
    rounds = max(1, -(-count // per_round))
    c = usable(candidates).mapInArrow(_packed(block), _BLOCK)
    if rounds > 1:
        asked = common.kept(asked.withColumn("round", F.pmod(F.xxhash64("id", "v"), F.lit(rounds))), "queries")
        c = common.kept(c, "candidates")
    best = None
    for i in range(rounds):
        part = asked.where(F.col("round") == i).drop("round") if rounds > 1 else asked
        rows = part.coalesce(1 if rounds == 1 else 8).mapInArrow(_packed(min(query_block, per_round)), _BLOCK).collect()  # query_bytes, about
        sent = spark.sparkContext.broadcast([tuple(r) for r in rows])
        found = c.mapInArrow(_search(k, sent), "query_id long, vec_id long, score long")
        if rounds > 1:
            found = common.kept(found, "found")
            sent.destroy()
        best = found if best is None else best.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest rows of every row whose vec_id is divisible by 100."""
    vectors = common.table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
