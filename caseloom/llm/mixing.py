"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is a stream of words: its documents in an order drawn from the seed. A source's
target takes the stream whole as often as it fits in (an epoch each), then a part of one
more epoch. Streams are cut into blocks of ``block_words`` words; the blocks that a target
comes to are the source's quota. A binary tree splits the vector of quotas among the output
shards: at each node the left half of the shards gets a multivariate-hypergeometric draw of
the node's blocks, the right half the rest. So a leaf has a range of each source's quota,
and the places of that range, permuted by a keyed Feistel network, are the blocks that it
takes: no two leaves share one, and of an epoch that is taken in part the blocks are a
random choice. The last block of a quota is cut where the target is met, to the word.
A document at the edge of a block may be cut there. Inside a shard rows are shuffled by a
seeded hash.

Places in a stream are exact prefix sums in three levels (256 cells of a hash, 256 cells
within each, then the documents of one small cell), so that a source holding a third of all
rows is never in one task. On the driver there is one row per source and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.llm import common

WEIGHTS = (3.0, 1.0, 2.0)


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of total by weight; none above most times its size, the excess reshared by weight until none is."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / weight for i in open_}
        full = [i for i in open_ if share[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = share[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def leaf_draws(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks of each source for the shard, blocks of each source that earlier shards have)."""
    have, before = quotas.astype(np.int64), np.zeros(len(quotas), np.int64)
    lo, hi = 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        total = int(have.sum())
        left = total * (mid - lo) // (hi - lo)
        rng = np.random.Generator(np.random.Philox(key=[seed, (lo << 32) + hi]))
        drawn = rng.multivariate_hypergeometric(have, left, method="marginals") if 0 < left < total else have * (left > 0)
        if shard < mid:
            have, hi = drawn, mid
        else:
            before, have, lo = before + drawn, have - drawn, mid
    return have, before


def permuted(places: np.ndarray, n: int, *key: int) -> np.ndarray:
    """The images of places in 0..n-1 under a permutation of 0..n-1 drawn from the key; any part of it can be computed alone."""
    if n < 2 or not len(places):
        return places.astype(np.int64)
    half = max(1, -(-(n - 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    words = np.random.SeedSequence(key).generate_state(6, np.uint64)

    def turn(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for w in words:
            mixed = (right + w) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = turn(places.astype(np.uint64))
    while (far := np.flatnonzero(out >= n)).size:  # walk on until back in range; every place gets there
        out[far] = turn(out[far])
    return out.astype(np.int64)


def blocks_of(size: int, quota: int, block: int) -> tuple[int, int, int, int]:
    """(whole epochs, blocks of an epoch, blocks taken of the last epoch, words of the last block taken) for a stream and a quota in words."""
    if not size or not quota:
        return 0, 1, int(size == 0), 0
    epochs = (quota - 1) // size
    rest = quota - epochs * size
    drawn = -(-rest // block)
    return epochs, -(-size // block), drawn, rest - (drawn - 1) * block


def leaf_blocks(first: int, have: int, size: int, quota: int, block: int, *key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(epoch, block, end) of the quota's places first..first+have-1; end: how far into the stream the block is taken."""
    epochs, whole, drawn, last = blocks_of(size, quota, block)
    place = permuted(np.arange(first, first + have), epochs * whole + drawn, *key, 0)
    epoch = np.minimum(place // whole, epochs)
    at = place - epoch * whole
    # of the last epoch: its blocks in a drawn order, the short one at the stream's end after all others
    some = (epoch == epochs) & (at < whole - 1)
    number = at.copy()
    number[some] = permuted(at[some], whole - 1, *key, 1)
    end = np.minimum((number + 1) * block, size)
    cut = (epoch == epochs) & (at == drawn - 1)
    end[cut] = number[cut] * block + last
    return epoch, number, end


def mix_documents(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5, most: float = 2.0, shard_words: int = 1 << 20, blocks_per_shard: int = 64, seed: int = 20, keep_text: bool = True,
) -> DataFrame:
    """The mix: one row per piece of a document that a block takes, and one with copy -1 per document that none takes.

    Columns: all of the input, then mix_row (a long for each input row), mix_size,
    mix_source_size, mix_target, mix_copy (the epoch: 0, 1, ...), mix_from (the piece's first
    word), mix_words (its words: all of the document, unless a block ends in it), mix_shard
    and mix_order (the place in the shard's shuffle). With keep_text the text of a piece is
    the piece's. A source's words come to its rounded target exactly, and a document gives
    each of its words at most once an epoch.

    Sources are weighed in code point order, null last, by the weights in turn. A null or
    empty text has no words; it is a row of no words wherever its place is taken. Repeated
    rows and ids are documents of their own. Names of the new columns get underscores where
    the input has them. An empty table gives no rows. The driver holds one row per source.
    """
    spark = docs.sparkSession
    names = {n: common.free_name(docs, n) for n in ("mix_row", "mix_size", "mix_source_size", "mix_target", "mix_copy", "mix_from", "mix_words", "mix_shard", "mix_order")}
    text = common.text_of(F.col(text_column).cast("string"))
    source = F.col(source_column).cast("string")
    # one narrow row per document; which of several equal rows is which doesn't matter
    digest = F.xxhash64(F.col(id_column), text, source)
    drawn = F.xxhash64(digest, F.lit(seed))
    own = [F.col(id_column).alias("id"), digest.alias("digest"), drawn.alias("h"), source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source"), F.regexp_count(text, F.lit(common.WORD)).cast("long").alias("size")]
    sized = docs.select(*own).withColumn("a", F.shiftrightunsigned("h", 56)).withColumn("b", F.shiftrightunsigned("h", 48).bitwiseAND(F.lit(255)))
    sized = common.durable(sized)
    cells = common.durable(sized.groupBy("no_source", "source", "a", "b").agg(F.sum("size").alias("words")))
    key = ["no_source", "source"]
    upper = cells.groupBy(*key, "a").agg(F.sum("words").alias("words"))
    before = lambda *by: F.coalesce(F.sum("words").over(Window.partitionBy(*key, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upper_at = upper.select(*key, "a", before("a").alias("at_a"))
    cell_at = cells.withColumn("at_b", before("a", "b")).join(upper_at, [*key, "a"]).select(*key, "a", "b", (F.col("at_a") + F.col("at_b")).alias("cell_at"))

    known = upper.groupBy(*key).agg(F.sum("words").alias("words")).collect()
    known.sort(key=lambda r: (r["no_source"], r["source"]))
    sizes = [int(r["words"]) for r in known]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(known))], share * sum(sizes), most)
    quota_words = [round(x) for x in aims]
    shards = max(1, -(-sum(quota_words) // shard_words))
    block = max(1, shard_words // blocks_per_shard)
    shape = [blocks_of(s, w, block) for s, w in zip(sizes, quota_words, strict=True)]
    quotas = np.array([epochs * whole + drawn for epochs, whole, drawn, _ in shape], dtype=np.int64)

    rank = Window.partitionBy(*key, "a", "b").orderBy("h", "id", "size")
    placed = (
        sized.withColumn("words", F.col("size"))
        .withColumn("rank", F.row_number().over(rank))
        .withColumn("in_cell", F.coalesce(F.sum("words").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(cell_at, [*key, "a", "b"])
        .withColumn("place", F.col("cell_at") + F.col("in_cell"))
    )
    kinds = "no_source boolean, source string, nth int, source_size long, target double, epochs int, whole long"
    facts = spark.createDataFrame([(r["no_source"], r["source"], i, s, a, f[0] + (f[2] > 0), f[1]) for i, (r, s, a, f) in enumerate(zip(known, sizes, aims, shape, strict=True))], kinds)
    # few sources: broadcast; else the join is left to the planner
    placed = placed.join(F.broadcast(facts) if len(known) <= 100_000 else facts, key)
    # a row for each epoch and each block that a document touches
    last_block = F.floor((F.col("place") + F.greatest(F.col("size") - 1, F.lit(0))) / F.lit(block))
    inside = lambda c: F.least(c, F.col("whole") - 1)
    touched = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.col("epochs") - 1, F.lit(0)))))
    touched = touched.withColumn("block", F.explode(F.sequence(inside(F.floor(F.col("place") / F.lit(block))), inside(last_block))))

    facts_of = list(zip(sizes, quota_words, strict=True))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard in b["id"].tolist():
                have, first = leaf_draws(quotas, shards, shard, seed)
                for nth, (size, quota) in enumerate(facts_of):
                    if have[nth]:
                        epoch, number, end = leaf_blocks(int(first[nth]), int(have[nth]), size, quota, block, seed, nth)
                        yield pd.DataFrame({"nth": np.full(len(epoch), nth, np.int32), "copy": epoch.astype(np.int32), "block": number, "end": end, "shard": np.full(len(epoch), shard, np.int64)})

    plan = spark.range(0, shards, 1, min(shards, 512)).mapInPandas(split, "nth int, copy int, block long, end long, shard long")
    begin = F.greatest(F.col("place"), F.col("block") * F.lit(block))
    out = touched.join(plan, ["nth", "copy", "block"]).withColumn("from", begin - F.col("place"))
    out = out.withColumn("words_taken", F.greatest(F.least(F.col("place") + F.col("size"), F.col("end")) - begin, F.lit(0))).where("words_taken > 0 or size = 0")
    out = out.withColumn("order", F.xxhash64("h", "rank", "copy", "block", F.lit(seed + 1)))
    none = {"shard": F.lit(None).cast("long"), "order": F.lit(None).cast("long"), "copy": F.lit(-1), "from": F.lit(0).cast("long"), "words_taken": F.lit(0).cast("long")}
    taken = common.kept(out.select("id", "digest", "rank", "size", "source_size", "target", "copy", "from", "words_taken", "shard", "order"), "taken")
    rest = placed.join(taken.select("digest", "rank").distinct(), ["digest", "rank"], "left_anti").withColumns(none)
    cols = ["id", "digest", "rank", "size", "source_size", "target", "copy", "from", "words_taken", "shard", "order"]
    rows = taken.select(*cols).unionByName(rest.select(*cols))
    rows = rows.withColumn("row", F.xxhash64("digest", "rank", "size"))
    new = {"mix_row": "row", "mix_size": "size", "mix_source_size": "source_size", "mix_target": "target", "mix_copy": "copy", "mix_from": "from", "mix_words": "words_taken", "mix_shard": "shard", "mix_order": "order"}
    narrow = rows.select("id", "digest", "rank", *[F.col(v).alias(names[k]) for k, v in new.items()])
    if not keep_text:
        return narrow.select(F.col("id").alias(id_column), *[names[k] for k in new])
    # back to the whole rows: equal rows are told apart by their rank among themselves
    own_digest, own_twin = common.free_name(docs, "digest"), common.free_name(docs, "twin")
    whole = docs.withColumn(own_digest, digest)
    whole = whole.withColumn(own_twin, F.row_number().over(Window.partitionBy(own_digest).orderBy(F.lit(0))))
    narrow = narrow.withColumn("twin_of", F.dense_rank().over(Window.partitionBy("digest").orderBy("rank"))).drop("id", "rank")
    narrow = narrow.withColumnsRenamed({"digest": own_digest}).withColumnsRenamed({"twin_of": own_twin})
    full = whole.join(narrow, [own_digest, own_twin]).drop(own_digest, own_twin)
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{common.WORD}"), F.lit(0)), (F.col(names["mix_from"]) + 1).cast("int"), F.col(names["mix_words"]).cast("int")), "")
    partial = (F.col(names["mix_copy"]) >= 0) & (F.col(names["mix_words"]) < F.col(names["mix_size"]))
    full = full.withColumn(text_column, F.when(partial, cut).otherwise(F.col(text_column)))
    return full.select(*docs.columns, *[names[k] for k in new])


def shuffled(mix: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """The taken pieces, the rows of each shard together and in its shuffled order. names: those of mix_copy, mix_shard and mix_order, if they are others."""
    copy, shard, order = ((names or {}).get(n, n) for n in ("mix_copy", "mix_shard", "mix_order"))
    return mix.where(F.col(copy) >= 0).repartition(F.col(shard)).sortWithinPartitions(shard, order)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of its words the mix takes from every document."""
    mix = mix_documents(common.table(spark, sf_dir, "documents"), keep_text=False)
    same = ["doc_id", "mix_row", "mix_size", "mix_source_size", "mix_target"]
    return mix.groupBy(*same).agg(F.sum("mix_words").alias("taken")).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), "taken")
