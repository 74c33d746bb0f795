import numpy as np
from pyspark.sql import functions as F

from caseloom.llm import mixing
from tests.llm.helpers import MIXED, frame, words


def test_targets_are_reshared():
    got = mixing.targets([10, 100, 100], [3, 1, 2], 315, 2)
    assert got[0] == 20 and abs(sum(got) - 315) < 1e-9 and max(g / s for g, s in zip(got, [10, 100, 100], strict=True)) <= 2
    assert mixing.targets([], [], 0, 2) == [] and mixing.targets([0, 0], [3, 1], 0, 2) == [0, 0]


def test_splitting_tree_gives_every_block_once():
    quotas = np.array([37, 0, 5, 200])
    taken = [mixing.leaf_draws(quotas, 7, s, 1) for s in range(7)]
    assert (sum(h for h, _ in taken) == quotas).all()
    for a, b in zip(taken, taken[1:], strict=False):
        assert ((a[0] + a[1]) == b[1]).all()


def test_words_meet_targets_and_rows_survive(spark):
    docs = frame(spark, MIXED + [(100 + i, f"d{i} " * (i % 40 + 1), f"s{i % 3}") for i in range(200)])
    out = mixing.mix_documents(docs, shard_words=2000, blocks_per_shard=8).cache()
    assert {"mix_row", "Mix_size", "mix_size_"} <= set(out.columns)
    got = out.groupBy("mix_row", "doc_id").agg(F.sum("mix_words").alias("taken"), F.max("mix_size_").alias("size")).toPandas()
    assert (got.taken <= 2 * got["size"]).all() and set(got.doc_id.dropna()) == set(docs.toPandas().doc_id.dropna())
    for r in out.groupBy("source").agg(F.sum("mix_words").alias("k"), F.max("mix_target").alias("t")).collect():
        assert abs(r["k"] - r["t"]) <= 1
    for r in out.where("mix_copy >= 0").collect():
        assert len(words(r["text"])) == r["mix_words"]
    again = mixing.mix_documents(docs.repartition(5), shard_words=2000, blocks_per_shard=8, keep_text=False)
    key = ["mix_row", "mix_copy", "mix_shard", "mix_order"]
    assert sorted(map(str, out.select(*key).collect())) == sorted(map(str, again.select(*key).collect()))
    assert mixing.mix_documents(docs.limit(0)).count() == 0
