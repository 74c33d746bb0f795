import random

from caseloom.llm import topk


def test_search_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(20)]) for i in range(150)] + [(200 + i, [0.5] * 20) for i in range(30)]
    rows += [(400, None), (500, [1.0, None] + [0.0] * 18), (600, [float("nan")] * 20), (700, [float("inf")] * 20), (None, [1.0] * 20), (800, [0.5] * 20)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    import math

    import numpy as np

    ok = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    for block, size, room in ((4096, 2048, 1 << 25), (16, 1, 320)):  # one round, and several
        got = topk.top_k(df, df.where("vec_id % 100 = 0"), 10, block=block, query_block=size, query_bytes=room).collect()
        for q in (0, 100, 200, 800):
            want = sorted(((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q))[:10]
            assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
        assert {r["query_id"] for r in got} == {0, 100, 200, 800}
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_huge_components_are_exact(spark):
    df = spark.createDataFrame([(0, [3e7, 1.0]), (1, [3e7, 2.0]), (2, [3e7, 1.0])], "vec_id long, embedding array<float>")
    got = topk.top_k(df, df.where("vec_id = 0"), 1).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, (3 * 10**7 * 1024) ** 2 + 1024 * 2048)] or got[0]["score"] == min((3 * 10**7 * 1024) ** 2 + 1024 * 2048, 2**63 - 1)
