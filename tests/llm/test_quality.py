import math
import random
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np

from caseloom.llm import quality
from tests.llm.helpers import LONG, MIXED, frame


def naive(text):
    """Some of the measures, character by character."""
    letter = lambda c: c.isascii() and c.isalpha() or ord(c) >= 128
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    up, low = (sum(c.isascii() and f(c) for c in text) for f in (str.isupper, str.islower))
    count, size = Counter(text.encode()), len(text.encode())
    share = lambda a, b: a / b if b else 0.0
    return {
        "log_chars": math.log1p(len(text)), "log_words": math.log1p(len(words)), "letters": share(sum(map(letter, text)), len(text)), "capitals": share(up, up + low),
        "digits": share(sum(c in "0123456789" for c in text), len(text)), "spaces": share(sum(c in " \t\n\r\x0b\x0c" for c in text), len(text)), "distinct_words": share(len(set(words)), len(words)),
        "top_word": share(max(Counter(words).values(), default=0), len(words)), "repeats": share(sum(a == b for a, b in pairwise(words)), len(words) - 1), "bare_words": share(sum(not any(map(letter, w)) for w in words), len(words)),
        "short_words": share(sum(any(map(letter, w)) and len(w.encode()) <= 3 for w in words), len(words)), "distinct_lines": share(len(set(lines)), len(lines)), "entropy": -sum(c / size * math.log2(c / size) for c in count.values()),
    }


def test_measures_are_those_of_brute_force(monkeypatch):
    rng = random.Random(1)
    texts = ["", " ", "a", "one two two, THREE\nfour## 5 | x", "é𝒳 naïve ÉÉ!", "\n\n", LONG]
    texts += ["".join(rng.choices("ab C.!\n#|9é ", k=rng.randint(0, 200))) for _ in range(60)]
    for t in texts:
        got = dict(zip(quality.MEASURES, quality.measures(t.encode()), strict=True))
        assert all(math.isclose(got[k], v, abs_tol=1e-12) for k, v in naive(t).items()), t[:50]
    whole = [quality.measures(t.encode()) for t in texts]
    monkeypatch.setattr(quality, "_SLICE", 64)
    assert [quality.measures(t.encode()) for t in texts] == whole


def test_a_tree_takes_the_best_cut():
    rng = np.random.default_rng(2)
    for _ in range(20):
        g, h, n = rng.normal(size=9), rng.random(9) + 0.1, rng.integers(0, 6, 9)
        step, gain = quality._split(g, h, n, 2, 3, 1.0)
        score = lambda s: g[s].sum() ** 2 / (h[s].sum() + 1)  # noqa: B023, E731
        every = [(score(slice(0, k)) + score(slice(k, 9)) - score(slice(0, 9)), k) for k in range(1, 9) if n[:k].sum() >= 3 and n[k:].sum() >= 3]
        most, k = max(every, default=(0, None))
        assert math.isclose(gain, max(most, 0), abs_tol=1e-9)
        if most > 1e-9:
            assert np.allclose(step, np.where(np.arange(9) < k, g[:k].sum() / (h[:k].sum() + 1), g[k:].sum() / (h[k:].sum() + 1)))


def test_scores_are_sums_of_table_entries_and_pairs_catch_what_mains_miss():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # no measure tells alone
    model = quality.fit(x, y)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.9 and (0, 1) in [(i, j) for i, j, *_ in model.pairs]
    for row in x[:40]:
        total = model.base + sum(t[sum(row[j] >= c for c in e)] for j, (e, t) in enumerate(zip(model.edges, model.mains, strict=True)))
        total += sum(t[sum(row[i] >= c for c in ei), sum(row[j] >= c for c in ej)] for i, j, ei, ej, t in model.pairs)
        assert math.isclose(model.scores(row[None])[0], 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def junk(rng, kind, n):
    w = ["".join(rng.choices(["ba", "ko", "ri", "su", "te", "mo"], k=rng.randint(1, 4))) for _ in range(n)]
    return [" ".join(w).capitalize() + ".", " ".join(f"{x}{rng.choice(['###', '&&&'])}" for x in w), " ".join(w).upper() + "!!", " ".join([w[0]] * n)][kind]


def test_held_out_documents_are_told(spark, tmp_path):
    rng = random.Random(7)
    kinds = {i: rng.choice([0, 0, 0, 1, 2, 3]) for i in range(600)}
    rows = [(i, junk(rng, k, rng.randint(10, 80)), rng.choice("ab")) for i, k in kinds.items()] + [(1000, None, "a"), (1001, "", "a"), (1002, LONG, "a"), (1003, "x", "a"), (5, "another text of id five", "b")]
    d = str(tmp_path)
    frame(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(k == 0), 0) for i, k in kinds.items()] + [(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    out = quality.op12_quality(spark, d).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 600 and r["doc_id"] != 5]
    assert len(held) > 100 and sum(r["predicted"] == (kinds[r["doc_id"]] == 0) for r in held) >= 0.97 * len(held)
    assert sorted(tuple(r) for r in quality.op12_quality(spark, d).collect()) == sorted(map(tuple, out))  # reruns agree


def test_labels_of_held_out_documents_are_not_read(spark):
    rng = random.Random(8)
    rows = [(i, junk(rng, i % 2, 20), "a") for i in range(80)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)], "doc_id long, quality int")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) AS quality")
    score = lambda lb: [r["score_"] for r in quality.score_documents(docs, quality.train(docs, lb.where(~quality.held_out()))).orderBy("doc_id").collect()]
    assert score(labels) == score(turned)


def test_nulls_one_class_and_no_rows(spark):
    docs = frame(spark, MIXED)
    none = spark.createDataFrame([], "doc_id long, quality int")
    ones = spark.createDataFrame([(4, 1), (5, 1), (6, 1), (4, None)], "doc_id long, quality int")
    assert {r["score_"] for r in quality.score_documents(docs, quality.train(docs, none)).collect()} == {0.5}
    assert min(r["score_"] for r in quality.score_documents(docs, quality.train(docs, ones)).collect()) > 0.5
    assert quality.score_documents(docs.limit(0), quality.train(docs, ones)).count() == 0
