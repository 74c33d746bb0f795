import itertools
import math
import random
import zlib

import numpy as np

from caseloom.llm import common, pipeline, toxicity
from tests.llm.helpers import LONG, MIXED, frame


def triples(word, decay=0.6, span=6):
    """Every triple of letters in order within a span, by brute force."""
    out = {}
    for i, j, k in itertools.combinations(range(len(word)), 3):
        if k - i < span:
            out[word[i], word[j], word[k]] = out.get((word[i], word[j], word[k]), 0) + decay ** (k - i - 2)
    return out


def kernel(a, b):
    x, y = triples(a), triples(b)
    size = lambda m: math.sqrt(sum(v * v for v in m.values()))
    return sum(v * y.get(c, 0) for c, v in x.items()) / (size(x) * size(y))


def test_the_kernel_is_that_of_brute_force():
    words = ["fribbleton", "frib", "fribxbleton", "zwackelhund", "abc", "aab", "quangmorf", "ab", "x", ""]
    marks = toxicity.Landmarks(words[:5], toxicity.Kernel(), 0.0)
    got = marks.similar(words)
    for i, w in enumerate(words):
        for j, m in enumerate(words[:5]):
            want = kernel(w, m) if len(w) >= 3 else 0.0
            assert abs(got[i, j] - want) < 1e-4, (w, m)
    assert kernel("fribbleton", "fribxbleton") > 0.7 > kernel("fribbleton", "zwackelhund")
    gated = toxicity.Landmarks(words[:5], toxicity.Kernel(), 0.55).similar(words)
    assert np.allclose(gated[got.max(axis=1) < 0.54], 0) and np.allclose(gated[got.max(axis=1) > 0.56], got[got.max(axis=1) > 0.56], atol=1e-4)


BAD = ["fribbleton", "zwackelhund", "quangmorf"]


def corpus(n, seed=5):
    """Documents, a quarter of them with insults, some with letters put in."""
    rng = random.Random(seed)
    plain = ["".join(rng.choices(["ba", "ko", "ri", "su", "te", "mo"], k=3)) for _ in range(300)]
    out = []
    for i in range(n):
        w = rng.choices(plain, k=60)
        for _ in range(4 * (i % 4 == 0)):
            b = rng.choice(BAD)
            at = rng.randrange(1, len(b))
            w[rng.randrange(60)] = b if rng.random() < 0.6 else f"{b[:at]}{rng.choice('*x')}{b[at:]}"
        out.append((i, " ".join(w[:30]) + ". " + " ".join(w[30:]) + ".", rng.choice("abc")))
    return out


def write(spark, d, rows, labels):
    frame(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")


def test_held_out_documents_and_the_cut(spark, tmp_path):
    rows = corpus(400)
    extra = [(1000, None, "a"), (1001, "", "a"), (1002, LONG, "a"), (None, "no id", "b"), rows[7], rows[7]]
    write(spark, str(tmp_path), rows + extra, [(i, 1, int(i % 4 == 0)) for i, _, _ in rows] + [(None, 1, 1), (9, 1, None)])
    out = toxicity.op7_toxicity(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 400]
    assert len(held) > 60 and sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    assert len({r["score"] for r in out if r["doc_id"] == rows[7][0]}) == 1


def test_repeated_rows_do_not_raise_what_is_collected(spark):
    rows = corpus(40)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _, _ in rows], "doc_id long, toxic int")
    once, often = (toxicity.train(frame(spark, r), labels) for r in (rows, rows * 3))
    assert np.allclose(once.head, often.head) and once.share == often.share


def test_no_documents(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    none = frame(spark, MIXED).limit(0)
    assert toxicity.score_documents(none, toxicity.train(none, labels)).count() == 0


def stage_rows():
    """A corpus with insults, boilerplate on many sites, near copies, and rows at the edges."""
    rng = random.Random(11)
    rows = [(1000 + i, t, f"s{i % 10}") for i, (_, t, _) in enumerate(corpus(120))]
    notice = "this notice stands on every site there is and goes"
    rows += [(200 + i, f"{notice}\nown words of page {i} " + " ".join(rng.choices("abcdefghijklmnop", k=30)), f"s{i}") for i in range(12)]
    base = [f"w{i}" for i in range(60)]
    rows += [(300 + i, " ".join([*base[:30], f"changed{i}", *base[31:]]), "s1") for i in range(4)] + [(310, " ".join(base), "s2")] * 2
    return rows + MIXED


def test_what_each_stage_keeps(spark, tmp_path):
    rows = stage_rows()
    write(spark, str(tmp_path), rows, [(1000 + i, 1, int(i % 4 == 0)) for i in range(0, 120, 2)])
    docs = common.table(spark, str(tmp_path), "documents")
    kept = pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    clean = [r[0] for r in rows if r[0] is None or r[0] < 1000 or r[0] % 4]
    assert sum(i not in ids for i in clean) <= 2 and sum(i in ids for i in range(1000, 1120, 4)) <= 2

    cleaned = pipeline.drop_boilerplate(spark, docs, str(tmp_path))
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    text = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert "notice" in text[200] and all("notice" not in text[200 + i] and f"page {i} " in text[200 + i] for i in range(1, 12)) and text[1] is None

    single = pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    left = sorted((r["doc_id"] for r in single.collect() if r["doc_id"] is not None and 300 <= r["doc_id"] < 1000))
    assert single.columns == docs.columns and left == [300]  # the four and the two copies are one group
    edge = sorted(r["doc_id"] for r in single.collect() if r["doc_id"] is not None and r["doc_id"] <= 8)
    assert edge == [1, 2, 3, 4, 5, 7, 8]  # of the repeated rows and their copies (5, 6, 6) the first stays

    mixed = pipeline.mix_sources(spark, docs, str(tmp_path))
    words = lambda df: sum(len((r["text"] or "").split()) for r in df.collect())
    assert mixed.columns == docs.columns and 0.9 < words(mixed) / (1.5 * words(docs)) <= 1.02

    packed = pipeline.pack(spark, docs, str(tmp_path))
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048 and packed.where("start = 0").count() == len(rows)


def test_stages_without_rows(spark, tmp_path):
    write(spark, str(tmp_path), MIXED[:1], [(1, 1, 0)])
    none = common.table(spark, str(tmp_path), "documents").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_scores_come_from_arrow_arrays_whatever_the_parts(spark):
    docs = frame(spark, [(i, None if i % 7 == 0 else f"word{i % 50} plain text. " * (i % 4), "a") for i in range(4500)])
    model = toxicity.fit(["you vile grubber here"] * 20 + ["a plain text here"] * 20, [1] * 20 + [0] * 20)
    got = toxicity.score_documents(docs.coalesce(1), model, score_column="p")
    import pyarrow as pa

    want = {r["doc_id"]: model.scores(pa.array([r["text"] or ""]))[0] for r in docs.where("doc_id % 97 = 0 or doc_id > 3990 and doc_id < 4010").collect()}
    have = {r["doc_id"]: r["p"] for r in got.select("doc_id", "p").collect()}
    assert len(have) == 4500 and all(abs(have[k] - v) < 1e-6 for k, v in want.items())
