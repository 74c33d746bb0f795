import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from caseloom.operators import joins, metrics, ranking, retrieval, windows
from caseloom.plans import encounters
from caseloom.sources import readers, schemas, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_override_wins_with_null_and_order_lookup(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    table = spark.createDataFrame([("a", None)], "k string, v string")
    assert rows(joins.override_left(df, table, "k", "v").select("k", F.coalesce("v", F.lit("-")))) == [("a", "-"), ("b", "y")]
    ids = spark.createDataFrame([(0, "b"), (1, "z"), (2, "b")], "pos long, id string")
    assert [r["pos"] for r in joins.in_list_order(df, ids, "k", "v").collect()] == [0, 2]


def test_pending_and_completeness(spark):
    todo = spark.createDataFrame([(1, "p"), (2, "p")], "case_id int, path_id string")
    done = spark.createDataFrame([(1, "p")], "case_id int, path_id string")
    assert rows(joins.pending(todo, done, ["case_id", "path_id"])) == [(2, "p")]
    assert joins.complete(todo, todo, "case_id").first()["complete"] and not joins.complete(todo, done, "case_id").first()["complete"]
    assert not joins.complete(todo.limit(0), done, "case_id").first()["complete"]


def test_levels_modes_and_representative(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 0)], "c string, y int")
    by = metrics.with_all_levels(df.groupBy("c").agg(*metrics.accuracy(F.col("y") == 1)), metrics.values_frame(spark, "c", ["a", "b", "z"]), ["c"], ["n", "n_scored"])
    assert rows(by.select("c", "n", "n_scored", F.coalesce("mean_correct", F.lit(-1.0)))) == [("a", 2, 1, 1.0), ("b", 1, 1, 0.0), ("z", 0, 0, -1.0)]
    m = spark.createDataFrame([(1, "y"), (1, "x"), (2, None)], "k int, v string")
    assert rows(metrics.modal("v", ["k"], m)) == [(1, "x"), (2, "")]
    r = spark.createDataFrame([(1, 0, 0.2, "a"), (1, 1, 0.6, "b"), (1, 2, 0.2, "c"), (2, 0, None, "d")], "k int, i int, s double, reply string")
    got = {x["k"]: x for x in metrics.representative(r, ["k"], "s", "i", "reply").collect()}
    assert got[1]["picked"] == 0.2 and got[1]["reply"] == "c" and got[2]["mean_score"] == 0.0


def test_votes_tie_to_a_question(spark):
    v = spark.createDataFrame([(1, True, "A"), (1, False, None)], "k int, a boolean, letter string")
    assert not metrics.vote(v, ["k"], F.col("a"), "letter").first()["commits"]


def test_dialogue_windows(spark):
    m = [(1, 0, "doctor", "hello"), (1, 1, "doctor", "Pain?"), (1, 2, "doctor", "Fever?"), (1, 3, "patient", "not sure"), (1, 4, "doctor", "FEVER ?"), (1, 5, "patient", "yes"), (1, 6, "doctor", "fever?"), (1, 7, "doctor", "[Diagnosis] flu?")]
    df = spark.createDataFrame(m, "conv int, turn int, role string, content string")
    args = ("conv", "turn", "role", "content")
    assert [(r["turn"], r["answer"]) for r in windows.paired_history(df, *args).orderBy("turn").collect()] == [(2, "not sure"), (4, "yes")]
    b = {r["turn"]: (r["prior"], r["blocked"]) for r in windows.blocked(df, *args).collect()}
    assert b == {1: (0, False), 2: (0, False), 4: (1, True), 6: (2, True)}


def test_argmax_pool_ties_and_softmax(spark):
    df = spark.createDataFrame([({"a": 0.5, "b": 0.5, "c": 0.9}, ["a", "b"])], "s map<string,double>, p array<string>")
    assert df.select(ranking.argmax_in_pool(F.col("s"), ("b", "a", "c"), F.col("p"))["arm"]).first()[0] == "b"
    shares = spark.range(1).select(ranking.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(0.0)))).first()[0]
    assert abs(sum(shares) - 1) < 1e-12 and shares[1] > shares[0] > shares[2]


def test_stable_hash_is_sha256_prefix(spark):
    import hashlib

    want = int(hashlib.sha256(b"case-1").hexdigest()[:16], 16)
    assert int(spark.range(1).select(ranking.stable_hash(F.lit("case-1"))).first()[0]) == want


def test_fusion_prefers_both_lists(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, doc_id int, rank int")
    assert [r["doc_id"] for r in retrieval.fuse([a, b], 3).orderBy("rank").collect()] == [11, 10, 12]
    with pytest.raises(ValueError):
        retrieval.retriever("none")


def test_lexical_fills_up_with_passages_that_score_nothing(spark):
    p = spark.createDataFrame([(1, "blue fish"), (2, "red fish"), (3, "green bird"), (4, None), (5, "green  Bird")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "red"), (2, "zzz"), (3, "green red")], "query_id int, query string")
    got = retrieval.lexical(q, retrieval.build_index(p), 4).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [(1, 2), (1, 1), (1, 3), (1, 4), (2, 1), (2, 2), (2, 3), (2, 4), (3, 2), (3, 3), (3, 5), (3, 1)]
    assert [r["score"] for r in got][4:8] == [0.0] * 4


def test_lexical_search_in_rounds_equals_brute_force_and_shuffles_no_pairs(spark):
    import math
    import random
    from collections import Counter

    rng = random.Random(8)
    pick = lambda k: " ".join(rng.choices([f"w{i}" for i in range(150)], weights=[1 / (i + 1) for i in range(150)], k=k))
    data = [(f"d{i:03d}", pick(rng.randint(0, 12))) for i in range(120)]
    data += [(f"e{i:03d}", data[i][1]) for i in range(60)] + [("null", None)]  # copies tie
    asks = [(i, pick(rng.randint(1, 9))) for i in range(40)] + [(90, "nowhere"), (91, ""), (92, None)]
    tf = {d: Counter((t or "").split()) for d, t in data}
    df = Counter(w for c in tf.values() for w in c)
    raw = {w: math.log(len(data) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    low, mean = 0.25 * sum(raw.values()) / len(raw), sum(sum(c.values()) for c in tf.values()) / len(data)
    idf = {w: low if r < 0 else r for w, r in raw.items()}
    score = lambda q, d: round(sum(n * idf[w] * tf[d][w] * 2.5 / (tf[d][w] + 1.5 * (0.25 + 0.75 * sum(tf[d].values()) / mean)) for w, n in Counter((q or "").split()).items() if w in tf[d]), 9)
    want = [(q, r + 1, d, round(-s, 6)) for q, t in asks for r, (s, d) in enumerate(sorted((-score(t, d), d) for d, _ in data)[:7])]
    queries = spark.createDataFrame(asks, "query_id int, query string")
    index = retrieval.build_index(spark.createDataFrame(data, "doc_id string, text string").repartition(3))
    for size in (60, 10**6):  # some queries a round, all
        got = retrieval.lexical(queries, index, 7, round_terms=size)
        assert sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "Generate" not in plan and "SortAggregate" not in plan


def test_index_shuffles_a_row_for_each_term_and_task_not_for_each_passage(spark):
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(10_000)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.concat(F.lit("w"), i)), " ")
    passages = spark.range(0, 400, 1, 2).select(F.col("id").alias("doc_id"), words.alias("text"))
    before = shuffled()
    index = retrieval.build_index(passages)
    n = index.select(F.explode("terms")).count()
    assert n == 400_000 and shuffled() - before < n / 2  # bytes


def test_index_counts_terms_of_repeated_null_and_odd_passages(spark):
    data = [(1, "A b\x0bA\u00a0c"), (1, "a  D\td"), (2, ""), (3, None), (None, "a"), (None, "e"), (4, " b\nb "), (5, None), (5, ""), (6, "\u0130 x")]
    p = spark.createDataFrame(data, "doc_id int, text string")
    got = {r["doc_id"]: (dict(zip(r["terms"], r["counts"], strict=True)), r["length"]) for r in retrieval.term_counts(p.repartition(3)).collect()}
    want = {r["doc_id"]: {} for r in p.collect()}
    for r in retrieval.terms(p, "doc_id", "text").groupBy("doc_id", "term").count().collect():
        want[r["doc_id"]][r["term"]] = r["count"]
    assert got == {d: (c, sum(c.values())) for d, c in want.items()} and got[1][0] == {"a": 2, "b": 1, "a\u00a0c": 1, "d": 2}
    q = spark.createDataFrame([(1, "d"), (2, "e b")], "query_id int, query string")
    rows = retrieval.lexical(q, retrieval.build_index(p), 1).collect()
    assert sorted((r["query_id"], r["doc_id"]) for r in rows) == [(1, 1), (2, 4)]
    blank = spark.createDataFrame([(7, ""), (8, None)], "doc_id int, text string")
    assert retrieval.lexical(q, retrieval.build_index(blank), 1).select("doc_id", "score").distinct().collect() == [(7, 0.0)]
    assert retrieval.lexical(q, retrieval.build_index(blank.limit(0)), 1).count() == 0


def test_rotation_and_numbering(spark):
    pick = windows.rotate_pick(F.array(*map(F.lit, "abc")), F.array(F.lit("a"), F.lit("b")), F.lit(2))
    assert spark.range(1).select(pick).first()[0] == "a"
    df = spark.range(1000).withColumn("k", F.col("id") * 7 % 1000)
    assert readers.numbered(df, "k").where("n <> k").count() == 0


def test_numbering_a_million_wide_rows(spark):
    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("wide"))
    got = readers.numbered(df, "k")
    n, distinct, low, high = got.agg(F.count("*"), F.countDistinct("n"), F.min("n"), F.max("n")).first()
    assert (n, distinct, low, high) == (1_000_000, 1_000_000, 0, 999_999)
    w = got.select("n", "k", F.lag("k").over(Window.orderBy("n")).alias("before"))
    assert w.where("before >= k").count() == 0


def test_jsonl_modes_and_last_wins(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text('{"id": 1, "v": "a"}\n\nnot json\n{"id": 1, "v": "b"}\n')
    got = readers.read_jsonl(spark, str(f), "id long, v string", strict=False)
    assert [r["v"] for r in readers.last_by_key(got, "id", "seq").collect()] == ["b"]
    with pytest.raises(Exception):  # noqa: B017
        readers.read_jsonl(spark, str(f), "id long, v string").collect()
    assert readers.read_encounters(spark, str(tmp_path / "none")).count() == 0


def test_cases_and_manifest(spark, tmp_path):
    f = tmp_path / "cases.jsonl"
    f.write_text('{"id": 3, "question": "q", "context": ["A 45-year-old woman has a cough."], "options": {"A": "x", "E": "y"}, "answer_idx": "a", "facts": ["1. cough"]}\n{"id": 9, "question": "q"}\n')
    got = readers.load_cases(spark, {"path": str(f), "id_max": 5}).collect()
    assert len(got) == 1 and got[0]["age_years"] == 45 and got[0]["gender"] == "female" and got[0]["ground_truth_answer"] == "x" and got[0]["options"] == {"A": "x"} and got[0]["atomic_facts"] == ["cough"]
    mark = sinks.claim_run(spark, str(tmp_path), sinks.condition({"seed": 1}, ["seed"]))
    assert sinks.claim_run(spark, str(tmp_path), sinks.condition({"seed": 1}, ["seed"])) == mark
    with pytest.raises(ValueError):
        sinks.claim_run(spark, str(tmp_path), sinks.condition({"seed": 2}, ["seed"]))


def test_dense_search_in_rounds_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    data = [(f"d{i:03d}", rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(300)]  # many ties
    vectors = spark.createDataFrame([*data, ("null", None), ("hole", [1.0, None, 0.0, 0.0, 0.0]), ("nan", [float("nan")] * 5), ("short", [9.0])], "id string, v array<double>").repartition(5)
    asks = [(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(23)]
    queries = spark.createDataFrame([*asks, (99, None)], "query_id int, v array<double>")
    want = sorted((q, r + 1, d, s) for q, v in asks for r, (s, d) in enumerate(sorted(((-float(np.dot(v, w)), d) for d, w in data))[:4]))
    for size in (40, 200, 10**6):  # one query a round, five, all
        got = retrieval.dense(queries, vectors, 4, doc="id", vector="v", round_bytes=size)
        assert sorted((r["query_id"], r["rank"], r["doc_id"], -r["score"]) for r in got.collect()) == want
    plan = retrieval.dense(queries, vectors, 4, doc="id", vector="v")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert retrieval.dense(queries.limit(0), vectors, 4, doc="id", vector="v").count() == 0
    assert retrieval.dense(queries, vectors.limit(0), 4, doc="id", vector="v").count() == 0
    assert retrieval.dense(queries, vectors.limit(2), 400, doc="id", vector="v").count() <= 46


def test_overlaps_found_by_rare_words_are_all_there_are(spark):
    import random

    rng = random.Random(6)
    pick = lambda k: sorted(set(rng.choices([f"w{i}" for i in range(30)], weights=[60 / (i + 1) for i in range(30)], k=k)))
    small, large = [(i, pick(rng.randint(0, 8))) for i in range(60)], [(i, pick(rng.randint(0, 15))) for i in range(200)]
    small += [(97, ["nowhere"]), (98, ["nowhere", "w0"]), (99, [])]
    for share in (0.5, 0.6, 1.0):
        got = joins.overlapping(spark.createDataFrame(small, "a int, ws array<string>"), spark.createDataFrame(large, "b int, ws array<string>"), "a", "b", "ws", share)
        want = sorted((a, b, len(set(x) & set(y)), len(x)) for a, x in small for b, y in large if x and len(set(x) & set(y)) >= share * len(x))
        assert sorted((r["a"], r["b"], r["hits"], r["n_words"]) for r in got.collect()) == want
