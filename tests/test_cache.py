import threading

import pytest
from pyspark.sql import functions as F

from caseloom.sources import cache, readers, sinks


def test_a_changed_source_is_built_again(spark, tmp_path):
    folder, built = str(tmp_path / "cache"), []

    def build(df):
        built.append(1)
        return df.groupBy("k").agg(F.sum("v").alias("v"))

    rows = [("a", 1), ("a", 2), ("b", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    read = lambda d, **p: sorted(map(tuple, cache.cached(d, build, folder, "sums", p).collect()), key=repr)
    assert read(df) == read(df.repartition(3)) == [("a", 3), ("b", None)] and len(built) == 1  # rows in any order and partitioning
    assert read(spark.createDataFrame([*rows, ("a", 1)], "k string, v int")) == [("a", 4), ("b", None)] and len(built) == 2
    read(df, k1=2)
    read(spark.createDataFrame([("a", 1), ("a", 2), (None, None)], "k string, v int"))
    read(df.withColumn("v", F.col("v").cast("long")))
    assert len(built) == 5
    read(df)
    assert len(built) == 5
    kept = cache.cached(df, build, folder, "sums", {})
    assert cache.prune(spark, folder, "sums", keep=kept) == 4 and kept.count() == 2 and len(built) == 5
    assert not [p for p in (tmp_path / "cache").iterdir() if p.name.startswith("_")]


def test_a_build_that_fails_leaves_nothing_to_read(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "v int")
    with pytest.raises(Exception, match="(?i)broken|zero"):
        cache.cached(df, lambda d: d.select(F.raise_error(F.lit("broken")).alias("x")), str(tmp_path), "t")
    assert cache.cached(df, lambda d: d, str(tmp_path), "t").count() == 1


def test_maps_and_nulls_have_digests(spark):
    a = spark.createDataFrame([({"x": 1, "y": 2}, None)], "m map<string,int>, s string")
    b = spark.createDataFrame([({"y": 2, "x": 1}, None)], "m map<string,int>, s string")
    assert cache.content_digest(a) == cache.content_digest(b) != cache.content_digest(a.withColumn("s", F.lit("")))
    assert cache.content_digest(a.limit(0)) != cache.content_digest(a)


def test_one_of_two_runs_claims_a_folder(spark, tmp_path):
    for attempt in range(8):
        folder, won, lost, start = str(tmp_path / f"run{attempt}"), [], [], threading.Barrier(6)

        def claim(i, folder=folder, won=won, lost=lost, start=start):
            start.wait()
            try:
                won.append(sinks.claim_run(spark, folder, sinks.condition({"seed": i}, ["seed"])))
            except ValueError:
                lost.append(i)

        threads = [threading.Thread(target=claim, args=(i,)) for i in range(6)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert len(won) == 1 and len(lost) == 5
    assert sinks.claim_run(spark, folder, sinks.condition({"seed": 99}, ["seed"]), allow_mismatch=True)


def test_places_are_those_of_files_and_rows(spark, tmp_path):
    path = str(tmp_path / "split")
    for part, (lo, hi) in enumerate([(0, 70), (70, 75), (75, 160)]):
        spark.range(lo, hi).select(F.col("id").alias("want"), F.lit(b"image").alias("image")).coalesce(1).write.parquet(f"{path}/p{part}.parquet")
    got = readers.with_places(spark, [f"{path}/p{i}.parquet" for i in range(3)], drop=("image",))
    assert got.columns == ["want", "id"] and got.where("id = want").count() == 160
    plan = got._jdf.queryExecution().toString()
    assert "image" not in plan.split("== Physical Plan ==")[1] and "SortMergeJoin" not in plan
