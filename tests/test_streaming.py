import random
import time

from pyspark.sql import functions as F

from caseloom.streaming import coverage

SCHEMA = "encounter_id string, turn int, total int, indices array<int>"


def run(events, write, cp, **trigger):
    q = events.writeStream.foreachBatch(write).option("checkpointLocation", cp).trigger(**(trigger or {"availableNow": True})).start()
    return q


def test_stream_equals_batch_and_a_restart_goes_on(spark, tmp_path):
    src, sink, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    rng = random.Random(2)
    first = [("a", 0, 4, [1]), ("a", 1, 4, [2, 9]), ("a", 2, 4, [2]), ("b", 1, 0, [1]), ("c", 1, 3, None)]
    later = [("a", 2, 4, [3]), ("a", 3, 4, [3, 4]), ("b", 2, 2, [2])] + [("d", i, 30, rng.choices(range(-2, 40), k=2)) for i in range(50)]
    seen = []
    for part in (first, later):  # the second query starts from the first one's checkpoint
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(src)
        write = coverage.write_batches(sink, ["encounter_id", "turn"])
        q = run(coverage.coverage_stream(spark.readStream.schema(SCHEMA).json(src), every=2), lambda b, i, write=write: (seen.append(i), write(b, i)), cp)
        q.awaitTermination(240)
        assert q.exception() is None
    got = spark.read.parquet(sink)
    cols = ["encounter_id", "turn", "covered", F.round("coverage_rate", 6).alias("r")]
    once = [r for r in first + later if r != ("a", 2, 4, [3])]  # a turn that was there before changes nothing
    want = coverage.coverage_batch(spark.createDataFrame(once, SCHEMA))
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    assert len(set(seen)) >= 2 and got.where("probed").count() == 1 + 1 + 24 and got.where("final").count() == 0


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    sink = str(tmp_path / "out")
    write = coverage.write_batches(sink, ["encounter_id"])
    batch = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], "encounter_id string, y int")
    write(batch("a", "b", "b"), 0)
    write(batch("c"), 1)
    write(batch("c"), 1)
    assert sorted((r["encounter_id"], r["batch_id"]) for r in spark.read.parquet(sink).collect()) == [("a", 0), ("b", 0), ("c", 1)]


def test_refits_come_by_count_on_warm_and_new_rows(spark, tmp_path):
    sink, fits = str(tmp_path / "log"), []
    batch = lambda lo, hi: spark.createDataFrame([(f"e{i}", 1) for i in range(lo, hi)], "encounter_id string, y int")
    warm = spark.createDataFrame([("w", 0)], "encounter_id string, y int")
    write = coverage.refit_every(5, warm, sink, lambda df, generation: fits.append((generation, df.count())))
    for i, (lo, hi) in enumerate([(0, 3), (3, 6), (6, 9), (9, 21)]):
        write(batch(lo, hi), i)
    assert fits == [(1, 7), (4, 22)]
    write(batch(9, 21), 3)  # a replay counts no row twice
    assert fits[-1] == (4, 22) and spark.read.parquet(sink).count() == 21
    coverage.refit_every(5, warm, sink, lambda df, generation: fits.append((generation, df.count())))(batch(21, 26), 9)  # after a gap of ids
    assert fits[-1] == (5, 27)


def test_silent_encounters_end(spark, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1, 4, [1, 2])], SCHEMA).coalesce(1).write.json(src)
    q = run(coverage.coverage_stream(spark.readStream.schema(SCHEMA).json(src), idle_ms=1), coverage.write_batches(sink), str(tmp_path / "cp"), processingTime="1 second")
    try:
        last, end = [], time.time() + 90
        while not last and time.time() < end:
            time.sleep(1)
            spark.createDataFrame([("b", int(time.time() % 1e6), 4, [3])], SCHEMA).coalesce(1).write.mode("append").json(src)  # batches go on
            try:
                last = spark.read.parquet(sink).where("final and encounter_id = 'a'").collect()
            except Exception:  # noqa: BLE001, S112  nothing is written yet, or a folder is being replaced
                continue
    finally:
        q.stop()
    assert len(last) == 1 and last[0]["covered"] == [1, 2] and last[0]["coverage_rate"] == 0.5


def test_ten_thousand_turns_take_seconds(spark):
    df = spark.range(10_000).select(F.lit("x").alias("encounter_id"), F.col("id").cast("int").alias("turn"), F.lit(40).alias("total"), F.array((F.col("id") / 200).cast("int"), (F.col("id") % 50).cast("int")).alias("indices"))
    start = time.perf_counter()
    last = coverage.coverage_batch(df).withColumn("left", coverage.uncovered(F.col("covered"), F.col("total"))).where("turn = 9999").first()
    assert last["coverage_count"] == 40 and last["left"] == [] and last["covered"] == list(range(1, 41)) and time.perf_counter() - start < 60
