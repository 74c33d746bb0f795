
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from caseloom.sources import readers

OUT = "encounter_id string, turn int, covered array<int>, coverage_rate double, probed boolean, final boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Coverage(StatefulProcessor):
    """Per encounter: a map from covered fact to the turn that covered it first, the counts, and a timer for encounters that fall silent."""

    def __init__(self, every: int, idle_ms: int | None):
        self.every, self.idle_ms = every, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getMapState("first", "fact int", "turn int")
        self.head = handle.getValueState("head", "total int, last int, turns int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        head = self.head.get() if self.head.exists() else None
        total, last, turns = head if head is not None else (0, -1, 0)
        seen = {int(k[0]) for k in self.first.keys()} if head is not None else set()  # noqa: SIM118  a state, not a dict
        ordered, out = sorted(seen), []
        frame = pd.concat(list(rows)).sort_values("turn", kind="stable")
        for turn, n, indices in zip(frame["turn"], frame["total"], frame["indices"], strict=True):
            if turn <= last:
                continue
            total, last, turns = int(n), int(turn), turns + (turn > 0)
            fresh = {int(i) for i in (indices if indices is not None else []) if i is not None and 1 <= i <= total} - seen
            for i in fresh:
                self.first.updateValue((i,), (last,))
            if fresh:
                seen |= fresh
                ordered = sorted(seen)
            out.append((key[0], last, ordered, len(seen) / total if total else 0.0, turn > 0 and turns % self.every == 0, False))
        self.head.update((total, last, turns))
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["encounter_id", "turn", "covered", "coverage_rate", "probed", "final"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """[MSC-6] The last snapshot of an encounter that has been silent; its state goes."""
        if self.head.exists():
            total, last, _ = self.head.get()
            seen = sorted(int(k[0]) for k in self.first.keys())  # noqa: SIM118
            self.first.clear()
            self.head.clear()
            yield pd.DataFrame([(key[0], last, seen, len(seen) / total if total else 0.0, True, True)], columns=["encounter_id", "turn", "covered", "coverage_rate", "probed", "final"])

    def close(self) -> None:
        pass


def coverage_stream(events: DataFrame, every: int = 1, idle_ms: int | None = None) -> DataFrame:
    """[ST-1..4, MSC-4..6] Monotone covered sets per encounter.

    events: encounter_id, turn, total, indices (what a turn covers; turn 0 seeds the state).
    Rows are taken in order of turn; turns at or before the last one seen are repeats and
    change nothing; indices outside 1..total are dropped, null ones are none. A row comes out
    for every turn, probed when the number of turns is a multiple of every. With idle_ms an
    encounter without rows for so long gives a final row and is forgotten. The state is a map
    entry a fact, whatever the turns; the session's state store becomes RocksDB if it is the
    default one.
    """
    spark = events.sparkSession
    if "RocksDB" not in (spark.conf.get(_PROVIDER, "") or ""):
        spark.conf.set(_PROVIDER, _ROCKS)
    return events.groupBy("encounter_id").transformWithStateInPandas(Coverage(every, idle_ms), OUT, "append", "none" if idle_ms is None else "processingTime")


def coverage_batch(events: DataFrame) -> DataFrame:
    """The same result of a whole log: a fact counts at the turn it is seen first, and windows add up what is new.

    Linear in the turns and facts: what a window holds is each fact once. Repeated turns of an
    encounter are one.
    """
    once = events.dropDuplicates(["encounter_id", "turn"])
    facts = once.select("encounter_id", "turn", "total", F.explode("indices").alias("i")).where(F.col("i").between(1, F.col("total")))
    first = facts.groupBy("encounter_id", "i").agg(F.min("turn").alias("turn"))
    fresh = first.groupBy("encounter_id", "turn").agg(F.collect_list("i").alias("fresh"))  # at most the facts of an encounter
    w = Window.partitionBy("encounter_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = once.join(fresh, ["encounter_id", "turn"], "left")
    covered = F.array_sort(F.flatten(F.collect_list("fresh").over(w)))
    count = F.sum(F.when(F.col("fresh").isNotNull(), F.size("fresh")).otherwise(0)).over(w)
    return rows.select("encounter_id", "turn", "total", covered.alias("covered"), count.alias("coverage_count"), F.coalesce(F.try_divide(count, F.col("total")), F.lit(0.0)).alias("coverage_rate"))


def uncovered(covered, total):
    """[SET-4] The facts 1..total that are not covered."""
    none = F.array().cast("array<int>")
    return F.when(total > 0, F.array_except(F.sequence(F.lit(1), total), covered)).otherwise(none)


def _batch(sink: str, batch_id: int) -> str:
    return f"{sink}/batch_id={batch_id}"


def write_batches(sink: str, keys: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """[ST-6, ST-8] A foreachBatch writer with a folder a batch, named by its id: a replayed batch replaces its own folder, and nothing of the sink is read.

    keys: of rows that share them within a batch one stays. Read the sink as one table; its
    column batch_id tells the batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.dropDuplicates(keys) if keys else batch).write.mode("overwrite").parquet(_batch(sink, batch_id))

    return write


def _total_before(spark: SparkSession, counts: str, batch_id: int) -> int:
    """Rows logged before a batch: the running total beside the batch before it."""
    path = f"{counts}/batch_id={batch_id - 1}"
    if batch_id > 0 and readers.exists(spark, path):
        return spark.read.schema("total long").json(path).first()["total"]
    if batch_id > 0 and readers.exists(spark, counts):  # ids may start late in a sink that another query began
        row = spark.read.schema("total long, batch_id long").json(counts).where(F.col("batch_id") < batch_id).orderBy(F.desc("batch_id")).first()
        return row["total"] if row else 0
    return 0


def refit_every(n: int, warm: DataFrame, sink: str, fit: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """[ST-5, ST-7, SET-3] A foreachBatch writer: logs the batch, and refits on warm rows and the log whenever another n rows are in it.

    A running total is kept beside each batch (sink_counts), so that a batch counts its own
    rows only. A replayed batch leaves the totals as they were and refits again.
    """
    log, counts = write_batches(sink, ["encounter_id"]), f"{sink}_counts"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _total_before(spark, counts, batch_id)
        log(batch, batch_id)
        now = before + spark.read.schema(batch.schema).parquet(_batch(sink, batch_id)).count()
        spark.createDataFrame([(now,)], "total long").coalesce(1).write.mode("overwrite").json(f"{counts}/batch_id={batch_id}")
        if now // n > before // n:
            upto = spark.read.parquet(sink).where(F.col("batch_id") <= batch_id).drop("batch_id")
            fit(warm.unionByName(upto, allowMissingColumns=True), now // n)

    return write
