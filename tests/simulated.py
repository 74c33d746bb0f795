"""A simulated world with a known optimum, for tests of the policy layer."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import ranking
from caseloom.plans import encounters as enc
from caseloom.plans.policy import OTHER_POOL, RESPONDER_POOL, fit_q
from caseloom.sources import schemas


@dataclass
class Truth:
    """[INF-5, INF-6, MSC-19, MSC-20] A simulated world: base rate, the right arms, and what they add."""

    base: float = 0.2
    pi1: dict[str, str] | None = None
    responder_arm: str = "A2c"
    other_arm: str = "A2b"
    gain1: float = 0.25
    gain2: float = 0.3

    def stage1(self, category: Column) -> Column:
        table = self.pi1 or {"Cardio": "A1a", "Neuro": "A1b"}
        out = F.lit("A1c")
        for k, v in table.items():
            out = F.when(category == k, v).otherwise(out)
        return out

    def stage2(self, responder: Column) -> Column:
        return F.when(responder, self.responder_arm).otherwise(self.other_arm)

    def success(self, category: Column, a1: Column, responder: Column, a2: Column) -> Column:
        p = F.lit(self.base) + F.when(a1 == self.stage1(category), self.gain1).otherwise(0.0) + F.when(a2 == self.stage2(responder), self.gain2).otherwise(0.0)
        return F.greatest(F.lit(0.02), F.least(F.lit(0.98), p))


def simulate(spark: SparkSession, n: int, seed: int, truth: Truth | None = None) -> DataFrame:
    """[SRC-21] n flat rows with a known optimum, by hashed uniforms."""
    truth = truth or Truth()
    u = lambda tag: ranking.hash_uniform(F.lit(seed), F.col("id"), F.lit(tag))
    pick = lambda values, tag: F.element_at(F.array(*map(F.lit, values)), (F.floor(u(tag) * len(values)) + 1).cast("int"))
    df = spark.range(0, n, 1, max(1, n // 50_000)).withColumn("case_category", pick(("Cardio", "Neuro", "Endo", "MSK"), "cat")).withColumn("A1", pick(schemas.A1_ARMS, "a1"))
    df = df.withColumn("R1_responder", u("r") < 0.4).withColumn("A2", F.when(F.col("R1_responder"), pick(RESPONDER_POOL, "a2")).otherwise(pick(OTHER_POOL, "a2")))
    df = df.withColumn("Y", (u("y") < truth.success(F.col("case_category"), F.col("A1"), F.col("R1_responder"), F.col("A2"))).cast("int"))
    part = {f"R1_{c}": F.floor(u(c) * 3).cast("int") for c in ("OPQRST", "red_flags", "pmh", "meds", "social")}
    df = df.withColumns(part).withColumn("R1_total", F.when(F.col("R1_responder"), 7).otherwise(3))
    return df.select(
        F.concat(F.lit("e"), "id").alias("encounter_id"), F.concat(F.lit("c"), "id").alias("case_id"), "case_category", F.repeat(F.lit("x"), (F.floor(u("len") * 60) + 20).cast("int")).alias("chief_complaint"),
        F.lit(seed).alias("seed"), "A1", "A2", "R1_total", "R1_responder", *part, (F.floor(u("t1") * 4) + 2).cast("int").alias("stage1_turns"), pick(enc.LITERACY, "lit").alias("literacy_id"), "Y",
    )


def recovery(spark: SparkSession, sizes: Sequence[int], repeats: int, seed: int = 0, truth: Truth | None = None) -> list[dict]:
    """[INF-4, JN-15] How often the fit's arms are the true ones, by size and repeat; a failed fit is a row with its error."""
    truth, out = truth or Truth(), []
    for n in sizes:
        for r in range(repeats):
            df = simulate(spark, n, seed * 1000 + n + r, truth)
            try:
                rules = fit_q(df).rules
                got = rules.withColumn("t1", truth.stage1(F.col("case_category"))).withColumn("t2", truth.stage2(F.col("R1_responder"))).agg(F.avg((F.col("pi1") == F.col("t1")).cast("int")), F.avg((F.col("pi2") == F.col("t2")).cast("int")), F.avg("value")).first()
                out.append({"n": n, "repeat": r, "agree_1": got[0], "agree_2": got[1], "value": got[2], "error": None})
            except (ValueError, np.linalg.LinAlgError) as e:
                out.append({"n": n, "repeat": r, "agree_1": None, "agree_2": None, "value": None, "error": str(e)})
    return out
