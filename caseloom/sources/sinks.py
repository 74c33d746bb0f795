
from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.sources import cache, readers


def write_jsonl(df: DataFrame, path: str, *, append: bool = False) -> None:
    """[SNK-1, SNK-3, SNK-4, SNK-11] A line per row; overwrites unless told to append."""
    df.write.mode("append" if append else "overwrite").json(path)


def destination(case_id: str | None, *, file: str | None = None, aggregate: str | None = None, folder: str | None = None) -> str:
    """[SNK-2] A named file, else the aggregate, else one per case."""
    if file or aggregate:
        return file or aggregate  # type: ignore[return-value]
    if not (folder and case_id):
        raise ValueError("no destination: give a file, an aggregate, or a folder and a case")
    return f"{folder}/{case_id}"


def write_subset(source: DataFrame, path: str, most: int | None, *, id_min: int | None = None, id_max: int | None = None) -> None:
    """[SNK-5, SNK-16] Rows of an id range, at most so many, as lines."""
    write_jsonl(readers.cases_in_range(source, id_min, id_max, most), path)


def write_by_category(df: DataFrame, path: str, column: str = "case_category") -> None:
    """[SNK-6] A folder per category; none for empty ones, old ones cleared."""
    df.repartition(column).write.mode("overwrite").partitionBy(column).json(path)


def write_table(df: DataFrame, path: str) -> None:
    """[SNK-7, SNK-8] A small result as one CSV with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_index(df: DataFrame, path: str, key: str) -> None:
    """Postings or vectors as Parquet, sorted by key so that readers prune row groups; ``cache.cached`` keeps them by their source's content."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def red_flag_cache(df: DataFrame, key: str = "case_id", value: str = "red_flags") -> DataFrame:
    """[SNK-15] One JSON object per key range would do; here (key, json list), to be written as lines."""
    return df.groupBy(key).agg(F.to_json(F.array_sort(F.flatten(F.collect_list(value)))).alias(value))


def coverage_report(df: DataFrame) -> DataFrame:
    """[SNK-9, SET-4] Lines of text per encounter: rate, covered and uncovered facts."""
    uncovered = F.array_except(F.sequence(F.lit(1), F.size("facts")), "covered")
    named = lambda idx: F.array_join(F.transform(idx, lambda i: F.concat(F.lit("- "), F.get("facts", i - 1))), "\n")
    head = F.format_string("%s: %d of %d facts", F.col("encounter_id"), F.size("covered"), F.size("facts"))
    return df.select(F.concat_ws("\n", head, F.lit("covered"), named(F.array_sort("covered")), F.lit("uncovered"), named(F.when(F.size("facts") > 0, uncovered).otherwise(F.array().cast("array<int>")))).alias("value"))


def matrix_markdown(rows: list, agents: list[str]) -> str:
    """[SNK-10] A small collected matrix (source, cells by agent) as Markdown."""
    lines = ["| source | " + " | ".join(agents) + " |", "|---" * (len(agents) + 1) + "|"]
    return "\n".join(lines + ["| " + " | ".join([r["source"], *[r[a] or "-" for a in agents]]) + " |" for r in rows])


def condition(config: dict, keys: list[str]) -> str:
    """[PRJ-44] The settings that define a run, as canonical JSON."""
    return json.dumps({k: config.get(k) for k in keys}, sort_keys=True, separators=(",", ":"))


def claim_run(spark: SparkSession, folder: str, snapshot: str, *, allow_mismatch: bool = False) -> str:
    """[SNK-14] Freeze a run's settings in its folder: the first writer's stand, and others with different settings get an error."""
    path, mark = f"{folder}/run_manifest.json", hashlib.sha256(snapshot.encode()).hexdigest()
    if not cache.create_once(spark, path, json.dumps({"mark": mark, "snapshot": snapshot}) + "\n"):
        old = json.loads(cache.read_small(spark, path))
        if old["mark"] != mark and not allow_mismatch:
            raise ValueError(f"{folder} was run with other settings: {old['snapshot']}")
    return mark
