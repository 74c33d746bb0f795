
from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.functions import text as fx
from caseloom.sources import schemas
from caseloom.sources.shared import durable


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str, *, strict: bool = True) -> DataFrame:
    """[SRC-8, SRC-11, SRC-12] One object a line; a malformed line fails the query, or is dropped when not strict. Blank lines are skipped.

    Adds seq, the order of lines: file, then place in the file.
    """
    if strict:
        df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    else:
        df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df.withColumn("seq", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def exists(spark: SparkSession, path: str) -> bool:
    """[FLT-22] The path is there, and not empty if it is a file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p)) and (bool(fs.getFileStatus(p).isDirectory()) or fs.getFileStatus(p).getLen() > 0)


def read_encounters(spark: SparkSession, path: str | None, default: str | None = None) -> DataFrame:
    """[SRC-7, SRC-9, SRC-10] A file, a folder's files by name, or the default; nothing there gives no rows."""
    path = path or default
    if not path or not exists(spark, path):
        return spark.createDataFrame([], schemas.ENCOUNTER).withColumn("seq", F.lit(None).cast("struct<file:string,block:bigint,row:bigint>"))
    return read_jsonl(spark, path, schemas.ENCOUNTER)


def read_raw_objects(spark: SparkSession, path: str) -> DataFrame:
    """Lines as raw JSON (column raw) beside the encounter columns, to tell an absent key from a null one."""
    raw = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("raw"))
    return raw.withColumn("e", F.from_json("raw", schemas.ENCOUNTER)).select("raw", "e.*")


def normalize_case(item: DataFrame) -> DataFrame:
    """[SRC-1, SRC-2, SRC-4, PRJ-11..15] Raw rows to cases; missing fields get what the text gives."""
    text = F.array_join(F.coalesce("context", F.array().cast("array<string>")), " ")
    facts = F.when(F.size("atomic_facts") > 0, F.col("atomic_facts")).otherwise(F.coalesce("facts", F.array().cast("array<string>")))  # [PRJ-18]
    age = F.coalesce(F.col("patient.age"), fx.age_of(text))
    full = F.when(text != "", text).otherwise(F.col("question"))
    return item.select(
        F.col("id").cast("string").alias("case_id"), fx.first_sentence(full).alias("chief_complaint"), age.alias("age"), fx.parse_age(age).alias("age_years"),
        F.coalesce(F.col("patient.gender"), fx.sex_of(full)).alias("gender"), full.alias("full_record"), fx.normalize_facts(facts).alias("atomic_facts"),
        F.coalesce(F.try_element_at("options", F.upper("answer_idx")), F.col("answer")).alias("ground_truth_answer"),  # [PRJ-14]
        F.upper("answer_idx").alias("ground_truth_idx"), F.col("question"), F.map_filter("options", lambda k, v: k.isin(*"ABCD")).alias("options"),  # [PRJ-16]
        F.coalesce("specialties", F.array().cast("array<string>")).alias("specialties"), F.coalesce("_source", F.lit("local")).alias("source"),
    )


def letters_for(values: Column, most: int = 10) -> Column:
    """[PRJ-15] A list of options as a map by letter, at most ten."""
    kept = F.slice(values, 1, most)
    return F.map_from_arrays(F.transform(kept, lambda _, i: F.char(i + 65)), kept)


def first_in_order(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """[SRC-1, SRT-11, FLT prefix] The first rows in a stated order; all without n."""
    return df if n is None else df.orderBy(*order).limit(n)


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """[SRC-13, SRC-16, MSC-50, MSC-51] Of each key the last row by order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("r")).select(key, *[F.col(f"r.`{c}`").alias(c) for c in rest])


def cases_in_range(df: DataFrame, id_min: int | None = None, id_max: int | None = None, most: int | None = None, column: str = "id") -> DataFrame:
    """[SRC-17, MSC-46] Whole-number ids in a range, by id, at most so many."""
    n = F.col(column).cast("string").try_cast("bigint")
    df = df.withColumn("case_no", n).where("case_no is not null")
    if id_min is not None:
        df = df.where(F.col("case_no") >= id_min)
    if id_max is not None:
        df = df.where(F.col("case_no") <= id_max)
    return first_in_order(df, most, "case_no").drop("case_no")


def seeded_prefix(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """[SRT-6, SRC-14, SRC-15] The first rows in an order drawn from seed and key."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(n)


def records_with_diagnosis(df: DataFrame, diagnosis: Sequence[str], complaint: str) -> DataFrame:
    """[SRC-14, MSC-49, FLT] Rows with a diagnosis in either field and a complaint."""
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    return df.withColumn("diagnosis", F.coalesce(*map(blank, diagnosis))).where(F.col("diagnosis").isNotNull() & blank(complaint).isNotNull())


def read_side_table(spark: SparkSession, path: str) -> DataFrame:
    """[SRC-6] A JSON object of lists as (case_id, red_flags)."""
    whole = spark.read.option("wholetext", True).text(path)
    entries = F.explode(F.from_json("value", "map<string,array<string>>"))
    return whole.select(entries.alias("case_id", "red_flags"))


def read_passages(spark: SparkSession, path: str, content: str = "content") -> DataFrame:
    """[SRC-20] (doc_id, text) of rows with content, ids in the order of files and lines."""
    df = read_jsonl(spark, path, f"{content} string", strict=False).where(F.trim(content) != "")
    return numbered(df, "seq").select(F.col("n").alias("doc_id"), F.col(content).alias("text"))


def numbered(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """[WIN-9] A column of 0, 1, ... in a global order, without one task that sorts all; ties in any order, but the same for all who read the result.

    Rows are sorted in ranges, which are checkpointed, as ranges drawn twice would differ;
    a place is the rows of the ranges before (one number a range) and the place in the range.
    """
    ranges = durable(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("place_", F.monotonically_increasing_id())
    part = F.shiftright("place_", 33)
    sizes = ranges.groupBy(part.alias("part_")).agg(F.count("*").alias("size_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = sizes.select("part_", F.coalesce(F.sum("size_").over(before), F.lit(0)).alias("before_"))
    placed = ranges.withColumn("part_", part).join(F.broadcast(sizes), "part_")
    return placed.withColumn(name, F.col("before_") + F.col("place_").bitwiseAND((1 << 33) - 1)).drop("part_", "place_", "before_")


def with_places(spark: SparkSession, path: str | Sequence[str], drop: Sequence[str] = (), name: str = "id") -> DataFrame:
    """[SRC-3, SRC-15] A Parquet split with each row's place (from 0) as id: files by name, rows as they stand in them. No sort, no shuffle of rows.

    The place in a file comes with the row; a file starts after the rows of those before it,
    a count a file. Columns to drop (images, say) are never read.
    """
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    file, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    sizes = df.select(file.alias("file_"), at.alias("at_")).groupBy("file_").agg((F.max("at_") + 1).alias("size_"))
    before = Window.orderBy("file_").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = sizes.select("file_", F.coalesce(F.sum("size_").over(before), F.lit(0)).alias("start_"))
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in drop], file.alias("file_"), at.alias("at_"))
    return rows.join(F.broadcast(starts), "file_").withColumn(name, F.col("start_") + F.col("at_")).drop("file_", "at_", "start_")


def load_cases(spark: SparkSession, config: dict) -> DataFrame:
    """[SRC-3, SRC-5, SRC-18, SRC-19, SRC-25] The configured source: files by format, an id range, a cap, a side table of red flags.

    Keys: path or paths, format (jsonl, json, parquet), id_min, id_max, max_cases, drop, red_flags.
    """
    paths = config.get("paths") or [config["path"]]
    kind = config.get("format", "jsonl")
    frames = []
    for p in paths:
        if kind == "parquet":
            frames.append(spark.read.parquet(p))
        elif kind == "json":
            frames.append(spark.read.schema(config.get("schema", schemas.CASE)).option("multiLine", True).json(p))
        else:
            frames.append(read_jsonl(spark, p, config.get("schema", schemas.CASE)).drop("seq"))
    df = frames[0]
    for other in frames[1:]:
        df = df.unionByName(other, allowMissingColumns=True)  # [SET-1]
    df = cases_in_range(df.drop(*config.get("drop", [])), config.get("id_min"), config.get("id_max"), config.get("max_cases"))
    out = normalize_case(df)
    if config.get("red_flags"):
        from caseloom.operators.joins import override_left

        out = override_left(out.withColumn("red_flags", F.array().cast("array<string>")), read_side_table(spark, config["red_flags"]), "case_id", "red_flags")
    return out


def read_config(path: str) -> dict:
    """[SRC-22, SRC-23, SRC-24] A configuration file: JSON, or YAML where that library is installed."""
    raw = Path(path).read_text()
    try:
        return json.loads(raw)
    except ValueError:
        import yaml

        return yaml.safe_load(raw)
