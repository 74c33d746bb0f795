"""What the training-data operators share: table access, durable intermediates, column helpers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.sources.shared import durable, kept, scratch, shared_dir

__all__ = ["WORD", "durable", "free_name", "give_back", "kept", "scratch", "shared_dir", "table", "text_of"]

#: A word: a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not use (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Arrow's memory that a task has freed goes back to the system, as workers live on beside later stages."""
    pa.default_memory_pool().release_unused()
