"""The corpus pipeline: five stages from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.llm import common, jaccard, lines, mixing, packing, toxicity

#: Documents with a toxicity score from here on go: the operator's own decision.
TOXIC = 0.3


def _as_documents(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; trained on the labelled ones among those present.

    A null text is scored as the empty one, which stays unless it is labelled so throughout.
    Repeated rows score alike, null ids are scored like others; no labelled rows, or an empty
    table, leave every row. Columns of the input may have any names.
    """
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.where(F.col(scored.columns[-1]) < TOXIC).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sources go, but for their first occurrence and whole copies of it; no document goes.

    Nulls, ties, repeated rows and clashing columns as ``lines.drop_spread_lines`` states.
    """
    return _as_documents(lines.drop_spread_lines(docs), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 80 %) one row stays: the smallest (id, text hash), null ids last, one of its repeated rows.

    Rows that share an id but not a group are not taken for copies. Texts without words link
    with nothing and all stay. An empty table gives no rows.
    """
    h, nth = common.free_name(docs, "text_hash"), common.free_name(docs, "nth")
    found = jaccard.near_duplicates(docs, n=5, percent=80, text_hash="hash").where("n_shingles > 0")
    first = found.select(F.col("component_id").alias("first_id"), F.col("component_hash").alias("first_hash")).distinct()
    text = common.text_of(F.col("text").cast("string"))
    has_words = text.rlike(common.WORD)
    worded = docs.where(has_words).withColumn(h, F.xxhash64(text))
    stay = worded.join(first, worded["doc_id"].eqNullSafe(F.col("first_id")) & (worded[h] == F.col("first_hash")), "left_semi")
    once = Window.partitionBy("doc_id", h).orderBy(F.lit(0))
    stay = stay.withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1)
    return stay.select(*docs.columns).unionByName(docs.where(~has_words))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece that the mix takes, with the piece's text, each shard together in its shuffled order.

    Nulls, ties, repeated rows and clashing columns as ``mixing.mix_documents`` states.
    """
    names = {n: common.free_name(docs, n) for n in ("mix_copy", "mix_shard", "mix_order")}
    return _as_documents(mixing.shuffled(mixing.mix_documents(docs), names), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of the packed sequences; a null text packs as its end mark alone, repeated ids are documents of their own."""
    packed = packing.pack_documents(docs)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can express neither the trained score nor the drawn mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = common.scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
