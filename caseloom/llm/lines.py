"""Removal of lines that recur across sites, by distinct-site spread. DataFrame functions only.

Each distinct line (by hash) gets a HyperLogLog sketch of the sites it is on; sketches merge
by aggregation, on the map side first, so that a line on a third of all documents is one
small row per task. Lines whose estimate is near the threshold get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import common

MIN_SITES = 8
#: Relative error of a sketch (64 registers), and the band around the threshold that is counted exactly.
ERROR = 0.14
BAND = 2.0
#: Largest table of lines that is broadcast (a hash and a place each, about 50 bytes a row).
BROADCAST_ROWS = 500_000
SALTS = 32
_BLANK = r"^[\x20\x09-\x0D]*$"


def _lookup(rows: DataFrame, lines: DataFrame, count: int) -> DataFrame:
    """rows joined with lines on the hash: broadcast when few, else salted, as one line may be on very many rows."""
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(lines), "line")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("k", "h", "pos"), F.lit(SALTS)).cast("int"))
    return salted.join(lines.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["line", "salt"]).drop("salt")


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes of the lines on min_sites sites or more; lines has the columns line and site (hashes)."""
    rough = lines.groupBy("line").agg(F.approx_count_distinct("site", ERROR).alias("about"))
    rough = common.durable(rough.where(F.col("about") >= min_sites / BAND))
    near = rough.where(F.col("about") < min_sites * BAND).select("line")
    count = near.count()
    pairs = lines.join(F.broadcast(near) if count <= BROADCAST_ROWS else near, "line", "left_semi").distinct()
    exact = pairs.groupBy("line").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("line")
    return rough.where(F.col("about") >= min_sites * BAND).select("line").unionByName(exact)


def drop_spread_lines(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", site_column: str = "source", min_sites: int = MIN_SITES,
) -> DataFrame:
    """All rows and columns, the text without its spread lines, plus removed_lines (long).

    A line is spread when it stands, as it is, on min_sites sites or more. Its first
    occurrence (by id, then text hash, then place) stays, and so does the same place of every
    equal text, so that copies of a document stay equal for document deduplication; all
    others go, however much of a document they are. Blank lines never go. A null site is a
    site. A null text stays null. Rows with equal id and text are treated alike. Null ids come
    first. A text of very many lines takes time in proportion to them. An empty table gives
    no rows. If the input has a column removed_lines, the new one gets an underscore.
    """
    flag = common.free_name(docs, "removed_lines")
    text = common.text_of(F.col(text_column).cast("string"))
    key = [F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(text).alias("h")]
    site = F.xxhash64(F.col(site_column).isNull(), F.coalesce(F.col(site_column).cast("string"), F.lit("")))
    split = lambda t: F.split(t, "\n", -1)
    rows = docs.select(*key, site.alias("site"), F.posexplode(split(text)).alias("pos", "text_line")).where(~F.col("text_line").rlike(_BLANK))
    lines = rows.select("k", "h", "pos", "site", F.xxhash64("text_line").alias("line"), F.length("text_line").alias("n"))
    spread = common.durable(spread_lines(lines.select("line", "site"), min_sites))
    count = spread.count()
    hits = common.durable(_lookup(lines.select("line", "k", "h", "pos", "n"), spread, count))
    first = hits.groupBy("line").agg(F.min(F.struct("k", "h", "pos")).alias("first"))
    gone = _lookup(hits, first, count).where(F.struct("k", "h", "pos") != F.col("first"))
    copied = (F.col("h") == F.col("first.h")) & (F.col("pos") == F.col("first.pos"))
    gone = gone.where(~copied).groupBy("k", "h").agg(F.collect_set("pos").alias("gone"))
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row_"), text.alias("t_"), *key)
    out = inner.join(gone, ["k", "h"], "left").withColumn("lines_", F.when(F.col("gone").isNotNull(), split(F.col("t_"))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines_") - 1), "gone")  # by a hash set, in order
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines_"), i)), "\n")
    out = out.withColumn("goes", F.col("gone").isNotNull())
    new = {c: F.col(f"row_.`{c}`").alias(c) for c in names}
    new[text_column] = F.when(F.col("goes"), kept).otherwise(F.col(f"row_.`{text_column}`")).alias(text_column)
    return out.select(*new.values(), F.when(F.col("goes"), F.size("gone")).otherwise(0).cast("long").alias(flag))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text after the removal of spread lines, as a digest."""
    out = drop_spread_lines(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "removed_lines", F.length(common.text_of("text")).cast("long").alias("kept_chars"), F.sha2(common.text_of("text"), 256).alias("kept_sha256"))


OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce('s' || source, 'n') AS site FROM documents),
l AS (
  SELECT doc_id, site, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d
), n AS (SELECT * FROM l WHERE NOT regexp_full_match(line, '[\\x20\\x09-\\x0D]*')),
b AS (SELECT line, arg_min(doc_id, (doc_id, pos)) AS doc, min((doc_id, pos))[2] AS place FROM n GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
g AS (SELECT n.doc_id, n.pos FROM n JOIN b USING (line) JOIN d AS f ON f.doc_id = b.doc JOIN d AS o ON o.doc_id = n.doc_id WHERE NOT (n.pos = b.place AND o.t = f.t)),
r AS (SELECT doc_id, count(*) AS c FROM g GROUP BY doc_id),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS t FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.pos = l.pos WHERE g.doc_id IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(r.c, 0) AS removed_lines, length(coalesce(k.t, '')) AS kept_chars, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""
