"""Fill-in-middle transformation by relational units.

A text's units (runs of ASCII letters, and every other character alone) are matched in rows
of up to 64 consecutive units each, which posexplode numbers. Windows over a document's rows
give the units and characters before each row and the number of units in all, from which the
two cuts follow. Cut requests meet their document's rows by unit ordinal; an aggregate has a
row per document with the place of both cuts, and the document is cut by substrings. Texts are
matched once and shuffled at most once, for the last join; the counts of their rows, some
hundredth of the text, are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.llm import common

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Consecutive units that one row stands for.
UNITS_A_ROW = 64
MARKS = ("<P>", "<S>", "<M>")
PLAIN_PERCENT, SPM_PERCENT = 10, 20


def draws(id_: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit integers: the first 8-digit groups of the hex sha256 of 'seed:id'; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def cut_places(texts: DataFrame, units_a_row: int = UNITS_A_ROW) -> DataFrame:
    """texts: k1, k2 (a document's key), h1, h2 (its draws), t. Returns a row per key: n (units), and for each cut the characters before its row, the characters of its row, and the units into it."""
    run = f"(?:{UNIT}){{1,{units_a_row}}}"
    counted = lambda r: F.struct(F.length(r).cast("long").alias("chars"), F.size(F.regexp_extract_all(r, F.lit(UNIT), F.lit(0))).cast("long").alias("units"))
    # only a text's last row may have fewer units; repeated rows of one document become one before they travel, and their counts travel together
    sizes = texts.select("k1", "k2", "h1", "h2", F.transform(F.regexp_extract_all("t", F.lit(run), F.lit(0)), counted).alias("sizes"))
    sizes = sizes.groupBy("k1", "k2").agg(*[F.any_value(c).alias(c) for c in ("h1", "h2", "sizes")])
    units = sizes.select("k1", "k2", "h1", "h2", F.posexplode("sizes").alias("pos", "row")).select("k1", "k2", "h1", "h2", "pos", "row.chars", "row.units")
    own = Window.partitionBy("k1", "k2")
    before = own.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = units.withColumns({
        "first": F.coalesce(F.sum("units").over(before), F.lit(0)), "at": F.coalesce(F.sum("chars").over(before), F.lit(0)), "n": F.sum("units").over(own),
    })
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    # a request for the place after `ordinal` units; it meets the row that holds the next unit, or the last row
    wanted = rows.select("*", F.posexplode(F.array(F.least(a, b), F.greatest(a, b))).alias("cut", "ordinal"))
    into = F.col("ordinal") - F.col("first")
    met = wanted.where((into >= 0) & ((into < F.col("units")) | (F.col("first") + F.col("units") == F.col("n"))))
    place = F.struct("at", "chars", into.alias("into"))
    return met.groupBy("k1", "k2").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("cut") == i, place)).alias(f"cut{i}") for i in (0, 1)])


def _characters(text: Column, cut: Column) -> Column:
    """Code points before a cut: those before its row, and those of the units into it."""
    row = F.substr(text, (cut["at"] + 1).cast("int"), cut["chars"].cast("int"))
    inside = F.slice(F.regexp_extract_all(row, F.lit(UNIT), F.lit(0)), F.lit(1), cut["into"].cast("int"))
    return F.when(cut["into"] == 0, cut["at"]).otherwise(cut["at"] + F.length(F.array_join(inside, "")))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of."""
    parts = F.split(output, "<[PSM]>", -1)  # a text with a mark is plain, so these are '' and the three segments
    middle = F.get(parts, F.lit(3))
    psm = F.concat(F.get(parts, F.lit(1)), middle, F.get(parts, F.lit(2)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(F.get(parts, F.lit(2)), middle, F.get(parts, F.lit(1))))


def fill_in_middle(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", seed: int = 1, units_a_row: int = UNITS_A_ROW) -> DataFrame:
    """All rows and columns plus fim: struct(n, form, prefix_chars, middle_chars, output); an underscore is added to a name in use.

    A null text is the empty one, which is plain with n = 0. Draws depend on the id alone, so
    rows with equal id and text get equal results; a null id draws as an empty one. A text
    that holds a mark is plain and still counted. Equal cuts leave an empty middle. Very long
    texts are many rows until they are cut. Copies of one row are one row of units, and the
    join that brings the cuts back is a plain one, in which Spark may split a hot key. An
    empty table gives no rows.
    """
    out = common.free_name(docs, "fim")
    names = list(docs.columns)
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no name can clash from here on
    id_, text = (inner[f"c{names.index(c)}"] for c in (id_column, text_column))
    t = common.text_of(text.cast("string"))
    h = draws(id_, seed)
    key = F.coalesce(id_.cast("string"), F.lit(""))
    keyed = inner.withColumns({"k1": F.xxhash64(key, t), "k2": F.xxhash64(F.lit("2"), t, key)})
    cuts = common.kept(cut_places(keyed.select("k1", "k2", h[0].alias("h1"), h[1].alias("h2"), t.alias("t")), units_a_row), "cuts")
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains(t, F.lit(m))
    plain = (t == "") | marked | (h[2] % 100 >= 100 - PLAIN_PERCENT)
    form = F.when(plain, "plain").when(h[3] % 100 < SPM_PERCENT, "spm").otherwise("psm")
    rows = keyed.join(cuts, ["k1", "k2"], "left").withColumn("form", form)
    cut = lambda i: F.when(F.col("form") != "plain", _characters(t, F.col(f"cut{i}")))
    rows = rows.withColumns({"from": cut(0).cast("long"), "to": cut(1).cast("long")})
    prefix, middle = F.substr(t, F.lit(1), F.col("from").cast("int")), F.substr(t, (F.col("from") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int"))
    suffix = F.substr(t, (F.col("to") + 1).cast("int"))
    p, s, m = map(F.lit, MARKS)
    output = F.when(F.col("form") == "plain", t).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    made = F.struct(F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("form").alias("form"), F.col("from").alias("prefix_chars"), (F.col("to") - F.col("from")).alias("middle_chars"), output.alias("output"))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], made.alias(out))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the output and of the text rebuilt from it, for all documents."""
    out = fill_in_middle(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"),
    )


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u FROM d),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST(('0x' || substr(x, 1, 8)) AS BIGINT) AS h1, CAST(('0x' || substr(x, 9, 8)) AS BIGINT) AS h2, CAST(('0x' || substr(x, 17, 8)) AS BIGINT) AS h3, CAST(('0x' || substr(x, 25, 8)) AS BIGINT) AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM s"""
