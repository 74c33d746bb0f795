"""Secret scanning with multipart credential linking. DataFrame functions only.

Strong findings stand alone: assignments, access ids, long hex runs. Weak candidates (a
random-looking token, a user or client id, an endpoint) are reported only when the parts
that make them usable lie in the same scope: an interval join within a document, done as an
equi-join on (document row, bin) with bins as wide as the scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import common

# The strong kinds, in order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# The weak kinds.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
USER = r"""((?i:user_?name|user|login|client_?id|account_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)"""
ENDPOINT = r"[a-z][a-z0-9+]*://[A-Za-z0-9_.@:%-]+"
KINDS = ("assign", "access", "hex", "weak_secret", "weak_id", "endpoint")
SCOPE = 256

_SPAN = "struct<start: bigint, end: bigint, value: string>"
#: Running sums go in pieces of so many, so that a text with very many matches takes little more than linear time.
_PIECE = 128


def match_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, end, value), in code points; value: the group.

    Texts between matches and the matches themselves have lengths; their running sums give
    the places: of whole pieces of the list first, then of each match in its piece. No state
    holds more than a number, as arrays in an aggregate's state are copied at every step.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("bigint"))
    steps = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), F.transform(found, lambda x: F.length(x)).alias("n"), values.alias("value"))
    none = F.array().cast(f"array<{_SPAN}>")
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x["gap"] + x["n"])
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  as a variable a value is computed once

    def place(piece: Column, at: Column) -> Column:
        def span(x: Column, j: Column) -> Column:
            start = at + total(F.slice(piece, F.lit(1), j)) + x["gap"]
            return once(start, lambda s: F.struct(s.alias("start"), (s + x["n"]).alias("end"), x["value"].alias("value")))

        return F.transform(piece, span)

    def pieces(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _PIECE).cast("int")), lambda i: F.slice(xs, i * _PIECE + 1, F.lit(_PIECE)))

    def spans(parts: Column) -> Column:
        before = lambda sums, i: F.aggregate(F.slice(sums, F.lit(1), i), F.lit(0).cast("bigint"), lambda a, x: a + x)
        return once(F.transform(parts, total), lambda sums: F.flatten(F.transform(parts, lambda piece, i: once(before(sums, i), lambda at: place(piece, at)))))

    return F.when(text.rlike(pattern), once(steps, lambda xs: once(pieces(xs), spans))).otherwise(none)


def scan_secrets(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: doc_id, base and linked, arrays of (kind, start, end) by start.

    base holds the strong findings, in code points, ends exclusive: assignments with a value
    of 8 characters or more, access ids of 16 or more, hex runs of 32 or more. linked holds
    weak candidates whose complement starts within ``scope`` code points of them: a random
    token (lower case, upper case and digits, 20 characters or more, not inside a strong
    finding) near an id; a user or client id near a secret; an endpoint near both.

    A null or empty text has no findings; a very long one takes time in proportion to its
    length, however many findings it has. Null and repeated ids and repeated rows each get
    their row. Other columns are not read. An empty table gives no rows.
    """
    text = F.col("t")
    rows = docs.select(F.col(id_column).alias("id"), common.text_of(F.col(text_column).cast("string")).alias("t"))
    plain = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    mixed = lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]")
    rows = rows.select(
        "id", "t",
        plain(F.filter(match_spans(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= 8)).alias("assign"),
        plain(match_spans(text, ACCESS)).alias("access"), plain(match_spans(text, HEX)).alias("hex"),
        plain(F.filter(match_spans(text, TOKEN), lambda x: mixed(x["value"]))).alias("weak_secret"),
        plain(F.filter(match_spans(text, USER, 2), lambda x: F.length(x["value"]) >= 3)).alias("weak_id"),
        plain(match_spans(text, ENDPOINT)).alias("endpoint"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = common.durable(rows)  # the row numbers, and the scan of the texts, hold from here

    # parts of the texts that may have both sides: (row, kind, start, end)
    both = rows.where((F.size("access") + F.size("weak_id") > 0) & (F.size("assign") + F.size("weak_secret") > 0))
    kind = lambda name: F.transform(name, lambda x: F.struct(F.lit(KINDS.index(name)).alias("k"), x["start"].alias("start"), x["end"].alias("end")))
    parts = both.select("row", F.explode(F.concat(*map(kind, KINDS))).alias("p")).select("row", "p.*")
    # weak tokens that overlap a strong finding are none: an interval join on the bins that each touches
    binned = lambda what: parts.where(what).withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / F.lit(scope)), F.floor((F.col("end") - 1) / F.lit(scope)))))
    a, b = binned("k = 3").alias("a"), binned("k < 3").alias("b")
    inside = a.join(b, F.expr("a.row = b.row AND a.bin = b.bin AND a.start < b.end AND b.start < a.end"), "left_semi").select("row", "k", "start").distinct()
    parts = parts.where("k <> 2").join(inside, ["row", "k", "start"], "left_anti").withColumn("bin", F.floor(F.col("start") / F.lit(scope)))
    is_id, is_secret = F.col("k").isin(1, 4), F.col("k").isin(0, 3)
    near = lambda df, what: (
        df.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
        .alias("a")
        .join(parts.where(what).select("row", "bin", F.col("start").alias("other")).alias("b"), (F.col("a.row") == F.col("b.row")) & (F.col("a.bin") == F.col("b.bin")) & (F.abs(F.col("a.start") - F.col("b.other")) <= scope), "left_semi")
        .select("row", "k", "start", "end", F.floor(F.col("start") / F.lit(scope)).alias("bin"))
        .distinct()
    )
    linked = near(parts.where("k = 3"), is_id).unionByName(near(parts.where("k = 4"), is_secret)).unionByName(near(near(parts.where("k = 5"), is_id), is_secret))
    linked = linked.groupBy("row").agg(F.collect_list(F.struct("start", "k", "end")).alias("linked"))
    out = rows.join(linked, "row", "left")
    numbered = lambda name: F.transform(name, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(name)).alias("k"), x["end"].alias("end")))
    base = F.concat(*map(numbered, ("assign", "access", "hex")))
    named = lambda a: F.transform(F.array_sort(a), lambda x: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    none = F.array().cast("array<struct<start: bigint, k: int, end: bigint>>")
    linked = F.coalesce("linked", none)
    return out.select(F.col("id").alias(id_column), named(base).alias("base"), named(linked).alias("linked"), named(F.concat(base, linked)).alias("spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of every document, as counts, a digest and a list."""
    found = scan_secrets(common.table(spark, sf_dir, "documents"))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


_Q = lambda p: p.replace("'", "''")
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT rid, 0 AS k, regexp_extract_all(t, '{_Q(ASSIGN)}') AS ms, regexp_extract_all(t, '{_Q(ASSIGN)}', 2) AS vs, string_split_regex(t, '{_Q(ASSIGN)}') AS ps FROM d
  UNION ALL SELECT rid, 1, regexp_extract_all(t, '{ACCESS}') AS ms, ms, string_split_regex(t, '{ACCESS}') FROM d
  UNION ALL SELECT rid, 2, regexp_extract_all(t, '{HEX}') AS ms, ms, string_split_regex(t, '{HEX}') FROM d
  UNION ALL SELECT rid, 3, regexp_extract_all(t, '{TOKEN}') AS ms, ms, string_split_regex(t, '{TOKEN}') FROM d
  UNION ALL SELECT rid, 4, regexp_extract_all(t, '{_Q(USER)}'), regexp_extract_all(t, '{_Q(USER)}', 2), string_split_regex(t, '{_Q(USER)}') FROM d
  UNION ALL SELECT rid, 5, regexp_extract_all(t, '{ENDPOINT}') AS ms, ms, string_split_regex(t, '{ENDPOINT}') FROM d
), u AS (
  SELECT rid, k, unnest(generate_series(1, len(ms))) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(ps[1:len(ms)]) AS p FROM f WHERE len(ms) > 0
), s0 AS (
  SELECT rid, k, v, CAST(sum(length(p) + length(m)) OVER w AS BIGINT) AS e, length(m) AS n FROM u WINDOW w AS (PARTITION BY rid, k ORDER BY i)
), s AS (
  SELECT rid, k, v, e - n AS s, e FROM s0
  WHERE CASE k WHEN 0 THEN length(v) >= 8 WHEN 4 THEN length(v) >= 3
    WHEN 3 THEN regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]') ELSE true END
), c AS (
  SELECT * FROM s WHERE k <> 3 OR NOT EXISTS (SELECT 1 FROM s b WHERE b.rid = s.rid AND b.k < 3 AND b.s < s.e AND s.s < b.e)
), l AS (
  SELECT * FROM c a WHERE k < 3
    OR (k IN (3, 5) AND EXISTS (SELECT 1 FROM c b WHERE b.rid = a.rid AND b.k IN (1, 4) AND abs(b.s - a.s) <= {SCOPE})
      AND (k = 3 OR EXISTS (SELECT 1 FROM c b WHERE b.rid = a.rid AND b.k IN (0, 3) AND abs(b.s - a.s) <= {SCOPE})))
    OR (k = 4 AND EXISTS (SELECT 1 FROM c b WHERE b.rid = a.rid AND b.k IN (0, 3) AND abs(b.s - a.s) <= {SCOPE}))
), g AS (
  SELECT rid, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS h,
    string_agg([{", ".join(f"'{k}'" for k in KINDS)}][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 3) AS base,
    string_agg([{", ".join(f"'{k}'" for k in KINDS)}][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans
  FROM l GROUP BY rid
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""
