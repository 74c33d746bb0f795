"""Registered queries over the supplied tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import replies
from caseloom.functions import text as fx
from caseloom.operators import joins, metrics, ranking, retrieval, windows
from caseloom.plans import encounters, estimators, policy
from caseloom.sources import cache, readers
from caseloom.streaming import coverage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LANGS = ("de", "en", "es", "fr", "it")
TYPES = ("click", "error", "purchase", "signup", "view")
FLAGS = ("chest pain", "the onset", "avec de la")
KEYWORDS = (("Care", ("health", "doctor")), ("Place", ("that", "avec")), ("Thing", ("nicht", "que")))


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def longs(df: DataFrame) -> DataFrame:
    """Counts as longs, so that both sides have one type."""
    return df.select(*[F.col(n).cast("long").alias(n) if k in ("int", "smallint", "tinyint") else F.col(n) for n, k in df.dtypes])


_ARM = "CAST(CAST('0x' || substr(sha256(CAST({k} AS VARCHAR)), 1, 16) AS UBIGINT) % {n} AS BIGINT)"


@query(f"""
SELECT l.lang, coalesce(n, 0) AS n, coalesce(n_scored, 0) AS n_scored, mean_correct
FROM (SELECT unnest([{", ".join(f"'{x}'" for x in LANGS)}]) AS lang) l LEFT JOIN (
  SELECT lang, count(*) AS n, count(quality) AS n_scored, avg(quality) AS mean_correct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang) g USING (lang)""")
def accuracy_by_category(spark: SparkSession, d: str) -> DataFrame:
    """AGG-1, AGG-3: every language has a row, unlabelled documents count in n only."""
    scored = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id", "left")
    by = scored.groupBy("lang").agg(*metrics.accuracy(F.col("quality") == 1))
    return metrics.with_all_levels(by, metrics.values_frame(spark, "lang", LANGS), ["lang"], ["n", "n_scored"])


@query("""SELECT source, avg(quality) FILTER (lang = 'de') AS de, avg(quality) FILTER (lang = 'en') AS en, avg(quality) FILTER (lang = 'es') AS es,
  avg(quality) FILTER (lang = 'fr') AS fr, avg(quality) FILTER (lang = 'it') AS it FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def accuracy_matrix_pivot(spark: SparkSession, d: str) -> DataFrame:
    """AGG-18."""
    df = t(spark, d, "documents").select("doc_id", "lang", "source").join(t(spark, d, "labels"), "doc_id")
    return metrics.matrix(df, "source", "lang", LANGS, F.col("quality") == 1)


@query("""SELECT lang, count(*) AS n, count(*) FILTER (toxic = 0) AS n_scored, count(*) FILTER (toxic = 0 AND quality = 1) / nullif(count(*) FILTER (toxic = 0), 0) AS accuracy
FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def accuracy_excl_failures(spark: SparkSession, d: str) -> DataFrame:
    """AGG-16."""
    df = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id")
    return df.groupBy("lang").agg(*metrics.accuracy_without_failures(F.col("quality") == 1, F.col("toxic") == 1))


@query(f"""SELECT event_type, arm, count(*) AS n, round(avg(value), 6) AS mean_y FROM (SELECT *, {_ARM.format(k="user_id", n=3)} AS arm FROM events) GROUP BY ALL""")
def arm_cell_table(spark: SparkSession, d: str) -> DataFrame:
    """AGG-10, ML-16."""
    df = t(spark, d, "events").withColumn("arm", ranking.hash_pick(F.col("user_id"), 3).cast("long"))
    return metrics.cell_table(df, ["event_type", "arm"], "value").withColumn("mean_y", F.round("mean_y", 6))


@query("""SELECT user_id, event_type AS modal_event_type FROM (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1""")
def modal_by_group(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12, AGG-13: ties to the smallest value."""
    return metrics.modal("event_type", ["user_id"], t(spark, d, "events"))


@query("""SELECT user_id, sum(c)::BIGINT AS n_rows, count(event_type) AS n_paths, count(*) FILTER (c > 1) AS n_repeated, count(event_type) = 5 AND count(*) FILTER (c > 1) = 0 AS ok
FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1""")
def grid_audit(spark: SparkSession, d: str) -> DataFrame:
    """AGG-21."""
    return metrics.grid_audit(t(spark, d, "events"), "user_id", "event_type", 5)


@query("""SELECT 'o_orderstatus' AS dimension, o_orderstatus AS level, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'all', NULL, count(*) FROM orders""")
def grouping_sets_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG-19, AGG-22, AGG-35: one pass."""
    return metrics.frequencies(t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""SELECT count(*) AS n, avg((quality = toxic)::INT) AS agree_1, avg((quality = doc_id % 2)::INT) AS agree_2, avg((quality = toxic AND quality = doc_id % 2)::INT) AS agree_all FROM labels""")
def rule_agreement(spark: SparkSession, d: str) -> DataFrame:
    """AGG-14, JN-1: two derived rule tables joined by id."""
    lb = t(spark, d, "labels")
    q = lb.select(F.col("doc_id").alias("encounter_id"), F.col("quality").alias("pi1"), F.col("quality").alias("pi2"))
    a = lb.select(F.col("doc_id").alias("encounter_id"), F.col("toxic").alias("pi1"), (F.col("doc_id") % 2).cast("int").alias("pi2"))
    return metrics.agreement(joins.rules_side_by_side(q, a), [("pi1_q", "pi1_a"), ("pi2_q", "pi2_a")])


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """JN-5..7, SET-5."""
    return joins.pending(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels"), ["doc_id"], F.col("quality") == 1)


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def cohort_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """FLT-2."""
    return t(spark, d, "documents").select("doc_id", "lang", "source").join(t(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality ELSE CAST(d.doc_id % 2 AS INTEGER) END AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def override_left_join(spark: SparkSession, d: str) -> DataFrame:
    """JN-2."""
    df = t(spark, d, "documents").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    return joins.override_left(df, t(spark, d, "labels"), "doc_id", "quality")


@query("SELECT pos, p_partkey, p_name FROM (SELECT unnest([7, 3, 7, 9999999, 1]) AS id, CAST(unnest([0, 1, 2, 3, 4]) AS BIGINT) AS pos) JOIN part ON p_partkey = id")
def ordered_id_lookup(spark: SparkSession, d: str) -> DataFrame:
    """JN-3."""
    ids = spark.createDataFrame([(i, k) for i, k in enumerate([7, 3, 7, 9999999, 1])], "pos long, id long")
    return joins.in_list_order(t(spark, d, "part").select("p_partkey", "p_name"), ids, "p_partkey", "p_name").select("pos", "p_partkey", "p_name")


@query("SELECT n_name, A1, A2, A1 || '_' || A2 AS path_id FROM nation, (SELECT unnest(['A1a', 'A1b', 'A1c']) AS A1), (SELECT unnest(['A2a', 'A2b', 'A2c']) AS A2)")
def grid_cross_product(spark: SparkSession, d: str) -> DataFrame:
    """JN-12, PRJ-31."""
    return joins.grid_of(t(spark, d, "nation").select("n_name"), ("A1a", "A1b", "A1c"), ("A2a", "A2b", "A2c"))


@query("SELECT n_name, r.r_name AS agent, x.r_name AS reader FROM nation JOIN region r ON n_regionkey = r.r_regionkey JOIN region x ON x.r_name <> r.r_name")
def cross_readings(spark: SparkSession, d: str) -> DataFrame:
    """JN-13: every row once per other agent."""
    regions = t(spark, d, "region")
    names = [r[0] for r in regions.select("r_name").orderBy("r_name").collect()]  # the agents, a handful
    df = t(spark, d, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.col("r_name").alias("agent"))
    return joins.cross_readings(df, names)


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    """SRC-13, SRC-16, AGG-32."""
    from caseloom.sources.readers import last_by_key

    return last_by_key(t(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    """AGG-31."""
    return joins.first_by(t(spark, d, "events"), "user_id", "event_id", "event_type")


@query("""SELECT conv_id, turn, text AS question, ans AS answer FROM (
  SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS ans FROM (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN text || '?' ELSE text END AS text FROM conversations)
  WHERE role IN ('user', 'assistant') AND trim(text) <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'""")
def qa_pairing(spark: SparkSession, d: str) -> DataFrame:
    """WIN-1: here users ask, so every user turn gets a question mark."""
    m = t(spark, d, "conversations").withColumn("text", F.when(F.col("role") == "user", F.concat("text", F.lit("?"))).otherwise(F.col("text")))
    return windows.paired_history(m, "conv_id", "turn", "role", "text", "user", "assistant")


@query("SELECT doc_id, toxic, round(avg(quality) OVER (PARTITION BY toxic ORDER BY doc_id ROWS UNBOUNDED PRECEDING), 9) AS running FROM labels")
def running_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """WIN-5."""
    return windows.running_accuracy(t(spark, d, "labels"), "toxic", ["doc_id"], F.col("quality") == 1).select("doc_id", "toxic", F.round("running", 9).alias("running"))


_NORM = r"rtrim(lower(ltrim(regexp_replace(regexp_replace({c}, '(?is)\[\s*lookup\s*:[^\]]*\]', '', 'g'), '\s+', ' ', 'g'))), '?.! ')"


@query(f"""SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id, norm ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM (
  SELECT conv_id, turn, {_NORM.format(c="text")} AS norm FROM conversations WHERE role = 'user')""")
def repeat_cap(spark: SparkSession, d: str) -> DataFrame:
    """WIN-2, WIN-3, FN-2: user turns, whole, as questions."""
    m = t(spark, d, "conversations").withColumn("text", F.concat("text", F.lit("?")))
    return windows.asked_before(m, "conv_id", "turn", "role", "text", "user").select("conv_id", "turn", F.col("prior").cast("long").alias("prior"))


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS e FROM (
  SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2)) WHERE e <= 3""")
def ordered_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """WIN-6."""
    return windows.recent_distinct(t(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id", 3)


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source ORDER BY 2 LIMIT 12")
def sample_one_per_category(spark: SparkSession, d: str) -> DataFrame:
    """WIN-8: the limit is the feature."""
    return joins.one_per_category(t(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 12)


@query("""SELECT conv_id, md5(string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS transcript FROM conversations GROUP BY conv_id""")
def transcript_format(spark: SparkSession, d: str) -> DataFrame:
    """FN-22, FN-24, FN-39."""
    m = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content")))).alias("m"))
    return m.select("conv_id", F.md5(fx.role_lines(F.col("m"))).alias("transcript"))


@query(f"SELECT doc_id, md5({_NORM.format(c='text')}) AS norm FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """FN-1, FN-18."""
    return t(spark, d, "documents").select("doc_id", F.md5(fx.normalize_question(F.col("text"))).alias("norm"))


_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({s})))".replace("{s}", ", ".join(f"'{w}'" for w in fx.STOPWORDS))


@query(f"""WITH f AS (SELECT item_id, len({_TOKENS.format(c="text")}) AS n, unnest({_TOKENS.format(c="text")}) AS w FROM benchmark),
g AS (SELECT doc_id, unnest({_TOKENS.format(c="text")}) AS w FROM documents)
SELECT item_id, doc_id, count(*) AS hits, n AS n_tokens FROM f JOIN g USING (w) GROUP BY item_id, doc_id, n HAVING count(*) >= 0.6 * n""")
def token_overlap_match(spark: SparkSession, d: str) -> DataFrame:
    """FN-21: facts meet texts on shared content words only; 60 % of a fact's words must be there."""
    words = lambda name, key: t(spark, d, name).select(key, F.array_distinct(fx.content_tokens(F.col("text"))).alias("words"))
    found = joins.overlapping(words("benchmark", "item_id"), words("documents", "doc_id"), "item_id", "doc_id", "words", 0.6)
    return found.select("item_id", "doc_id", "hits", F.col("n_words").alias("n_tokens"))


@query("SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in KEYWORDS) + " ELSE 'Other' END AS category FROM documents")
def keyword_category(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-11."""
    return t(spark, d, "documents").select("doc_id", fx.category_by_keywords(F.col("text"), KEYWORDS).alias("category"))


@query("""WITH c AS (SELECT conv_id, lower(string_agg(text, ' ' ORDER BY turn)) AS x FROM conversations GROUP BY conv_id)
SELECT conv_id, """ + " OR ".join("NOT (" + " OR ".join(f"contains(x, '{w}')" for w in f.split() if len(w) > 2) + ")" for f in FLAGS) + " AS missed FROM c")
def red_flag_miss(spark: SparkSession, d: str) -> DataFrame:
    """FLT-14."""
    said = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"))
    talk = F.array_join(F.transform("m", lambda x: x["text"]), " ")
    return said.select("conv_id", fx.red_flag_missed(talk, F.array(*map(F.lit, FLAGS))).alias("missed"))


_BM25 = """
tf AS (SELECT doc_id, w AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2),
ln AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY 1), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM ln) AS total),
rw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM rw) ELSE raw END AS idf FROM rw),
qt AS (SELECT item_id AS query_id, w AS term, count(*) AS times FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM benchmark) WHERE w <> '' GROUP BY 1, 2),
sc AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (total / n)))), 9) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN ln USING (doc_id), st GROUP BY 1, 2),
lx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)"""


def _lexical(spark: SparkSession, d: str, k: int) -> DataFrame:
    index = cache.cached(t(spark, d, "documents").select("doc_id", "text"), retrieval.build_index, cache.session_cache(spark), "lexical_index")  # [SNK-12]
    return retrieval.lexical(t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), index, k)


@query(f"WITH {_BM25} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM lx WHERE rank <= 3")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """RET-1, RET-2, SRT-1, SNK-12."""
    return longs(_lexical(spark, d, 3)).withColumn("score", F.round("score", 6))


_DENSE = """
q AS (SELECT item_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM benchmark JOIN embeddings ON vec_id = item_id),
ds AS (SELECT query_id, vec_id AS doc_id, round(list_inner_product(v, list_transform(embedding, lambda x: x::DOUBLE)), 9) AS score FROM q, embeddings),
dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds)"""


def _dense(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    q = t(spark, d, "benchmark").join(e, F.col("item_id") == F.col("doc_id")).select(F.col("item_id").alias("query_id"), "vector")
    return retrieval.dense(q, e, k)


@query(f"WITH {_DENSE} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM dn WHERE rank <= 5")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """SRT-3, SRT-4: the benchmark's items are the stated queries, their vectors those of the same number."""
    return longs(_dense(spark, d, 5)).withColumn("score", F.round("score", 6))


@query(f"""WITH {_BM25}, {_DENSE},
u AS (SELECT query_id, doc_id, 1.0 / (60 + rank)::DOUBLE AS s, rank AS fr FROM lx WHERE rank <= 30 UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank)::DOUBLE, NULL FROM dn WHERE rank <= 30),
g AS (SELECT query_id, doc_id, round(sum(s), 12) AS score, coalesce(min(fr), 1073741824) AS fr FROM u GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fr, doc_id) AS rank FROM g)
SELECT query_id, doc_id, rank, round(score, 9) AS score FROM r WHERE rank <= 3""")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """RET-6, SET-8."""
    k = retrieval.candidates(3)
    return longs(retrieval.fuse([_lexical(spark, d, k), _dense(spark, d, k)], 3)).withColumn("score", F.round("score", 9))


@query(f"SELECT doc_id, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS UBIGINT)::DECIMAL(20, 0) AS h, {_ARM.format(k='doc_id', n=3)} AS arm FROM documents")
def stable_hash_assign(spark: SparkSession, d: str) -> DataFrame:
    """FN-45, ML-16, ML-17."""
    return t(spark, d, "documents").select("doc_id", ranking.stable_hash(F.col("doc_id")).alias("h"), ranking.hash_pick(F.col("doc_id"), 3).cast("long").alias("arm"))


@query("""WITH a AS (SELECT user_id, event_type, avg(value) / 100 AS v FROM events GROUP BY 1, 2), m AS (SELECT *, exp(v - max(v) OVER (PARTITION BY user_id)) AS e FROM a)
SELECT user_id, event_type, round(e / sum(e) OVER (PARTITION BY user_id), 9) AS p FROM m""")
def softmax_propensity(spark: SparkSession, d: str) -> DataFrame:
    """FN-46."""
    a = t(spark, d, "events").groupBy("user_id", "event_type").agg((F.avg("value") / 100).alias("v")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "v"))).alias("s"))
    shares = ranking.softmax(F.transform("s", lambda x: x["v"]))
    return a.select("user_id", F.explode(F.zip_with("s", shares, lambda x, p: F.struct(x["event_type"].alias("event_type"), F.round(p, 9).alias("p")))).alias("r")).select("user_id", "r.*")


@query("""WITH a AS (SELECT user_id, event_type, count(*) AS v FROM events GROUP BY 1, 2), r AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_type) AS r FROM a WHERE user_id % 2 = 0 OR event_type IN ('click', 'view'))
SELECT u.user_id, event_type AS arm, v AS value FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT * FROM r WHERE r = 1) USING (user_id)""")
def constrained_argmax(spark: SparkSession, d: str) -> DataFrame:
    """SRT-8, FLT-19: odd users may only have two of the types."""
    a = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("scores"))
    best = ranking.argmax_in_pool(F.col("scores"), TYPES, ranking.responder_pool(F.col("user_id") % 2 == 0, TYPES, ("click", "view")))
    return a.withColumn("b", best).select("user_id", F.col("b.arm").alias("arm"), F.col("b.value").alias("value"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def flatten_json_props(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-1, FN-40."""
    return t(spark, d, "events").select("event_id", replies.lenient_json(F.col("props"), "k long")["k"].alias("k"))


@query("SELECT event_id, " + ", ".join(f"coalesce((event_type = '{x}')::BIGINT, 0) AS type_{x}" for x in (*TYPES, "refund")) + " FROM events")
def one_hot_fixed_levels(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-7: a level that never occurs has its column too."""
    return longs(t(spark, d, "events").select("event_id", *encounters.one_hot(F.col("event_type"), (*TYPES, "refund"), "type")))


@query("""SELECT count(*) AS n, round(avg(l_quantity * l_quantity), 4) AS qq, round(avg(l_quantity * l_discount), 6) AS qd, round(avg(l_discount * l_discount), 8) AS dd,
  round(avg(l_quantity * l_extendedprice), 1) AS qy FROM lineitem""")
def ridge_moments(spark: SparkSession, d: str) -> DataFrame:
    """ML-9: the sums that the normal equations are made of."""
    q, s, y = F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice")
    return t(spark, d, "lineitem").agg(F.count("*").alias("n"), F.round(F.avg(q * q), 4).alias("qq"), F.round(F.avg(q * s), 6).alias("qd"), F.round(F.avg(s * s), 8).alias("dd"), F.round(F.avg(q * y), 1).alias("qy"))


_RIDGE = ("l_quantity", "l_discount", "l_tax")
_CENTRED = ", ".join(f"sum({a} * {b}) - sum({a}) * sum({b}) / count(*)" + (f" + {float(i == j)} AS a{i}{j}" if b != "l_extendedprice" else f" AS y{i}") for i, a in enumerate(_RIDGE) for j, b in enumerate((*_RIDGE, "l_extendedprice")) if j >= i)


@query(f"""WITH m AS (SELECT {_CENTRED}, avg(l_quantity) AS m0, avg(l_discount) AS m1, avg(l_tax) AS m2, avg(l_extendedprice) AS my FROM (SELECT l_quantity::DOUBLE AS l_quantity, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax, l_extendedprice::DOUBLE AS l_extendedprice FROM lineitem)),
d AS (SELECT *, a00 * (a11 * a22 - a12 * a12) - a01 * (a01 * a22 - a12 * a02) + a02 * (a01 * a12 - a11 * a02) AS det FROM m),
w AS (SELECT *, (y0 * (a11 * a22 - a12 * a12) - a01 * (y1 * a22 - a12 * y2) + a02 * (y1 * a12 - a11 * y2)) / det AS w0,
  (a00 * (y1 * a22 - a12 * y2) - y0 * (a01 * a22 - a12 * a02) + a02 * (a01 * y2 - y1 * a02)) / det AS w1, (a00 * (a11 * y2 - y1 * a12) - a01 * (a01 * y2 - y1 * a02) + y0 * (a01 * a12 - a11 * a02)) / det AS w2 FROM d)
SELECT CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS place, round(unnest([w0, w1, w2, my - w0 * m0 - w1 * m1 - w2 * m2]), 3) AS coefficient FROM w""")
def ridge_normal_equations(spark: SparkSession, d: str) -> DataFrame:
    """ML-1, ML-9, ML-12: three features, whose normal equations Cramer's rule solves in SQL."""
    m = policy.ridge(t(spark, d, "lineitem"), F.array(*[F.col(c).cast("double") for c in _RIDGE]), F.col("l_extendedprice"))
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(m.weights)], "place long, coefficient double").withColumn("coefficient", F.round("coefficient", 3))


@query()
def policy_rules(spark: SparkSession, d: str) -> DataFrame:
    """ML-3..5, AGG-12: rules fitted to a row per user of all events, summarised by category and responder."""
    fit = policy.fit_q(policy.of_events(t(spark, d, "events")))
    both = [metrics.modal(p, ["case_category", "R1_responder"], fit.rules) for p in ("pi1", "pi2")]
    return fit.rules.groupBy("case_category", "R1_responder").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).join(both[0], ["case_category", "R1_responder"]).join(both[1], ["case_category", "R1_responder"])


@query()
def kfold_crossfit(spark: SparkSession, d: str) -> DataFrame:
    """ML-7: a row per user of all events."""
    return spark.createDataFrame([(policy.cross_fitted_value(policy.of_events(t(spark, d, "events"))),)], "value double")


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """INF-1..3, MSC-11, MSC-12: intervals of the policy's value over all users; percentile of the cross-fitted one, the others in-sample."""
    df = policy.of_events(t(spark, d, "events"))
    inside, crossed = policy.PolicyValue(estimators.Ridge()), policy.PolicyValue(estimators.Ridge(), estimators.Folds())
    n, value, held = df.count(), inside.values(df, estimators.Same())[0], crossed.values(df, estimators.Same())[0]
    m = policy.subsample_size(n)
    full, part, other = policy.replicates(df, crossed, 100, seed=2), policy.replicates(df, inside, 500, m=m), policy.replicates(df, inside, 500, m=m, seed=1)
    rows = [("percentile", policy.interval(full, held)), ("m_out_of_n", policy.interval(part, value, kind="m_out_of_n", m=m, n=n)), ("projection", policy.interval(other, value, kind="projection"))]
    return joins.union_to([r.withColumn("kind", F.lit(name)) for name, r in rows], ("point", "low", "high", "n_draws", "kind"))


@query("""SELECT conv_id AS encounter_id, turn, round(covered / 8.0, 6) AS coverage_rate FROM (
  SELECT conv_id, turn, count(*) FILTER (turn + 1 BETWEEN 1 AND 8) OVER (PARTITION BY conv_id ORDER BY turn) AS covered FROM conversations)""")
def coverage_replay(spark: SparkSession, d: str) -> DataFrame:
    """ST-1..4: each turn covers the fact of its number, of eight."""
    m = t(spark, d, "conversations").select(F.col("conv_id").alias("encounter_id"), "turn", F.lit(8).alias("total"), F.array((F.col("turn") + 1).cast("int")).alias("indices"))
    return coverage.coverage_batch(m).select("encounter_id", "turn", F.round("coverage_rate", 6).alias("coverage_rate"))


@query("""SELECT user_id, count(*) FILTER (event_type <> 'view') AS answers, count(*) FILTER (event_type = 'view') AS questions,
  count(*) FILTER (event_type <> 'view') > count(*) FILTER (event_type = 'view') AS commits FROM events GROUP BY user_id""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    """AGG-25, FLT-29: views are questions, other events answers."""
    return metrics.vote(t(spark, d, "events"), ["user_id"], F.col("event_type") != "view", "event_type").select("user_id", "answers", "questions", "commits")


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'yes') THEN 'YES' WHEN contains(lower(text), 'no') THEN 'NO' END AS yes_no,
  CASE WHEN contains(text, 'A') THEN 'A' WHEN contains(text, 'B') THEN 'B' WHEN contains(text, 'C') THEN 'C' WHEN contains(text, 'D') THEN 'D' END AS grade,
  contains(upper(text), 'CORRECT') AND NOT contains(upper(text), 'INCORRECT') AS verdict FROM conversations""")
def reply_parsing(spark: SparkSession, d: str) -> DataFrame:
    """FN-9, FN-26, FN-28."""
    c = F.col("text")
    return t(spark, d, "conversations").select("conv_id", "turn", replies.yes_no(c, None).alias("yes_no"), replies.grade(c).alias("grade"), replies.verdict(c).alias("verdict"))


@query("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def varying_within(spark: SparkSession, d: str) -> DataFrame:
    """AGG-34."""
    return metrics.varying_within(t(spark, d, "events"), "user_id", F.col("event_type"))


@query("""SELECT doc_id, unnest(list_filter([CASE WHEN NOT coalesce(n_chars >= 100, false) THEN 'short' END, CASE WHEN NOT coalesce(lang = 'en', false) THEN 'language' END,
  CASE WHEN NOT coalesce(length(text) = n_chars, false) THEN 'length' END], lambda x: x IS NOT NULL)) AS violation FROM documents""")
def validation_errors(spark: SparkSession, d: str) -> DataFrame:
    """AGG-33, MSC-54."""
    rules = {"short": F.col("n_chars") >= 100, "language": F.col("lang") == "en", "length": F.length("text") == F.col("n_chars")}
    return t(spark, d, "documents").select("doc_id", F.explode(metrics.violations(rules)).alias("violation"))


@query("""WITH a AS (SELECT user_id, list_distinct(list(event_type) FILTER (event_id % 2 = 0)) AS x, list_distinct(list(event_type) FILTER (event_id % 3 = 0)) AS y FROM events GROUP BY 1)
SELECT user_id, len(list_intersect(x, y)) AS shared, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 9) AS jaccard FROM a WHERE x IS NOT NULL AND y IS NOT NULL""")
def fact_overlap(spark: SparkSession, d: str) -> DataFrame:
    """SET-9: two derived tiers of each user's types."""
    some = lambda k: F.collect_set(F.when(F.col("event_id") % k == 0, F.col("event_type")))
    a = t(spark, d, "events").groupBy("user_id").agg(some(2).alias("x"), some(3).alias("y")).where("size(x) > 0 AND size(y) > 0")
    return a.select("user_id", F.size(F.array_intersect("x", "y")).cast("long").alias("shared"), F.round(joins.jaccard(F.col("x"), F.col("y")), 9).alias("jaccard"))


@query("""SELECT user_id, arm, round(mean_value, 6) AS y FROM (SELECT user_id, arg_max(event_type, event_id) AS arm FROM events GROUP BY 1) p
LEFT JOIN (SELECT user_id, event_type AS arm, arg_max(value, event_id) AS mean_value FROM events WHERE value > 5 GROUP BY 1, 2) g USING (user_id, arm)""")
def policy_lookup(spark: SparkSession, d: str) -> DataFrame:
    """JN-10, AGG-32: each user's last type is its policy; small values are outcomes that are missing."""
    e = t(spark, d, "events")
    chosen = windows.last_letter(e, "user_id", "event_id", "event_type").select(F.col("user_id").alias("case_id"), F.lit("a").alias("pi1"), F.col("event_type").alias("pi2"))
    grid = e.select(F.col("user_id").alias("case_id"), F.lit("a").alias("A1"), F.col("event_type").alias("A2"), F.when(F.col("value") > 5, F.col("value")).alias("y"), F.col("event_id").alias("seq"))
    return joins.policy_outcomes(chosen, grid).select(F.col("case_id").alias("user_id"), F.col("pi2").alias("arm"), F.round("y", 6).alias("y"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_values(spark: SparkSession, d: str) -> DataFrame:
    """SRT-5, SRT-7: the limit is the feature."""
    return ranking.top_values(t(spark, d, "events"), "event_type", 3)


@query("SELECT row_number() OVER () - 1 AS id, doc_id, lang, n_chars FROM documents")
def split_positions(spark: SparkSession, d: str) -> DataFrame:
    """SRC-3, SRC-15: each document's place in its split as id, the texts never read."""
    return readers.with_places(spark, f"{d}/documents.parquet", drop=("text",)).select("id", "doc_id", "lang", "n_chars")


_BY_SOURCE = "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2"


@query(_BY_SOURCE)
def kept_by_content(spark: SparkSession, d: str) -> DataFrame:
    """SNK-12, SNK-13: a table derived from the documents, read through the cache."""
    by = lambda df: df.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return cache.cached(t(spark, d, "documents").select("source", "lang", "n_chars"), by, cache.session_cache(spark), "by_source")
