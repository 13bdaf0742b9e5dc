"""Queries over the driver's tables, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritstone.functions import text as T
from gritstone.operators import chunking, matching, relational, retrieval, stateful
from gritstone.plans import router, rules, stores
from gritstone.sources import parsers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


QUESTIONS = ((1, "the thing of that information"), (2, "license version apache"), (3, "der und die einer"), (4, "les dans pour que"))
_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+(?:[/-][a-z0-9]+)*')"
_Q = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + ") AS q(query_id, query)"


def _questions(t) -> DataFrame:
    return t("region").sparkSession.createDataFrame(QUESTIONS, "query_id int, query string")


# --- scalar functions ---------------------------------------------------------------------------------------------


@query("SELECT p_partkey, regexp_replace(upper(p_name), '[^0-9A-Z]+', '', 'g') AS k FROM part")
def norm_well_key(t):
    return t("part").select("p_partkey", T.well_key(F.col("p_name")).alias("k"))


@query("SELECT c_custkey, regexp_replace(replace(replace(upper(c_name), 'WELL', ''), 'NO', ''), '[^0-9A-Z]+', '', 'g') AS k FROM customer")
def picks_well_key(t):
    return t("customer").select("c_custkey", T.picks_well_key(F.col("c_name")).alias("k"))


@query("SELECT p_partkey, CASE WHEN ends_with(upper(p_type), 'STEEL') THEN 'x' ELSE 'y' END AS k, regexp_replace(regexp_replace(upper(p_type), 'STEEL$', ''), 'BRASS$', '') AS cut FROM part")
def suffix_strip(t):
    up = F.upper("p_type")
    return t("part").select("p_partkey", F.when(F.endswith(up, F.lit("STEEL")), "x").otherwise("y").alias("k"), T.strip_suffixes(up, ("STEEL", "BRASS")).alias("cut"))


@query("SELECT p_partkey, regexp_replace(replace(lower(p_name), 'ρ', 'rho'), '[^a-z0-9]', '', 'g') AS k FROM part")
def canonical_tokenize(t):
    return t("part").select("p_partkey", T.canonical_token(F.col("p_name")).alias("k"))


@query("SELECT p_partkey, regexp_replace(replace(replace(upper(p_name), 'FORMATION', ''), 'FM.', 'FM'), '[^0-9A-Z]+', '', 'g') AS a, regexp_replace(replace(replace(replace(upper(p_name), 'FORMATION', ''), 'FM.', 'FM'), 'FM', ''), '[^0-9A-Z]+', '', 'g') AS b FROM part")
def formation_keys(t):
    return t("part").select("p_partkey", T.formation_key(F.col("p_name")).alias("a"), T.formation_key(F.col("p_name"), keep_fm=False).alias("b"))


@query(f"SELECT doc_id, len({_TOK.format('text')})::INT AS n FROM documents")
def tokenize_count(t):
    return t("documents").select("doc_id", F.size(T.tokens(F.col("text"))).alias("n"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', E'\n\n', 'g'), '[ \t]+', ' ', 'g'), '[–—]', '-', 'g'), '^[ \n]+|[ \n]+$', '', 'g')) AS h FROM documents")
def clean_text(t):
    return t("documents").select("doc_id", F.md5(T.clean(F.col("text")).cast("binary")).alias("h"))


@query(r"SELECT doc_id, md5(CASE WHEN len(string_split(text, chr(10))) >= 10 THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(lower(trim(x)), '^([0-9]+$|page [0-9]+|confidential|draft)')), chr(10)) ELSE text END) AS h FROM documents")
def header_footer_strip(t):
    return t("documents").select("doc_id", F.md5(T.drop_headers_footers(F.col("text")).cast("binary")).alias("h"))


_REDACTED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '[A-Z]:\\[^\s]+', '[FILE_PATH]', 'g'), '/[^\s]+', '[FILE_PATH]', 'g'), '\.\./[^\s]+', '[FILE_PATH]', 'g'), '\.\\[^\s]+', '[FILE_PATH]', 'g'), 'sk-[a-zA-Z0-9]{10,}', '[API_KEY]', 'g'),
 '(?i)api[_-]?key\s*[:=]\s*[^\s]+', 'api_key=[REDACTED]', 'g'), '(?i)password\s*[:=]\s*[^\s]+', 'password=[REDACTED]', 'g'), '(?i)secret\s*[:=]\s*[^\s]+', 'secret=[REDACTED]', 'g'),
 '(?i)token\s*[:=]\s*[^\s]+', 'token=[REDACTED]', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '[EMAIL]', 'g'),
 '(?s)Traceback \(most recent call last\):.*', '[STACK_TRACE]', 'g'), 'File "[^"]+", line \d+.*', '[STACK_TRACE]', 'g')"""


@query(f"SELECT doc_id, md5({_REDACTED}) AS h FROM documents")
def sanitize_redact(t):
    return t("documents").select("doc_id", F.md5(T.redact(F.col("text")).cast("binary")).alias("h"))


@query(r"SELECT page_id, regexp_matches(lower(html), '<script|javascript:|onerror=|onload=|eval\(|exec\(') AS bad, len(html)::INT AS n FROM pages")
def dangerous_flag(t):
    return t("pages").select("page_id", T.is_dangerous(F.col("html")).alias("bad"), F.length("html").alias("n"))


@query("SELECT doc_id, md5(concat_ws('|', source, lang, doc_id::VARCHAR, left(text, 2000))) AS k FROM documents")
def doc_key_md5(t):
    return t("documents").select("doc_id", T.doc_key(F.col("source"), F.col("lang"), F.col("doc_id"), F.substring("text", 1, 2000)).alias("k"))


@query(r"SELECT conv_id, turn, ends_with(q, '...') OR regexp_matches(lower(q), ' (was|is|has|did|will|were|are|have|had|would|could|should|and|or|but)\.?$') OR regexp_matches(q, '(?i)(Wellbore|Well)\s+[A-Z0-9/_-]+\s+was\s*\.\.?\.?$') AS open FROM (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS q FROM conversations)")
def incomplete_query_flag(t):
    return t("conversations").select("conv_id", "turn", T.is_unfinished(F.col("text")).alias("open"))


_DOTTED = r"regexp_matches(x, '\.{4,}\s*[0-9]+\s*$')"


@query(rf"SELECT doc_id, dotted >= 2 OR (dotted >= 1 AND (dotted + short) / n > 0.4) AS toc FROM (SELECT doc_id, len(a) AS n, len(list_filter(a, lambda x: {_DOTTED})) AS dotted, len(list_filter(a, lambda x: len(x) < 60 AND regexp_matches(x, '[0-9]+\s*$') AND NOT {_DOTTED})) AS short FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))")
def toc_filter(t):
    return t("documents").select("doc_id", T.is_toc(F.col("text")).alias("toc"))


@query("SELECT p_partkey, round(CASE WHEN chars = 0 THEN 0 ELSE least(1, 0.8 + CASE WHEN chars BETWEEN 1500 AND 8000 THEN 0.1 WHEN chars < 500 THEN -0.3 ELSE 0 END + CASE WHEN p_size > 50 THEN 0.05 ELSE 0 END) END, 6)::DOUBLE AS c FROM (SELECT *, p_retailprice::DOUBLE * (p_size % 6) / 2 AS chars FROM part)")
def pdf_confidence(t):
    chars = F.col("p_retailprice").cast("double") * (F.col("p_size") % 6) / 2
    return t("part").select("p_partkey", F.round(T.pdf_confidence(chars, F.lit(1), F.col("p_size")), 6).alias("c"))


@query("SELECT page_id, 'Source: ' || url || CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN ' (page ' || page_id || ')' ELSE ' (pages ' || page_id || '-' || page_id + 2 || ')' END AS cite FROM pages")
def citation_format(t):
    first = F.when(F.col("page_id") % 3 == 0, None).otherwise(F.col("page_id"))
    return t("pages").select("page_id", T.format_cite(F.col("url"), first, F.when(F.col("page_id") % 3 == 1, first).otherwise(first + 2)).alias("cite"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_parse(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT conv_id, to_json(list_transform(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), lambda x: x))::VARCHAR AS roles FROM (SELECT conv_id, list(role ORDER BY turn) AS l FROM conversations GROUP BY 1)")
def ordered_distinct(t):
    roles = t("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("l"))
    return roles.select("conv_id", F.to_json(T.distinct_ignoring_case(F.col("l"))).alias("roles"))


@query("SELECT doc_id, md5(array_to_string(list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(30), 'g'), chr(30)), lambda s: s <> ''), '|')) AS h, len(list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(30), 'g'), chr(30)), lambda s: s <> ''))::INT AS n FROM documents")
def sentence_split(t):
    s = T.sentences(F.col("text"))
    return t("documents").select("doc_id", F.md5(F.array_join(s, "|").cast("binary")).alias("h"), F.size(s).alias("n"))


# --- joins, aggregates, windows -----------------------------------------------------------------------------------


@query("SELECT n_name, to_json(list_sort(list(DISTINCT c_mktsegment)))::VARCHAR AS segments FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def distinct_list_per_key(t):
    both = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.groupBy("n_name").agg(F.to_json(F.array_sort(F.collect_set("c_mktsegment"))).alias("segments"))


@query("SELECT c_mktsegment, count(*) AS n_all, count(o_orderkey) AS n_found FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_join_coverage(t):
    return relational.left_with_coverage(t("customer").withColumn("k", F.col("c_custkey")), t("orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), "k", "c_mktsegment", "o_orderkey")


@query("SELECT p_partkey, (SELECT n_name FROM nation WHERE starts_with(upper(n_name), upper(left(p_name, 1))) OR starts_with(upper(left(p_name, 1)), upper(n_name)) ORDER BY n_name LIMIT 1) AS n_name FROM part")
def theta_prefix_join(t):
    both = relational.prefix_join(t("part").select("p_partkey", "p_name"), t("nation").select("n_name"), F.upper(F.substring("p_name", 1, 1)), F.upper("n_name"), "p_partkey", "n_name")
    return both.select("p_partkey", "n_name")


@query("""WITH a AS (SELECT p_partkey, p_name, p_brand FROM part), s AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier),
 h AS (SELECT p_partkey, s_suppkey, 0 AS rule FROM a JOIN s ON p_partkey = s_suppkey UNION ALL SELECT p_partkey, s_suppkey, 1 FROM a JOIN s ON p_partkey % 100 = s_suppkey UNION ALL SELECT p_partkey, s_suppkey, 2 FROM a JOIN s ON p_partkey % 25 = s_nationkey)
 SELECT p_partkey, s_suppkey, rule FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY rule, s_suppkey) n FROM h) WHERE n = 1""")
def fallback_cascade_join(t):
    rules = [(F.col("p_partkey"), F.col("s_suppkey")), (F.col("p_partkey") % 100, F.col("s_suppkey")), (F.col("p_partkey") % 25, F.col("s_nationkey").cast("long"))]
    return relational.first_match(t("part").select("p_partkey"), t("supplier").select("s_suppkey", "s_nationkey"), rules, "p_partkey", "s_suppkey").select("p_partkey", "s_suppkey", "rule")


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 0)")
def semi_docs(t):
    return t("documents").join(t("labels").where("quality = 0"), "doc_id", "left_semi").select("doc_id")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_docs(t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_first_wins(t):
    return relational.keep_first(t("documents").select("doc_id", "source"), ["source"], [F.asc("doc_id")])


@query("SELECT l_orderkey, max_by(l_partkey, (l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1")
def dedup_last_wins(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("l_partkey"))


@query("SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 2) AS o, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 2) AS f FROM lineitem GROUP BY 1")
def pivot_table(t):
    wide = t("lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.sum("l_quantity"))
    return wide.select("l_returnflag", F.round("O", 2).alias("o"), F.round("F", 2).alias("f"))


@query("SELECT p_partkey, arg_max(w, (length(w), w)) AS w FROM part, (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) v WHERE contains(lower(p_name), lower(w)) GROUP BY 1")
def longest_match_vocab(t):
    terms = t("part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    return relational.longest_term(t("part"), terms, "p_name", "w", "p_partkey")


@query("""WITH m AS (SELECT event_type, avg(CASE WHEN event_id % 2 = 0 THEN value END) AS b, avg(CASE WHEN event_id % 2 = 1 THEN value END) AS c FROM events GROUP BY 1)
 SELECT event_type, round(c - b, 6) AS gain, round(CASE WHEN b > 0 THEN (c - b) / b * 100 ELSE 0 END, 6) AS pct FROM m""")
def baseline_compare(t):
    half = lambda n: t("events").where(F.col("event_id") % 2 == n).groupBy("event_type").agg(F.avg("value").alias(f"m{n}"))
    return half(0).join(half(1), "event_type").select("event_type", F.round(F.col("m1") - F.col("m0"), 6).alias("gain"), F.round(T.percent_change(F.col("m1"), F.col("m0")), 6).alias("pct"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most, round(sum(value), 4) AS total FROM events GROUP BY 1")
def metric_stats(t):
    s = relational.metric_stats(t("events"), "event_type", "value")
    return s.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("least", 6).alias("least"), F.round("most", 6).alias("most"), F.round("total", 4).alias("total"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) n FROM events), s AS (SELECT event_type, list_sort(list(value)) v FROM r WHERE n <= 1000 GROUP BY 1)
 SELECT event_type, len(v)::BIGINT AS n, v[(len(v) * 0.5)::DOUBLE.floor()::INT + 1] AS p50, v[floor(len(v)::DOUBLE * 0.95)::INT + 1] AS p95, v[floor(len(v)::DOUBLE * 0.99)::INT + 1] AS p99 FROM s""".replace("(len(v) * 0.5)::DOUBLE.floor()::INT", "floor(len(v)::DOUBLE * 0.5)::INT"))
def histogram_percentiles(t):
    return relational.histogram(t("events"), "event_type", "value", [F.desc("ts"), F.desc("event_id")])


@query("""WITH b AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bin, avg(value) AS mean, sum(value) AS total FROM events GROUP BY 1), e AS (SELECT unnest(generate_series(min(bin), max(bin), INTERVAL 5 MINUTE)) AS bin FROM b)
 SELECT e.bin, round(mean, 6) AS mean, round(coalesce(total, 0), 6) AS total FROM e LEFT JOIN b ON e.bin = b.bin""")
def resample_5min_filled(t):
    return relational.resample(t("events"), "ts", "value").select("bin", F.round("mean", 6).alias("mean"), F.round("total", 6).alias("total"))


@query("SELECT event_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def timeframe_24h(t):
    last = t("events").agg(F.max("ts").alias("last"))
    return t("events").join(last, F.col("ts") >= F.col("last") - F.expr("interval 24 hours")).select("event_id", "event_type")


@query("SELECT event_type, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) * 100, 6) AS rate FROM events GROUP BY 1")
def hit_rate(t):
    return t("events").groupBy("event_type").agg(F.round(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)) * 100, 6).alias("rate"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS ctx FROM conversations")
def conversation_context(t):
    return relational.context(t("conversations"), F.when(F.col("role") == "user", F.col("text")), "ctx").select("conv_id", "turn", "ctx")


@query("SELECT conv_id, max_by(text, turn) AS latest FROM conversations WHERE role = 'user' GROUP BY 1")
def latest_user_message(t):
    return t("conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("latest"))


@query("SELECT o_custkey, o_orderkey, n FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def topk_per_group(t):
    return retrieval.top_k(t("orders"), 3, ["o_custkey"], "o_totalprice", "o_orderkey", "n").select("o_custkey", "o_orderkey", "n")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS n, lead(o_totalprice) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))
 SELECT o_custkey, o_orderkey, o_totalprice >= 100000 AND o_totalprice - coalesce(second, 0) >= 5000 AS ok FROM r WHERE n = 1""")
def top2_margin_accept(t):
    return relational.accepted(t("orders"), "o_custkey", "o_totalprice", "o_orderkey", 100000, 5000).select("o_custkey", "o_orderkey", "ok")


@query("SELECT conv_id, turn, (SELECT min(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND length(b.text) % 3 <= length(a.text) % 3) AS end_pos FROM conversations a")
def section_end_next(t):
    s = t("conversations").select("conv_id", "turn", (F.length("text") % 3).alias("level"))
    return relational.section_ends(s, "conv_id", "turn", "level").select("conv_id", "turn", "end_pos")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM conversations")
def fill_down(t):
    return relational.fill_down(t("conversations"), F.when(F.col("role") == "user", F.col("turn")), "conv_id", "turn", "held").select("conv_id", "turn", "held")


@query("""WITH g AS (SELECT event_id, user_id, ts, date_diff('second', lag(date_trunc('second', ts)) OVER w, date_trunc('second', ts)) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT event_id, user_id, sum(CASE WHEN gap > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g""")
def sessionize(t):
    return relational.sessions(t("events"), "user_id", "ts", 3600).select("event_id", "user_id", "session")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_vocabulary(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def intersect_names(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").where("s_acctbal > 0").select("s_nationkey"))


# --- retrieval and evaluation -------------------------------------------------------------------------------------

_BM25 = f"""d AS (SELECT doc_id, {_TOK.format('text')} AS toks FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM d) GROUP BY 1, 2),
 w AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d), i0 AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf, any_value(avgdl) AS avgdl FROM tf, w GROUP BY term, n),
 i AS (SELECT term, avgdl, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0), q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOK.format('query')}) AS term FROM {_Q}) GROUP BY 1, 2),
 s AS (SELECT query_id, tf.doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avgdl))) AS score FROM q JOIN i USING (term) JOIN tf USING (term) JOIN d ON d.doc_id = tf.doc_id GROUP BY 1, 2),
 r AS (SELECT query_id, doc_id, coalesce(round(score, 6), 0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(round(score, 6), 0) DESC, doc_id) AS rank FROM (SELECT query_id, doc_id FROM {_Q}, d) LEFT JOIN s USING (query_id, doc_id))"""


def _lexical(t, k: int = 10) -> DataFrame:
    return retrieval.bm25_top(t("documents"), _questions(t), k)


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10")
def bm25_topk(t):
    return _lexical(t).select("query_id", "doc_id", "score", "rank")


def _vector_sql(expr: str, order: str) -> str:
    return f"""SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, round({expr}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({expr}, 6) {order}, b.vec_id) AS rank
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 10"""


def _asked(t) -> DataFrame:
    """The questions: a twentieth of the vectors, as many more as there are more vectors."""
    return t("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(_vector_sql("1 / (1 + list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)))", "DESC"))
def vector_topk_l2(t):
    return retrieval.nearest(t("embeddings"), _asked(t), "l2", 10, 6)


@query(_vector_sql("list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", "DESC"))
def vector_topk_cosine(t):
    return retrieval.nearest(t("embeddings"), _asked(t), "cosine", 10, 6)


_LISTS = f"""WITH {_BM25}, x AS (SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10), y AS (SELECT query_id, doc_id, rank, 1.0 / rank AS score FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY md5(query_id || '-' || doc_id)) AS rank FROM {_Q}, documents) WHERE rank <= 10)"""


def _second_list(t) -> DataFrame:
    """A second ranked list: documents by a hash, in place of a dense list over the same documents."""
    pairs = t("documents").select("doc_id").withColumn("query_id", F.explode(F.array(*(F.lit(i) for i, _ in QUESTIONS))))
    pairs = pairs.withColumn("h", F.md5(F.concat_ws("-", "query_id", "doc_id").cast("binary")))
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("h"))).where("rank <= 10").withColumn("score", 1.0 / F.col("rank"))


@query(_LISTS + " SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM x UNION ALL SELECT query_id, doc_id, rank FROM y) GROUP BY 1, 2")
def fuse_rrf(t):
    both = _lexical(t).select("query_id", "doc_id", "rank").unionByName(_second_list(t).select("query_id", "doc_id", "rank"))
    return retrieval.fuse_reciprocal(both).withColumn("score", F.round("score", 9))


@query(_LISTS + """, a AS (SELECT query_id, doc_id, 0.65 * score + 0.35 / rank AS s FROM y), b AS (SELECT query_id, doc_id, 0.55 * round(score, 6) / max(round(score, 6)) OVER (PARTITION BY query_id) + 0.45 / rank AS s FROM x)
 SELECT query_id, doc_id, round(greatest(a.s, b.s), 6) AS score FROM a FULL JOIN b USING (query_id, doc_id)""")
def fuse_weighted(t):
    place = (F.col("rank") - 1).alias("idx")
    fused = retrieval.fuse_weighted(_second_list(t).select("query_id", "doc_id", "score", place), _lexical(t).select("query_id", "doc_id", "score", place))
    return fused.withColumn("score", F.round("score", 6))


@query()
def mmr_select(t):
    near = retrieval.nearest(t("embeddings"), _asked(t), "cosine", 24, 12).join(t("embeddings").select("vec_id", "embedding"), "vec_id")
    return retrieval.diversify(near.select(F.col("query_id").cast("long").alias("query_id"), F.col("vec_id").alias("doc_id"), "score", "embedding"), 10)


@query(f"""WITH {_BM25}, p AS (SELECT query_id, r.doc_id, list_distinct({_TOK.format('query')}) AS a, {_TOK.format('left(text, 512)')} AS b FROM r JOIN documents USING (doc_id) JOIN {_Q} USING (query_id) WHERE rank <= 10)
 SELECT query_id, doc_id, round(len(list_intersect(a, b)) / len(a), 6) AS score FROM p""")
def overlap_rerank(t):
    pairs = _lexical(t).select("query_id", "doc_id").join(t("documents").select("doc_id", "text"), "doc_id").join(_questions(t), "query_id")
    return retrieval.overlap_scores(pairs).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def _evaluated(t) -> DataFrame:
    """The cosine lists, judged by label; what is relevant is counted by label, without pairs."""
    label = t("embeddings").select("vec_id", "label")
    run = vector_topk_cosine(t).join(label.withColumnRenamed("vec_id", "query_id").withColumnRenamed("label", "own"), "query_id").join(label, "vec_id")
    marked = run.select("query_id", "rank", F.coalesce((F.col("own") == F.col("label")).cast("int"), F.lit(0)).alias("rel"))
    total = label.groupBy("label").agg((F.count("*") - 1).alias("n_rel"))
    return retrieval.evaluate_marked(marked, label.where("vec_id % 20 = 0").join(total, "label").select(F.col("vec_id").alias("query_id"), "n_rel"))


_EVAL = f"""WITH run AS ({_vector_sql('list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])', 'DESC')}), rel AS (SELECT a.vec_id AS query_id, b.vec_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
 m AS (SELECT run.*, (rel.vec_id IS NOT NULL)::INT AS hit FROM run LEFT JOIN rel ON run.query_id = rel.query_id AND run.vec_id = rel.vec_id), n AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY 1),
 e AS (SELECT m.query_id, k, n_rel, sum(hit) FILTER (rank <= k) AS hits, count(*) FILTER (rank <= k) AS shown, min(rank) FILTER (hit = 1) AS first, sum(hit / log2(rank + 1)) FILTER (rank <= k) AS dcg FROM m JOIN n USING (query_id), (VALUES (1), (3), (5), (10)) AS ks(k) GROUP BY 1, 2, 3),
 x AS (SELECT query_id, k, hits / shown AS p, hits / n_rel AS r, coalesce(1.0 / first, 0) AS rr, dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(k, n_rel) + 1) AS g(i)) AS ndcg FROM e)"""


@query(_EVAL + " SELECT query_id, k, round(p, 6) AS precision, round(r, 6) AS recall, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM x")
def eval_per_query(t):
    e = _evaluated(t)
    return e.select("query_id", "k", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "rr", "ndcg")))


@query(_EVAL + " SELECT k, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM x GROUP BY 1")
def eval_macro(t):
    e = _evaluated(t).groupBy("k")
    return e.agg(F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


# --- matching, routing, state -------------------------------------------------------------------------------------


@query("SELECT p_name, n_name, levenshtein(lower(p_name), lower(n_name))::INT AS distance FROM (SELECT DISTINCT p_name FROM part), nation")
def levenshtein_candidates(t):
    names = t("part").select("p_name").distinct()
    return names.join(relational.small(t("nation").select("n_name")), F.lit(True)).select("p_name", "n_name", F.levenshtein(F.lower("p_name"), F.lower("n_name")).alias("distance"))


@query()
def fuzzy_accept(t):
    scored = matching.candidates(t("part").select("p_partkey", "p_name"), t("part").select(F.col("p_name").alias("term")).distinct(), "p_name", "term", k=2, floor=75)
    return relational.accepted(scored, "p_partkey", "score", "term", 85, 10).select("p_partkey", "term", F.round("score", 6).alias("score"), "ok")


@query()
def route_case(t):
    return t("conversations").select("conv_id", "turn", router.route(F.col("text")).alias("tool"))


@query(r"SELECT doc_id, CASE WHEN doc_id % 4 >= 2 THEN 'answer' WHEN length(text) < 50 THEN 'rewrite' WHEN NOT regexp_matches(q, '[.!?:]$') AND (contains(lower(q), 'is') OR contains(lower(q), 'accordingly') OR contains(lower(q), 'reported')) AND length(text) > 500 THEN 'answer' ELSE 'llm' END AS step FROM (SELECT *, regexp_replace(coalesce(source, ''), '^\s+|\s+$', '', 'g') AS q FROM documents)")
def grade_case(t):
    return t("documents").select("doc_id", router.grade(F.coalesce("source", F.lit("")), F.col("text"), F.col("doc_id") % 4).alias("step"))


@query()
def token_bucket_replay(t):
    return stateful.token_bucket(t("events"), 2.0)


@query()
def ttl_cache_replay(t):
    return stateful.cache_replay(t("events"), 3600)


@query()
def chunk_pack(t):
    return chunking.pack_chunks(t("documents"))


# --- parsers over lines made of the tables' numbers ---------------------------------------------------------------


@query("""SELECT o_orderkey, line, item, parameter, value, unit FROM (
  SELECT o_orderkey, 0 AS line, 0 AS item, 'Rw (at 20 °C)' AS parameter, '0.' || o_custkey AS value, 'ohmm' AS unit FROM orders
  UNION ALL SELECT o_orderkey, 0, 1, 'Temperature gradient', '2.' || o_custkey, '°C' FROM orders
  UNION ALL SELECT o_orderkey, 2, 0, 'Reservoir temperature (at ' || o_orderkey || ' m TVDSS)', '1' || o_custkey, '°C' FROM orders
  UNION ALL SELECT o_orderkey, 3, 0, 'Shale cut-off', o_custkey || '.5', 'g/cc' FROM orders
  UNION ALL SELECT o_orderkey, 4, 0, 'Fluid', CAST(o_orderkey AS VARCHAR), NULL FROM orders)""")
def parse_facts(t):
    say = "'Rw = 0.', o_custkey, ' at 20 oC, Temp Gradient: 2.', o_custkey, ' oC\n\nReservoir Temperature = 1', o_custkey, ' oC at ', o_orderkey, ' m TVDSS\n Shale cut-off : ', o_custkey, '.5 g/cc\nFluid=', o_orderkey, '\nPage: 3\nprose 7'"
    made = t("orders").select("o_orderkey", F.expr(f"concat({say})").alias("text"))
    return parsers.parse_facts(made).select("o_orderkey", "line", "item", "parameter", "value", "unit")


@query("""SELECT l_orderkey, l_linenumber, n, source, CAST(page_start AS DOUBLE) AS page_start, CAST(page_end AS DOUBLE) AS page_end FROM (
  SELECT l_orderkey, l_linenumber, 0 AS n, 'wells/' || l_partkey || '.pdf' AS source, l_suppkey AS page_start, l_suppkey + 2 AS page_end FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 1, l_partkey || '.txt', l_suppkey, l_suppkey FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 2, 'picks.dat', NULL, NULL FROM lineitem)""")
def parse_citations(t):
    first = "'Source: ..\\\\wells\\\\', l_partkey, '.pdf (pages ', l_suppkey, '-', l_suppkey + 2, ')\n'"
    say = f"'Answer.\n', {first}, '  Source: ', l_partkey, '.txt (page ', l_suppkey, ')\nSource: N/A\n', {first}, 'Source: picks.dat'"
    made = t("lineitem").select("l_orderkey", "l_linenumber", F.expr(f"concat({say})").alias("text"))
    return parsers.parse_citations(made).withColumns({c: F.col(c).cast("double") for c in ("page_start", "page_end")})


@query("""SELECT source, line_no, well, formation, pick_type, md_m, tvd_m, tvdss_m, quality FROM (
  SELECT p_partkey AS source, 4 AS line_no, 'NO 15/9-' || p_size AS well, 'Hugin Fm.' AS formation, 'Top' AS pick_type, p_size + 0.5 AS md_m, CAST(p_size AS DOUBLE) AS tvd_m, CAST(-p_size AS DOUBLE) AS tvdss_m, 'Eroded' AS quality FROM part
  UNION ALL SELECT p_partkey, 5, 'NO 15/9-' || p_size, 'Ty Fm.', 'Base', CAST(p_size AS DOUBLE), CAST(p_size AS DOUBLE), NULL, 'Not logged' FROM part)""")
def parse_picks(t):
    say = "'NO 15/9-9  Lost Fm. Top  1 ER 5 5 5\nWell NO 15/9-', p_size, '\n# note\nWell name   Surface name   Obs#\nNO 15/9-', p_size, '   Hugin Fm. Top    1  ER  ', p_size, '.5  ', p_size, '  -', p_size, ' x\nNO 15/9-', p_size, '   Ty Fm. Base   ', p_size, ' ', p_size, '\n-----'"
    made = t("part").select(F.col("p_partkey").alias("source"), F.posexplode(F.split(F.expr(f"concat({say})"), "\n")).alias("line_no", "line"))
    return parsers.parse_picks(made)


QUERIES |= rules.QUERIES | stores.QUERIES
ORACLES |= rules.ORACLES | stores.ORACLES
