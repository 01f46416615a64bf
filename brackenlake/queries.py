"""Queries of the engine over the driver's tables, with the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, text
from .functions import vocabulary as V
from .operators import context, graph, index, knowledge, metrics, segments, store
from .operators import symbols as sym
from .plans import retrieve, upkeep
from .registry import ORACLE, QUERIES, query
from .sources.corpus import CORPUS_SQL, corpus, diff, grep, grep_files, line_range, table, upsert
from .streaming import events as ev

CORPUS = f"WITH corpus AS ({CORPUS_SQL}) "


ASKED = {
    1: "how to install the package and configure settings",
    2: "where is the guide module for tests",
    3: "find all function error in the config",
    4: "the of and ththe onthe module docs readme",
}
_VALUES = ", ".join(f"({k}, '{v}')" for k, v in ASKED.items())


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in ASKED.items()], "query_id int, query string")


# --- projections -------------------------------------------------------------------------------

_EXT = paths.EXT_SQL.format(p="path")
_LANG_CASES = " ".join(f"WHEN {_EXT} IN {V.sql_list(e)} THEN '{k}'" for k, (e, _) in V.LANGUAGES.items())
_NAME_CASES = " ".join(f"WHEN regexp_extract(path, '([^/]*)$', 1) IN {V.sql_list(n)} THEN '{k}'" for k, (_, n) in V.LANGUAGES.items() if n)


@query(CORPUS + f"SELECT doc_id, path, CASE {_NAME_CASES} {_LANG_CASES} END AS detected FROM corpus")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", "path", paths.language(F.col("path")).alias("detected"))


@query(CORPUS + f"""SELECT doc_id, path, {paths.file_class_sql('path')} AS file_class, {paths.class_boost_sql('(' + paths.file_class_sql('path') + ')')}::DOUBLE AS boost
FROM corpus""")
def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir).select("doc_id", "path", paths.file_class(F.col("path")).alias("file_class"))
    return c.withColumn("boost", paths.class_boost(F.col("file_class")))


@query(CORPUS + """SELECT doc_id, (CASE WHEN regexp_matches(lower(path), '(readme\\.md|contributing\\.md|contributing|claude\\.md|agents\\.md)$') THEN 1.3 WHEN contains(lower(path), '/docs/') OR contains(lower(path), '/.github/') THEN 1.2 WHEN starts_with(lower(path), 'types/') OR contains(lower(path), '/types/') THEN 1.15 ELSE 1.0 END)::DOUBLE AS directory,
(CASE WHEN regexp_extract(lower(path), '([^/]*)$', 1) = 'readme.md' THEN 1.5 WHEN (contains(lower(path), '/docs/') OR starts_with(lower(path), 'docs/'))
AND ends_with(lower(path), '.md') THEN 1.2 WHEN (contains(lower(path), '/.github/') OR starts_with(lower(path), '.github/'))
AND ends_with(lower(path), '.md') THEN 1.1 ELSE 1.0 END)::DOUBLE AS authority FROM corpus""")  # fmt: skip
def path_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return corpus(spark, sf_dir).select("doc_id", paths.directory_boost(p).alias("directory"), paths.authority_boost(p).alias("authority"))


_SPLIT = r"""list_filter(string_split_regex(lower(regexp_replace(regexp_replace({n}, '([a-z][^A-Za-z_-]*)([A-Z])', '\1 \2', 'g'), '([A-Z][^a-z_ -]*)([^a-z_ -])([a-z])', '\1 \2\3', 'g')), '[_ -]+'), lambda t: t <> '')"""
_STEM = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '')"


@query(CORPUS + f"SELECT doc_id, array_to_string(list_filter({_SPLIT.format(n=_STEM)}, lambda t: t <> lower({_STEM})) || [lower({_STEM})], ' ') AS parts FROM corpus")
def split_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.regexp_replace(paths.filename(F.col("path")), r"\.[^.]*$", "")
    parts = F.filter(text.split_identifier(stem), lambda t: t != F.lower(stem))
    return corpus(spark, sf_dir).select("doc_id", F.array_join(F.concat(parts, F.array(F.lower(stem))), " ").alias("parts"))


@query(r"SELECT doc_id, trim(regexp_extract(text, '(?m)^[ \t]*#{1,2} +(.+)$', 1)) AS title FROM documents")
def markdown_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.title(F.col("text")).alias("title"))


@query("SELECT conv_id, turn, " + text.intent_sql("lower(text)") + f" AS intent, len(list_intersect(string_split_regex(lower(text), '[^a-z0-9]+'), {list(V.TEST_TERMS)})) > 0 AS about_tests FROM conversations")
def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.intent(q).alias("intent"), text.is_test_query(q).alias("about_tests"))


_SYN = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in V.SYNONYMS.items()) + "}"
_CANON = "CASE WHEN strlen(t) >= 4 AND ends_with(t, 's') AND NOT ends_with(t, 'ss') AND NOT ends_with(t, 'us') THEN t[:-2] ELSE t END"


@query(f"""WITH a(k, phrase) AS (VALUES {_VALUES}), q AS (SELECT conv_id, turn, coalesce(role, '') || ' ' || phrase || ' ' || turn || ' ' || conv_id AS query FROM conversations JOIN a ON k = 1 + conv_id % 4),
t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(query), '[^a-z0-9_]+'), lambda t: strlen(t) >= 2 AND NOT list_contains({list(V.STOP_WORDS)}, t))) AS toks FROM q),
u AS (SELECT conv_id, turn, unnest(toks) AS t FROM t), e AS (SELECT conv_id, turn, t AS term FROM u UNION SELECT conv_id, turn, unnest(({_SYN})[{_CANON}]) FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY term) AS n FROM e)
SELECT conv_id, turn, string_agg(term, ' ' ORDER BY term) AS terms FROM r WHERE n <= 20 GROUP BY ALL""")  # fmt: skip
def expand_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of each turn's role, numbers and one of the stated phrases."""
    phrase = F.element_at(F.array(*map(F.lit, ASKED.values())), (1 + F.col("conv_id") % 4).cast("int"))
    q = F.concat_ws(" ", F.coalesce("role", F.lit("")), phrase, F.col("turn").cast("string"), F.col("conv_id").cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.expand(text.query_tokens(q)), " ").alias("terms"))


@query("""SELECT doc_id, sha256(text) AS hash, substring(sha256(source), 1, 12) AS repository_id, greatest(strlen(text) // 4, floor(len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\x0B\\f]+'), lambda t: t <> '')) * 1.3::DOUBLE)::BIGINT) AS n_tokens
FROM documents""")
def hashes_and_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), paths.repository_id(F.col("source")).alias("repository_id"), text.token_estimate(F.col("text")).alias("n_tokens"))


# --- index and search --------------------------------------------------------------------------

_PATH_TOKENS = f"list_distinct(flatten(list_transform(list_filter(string_split_regex(path, '[/\\\\._-]+'), lambda p: p <> ''), lambda p: {_SPLIT.format(n='p')} || [lower(p)])))"
_ANALYSE = "list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '' AND strlen(t) <= 40)"
_WORD_PARTS = f"CASE WHEN regexp_matches(w, '_|[a-z][^_]*[A-Z]|[A-Z].*[A-Z].*[a-z]') THEN [lower(w)] || list_filter({_SPLIT.format(n='w')}, lambda p: p <> lower(w)) ELSE [lower(w)] END"
_WORDS = f"flatten(list_transform(list_filter(string_split_regex(content, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> ''), lambda w: {_WORD_PARTS}))"
_TITLE = f"CASE WHEN ({paths.file_class_sql('path')}) = 'Documentation' THEN trim(regexp_extract(content, '(?m)^[ \\t]*#{{1,2}} +(.+)$', 1)) ELSE '' END"
_HEADINGS = "array_to_string(list_transform(list_filter(string_split(content, chr(10)), lambda x: starts_with(trim(x), '#')), lambda x: trim(regexp_replace(trim(x), '^#+', ''))), ' ')"
_NAMES = "list_distinct(flatten([" + ", ".join("regexp_extract_all(content, '" + p.replace("'", "''") + "', 1)" for p in sym.PATTERNS.values()) + "]))"
_NAME_PARTS = f"list_transform({_NAMES}, lambda n: array_to_string([n] || list_filter({_SPLIT.format(n='n')}, lambda p: p <> lower(n)), ' '))"
#: The terms of the six fields of each file in `corpus`.
FIELDS_SQL = f"""f AS (SELECT repository_id, path, 'path' AS field, {_ANALYSE.format(x=f"array_to_string({_PATH_TOKENS}, ' ')")} AS terms FROM corpus
UNION ALL SELECT repository_id, path, 'filename', {_ANALYSE.format(x=_STEM)} FROM corpus
UNION ALL SELECT repository_id, path, 'title', {_ANALYSE.format(x=_TITLE)} FROM corpus
UNION ALL SELECT repository_id, path, 'content', (CASE WHEN ({_TITLE}) <> '' THEN {_ANALYSE.format(x=_HEADINGS)} ELSE [] END) || {_ANALYSE.format(x=f"array_to_string({_WORDS}, ' ')")} FROM corpus
UNION ALL SELECT repository_id, path, 'symbols', {_ANALYSE.format(x=f"array_to_string({_NAME_PARTS}, ' ')")} FROM corpus
UNION ALL SELECT repository_id, path, 'symbol_name', {_ANALYSE.format(x=f"array_to_string({_NAMES}, ' ')")} FROM corpus)"""  # fmt: skip
_FIELDS = CORPUS + ", " + FIELDS_SQL


def _stored(spark: SparkSession, sf_dir: str) -> segments.Snapshot:
    """The stored index of the documents; the first query builds it."""
    return upkeep.opened(corpus(spark, sf_dir), "documents")


@query(_FIELDS + " SELECT repository_id, field, count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM f GROUP BY ALL")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.field_sizes(_stored(spark, sf_dir))


@query(_FIELDS + """, t AS (SELECT repository_id, path, unnest(terms) AS term FROM f WHERE field = 'content'), p AS (SELECT repository_id, path, term, count(*) AS tf FROM t
GROUP BY ALL) SELECT repository_id, count(*) AS n_postings, sum(tf)::BIGINT AS total_tf, max(tf) AS max_tf, count(DISTINCT term) AS n_terms FROM p GROUP BY ALL""")
def postings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_term = segments.owned(_stored(spark, sf_dir), ["content"]).groupBy("repository_id", "term").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"), F.max("tf").alias("most"))
    return by_term.groupBy("repository_id").agg(F.sum("n").alias("n_postings"), F.sum("tf").alias("total_tf"), F.max("most").alias("max_tf"), F.count("*").alias("n_terms"))


_TERMS = f"""q(query_id, query) AS (VALUES {_VALUES}), qt AS (SELECT query_id, unnest(list_distinct(list_filter(string_split_regex(lower(query), '[^a-z0-9_]+'), lambda t: strlen(t) >= 2 AND NOT list_contains({list(V.STOP_WORDS)}, t)))) AS term FROM q)"""
_BM25 = _FIELDS + f""", {_TERMS}, st AS (SELECT field, count(*) AS n, avg(len(terms)) AS al FROM f GROUP BY field), u AS (SELECT repository_id, path, field, len(terms) AS len, unnest(terms) AS term FROM f),
tf AS (SELECT repository_id, path, field, len, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
b(field, boost) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in V.FIELD_BOOSTS.items())}),
s AS (SELECT query_id, repository_id, path, sum(boost * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / al)))) AS score
FROM tf JOIN df USING (field, term) JOIN st USING (field) JOIN b USING (field) JOIN qt USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, repository_id, path) AS rank FROM s)"""  # fmt: skip


@query(_BM25 + " SELECT query_id::INT AS query_id, repository_id, path, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 50")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segments.search(_stored(spark, sf_dir), segments.clauses_of(retrieve.terms(asked(spark))), 50)
    return found.select("query_id", "repository_id", "path", F.round("score", 6).alias("score"), "rank")


@query(CORPUS + "SELECT repository_id, count(*) AS n_files, sum(strlen(content))::BIGINT AS n_bytes FROM corpus GROUP BY repository_id")
def repository_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.count_files(corpus(spark, sf_dir))


@query(CORPUS + """, l AS (SELECT repository_id, path, unnest(string_split(content, chr(10))) AS content, generate_subscripts(string_split(content, chr(10)), 1) AS line
FROM corpus) SELECT repository_id, path, line::INT AS line, content FROM l WHERE regexp_matches(content, '(?i)licen[sc]ed? under')
ORDER BY repository_id, path, line LIMIT 200""")
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limited scan is the operator's feature: the first 200 matching lines in order."""
    return grep(corpus(spark, sf_dir), "licen[sc]ed? under", 200)


@query("SELECT p_name, p_partkey FROM part WHERE p_name ILIKE '%WIDGET%' AND p_name ILIKE '%b%' ORDER BY p_name, p_partkey LIMIT 100")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limited lookup by parts of a name, in order of names."""
    return store.search_names(table(spark, sf_dir, "part").select("p_name", "p_partkey"), "p_name", ["WIDGET", "B"], 100)


# --- joins, sets, incremental ------------------------------------------------------------------


@query("""WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents
WHERE doc_id % 10 <> 0), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END) AS h FROM documents
WHERE doc_id % 11 <> 0) SELECT CAST(coalesce(o.doc_id, n.doc_id) AS VARCHAR) AS path, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'deleted' WHEN o.h <> n.h THEN 'changed' ELSE 'unchanged' END AS status
FROM o FULL JOIN n USING (doc_id)""")
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two made-up states of one tree; the modulo rules make the states and leave no row of either out."""
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 10 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash"))
    new = d.where("doc_id % 11 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return diff(old, new)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return store.orphans(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), o, ["c_custkey"])


_KNOW = "SELECT event_type AS category, CAST(user_id AS VARCHAR) AS key, CAST(event_id % 5 AS VARCHAR) AS repository_id, value AS confidence, CAST(event_id AS VARCHAR) AS value, event_id AS updated_at FROM events"


def _knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("key"), (F.col("event_id") % 5).cast("string").alias("repository_id"), F.col("value").alias("confidence"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("updated_at"))


@query(f"""WITH k AS ({_KNOW}), r AS (SELECT *, row_number() OVER (PARTITION BY category, key, repository_id ORDER BY confidence DESC, value DESC) AS n
FROM k) SELECT category, key, repository_id, confidence, value, updated_at FROM r WHERE n = 1""")
def surest_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.surest(_knowledge(spark, sf_dir))


@query(f"""WITH k AS ({_KNOW}), r AS (SELECT *, row_number() OVER (PARTITION BY category, key, repository_id ORDER BY updated_at DESC) AS n
FROM k) SELECT category, key, repository_id, confidence, value, updated_at FROM r WHERE n = 1""")
def upsert_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _knowledge(spark, sf_dir)
    return upsert(k.where("updated_at % 2 = 0"), k.where("updated_at % 2 = 1"), ["category", "key", "repository_id"], "updated_at")


@query(f"""WITH k AS ({_KNOW}) SELECT category, key, repository_id, value, updated_at, CASE WHEN updated_at < 5000 THEN greatest(0.1::DOUBLE, confidence - 0.25::DOUBLE) ELSE confidence END AS confidence
FROM k""")
def decay_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.decay(_knowledge(spark, sf_dir), 5000, 0.25)


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT n_name AS src, r_name AS dst
FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT DISTINCT c_mktsegment, n_name
FROM customer JOIN nation ON c_nationkey = n_nationkey), i(path) AS (SELECT src FROM e WHERE dst IN ('ASIA', 'EUROPE') UNION SELECT src
FROM e JOIN i ON e.dst = i.path) SELECT 'r' AS repository_id, path FROM i""")
def impact_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, c = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    e = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst")).unionByName(c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_mktsegment").alias("src"), F.col("n_name").alias("dst"))).distinct()
    return graph.impact(e.withColumn("repository_id", F.lit("r")), spark.createDataFrame([("r", "ASIA"), ("r", "EUROPE")], "repository_id string, path string"))


# --- aggregations, windows, metrics ------------------------------------------------------------


@query("""SELECT event_type, le::DOUBLE AS le, count(*) FILTER (value <= le) AS n, round(sum(value), 4) AS total, count(value) AS count
FROM events, (VALUES (10), (25), (50), (100), (250)) b(le) GROUP BY event_type, le""")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(table(spark, sf_dir, "events"), "event_type", "value", [10, 25, 50, 100, 250]).withColumn("total", F.round("total", 4))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n
FROM events) SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) FILTER (i = least(floor(n * 0.5), n - 1)) AS p50, max(value) FILTER (i = least(floor(n * 0.95), n - 1)) AS p95
FROM r GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentiles(table(spark, sf_dir, "events"), "event_type", "value").withColumn("mean", F.round("mean", 6))


_TASKS = "WITH t AS (SELECT o_custkey AS task_id, list(DISTINCT l_suppkey ORDER BY l_suppkey) AS expected, list(l_partkey % 100 + 1 ORDER BY l_orderkey, l_linenumber, l_partkey % 100 + 1) AS retrieved FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) "


@query(_TASKS + """SELECT task_id, round(len(list_intersect(expected, list_slice(retrieved, 1, 10)))::DOUBLE / greatest(len(expected), 1), 6) AS recall, round(coalesce(1.0::DOUBLE / list_min(list_filter(list_transform(expected, lambda e: coalesce(list_position(retrieved, e), 0)), lambda x: x > 0)), 0), 6) AS rr, round(CASE WHEN len(retrieved) = 0 THEN 0 ELSE (len(retrieved) - len(list_distinct(retrieved)))::DOUBLE / len(retrieved) END, 6) AS duplicates
FROM t""")
def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    j = o.join(li, o.o_orderkey == li.l_orderkey)
    got = F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", (F.col("l_partkey") % 100 + 1).alias("p")))), lambda x: x["p"])
    t = j.groupBy(F.col("o_custkey").alias("task_id")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("expected"), got.alias("retrieved"))
    q = metrics.quality(t, 10)
    return q.select("task_id", *[F.round(c, 6).alias(c) for c in ("recall", "rr", "duplicates")])


@query("""WITH t AS (SELECT l_suppkey AS id, list(DISTINCT l_partkey) FILTER (l_returnflag = 'A') AS a, list(DISTINCT l_partkey) FILTER (l_returnflag = 'N') AS b
FROM lineitem
GROUP BY 1) SELECT id, len(list_intersect(coalesce(a, []), coalesce(b, []))) AS common, len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS a_only, len(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))) AS b_only
FROM t""")
def result_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    of = lambda f: F.collect_set(F.when(F.col("l_returnflag") == f, F.col("l_partkey")))
    return metrics.overlap(li.groupBy(F.col("l_suppkey").alias("id")).agg(of("A").alias("a"), of("N").alias("b")))


@query("""WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY role, sha256(text) ORDER BY conv_id, turn) AS n
FROM conversations) SELECT conv_id, turn, role FROM r WHERE n = 1""")
def session_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "conversations").select(F.col("role").alias("session_id"), F.struct("conv_id", "turn").alias("ts"), F.col("text").alias("content"))
    return context.first_in_session(b).select("ts.conv_id", "ts.turn", F.col("session_id").alias("role"))


_TOK = "greatest(strlen(line) // 4, floor(len(list_filter(string_split_regex(line, '[ \\t\\n\\r\\x0B\\f]+'), lambda t: t <> '')) * 1.3::DOUBLE)::BIGINT) + 1"


@query(CORPUS + f""", own AS (SELECT doc_id, content, {_TOK.replace('line', 'content')} - 1 AS own FROM corpus),
l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM corpus),
r AS (SELECT *, sum({_TOK}) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM l),
k AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (run <= 195) || chr(10), '') AS kept, coalesce(max(run) FILTER (run <= 195), 0) + 5 AS t FROM r GROUP BY doc_id)
SELECT doc_id, CASE WHEN own > 200 THEN kept || '... [truncated, full text at ' || substring(sha256(content), 1, 16) || ']' ELSE content END AS text,
CASE WHEN own > 200 THEN t ELSE own END::BIGINT AS n_tokens, own > 200 AS cut FROM own JOIN k USING (doc_id)""")  # fmt: skip
def truncate_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.truncate(corpus(spark, sf_dir).select("doc_id", F.col("content").alias("text")), 200)


@query(f"""{CORPUS}, c AS (SELECT doc_id, repository_id, path, ({paths.file_class_sql('path')}) = 'Documentation' AS docs, strlen(content) // 4 AS n_tokens
FROM corpus), r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY repository_id, docs ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used
FROM c) SELECT repository_id AS query_id, path, n_tokens, used FROM r WHERE used <= CASE WHEN docs THEN 1800 ELSE 2200 END""")
def fill_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus(spark, sf_dir).select(F.col("repository_id").alias("query_id"), "path", F.col("doc_id").alias("rank"), paths.file_class(F.col("path")).alias("file_class"), F.floor(F.octet_length("content") / 4).alias("n_tokens"))
    return context.fill_budget(e, 4000).select("query_id", "path", "n_tokens", "used")


@query("""WITH r AS (SELECT user_id AS repository_id, ts, event_type AS oid, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old
FROM events) SELECT repository_id, event_id, oid FROM r WHERE old IS NULL OR old <> oid""")
def head_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("repository_id"), F.struct("ts", "event_id").alias("ts"), F.col("event_type").alias("oid"))
    return ev.head_changes(e).select("repository_id", "ts.event_id", "oid")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring buffer of 1000 events is the operator's feature."""
    return ev.last_n(table(spark, sf_dir, "events")).select("event_id", "user_id", "event_type")


@query("SELECT CAST(time_bucket(INTERVAL 5 MINUTE, ts) AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.windowed(e).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


_ORDERED = "e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"


@query(f"""WITH RECURSIVE {_ORDERED}, b AS (
SELECT user_id, event_id, us, i, 19e6::DOUBLE AS rest, true AS allowed FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.event_id, e.us, e.i,
CASE WHEN least(20e6::DOUBLE, rest + (e.us - b.us) * 10) >= 1e6 THEN least(20e6::DOUBLE, rest + (e.us - b.us) * 10) - 1e6 ELSE least(20e6::DOUBLE, rest + (e.us - b.us) * 10) END,
least(20e6::DOUBLE, rest + (e.us - b.us) * 10) >= 1e6 FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1)
SELECT user_id AS session, event_id, allowed FROM b""")  # fmt: skip
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.limit_rate(table(spark, sf_dir, "events"), "user_id").drop("ts")


@query("""SELECT event_type AS request_type, count(*) AS n, coalesce(sum(event_id), 0)::BIGINT AS input_tokens, round(coalesce(sum(value), 0), 4) AS cost FROM events
GROUP BY 1""")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = store.usage(table(spark, sf_dir, "events"), "event_type", "event_id", "value")
    return u.select(F.col("event_type").alias("request_type"), "n", F.col("tokens").alias("input_tokens"), F.round("cost", 4).alias("cost"))


@query(CORPUS + f"SELECT {_EXT} AS ext, count(*) AS n FROM corpus GROUP BY 1 ORDER BY n DESC, ext LIMIT 10")
def top_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-ten report."""
    return store.top(corpus(spark, sf_dir).select(paths.extension(F.col("path")).alias("ext")), "ext", 10)


_SYMS = "SELECT mod(p_partkey, 20)::VARCHAR AS repository_id, replace(p_name, ' ', '_') AS name FROM part"


@query(f"""WITH s AS ({_SYMS}), t AS (SELECT repository_id, CASE WHEN contains(name, '_') THEN 'snake_case' WHEN regexp_matches(name, '^[a-z].*[A-Z]') THEN 'camelCase' WHEN regexp_matches(name, '^[A-Z]') THEN 'PascalCase' END AS k
FROM s) SELECT repository_id, convention, 0.8::DOUBLE AS confidence FROM (SELECT repository_id, k AS convention, count(*) AS n FROM t
GROUP BY ALL) JOIN (SELECT repository_id, count(*) AS total FROM t GROUP BY ALL) USING (repository_id) WHERE convention IS NOT NULL AND n > 0.5 * total""")
def naming_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).cast("string").alias("repository_id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    return knowledge.naming(s)


@query("WITH k(term) AS (VALUES " + ", ".join(f"('{t}')" for t in V.DOMAIN_TERMS) + "), s AS (SELECT source AS repository_id, unnest(string_split(text, ' ')) AS name FROM documents) SELECT repository_id, term, count(*) AS n, least(count(*) / 10, 0.9::DOUBLE) AS confidence FROM s JOIN k ON contains(lower(name), term) GROUP BY ALL HAVING count(*) >= 2")
def domain_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("repository_id"), F.explode(F.split("text", " ")).alias("name"))
    return knowledge.domain_terms(d)


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3""")
def ranked_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three rows of each group, a top-k report."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    best = store.best_of(li, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3)
    return best.select("l_orderkey", "l_linenumber", "l_suppkey", "rank")


@query("""WITH a AS (SELECT CAST(l_partkey AS VARCHAR) AS path, max(l_extendedprice) AS s FROM lineitem WHERE l_returnflag = 'A'
GROUP BY 1), n AS (SELECT CAST(l_partkey AS VARCHAR) AS path, max(l_extendedprice) AS s FROM lineitem WHERE l_returnflag = 'N'
GROUP BY 1) SELECT coalesce(a.path, n.path) AS path, greatest(coalesce(a.s * 1.0::DOUBLE, 0), coalesce(n.s * 0.4::DOUBLE, 0)) AS score FROM a
FULL JOIN n ON a.path = n.path""")
def merged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    of = lambda f: li.where(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").cast("string").alias("path")).agg(F.max("l_extendedprice").alias("score"))
    return index.merge_evidence(of("A"), of("N"), 1.0, 0.4)


@query("""WITH a AS (SELECT CAST(l_partkey AS VARCHAR) AS path, max(l_extendedprice) AS score FROM lineitem WHERE l_returnflag = 'A'
GROUP BY 1), n AS (SELECT CAST(l_partkey AS VARCHAR) AS path, max(l_extendedprice) AS score FROM lineitem WHERE l_returnflag = 'N'
GROUP BY 1) SELECT path, score FROM a UNION ALL SELECT path, score * 0.5::DOUBLE FROM n WHERE path NOT IN (SELECT path FROM a)""")
def expansion_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    of = lambda f: li.where(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").cast("string").alias("path")).agg(F.max("l_extendedprice").alias("score"))
    return index.gap_fill(of("A"), of("N"))


# --- more of the index, the graph, context and upkeep ------------------------------------------


@query("""SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: starts_with(trim(x), '#')), lambda x: trim(regexp_replace(trim(x), '^#+', ''))), ' ') AS headings
FROM documents""")
def all_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.headings(F.col("text")).alias("headings"))


@query(CORPUS + f"SELECT doc_id, array_to_string(list_sort({_PATH_TOKENS}), ' ') AS tokens FROM corpus")
def path_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", F.array_join(F.sort_array(text.path_tokens(F.col("path"))), " ").alias("tokens"))


@query(f"""SELECT doc_id, len(t)::INT AS n_terms, len(list_distinct(t))::INT AS n_distinct, sha256(array_to_string(t, ' ')) AS hash
FROM (SELECT doc_id, {_ANALYSE.format(x='text')} AS t FROM documents)""")
def analyze_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", text.analyse(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_terms"), F.size(F.array_distinct("t")).alias("n_distinct"), F.sha2(F.array_join("t", " "), 256).alias("hash"))


@query(f"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda t: strlen(t) >= 2 AND NOT list_contains({list(V.STOP_WORDS)}, t)))), ' ') AS terms
FROM conversations""")
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.sort_array(text.query_tokens(F.col("text"))), " ").alias("terms"))


_FOUND = " SELECT query_id::INT AS query_id, repository_id, path, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 20"


@query(_BM25.replace("FROM s)", "FROM s WHERE repository_id = (SELECT min(source) FROM documents))") + _FOUND)
def bm25_in_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "documents").agg(F.min("source")).first()[0]
    found = segments.search(_stored(spark, sf_dir), segments.clauses_of(retrieve.terms(asked(spark))), 20, F.col("repository_id") == first)
    return found.select("query_id", "repository_id", "path", F.round("score", 6).alias("score"), "rank")


@query(_BM25.replace("FROM s)", f"FROM s WHERE (CASE {_NAME_CASES} {_LANG_CASES} END) = 'python')") + _FOUND)
def bm25_in_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segments.search(_stored(spark, sf_dir), segments.clauses_of(retrieve.terms(asked(spark))), 20, F.col("language") == "python")
    return found.select("query_id", "repository_id", "path", F.round("score", 6).alias("score"), "rank")


@query(_FIELDS + f""", {_TERMS}, u AS (SELECT repository_id, path, field, unnest(terms) AS term
FROM f) SELECT field, term, count(DISTINCT repository_id || '/' || path) AS n_docs, count(*) AS n_found FROM u WHERE term IN (SELECT term FROM qt) GROUP BY ALL""")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.document_frequency(_stored(spark, sf_dir), retrieve.terms(asked(spark)))


@query(_FIELDS + f""", {_TERMS}, u AS (SELECT DISTINCT repository_id, path, unnest(terms) AS term
FROM f) SELECT query_id::INT AS query_id, count(DISTINCT repository_id || '/' || path) AS n FROM u JOIN qt USING (term) GROUP BY 1""")
def count_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold any term of each query in any field, whatever k."""
    return segments.count_hits(_stored(spark, sf_dir), retrieve.terms(asked(spark)))


@query(CORPUS + f""", t AS (SELECT repository_id, path, ' ' || array_to_string({_ANALYSE.format(x='content')}, '  ') || ' ' AS line
FROM corpus), n AS (SELECT repository_id, path, (length(line) - length(replace(line, ' licensed  under ', ''))) // 17 AS n FROM t) SELECT * FROM n WHERE n > 0""")
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.phrase_matches(corpus(spark, sf_dir), "licensed under")


@query(CORPUS + """, l AS (SELECT repository_id, path, unnest(string_split(content, chr(10))) AS line FROM corpus) SELECT repository_id, path, count(*)::INT AS n_lines FROM l
WHERE regexp_matches(line, '(?i)[a-z0-9]+@[a-z0-9]+') GROUP BY ALL""")
def grep_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep_files(corpus(spark, sf_dir), "[a-z0-9]+@[a-z0-9]+")


@query(CORPUS + "SELECT doc_id, array_to_string(list_slice(string_split(content, chr(10)), 2, 4), chr(10)) AS snippet FROM corpus")
def line_window_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", line_range(F.col("content"), 2, 4).alias("snippet"))


@query(f"""WITH k AS ({_KNOW}) SELECT category, key, repository_id, value, confidence FROM k
WHERE (key ILIKE '%12%' OR value ILIKE '%12%') AND confidence >= 0.3 AND repository_id = '2' ORDER BY confidence DESC, repository_id, category, key LIMIT 20""")
def knowledge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest 20 rows that hold a text, a limited lookup."""
    return knowledge.retrieve(_knowledge(spark, sf_dir), "12", repository="2").select("category", "key", "repository_id", "value", "confidence")


@query("""WITH e AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS src, 'p' || l_partkey AS dst
FROM orders JOIN lineitem ON o_orderkey = l_orderkey), x AS (SELECT src AS path, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1
FROM e) SELECT 'r' AS repository_id, path, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM x GROUP BY path""")
def edge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    e = o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").cast("string").alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst")).distinct()
    return graph.degrees(e.withColumn("repository_id", F.lit("r")))


@query("SELECT event_type AS path, user_id AS source, CAST(event_id % 3 AS VARCHAR) AS retriever, max(value) AS score, min(event_id) AS pos FROM events GROUP BY ALL")
def provenance_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("path"), F.col("user_id").alias("source"), (F.col("event_id") % 3).cast("string").alias("retriever"), F.col("value").alias("score"), F.col("event_id").alias("pos"))
    return context.provenance(e)


@query("SELECT p_brand AS category, count(*) AS n, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY 1")
def category_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.means(table(spark, sf_dir, "part").withColumnRenamed("p_brand", "category"), "category", "p_retailprice").withColumn("mean", F.round("mean", 6))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def counter_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.counter(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT lang AS language, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY lang")
def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.shares(table(spark, sf_dir, "documents").withColumnRenamed("lang", "language"), "language").withColumn("share", F.round("share", 6))


@query(f"""WITH RECURSIVE {_ORDERED}, d AS (SELECT user_id, us / 1e6::DOUBLE AS t, min(i) AS i FROM e GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM d), b AS (
SELECT user_id, k, t + 3600 AS until, true AS fires FROM n WHERE k = 1
UNION ALL SELECT n.user_id, n.k, CASE WHEN n.t > b.until THEN n.t + 3600 ELSE b.until END, n.t > b.until FROM b JOIN n ON n.user_id = b.user_id AND n.k = b.k + 1)
SELECT user_id, until AS fired FROM b WHERE fires""")  # fmt: skip
def debounce_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("at"))
    return ev.debounce_events(e, "user_id", 3600.0)


# --- ranking pieces, the graph's sides, upkeep of scopes ----------------------------------------


@query(CORPUS + f"""SELECT doc_id, ({paths.file_class_sql('path')}) = 'Documentation' AS is_documentation, ({paths.file_class_sql('path')}) = 'Test' AS is_test FROM corpus""")
def path_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cls = paths.file_class(F.col("path"))
    return corpus(spark, sf_dir).select("doc_id", (cls == "Documentation").alias("is_documentation"), (cls == "Test").alias("is_test"))


@query(CORPUS + f""", {_TERMS}, q2 AS (SELECT query_id, list(term) AS terms FROM qt
GROUP BY 1) SELECT query_id::INT AS query_id, doc_id, len(list_filter(terms, lambda t: len(list_filter(string_split_regex(lower(path), '[^a-z0-9]+'), lambda s: contains(s, t))) > 0))::INT AS n_matched
FROM corpus, q2""")
def path_token_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens of each of the stated queries lie in each path; the queries are a constant of the plan."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("query_id"), text.query_tokens(F.lit(v)).alias("tokens")) for k, v in ASKED.items()]))
    c = corpus(spark, sf_dir).select("doc_id", "path", each.alias("q"))
    return c.select("q.query_id", "doc_id", paths.segment_matches(F.col("q.tokens"), F.col("path")).alias("n_matched"))


_PAIRS = "f AS (SELECT 'v' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '.cshtml' ELSE '.cshtml.cs' END AS path, p_retailprice AS score FROM part UNION ALL SELECT 'v' || p_partkey || '.cshtml.cs', 0 FROM part WHERE p_partkey % 3 = 0), found AS (SELECT path, score FROM f WHERE score > 0)"


@query(f"""WITH {_PAIRS} SELECT path || '.cs' AS path, score * 0.8::DOUBLE AS score FROM found WHERE path LIKE '%.cshtml' AND path || '.cs' IN (SELECT path
FROM f) AND path || '.cs' NOT IN (SELECT path FROM found)""")
def code_behind_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as views and their code files; views that were found bring theirs along."""
    p = table(spark, sf_dir, "part")
    stem = F.concat(F.lit("v"), F.col("p_partkey").cast("string"))
    found = p.select(F.concat(stem, F.when(F.col("p_size") % 2 == 0, ".cshtml").otherwise(".cshtml.cs")).alias("path"), F.col("p_retailprice").alias("score"))
    files = found.select("path").unionByName(p.where("p_partkey % 3 = 0").select(F.concat(stem, F.lit(".cshtml.cs")).alias("path")))
    return index.code_behind(found, files)


@query("""WITH a AS (SELECT CAST(l_partkey AS VARCHAR) AS path, max(l_extendedprice) AS score, 'lexical' AS source FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1
UNION ALL SELECT CAST(l_partkey AS VARCHAR), max(l_extendedprice), 'symbols' FROM lineitem WHERE l_returnflag <> 'A'
GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, source DESC) AS n FROM a) SELECT path, source, score FROM r WHERE n = 1""")
def merge_max_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    of = lambda on, s: li.where(on).groupBy(F.col("l_partkey").cast("string").alias("path")).agg(F.max("l_extendedprice").alias("score")).withColumn("source", F.lit(s))
    return index.merge_max(of("l_returnflag = 'A'", "lexical"), of("l_returnflag <> 'A'", "symbols"))


@query("""SELECT DISTINCT 'r' AS repository_id, CAST(c_custkey AS VARCHAR) AS path FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE n_name IN ('NATION_0', 'NATION_9')""")
def dependents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    edges = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").cast("string").alias("src"), F.col("n_name").alias("dst"))
    of = spark.createDataFrame([("r", "NATION_0"), ("r", "NATION_9")], "repository_id string, path string")
    return graph.dependents(edges.withColumn("repository_id", F.lit("r")), of)


from . import queries_code, queries_evaluate, queries_sessions, queries_store, queries_structure  # noqa: E402, F401  (they register their queries)
