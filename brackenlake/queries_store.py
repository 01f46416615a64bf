"""Queries of the stored tables' upkeep, of request and path functions, of filters, metrics and states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, text
from .functions import vocabulary as V
from .operators import context, graph, index, knowledge, metrics, store
from .operators import symbols as sym
from .queries import CORPUS, _LANG_CASES, _NAME_CASES, _TOK
from .queries_code import _AUTHORITY, _BARE, _CLASS, _DIRECTORY, _EDGES, _EXPANDED, _PLAIN, _SEARCHED, _SYMBOLS, _TOKENS, _WEIGHTS, CODE
from .registry import query
from .sources.code import code_corpus
from .sources.corpus import corpus, table
from .streaming import events as ev

# --- files, symbols, repositories -------------------------------------------------------------------


@query(f"""{CODE}, {_SYMBOLS}, n AS (SELECT repository_id, path, count(*) AS n FROM symbols
GROUP BY ALL) SELECT repository_id, path, language, strlen(content) AS n_bytes, coalesce(n, 0) AS n_symbols FROM corpus LEFT JOIN n USING (repository_id, path)""")
def file_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = code_corpus(spark, sf_dir)
    return store.file_info(c, sym.symbols(c))


@query(f"""{CODE}, {_SYMBOLS} SELECT repository_id, path, name, kind, CASE WHEN path LIKE '%inner%' THEN 'unknown' ELSE language END AS language
FROM symbols JOIN corpus USING (repository_id, path) WHERE name = 'check_item'""")
def symbol_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of one name; the files that hold most of them are not in the table of files."""
    c = code_corpus(spark, sf_dir)
    return store.symbol_info(sym.symbols(c), c.where("path not like '%inner%'"), "check_item")


@query(f"{CODE}, {_SYMBOLS} SELECT s.* FROM symbols s JOIN corpus USING (repository_id, path) WHERE language = 'rust'")
def symbols_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = code_corpus(spark, sf_dir)
    return store.symbol_paths(sym.symbols(c), c.where("language = 'rust'"))


@query(f"""{CODE}, {_SYMBOLS} SELECT s.* FROM symbols s JOIN corpus USING (repository_id, path) WHERE language <> 'python'
UNION ALL SELECT repository_id, path, 'new_' || path, 'function' FROM corpus WHERE language = 'python' AND path LIKE '%.py'""")
def symbols_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols after the files of one language were read again."""
    c = code_corpus(spark, sf_dir)
    changed = c.where("language = 'python'")
    new = changed.select("repository_id", "path", F.concat(F.lit("new_"), "path").alias("name"), F.lit("function").alias("kind"))
    return store.replace_symbols(sym.symbols(c), changed, new)


@query(f"{CODE} SELECT repository_id, path, CASE WHEN language = 'rust' THEN 'changed' ELSE content END AS content FROM corpus WHERE language <> 'csharp'")
def files_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files after some were changed and some deleted."""
    c = code_corpus(spark, sf_dir).select("repository_id", "path", "content")
    lang = code_corpus(spark, sf_dir)
    new = lang.where("language = 'rust'").select("repository_id", "path", F.lit("changed").alias("content"))
    return store.drop_files(store.put_files(c, new), lang.where("language = 'csharp'"))


_REGISTRY = "SELECT substring(sha256(n_name), 1, 12) AS repository_id, n_name AS path, n_nationkey AS registered_at FROM nation"


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(paths.repository_id(F.col("n_name")).alias("repository_id"), F.col("n_name").alias("path"), F.col("n_nationkey").alias("registered_at"))


@query(f"""WITH r AS ({_REGISTRY}) SELECT repository_id, CASE WHEN registered_at % 3 = 0 THEN path || '/new' ELSE path END AS path, registered_at FROM r
UNION ALL SELECT 'new', 'new', 99""")
def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known repositories that come again take their new path and keep their time; one is new."""
    r = _registry(spark, sf_dir)
    again = r.where("registered_at % 3 = 0").select("repository_id", F.concat("path", F.lit("/new")).alias("path"), F.lit(500).cast(dict(r.dtypes)["registered_at"]).alias("registered_at"))
    new = spark.createDataFrame([("new", "new", 99)], "repository_id string, path string, registered_at int")
    return store.register(r, again.unionByName(new.withColumn("registered_at", F.col("registered_at").cast(dict(r.dtypes)["registered_at"]))))


@query(f"WITH r AS ({_REGISTRY}) SELECT repository_id, path FROM r WHERE path <> 'NATION_3' ORDER BY registered_at")
def registered_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _registry(spark, sf_dir)
    left, _ = store.unregister(r, corpus(spark, sf_dir), r.where("path = 'NATION_3'").first()["repository_id"])
    return store.registered(left)


@query(CORPUS + "SELECT DISTINCT repository_id FROM corpus WHERE repository_id <> ''")
def repository_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.repositories(corpus(spark, sf_dir))


# --- memory, knowledge, seeds -----------------------------------------------------------------------

_MEMORY = "SELECT event_type AS namespace, 'k' || (user_id % 50) AS key, CAST(event_id AS VARCHAR) AS value, event_id AS created_at FROM events"


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("namespace"), F.concat(F.lit("k"), F.col("user_id") % 50).alias("key"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("created_at"))


def _remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _memory(spark, sf_dir)
    none = m.limit(0)
    return store.remember(store.remember(none, m.where("created_at % 2 = 1")), m.where("created_at % 2 = 0"))


_KEPT = f"m AS ({_MEMORY}), kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY namespace, key ORDER BY created_at % 2, created_at DESC) AS n FROM m) WHERE n = 1)"


@query(f"WITH {_KEPT} SELECT namespace, key, value, created_at FROM kept")
def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of even numbers are saved after those of odd ones, so they win whatever their time."""
    return _remembered(spark, sf_dir)


@query(f"""WITH {_KEPT}, t AS (SELECT min(namespace) AS t FROM kept) SELECT namespace, key, value, created_at FROM kept, t
WHERE namespace = t AND key <> 'k12' AND (key ILIKE '%1%' OR value ILIKE '%1%') ORDER BY key LIMIT 20""")
def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty rows of a namespace that hold a text, a limited lookup, after one was forgotten."""
    m = _remembered(spark, sf_dir)
    first = m.agg(F.min("namespace")).first()[0]
    return store.search_memory(store.forget(m, first, "k12"), first, "1", 20)


@query(f"WITH {_KEPT} SELECT namespace, key, value, created_at FROM kept WHERE key = 'k7' AND namespace = (SELECT min(namespace) FROM kept)")
def memory_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _remembered(spark, sf_dir)
    return store.recall(m, m.agg(F.min("namespace")).first()[0], "k7")


@query("""SELECT event_type AS category, CAST(user_id AS VARCHAR) AS key, CAST(event_id % 5 AS VARCHAR) AS repository_id FROM events
WHERE NOT (event_type = (SELECT min(event_type) FROM events) AND user_id = 7 AND event_id % 5 = 2)""")
def delete_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = e.select(F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("key"), (F.col("event_id") % 5).cast("string").alias("repository_id"))
    return knowledge.delete(k, e.agg(F.min("event_type")).first()[0], "7", "2")


_TREE = "SELECT source AS repository_id, CASE doc_id % 5 WHEN 0 THEN 'README.md' WHEN 1 THEN 'readme.md' WHEN 2 THEN 'docs/adr/' || doc_id || '.md' WHEN 3 THEN 'adr/deep/' || doc_id || '.md' ELSE 'README' END AS path, text AS content FROM documents WHERE doc_id % 5 > 1 OR doc_id IN (SELECT min(doc_id) FROM documents GROUP BY source, doc_id % 5)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k, n = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    path = F.when(k == 0, "README.md").when(k == 1, "readme.md").when(k == 2, F.concat(F.lit("docs/adr/"), n, F.lit(".md"))).when(k == 3, F.concat(F.lit("adr/deep/"), n, F.lit(".md"))).otherwise("README")
    first = d.groupBy("source", k.alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    kept = d.where(k > 1).unionByName(d.where(k <= 1).join(first, "doc_id", "left_semi"))
    return kept.select(F.col("source").alias("repository_id"), path.alias("path"), F.col("text").alias("content"))


@query(f"""WITH t AS ({_TREE}), r AS (SELECT repository_id, min(CASE path WHEN 'README.md' THEN 1 WHEN 'readme.md' THEN 3 WHEN 'README' THEN 4 END) AS k FROM t GROUP BY 1)
SELECT repository_id, 'docs' AS category, CASE k WHEN 1 THEN 'README.md' WHEN 3 THEN 'readme.md' ELSE 'README' END AS key, 0.9::DOUBLE AS confidence FROM r WHERE k IS NOT NULL
UNION ALL SELECT repository_id, 'adr', path, 1.0 FROM t WHERE regexp_extract(path, '^(.*)/[^/]*$', 1) = 'docs/adr'""")
def seed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.seeds(_tree(spark, sf_dir)).select("repository_id", "category", "key", "confidence")


_YAML = "'# list' || chr(10) || 'packages:' || chr(10) || '  - \"Controllers/*\"' || chr(10) || '  - lib/*' || chr(10) || '  - tools' || chr(10) || 'other: x' || chr(10) || '  - no'"


@query(f"""{CODE} SELECT repository_id, 'tools' AS package FROM (SELECT DISTINCT repository_id FROM corpus)
UNION ALL SELECT DISTINCT repository_id, 'lib/' || string_split(path, '/')[2] FROM corpus WHERE path LIKE 'lib/%/%'""")
def workspace_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = code_corpus(spark, sf_dir).select("repository_id", "path", "content")
    yaml = '# list\npackages:\n  - "Controllers/*"\n  - lib/*\n  - tools\nother: x\n  - no'
    lists = c.select("repository_id").distinct().withColumn("path", F.lit("pnpm-workspace.yaml")).withColumn("content", F.lit(yaml))
    return store.workspace_packages(c.unionByName(lists))


@query("SELECT substring(sha256(text), 1, 16) AS key, sha256(text) AS hash FROM (SELECT DISTINCT text FROM documents)")
def spilled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.spill(table(spark, sf_dir, "documents").select("text")).select("key", F.sha2("text", 256).alias("hash"))


# --- requests ---------------------------------------------------------------------------------------

_REQUESTS = "FROM (SELECT conv_id, turn, text AS query FROM conversations)"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("query"))


@query(f"""WITH s AS (SELECT conv_id, turn, query, len({_BARE}) AS n, {_SEARCHED} AS l, {_PLAIN} AS plain {_REQUESTS})
SELECT conv_id, turn, CASE WHEN n > 0 THEN sha256(array_to_string(list_filter(l, lambda e, i: list_position(l, e) = i), ' OR ')) ELSE sha256(coalesce(nullif(trim(regexp_replace(plain, '\\s+', ' ', 'g')), ''), query)) END AS sanitised FROM s""")
def sanitise_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("conv_id", "turn", F.sha2(text.sanitise(F.col("query")), 256).alias("sanitised"))


_SCANNED = f"list_filter(list_transform(list_filter(string_split_regex(query, '\\s+'), lambda t: t <> ''), lambda t: lower(regexp_replace(t, '[^\\p{{L}}\\p{{N}}_]', '', 'g'))), lambda t: strlen(t) >= 2 AND NOT list_contains({list(V.SCAN_STOP_WORDS)}, t))"


@query(f"SELECT conv_id, turn, sha256(array_to_string({_SCANNED}, '|')) AS pattern {_REQUESTS} WHERE len({_SCANNED}) > 0")
def scan_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of stop words alone stand for themselves; those are tested on small cases."""
    r = _requests(spark, sf_dir).select("conv_id", "turn", "query", text.scan_pattern(F.col("query")).alias("p"))
    words = F.filter(F.transform(F.split("query", r"\s+"), lambda t: F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}_]", ""))), lambda t: (F.octet_length(t) >= 2) & ~t.isin(V.SCAN_STOP_WORDS))
    return r.where(F.size(words) > 0).select("conv_id", "turn", F.sha2("p", 256).alias("pattern"))


@query(f"""WITH t AS (SELECT conv_id, turn, {_TOKENS} AS tokens {_REQUESTS}), x AS (SELECT *, {_EXPANDED} AS expanded
FROM t) SELECT conv_id, turn, CASE WHEN len(tokens) > 0 AND len(expanded) > len(tokens) THEN array_to_string(expanded, ' OR ') END AS expanded FROM x""")
def expanded_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("conv_id", "turn", text.expanded_query(F.col("query")).alias("expanded"))


_LINE = "replace(replace(query, chr(13), ''), chr(10), '\\n')"


@query(f"""SELECT conv_id, turn, CASE WHEN length({_LINE}) <= 60 THEN {_LINE} ELSE substring({_LINE}, 1, 60) || '… (+' || (length({_LINE}) - 60) || ' chars)' END AS preview, strlen(query) <= 2000 AS fits {_REQUESTS}""")
def request_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("query")
    return _requests(spark, sf_dir).select("conv_id", "turn", text.preview(q, 60).alias("preview"), text.within_limit(q, 2000).alias("fits"))


@query("SELECT conv_id, turn, text FROM conversations WHERE CAST(conv_id AS VARCHAR) = (SELECT CAST(min(conv_id) AS VARCHAR) FROM conversations)")
def correlated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    e = c.select("conv_id", "turn", "text", F.col("conv_id").cast("string").alias("correlation_id"))
    return ev.by_correlation(e, str(c.agg(F.min("conv_id")).first()[0])).drop("correlation_id")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text ELSE text || chr(10) || chr(10) || '---' || chr(10) || CASE WHEN turn % 3 = 1 THEN 'd' || chr(10) || chr(10) || role ELSE role END END AS enriched
FROM conversations""")
def enriched_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    k = F.col("turn") % 3
    return c.select("conv_id", "turn", context.enrich(F.col("text"), F.when(k == 1, "d").otherwise(""), F.when(k > 0, F.col("role")), F.when(k > 0, 5).otherwise(0)).alias("enriched"))


# --- paths and boosts -------------------------------------------------------------------------------

_ALIAS_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in {**V.LANGUAGE_ALIASES, **{k: k for k in V.LANGUAGES}}.items()) + "}"
_EXTENSION = "regexp_extract(path, '\\.([^./]*)$', 1)"


@query(CORPUS + f"SELECT doc_id, ({_ALIAS_MAP})[lower({_EXTENSION})] AS by_ending, ({_ALIAS_MAP})[lower(substring(coalesce(language, ''), 1, 2))] AS by_name FROM corpus")
def language_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return c.select("doc_id", paths.language_of(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("by_ending"), paths.language_of(F.upper(F.substring(F.coalesce("language", F.lit("")), 1, 2))).alias("by_name"))


@query(CORPUS + f""", l AS (SELECT doc_id, path, CASE {_NAME_CASES} {_LANG_CASES} END AS l FROM corpus)
SELECT doc_id, CASE WHEN l IN ('markdown', 'text') THEN 'Documentation' WHEN l IN ('yaml', 'toml', 'json', 'xml') THEN 'Config' ELSE 'Source' END AS file_class,
l IS NOT NULL OR string_split(path, '.')[-1] IN {V.sql_list(V.TEXT_EXTENSIONS)} OR lower(regexp_extract(path, '([^/]*)$', 1)) IN {V.sql_list(V.TEXT_NAMES)} AS indexable,
lower({paths.EXT_SQL.format(p='path')}) IN {V.sql_list(V.BINARY_EXTENSIONS)} AS is_binary FROM l""")
def indexable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return corpus(spark, sf_dir).select("doc_id", F.coalesce(paths.class_of_language(paths.language(p)), F.lit("Source")).alias("file_class"), paths.indexable(p).alias("indexable"), paths.binary_by_name(p).alias("is_binary"))


@query("""WITH w AS (SELECT doc_id, text AS t FROM documents)
SELECT doc_id, coalesce(strlen(t) >= 5 AND lower(t) NOT IN ('todo', 'no', 'this', 'true', 'false') AND (contains(t, '/') OR contains(t, '\\') OR contains(t, '.')), false) AS valid FROM w""")
def valid_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.coalesce(paths.valid_path(F.col("text")), F.lit(False)).alias("valid"))


_ASK = "how to configure the guide module tests"


@query(f"""{CORPUS}, q AS (SELECT *, '{_ASK}' AS query FROM corpus), t AS (SELECT doc_id, path, content, {_TOKENS} AS tokens FROM q),
m AS (SELECT *, len(list_filter(tokens, lambda t: contains(lower(content), t) OR len(list_filter(string_split_regex(lower(path), '[^a-z0-9]+'), lambda s: contains(s, t))) > 0)) AS n,
trim(regexp_extract(content, '(?m)^[ \\t]*#{{1,2}} +(.+)$', 1)) AS title FROM t)
SELECT doc_id, round(1 + n / len(tokens) * 1.5, 9) AS symbol_boost, round(CASE WHEN title = '' THEN 1 ELSE 1 + len(list_filter(tokens, lambda t: contains(lower(title), t))) / len(tokens) END, 9) AS title_boost FROM m""")
def match_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = text.query_tokens(F.lit(_ASK))
    c = corpus(spark, sf_dir)
    return c.select("doc_id", F.round(paths.symbol_boost(tokens, F.col("path"), F.col("content")), 9).alias("symbol_boost"), F.round(text.title_boost(text.title(F.col("content")), tokens), 9).alias("title_boost"))


@query(f"""{CORPUS}, weights(intent, cls, weight) AS (VALUES {_WEIGHTS}), i AS (SELECT DISTINCT intent FROM weights), c AS (SELECT doc_id, path, {_CLASS} AS cls, intent FROM corpus, i)
SELECT doc_id, c.intent, coalesce(weight, CASE c.cls WHEN 'Generated' THEN 0.5::DOUBLE ELSE 0 END) AS weight,
round(coalesce(weight, CASE c.cls WHEN 'Generated' THEN 0.5::DOUBLE ELSE 0 END) * CASE WHEN c.cls = 'Test' THEN CASE WHEN c.intent = 'Testing' THEN 1.4::DOUBLE ELSE 0.6::DOUBLE END ELSE 1 END * {_DIRECTORY} * {_AUTHORITY}, 9) AS boost
FROM c LEFT JOIN weights w ON w.intent = c.intent AND w.cls = c.cls""")
def combined_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's factor for each of the nine intents; the request speaks of tests with that intent alone."""
    c = corpus(spark, sf_dir).select("doc_id", "path", paths.file_class(F.col("path")).alias("cls"), F.explode(F.array(*map(F.lit, V.INTENT_WEIGHTS))).alias("intent"))
    request = F.when(F.col("intent") == "Testing", "run the tests").otherwise("run it")
    weight = paths.intent_weight(F.col("intent"), F.col("cls"))
    return c.select("doc_id", "intent", weight.alias("weight"), F.round(paths.combined_boost(F.col("intent"), request, F.col("path"), F.col("cls")), 9).alias("boost"))


@query(f"""WITH t AS ({_TREE}) SELECT repository_id, coalesce(min(path) FILTER (lower(regexp_extract(path, '([^/]*)$', 1)) = 'readme.md'), min(path)) AS path FROM t
GROUP BY 1""")
def canonical_readmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.canonical_readme(_tree(spark, sf_dir))


# --- candidates, places, labels ---------------------------------------------------------------------


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir).select(F.col("repository_id").alias("query_id"), "repository_id", "path", paths.file_class(F.col("path")).alias("file_class"), F.octet_length("content").cast("double").alias("score"))
    return index.top_k(c, ["query_id"], 1 << 30)


@query(f"""{CORPUS}, p AS (SELECT repository_id AS query_id, path, ({_CLASS}) = 'Documentation' AS doc, row_number() OVER (PARTITION BY repository_id ORDER BY strlen(content) DESC, repository_id, path) AS r, count(*) OVER (PARTITION BY repository_id) AS n FROM corpus),
k AS (SELECT *, least(4, n) AS k FROM p), t AS (SELECT *, CASE WHEN r <= k - 2 THEN 'head' WHEN r <= k THEN 'tail' ELSE 'below' END AS part FROM k),
c AS (SELECT *, 2 - count(*) FILTER (doc AND part = 'tail') OVER w AS need, count(*) FILTER (doc AND part = 'head') OVER w AS heads, count(*) FILTER (doc
AND part = 'below') OVER w AS belows, row_number() OVER (PARTITION BY query_id, part, doc ORDER BY r) AS nth FROM t WINDOW w AS (PARTITION BY query_id)),
o AS (SELECT *, least(need, heads) AS a, least(need - least(need, heads), belows) AS b FROM c)
SELECT query_id, path FROM o WHERE CASE WHEN k > 2 THEN (part = 'below' AND doc AND nth <= b) OR (part <> 'below' AND NOT (part = 'tail' AND NOT doc AND nth BETWEEN a + 1 AND a + b)) ELSE part <> 'below' END""")
def docs_reserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.reserve_docs(_ranked(spark, sf_dir), 4).select("query_id", "path")


@query(f"""{CODE}, {_EDGES}, r AS (SELECT repository_id AS query_id, repository_id, path, strlen(content)::DOUBLE AS score, row_number() OVER (PARTITION BY repository_id ORDER BY strlen(content) DESC, repository_id, path) AS rank FROM corpus),
paired AS (SELECT repository_id, src, dst FROM edges UNION SELECT repository_id, dst, src FROM edges), near AS (SELECT DISTINCT b.repository_id, b.dst AS path FROM paired b JOIN r ON r.repository_id = b.repository_id AND r.path = b.src AND rank <= 3)
SELECT r.query_id, r.repository_id, r.path, CASE WHEN n.path IS NOT NULL AND rank > 3 THEN score * 1.2::DOUBLE ELSE score END AS score FROM r LEFT JOIN near n ON n.repository_id = r.repository_id AND n.path = r.path""")
def graph_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = code_corpus(spark, sf_dir)
    rows = c.select(F.col("repository_id").alias("query_id"), "repository_id", "path", F.octet_length("content").cast("double").alias("score"))
    return graph.graph_boost(index.top_k(rows, ["query_id"], 1 << 30), graph.dependencies(c)).drop("rank")


@query("""SELECT event_id, 'a/' || event_id AS path, CASE event_id % 5 WHEN 0 THEN 'index' WHEN 1 THEN 'ast-grep' WHEN 2 THEN 'ripgrep' ELSE 'index' END AS retriever, CASE event_id % 5 WHEN 0 THEN 'bm25' WHEN 1 THEN 'symbol match' WHEN 2 THEN 'text match' WHEN 3 THEN 'code-behind' ELSE 'symbol match' END AS reason
FROM events""")
def provenance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    source = F.when(k == 0, "lexical").when(k == 1, "structural").when(k == 2, "scan").when(k == 3, "code-behind").otherwise("symbols")
    verbatim = F.concat(F.lit("\\\\?\\a/"), F.col("event_id").cast("string"))
    e = table(spark, sf_dir, "events").select("event_id", F.when(k < 2, verbatim).otherwise(F.concat(F.lit("a/"), F.col("event_id").cast("string"))).alias("path"), source.alias("source"))
    return context.labels(e).select("event_id", "path", "retriever", "reason")


@query("""SELECT r_regionkey, 'r_regionkey: ' || r_regionkey || chr(10) || 'r_name: \"' || r_name || '\"' AS block, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS preview
FROM region""")
def preview_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return r.select("r_regionkey", context.yaml_block(["r_regionkey", "r_name"]).alias("block"), context.preview_json(F.struct("r_regionkey", "r_name")).alias("preview"))


@query(f"""{CORPUS}, s AS (SELECT repository_id AS query_id, path, ({_CLASS}) = 'Documentation' AS docs, doc_id, '// ' || path || chr(10) || array_to_string(list_slice(string_split(content, chr(10)), 1, 2), chr(10)) AS text FROM corpus),
p AS (SELECT query_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY doc_id) FILTER (docs), '') AS docs, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY doc_id) FILTER (NOT docs), '') AS code FROM s GROUP BY 1),
o AS (SELECT query_id, 'docs' AS kind, docs AS line, 135 AS budget FROM p UNION ALL SELECT query_id, 'code', code, 165 FROM p), own AS (SELECT *, {_TOK} - 1 AS own FROM o),
l AS (SELECT query_id, kind, budget, unnest(string_split(line, chr(10))) AS line, generate_subscripts(string_split(line, chr(10)), 1) AS n FROM own),
r AS (SELECT *, sum({_TOK}) OVER (PARTITION BY query_id, kind ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM l), k AS (SELECT query_id, kind, coalesce(max(run) FILTER (run <= budget - 5), 0) + 5 AS t FROM r GROUP BY ALL),
u AS (SELECT query_id, kind, CASE WHEN own > budget THEN t ELSE own END::BIGINT AS t FROM own JOIN k USING (query_id, kind))
SELECT query_id, max(t) FILTER (kind = 'docs') AS docs_tokens, max(t) FILTER (kind = 'code') AS code_tokens, greatest(300 - sum(t), 0)::BIGINT AS remaining FROM u GROUP BY 1""")
def context_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack of each repository's first lines, under a budget of 300 tokens."""
    from .sources.corpus import line_range

    c = corpus(spark, sf_dir)
    s = c.select(F.col("repository_id").alias("query_id"), "repository_id", "path", F.col("doc_id").cast("int").alias("rank"), (paths.file_class(F.col("path")) == "Documentation").alias("docs"), F.concat(F.lit("// "), "path", F.lit("\n"), line_range(F.col("content"), 1, 2)).alias("text"))
    return context.pack(s, 300).select("query_id", "docs_tokens", "code_tokens", "remaining")


# --- metrics and states -----------------------------------------------------------------------------


@query("""WITH t AS (SELECT l_suppkey AS id, list(DISTINCT CAST(l_partkey AS VARCHAR)) FILTER (l_returnflag = 'A') AS before, list(DISTINCT CAST(l_partkey AS VARCHAR)) FILTER (l_returnflag = 'N') AS after
FROM lineitem
GROUP BY 1) SELECT id, round((len(list_filter(coalesce(after, []), lambda x: NOT list_contains(coalesce(before, []), x))) - len(list_filter(coalesce(before, []), lambda x: NOT list_contains(coalesce(after, []), x)))) / greatest(len(coalesce(before, [])), 1), 9) AS change
FROM t""")
def recall_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda f: F.collect_set(F.when(F.col("l_returnflag") == f, F.col("l_partkey").cast("string")))
    pairs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(of("A").alias("before"), of("N").alias("after"))
    return metrics.recall_change(pairs).withColumn("change", F.round("change", 9))


@query("""SELECT doc_id AS task_id, round(len(list_filter(['The', 'licensed', 'que', 'zzz'], lambda k: contains(lower(text), lower(k)))) / 4, 9) AS coverage
FROM documents""")
def keyword_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), F.array(*map(F.lit, ["The", "licensed", "que", "zzz"])).alias("keywords"), "text")
    return metrics.keyword_coverage(t).withColumn("coverage", F.round("coverage", 9))


@query("""WITH t AS (SELECT o_custkey AS task_id, list(DISTINCT CAST(l_suppkey AS VARCHAR)) AS expected, list('p' || (l_partkey % 200) || 'x' ORDER BY l_orderkey, l_linenumber, l_partkey) AS retrieved FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
e AS (SELECT task_id, unnest(expected) AS path, retrieved FROM t) SELECT task_id, path, list_position(list_transform(retrieved, lambda r: contains(r, path) OR contains(path, r)), true) AS rank FROM e""")
def ranks_of_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    got = F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("// p"), (x["l_partkey"] % 200).cast("string"), F.lit("x:12")))
    t = o.join(li, o.o_orderkey == li.l_orderkey).groupBy(F.col("o_custkey").alias("task_id")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("expected"), got.alias("retrieved"))
    return metrics.ranks_of_expected(t)


_STATES = "SELECT user_id AS repository_id, event_id AS ts, CASE event_id % 4 WHEN 0 THEN 'started' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'other' END AS kind FROM events"


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("repository_id"), F.col("event_id").alias("ts"), F.when(k == 0, "started").when(k == 1, "completed").when(k == 2, "failed").otherwise("other").alias("kind"))


@query(f"""WITH e AS ({_STATES}), s AS (SELECT *, CASE WHEN kind = 'started' THEN 'indexing' WHEN kind <> 'other' THEN 'ready' END AS state FROM e), o AS (SELECT *, lag(state) OVER (PARTITION BY repository_id ORDER BY ts) AS old FROM s WHERE state IS NOT NULL)
SELECT repository_id, ts AS since, lead(ts) OVER (PARTITION BY repository_id ORDER BY ts) AS until, state FROM o WHERE old IS NULL OR old <> state""")
def readiness_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.readiness(_states(spark, sf_dir))


@query(f"""WITH e AS ({_STATES}) SELECT repository_id, CASE WHEN arg_max(kind, ts) <> 'started' THEN greatest(0, 1000000 - max(ts) FILTER (kind = 'completed')) END AS age
FROM e GROUP BY 1""")
def index_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.index_age(_states(spark, sf_dir), 1_000_000)


@query("SELECT conv_id, turn FROM conversations WHERE role <> 'user'")
def forgotten_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("session_id"))
    return ev.forget_session(c, "user").drop("session_id")
