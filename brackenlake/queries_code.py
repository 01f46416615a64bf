"""Queries over a corpus of code: symbols, imports, graphs, structural search, and the whole ranking chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, text
from .functions import vocabulary as V
from .operators import context, graph, index, knowledge, metrics, segments, store
from .operators import symbols as sym
from .plans import retrieve, upkeep
from .queries import _ANALYSE, _CANON, _NAMES, _PATH_TOKENS, _SPLIT, _SYN, _VALUES, ASKED, FIELDS_SQL, asked
from .registry import query
from .sources.code import CODE_SQL, code_corpus
from .sources.corpus import CORPUS_SQL, corpus

CODE = f"WITH corpus AS ({CODE_SQL})"
#: The documents as files, and the code.
ALL = f"WITH corpus AS (SELECT repository_id, path, language, content FROM ({CORPUS_SQL}) UNION ALL {CODE_SQL})"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).drop("doc_id").unionByName(code_corpus(spark, sf_dir))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_LINES = "lines AS (SELECT repository_id, path, language, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM corpus)"
_SYMBOLS = "symbols AS (" + " UNION ".join(
    f"SELECT repository_id, path, unnest(regexp_extract_all(content, {_quoted(p)}, 1)) AS name, '{'function' if k == 'arrow' else k}' AS kind FROM corpus" for k, p in sym.PATTERNS.items()
) + ")"
_IMPORTS = _LINES + r""", t AS (SELECT repository_id, path, language, trim(text) AS x FROM lines),
imports AS (SELECT DISTINCT repository_id, path, language, CASE
WHEN language = 'rust' THEN CASE WHEN regexp_matches(x, '^(?:pub )?mod [A-Za-z0-9_]+\s*;') THEN regexp_extract(x, '^(?:pub )?mod ([A-Za-z0-9_]+)\s*;', 1) ELSE regexp_extract(x, '^(?:pub )?use ([A-Za-z0-9_:]+)', 1) END
WHEN language = 'python' THEN CASE WHEN regexp_matches(x, '^from [A-Za-z0-9_.]+ import') THEN regexp_extract(x, '^from ([A-Za-z0-9_.]+) import', 1) ELSE regexp_extract(x, '^import ([A-Za-z0-9_.]+)', 1) END
WHEN language IN ('typescript', 'javascript', 'tsx', 'jsx') THEN regexp_extract(x, '^(?:import|export)\b.*?["'']([^"'']+)["'']', 1) ELSE '' END AS source FROM t)"""
_ENDINGS = ", ".join(f"('{k}', {i}, '{e}')" for k, v in graph.CANDIDATES.items() for i, e in enumerate(v))
_EDGES = _IMPORTS + rf""", parts AS (SELECT repository_id, path, source, CASE WHEN language IN ('rust', 'python') THEN language ELSE 'script' END AS kind,
CASE language WHEN 'rust' THEN string_split(regexp_replace(source, '^(?:(?:crate|self|super)::)+', ''), '::') WHEN 'python' THEN string_split(source, '.')
ELSE [regexp_replace(source, '^(?:\./)*(?:\.\./)*', '')] END AS parts FROM imports
WHERE source <> '' AND CASE language WHEN 'rust' THEN NOT regexp_matches(source, '^(?:std|core|alloc)(?:::|$)') WHEN 'python' THEN true ELSE regexp_matches(source, '^[./]') END),
tried AS (SELECT repository_id, path, source, kind, parts, unnest(range(1, len(parts) + 1)) AS i FROM parts), endings(kind, k, e) AS (VALUES {_ENDINGS}),
candidates AS (SELECT repository_id, path, source, len(parts) - i AS n, k, replace(e, '{{p}}', array_to_string(list_slice(parts, 1, i), '/')) AS dst FROM tried JOIN endings USING (kind)),
resolved AS (SELECT c.repository_id, c.path, source, arg_min(c.dst, n * 100 + k) AS dst FROM candidates c JOIN (SELECT DISTINCT repository_id, path AS dst FROM corpus) USING (repository_id, dst) GROUP BY ALL),
edges AS (SELECT DISTINCT repository_id, path AS src, dst FROM resolved WHERE path <> dst)"""


# --- symbols and structure -------------------------------------------------------------------------


@query(f"{CODE}, {_SYMBOLS} SELECT * FROM symbols")
def extract_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sym.symbols(code_corpus(spark, sf_dir))


@query(f"""{CODE}, {_SYMBOLS} SELECT * FROM symbols WHERE contains(lower(name), 'run') OR contains(lower(name), 'service')
ORDER BY repository_id, path, name, kind LIMIT 50""")
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 symbols whose name holds a word, a limited lookup."""
    return sym.find(sym.symbols(code_corpus(spark, sf_dir)), ["run", "of", "Service"], 50)


_FN, _ = sym.compile_pattern("fn $NAME($$$ARGS)")


@query(f"""{CODE}, m AS (SELECT repository_id, path, content, regexp_extract(content, {_quoted('(?s)' + _FN)}, 0) AS matched, regexp_extract(content, {_quoted('(?s)' + _FN)}, 1) AS name FROM corpus WHERE language = 'rust')
SELECT repository_id, path, len(string_split(substring(content, 1, position(matched IN content) - 1), chr(10)))::INT AS line, name,
least(1.0::DOUBLE, 0.85::DOUBLE + CASE WHEN length(matched) > 100 THEN 0.1::DOUBLE WHEN length(matched) > 50 THEN 0.05::DOUBLE ELSE 0 END + 0.05::DOUBLE * 4 + 0.05::DOUBLE * 2) AS score FROM m WHERE matched <> ''""")
def structural_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sym.structural(code_corpus(spark, sf_dir).where("language = 'rust'"), "fn $NAME($$$ARGS)")
    return found.select("repository_id", "path", "line", F.col("captures")["NAME"].alias("name"), "score")


_KIND_CASES = " ".join(f"WHEN contains(lower(text), '{w}') THEN '{k}'" for w, k in sym.KIND_WORDS)


@query(f"SELECT conv_id, turn, CASE {_KIND_CASES} END AS kind, " + "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in V.ENUMERATION_WORDS) + ") AS enumerates FROM conversations")
def structural_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    from .sources.corpus import table

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sym.kind_of(t).alias("kind"), text.wants_enumeration(t).alias("enumerates"))


@query(f"""{CODE}, {_SYMBOLS}, few AS (SELECT DISTINCT repository_id, path FROM symbols WHERE kind = 'impl'),
m AS (SELECT repository_id, path, regexp_extract(content, {_quoted('(?s)' + _FN)}, 1) AS name FROM corpus JOIN few USING (repository_id, path)) SELECT * FROM m WHERE name <> ''""")
def structural_in_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = code_corpus(spark, sf_dir)
    few = sym.symbols(c).where("kind = 'impl'")
    found = sym.structural_in(c, few, "fn $NAME($$$ARGS)")
    return found.select("repository_id", "path", F.col("captures")["NAME"].alias("name"))


# --- imports and graphs ----------------------------------------------------------------------------


@query(f"{CODE}, {_IMPORTS} SELECT * FROM imports WHERE source <> ''")
def import_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.imports(code_corpus(spark, sf_dir))


@query(f"{CODE}, {_EDGES} SELECT * FROM resolved")
def import_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = code_corpus(spark, sf_dir)
    return graph.resolve(graph.imports(c), c)


@query(f"{CODE}, {_EDGES} SELECT * FROM edges")
def dependency_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependencies(code_corpus(spark, sf_dir))


@query(f"{CODE}, {_EDGES} SELECT DISTINCT repository_id, dst AS path FROM edges WHERE src LIKE 'web/%'")
def dependencies_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = code_corpus(spark, sf_dir)
    return graph.dependencies_of(graph.dependencies(c), c.where("path like 'web/%'"))


@query(f"""{CODE}, {_EDGES}, n AS (SELECT repository_id, src AS path FROM edges UNION SELECT repository_id, dst
FROM edges) SELECT repository_id, count(*) AS n_files, (SELECT count(*) FROM edges e WHERE e.repository_id = n.repository_id) AS n_edges FROM n
GROUP BY repository_id""")
def graph_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = graph.degrees(graph.dependencies(code_corpus(spark, sf_dir)))
    return d.groupBy("repository_id").agg(F.count("*").alias("n_files"), F.sum("n_out").alias("n_edges"))


_DEFINED = " UNION ALL ".join(f"SELECT repository_id, path, line AS start, regexp_extract(text, {_quoted(p)}, 1) AS name FROM lines" for p in graph.DEFINITIONS)
_FUNCTIONS = _LINES + f""", defined AS (SELECT DISTINCT * FROM ({_DEFINED}) WHERE name <> ''),
braces AS (SELECT repository_id, path, line, unnest(string_split(regexp_replace(text, '[^{{}}]', '', 'g'), '')) AS ch, generate_subscripts(string_split(regexp_replace(text, '[^{{}}]', '', 'g'), ''), 1) AS pos FROM lines WHERE regexp_matches(text, '[{{}}]')),
depth AS (SELECT *, sum(CASE ch WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY repository_id, path ORDER BY line, pos ROWS UNBOUNDED PRECEDING) AS after FROM braces),
base AS (SELECT d.repository_id, d.path, d.start, d.name, coalesce(arg_max(b.after, b.line * 10000 + b.pos), 0) AS base FROM defined d LEFT JOIN depth b ON b.repository_id = d.repository_id AND b.path = d.path AND b.line < d.start GROUP BY ALL),
ends AS (SELECT b.repository_id, b.path, b.start, b.name, min(x.line) AS e FROM base b LEFT JOIN depth x ON x.repository_id = b.repository_id AND x.path = b.path AND x.line >= b.start AND x.ch = '}}' AND x.after = b.base GROUP BY ALL),
functions AS (SELECT repository_id, path, name, start, least(coalesce(e, len(string_split(content, chr(10)))), start + 2000) AS stop FROM ends JOIN corpus USING (repository_id, path))"""
_CALLS = _FUNCTIONS + rf""", names AS (SELECT repository_id, path, line, unnest(regexp_extract_all(text, '\b([A-Za-z_]\w*)\s*\(', 1)) AS callee FROM lines),
calls AS (SELECT DISTINCT n.* FROM names n WHERE length(callee) > 1 AND callee NOT IN {V.sql_list(V.CALL_KEYWORDS)}
AND NOT EXISTS (SELECT 1 FROM defined d WHERE d.repository_id = n.repository_id AND d.path = n.path AND d.start = n.line AND d.name = n.callee)),
inside AS (SELECT c.*, arg_max(f.name, struct_pack(s := f.start, n := f.name)) AS caller FROM calls c JOIN functions f ON f.repository_id = c.repository_id AND f.path = c.path AND c.line BETWEEN f.start AND f.stop GROUP BY ALL),
first AS (SELECT repository_id, name AS callee, min(path) AS callee_path FROM functions GROUP BY ALL),
call_edges AS (SELECT DISTINCT c.repository_id, c.path AS caller_path, coalesce(caller, 'unknown') AS caller, callee_path, callee
FROM calls c LEFT JOIN inside USING (repository_id, path, line, callee) JOIN first USING (repository_id, callee))"""


@query(f"{CODE}, {_FUNCTIONS} SELECT repository_id, path, name, start::INT AS start, stop::INT AS stop FROM functions")
def function_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.definitions(code_corpus(spark, sf_dir)).withColumnRenamed("end", "stop")


@query(f"{CODE}, {_CALLS} SELECT repository_id, path, line::INT AS line, callee FROM calls")
def function_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.calls(code_corpus(spark, sf_dir)).distinct()


def _call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = code_corpus(spark, sf_dir)
    return graph.call_edges(graph.calls(c), graph.definitions(c))


@query(f"{CODE}, {_CALLS} SELECT * FROM call_edges")
def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _call_edges(spark, sf_dir)


@query(f"{CODE}, {_CALLS} SELECT DISTINCT repository_id, caller_path, caller FROM call_edges WHERE callee = 'check_item'")
def callers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.callers_of(_call_edges(spark, sf_dir), "check_item")


@query(f"{CODE}, {_CALLS} SELECT DISTINCT repository_id, callee_path, callee FROM call_edges WHERE caller = 'unknown' OR caller = 'run_20'")
def callees_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _call_edges(spark, sf_dir)
    return graph.callees_of(e, "run_20").unionByName(graph.callees_of(e, "unknown")).distinct()


@query(f"{CODE}, {_FUNCTIONS} SELECT repository_id, path, name, start::INT AS start, stop::INT AS stop FROM functions WHERE path = 'm20.rs'")
def definitions_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.definitions_in(graph.definitions(code_corpus(spark, sf_dir)), "m20.rs").withColumnRenamed("end", "stop")


# --- knowledge of code -----------------------------------------------------------------------------

_ARCHITECTURE = f"""{_SYMBOLS}, a AS (SELECT repository_id, {', '.join(f"bool_or(contains(lower(name), '{w}')) AS {w}" for w in ('controller', 'service', 'repo', 'handler', 'middleware'))} FROM symbols GROUP BY 1),
b AS (SELECT repository_id, {', '.join(f"bool_or(contains(lower(path), '{w}')) AS f_{w}" for w in ('model', 'view', 'controller'))} FROM corpus GROUP BY 1), ab AS (SELECT * FROM a JOIN b USING (repository_id)),
architecture AS (SELECT repository_id, 'controller-service-repository' AS pattern, 0.9::DOUBLE AS confidence FROM ab WHERE controller AND service AND repo UNION ALL SELECT repository_id, 'mvc', 0.85 FROM ab WHERE f_model AND f_view AND f_controller
UNION ALL SELECT repository_id, 'handler', 0.7 FROM ab WHERE handler UNION ALL SELECT repository_id, 'middleware', 0.7 FROM ab WHERE middleware)"""


@query(f"{CODE}, {_ARCHITECTURE} SELECT * FROM architecture")
def architecture_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = code_corpus(spark, sf_dir)
    return knowledge.architecture(sym.symbols(c), c)


@query(f"""{CODE}, {_ARCHITECTURE}, k(term) AS (VALUES {", ".join(f"('{t}')" for t in V.DOMAIN_TERMS)}),
n AS (SELECT repository_id, CASE WHEN contains(name, '_') THEN 'snake_case' WHEN regexp_matches(name, '^[a-z].*[A-Z]') THEN 'camelCase' WHEN regexp_matches(name, '^[A-Z]') THEN 'PascalCase' END AS kind FROM symbols)
SELECT repository_id, 'architecture' AS category, pattern AS key, confidence FROM architecture
UNION ALL SELECT repository_id, 'convention', kind, 0.8 FROM n GROUP BY repository_id, kind HAVING kind IS NOT NULL AND count(*) > 0.5 * (SELECT count(*) FROM symbols s WHERE s.repository_id = n.repository_id)
UNION ALL SELECT repository_id, 'domain', term, least(count(*) / 10, 0.9::DOUBLE) FROM symbols JOIN k ON contains(lower(name), term) GROUP BY ALL HAVING count(*) >= 2""")
def extract_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = code_corpus(spark, sf_dir)
    return knowledge.extract(sym.symbols(c), c)


# --- the whole ranking chain -----------------------------------------------------------------------

_BOOSTS = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in V.FIELD_BOOSTS.items())
_WEIGHTS = ", ".join(f"('{i}', '{c}', {w}::DOUBLE)" for i, ws in V.INTENT_WEIGHTS.items() for c, w in zip(("Documentation", "Config", "Source", "Test"), ws))
_PLAIN = "regexp_replace(query, '[:+\\-()\"~*?\\\\^]', ' ', 'g')"
_BARE = "list_filter(list_transform(list_filter(string_split_regex(" + _PLAIN + r", '\s+'), lambda t: t <> ''), lambda t: regexp_replace(t, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g')), lambda t: strlen(t) >= 2 AND NOT list_contains(" + str(list(V.STOP_WORDS)) + ", lower(t)))"
_ALIASES = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in V.QUERY_ALIASES.items()) + "}"
_SEARCHED = f"flatten(list_transform({_BARE}, lambda t: list_filter({_SPLIT.format(n='t')} || [lower(t)], lambda p: strlen(p) >= 2) || coalesce(({_ALIASES})[lower(t)], [])))"
_TOKENS = f"list_distinct(list_filter(string_split_regex(lower(query), '[^a-z0-9_]+'), lambda t: strlen(t) >= 2 AND NOT list_contains({list(V.STOP_WORDS)}, t)))"
_EXPANDED = f"list_slice(list_sort(list_distinct(tokens || flatten(list_transform(tokens, lambda t: coalesce(({_SYN})[{_CANON}], []))))), 1, 20)"


def _matched(tokens: str) -> str:
    return f"len(list_filter({tokens}, lambda t: len(list_filter(string_split_regex(lower(path), '[^a-z0-9]+'), lambda s: contains(s, t))) > 0))"


_DIRECTORY = """(CASE WHEN regexp_matches(lower(path), '(readme\\.md|contributing\\.md|contributing|claude\\.md|agents\\.md)$') THEN 1.3
WHEN contains(lower(path), '/docs/') OR contains(lower(path), '/.github/') THEN 1.2 WHEN starts_with(lower(path), 'types/') OR contains(lower(path), '/types/') THEN 1.15
WHEN contains(lower(path), 'pnpm-workspace.yaml') OR contains(lower(path), 'lerna.json') OR contains(lower(path), 'nx.json') THEN 1.1 ELSE 1.0 END)::DOUBLE"""
_NAME = "regexp_extract(lower(path), '([^/]*)$', 1)"
_AUTHORITY = f"""(CASE WHEN {_NAME} = 'readme.md' THEN 1.5 WHEN starts_with({_NAME}, 'readme.') AND ends_with({_NAME}, '.md') THEN 1.1 WHEN ends_with(lower(path), 'docs/index.md') THEN 1.3
WHEN (contains(lower(path), '/docs/') OR starts_with(lower(path), 'docs/')) AND ends_with(lower(path), '.md') THEN 1.2
WHEN (contains(lower(path), '/.github/') OR starts_with(lower(path), '.github/')) AND ends_with(lower(path), '.md') THEN 1.1
WHEN NOT contains(path, '/') AND ends_with(lower(path), '.md') THEN 1.2 ELSE 1.0 END)::DOUBLE"""
_CLASS = paths.file_class_sql("path")
_CHAIN = f"""{ALL}, {FIELDS_SQL}, {_EDGES}, {_SYMBOLS},
q0(query_id, query) AS (VALUES {_VALUES}), q1 AS (SELECT query_id, query, {_TOKENS} AS tokens, {text.intent_sql('lower(query)')} AS intent FROM q0), q2 AS (SELECT *, {_EXPANDED} AS expanded FROM q1),
q AS (SELECT *, len(expanded) > len(tokens) AND len(tokens) > 0 AS more, len(list_intersect(string_split_regex(lower(query), '[^a-z0-9]+'), {list(V.TEST_TERMS)})) > 0 AS about_tests,
CASE WHEN len(expanded) > len(tokens) AND len(tokens) > 0 THEN expanded ELSE list_filter(string_split_regex(lower(query), '[^a-z0-9_]+'), lambda t: t <> '') END AS words FROM q2),
size AS (SELECT count(*) AS n, CASE WHEN count(*) <= 500 OR count(*) > 5000 THEN 50 ELSE 20 END AS most FROM corpus),
pool AS (SELECT n, most, least(1000, greatest(CASE WHEN n > 5000 THEN 200 ELSE 100 END, 4 * most)) AS k FROM size),
qt AS (SELECT DISTINCT query_id, 0 AS variant, unnest({_ANALYSE.format(x=f"array_to_string({_SEARCHED}, ' ')")}) AS term FROM q UNION SELECT DISTINCT query_id, 1, unnest({_ANALYSE.format(x="array_to_string(expanded, ' ')")}) FROM q WHERE more),
st AS (SELECT field, count(*) AS n, sum(len(terms)) / count(*) AS al FROM f GROUP BY field), u AS (SELECT repository_id, path, field, len(terms) AS len, unnest(terms) AS term FROM f),
tf AS (SELECT repository_id, path, field, len, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL), b(field, boost) AS (VALUES {_BOOSTS}),
s AS (SELECT query_id, variant, repository_id, path, sum(boost * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / al)))) AS score
FROM tf JOIN df USING (field, term) JOIN st USING (field) JOIN b USING (field) JOIN qt USING (term) GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY round(score, 9) DESC, repository_id, path) AS r FROM s) WHERE r <= (SELECT k FROM pool)),
classed AS (SELECT h.*, {_CLASS} AS cls, about_tests FROM hits h JOIN q USING (query_id)),
weighed AS (SELECT *, {paths.class_boost_sql('cls')}::DOUBLE AS w FROM classed),
scored AS (SELECT query_id, variant, repository_id, path, score * w * CASE WHEN cls <> 'Test' THEN 1.0::DOUBLE WHEN about_tests THEN 1.4::DOUBLE ELSE 0.6::DOUBLE END * {_DIRECTORY} AS score FROM weighed WHERE w > 0 AND strlen(path) >= 5),
own AS (SELECT * FROM scored WHERE variant = 0), full_ AS (SELECT query_id FROM own GROUP BY 1 HAVING count(*) >= (SELECT most FROM pool)),
lexical AS (SELECT query_id, repository_id, path, score, 'lexical' AS source FROM own UNION ALL SELECT query_id, repository_id, path, score * 0.5::DOUBLE, 'expanded' FROM scored s WHERE variant = 1 AND query_id NOT IN (SELECT query_id FROM full_)
AND NOT EXISTS (SELECT 1 FROM own o WHERE o.query_id = s.query_id AND o.repository_id = s.repository_id AND o.path = s.path)),
boosted AS (SELECT l.query_id, repository_id, path, score * (1 + 1.5::DOUBLE * {_matched('tl')} / greatest(len(tl), 1)) AS score, source FROM (SELECT l.*, CASE WHEN more THEN expanded ELSE tokens END AS tl FROM lexical l JOIN q USING (query_id)) l),
sw AS (SELECT query_id, list_slice(list_filter(words, lambda w: strlen(w) >= 3), 1, 6) AS six FROM q),
sh AS (SELECT query_id, repository_id, path, row_number() OVER (PARTITION BY query_id ORDER BY repository_id, path, name, kind) AS r FROM symbols JOIN sw ON len(list_filter(six, lambda w: contains(lower(name), lower(w)))) > 0),
found AS (SELECT * FROM boosted UNION ALL SELECT DISTINCT query_id, repository_id, path, 1.0::DOUBLE, 'symbols' FROM sh WHERE r <= 2 * (SELECT most FROM pool)),
merged AS (SELECT query_id, repository_id, path, max(score) AS score, arg_max(source, struct_pack(a := score, b := source)) AS source FROM found GROUP BY ALL),
behind AS (SELECT m.query_id, m.repository_id, m.path || '.cs' AS path, m.score * 0.8::DOUBLE AS score, 'code-behind' AS source FROM merged m JOIN (SELECT DISTINCT repository_id, path FROM corpus) c ON c.repository_id = m.repository_id AND c.path = m.path || '.cs'
WHERE (m.path LIKE '%.cshtml' OR m.path LIKE '%.razor') AND NOT EXISTS (SELECT 1 FROM merged o WHERE o.query_id = m.query_id AND o.repository_id = m.repository_id AND o.path = m.path || '.cs')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, repository_id, path) AS r FROM (SELECT * FROM merged UNION ALL SELECT * FROM behind)),
paired AS (SELECT repository_id, src, dst FROM edges UNION SELECT repository_id, dst, src FROM edges),
near AS (SELECT DISTINCT query_id, b.repository_id, b.dst AS path FROM paired b JOIN ranked a ON a.repository_id = b.repository_id AND a.path = b.src AND a.r <= 3 JOIN q USING (query_id) WHERE intent = 'Debugging' AND (SELECT n FROM pool) <= 5000),
raised AS (SELECT r.query_id, r.repository_id, r.path, CASE WHEN n.path IS NOT NULL AND r.r > 3 THEN r.score * 1.2::DOUBLE ELSE r.score END AS score, source FROM ranked r LEFT JOIN near n ON n.query_id = r.query_id AND n.repository_id = r.repository_id AND n.path = r.path),
weights(intent, cls, weight) AS (VALUES {_WEIGHTS}), joined AS (SELECT r.*, {_CLASS} AS cls, tokens, intent, more FROM raised r JOIN q USING (query_id)),
delta AS (SELECT j.*, coalesce(weight, CASE cls WHEN 'Generated' THEN 0.5::DOUBLE ELSE 0 END) / CASE WHEN {paths.class_boost_sql('cls')} = 0 THEN 1.0::DOUBLE ELSE {paths.class_boost_sql('cls')}::DOUBLE END AS d
FROM (SELECT j.*, w.weight FROM joined j LEFT JOIN weights w ON w.intent = j.intent AND w.cls = j.cls) j),
adjusted AS (SELECT query_id, repository_id, path, cls, source, score * CASE WHEN abs(d - 1) > 0.01 THEN d ELSE 1 END * {_AUTHORITY} * CASE WHEN more THEN 1.05::DOUBLE ELSE 1 END
* CASE WHEN cls = 'Documentation' AND len(tokens) > 0 AND {_matched('tokens')} = 0 THEN 0.1::DOUBLE ELSE 1 END AS score FROM delta),
again AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, repository_id, path) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM adjusted),
placed AS (SELECT *, least((SELECT most FROM pool), n) AS k, cls = 'Documentation' AS doc FROM again), parted AS (SELECT *, CASE WHEN r <= k - 2 THEN 'head' WHEN r <= k THEN 'tail' ELSE 'below' END AS part FROM placed),
counted AS (SELECT *, 2 - count(*) FILTER (doc AND part = 'tail') OVER w AS need, count(*) FILTER (doc AND part = 'head') OVER w AS heads, count(*) FILTER (doc
AND part = 'below') OVER w AS belows, row_number() OVER (PARTITION BY query_id, part, doc ORDER BY r) AS nth FROM parted WINDOW w AS (PARTITION BY query_id)),
kept AS (SELECT *, least(need, heads) AS own_, least(need - least(need, heads), belows) AS in_ FROM counted),
answer AS (SELECT query_id, repository_id, path, cls, source, score * 1000::DOUBLE AS score FROM kept WHERE CASE WHEN k > 2 THEN (part = 'below' AND doc AND nth <= in_) OR (part <> 'below' AND NOT (part = 'tail' AND NOT doc AND nth BETWEEN own_ + 1 AND own_ + in_)) ELSE part <> 'below' END),
final AS (SELECT query_id::INT AS query_id, repository_id, path, cls AS file_class, round(score, 4) AS score, source, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, repository_id, path)::INT AS rank FROM answer)"""  # fmt: skip


@query(f"{_CHAIN} SELECT * FROM final")
def ranked_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of the stated queries over documents and code: every stage of the chain in one plan."""
    c = files(spark, sf_dir)
    r = retrieve.rank(c, asked(spark), stored=upkeep.opened(c, "files"))
    return r.select("query_id", "repository_id", "path", "file_class", F.round("score", 4).alias("score"), "source", "rank")


@query(f"{_CHAIN} SELECT query_id::INT AS query_id, repository_id, path, round(score, 6) AS score, source FROM boosted")
def lexical_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, gap fill and path boost of the chain."""
    from .plans import planner

    stored = upkeep.opened(files(spark, sf_dir), "files")
    most = planner.max_files(stored.n_files)
    found = retrieve.lexical(None, retrieve.prepare(asked(spark)), most, planner.candidates(stored.n_files, most), stored)
    return found.withColumn("score", F.round("score", 6))


@query(f"""{_CHAIN} SELECT DISTINCT query_id::INT AS query_id, repository_id, path, 1.0::DOUBLE AS score, 'symbols' AS source FROM sh WHERE r <= 2 * (SELECT most
FROM pool)""")
def symbol_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans import planner

    c = files(spark, sf_dir)
    return retrieve.by_symbols(c, retrieve.prepare(asked(spark)), planner.max_files(c.count()))


@query(f"""{ALL}, {FIELDS_SQL}, q(query_id, query) AS (VALUES {_VALUES}), qt AS (SELECT DISTINCT query_id, unnest({_ANALYSE.format(x=f"array_to_string({_SEARCHED}, ' ')")}) AS term FROM q),
st AS (SELECT field, count(*) AS n, sum(len(terms)) / count(*) AS al FROM f GROUP BY field), u AS (SELECT repository_id, path, field, len(terms) AS len, unnest(terms) AS term FROM f),
tf AS (SELECT repository_id, path, field, len, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL), b(field, boost) AS (VALUES {_BOOSTS}),
s AS (SELECT query_id, repository_id, path, sum(boost * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / al)))) AS score
FROM tf JOIN df USING (field, term) JOIN st USING (field) JOIN b USING (field) JOIN qt USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, repository_id, path) AS rank FROM s) SELECT query_id::INT AS query_id, repository_id, path, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 50""")
def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is written, and a search reads the buckets of its terms."""
    import uuid

    at = f"{store.shared_dir(spark)}/index/{uuid.uuid4().hex}"
    index.store(files(spark, sf_dir), at)
    terms = retrieve.prepare(asked(spark)).select("query_id", F.explode("terms").alias("term"))
    return index.search(spark, at, terms).select("query_id", "repository_id", "path", F.round("score", 6).alias("score"), "rank")


#: The fields with their terms at their places: distinct parts of a path in order, names sorted.
_RAW_TOKENS = _PATH_TOKENS.removeprefix("list_distinct")
_PLACED_SQL = FIELDS_SQL.replace(_PATH_TOKENS, f"list_filter({_RAW_TOKENS}, lambda e, i: list_position({_RAW_TOKENS}, e) = i)").replace(_NAMES, f"list_sort({_NAMES})")
#: Requests with terms of several tokens; they stand in files of the code corpus by the table's rows.
_PHRASED = "SELECT 2 * doc_id AS query_id, 'load_' || doc_id AS term FROM documents WHERE doc_id % 20 = 4 UNION ALL SELECT 2 * doc_id, 'Home' || doc_id || 'Controller.cs' FROM documents WHERE doc_id % 20 = 8 UNION ALL SELECT 2 * doc_id, 'web/c' || doc_id || '.ts' FROM documents WHERE doc_id % 20 = 6 UNION ALL SELECT 2 * doc_id, 'return' FROM documents WHERE doc_id % 20 IN (4, 6, 8)"


@query(f"""{ALL}, {_PLACED_SQL}, asked AS (SELECT query_id, term, {_ANALYSE.format(x="term")} AS tokens FROM ({_PHRASED})),
tok AS (SELECT DISTINCT term, len(tokens) AS m, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS j FROM asked),
pos AS (SELECT repository_id, path, field, len(terms) AS len, unnest(terms) AS token, generate_subscripts(terms, 1) AS place FROM f),
st AS (SELECT field, count(*) AS n, sum(len(terms)) / count(*) AS al FROM f GROUP BY field), df AS (SELECT field, token, count(DISTINCT repository_id || '/' || path) AS df FROM pos GROUP BY ALL),
begun AS (SELECT repository_id, path, field, len, term, m, place - j AS begins FROM pos JOIN tok USING (token) GROUP BY ALL HAVING count(*) = m),
tf AS (SELECT repository_id, path, field, len, term, count(*) AS tf FROM begun GROUP BY ALL),
idf AS (SELECT term, field, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) AS idf FROM tok JOIN df USING (token) JOIN st USING (field) GROUP BY ALL),
b(field, boost) AS (VALUES {_BOOSTS}),
s AS (SELECT query_id, repository_id, path, sum(boost * idf * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / al)))) AS score FROM asked JOIN tf USING (term) JOIN idf USING (term, field) JOIN st USING (field) JOIN b USING (field) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, repository_id, path) AS rank FROM s)
SELECT query_id, repository_id, path, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10""")
def phrase_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made from every twentieth rows' ids, whose terms of several tokens score as phrases from the stored index."""
    from .sources.corpus import table

    n = F.col("doc_id")
    term = F.when(n % 20 == 4, F.concat(F.lit("load_"), n)).when(n % 20 == 8, F.concat(F.lit("Home"), n, F.lit("Controller.cs"))).when(n % 20 == 6, F.concat(F.lit("web/c"), n, F.lit(".ts")))
    asked_ = table(spark, sf_dir, "documents").where((n % 20).isin(4, 6, 8)).select((2 * n).alias("query_id"), F.explode(F.array(term, F.lit("return"))).alias("term"))
    clauses = asked_.select("query_id", text.analyse(F.col("term")).alias("tokens"))
    found = segments.search(upkeep.opened(files(spark, sf_dir), "files"), clauses, 10)
    return found.select("query_id", "repository_id", "path", F.round("score", 6).alias("score"), "rank")


# --- context of an answer --------------------------------------------------------------------------


@query(f"""{CODE}, e AS (SELECT 1 AS query_id, repository_id, path, content, row_number() OVER (ORDER BY repository_id, path) AS rank FROM corpus WHERE path LIKE 'm%.rs' ORDER BY repository_id, path LIMIT 30)
SELECT query_id, repository_id, path, rank::INT AS rank, ({_CLASS}) = 'Documentation' AS docs, '// ' || path || ':6' || chr(10) || array_to_string(list_slice(string_split(content, chr(10)), 3, 6 + least(greatest(floor(20 * 23 / 30)::INT - 3, 6), 20) - greatest(floor(least(greatest(floor(20 * 23 / 30)::INT - 3, 6), 20) * 5 / 20)::INT, 2)), chr(10)) AS text
FROM (SELECT * FROM e)""")
def evidence_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows around line 6 of thirty files, which narrows them."""
    c = code_corpus(spark, sf_dir)
    some = c.where("path like 'm%.rs'").select(F.lit(1).alias("query_id"), "repository_id", "path").orderBy("repository_id", "path").limit(30)
    e = index.top_k(some.withColumn("score", F.lit(1.0)), ["query_id"], 30).withColumn("line", F.lit(6))
    return context.snippets(e, c, 15)


@query(f"""{CODE}, {_EDGES}, {_SYMBOLS}, tasks_(task_id, tokens) AS (VALUES (1, ['run', 'order']), (2, ['handle', 'service', 'missing', 'words', 'here', 'again']), (3, ['nowhere'])),
x AS (SELECT task_id, tokens, repository_id, path, content, contains(path, 'inner') AS hit FROM tasks_, corpus),
gone AS (SELECT task_id, tokens, 'r0' AS repository_id, 'absent.rs' AS path, NULL AS content, false AS hit FROM tasks_), every AS (SELECT * FROM x UNION ALL SELECT * FROM gone),
paired AS (SELECT repository_id, src AS path, dst AS other FROM edges UNION SELECT repository_id, dst, src FROM edges), near AS (SELECT DISTINCT task_id, b.repository_id, b.path FROM paired b JOIN x ON x.repository_id = b.repository_id AND x.path = b.other AND x.hit),
n AS (SELECT e.*, len(list_filter(tokens, lambda k: contains(lower(content), k) OR contains(lower(regexp_extract(e.path, '([^/]*)$', 1)), k))) AS hits, near.path IS NOT NULL AS near,
EXISTS (SELECT 1 FROM symbols s WHERE s.repository_id = e.repository_id AND s.path = e.path AND len(list_filter(tokens, lambda k: contains(lower(s.name), k))) > 0) AS sym FROM every e LEFT JOIN near ON near.task_id = e.task_id AND near.repository_id = e.repository_id AND near.path = e.path)
SELECT CASE WHEN hit THEN 'Hit' WHEN content IS NULL OR content = '' THEN 'NotIndexed' WHEN hits = 0
AND near THEN 'GraphMiss' WHEN hits = 0 THEN 'LexicalMiss' WHEN sym THEN 'SymbolMiss' WHEN hits < len(tokens) // 2 THEN 'QueryExpansionMiss' ELSE 'RankedTooLow' END AS miss, count(*) AS n
FROM n GROUP BY 1""")
def miss_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tasks that expect every file and one that is not there, of which some were found."""
    c = code_corpus(spark, sf_dir)
    tasks = spark.createDataFrame([(1, ["run", "order"]), (2, ["handle", "service", "missing", "words", "here", "again"]), (3, ["nowhere"])], "task_id int, tokens array<string>")
    absent = tasks.select("task_id", "tokens", F.lit("r0").alias("repository_id"), F.lit("absent.rs").alias("path"), F.lit(None).cast("int").alias("rank"))
    rank = F.when(F.contains("path", F.lit("inner")), 1)
    each = c.select(F.explode(F.array(*[F.struct(F.lit(k).alias("task_id"), F.array(*map(F.lit, w)).alias("tokens")) for k, w in ((r[0], r[1]) for r in tasks.collect())])).alias("t"), "repository_id", "path", rank.alias("rank"))
    expected = each.select("t.task_id", "t.tokens", "repository_id", "path", "rank").unionByName(absent)
    found = expected.where("rank is not null").select("task_id", "repository_id", "path")
    return metrics.miss_counts(metrics.misses(expected, c, sym.symbols(c), graph.dependencies(c), found))
