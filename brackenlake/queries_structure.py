"""Queries on nesting and structure; their SQL reads lines and counts braces and indents by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vocabulary as V
from .operators import graph, store, structure
from .plans import discovery, retrieve, upkeep
from .queries import _VALUES
from .queries_code import _CHAIN, _EDGES, _IMPORTS, CODE, files
from .registry import query
from .sources.code import CODE_SQL, code_corpus

#: One definition a line at most, with its kind; where its braces or its indented block end; the definition around.
_SPANS = rf"""rows_ AS (SELECT repository_id, path, language, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM corpus),
told AS (SELECT *, CASE language
WHEN 'rust' THEN regexp_extract(x, '^ *(?:pub )?(fn|struct|enum|trait|impl|mod) \w', 1) WHEN 'python' THEN regexp_extract(x, '^ *(class|def) \w', 1)
WHEN 'typescript' THEN CASE WHEN regexp_matches(x, '^const \w+ = \(') THEN 'fn' ELSE regexp_extract(x, '^(?:export )?(?:async )?(function|interface) \w', 1) END
ELSE CASE WHEN regexp_matches(x, '^ *(?:public|private) .*\) \{{') THEN 'fn' ELSE regexp_extract(x, '^public (class) \w', 1) END END AS word FROM rows_),
d AS (SELECT *, CASE word WHEN 'fn' THEN 'function' WHEN 'def' THEN 'function' WHEN 'mod' THEN 'module' ELSE word END AS kind,
CASE WHEN language = 'csharp' AND word = 'fn' THEN regexp_extract(x, '(\w+)\(', 1) ELSE regexp_extract(x, '(?:fn|struct|enum|trait|impl|mod|class|def|function|interface|const) (\w+)', 1) END AS name,
length(x) - length(ltrim(x)) AS deep FROM told WHERE word <> ''),
curly AS (SELECT repository_id, path, line, sum(length(x) - length(replace(x, '{{', '')) - length(x) + length(replace(x, '}}', ''))) OVER (PARTITION BY repository_id, path ORDER BY line) AS after, length(x) - length(replace(x, '{{', '')) - length(x) + length(replace(x, '}}', '')) AS own FROM rows_),
closed AS (SELECT d.repository_id, d.path, d.line, min(c.line) AS stop FROM d JOIN curly b USING (repository_id, path, line) JOIN curly c ON c.repository_id = d.repository_id AND c.path = d.path AND c.line >= d.line AND c.after <= b.after - b.own GROUP BY ALL),
inner_ AS (SELECT d.repository_id, d.path, d.line, min(r.line) AS next FROM d JOIN rows_ r ON r.repository_id = d.repository_id AND r.path = d.path AND r.line > d.line AND trim(r.x) <> '' AND length(r.x) - length(ltrim(r.x)) <= d.deep WHERE d.language = 'python' GROUP BY ALL),
dedent AS (SELECT d.repository_id, d.path, d.line, max(r.line) AS stop FROM d LEFT JOIN inner_ i USING (repository_id, path, line) JOIN rows_ r ON r.repository_id = d.repository_id
AND r.path = d.path AND r.line >= d.line AND r.line < coalesce(i.next, 1000000) AND trim(r.x) <> '' WHERE d.language = 'python' GROUP BY ALL),
flat AS (SELECT d.*, CASE WHEN d.language = 'python' THEN p.stop WHEN regexp_matches(d.x, ';$') THEN d.line ELSE c.stop END AS stop FROM d LEFT JOIN closed c USING (repository_id, path, line) LEFT JOIN dedent p USING (repository_id, path, line)),
spans AS (SELECT f.repository_id, f.path, f.language, f.x, f.name, f.kind, f.line, f.stop, arg_max(o.name, o.line) AS parent FROM flat f LEFT JOIN flat o ON o.repository_id = f.repository_id AND o.path = f.path AND o.line < f.line AND o.stop >= f.line GROUP BY ALL)"""
_SCOPED = _SPANS + rf""", named AS (SELECT repository_id, path, line, unnest(regexp_extract_all(x, '\b([A-Za-z_]\w*)\s?\(', 1)) AS callee FROM rows_),
called AS (SELECT DISTINCT n.* FROM named n WHERE length(callee) > 1 AND callee NOT IN {V.sql_list(V.CALL_KEYWORDS)} AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.repository_id = n.repository_id AND s.path = n.path AND s.line = n.line AND s.name = n.callee)),
scoped AS (SELECT c.repository_id, c.path, c.line, c.callee, coalesce(arg_max(s.name, s.line), 'unknown') AS caller FROM called c LEFT JOIN spans s ON s.repository_id = c.repository_id AND s.path = c.path AND s.kind = 'function' AND c.line BETWEEN s.line AND s.stop GROUP BY ALL)"""


@query(f"{CODE}, {_SPANS} SELECT repository_id, path, name, kind, line::INT AS line_start, stop::INT AS line_end, parent FROM spans")
def symbol_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with their lines and what they stand in."""
    return structure.spans(code_corpus(spark, sf_dir))


@query(f"{CODE}, {_SCOPED} SELECT repository_id, path, line::INT AS line, callee, caller FROM scoped")
def scoped_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in their innermost function."""
    return structure.scoped_calls(code_corpus(spark, sf_dir)).distinct()


@query(f"""{CODE}, {_SCOPED}, first AS (SELECT repository_id, name AS callee, min(path) AS callee_path FROM spans WHERE kind = 'function' GROUP BY ALL)
SELECT DISTINCT s.repository_id, s.path AS caller_path, caller, callee_path, callee FROM scoped s JOIN first USING (repository_id, callee)""")
def scoped_call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = code_corpus(spark, sf_dir)
    return structure.call_edges(structure.scoped_calls(c), structure.spans(c))


@query(f"""{CODE}, {_SPANS} SELECT repository_id, path, line::INT AS line, stop::INT AS line_end, name FROM spans
WHERE kind = 'function' AND NOT regexp_matches(x, ';$') AND (language <> 'csharp' OR starts_with(ltrim(x), 'public'))""")
def structural_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of the patterns that the languages have for functions."""
    found = structure.matches(code_corpus(spark, sf_dir), kind="function")
    return found.select("repository_id", "path", "line", "line_end", F.col("captures")["NAME"].alias("name"))


@query(f"""{CODE}, {_SPANS}, all_ AS (SELECT repository_id, path, line, stop, name FROM spans WHERE language = 'rust' AND kind = 'struct' AND x LIKE '%{{' OR language IN ('typescript', 'csharp', 'python') AND kind = 'class' AND NOT contains(x, '('))
SELECT repository_id, path, line::INT AS line, stop::INT AS line_end, name FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, path ORDER BY line) AS n FROM all_) WHERE n = 1""")
def structural_first_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first match of each file of the patterns for classes."""
    found = structure.matches(code_corpus(spark, sf_dir), kind="class", first=True)
    return found.select("repository_id", "path", "line", "line_end", F.col("captures")["NAME"].alias("name"))


ASKED_FOR = {1: "find all function definitions that run", 2: "show all struct and class models", 3: "find all enum types in tests", 4: "where is the guide module"}
_ASKED_FOR = ", ".join(f"({k}, '{v}')" for k, v in ASKED_FOR.items())
_MATCHED = _SPANS.replace("FROM corpus)", "FROM corpus WHERE language IN ('rust', 'python', 'typescript', 'csharp'))", 1)


@query(f"""{_CHAIN.replace(_VALUES, _ASKED_FOR)}, {_MATCHED},
hit AS (SELECT DISTINCT 1 AS query_id, repository_id, path FROM spans WHERE kind = 'function' AND NOT regexp_matches(x, ';$') AND (language <> 'csharp' OR starts_with(ltrim(x), 'public'))
UNION SELECT DISTINCT 2, repository_id, path FROM spans WHERE language = 'rust' AND kind = 'struct' AND x LIKE '%{{' OR language IN ('typescript', 'csharp', 'python') AND kind = 'class' AND NOT contains(x, '(')
UNION SELECT DISTINCT 3, repository_id, path FROM spans WHERE kind = 'enum'),
shaped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY repository_id, path) AS nth FROM hit) WHERE nth <= 500),
text_ AS (SELECT query_id, repository_id, path, score * CASE WHEN query_id <= 3 THEN 0.3::DOUBLE ELSE 1 END AS score FROM answer),
both_ AS (SELECT query_id::INT AS query_id, repository_id, path, greatest(coalesce(t.score, 0.0::DOUBLE), CASE WHEN s.path IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS score FROM text_ t FULL OUTER JOIN shaped s USING (query_id, repository_id, path)),
placed_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, repository_id, path) AS rank FROM both_)
SELECT query_id, repository_id, path, round(score, 4) AS score, rank::INT AS rank FROM placed_ WHERE rank <= (SELECT most FROM pool) + CASE WHEN query_id <= 3 THEN (SELECT most FROM pool) // 2 ELSE 0 END""")
def structural_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the whole chain with its structural branch: three requests that ask for kinds of code, and one that does not."""
    c = files(spark, sf_dir)
    requests = spark.createDataFrame(list(ASKED_FOR.items()), "query_id int, query string")
    r = retrieve.answer(c, requests, stored=upkeep.opened(c, "files"))
    return r.select("query_id", "repository_id", "path", F.round("score", 4).alias("score"), "rank")


# --- graphs ---------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {CODE.removeprefix("WITH ")}, {_EDGES}, start AS (SELECT DISTINCT repository_id, path FROM corpus WHERE regexp_matches(path, '(^|[^0-9])[0-9]$|[^0-9][0-9]\\.')),
reach(repository_id, path) AS (SELECT e.repository_id, e.src FROM edges e JOIN start s ON s.repository_id = e.repository_id AND s.path = e.dst UNION SELECT e.repository_id, e.src FROM edges e JOIN reach r ON r.repository_id = e.repository_id AND r.path = e.dst)
SELECT * FROM reach""")
def import_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files that import files of one-digit numbers, over chains as long as a tenth of the table."""
    c = code_corpus(spark, sf_dir)
    start = c.where(F.col("path").rlike(r"(^|[^0-9])[0-9]$|[^0-9][0-9]\.")).select("repository_id", "path").distinct()
    return graph.impact(graph.dependencies(c), start)


_NUMBER = "regexp_extract(path, '([0-9]+)', 1)::INT"
_CHANGED = f"WITH corpus AS (SELECT repository_id, path, language, CASE WHEN {_NUMBER} % 10 IN (2, 5) THEN replace(replace(content, 'crate::', 'crate::pkg::'), 'import pkg', 'import lib') ELSE content END AS content FROM ({CODE_SQL}) WHERE {_NUMBER} % 10 <> 4)"


@query(f"{_CHANGED}, {_EDGES} SELECT * FROM edges")
def graph_after_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dependency graph brought up to a change: files of some last digits change, go or come; other imports are resolved again only where that touches them."""
    c = code_corpus(spark, sf_dir)
    digit = F.expr("try_cast(regexp_extract(path, '([0-9]+)', 1) as int)") % 10
    before = store.cut(c.where(digit != 7))
    tried = store.cut(graph.candidates(graph.imports(before)))
    resolved = store.cut(graph.chosen(tried, before))
    text = F.replace(F.replace("content", F.lit("crate::"), F.lit("crate::pkg::")), F.lit("import pkg"), F.lit("import lib"))
    changed = c.where(digit.isin(2, 5, 7)).withColumn("content", F.when(digit == 7, F.col("content")).otherwise(text))
    gone = before.where(digit == 4).select("repository_id", "path")
    _, resolved = graph.refresh(tried, resolved, before.select("repository_id", "path"), changed, gone)
    return graph.edges_of(resolved)


@query(f"{CODE}, {_IMPORTS} SELECT * FROM imports WHERE source <> '' UNION SELECT repository_id, path, language, regexp_extract(text, '^using ([A-Za-z.]+);', 1) FROM lines WHERE language = 'csharp' AND regexp_matches(text, '^using [A-Za-z.]+;')")
def token_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports by tokens, over as many lines as they take."""
    return structure.imports(code_corpus(spark, sf_dir))


# --- profiles --------------------------------------------------------------------------------------

#: Manifests made from every fiftieth row's id: name and text by (doc_id div 50) modulo 4.
_MANIFESTS = [
    ("Cargo.toml", "[workspace]"), ("package.json", '{"dependencies": {"react": "1"}, "devDependencies": {"@nestjs/core": "2"}, "scripts": {"build": "tsc", "lint": "x"}}'),
    ("pyproject.toml", "[tool.poetry]"), ("go.mod", "module x"),
]
_MADE = " ".join(f"WHEN {k} THEN '{n}'" for k, (n, _) in enumerate(_MANIFESTS))
_FRAMEWORKS = "(VALUES (0, 0, 'cargo'), (0, 1, 'rust-workspace'), (1, 2, 'node'), (1, 3, 'react'), (1, 8, 'nestjs-core'), (2, 11, 'python'), (2, 12, 'poetry'), (3, 10, 'go-modules'))"
_COMMANDS = "(VALUES (0, 'cargo build', 'cargo test'), (1, 'tsc', 'npm test'), (2, NULL, 'poetry run pytest'), (3, 'go build ./...', 'go test ./...'))"


@query(f"""{CODE}, made AS (SELECT 'r' || (doc_id // 50 % 2) AS repository_id, 'p' || doc_id AS folder, doc_id // 50 % 4 AS k FROM documents WHERE doc_id % 50 = 0),
fw AS (SELECT repository_id, list(framework ORDER BY folder, place) AS l FROM (SELECT repository_id, framework, min(folder) AS folder, arg_min(place, folder) AS place FROM made JOIN {_FRAMEWORKS} f(k, place, framework) USING (k) GROUP BY ALL) GROUP BY 1),
cmd AS (SELECT repository_id, arg_min(build, folder) FILTER (build IS NOT NULL) AS build, arg_min(test, folder) AS test FROM made JOIN {_COMMANDS} c(k, build, test) USING (k) GROUP BY 1),
lang AS (SELECT repository_id, language, count(*) AS n FROM corpus GROUP BY ALL), top AS (SELECT repository_id, string_agg(language || ' ' || n, ',' ORDER BY n DESC, language) AS languages FROM lang GROUP BY 1)
SELECT repository_id, languages, 'lib' AS folders, array_to_string(l, ',') AS frameworks, build, test FROM top JOIN fw USING (repository_id) JOIN cmd USING (repository_id)""")
def repository_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of the code with manifests in some folders."""
    from .sources.corpus import table

    n, k = F.col("doc_id"), F.floor(F.col("doc_id") / 50) % 4
    pick = lambda i: F.element_at(F.array(*[F.lit(m[i]) for m in _MANIFESTS]), (k + 1).cast("int"))
    made = table(spark, sf_dir, "documents").where(n % 50 == 0).select(F.concat(F.lit("r"), F.floor(n / 50) % 2).alias("repository_id"), F.concat(F.lit("p"), n, F.lit("/"), pick(0)).alias("path"), pick(1).alias("content"))
    p = discovery.profile(code_corpus(spark, sf_dir).select("repository_id", "path", "content").unionByName(made))
    shown = F.array_join(F.transform(F.filter("languages", lambda x: ~x["language"].isin("toml", "json")), lambda x: F.concat(x["language"], F.lit(" "), x["n"])), ",")
    return p.select("repository_id", shown.alias("languages"), F.array_join("folders", ",").alias("folders"), F.array_join("frameworks", ",").alias("frameworks"), "build", "test")
