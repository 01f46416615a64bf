"""The chain measured under several settings on requests made from the benchmark table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import evaluate, request, upkeep
from .queries import _ANALYSE, _VALUES, asked
from .queries_code import _CHAIN, files
from .registry import query
from .sources.corpus import table

SETTINGS = [evaluate.Setting("base"), evaluate.Setting("no expansion", expansion=False), evaluate.Setting("graph", graph=True), evaluate.Setting("pool of 10", pool=10)]
_GOLDEN = f"items AS (SELECT item_id, list_slice({_ANALYSE.format(x='text')}, 3, 10) AS t FROM benchmark), tasks_ AS (SELECT item_id AS query_id, array_to_string(t, ' ') AS query, t FROM items WHERE len(t) = 8)"
_MORE = "len(expanded) > len(tokens) AND len(tokens) > 0"


def _run(s: evaluate.Setting) -> str:
    chain = _CHAIN.replace(f"(VALUES {_VALUES})", "(SELECT query_id, query FROM tasks_)").replace("WHERE intent = 'Debugging' AND", f"WHERE {str(s.graph).lower()} AND")
    if not s.expansion:
        chain = chain.replace(_MORE, "false")
    chain = chain.replace("SELECT n, most, least(1000, greatest(CASE WHEN n > 5000 THEN 200 ELSE 100 END, 4 * most)) AS k FROM size", f"SELECT n, most, {max(s.pool, 0)} AS k FROM size")
    return f"SELECT '{s.name}' AS setting, query_id AS task_id, repository_id, path, rank FROM ({chain} SELECT * FROM final)"


@query(f"""WITH {_GOLDEN}, answers AS ({" UNION ALL ".join(_run(s) for s in SETTINGS)}),
held AS ({_CHAIN.split(", f AS (")[0]} SELECT repository_id, path, {_ANALYSE.format(x="content")} AS t FROM corpus),
place AS (SELECT repository_id, path, unnest(t) AS token, generate_subscripts(t, 1) AS p FROM held), asked AS (SELECT query_id, unnest(t) AS token, generate_subscripts(t, 1) AS j FROM tasks_),
expected AS (SELECT DISTINCT query_id AS task_id, repository_id, path FROM (SELECT query_id, repository_id, path, p - j AS b FROM place JOIN asked USING (token) GROUP BY ALL HAVING count(*) = 8)),
every AS (SELECT query_id AS task_id, setting FROM tasks_, (VALUES {", ".join(f"('{s.name}')" for s in SETTINGS)}) v(setting)),
n AS (SELECT task_id, count(*) AS n FROM expected GROUP BY 1), marked AS (SELECT a.*, e.path IS NOT NULL AS wanted FROM answers a LEFT JOIN expected e USING (task_id, repository_id, path)),
found_ AS (SELECT setting, task_id, count(*) FILTER (wanted AND rank <= 5) AS h5, count(*) FILTER (wanted AND rank <= 10) AS h10, min(CASE WHEN wanted THEN rank END) AS first FROM marked GROUP BY ALL),
lists AS (SELECT setting, task_id, list(repository_id || '/' || path) AS l FROM answers WHERE rank <= 10 GROUP BY ALL),
t AS (SELECT e.setting, e.task_id, CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE coalesce(h5, 0) / n END AS r5, CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE coalesce(h10, 0) / n END AS r10, coalesce(1.0::DOUBLE / first, 0) AS rr,
coalesce(len(list_filter(l.l, lambda x: NOT list_contains(coalesce(o.l, []), x))), 0) AS added, coalesce(len(list_filter(o.l, lambda x: NOT list_contains(coalesce(l.l, []), x))), 0) AS removed, coalesce(len(o.l), 0) AS size
FROM every e LEFT JOIN found_ f USING (setting, task_id) LEFT JOIN n USING (task_id) LEFT JOIN lists l USING (setting, task_id) LEFT JOIN (SELECT task_id, l FROM lists WHERE setting = '{SETTINGS[0].name}') o ON o.task_id = e.task_id)
SELECT setting, count(*) AS tasks, round(avg(r5), 9) AS recall_5, round(avg(r10), 9) AS recall_10, round(avg(rr), 9) AS mrr, round(avg((added - removed) / greatest(size, 1)), 9) AS change, round(avg((added + removed) / greatest(size, 1)), 9) AS turned FROM t GROUP BY setting""")
def golden_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, reciprocal rank and what changes, by setting, over all items of the benchmark."""
    c = files(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id"), "text")
    requests, expected = evaluate.golden(c, items)
    answers = evaluate.runs(c, requests, SETTINGS, stored=upkeep.opened(c, "files"))
    m = evaluate.measure(answers, requests, expected, SETTINGS)
    return m.select("setting", "tasks", *[F.round(x, 9).alias(x) for x in ("recall_5", "recall_10", "mrr", "change", "turned")])


_TOKENS_OF = "greatest(floor(strlen({x}) / 4), floor(len(list_filter(string_split_regex({x}, '[ \\t\\n\\r\\x0B\\f]+'), lambda t: t <> '')) * 1.3))::BIGINT"


@query(f"""{_CHAIN.replace(" AND (SELECT n FROM pool) <= 5000", "")}, ev AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM final), wide AS (SELECT *, CASE WHEN n <= 20 THEN 15 ELSE least(greatest(20 * 23 // n - 3, 6), 20) - greatest(least(greatest(20 * 23 // n - 3, 6), 20) * 5 // 20, 2) END AS under FROM ev),
piece AS (SELECT query_id, rank, file_class = 'Documentation' AS docs, '// ' || path || ':1' || chr(10) || array_to_string(list_slice(string_split(content, chr(10)), 1, 1 + under), chr(10)) AS x FROM wide JOIN corpus USING (repository_id, path)),
packed AS (SELECT query_id, count(*) AS n_files, coalesce(string_agg(x, chr(10) || chr(10) ORDER BY rank) FILTER (docs), '') AS docs, coalesce(string_agg(x, chr(10) || chr(10) ORDER BY rank) FILTER (NOT docs), '') AS code FROM piece GROUP BY query_id)
SELECT query_id::INT AS query_id, coalesce(n_files, 0) AS n_files, coalesce({_TOKENS_OF.format(x='docs')}, 0) AS docs_tokens, coalesce({_TOKENS_OF.format(x='code')}, 0) AS code_tokens,
sha256(CASE WHEN n_files IS NULL THEN query ELSE query || chr(10) || chr(10) || '---' || chr(10) || docs || CASE WHEN docs <> '' AND code <> '' THEN chr(10) || chr(10) ELSE '' END || code END) AS enriched
FROM (SELECT query_id, query FROM q0) LEFT JOIN packed USING (query_id)""")
def request_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the stated requests to their enriched texts, all stages in one plan; the budget holds them whole."""
    c = files(spark, sf_dir)
    r = request.respond(c, asked(spark), budget=10_000_000, stored=upkeep.opened(c, "files"))
    return r.select("query_id", "n_files", "docs_tokens", "code_tokens", F.sha2("enriched", 256).alias("enriched"))
