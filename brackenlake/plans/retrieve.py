"""The ranking chain as one composed plan over a batch of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths, text
from ..functions import vocabulary as V
from ..operators import graph, index, segments, store, structure, symbols
from . import planner

FILE = ["repository_id", "path"]
KEY = ["query_id", *FILE]


def batch(q: DataFrame) -> DataFrame:
    """A batch of requests, computed once; a counted small one goes to the tasks that join it."""
    return store.sent(store.cut(q))


def terms(queries: DataFrame) -> DataFrame:
    """(query_id, term) of queries (query_id, query): tokens without stop words."""
    return queries.select("query_id", F.explode(text.query_tokens(F.col("query"))).alias("term"))


def plain_words(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), "[^a-z0-9_]+"), lambda t: t != "")


def prepare(queries: DataFrame) -> DataFrame:
    """(query_id, query, tokens, expanded, more, intent, terms, words) of queries (query_id, query).

    terms are those of the search, analysed as the fields are; expanded has synonyms too, more tells
    if they add any; words are what symbols' names are tried with.
    """
    q = queries.select("query_id", "query", text.query_tokens(F.col("query")).alias("tokens"), text.intent(F.col("query")).alias("intent"))
    q = q.withColumn("expanded", text.expand(F.col("tokens"))).withColumn("more", (F.size("tokens") > 0) & (F.size("expanded") > F.size("tokens")))
    analysed = lambda x: F.array_distinct(text.analyse(F.array_join(x, " ")))
    return q.select(
        "query_id", "query", "tokens", "expanded", "more", "intent",
        analysed(text.search_terms(F.col("query"))).alias("terms"),
        analysed(F.col("expanded")).alias("more_terms"),
        F.when(F.col("more"), F.col("expanded")).otherwise(plain_words(F.col("query"))).alias("words"),
    )


def _by_class(hits: DataFrame, q: DataFrame) -> DataFrame:
    """Hits with their file class, times class, test and directory factors; classes of no weight go."""
    j = hits.join(q.select("query_id", "query"), "query_id").withColumn("file_class", paths.file_class(F.col("path")))
    cls = F.col("file_class")
    j = j.withColumn("score", F.col("score") * paths.class_boost(cls) * paths.test_multiplier(F.col("query"), cls) * paths.directory_boost(F.col("path")))
    return j.where((paths.class_boost(cls) > 0) & paths.valid_path(F.col("path"))).drop("query")


def _path_boost(tokens: Column, path: Column) -> Column:
    return 1 + V.SYMBOL_WEIGHT * paths.segment_matches(tokens, path) / F.greatest(F.size(tokens), F.lit(1))


def _ranked(rows: DataFrame) -> DataFrame:
    return index.top_k(rows, ["query_id"], 1 << 30)


def phrases(q: DataFrame) -> DataFrame:
    """(query_id, tokens) of prepared queries: a clause for each search term; a term of several tokens is a phrase."""
    found = F.transform(text.search_terms(F.col("query")), text.analyse)
    return q.select("query_id", F.explode(F.array_distinct(F.filter(found, lambda t: F.size(t) > 0))).alias("tokens"))


def lexical(corpus: DataFrame | None, q: DataFrame, most: int, pool: int, stored: segments.Snapshot | None = None) -> DataFrame:
    """(query_id, repository_id, path, score, source) by text: the search's own hits, and where they are fewer than `most` those of the expanded terms, damped.

    Both searches are one pass: a query's two lists of terms are two queries of one batch. With a
    stored index its postings are read, else the corpus is analysed.
    """
    lists = F.array(F.struct(F.lit(0).alias("variant"), F.col("terms").alias("t")), F.struct(F.lit(1).alias("variant"), F.when(F.col("more"), F.col("more_terms")).alias("t")))
    asked = q.select("query_id", F.explode(lists).alias("v")).select(F.struct("query_id", "v.variant").alias("query_id"), F.explode("v.t").alias("term"))
    found = index.bm25(corpus, asked, pool) if stored is None else segments.search(stored, segments.clauses_of(asked), pool)
    if "pool" in q.columns:  # queries with pools of their own, of `pool` at most
        own = q.select(F.col("query_id").alias("asked"), F.col("pool").alias("its_pool"))
        found = found.join(own, F.col("query_id.query_id") == F.col("asked")).where("rank <= its_pool").drop("asked", "its_pool")
    hits = found.drop("rank").select("query_id.query_id", "query_id.variant", *FILE, "score")
    scored = store.cut(_by_class(hits, q))  # a bounded number of rows a query
    own = scored.where("variant = 0").select(*KEY, "score", F.lit("lexical").alias("source"))
    few = own.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= most).select("query_id")
    more = scored.where("variant = 1").join(few, "query_id", "left_anti").select(*KEY, "score", F.lit("expanded").alias("source"))
    found = index.gap_fill(own, more)
    tokens = q.select("query_id", F.when(F.col("more"), F.col("expanded")).otherwise(F.col("tokens")).alias("t"))
    boosted = found.join(tokens, "query_id").withColumn("score", F.col("score") * _path_boost(F.col("t"), F.col("path")))
    return boosted.drop("t")


def by_symbols(corpus: DataFrame, q: DataFrame, most: int) -> DataFrame:
    """(query_id, repository_id, path, score, source) of files with a symbol whose name holds a word, all alike."""
    hit = symbols.find_each(symbols.symbols(corpus), q.select("query_id", "words"), 2 * most)
    return hit.select(*KEY).distinct().withColumn("score", F.lit(1.0)).withColumn("source", F.lit("symbols"))


def with_graph(rows: DataFrame, corpus: DataFrame, q: DataFrame, n_files: int, graph_files: int | None = planner.GRAPH_FILES) -> DataFrame:
    """Scores raised for files beside a query's first three, for queries whose plan asks for it.

    Edges join files of one query's rows, so of the graph the imports of those files are resolved,
    against all files. With graph_files a corpus of more files has its rows as they are; None raises
    them whatever its size.
    """
    wanted = [i for i in V.INTENT_WEIGHTS if planner.plan(i).graph]
    of = q.where(F.col("graph") if "graph" in q.columns else F.col("intent").isin(wanted)).select("query_id")
    many = rows.groupBy("query_id").agg(F.count("*").alias("hits")).where(F.col("hits") >= 2).select("query_id")
    of = store.cut(of.join(many, "query_id", "left_semi"))  # queries of fewer hits have no gate to pass
    if not planner.graph_allowed(True, 2, n_files, n_files, graph_files) or of.isEmpty():
        return rows
    r = store.cut(_ranked(rows.join(of, "query_id", "left_semi")))
    edges = store.cut(graph.dependencies_from(corpus, r))
    return graph.graph_boost(r, edges).drop("rank").unionByName(rows.join(of, "query_id", "left_anti"))


def adjusted(rows: DataFrame, q: DataFrame) -> DataFrame:
    """Rows times what their class weighs for the intent against its common weight, authority, expansion, and the damping of documentation that no token's path names."""
    j = rows.join(q.select("query_id", "tokens", "intent", "more"), "query_id").withColumn("file_class", paths.file_class(F.col("path")))
    cls, path = F.col("file_class"), F.col("path")
    base = paths.class_boost(cls)
    delta = paths.intent_weight(F.col("intent"), cls) / F.when(base == 0, 1.0).otherwise(base)
    generic = (cls == "Documentation") & (F.size("tokens") > 0) & (paths.segment_matches(F.col("tokens"), path) == 0)
    score = F.col("score") * F.when(F.abs(delta - 1) > 0.01, delta).otherwise(1.0) * paths.authority_boost(path) * F.when(F.col("more"), V.EXPANDED_BOOST).otherwise(1.0) * F.when(generic, V.DAMPING).otherwise(1.0)
    return j.withColumn("score", score).select(*KEY, "file_class", "score", "source")


def rank(corpus: DataFrame, queries: DataFrame, most: int | None = None, wanted: int | None = None, stored: segments.Snapshot | None = None, graph_files: int | None = planner.GRAPH_FILES) -> DataFrame:
    """(query_id, repository_id, path, file_class, score, source, rank): the files of each query's answer.

    Search and gap fill, symbols, the greater score of each file, files behind views, graph, intent
    and authority, damping, places for documentation among the first `most`, then by score again.
    How many files and candidates there are is decided from the number of files unless given. With
    a stored index of the corpus its postings are searched and its files counted. Edges count up to
    graph_files files, or always if that is None.
    """
    return rank_prepared(corpus, prepare(queries), most, wanted, stored, graph_files)


def rank_prepared(corpus: DataFrame, q: DataFrame, most: int | None = None, wanted: int | None = None, stored: segments.Snapshot | None = None, graph_files: int | None = planner.GRAPH_FILES) -> DataFrame:
    """rank() of prepared queries, which may have columns of their own: graph (whether edges count) and pool (candidates)."""
    n = corpus.count() if stored is None else stored.n_files
    most, q = planner.max_files(n, most), batch(q)
    found = store.cut(index.merge_max(lexical(corpus, q, most, planner.candidates(n, most, wanted), stored), by_symbols(corpus, q, most)))
    behind = index.code_behind(found.select(*KEY, "score"), corpus).withColumn("source", F.lit("code-behind"))
    found = store.cut(found.select(*KEY, "score", "source").unionByName(behind.select(*KEY, "score", "source")))
    found = adjusted(with_graph(found, corpus, q, n, graph_files), q)
    kept = index.reserve_docs(_ranked(store.cut(found)), most)
    scaled = kept.drop("rank").withColumn("score", F.col("score") * V.SCORE_SCALE)
    return _ranked(scaled)


def by_structure(corpus: DataFrame, q: DataFrame, most: int, candidates: DataFrame | None = None) -> DataFrame:
    """(query_id, repository_id, path, line, score) of files with a match of the patterns for what a structural request asks for.

    A request's words tell the kind, a file's language the patterns; test files stay out of requests
    that are not about tests. A request gets files by name until twice `most`, or 500 if it asks for
    all. With candidates (repository_id, path) only those files are read.
    """
    limit = F.when(text.any_of(F.lower("query"), *planner.EXHAUSTIVE_WORDS), planner.EXHAUSTIVE[1]).otherwise(planner.structural_stop(most))
    kind = structure.kind_column(symbols.kind_of(F.col("query")))
    asked = store.cut(q.where("intent = 'Structural'").select("query_id", "query", kind.alias("kind"), limit.alias("limit")).where("kind is not null"))
    files = corpus if candidates is None else corpus.join(candidates.select(*FILE).distinct(), FILE, "left_semi")
    kinds = [r[0] for r in asked.select("kind").distinct().collect()]  # as many as there are kinds
    if not kinds:
        return asked.select("query_id", F.lit("").alias("repository_id"), F.lit("").alias("path"), F.lit(1).alias("line"), F.lit(0.0).alias("score")).limit(0)
    hits = None
    for k in kinds:
        some = structure.matches(files, kind=k, first=True).select(*FILE, "line", "score", F.lit(k).alias("kind"))
        hits = some if hits is None else hits.unionByName(some)
    tests = paths.file_class(F.col("path")) == "Test"
    found = hits.join(asked, "kind").where(~tests | text.is_test_query(F.col("query")))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(*FILE))
    return found.withColumn("nth", nth).where("nth <= limit").select(*KEY, "line", "score")


def answer(corpus: DataFrame, queries: DataFrame, most: int | None = None, wanted: int | None = None, stored: segments.Snapshot | None = None, structural_in: DataFrame | None = None, graph_files: int | None = planner.GRAPH_FILES) -> DataFrame:
    """(query_id, repository_id, path, file_class, score, rank, line): rank() and, for structural requests, the files whose code matches, each weighted by the request's plan; the greater one counts. line is that of the match, else 1."""
    n = corpus.count() if stored is None else stored.n_files
    pinned, most = most, planner.max_files(n, most)
    q = prepare(queries)
    text_ = rank(corpus, queries, pinned, wanted, stored, graph_files)
    shaped = store.cut(by_structure(corpus, q, most, structural_in))
    both = shaped.select("query_id").distinct().withColumn("both", F.lit(True))
    weigh = planner.plan("Structural", True)
    mine = text_.join(both, "query_id", "left").withColumn("score", F.when(F.col("both"), F.col("score") * weigh.lexical_weight).otherwise(F.col("score")))
    merged = index.merge_evidence(mine, shaped, 1.0, weigh.structural_weight).join(both, "query_id", "left")
    limit = F.when(F.col("both"), planner.max_evidence(most, True)).otherwise(planner.max_evidence(most, False))
    rows = index.top_k(merged.withColumn("limit", limit), ["query_id"], planner.max_evidence(most, True)).where("rank <= limit")
    rows = rows.join(shaped.select(*KEY, "line"), KEY, "left")
    return rows.select(*KEY, paths.file_class(F.col("path")).alias("file_class"), "score", "rank", F.coalesce("line", F.lit(1)).alias("line"))


def search_or_scan(corpus: DataFrame, query: str, most: int = 50) -> tuple[str, DataFrame]:
    """('Found' or 'FallbackUsed', rows): the search of one request, or, if it finds nothing, lines that hold one of its words."""
    spark = corpus.sparkSession
    asked = spark.createDataFrame([(1, query)], "query_id int, query string")
    hits = index.bm25(corpus, prepare(asked).select("query_id", F.explode("terms").alias("term")), most)
    if not hits.isEmpty():
        return "Found", hits.select(*FILE, F.lit(1).alias("line"), "score")
    from ..sources.corpus import grep

    pattern = asked.select(text.scan_pattern(F.col("query"))).first()[0]
    return "FallbackUsed", grep(corpus, pattern, most).select(*FILE, "line", F.lit(1.0).alias("score"))


def guarded(corpus: DataFrame, queries: DataFrame, at: str, most: int = 50) -> DataFrame:
    """(query_id, repository_id, path, line, score, how) of a batch (query_id, query), however the index in a folder is.

    The snapshot at hand is searched; if what it names is gone the last version is opened anew, and
    without one nothing is searched. Requests without a hit get lines that hold one of their words,
    the first `most` by file, by one scan of the corpus for all of them.
    """
    spark = corpus.sparkSession
    q = store.cut(prepare(queries))
    asked = segments.clauses_of(q.select("query_id", F.explode("terms").alias("term")))
    hits = None
    for opened in (segments.cached, segments.open_):
        try:
            hits = store.cut(segments.search(opened(spark, at), asked, most).drop("rank"))
            break
        except Exception as e:  # files of an old version may have been removed meanwhile
            if not isinstance(e, FileNotFoundError) and not any(x in str(e) for x in ("PATH_NOT_FOUND", "FileNotFound", "does not exist", "FILE_NOT_EXIST")):
                raise
            segments.invalidate(at)
    found = [] if hits is None else [hits.select("query_id", *FILE, F.lit(1).alias("line"), "score", F.lit("Found").alias("how"))]
    left = q if hits is None else q.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    left = left.select("query_id", F.concat(F.lit("(?i)"), text.scan_pattern(F.col("query"))).alias("pattern"))
    near = corpus.join(left, F.expr("content rlike pattern")).select("query_id", "pattern", *FILE, F.posexplode(F.split("content", "\n")).alias("line", "text"))
    lines = near.where(F.expr("text rlike pattern")).withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(*FILE, "line"))).where(F.col("nth") <= most)
    found.append(lines.select("query_id", *FILE, (F.col("line") + 1).alias("line"), F.lit(1.0).alias("score"), F.lit("FallbackUsed").alias("how")))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def explain(rows: DataFrame) -> DataFrame:
    """rows with a line of text that says where each stands and why."""
    line = F.format_string("%s score:%.2f class:%s source:%s rank:%d", "path", F.col("score").cast("double"), "file_class", "source", "rank")
    return rows.withColumn("explained", line)
