"""The postings store, BM25 over several fields, and what else is asked of the index."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths, text
from ..functions import vocabulary as V
from . import store as store_
from . import symbols

FILE = ["repository_id", "path"]
#: Terms of a batch that a scan without a stored index picks within the row.
WANTED = 2000


def _identifier_terms(names: Column) -> Column:
    return F.flatten(F.transform(names, lambda n: text.analyse(F.array_join(F.concat(F.array(n), F.filter(text.split_identifier(n), lambda p: p != F.lower(n))), " "))))


def field_terms(corpus: DataFrame) -> DataFrame:
    """(repository_id, path, and of each field its terms): all in the file's row.

    path and filename are split; title is that of documentation; content has each word with the
    parts of its identifier, and all headings of titled documentation before; symbols has names and
    their parts, symbol_name the names alone.
    """
    stem = F.regexp_replace(paths.filename(F.col("path")), r"\.[^.]*$", "")
    doc = paths.file_class(F.col("path")) == "Documentation"
    named = corpus.withColumn("__names", symbols.names(F.col("content"))).withColumn("__title", F.when(doc, F.coalesce(text.title(F.col("content")), F.lit(""))).otherwise(""))
    heads = F.when(F.col("__title") != "", text.analyse(text.headings(F.col("content")))).otherwise(F.array().cast("array<string>"))
    content = F.coalesce("content", F.lit(""))
    return named.select(
        *FILE,
        text.analyse(F.array_join(text.path_tokens(F.col("path")), " ")).alias("path_terms"),
        text.analyse(stem).alias("filename"),
        text.analyse(F.col("__title")).alias("title"),
        F.concat(heads, text.analyse(F.array_join(text.preprocess(content), " "))).alias("content"),
        _identifier_terms(F.col("__names")).alias("symbols"),
        F.flatten(F.transform("__names", lambda n: text.analyse(n))).alias("symbol_name"),
    )


FIELDS = {"path": "path_terms", "filename": "filename", "title": "title", "content": "content", "symbols": "symbols", "symbol_name": "symbol_name"}


def fields(corpus: DataFrame) -> DataFrame:
    """(repository_id, path, field, terms) of each file, a row for each of the six fields."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(c).alias("terms")) for k, c in FIELDS.items()]))
    return field_terms(corpus).select(*FILE, each.alias("f")).select(*FILE, "f.field", "f.terms")


def postings(fields_: DataFrame) -> DataFrame:
    """(repository_id, path, field, len, term, tf): runs of equal terms are counted within the row, so nothing is shuffled."""
    s = fields_.select(*FILE, "field", F.size("terms").alias("len"), F.array_sort("terms").alias("s")).where("len > 0")
    new = lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1))
    s = s.withColumn("at", F.filter(F.sequence(F.lit(0), F.col("len") - 1), new))
    each = F.transform("at", lambda a, j: F.struct(F.get("s", a).alias("term"), (F.coalesce(F.get("at", j + 1), F.col("len")) - a).cast("long").alias("tf")))
    return s.select(*FILE, "field", "len", F.explode(each).alias("t")).select(*FILE, "field", "len", "t.term", "t.tf")


# --- the stored index: segments and snapshots --------------------------------------------------------


def store(corpus: DataFrame, path: str) -> None:
    """Write an index of the corpus under a path, in place of what is there once it is committed."""
    from . import segments

    segments.build(corpus, path)


def update(spark: SparkSession, path: str, changed: DataFrame, deleted: DataFrame) -> int:
    """Commit a version with the changed files anew and without deleted ones; what is written grows with the change. Returns the version."""
    from . import segments

    return segments.change(spark, path, changed, deleted).version


def files(spark: SparkSession, path: str) -> DataFrame:
    """(repository_id, path) of the files that a stored index holds."""
    from . import segments

    return segments.open_(spark, path).files().select(*FILE)


def validate(spark: SparkSession, path: str) -> str:
    """'missing', 'empty' or 'ok'."""
    from . import segments

    try:
        return "ok" if segments.open_(spark, path).n_files else "empty"
    except FileNotFoundError:
        return "missing"


# --- search ----------------------------------------------------------------------------------------


def score(postings_: DataFrame, stats: DataFrame, queries: DataFrame, only: Column | None = None) -> DataFrame:
    """(query_id, repository_id, path, score): BM25 of postings of the terms asked for, summed over terms and fields.

    queries: (query_id, term). The table of fields goes to all tasks; terms and queries are as large as the batch.
    """
    df = postings_.groupBy("field", "term").agg(F.count("*").alias("df"))
    boost = F.create_map(*[F.lit(x) for kv in V.FIELD_BOOSTS.items() for x in kv])
    j = postings_.join(df, ["field", "term"]).join(F.broadcast(stats), "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (V.BM25_K1 + 1) / (F.col("tf") + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("len") / (F.col("total") / F.col("n"))))
    j = j if only is None else j.where(only)
    hits = j.withColumn("s", boost[F.col("field")] * idf * norm).join(queries, "term")
    return hits.groupBy("query_id", *FILE).agg(F.sum("s").alias("score"))


def bm25(corpus: DataFrame, queries: DataFrame, k: int = 50, only: Column | None = None) -> DataFrame:
    """(query_id, repository_id, path, score, rank): the best k files of each query over all repositories, analysed anew.

    only, a condition on repository_id and path, picks the files that may be found; the statistics
    are those of all files all the same. The corpus is analysed once: of each field its length and
    the terms asked for (the batch of queries is bounded) are kept, the rest never leaves the row.
    """
    some = queries.select("term").distinct()
    wanted = sorted(r[0] for r in some.limit(WANTED + 1).collect())
    few = len(wanted) <= WANTED  # else all terms are kept, and joined
    hits = lambda terms: F.filter(terms, lambda t: t.isin(wanted)) if wanted and few else terms if wanted else F.array().cast("array<string>")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(c).alias("len"), hits(F.col(c)).alias("hits")) for f, c in FIELDS.items()]))
    f = store_.cut(field_terms(corpus).select(*FILE, each.alias("f")).select(*FILE, "f.*"))
    stats = f.groupBy("field").agg(F.count("*").alias("n"), F.sum("len").alias("total"))
    each = f.where(F.size("hits") > 0).select(*FILE, "field", "len", F.explode("hits").alias("term"))
    tf = (each if few else each.join(some, "term", "left_semi")).groupBy(*FILE, "field", "len", "term").agg(F.count("*").alias("tf"))
    return top_k(score(tf, stats, queries, only), ["query_id"], k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 50, only: Column | None = None) -> DataFrame:
    """As bm25, from the last version of a stored index; only is a condition on repository_id, path and language."""
    from . import segments

    return segments.search(segments.cached(spark, path), segments.clauses_of(queries), k, only)


def document_frequency(corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """(field, term, n_docs, n_found) of the terms asked for, a table of bounded size: files that hold each, and how often."""
    p = postings(fields(corpus)).join(terms.select("term").distinct(), "term")
    return p.groupBy("field", "term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_found"))


def count_hits(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n): files that hold any term of each query (query_id, term) in any field, whatever k."""
    p = postings(fields(corpus)).join(queries, "term")
    return p.select("query_id", *FILE).distinct().groupBy("query_id").agg(F.count("*").alias("n"))


def phrase_matches(corpus: DataFrame, phrase: str) -> DataFrame:
    """(repository_id, path, n): files whose content holds the phrase as consecutive terms, and how often (no overlaps).

    Files without one of its words are left out before any text is analysed.
    """
    words = [w for w in re.split(r"[\W_]+", phrase.lower()) if w]
    if not words:
        return corpus.select(*FILE, F.lit(0).cast("long").alias("n")).limit(0)
    for w in words:
        corpus = corpus.where(F.contains(F.lower("content"), F.lit(w)))
    line = F.concat(F.lit(" "), F.array_join(text.analyse(F.col("content")), "  "), F.lit(" "))
    sought = " " + "  ".join(words) + " "
    n = ((F.length(line) - F.length(F.replace(line, F.lit(sought), F.lit("")))) / len(sought)).cast("long")
    return corpus.select(*FILE, n.alias("n")).where("n > 0")


def top_k(scored: DataFrame, by: list[str], k: int, score: str = "score", then: tuple[str, ...] = ("repository_id", "path")) -> DataFrame:
    """The best k rows of each key by score, then by columns that it has; a window's own limit keeps k rows a task first."""
    order = [F.desc(F.round(score, 9)), *[c for c in then if c in scored.columns]]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


# --- lists of candidates, by what names a file in both ----------------------------------------------


def _keys(*parts: DataFrame) -> list[str]:
    return [c for c in ("query_id", *FILE) if all(c in p.columns for p in parts)]


def merge_max(*parts: DataFrame) -> DataFrame:
    """Candidate lists ([query_id, repository_id,] path, score, source) put together: of each file the best score, then the source by name."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*_keys(*parts)).agg(F.max_by("source", F.struct(F.col("score"), F.col("source"))).alias("source"), F.max("score").alias("score"))


def gap_fill(found: DataFrame, expanded: DataFrame, damp: float = V.EXPANSION_WEIGHT) -> DataFrame:
    """Found rows, and those of the expanded query that were not found, damped."""
    k = _keys(found, expanded)
    return found.unionByName(expanded.join(found.select(*k), k, "left_anti").withColumn("score", F.col("score") * damp))


def code_behind(found: DataFrame, files: DataFrame, factor: float = V.CODE_BEHIND) -> DataFrame:
    """Rows added for files named like a found view (.cshtml, .razor) with .cs after it, unless found themselves."""
    k = _keys(found)
    views = found.where(F.col("path").endswith(".cshtml") | F.col("path").endswith(".razor"))
    pair = views.select(*[c for c in k if c != "path"], F.concat("path", F.lit(".cs")).alias("path"), (F.col("score") * factor).alias("score"))
    own = _keys(pair, files)
    return pair.join(files.select(*own).distinct(), own, "left_semi").join(found.select(*k), k, "left_anti")


def merge_evidence(lexical: DataFrame, structural: DataFrame, w1: float, w2: float) -> DataFrame:
    k = _keys(lexical, structural)
    j = lexical.select(*k, F.col("score").alias("l")).join(structural.select(*k, F.col("score").alias("s")), k, "full_outer")
    return j.select(*k, F.greatest(F.coalesce(F.col("l") * w1, F.lit(0.0)), F.coalesce(F.col("s") * w2, F.lit(0.0))).alias("score"))


def reserve_docs(ranked: DataFrame, k: int | Column, slots: int = V.DOC_SLOTS) -> DataFrame:
    """The first k of each query's ranked rows (query_id, rank, file_class, ...), of which `slots` are documentation if there is so much.

    The last `slots` of the k are for documents. A document that stands above those fills a place
    first, and changes over with the row there; only then documents from below come in, for the
    rows at the later places. Ranks stay, so this is about who is in.
    """
    w = Window.partitionBy("query_id")
    rank, doc = F.col("rank"), F.col("file_class") == "Documentation"
    n = F.count("*").over(w)
    k = F.least(F.lit(k) if isinstance(k, int) else k, n)
    r = ranked.withColumn("__k", k).withColumn("__part", F.when(rank <= F.col("__k") - slots, "head").when(rank <= F.col("__k"), "tail").otherwise("below"))
    count = lambda on: F.count(F.when(on, 1)).over(w)
    part = F.col("__part")
    r = r.withColumn("__need", F.lit(slots) - count(doc & (part == "tail"))).withColumn("__own", F.least(F.col("__need"), count(doc & (part == "head"))))
    r = r.withColumn("__in", F.least(F.col("__need") - F.col("__own"), count(doc & (part == "below"))))
    nth = F.row_number().over(Window.partitionBy("query_id", "__part", doc).orderBy("rank"))
    r = r.withColumn("__nth", nth)
    out = (part == "tail") & ~doc & F.col("__nth").between(F.col("__own") + 1, F.col("__own") + F.col("__in"))
    into = (part == "below") & doc & (F.col("__nth") <= F.col("__in"))
    kept = F.when(F.col("__k") > slots, into | (part != "below") & ~out).otherwise(part != "below")
    return r.where(kept).drop("__k", "__part", "__need", "__own", "__in", "__nth")
