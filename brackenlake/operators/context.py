"""From ranked evidence to a pack of snippets under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from ..functions import text as T
from .store import cut, sent, spill_key

FILE = ["repository_id", "path"]

DOCS_SHARE = 0.45


def snippet_window(n: int, most: int) -> tuple[int, int]:
    """Lines above and below a hit for n pieces of evidence: full windows to 20 pieces, then the same total shared out."""
    below = min(most, 15)
    if n <= 20:
        return 5, below
    total = min(max(20 * (8 + below) // n - 3, 6), 5 + below)
    above = max(total * 5 // (5 + below), 2)
    return above, total - above


def truncate(snippets: DataFrame, budget: int, reserve: int = 5) -> DataFrame:
    """(all columns but text, text, n_tokens, cut): whole lines of each text while their tokens, one more a line, fit the budget less a reserve.

    A text within the budget stays as it is. What is cut ends in a line that names the key of the
    full text (store.spill), at `reserve` tokens. All in the row.
    """
    lines = F.split("text", "\n")
    cost = lambda x: T.token_estimate(x) + 1
    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).alias("n"), F.lit(True).alias("on"))
    step = lambda s, x: F.struct(F.when(s["on"] & (s["run"] + cost(x) <= budget - reserve), s["run"] + cost(x)).otherwise(s["run"]).alias("run"), (s["n"] + (s["on"] & (s["run"] + cost(x) <= budget - reserve)).cast("int")).alias("n"), (s["on"] & (s["run"] + cost(x) <= budget - reserve)).alias("on"))
    own = T.token_estimate(F.col("text"))
    rest = [c for c in snippets.columns if c != "text"]
    s = snippets.select(*rest, "text", own.alias("__own"), lines.alias("__lines")).withColumn("__kept", F.aggregate("__lines", start, step))
    cut = F.col("__own") > budget
    pointer = F.concat(F.lit("... [truncated, full text at "), spill_key(F.col("text")), F.lit("]"))
    short = F.concat(F.array_join(F.slice("__lines", 1, F.col("__kept.n")), "\n"), F.when(F.col("__kept.n") > 0, "\n").otherwise(""), pointer)
    return s.select(*rest, F.when(cut, short).otherwise(F.col("text")).alias("text"), F.when(cut, F.col("__kept.run") + reserve).otherwise(F.col("__own")).alias("n_tokens"), cut.alias("cut"))


def snippets(evidence: DataFrame, files: DataFrame, most_lines: int, hints: DataFrame | None = None) -> DataFrame:
    """(query_id, repository_id, path, rank, docs, text): the lines around each piece of evidence (query_id, repository_id, path, line, rank), as one part of a pack.

    The window is narrower the more evidence a query has. Files that a request names (hints:
    query_id, repository_id, path) follow with their first lines. Evidence of files that are not
    stored is left out. Documentation is told from code by the path. Evidence goes to the files, so
    that no text is shuffled, unless there is more of it than is sent.
    """
    n = F.count("*").over(Window.partitionBy("query_id"))
    below = min(most_lines, 15)
    total = F.least(F.greatest(F.floor(F.lit(20 * (8 + below)) / F.col("__n")) - 3, F.lit(6)), F.lit(5 + below))
    above = F.when(F.col("__n") <= 20, 5).otherwise(F.greatest(F.floor(total * 5 / (5 + below)), F.lit(2)))
    under = F.when(F.col("__n") <= 20, below).otherwise(total - above)
    e = evidence.withColumn("__n", n).select("query_id", *FILE, "rank", "line", F.greatest(F.col("line") - above, F.lit(1)).cast("int").alias("__from"), (F.col("line") + under).cast("int").alias("__to"))
    if hints is not None:
        e = e.unionByName(hints.select("query_id", *FILE, F.lit(None).cast("int").alias("rank"), F.lit(1).alias("line"), F.lit(1).alias("__from"), F.lit(most_lines).alias("__to")))
    j = sent(cut(e)).join(files.select(*FILE, "content"), FILE)
    lines = F.split("content", "\n")
    body = F.array_join(F.slice(lines, F.col("__from"), F.greatest(F.least(F.size(lines), F.col("__to")) - F.col("__from") + 1, F.lit(0))), "\n")
    head = F.concat(F.lit("// "), F.col("path"), F.when(F.col("rank").isNotNull(), F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(""))
    return j.select("query_id", *FILE, "rank", (paths.file_class(F.col("path")) == "Documentation").alias("docs"), F.concat(head, F.lit("\n"), body).alias("text"))


def pack(snippets_: DataFrame, budget: int) -> DataFrame:
    """(query_id, docs_text, code_text, docs_tokens, code_tokens, remaining): documentation in its share of the budget, code in the rest, by rank; hints last.

    The rows of a query are its bounded evidence, so its parts are joined in one row.
    """
    part = lambda docs: F.array_join(F.transform(F.filter("__all", lambda x: x["docs"] == F.lit(docs)), lambda x: x["text"]), "\n\n")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("rank", F.lit(1 << 30)).alias("rank"), *FILE, "docs", "text")))
    both = snippets_.groupBy("query_id").agg(order.alias("__all")).select("query_id", part(True).alias("docs"), part(False).alias("code"))
    share = int(budget * DOCS_SHARE)
    docs = truncate(both.select("query_id", F.col("docs").alias("text")), share).select("query_id", F.col("text").alias("docs_text"), F.col("n_tokens").alias("docs_tokens"))
    code = truncate(both.select("query_id", F.col("code").alias("text")), budget - share).select("query_id", F.col("text").alias("code_text"), F.col("n_tokens").alias("code_tokens"))
    out = docs.join(code, "query_id")
    return out.withColumn("remaining", F.greatest(F.lit(budget) - F.col("docs_tokens") - F.col("code_tokens"), F.lit(0)))


def usage_by_source(packs: DataFrame) -> DataFrame:
    """(query_id, total, by_source): the tokens of each part of a pack, and what the budget has left for the rest, as a map."""
    parts = {"docs_context": "docs_tokens", "code_context": "code_tokens", "metadata": "remaining"}
    each = F.create_map(*[x for k, c in parts.items() for x in (F.lit(k), F.col(c).cast("long"))])
    return packs.select("query_id", (F.col("docs_tokens") + F.col("code_tokens")).cast("long").alias("total"), each.alias("by_source"))


def labels(evidence: DataFrame) -> DataFrame:
    """evidence (path, source, score, ...) with path cleaned and the retriever and reason of its source."""
    s = F.col("source")
    retriever = F.when(s == "structural", "ast-grep").when(s == "scan", "ripgrep").otherwise("index")
    reason = F.when(s == "lexical", "bm25").when(s == "expanded", "bm25 of expanded terms").when(s == "code-behind", "code-behind").when(s == "scan", "text match").otherwise("symbol match")
    return evidence.withColumn("path", clean_path(F.col("path"))).withColumn("retriever", retriever).withColumn("reason", reason)


def first_in_session(blocks: DataFrame) -> DataFrame:
    """Of each session and content (session_id, ts, content) the first block; later copies are left out."""
    w = Window.partitionBy("session_id", F.sha2("content", 256)).orderBy("ts")
    return blocks.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def fill_budget(evidence: DataFrame, budget: int) -> DataFrame:
    """Rows (query_id, path, rank, file_class, n_tokens) that fit: documentation in its share, code in the rest, by rank."""
    docs = (F.col("file_class") == "Documentation").alias("docs")
    w = Window.partitionBy("query_id", "docs").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    share = F.when(F.col("docs"), F.floor(F.lit(budget * DOCS_SHARE))).otherwise(budget - F.floor(F.lit(budget * DOCS_SHARE)))
    return evidence.withColumn("docs", docs).withColumn("used", F.sum("n_tokens").over(w)).where(F.col("used") <= share)


def provenance(rows: DataFrame) -> DataFrame:
    """Of each path, source and retriever the best score, with the place of the first (pos)."""
    return rows.groupBy("path", "source", "retriever").agg(F.max("score").alias("score"), F.min("pos").alias("pos"))


def clean_path(path: Column) -> Column:
    """A path without its verbatim prefix, and without a docs: or code: label before an absolute path."""
    p = F.regexp_replace(path, r"^\\\\\?\\", "")
    return F.regexp_replace(p, r"^[a-z]+:(?=(?:/|[A-Za-z]:[\\/]))", "")


def preview_json(row: Column) -> Column:
    """A row as JSON with all its fields, null ones too."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def yaml_block(columns: list[str]) -> Column:
    """Columns as lines of YAML; texts are quoted as JSON strings, which YAML reads alike."""
    value = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1)
    return F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), value(c)) for c in columns])


def enrich(request: Column, docs: Column, code: Column, tokens: Column) -> Column:
    """A request with its context after a delimiter, or as it came if there is none (fail open)."""
    found = F.concat_ws("\n\n", F.nullif(docs, F.lit("")), F.nullif(code, F.lit("")))
    return F.when(F.coalesce(tokens, F.lit(0)) > 0, F.concat(request, F.lit("\n\n---\n"), found)).otherwise(request)
