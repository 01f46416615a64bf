"""From requests to packs of context: ranking, snippets, budget and enriched texts as one plan over a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context, segments, store
from . import retrieve

FILE = ["repository_id", "path"]


def respond(corpus: DataFrame, requests: DataFrame, budget: int = 8000, most_lines: int = 15, most: int | None = None, stored: segments.Snapshot | None = None, hints: DataFrame | None = None, repository: str | None = None) -> DataFrame:
    """(query_id, n_files, docs_text, code_text, docs_tokens, code_tokens, remaining, enriched) of every request (query_id, query).

    The answer's files give the lines around their match, files that a request names (hints:
    query_id, repository_id, path) follow, and both are cut to the budget. A request without any
    context comes back as it came. With a repository only its files are packed. Edges between files
    count whatever the number of files.
    """
    found = retrieve.answer(corpus, requests, most, stored=stored, graph_files=None)
    found = found if repository is None else found.where(F.col("repository_id") == repository)
    evidence = store.cut(found.select("query_id", *FILE, "line", "rank"))  # a bounded number of rows a request
    parts = context.snippets(evidence, corpus, most_lines, hints)
    packs = context.pack(parts, budget)
    n = evidence.groupBy("query_id").agg(F.count("*").cast("long").alias("n_files"))
    out = requests.join(n, "query_id", "left").join(packs, "query_id", "left")
    used = F.coalesce(F.col("docs_tokens") + F.col("code_tokens"), F.lit(0))
    return out.select(
        "query_id", F.coalesce("n_files", F.lit(0)).alias("n_files"), "docs_text", "code_text", F.coalesce("docs_tokens", F.lit(0)).alias("docs_tokens"), F.coalesce("code_tokens", F.lit(0)).alias("code_tokens"),
        F.coalesce("remaining", F.lit(budget)).alias("remaining"), context.enrich(F.col("query"), F.col("docs_text"), F.col("code_text"), used).alias("enriched"),
    )
