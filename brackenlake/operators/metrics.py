"""Retrieval quality, latency, counters and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans


def quality(tasks: DataFrame, k: int) -> DataFrame:
    """tasks (task_id, expected, retrieved) with recall@k, reciprocal rank and the share of repeated paths."""
    top = F.slice("retrieved", 1, k)
    rank = F.array_min(F.filter(F.transform("expected", lambda e: F.array_position("retrieved", e)), lambda x: x > 0))
    n = F.size("retrieved")
    return tasks.select(
        "task_id",
        (F.size(F.array_intersect("expected", top)) / F.greatest(F.size(F.array_distinct("expected")), F.lit(1))).alias("recall"),
        F.coalesce(1 / rank, F.lit(0.0)).alias("rr"),
        F.when(n == 0, 0.0).otherwise((n - F.size(F.array_distinct("retrieved"))) / n).alias("duplicates"),
    )


def overlap(pairs: DataFrame) -> DataFrame:
    """pairs (id, a, b) of lists with the sizes of what both have and of what one has alone."""
    size = lambda x: F.size(x).cast("long")
    return pairs.select("id", size(F.array_intersect("a", "b")).alias("common"), size(F.array_except("a", "b")).alias("a_only"), size(F.array_except("b", "a")).alias("b_only"))


def percentiles(values: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, mean, p50, p95) with the value at place floor(n * p) of the sorted ones.

    Equal values are counted first, by partial sums; the counts are summed up in order over range
    partitions, so no task holds a key's values; the mean is a plain aggregation.
    """
    some = values.where(F.col(value).isNotNull() & F.col(by).isNotNull())
    counts = some.groupBy(by, value).agg(F.count("*").cast("long").alias("c"))
    r = scans.scan(counts, [by, value], by, add=("c",)).join(some.groupBy(by).agg(F.count("*").alias("__n")), by)
    at = lambda p: F.min(F.when(F.col("run_c") > F.least(F.floor(F.col("__n") * p), F.col("__n") - 1), F.col(value)))
    ranked = r.groupBy(by).agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    return values.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).join(ranked, by, "left")


def histogram(values: DataFrame, by: str, value: str, bounds: list[float]) -> DataFrame:
    """(by, le, n, total, count): cumulative counts for each bound, with the key's sum and number of values."""
    counts = values.groupBy(by).agg(F.sum(value).alias("total"), F.count(value).alias("count"), *[F.count(F.when(F.col(value) <= b, 1)).alias(f"b{i}") for i, b in enumerate(bounds)])
    each = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]))
    return counts.select(by, "total", "count", each.alias("h")).select(by, "h.le", "h.n", "total", "count")


def means(values: DataFrame, by: str, value: str) -> DataFrame:
    return values.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def recall_change(pairs: DataFrame) -> DataFrame:
    """pairs (id, before, after) of lists of files: files added less those removed, as a share of the list before."""
    b, a = F.array_distinct("before"), F.array_distinct("after")
    return pairs.select("id", ((F.size(F.array_except(a, b)) - F.size(F.array_except(b, a))) / F.greatest(F.size("before"), F.lit(1))).alias("change"))


def keyword_coverage(tasks: DataFrame) -> DataFrame:
    """tasks (task_id, keywords, text): the share of keywords that a text holds, in any case; 0 of none."""
    held = F.size(F.filter("keywords", lambda k: F.contains(F.lower("text"), F.lower(k))))
    return tasks.select("task_id", F.when(F.size("keywords") > 0, held / F.greatest(F.size("keywords"), F.lit(1))).otherwise(0.0).alias("coverage"))


def bare_path(label: Column) -> Column:
    """A path without the comment sign before and the line number after it."""
    return F.regexp_replace(F.trim(F.regexp_replace(label, "^(?:// )+", "")), r":\d*$", "")


def ranks_of_expected(tasks: DataFrame) -> DataFrame:
    """tasks (task_id, expected, retrieved): (task_id, path, rank) of each expected file, the first place whose path holds it or is held by it; null if none.

    The lists are those of one request, so they are compared within the row.
    """
    e = tasks.select("task_id", F.explode("expected").alias("path"), F.transform("retrieved", bare_path).alias("r"))
    hit = F.array_position(F.transform("r", lambda x: F.contains(x, F.col("path")) | F.contains(F.col("path"), x)), F.lit(True))
    return e.select("task_id", "path", F.nullif(hit, F.lit(0)).alias("rank"))


def misses(expected: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """Why each expected file (task_id, repository_id, path, tokens, rank) that has no rank was not found: a ladder whose first true step decides.

    NotIndexed: no such file or an empty one. GraphMiss: no token in text or name, though an edge
    joins it to a file that was found (task_id, repository_id, path). LexicalMiss: no token in text
    or name. SymbolMiss: a symbol's name holds a token, yet it was not found. QueryExpansionMiss:
    under half of the tokens. RankedTooLow: all others. With a rank: Hit.
    """
    key = ["repository_id", "path"]
    names = symbols.groupBy(*key).agg(F.collect_set(F.lower("name")).alias("names"))  # of one file
    both = edges.select("repository_id", F.col("src").alias("path"), F.col("dst").alias("other")).unionByName(edges.select("repository_id", F.col("dst").alias("path"), F.col("src").alias("other")))
    near = both.join(found.select("task_id", "repository_id", F.col("path").alias("other")), ["repository_id", "other"]).select("task_id", *key).distinct().withColumn("near", F.lit(True))
    j = expected.join(files.select(*key, "content"), key, "left").join(names, key, "left").join(near, ["task_id", *key], "left")
    low, name = F.lower("content"), F.lower(F.substring_index("path", "/", -1))
    hits = F.size(F.filter("tokens", lambda t: F.contains(low, t) | F.contains(name, t)))
    symbol = F.exists("names", lambda n: F.exists("tokens", lambda t: F.contains(n, t)))
    kind = F.when(F.col("rank").isNotNull(), "Hit").when(F.col("content").isNull() | (F.col("content") == ""), "NotIndexed").when((hits == 0) & F.coalesce("near", F.lit(False)), "GraphMiss").when(hits == 0, "LexicalMiss").when(F.coalesce(symbol, F.lit(False)), "SymbolMiss").when(hits < F.floor(F.size("tokens") / 2), "QueryExpansionMiss").otherwise("RankedTooLow")
    return j.select("task_id", *key, "rank", kind.alias("miss"))


def miss_counts(misses_: DataFrame) -> DataFrame:
    return misses_.groupBy("miss").agg(F.count("*").alias("n"))
