"""Retrieval measured on golden requests: a batch of requests times settings, ranked and scored as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import segments, store
from . import planner, retrieve

FILE = ["repository_id", "path"]


@dataclass(frozen=True)
class Setting:
    """What a run of the chain does: synonyms, edges beside the first files, candidates of a search."""

    name: str
    expansion: bool = True
    graph: bool = False
    pool: int = 100


def golden(corpus: DataFrame, items: DataFrame, skip: int = 2, words: int = 8) -> tuple[DataFrame, DataFrame]:
    """(requests: task_id and query; expected: task_id, repository_id, path) of items (task_id, text).

    A request is some words of its item; expected are the files that hold them one after another.
    Items with fewer words give none.
    """
    tokens = F.slice(text.analyse(F.col("text")), skip + 1, words)
    asked = items.select("task_id", tokens.alias("t")).where(F.size("t") == words).select("task_id", F.array_join("t", " ").alias("query"))
    t = text.analyse(F.col("content"))
    each = corpus.select(*FILE, t.alias("t")).where(F.size("t") >= words)
    windows = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("t") - words + 1), lambda i: F.array_join(F.slice("t", i, words), " ")))
    return asked, each.select(*FILE, F.explode(windows).alias("query")).join(asked, "query").select("task_id", *FILE)


def runs(corpus: DataFrame, requests: DataFrame, settings: list[Setting], most: int | None = None, stored: segments.Snapshot | None = None) -> DataFrame:
    """(setting, task_id, repository_id, path, rank): each request's answer under each setting, by one search and one chain."""
    each = F.array(*[F.struct(F.lit(s.name).alias("setting"), F.lit(s.expansion).alias("expansion"), F.lit(s.graph).alias("graph"), F.lit(s.pool).alias("pool")) for s in settings])
    q = retrieve.prepare(requests.withColumnRenamed("task_id", "query_id")).withColumn("s", F.explode(each))
    q = q.withColumn("more", F.col("more") & F.col("s.expansion"))
    q = q.withColumn("words", F.when(F.col("more"), F.col("expanded")).otherwise(retrieve.plain_words(F.col("query"))))
    q = q.select(F.struct(F.col("s.setting"), F.col("query_id").alias("task_id")).alias("query_id"), *[c for c in q.columns if c not in ("query_id", "s")], "s.graph", "s.pool")
    n = corpus.count() if stored is None else stored.n_files
    ranked = retrieve.rank_prepared(corpus, store.cut(q), planner.max_files(n, most), max(s.pool for s in settings), stored)
    return ranked.select("query_id.setting", "query_id.task_id", *FILE, "rank")


def measure(answers: DataFrame, requests: DataFrame, expected: DataFrame, settings: list[Setting], k: tuple[int, int] = (5, 10)) -> DataFrame:
    """(setting, tasks, recall_<k>, mrr, change): means over requests; change is files added less files removed among the first of the greater k, as a share of the first setting's.

    A request of which no file is expected has a recall of 1 and a reciprocal rank of 0; one without an answer counts as all others.
    """
    every = requests.select("task_id").withColumn("setting", F.explode(F.array(*[F.lit(s.name) for s in settings])))
    wanted = expected.distinct().withColumn("wanted", F.lit(True))
    n = wanted.groupBy("task_id").agg(F.count("*").alias("n"))
    top = store.cut(answers.join(wanted, ["task_id", *FILE], "left"))
    hit = lambda d: F.count(F.when(F.col("wanted") & (F.col("rank") <= d), 1))
    found = top.groupBy("setting", "task_id").agg(*[hit(d).alias(f"hits_{d}") for d in k], F.min(F.when(F.col("wanted"), F.col("rank"))).alias("first"))
    first = top.where((F.col("rank") <= k[1]) & (F.col("setting") == settings[0].name)).select("task_id", *FILE)
    size = first.groupBy("task_id").agg(F.count("*").alias("size"))
    own = top.where(F.col("rank") <= k[1]).select("setting", "task_id", *FILE)
    now = own.groupBy("setting", "task_id").agg(F.count("*").alias("now"))
    # added less removed is what there is now less what there was, as both lists hold a file once
    t = every.join(found, ["setting", "task_id"], "left").join(n, "task_id", "left").join(size, "task_id", "left").join(now, ["setting", "task_id"], "left")
    kept = own.join(first, ["task_id", *FILE], "left_semi").groupBy("setting", "task_id").agg(F.count("*").alias("kept"))
    t = t.join(kept, ["setting", "task_id"], "left").fillna(0, ["size", "now", "kept", *[f"hits_{d}" for d in k]])
    recall = [F.avg(F.when(F.col("n").isNull(), 1.0).otherwise(F.col(f"hits_{d}") / F.col("n"))).alias(f"recall_{d}") for d in k]
    change = ((F.col("now") - F.col("kept")) - (F.col("size") - F.col("kept"))) / F.greatest(F.col("size"), F.lit(1))
    turned = (F.col("now") - F.col("kept") + F.col("size") - F.col("kept")) / F.greatest(F.col("size"), F.lit(1))
    return t.groupBy("setting").agg(F.count("*").alias("tasks"), *recall, F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(change).alias("change"), F.avg(turned).alias("turned"))
