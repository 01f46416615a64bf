"""A repository's index over time: build, change, state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import index, segments, store
from ..sources import commits
from ..sources.corpus import diff

FILE = ["repository_id", "path"]


def known(files: DataFrame) -> DataFrame:
    """(repository_id, path, hash): what is kept of files to tell later which of them changed."""
    return files.select(*FILE, F.sha2("content", 256).alias("hash"))


#: What indexes of this code are like; another number is built anew.
FORMAT = 2


def opened(corpus: DataFrame, name: str) -> segments.Snapshot:
    """The index of a corpus that is read from files: built once for their state, opened again after that.

    name tells apart what different corpora make of the same files.
    """
    spark = corpus.sparkSession
    at = f"{store.shared_dir(spark)}/index/{name}-{FORMAT}-{commits.fingerprint(spark, corpus.inputFiles())}"
    try:
        return segments.cached(spark, at)
    except FileNotFoundError:
        try:
            return segments.build(corpus, at)
        except FileExistsError:  # another job built it meanwhile, of the same files
            return segments.cached(spark, at)


def reindex(spark: SparkSession, path: str, before: DataFrame, now: DataFrame) -> dict[str, int]:
    """Bring a stored index from files known before (repository_id, path, hash) to those of now; how many files had each status.

    New and changed files are analysed, all others are not read again; an index that is missing is built.
    """
    if index.validate(spark, path) != "ok":
        index.store(now, path)
        return {"new": now.count()}
    status = store.cut(diff(before, known(now)))
    n = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    if n.keys() - {"unchanged"}:
        changed = now.join(status.where("status in ('new', 'changed')").select(*FILE), FILE, "left_semi")
        index.update(spark, path, changed, status.where("status = 'deleted'"))
    return n


def probe(spark: SparkSession, path: str, files: DataFrame, request: str = "readme") -> dict:
    """The state of a stored index, its files, those of the table, and how many files a smoke request finds."""
    from .retrieve import prepare

    state = index.validate(spark, path)
    out = {"index": state, "stored": files.count(), "indexed": 0, "found": 0}
    if state == "ok":
        asked = prepare(spark.createDataFrame([(1, request)], "query_id int, query string")).select("query_id", F.explode("terms").alias("term"))
        out["indexed"] = index.files(spark, path).count()
        out["found"] = index.search(spark, path, asked, 10).count()
    return out


def languages(spark: SparkSession) -> DataFrame:
    """(language, endings, names): the languages that are known."""
    return spark.createDataFrame([(k, e, n) for k, (e, n) in V.LANGUAGES.items()], "language string, endings array<string>, names array<string>")
