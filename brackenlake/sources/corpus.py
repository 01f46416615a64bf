"""Sources and sinks: a document table as a corpus of files, repository trees, table upkeep."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from . import commits

#: Paths of the corpus by doc_id modulo 8; {n} is the doc_id.
PATHS = ["docs/guide_{n}.md", "src/core/Module{n}.rs", "tests/test_{n}.py", "config/app_{n}.yaml", "types/pkg{n}/index.d.ts", ".github/flow_{n}.yml", "a{n}/docs/README.md", "web/View{n}.cshtml"]


def _cases(text) -> str:
    return " ".join(f"WHEN {k} THEN concat({', '.join(repr(x) if i % 2 == 0 else 'doc_id' for i, x in enumerate(sum(([a, None] for a in p.split('{n}')), [])[:-1]))})" for k, p in enumerate(text))


CORPUS_SQL = f"SELECT doc_id, source AS repository_id, CASE doc_id % 8 {_cases(PATHS)} END AS path, lang AS language, text AS content FROM documents"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, repository_id, path, language, content) of the documents."""
    d = table(spark, sf_dir, "documents")
    path = None
    for k, p in enumerate(PATHS):
        a, b = p.split("{n}")
        value = F.concat(F.lit(a), F.col("doc_id").cast("string"), F.lit(b))
        path = F.when(F.col("doc_id") % 8 == k, value) if path is None else path.when(F.col("doc_id") % 8 == k, value)
    return d.select("doc_id", F.col("source").alias("repository_id"), path.alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"))


SKIPPED = r"/(?:obj|bin|node_modules|\.git|target)/"


def ignore_rules(text: str) -> list[tuple[bool, str]]:
    """Lines of an ignore file as (ignored, regular expression over paths below the root), in order; a ! line takes back."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        p = line[1:] if keep else line
        folder, rooted = p.endswith("/"), "/" in p.rstrip("/")
        body, i = "", 0
        p = p.strip("/")
        while i < len(p):
            if p.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif p.startswith("**", i):
                body, i = body + ".*", i + 2
            elif p[i] in "*?":
                body, i = body + ("[^/]*" if p[i] == "*" else "[^/]"), i + 1
            else:
                body, i = body + re.escape(p[i]), i + 1
        out.append((not keep, ("^" if rooted else "^(?:.*/)?") + body + ("/.*$" if folder else "(?:/.*)?$")))
    return out


def ignored(path, rules: list[tuple[bool, str]]):
    """Whether a path below the root is ignored: the last rule that matches decides."""
    out = F.lit(False)
    for ignore, rx in rules:
        out = F.when(path.rlike(rx), F.lit(ignore)).otherwise(out)
    return out


def nested_rules(texts: list[tuple[str, str]]) -> list[tuple[bool, str]]:
    """Rules of several ignore files (folder below the root or '', text): those of a folder hold below it, and later than those of the folders around."""
    out = []
    for folder, text in sorted(texts, key=lambda x: (x[0].count("/") + bool(x[0]), x[0])):
        at = "^" + re.escape(folder + "/") if folder else "^"
        out += [(ignore, at + rx.removeprefix("^")) for ignore, rx in ignore_rules(text)]
    return out


def scan_tree(spark: SparkSession, root: str, known: DataFrame | None = None, ignore: str = "", nested: bool = False) -> DataFrame:
    """(path, size, modified, content) of a repository tree; files unchanged since known (path, size, last_indexed_at) are left out before reading.

    ignore is the text of an ignore file for the root; with nested the .gitignore files of all
    folders count, each below its own. Files of binary endings, and those whose first 512 bytes hold
    more NULs than a hundredth of them, are left out.
    """
    if nested:
        top = root.rstrip("/").split("://")[-1].lstrip("/") + "/"
        rules = nested_rules([("", ignore), *[x for x in commits.texts_named(spark, root, ".gitignore") if not re.search(SKIPPED, f"/{x[0]}/")]])
        left = scan_tree(spark, root, known)
        return left.where(~ignored(F.substring_index(F.col("path"), top, -1), rules)) if rules else left
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(~F.col("path").rlike(SKIPPED) & ~paths.binary_by_name(F.col("path")))
    if ignore:
        below = F.substring_index(F.col("path"), root.rstrip("/").split("://")[-1].lstrip("/") + "/", -1)
        files = files.where(~ignored(below, ignore_rules(ignore)))
    if known is not None:
        same = known.select("path", F.col("size").alias("__size"), "last_indexed_at")
        files = files.join(same, "path", "left").where(~F.coalesce((F.col("length") == F.col("__size")) & (F.col("modificationTime") <= F.col("last_indexed_at")), F.lit(False)))
    head = F.substring(F.col("content"), 1, 512)
    nul = F.length(head) - F.octet_length(F.replace(F.decode(head, "ISO-8859-1"), F.lit("\x00"), F.lit("")).cast("binary"))
    text = F.decode("content", "UTF-8")
    return files.where(nul <= F.floor(F.least(F.length("content"), F.lit(512)) / 100)).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), text.alias("content"))


def line_range(content, start: int, end: int | None = None):
    """Lines start to end of a text, both included, from 1; the end is clamped."""
    lines = F.split(content, "\n")
    n = F.size(lines) if end is None else F.least(F.size(lines), F.lit(end))
    return F.array_join(F.slice(lines, start, F.greatest(n - start + 1, F.lit(0))), "\n")


def grep(corpus_: DataFrame, pattern: str, most: int) -> DataFrame:
    """(repository_id, path, line, content): lines that match, without regard to case; the first `most` by path and line."""
    lines = corpus_.where(F.col("content").rlike(f"(?i){pattern}")).select("repository_id", "path", F.posexplode(F.split("content", "\n")).alias("line", "content"))
    return lines.where(F.col("content").rlike(f"(?i){pattern}")).withColumn("line", F.col("line") + 1).orderBy("repository_id", "path", "line").limit(most)


def grep_files(corpus_: DataFrame, pattern: str) -> DataFrame:
    """(repository_id, path, n_lines): files with lines that match, without regard to case, and how many."""
    hit = F.size(F.filter(F.split("content", "\n"), lambda x: x.rlike(f"(?i){pattern}")))
    return corpus_.where(F.col("content").rlike(f"(?i){pattern}")).select("repository_id", "path", hit.alias("n_lines")).where("n_lines > 0")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """([repository_id,] path, status): new, changed, unchanged or deleted, by what names a file in both and its hash; one full outer join."""
    key = [c for c in ("repository_id", "path") if c in old.columns and c in new.columns]
    j = old.select(*key, F.col("hash").alias("h0")).join(new.select(*key, F.col("hash").alias("h1")), key, "full_outer")
    status = F.when(F.col("h0").isNull(), "new").when(F.col("h1").isNull(), "deleted").when(F.col("h0") != F.col("h1"), "changed").otherwise("unchanged")
    return j.select(*key, status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Of each key the row that is latest by a column; of equals the new one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(by), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def replace_partition(df: DataFrame, path: str, by: str = "repository_id") -> None:
    """Write a table so that the partitions that df has are replaced and the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
