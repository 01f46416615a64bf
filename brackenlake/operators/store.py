"""Upkeep of the stored tables: files, symbols, the registry of repositories, memory, seeds, spilled texts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILE = ["repository_id", "path"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (tests, local mode) a temporary one."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/brackenlake-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read from a reliable checkpoint: in spark.checkpoint.dir, else (tests, local mode) in a temporary folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


#: Rows of a table up to which it is sent to the tasks that join it, after a count.
SENT = 100_000


def sent(df: DataFrame) -> DataFrame:
    """df, cut before, to be joined: a counted small one goes to all tasks, so that the other side stays where it is."""
    return F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df


#: Names of first documents, in order, and folders of decision records.
SEED_NAMES = ("README.md", "Readme.md", "readme.md", "README")
SEED_FOLDERS = ("docs/adr", "docs/decisions", "adr", "decisions")
SEED_CHARS = 65_536


# --- files and symbols -----------------------------------------------------------------------------


def put_files(files: DataFrame, new: DataFrame) -> DataFrame:
    """files with the rows of new in place of those of the same file."""
    return files.join(new.select(*FILE), FILE, "left_anti").unionByName(new)


def drop_files(files: DataFrame, gone: DataFrame) -> DataFrame:
    """files, or symbols of files, without those of the files that are gone."""
    return files.join(gone.select(*FILE).distinct(), FILE, "left_anti")


def count_files(files: DataFrame) -> DataFrame:
    """(repository_id, n_files, n_bytes)."""
    return files.groupBy("repository_id").agg(F.count("*").alias("n_files"), F.sum(F.octet_length("content")).cast("long").alias("n_bytes"))


def replace_symbols(symbols: DataFrame, of: DataFrame, new: DataFrame) -> DataFrame:
    """symbols with those of some files replaced; a file that has none any more loses its old ones."""
    return drop_files(symbols, of).unionByName(new)


def symbols_of(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols of these files alone."""
    return symbols.join(files.select(*FILE).distinct(), FILE, "left_semi")


def count_symbols(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, path, n_symbols) of every file, 0 for those without."""
    n = symbols.groupBy(*FILE).agg(F.count("*").alias("n"))
    return files.select(*FILE).join(n, FILE, "left").select(*FILE, F.coalesce("n", F.lit(0)).alias("n_symbols"))


def file_info(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repository_id, path, language, n_bytes, n_symbols) of every file."""
    own = files.select(*FILE, "language", F.octet_length("content").cast("long").alias("n_bytes"))
    return own.join(count_symbols(symbols, files), FILE)


def symbol_info(symbols: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """(repository_id, path, name, kind, language) of the symbols of a name; the language of a file that is not stored is 'unknown'."""
    hit = symbols.where(F.col("name") == name)
    return hit.join(files.select(*FILE, "language"), FILE, "left").select(*FILE, "name", "kind", F.coalesce("language", F.lit("unknown")).alias("language"))


def symbol_paths(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, path, name, kind): symbols of files that are stored, with their paths by file id."""
    ids = files.select(F.xxhash64(*FILE).alias("file_id"), *FILE)
    return symbols.select(F.xxhash64(*FILE).alias("file_id"), "name", "kind").join(ids, "file_id").select(*FILE, "name", "kind")


def orphans(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among the known ones; a null key is known nowhere."""
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")


def search_names(rows: DataFrame, name: str, parts: list[str], most: int) -> DataFrame:
    """The first rows by name that hold all parts in it, without regard to case."""
    for p in parts:
        rows = rows.where(F.contains(F.lower(name), F.lit(p.lower())))
    return rows.orderBy(name, *[c for c in rows.columns if c != name]).limit(most)


# --- repositories ----------------------------------------------------------------------------------


def register(registry: DataFrame, new: DataFrame) -> DataFrame:
    """registry (repository_id, path, registered_at) with new ones; a known one takes the new path and keeps its time."""
    known = registry.select("repository_id", F.col("registered_at").alias("__at"))
    fresh = new.join(known, "repository_id", "left").withColumn("registered_at", F.coalesce("__at", "registered_at")).drop("__at")
    return registry.join(new.select("repository_id"), "repository_id", "left_anti").unionByName(fresh.select(registry.columns))


def registered(registry: DataFrame) -> DataFrame:
    return registry.orderBy("registered_at", "repository_id").select("repository_id", "path")


def repositories(files: DataFrame) -> DataFrame:
    return files.where("repository_id <> ''").select("repository_id").distinct()


def unregister(registry: DataFrame, files: DataFrame, repository: str) -> tuple[DataFrame, DataFrame]:
    """(registry, files) without a repository."""
    keep = F.col("repository_id") != repository
    return registry.where(keep), files.where(keep)


# --- memory ----------------------------------------------------------------------------------------


def remember(memory: DataFrame, new: DataFrame) -> DataFrame:
    """memory (namespace, key, value, created_at) with new rows in place of those of the same key; of new rows of a key the latest."""
    both = memory.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = F.struct("value", "created_at")
    best = both.groupBy("namespace", "key").agg(F.max_by(rest, F.struct("__new", "created_at", "value")).alias("b"))
    return best.select("namespace", "key", "b.value", "b.created_at")


def recall(memory: DataFrame, namespace: str, key: str) -> DataFrame:
    return memory.where((F.col("namespace") == namespace) & (F.col("key") == key))


def search_memory(memory: DataFrame, namespace: str, query: str, most: int) -> DataFrame:
    """The first rows of a namespace, by key, whose key or value is like %query%, without regard to case."""
    like = F.col("key").ilike(f"%{query}%") | F.col("value").ilike(f"%{query}%")
    return memory.where((F.col("namespace") == namespace) & like).orderBy("key").limit(most)


def forget(memory: DataFrame, namespace: str, key: str) -> DataFrame:
    return memory.where(~((F.col("namespace") == namespace) & (F.col("key") == key)))


# --- seeds, workspaces, spilled texts ---------------------------------------------------------------


def seeds(files: DataFrame) -> DataFrame:
    """(category, key, value, confidence, source, repository_id): knowledge from a repository's first readme and its decision records."""
    rank = F.array_position(F.array(*map(F.lit, SEED_NAMES)), F.col("path"))
    readme = files.where(rank > 0).groupBy("repository_id").agg(F.min_by(F.struct("path", "content"), rank).alias("r"))
    first = readme.select(F.lit("docs").alias("category"), F.col("r.path").alias("key"), F.substring("r.content", 1, SEED_CHARS).alias("value"), F.lit(0.9).alias("confidence"), F.lit("bootstrap").alias("source"), "repository_id")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    records = files.where(folder.isin(*SEED_FOLDERS) & F.col("path").endswith(".md"))
    return first.unionByName(records.select(F.lit("adr").alias("category"), F.col("path").alias("key"), F.col("content").alias("value"), F.lit(1.0).alias("confidence"), F.lit("bootstrap").alias("source"), "repository_id"))


def canonical_readme(files: DataFrame) -> DataFrame:
    """(repository_id, path): the first file named readme.md in any case, else the first of all, by path."""
    name = F.lower(F.substring_index("path", "/", -1))
    return files.groupBy("repository_id").agg(F.coalesce(F.min(F.when(name == "readme.md", F.col("path"))), F.min("path")).alias("path"))


def workspace_packages(files: DataFrame) -> DataFrame:
    """(repository_id, package) of the lists in pnpm-workspace.yaml; x/* names the folders right under x that hold files."""
    lines = files.where("path = 'pnpm-workspace.yaml'").select("repository_id", F.transform(F.split("content", "\n"), lambda x: F.trim(x)).alias("lines"))
    step = lambda s, x: F.when(s["state"] == 0, F.struct(F.when(x.startswith("packages:"), 1).otherwise(0).alias("state"), s["found"].alias("found"))).when((s["state"] == 1) & x.startswith("- "), F.struct(F.lit(1).alias("state"), F.concat(s["found"], F.array(F.regexp_replace(F.trim(F.substr(x, F.lit(3))), r"""^["']+|["']+$""", ""))).alias("found"))).when((s["state"] == 1) & (x != "") & ~x.startswith("#") & ~x.startswith("-"), F.struct(F.lit(2).alias("state"), s["found"].alias("found"))).otherwise(s)
    found = F.aggregate("lines", F.struct(F.lit(0).alias("state"), F.array().cast("array<string>").alias("found")), step, lambda s: s["found"])
    globs = lines.select("repository_id", F.explode(found).alias("glob"))
    plain = globs.where(~F.col("glob").endswith("/*")).select("repository_id", F.col("glob").alias("package"))
    parts = F.split("path", "/")
    folders = files.select("repository_id", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.when(i < F.size(parts), F.struct(F.array_join(F.slice(parts, 1, i - 1), "/").alias("base"), F.array_join(F.slice(parts, 1, i), "/").alias("package"))))).alias("f")).where("f is not null").select("repository_id", "f.base", "f.package").distinct()
    stars = globs.where(F.col("glob").endswith("/*")).select("repository_id", F.expr("substring(glob, 1, length(glob) - 2)").alias("base"))
    return plain.unionByName(folders.join(stars, ["repository_id", "base"]).select("repository_id", "package"))


def spill_key(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def spill(texts: DataFrame) -> DataFrame:
    """(key, text): full texts by the key that a shortened one points to; equal texts once."""
    return texts.select(spill_key(F.col("text")).alias("key"), "text").distinct()


def original(spilled: DataFrame, key: str) -> DataFrame:
    return spilled.where(F.col("key") == key).select("text")


# --- usage, counters -------------------------------------------------------------------------------


def usage(rows: DataFrame, by: str, tokens: str, cost: str) -> DataFrame:
    """(by, n, tokens, cost): requests and sums of each kind; sums of nothing are 0."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost"))


def counter(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def top(rows: DataFrame, by: str, most: int) -> DataFrame:
    """The most frequent values, by count and then name; a report of so many rows."""
    return counter(rows, by).orderBy(F.desc("n"), by).limit(most)


def shares(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, share): how often each value occurs, and in what share of the rows."""
    n = counter(rows, by)
    total = n.agg(F.sum("n").alias("__total"))  # one row
    return n.crossJoin(F.broadcast(total)).select(by, "n", (F.col("n") / F.col("__total")).alias("share"))


def best_of(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key in an order, with their rank; Spark keeps `most` rows a key and task before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)
