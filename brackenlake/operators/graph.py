"""Imports, dependency and call graphs, impact. Every file is named by repository_id and path."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from . import store

FILE = ["repository_id", "path"]
#: Endings that an import of each language is tried with, best first; {p} is the path that it names.
CANDIDATES = {
    "rust": ["{p}.rs", "{p}/mod.rs"],
    "script": ["{p}", "{p}.ts", "{p}.tsx", "{p}.js", "{p}.jsx", "{p}.mts", "{p}.cts", "{p}/index.ts", "{p}/index.tsx", "{p}/index.js", "{p}/index.jsx"],
    "python": ["{p}/__init__.py", "{p}.py"],
}
SCRIPTS = ("typescript", "javascript", "tsx", "jsx")


def imports(corpus: DataFrame) -> DataFrame:
    """(repository_id, path, language, source): what files import: use and mod of Rust, import and from of scripts and Python, by line."""
    lines = corpus.select(*FILE, "language", F.explode(F.split("content", "\n")).alias("line")).withColumn("line", F.trim("line"))
    rust = F.regexp_extract("line", r"^(?:pub )?use ([A-Za-z0-9_:]+)", 1)
    mod = F.regexp_extract("line", r"^(?:pub )?mod ([A-Za-z0-9_]+)\s*;", 1)
    script = F.regexp_extract("line", r"^(?:import|export)\b.*?[\"']([^\"']+)[\"']", 1)
    py = F.coalesce(F.nullif(F.regexp_extract("line", r"^from ([A-Za-z0-9_.]+) import", 1), F.lit("")), F.regexp_extract("line", r"^import ([A-Za-z0-9_.]+)", 1))
    source = F.when(F.col("language") == "rust", F.when(mod != "", mod).otherwise(rust)).when(F.col("language") == "python", py).when(F.col("language").isin(*SCRIPTS), script)
    return lines.select(*FILE, "language", source.alias("source")).where("source <> ''").distinct()


def candidates(imports_: DataFrame) -> DataFrame:
    """(repository_id, path, source, n, k, dst): every path that an import may name, the longest first, then by ending; outer modules name none."""
    rust, python = F.col("language") == "rust", F.col("language") == "python"
    inner = F.regexp_replace("source", "^(?:(?:crate|self|super)::)+", "")
    parts = F.when(rust, F.split(inner, "::")).otherwise(F.split("source", r"\."))
    outer = F.col("source").rlike("^(?:std|core|alloc)(?:::|$)")
    bare = F.regexp_replace("source", r"^(?:\./)*(?:\.\./)*", "")
    path_like = F.array(F.struct(F.lit(0).alias("n"), bare.alias("p")))
    dotted = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct((F.size(parts) - i).alias("n"), F.array_join(F.slice(parts, 1, i), "/").alias("p")))
    tried = imports_.where(~(rust & outer)).where(rust | python | F.col("source").rlike(r"^[./]"))
    tried = tried.select(*FILE, "source", "language", F.explode(F.when(rust | python, dotted).otherwise(path_like)).alias("c"))
    endings = F.create_map(*[x for k, v in CANDIDATES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    kind = F.when(rust | python, F.col("language")).otherwise("script")
    tried = tried.select(*FILE, "source", F.col("c.n").alias("n"), F.col("c.p").alias("p"), F.posexplode(endings[kind]).alias("k", "e"))
    return tried.select(*FILE, "source", "n", "k", F.replace("e", F.lit("{p}"), F.col("p")).alias("dst"))


def chosen(tried: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, path, source, dst): of each import the first candidate that is a file of its own repository; of one without, no row."""
    found = tried.join(files.select("repository_id", F.col("path").alias("dst")).distinct(), ["repository_id", "dst"])
    return found.groupBy(*FILE, "source").agg(F.min_by("dst", F.struct("n", "k")).alias("dst"))


def resolve(imports_: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, path, source, dst): each import to the first file of its own repository that it may name."""
    return chosen(candidates(imports_), files)


def refresh(tried: DataFrame, resolved: DataFrame, before: DataFrame, changed: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, resolved imports) after a change, from those before it.

    changed holds the changed and new files whole, before and deleted (repository_id, path). Imports
    of changed files are read anew. An import of an untouched file is resolved again only if one of
    its candidates is a file that came or went; all others stay, so what is computed grows with the
    change and with the imports that it touches.
    """
    touched = changed.select(*FILE).unionByName(deleted.select(*FILE)).distinct()
    came = changed.select(*FILE).join(before.select(*FILE), FILE, "left_anti")
    moved = store.cut(came.unionByName(deleted.select(*FILE)).distinct())
    now = before.select(*FILE).join(deleted.select(*FILE), FILE, "left_anti").unionByName(came)
    kept = tried.join(touched, FILE, "left_anti")
    new = store.cut(candidates(imports(changed)))
    again = kept.join(moved.select("repository_id", F.col("path").alias("dst")), ["repository_id", "dst"], "left_semi").select(*FILE, "source").distinct()
    again = store.cut(again)
    redo = new.unionByName(kept.join(again, [*FILE, "source"], "left_semi"))
    stay = resolved.join(touched, FILE, "left_anti").join(again, [*FILE, "source"], "left_anti")
    return kept.unionByName(new), stay.unionByName(chosen(redo, now))


def edges_of(resolved: DataFrame) -> DataFrame:
    """(repository_id, src, dst) of resolved imports, those of a file by itself aside."""
    return resolved.where("path <> dst").select("repository_id", F.col("path").alias("src"), "dst").distinct()


def dependencies(corpus: DataFrame) -> DataFrame:
    """(repository_id, src, dst): the files that each file imports, itself aside."""
    return edges_of(resolve(imports(corpus), corpus))


def dependencies_from(corpus: DataFrame, some: DataFrame) -> DataFrame:
    """The edges of dependencies() that begin at some files (repository_id, path).

    Imports of those files alone are taken, and tried against all files of the corpus. Both tables
    are sent to the corpus if they are small; no text is shuffled if they are not.
    """
    of = store.cut(some.select(*FILE).distinct())
    few = of.limit(store.SENT + 1).count() <= store.SENT
    own = imports(corpus.join(F.broadcast(of), FILE, "left_semi")) if few else imports(corpus).join(of, FILE, "left_semi")
    tried = store.cut(candidates(own))
    named = store.sent(store.cut(tried.select("repository_id", F.col("dst").alias("path")).distinct()))
    return edges_of(chosen(tried, corpus.select(*FILE).join(named, FILE, "left_semi")))


def dependents(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(repository_id, path) of files with an edge to one of these."""
    ends = of.select("repository_id", F.col("path").alias("dst"))
    return edges.join(ends, ["repository_id", "dst"], "left_semi").select("repository_id", F.col("src").alias("path")).distinct()


def dependencies_of(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(repository_id, path) of files that these have an edge to."""
    starts = of.select("repository_id", F.col("path").alias("src"))
    return edges.join(starts, ["repository_id", "src"], "left_semi").select("repository_id", F.col("dst").alias("path")).distinct()


#: Edges of a repository up to which one task follows them, after a count.
ALONE = 1 << 20


def _reached(edges: pd.DataFrame, start: pd.DataFrame) -> np.ndarray:
    """Names that reach one of the start names over edges of one repository."""
    code, names = pd.factorize(np.concatenate([edges["src"].to_numpy(), edges["dst"].to_numpy()]))
    src, dst = code[: len(edges)], code[len(edges) :]
    order = np.argsort(dst, kind="stable")
    src, begins = src[order], np.searchsorted(dst[order], np.arange(len(names) + 1))
    seen = np.zeros(len(names), bool)
    front = np.flatnonzero(np.isin(names, start["path"].unique()))
    while len(front):
        n = begins[front + 1] - begins[front]
        ends = np.cumsum(n)
        next_ = np.unique(src[np.arange(ends[-1]) + np.repeat(begins[front] - (ends - n), n)]) if len(ends) and ends[-1] else np.empty(0, int)
        front = next_[~seen[next_]]
        seen[front] = True
    return names[seen]


def impact(edges: DataFrame, start: DataFrame, growth: int = 4, alone: int = ALONE) -> DataFrame:
    """Files that depend on the start files, directly or not; a start file only if a cycle leads back.

    A repository of at most `alone` edges is followed by one task, each edge once. Larger ones go by
    paths that double in length (doubled()).
    """
    edges = store.cut(edges.select("repository_id", "src", "dst").distinct())
    size = edges.groupBy("repository_id").agg(F.count("*").alias("n"))
    large = store.cut(size.where(F.col("n") > alone).select("repository_id"))
    some = not large.isEmpty()
    small = edges.join(large, "repository_id", "left_anti") if some else edges

    def follow(key, e, s):
        return pd.DataFrame({"repository_id": key[0], "path": _reached(e, s)})

    out = small.groupBy("repository_id").cogroup(start.select(*FILE).groupBy("repository_id")).applyInPandas(follow, "repository_id string, path string")
    return out.unionByName(doubled(edges.join(large, "repository_id", "left_semi"), start, growth)) if some else out


def doubled(edges: DataFrame, start: DataFrame, growth: int = 4) -> DataFrame:
    """impact() by joins alone, however large the graph is.

    The paths of a round are twice as long as those of the round before: edges are joined with
    themselves, so a chain of n imports takes about log2(n) rounds, and a cycle ends when nothing
    new is reached. Where that would make more than `growth` times as many pairs as there are edges,
    paths stay as long as they are, and rounds go on with them.
    """
    steps = store.cut(edges.select("repository_id", "src", "dst").distinct())  # paths of 2 ** round edges
    most = growth * steps.count()
    seen = store.cut(dependents(steps, start))  # by 1 to 2 ** round edges
    known, longer = seen.count(), True
    while known:
        reached = dependents(steps, seen)
        seen = store.cut(seen.unionByName(reached).distinct())
        now = seen.count()
        if now == known:
            break
        known = now
        if longer:
            second = steps.select("repository_id", F.col("src").alias("dst"), F.col("dst").alias("end"))
            twice = steps.join(second, ["repository_id", "dst"]).select("repository_id", "src", F.col("end").alias("dst")).distinct()
            twice = store.cut(twice.limit(most + 1))
            longer = twice.count() <= most
            steps = twice if longer else steps
    return seen


def degrees(edges: DataFrame) -> DataFrame:
    """(repository_id, path, n_out, n_in) of every file with an edge: what it depends on and what depends on it."""
    ends = F.array(F.struct(F.col("src").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return edges.select("repository_id", F.explode(ends).alias("e")).groupBy("repository_id", "e.path").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))


def graph_boost(ranked: DataFrame, edges: DataFrame, factor: float = V.GRAPH_BOOST, anchors: int = 3) -> DataFrame:
    """Scores of files that an edge joins to one of the first files of their query, raised; those first files stay.

    ranked: (query_id, repository_id, path, score, rank), a bounded number of rows a query; a query
    of one file raises nothing, as its file is the anchor.
    """
    key = ["query_id", *FILE]
    top = ranked.where(F.col("rank") <= anchors).select("query_id", "repository_id", F.col("path").alias("src"))
    both = edges.select("repository_id", "src", "dst").unionByName(edges.select("repository_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = both.join(top, ["repository_id", "src"]).select("query_id", "repository_id", F.col("dst").alias("path")).distinct().withColumn("near", F.lit(True))
    raised = F.when(F.col("near") & (F.col("rank") > anchors), F.col("score") * factor).otherwise(F.col("score"))
    return ranked.join(near, key, "left").withColumn("score", raised).drop("near")


def store_edges(edges: DataFrame, path: str) -> None:
    """The graph as a table of edges, by repository; the repositories that edges has are replaced."""
    edges.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repository_id").parquet(path)


def load_edges(spark: SparkSession, path: str, repository: str | None = None) -> DataFrame:
    """Stored edges, of one repository's partition or of all."""
    edges = spark.read.schema("src string, dst string, repository_id string").parquet(path)
    return edges if repository is None else edges.where(F.col("repository_id") == repository)


# --- functions and calls ---------------------------------------------------------------------------

#: Beginnings of definitions in several languages; the one group is the name.
DEFINITIONS = (
    r"\bfn\s+(\w+)\s*\(",
    r"\bdef\s+(\w+)\s*\(",
    r"\bfunction\s+(\w+)\s*\(",
    r"\b(?:public|private|protected|internal)\s+(?:static\s+)?(?:async\s+|final\s+)?(?:void|bool|boolean|int|long|float|double|string|String|var|IEnumerable|Task|ValueTask|IActionResult|ActionResult|ObjectResult)\s+(\w+)\s*\(",
)
MOST_LINES = 2000


def definitions(corpus: DataFrame) -> DataFrame:
    """(repository_id, path, name, start, end): functions with their lines, from 1, both included.

    A function ends on the line where the braces that it opens are closed; without braces, or if
    they stay open, on the file's last line; 2000 lines after its start at most. All in the file's row.
    """
    lines = F.split("content", "\n")
    named = lambda p: F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, p, 1).alias("name")))
    names = F.flatten(F.array(*map(named, DEFINITIONS)))
    braces = F.flatten(F.transform(lines, lambda x, i: F.transform(F.filter(F.split(x, ""), lambda c: c.isin("{", "}")), lambda c: F.struct(i.alias("i"), F.when(c == "{", 1).otherwise(-1).alias("d")))))
    f = corpus.select(*FILE, F.size(lines).alias("n"), F.filter(names, lambda x: x["name"] != "").alias("found"), braces.alias("braces"))
    f = f.select(*FILE, "n", "braces", F.explode("found").alias("f")).select(*FILE, "n", "f.name", F.col("f.i").alias("i"), F.filter("braces", lambda b: b["i"] >= F.col("f.i")).alias("braces"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("int").alias("end"))
    step = lambda s, b: F.when(s["end"].isNotNull(), s).otherwise(F.struct((s["depth"] + b["d"]).alias("depth"), F.when((b["d"] < 0) & (s["depth"] == 1), b["i"]).alias("end")))
    end = F.aggregate("braces", start, step, lambda s: s["end"])
    last = F.least(F.coalesce(end + 1, F.col("n")), F.col("i") + 1 + MOST_LINES)
    return f.select(*FILE, "name", (F.col("i") + 1).alias("start"), last.alias("end")).distinct()


def calls(corpus: DataFrame) -> DataFrame:
    """(repository_id, path, line, callee): names of two letters or more before a bracket, keywords aside; not those of definitions."""
    lines = corpus.select(*FILE, F.posexplode(F.split("content", "\n")).alias("i", "text"))
    defined = F.array(*[F.regexp_extract("text", p, 1) for p in DEFINITIONS])
    name = F.explode(F.array_except(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)), defined))
    return lines.select(*FILE, (F.col("i") + 1).alias("line"), name.alias("callee")).where(~F.col("callee").isin(V.CALL_KEYWORDS) & (F.length("callee") > 1))


def call_edges(calls_: DataFrame, functions: DataFrame) -> DataFrame:
    """(repository_id, caller_path, caller, callee_path, callee): calls, in the innermost function that holds their line, to the first definition of their name.

    A call outside of functions has the caller 'unknown'; of definitions of one name the first by
    path and line counts; calls of names that the repository does not define are left out.
    """
    f = functions.select(*FILE, F.col("name").alias("caller"), "start", "end")
    inside = calls_.distinct().join(f, FILE, "left").where("start is null or line between start and end")
    inner = inside.groupBy(*FILE, "line", "callee").agg(F.max_by("caller", F.struct("start", "caller")).alias("caller"))
    all_ = calls_.distinct().join(inner, [*FILE, "line", "callee"], "left").withColumn("caller", F.coalesce("caller", F.lit("unknown")))
    first = functions.groupBy("repository_id", F.col("name").alias("callee")).agg(F.min("path").alias("callee_path"))
    out = all_.join(first, ["repository_id", "callee"])
    return out.select("repository_id", F.col("path").alias("caller_path"), "caller", "callee_path", "callee").distinct()


def callers_of(edges: DataFrame, name: Column | str) -> DataFrame:
    return edges.where(F.col("callee") == name).select("repository_id", "caller_path", "caller").distinct()


def callees_of(edges: DataFrame, name: Column | str) -> DataFrame:
    return edges.where(F.col("caller") == name).select("repository_id", "callee_path", "callee").distinct()


def definitions_in(functions: DataFrame, path: Column | str) -> DataFrame:
    return functions.where(F.col("path") == path)


