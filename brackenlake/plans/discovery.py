"""What a repository is made of: languages, folders, frameworks, commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

#: Folders that are named in a profile, in order; names of a script's frameworks; how many languages.
FOLDERS = ("src", "crates", "lib", "packages", "apps", "services", "docs", "tests", "test", "scripts", "benches", "examples", "deploy")
SCRIPT_FRAMEWORKS = ("react", "vue", "svelte", "next", "express", "@nestjs/core")
LANGUAGES = 10
#: Files that tell the tools of their folder.
MANIFESTS = ("Cargo.toml", "package.json", "go.mod", "pyproject.toml", "requirements.txt", "setup.py", "pom.xml", "build.gradle", "build.gradle.kts", "Makefile", "makefile")
_SKIPPED = r"^(?:\.|node_modules/|target/|dist/|build/|vendor/|coverage/|obj/|bin/)"
#: What a manifest says: place in the order of trial, framework, build and test command.
_SAYS = "array<struct<at:int,framework:string,build:string,test:string>>"


def _said() -> Column:
    """What the manifests of one folder say, in order; has tells which there are, the texts are those of two of them."""
    say = lambda at, name, build=None, test=None: F.struct(F.lit(at).alias("at"), F.lit(name).cast("string").alias("framework"), (build if isinstance(build, Column) else F.lit(build)).cast("string").alias("build"), (test if isinstance(test, Column) else F.lit(test)).cast("string").alias("test"))
    has = lambda *names: F.arrays_overlap("has", F.array(*map(F.lit, names)))
    node = F.from_json("package", "dependencies map<string,string>, devDependencies map<string,string>, scripts map<string,string>")
    needs = lambda name: F.coalesce(F.map_contains_key(node["dependencies"], name), F.lit(False)) | F.coalesce(F.map_contains_key(node["devDependencies"], name), F.lit(False))
    script = lambda name: F.try_element_at(node["scripts"], F.lit(name))
    project = F.coalesce("project", F.lit(""))
    poetry = F.contains(project, F.lit("[tool.poetry]"))
    python = has("pyproject.toml", "requirements.txt", "setup.py")
    maven, gradle = has("pom.xml"), has("build.gradle", "build.gradle.kts")
    rules = [
        (has("Cargo.toml"), say(0, "cargo", "cargo build", "cargo test")),
        (has("Cargo.toml") & F.contains(F.coalesce("cargo", F.lit("")), F.lit("[workspace]")), say(1, "rust-workspace")),
        (has("package.json"), say(2, "node", script("build"), F.coalesce(script("test"), F.lit("npm test")))),
        *[(has("package.json") & needs(x), say(3 + i, x.lstrip("@").replace("/", "-"))) for i, x in enumerate(SCRIPT_FRAMEWORKS)],
        (has("go.mod"), say(10, "go-modules", "go build ./...", "go test ./...")),
        (python, say(11, "python")),
        (python & poetry, say(12, "poetry", None, "poetry run pytest")),
        (python & ~poetry & F.contains(project, F.lit("[tool.uv]")), say(12, "uv")),
        (python, say(13, None, None, "pytest")),
        (maven, say(14, "maven", "mvn package", "mvn test")),
        (~maven & gradle, say(14, "gradle", "gradle build", "gradle test")),
        (has("Makefile", "makefile"), say(15, "make", "make", "make test")),
    ]
    return F.filter(F.array(*[F.when(on, x) for on, x in rules]), lambda x: x.isNotNull())


def stack(files: DataFrame) -> DataFrame:
    """(repository_id, frameworks, build, test): by the manifests of the root and of folders one below, in that order.

    The first command counts; make stands in only if nothing before it gave one.
    """
    name = paths.filename(F.col("path"))
    folder = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise("")
    near = files.where(name.isin(*MANIFESTS) & (F.size(F.split("path", "/")) <= 2) & ~F.col("path").rlike(_SKIPPED))
    text = lambda x: F.max(F.when(F.col("name") == x, F.col("content")))
    each = near.select("repository_id", folder.alias("folder"), name.alias("name"), "content").groupBy("repository_id", "folder")
    each = each.agg(F.collect_set("name").alias("has"), text("Cargo.toml").alias("cargo"), text("package.json").alias("package"), text("pyproject.toml").alias("project"))
    said = each.select("repository_id", "folder", _said().cast(_SAYS).alias("said"))
    every = said.groupBy("repository_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("folder", "said"))), lambda x: x["said"])).alias("said"))
    start = F.struct(F.lit(None).cast("string").alias("build"), F.lit(None).cast("string").alias("test"))
    free = lambda s, x: (x["framework"].isNull() | (x["framework"] != "make")) | (s["build"].isNull() & s["test"].isNull())
    step = lambda s, x: F.when(free(s, x), F.struct(F.coalesce(s["build"], x["build"]).alias("build"), F.coalesce(s["test"], x["test"]).alias("test"))).otherwise(s)
    found = F.aggregate("said", start, step)
    names = F.array_distinct(F.filter(F.transform("said", lambda x: x["framework"]), lambda x: x.isNotNull()))
    return every.select("repository_id", names.alias("frameworks"), found.alias("f")).select("repository_id", "frameworks", "f.build", "f.test")


def profile(files: DataFrame) -> DataFrame:
    """(repository_id, languages, folders, frameworks, build, test) of every repository: its most frequent languages with their files, named folders of its root, and its stack."""
    inside = files.where(~F.col("path").rlike(_SKIPPED) & ~F.col("path").rlike("/(?:node_modules|target|dist|build|vendor|coverage|obj|bin)/"))
    ending = F.regexp_extract(paths.filename(F.col("path")), r"^.+\.([^.]+)$", 1)
    n = inside.select("repository_id", paths.language(F.concat(F.lit("x."), F.lower(ending))).alias("language")).where("language is not null").groupBy("repository_id", "language").agg(F.count("*").alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "language")))  # languages that are known, at most
    languages = n.groupBy("repository_id").agg(F.slice(order, 1, LANGUAGES).alias("l")).select("repository_id", F.transform("l", lambda x: F.struct(x["language"].alias("language"), (-x["less"]).alias("n"))).alias("languages"))
    tops = files.where(F.contains("path", F.lit("/"))).groupBy("repository_id").agg(F.collect_set(F.when(F.substring_index("path", "/", 1).isin(*FOLDERS), F.substring_index("path", "/", 1))).alias("tops"))
    folders = tops.select("repository_id", F.array_intersect(F.array(*map(F.lit, FOLDERS)), "tops").alias("folders"))
    out = files.select("repository_id").distinct()
    for part in (languages, folders, stack(files)):
        out = out.join(part, "repository_id", "left")
    return out


def profile_json(profiles: DataFrame) -> DataFrame:
    """(repository_id, profile): each profile as one JSON text, nulls too."""
    return profiles.select("repository_id", F.to_json(F.struct(*[c for c in profiles.columns if c != "repository_id"]), {"ignoreNullFields": "false"}).alias("profile"))
