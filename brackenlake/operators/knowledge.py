"""Knowledge and memory rows: retrieval, ageing, and what is learnt from symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V


def retrieve(knowledge: DataFrame, query: str, least: float = 0.3, repository: str | None = None, category: str | None = None, most: int = 20) -> DataFrame:
    """Rows whose key or value is like %query%, surest first; % and _ in the query are wild."""
    k = knowledge.where((F.col("key").ilike(f"%{query}%") | F.col("value").ilike(f"%{query}%")) & (F.col("confidence") >= least))
    k = k if repository is None else k.where(F.col("repository_id") == repository)
    k = k if category is None else k.where(F.col("category") == category)
    return k.orderBy(F.desc("confidence"), "repository_id", "category", "key").limit(most)


def rows_of(knowledge: DataFrame, category: str | None = None, key: str | None = None, repository: str | None = None) -> DataFrame:
    """Rows of a category, a key and a repository, as far as they are given, surest first."""
    for name, value in (("category", category), ("key", key), ("repository_id", repository)):
        knowledge = knowledge if value is None else knowledge.where(F.col(name) == value)
    return knowledge.orderBy(F.desc("confidence"), "repository_id", "category", "key")


def decay(knowledge: DataFrame, before, by: float) -> DataFrame:
    return knowledge.withColumn("confidence", F.when(F.col("updated_at") < before, F.greatest(F.lit(0.1), F.col("confidence") - by)).otherwise(F.col("confidence")))


def surest(knowledge: DataFrame) -> DataFrame:
    """Of each category, key and repository the row of most confidence."""
    keys = ["category", "key", "repository_id"]
    rest = [c for c in knowledge.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("confidence", "value"))
    return knowledge.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def naming(symbols: DataFrame) -> DataFrame:
    """(repository_id, convention, confidence): the way that more than half of the names of a repository are written."""
    n = F.col("name")
    kind = F.when(F.contains(n, F.lit("_")), "snake_case").when(n.rlike("^[a-z].*[A-Z]"), "camelCase").when(n.rlike("^[A-Z]"), "PascalCase")
    total = symbols.groupBy("repository_id").agg(*[F.avg((kind == k).cast("int")).alias(k) for k in ("snake_case", "camelCase", "PascalCase")])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("convention"), F.coalesce(F.col(k), F.lit(0.0)).alias("share")) for k in ("snake_case", "camelCase", "PascalCase")]))
    return total.select("repository_id", each.alias("c")).where("c.share > 0.5").select("repository_id", "c.convention", F.lit(0.8).alias("confidence"))


def architecture(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, pattern, confidence) by names of symbols and paths."""
    s, p = F.lower("name"), F.lower("path")
    has = lambda c, w: F.max(F.contains(c, F.lit(w)))
    a = symbols.groupBy("repository_id").agg(*[has(s, w).alias(w) for w in ("controller", "service", "repo", "handler", "middleware")])
    b = files.groupBy("repository_id").agg(*[has(p, w).alias(f"f_{w}") for w in ("model", "view", "controller")])
    j = a.join(b, "repository_id", "full_outer").na.fill(False)
    rules = {"controller-service-repository": ("controller and service and repo", 0.9), "mvc": ("f_model and f_view and f_controller", 0.85), "handler": ("handler", 0.7), "middleware": ("middleware", 0.7)}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("pattern"), F.expr(e).alias("on"), F.lit(c).alias("confidence")) for k, (e, c) in rules.items()]))
    return j.select("repository_id", each.alias("r")).where("r.on").select("repository_id", "r.pattern", "r.confidence")


def domain_terms(symbols: DataFrame) -> DataFrame:
    """(repository_id, term, n, confidence) of terms that two names or more hold."""
    terms = F.array(*map(F.lit, V.DOMAIN_TERMS))
    each = symbols.select("repository_id", F.explode(F.filter(terms, lambda t: F.contains(F.lower(F.col("name")), t))).alias("term"))
    n = each.groupBy("repository_id", "term").agg(F.count("*").alias("n")).where("n >= 2")
    return n.withColumn("confidence", F.least(F.col("n") / 10, F.lit(0.9)))


def delete(knowledge: DataFrame, category: str, key: str, repository: str | None = None) -> DataFrame:
    """Rows without those of a category and key, in one repository or in all."""
    hit = (F.col("category") == category) & (F.col("key") == key)
    hit = hit if repository is None else hit & (F.col("repository_id") == repository)
    return knowledge.where(~hit)


def is_initialised(knowledge: DataFrame, repository: str) -> bool:
    return not knowledge.where(F.col("repository_id") == repository).isEmpty()


def extract(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, category, key, confidence): conventions, architecture and terms of repositories as knowledge."""
    of = lambda df, category, key: df.select("repository_id", F.lit(category).alias("category"), F.col(key).alias("key"), F.col("confidence").cast("double").alias("confidence"))
    parts = of(naming(symbols), "convention", "convention"), of(architecture(symbols, files), "architecture", "pattern"), of(domain_terms(symbols), "domain", "term")
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
