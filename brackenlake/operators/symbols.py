"""Symbols by patterns, and structural search by patterns with placeholders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store

_VIS = r"(?:(?:pub|public|private|protected|internal)\s+)?"
_MOD = r"(?:(?:export|declare|default|async|static|abstract|sealed)\s+)*"
#: Of each kind a pattern whose first group is the name.
PATTERNS = {
    "function": rf"(?m)^\s*{_VIS}{_MOD}(?:fn|def|function|func)\s+(\w+)",
    "arrow": rf"(?m)^\s*{_VIS}{_MOD}(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\()",
    "struct": rf"(?m)^\s*{_VIS}{_MOD}(?:struct|class|interface)\s+(\w+)",
    "enum": rf"(?m)^\s*{_VIS}{_MOD}enum\s+(\w+)",
    "impl": r"(?m)^impl(?:<[^>]*>)?\s+(\w+)",
    "trait": rf"(?m)^{_VIS}trait\s+(\w+)",
    "type": rf"(?m)^{_VIS}{_MOD}type\s+(\w+)",
}


def names(content) -> Column:
    """Distinct names of all symbols of a text, in order."""
    found = F.flatten(F.array(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in PATTERNS.values()]))
    return F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))))


def symbols(corpus: DataFrame) -> DataFrame:
    """(repository_id, path, name, kind) found by the patterns; a name comes out once a kind and file."""
    kinds = F.array(*[F.struct(F.lit("function" if k == "arrow" else k).alias("kind"), F.regexp_extract_all("content", F.lit(p), F.lit(1)).alias("names")) for k, p in PATTERNS.items()])
    each = corpus.select("repository_id", "path", F.explode(kinds).alias("s"))
    return each.select("repository_id", "path", F.explode("s.names").alias("name"), "s.kind").distinct()


def find(symbols_: DataFrame, words: list[str], most: int) -> DataFrame:
    """Symbols whose name holds one of the words, without regard to case; up to six words of three bytes or more count."""
    some = [w for w in words if len(w.encode()) >= 3][:6]
    if not some:
        return symbols_.limit(0)
    return symbols_.where(F.lower("name").rlike("|".join(re.escape(w.lower()) for w in some))).orderBy("repository_id", "path", "name", "kind").limit(most)


def find_each(symbols_: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(query_id, repository_id, path, name, kind, n): of each query (query_id, words) the first `most` symbols that find() gives.

    Names and words meet by an equal join of three letters in a row: those a word begins with, and
    all that a name has; a name that has them is then looked at whole. Words of fewer letters (of
    several bytes each) meet by what they have. Words go to the names unless there are more than are sent.
    """
    some = F.slice(F.filter("words", lambda w: F.octet_length(w) >= 3), 1, 6)
    words = store.cut(queries.select("query_id", F.explode(F.transform(some, lambda w: F.lower(w))).alias("word")).distinct())
    low = symbols_.withColumn("low", F.lower("name"))
    lengths = [3, *[n for n in (1, 2) if not words.where(F.length("word") == n).isEmpty()]]
    gram = lambda n: F.when(F.length("low") >= n, F.transform(F.sequence(F.lit(1), F.length("low") - n + 1), lambda i: F.substr("low", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = F.array_distinct(F.flatten(F.array(*map(gram, lengths))))
    asked = words.select("query_id", "word", F.substr("word", F.lit(1), F.lit(3)).alias("gram"))
    hit = low.withColumn("gram", F.explode(grams)).join(store.sent(asked), "gram").where(F.contains("low", F.col("word")))
    w = Window.partitionBy("query_id").orderBy("repository_id", "path", "name", "kind")
    found = hit.select("query_id", "repository_id", "path", "name", "kind").distinct()
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def compile_pattern(pattern: str) -> tuple[str, list[str]]:
    """A structural pattern as a regular expression, and its placeholders' names: $NAME is one token or bracketed part, $$$NAME anything."""
    out, names, at = [], [], 0
    for m in re.finditer(r"\$\$\$([A-Z_]*)|\$([A-Z_]+)", pattern):
        out.append(_literal(pattern[at : m.start()]))
        out.append("(.*?)" if m[0].startswith("$$$") else r"([\w.:<>\[\]&*]+|\([^()]*\))")
        names.append(m[1] if m[0].startswith("$$$") else m[2])
        at = m.end()
    out.append(_literal(pattern[at:]))
    return "".join(out), names


def _literal(s: str) -> str:
    return re.sub(r"(?:\\\s|\s)+", r"\\s+", re.escape(s))


def validate_pattern(pattern: str) -> bool:
    return bool(pattern.strip()) and pattern.count("(") == pattern.count(")") and pattern.count("{") == pattern.count("}")


def structural(corpus: DataFrame, pattern: str) -> DataFrame:
    """(repository_id, path, line, matched, captures, score): the first match of each file.

    Matching is by regular expression, an approximation of matching syntax trees; the score rises
    with the length of the match, with the $ signs of the pattern and with captures, to 1 at most.
    """
    rx, names = compile_pattern(pattern)
    rx = f"(?s){rx}"
    hit = corpus.where(F.col("content").rlike(rx)).withColumn("matched", F.regexp_extract("content", rx, 0))
    before = F.substr("content", F.lit(1), F.position(F.col("matched"), F.col("content")) - 1)
    line = F.size(F.split(before, "\n"))
    captures = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n or f"_{i}"), F.regexp_extract("content", rx, i + 1))]) if names else F.create_map().cast("map<string,string>")
    n = F.length("matched")
    score = F.least(F.lit(1.0), 0.85 + F.when(n > 100, 0.1).when(n > 50, 0.05).otherwise(0.0) + 0.05 * pattern.count("$") + 0.05 * len(names))
    return hit.select("repository_id", "path", line.alias("line"), "matched", captures.alias("captures"), score.alias("score"))


def structural_in(corpus: DataFrame, candidates: DataFrame, pattern: str) -> DataFrame:
    """structural() in candidate files (repository_id, path) alone; others are not searched."""
    key = ["repository_id", "path"]
    return structural(corpus.join(candidates.select(*key).distinct(), key, "left_semi"), pattern)


#: Words of a request, in order of trial, with the kind that they ask for.
KIND_WORDS = [("function", "function"), ("method", "method"), ("class", "class"), ("struct", "struct"), ("enum", "enum"), ("trait", "trait"), ("interface", "interface"), ("import", "import"), ("impl", "impl"), ("call", "call"), ("type", "type")]


def kind_of(request):
    q = F.lower(request)
    out = None
    for w, k in KIND_WORDS:
        out = F.when(F.contains(q, F.lit(w)), k) if out is None else out.when(F.contains(q, F.lit(w)), k)
    return out
