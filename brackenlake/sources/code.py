"""A corpus of code made from the document table by expressions: files whose imports, symbols and calls follow from doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import table

#: Files by (doc_id div 2) modulo 5: condition, path, language, content; {n} is the doc_id, {n-10} an earlier one of the same repository and kind.
FILES = [
    ("k = 0", "m{n}.rs", "rust", """use std::collections::HashMap;
use crate::m{n-10}::inner;
use crate::lib::m{n-8}::Service{n-8};
mod m{n-20};
/// Runs.
pub struct Order{n} {
    count: u32,
}
impl Order{n} {
    pub fn run_{n}(x: u32) -> u32 {
        if check_item(x) {
            step_{n}(x);
        }
        run_{n-10}(x)
    }
}
fn step_{n}(x: u32) {
    for i in 0..x { check_item(i); }
}
"""),
    ("k = 0 AND n % 3 = 0", "m{n}/inner.rs", "rust", """use super::m{n};
pub fn check_item(x: u32) -> bool {
    x > 1
}
pub enum Kind{n} { One, Two }
"""),
    ("k = 1", "lib/m{n}/mod.rs", "rust", """use crate::lib::m{n-10};
pub struct Service{n};
pub trait Handle{n} {
    fn handle_{n}(x: u32);
}
"""),
    ("k = 2", "pkg/p{n}.py", "python", """import os
import pkg.p{n-10}
from pkg.p{n-20}.extra import user_session_{n-20}

class UserModel{n}:
    def load_{n}(self, x):
        return load_{n-10}(x)

def user_session_{n}(x):
    return print(x)
"""),
    ("k = 2 AND n % 3 = 0", "pkg/p{n}/__init__.py", "python", """from pkg.p{n} import user_session_{n}
"""),
    ("k = 3", "web/c{n}.ts", "typescript", """import { call{n-10} } from './c{n-10}';
import x from 'react';
import y from '../web/c{n-20}';
export async function call{n}(x) {
  const y = await call{n-10}(x);
  return load(y, { retry: true });
}
interface Shape{n} { size: number }
const arrow{n} = (x) => x;
"""),
    ("k = 4", "Controllers/Home{n}Controller.cs", "csharp", """using System;
public class Home{n}Controller {
    public IActionResult Index{n}(int id) {
        return View(Find(id));
    }
    private static int Find(int id) { return id; }
}
"""),
    ("k = 4 AND n % 3 = 0", "Views/Model{n}.cs", "csharp", """public class UserRepo{n} {
}
public class RequestHandler{n} { }
"""),
]


def _split(template: str) -> list[tuple[str, int | None]]:
    """Literal parts and offsets from n in turn."""
    out: list[tuple[str, int | None]] = []
    rest = template
    while "{n" in rest:
        a, rest = rest.split("{n", 1)
        b, rest = rest.split("}", 1)
        out.append((a, int(b or 0)))
    return out + [(rest, None)]


def _column(template: str) -> Column:
    parts = [x for a, k in _split(template) for x in (F.lit(a), *([] if k is None else [(F.col("n") + k).cast("string")]))]
    return F.concat(*parts)


def _sql(template: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return "(" + " || ".join(x for a, k in _split(template) for x in (quote(a), *([] if k is None else [f"(n + {k})"]))) + ")"


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repository_id, path, language, content): one or two files of each document, in two repositories."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n")).withColumn("k", F.floor(F.col("n") / 2) % 5)
    file = lambda cond, path, lang, text: F.when(F.expr(cond), F.struct(_column(path).alias("path"), F.lit(lang).alias("language"), _column(text).alias("content")))
    files = F.filter(F.array(*[file(*x) for x in FILES]), lambda x: x.isNotNull())
    return d.select(F.concat(F.lit("r"), F.col("n") % 2).alias("repository_id"), F.explode(files).alias("f")).select("repository_id", "f.*")


CODE_SQL = " UNION ALL ".join(f"SELECT 'r' || (n % 2) AS repository_id, {_sql(path)} AS path, '{lang}' AS language, {_sql(text)} AS content FROM (SELECT doc_id AS n, (doc_id // 2) % 5 AS k FROM documents) WHERE {cond}" for cond, path, lang, text in FILES)
