"""Token streams: nesting, calls in functions, structural patterns."""

import pytest
from pyspark.sql import functions as F

from brackenlake import queries  # noqa: F401
from brackenlake.operators import segments, structure as st
from brackenlake.plans import retrieve

RUST = """
pub fn main() {
    println!("Hello {"); // }
}
pub struct Config { pub name: String }
impl<T: Fn(i32)> Drawable for Config<T> {
    fn new<'a>(x: &'a str) -> Self { run(step(x), ")"); Config { name: '{'.to_string() } }
}
trait Drawable { fn draw(&self); }
mod inner { pub async fn deep() { /* } */ fn deeper() { call(1) } other() } }
type Result<T> = std::result::Result<T, Error>;
"""
PYTHON = '''
def hello(a,
b=")"):
    x = {
1: 2}
    print("Hello")  # ) :
    def inner():
        return hello(1)

    return inner()

class Config(Base):
    def __init__(self):
        self.name = load("test")
y = hello(2)
'''
SCRIPT = """export declare function add(a: number): number;
interface User { name: string; }
class Config { run() { console.log("}"); } }
const greet = async (x) => { log(`{`); };
export async function fetchData() { return {}; }
"""
SHARP = """namespace MyApp.Models {
    public class Order {
        public int Id { get; set; }
        public Order() { }
        public void Process(int x) { Run(x); new Order(); }
        private static Task<int> Find(int id) { return id; }
    }
    public interface IOrderService { Task<Order> GetOrderAsync(int id); }
}"""


def spans(code, language):
    t = st.tokenize(code, language)
    found = st.symbols_of(t)
    return [(n, k, t.line(a), t.line(b), found[p][0] if p >= 0 else None) for n, k, a, b, p in found]


def calls(code, language):
    t = st.tokenize(code, language)
    return {(c, by) for _, c, by in st.calls_of(t, st.symbols_of(t))}


def test_spans_and_parents():
    assert spans(RUST, "rust") == [
        ("main", "function", 2, 4, None), ("Config", "struct", 5, 5, None), ("Config", "impl", 6, 8, None), ("new", "function", 7, 7, "Config"), ("Drawable", "trait", 9, 9, None),
        ("draw", "function", 9, 9, "Drawable"), ("inner", "module", 10, 10, None), ("deep", "function", 10, 10, "inner"), ("deeper", "function", 10, 10, "deep"), ("Result", "type", 11, 11, None),
    ]
    assert spans(PYTHON, "python") == [("hello", "function", 2, 10, None), ("inner", "function", 7, 8, "hello"), ("Config", "class", 12, 14, None), ("__init__", "function", 13, 14, "Config")]
    assert spans(SCRIPT, "typescript") == [("add", "function", 1, 1, None), ("User", "interface", 2, 2, None), ("Config", "class", 3, 3, None), ("greet", "function", 4, 4, None), ("fetchData", "function", 5, 5, None)]
    assert [x for x in spans(SHARP, "csharp") if x[4] != "MyApp"] == [("MyApp", "module", 1, 9, None), ("Order", "function", 4, 4, "Order"), ("Process", "function", 5, 5, "Order"), ("Find", "function", 6, 6, "Order")]
    for odd in ("", None, "}}})))", "fn", "fn (", "class", "impl<", "'", '"', "/*", "def f(:\n", "\x00 é fn é() {"):
        for language in ("rust", "python", "typescript", "csharp", "", None):
            spans(odd, language)
    assert spans("fn open() {\n a();\n", "rust") == [("open", "function", 1, 1, None)]  # a brace that stays open is none


def test_calls_know_their_innermost_function():
    assert calls(RUST, "rust") >= {("step", "new"), ("call", "deeper"), ("other", "deep"), ("to_string", "new")}
    assert calls(PYTHON, "python") >= {("hello", "inner"), ("inner", "hello"), ("load", "__init__"), ("hello", "unknown")}
    assert ("log", "greet") in calls(SCRIPT, "typescript") and ("Run", "Process") in calls(SHARP, "csharp")


def found(pattern, code, language):
    t = st.tokenize(code, language)
    return [(t.text[t.start[a] : t.end[b - 1]], held) for _, a, b, held in st.matches_of(st.compile_pattern(pattern, language), t)]


def test_patterns():
    assert [h["NAME"] for _, h in found("fn $NAME($$$ARGS) { $$$ }", RUST, "rust")] == ["main", "deep", "deeper"]
    assert found("$A == $A", "if (x.y == x.y && a == b) { f(a) == f(a) }", "typescript") == [("x.y == x.y", {"A": "x.y"}), ("f(a) == f(a)", {"A": "f(a)"})]
    nested = found("$FUNC($$$ARGS)", "run(step(x), g(1)(2)); a.b(c)", "rust")
    assert nested[0] == ("run(step(x), g(1)(2))", {"FUNC": "run", "ARGS": "step(x), g(1)(2)"}) and ("step(x)", {"FUNC": "step", "ARGS": "x"}) in nested
    assert found("use $MODULE;", "use std::collections::HashMap;\nuse a;", "rust") == [("use std::collections::HashMap;", {"MODULE": "std::collections::HashMap"}), ("use a;", {"MODULE": "a"})]
    assert found("def $NAME($$$): $$$", "def f(a,\n b):\n    x\n    y\nz", "python") == [("def f(a,\n b):\n    x\n    y", {"NAME": "f"})]
    assert found("if ($C) { $$$A } else { $$$A }", "if (x) { f(); } else { f(); } if (x) { g(); } else { h(); }", "typescript") == [("if (x) { f(); } else { f(); }", {"C": "x", "A": "f();"})]
    assert found("f($$$)", "f(g(1), ')') // f(", "rust") == [("f(g(1), ')')", {})]
    assert found("f($A, $B)", "f(g(1, 2), [3, 4])", "rust") == [("f(g(1, 2), [3, 4])", {"A": "g(1, 2)", "B": "[3, 4]"})]
    assert found("", "f(x)", "rust") == [] and found("$$$", "", "rust") == []
    assert st.valid("f($$$)") and not st.valid("f($$$") and not st.valid(" ") and st.valid("f(')')")
    assert st.patterns_for("class", "tsx") == ["class $NAME { $$$ }"] and st.patterns_for("impl", "python") == [] and st.patterns_for("nothing", "rust") == []
    assert st.patterns_for("import", "typescript") == st.patterns_for("import", "javascript") != []


@pytest.fixture(scope="module")
def code(spark):
    rows = [("r", "a.rs", "rust", RUST), ("r", "b.py", "python", PYTHON), ("r", "c.ts", "typescript", SCRIPT), ("r", "tests/test_d.rs", "rust", "fn t() { main(); }"), ("r", "n.rs", "rust", None), ("r", "x.txt", None, "no code (")]
    return spark.createDataFrame(rows, "repository_id string, path string, language string, content string")


def test_matches_over_files(spark, code):
    every = {(r["path"], r["nth"], r["captures"]["NAME"], r["score"]) for r in st.matches(code, kind="function").collect()}
    assert {x[:3] for x in every} == {("a.rs", 0, "main"), ("a.rs", 1, "new<'a>"), ("a.rs", 2, "deep"), ("a.rs", 3, "deeper"), ("b.py", 0, "hello"), ("b.py", 1, "inner"), ("b.py", 2, "__init__"), ("c.ts", 0, "fetchData"), ("tests/test_d.rs", 0, "t")}
    assert {x[3] for x in every} == {1.0}
    first = st.matches(code, ["struct $NAME { $$$ }", "fn $NAME($$$) { $$$ }"], first=True).collect()
    assert {(r["path"], r["pattern"][:2], r["line"]) for r in first} == {("a.rs", "fn", 2), ("tests/test_d.rs", "fn", 1)}
    assert [r["path"] for r in st.matches_in(code, code.where("path like 'b%'"), kind="function", most=2).collect()] == ["b.py", "b.py"]
    edges = st.call_edges(st.scoped_calls(code), st.spans(code)).collect()
    assert ("r", "tests/test_d.rs", "t", "a.rs", "main") in {tuple(r) for r in edges}


def test_answers_with_structure(spark, code, tmp_path):
    s = segments.build(code, str(tmp_path))
    asked = spark.createDataFrame([(1, "find all functions that say hello"), (2, "hello")], "query_id int, query string")
    got = [(r["query_id"], r["path"], round(r["score"], 3)) for r in retrieve.answer(code, asked, most=4, stored=s).orderBy("query_id", "rank").collect()]
    assert {p for q, p, _ in got if q == 1} == {"a.rs", "b.py", "c.ts"}  # not the test file, as the request is not about tests
    assert all(p in ("a.rs", "b.py", "c.ts") for q, p, _ in got if q == 2)
    some = retrieve.by_structure(code, retrieve.prepare(asked), 4, code.where(F.col("path") == "a.rs")).collect()
    assert [(r["query_id"], r["path"], r["line"]) for r in some] == [(1, "a.rs", 2)]
