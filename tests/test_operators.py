"""Operators against small hand-made cases."""

from pyspark.sql import functions as F

from brackenlake.functions import paths, text
from brackenlake.operators import context, graph, index, knowledge, store, symbols
from brackenlake.plans import planner
from brackenlake.sources import corpus
from brackenlake.streaming import events


def col(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def test_identifiers(spark):
    split = lambda x: col(spark, x, text.split_identifier)
    assert split("CheckoutModel") == ["checkout", "model", "checkoutmodel"]
    assert split("HTTPServer") == ["http", "server", "httpserver"]
    assert split("snake_case-name") == ["snake", "case", "name", "snake_case-name"]
    assert split("plain") == ["plain"]


def test_classes_and_languages(spark):
    cls = lambda x: col(spark, x, paths.file_class)
    assert [cls(x) for x in ("src/a.rs", "tests/a.rs", "vendor/test/a.rs", "a/build/x.md", "README.md", "x.toml", ".gitignore", "img/a.png", "gen/a.ts")] == ["Source", "Test", "Vendor", "Dependency", "Documentation", "Config", "Config", "Binary", "Generated"]
    lang = lambda x: col(spark, x, paths.language)
    assert [lang(x) for x in ("Cargo.toml", "a/b.toml", "x.pyi", "y.d.ts", "Makefile")] == ["rust", "toml", "python", "typescript", None]


def test_intents(spark):
    intent = lambda x: col(spark, x, text.intent)
    cases = {"How do I add a new package": "Procedural", "how are packages tested": "Testing", "why does login fail": "Debugging", "where is the parser": "Navigation", "find all functions": "Structural", "what is this": "Informational", "implement cache": "Implementation", "architecture overview": "Architecture", "configure the linter": "Configuration"}
    assert {k: intent(k) for k in cases} == cases


def test_windows_and_plans():
    assert [context.snippet_window(n, 20) for n in (1, 20, 50, 200)] == [(5, 15), (5, 15), (2, 4), (2, 4)]
    assert context.snippet_window(20, 3) == (5, 3)
    assert sum(context.snippet_window(21, 20)) == 18
    assert planner.max_files(300) == 50 and planner.max_files(3000) == 20 and planner.max_files(9000) == 50
    assert planner.candidates(6000, 50) == 200 and planner.candidates(100, 50) == 200
    assert planner.plan("Debugging").graph and not planner.plan("Procedural").symbols


def reserve(ranked, k, slots):
    """What stands among the first k once documents are promoted into the last places, one swap at a time."""
    out, k = list(ranked), min(k, len(ranked))
    if slots == 0 or k <= slots:
        return set(out[:k])
    tail = k - slots
    is_doc = lambda x: x[1] == "Documentation"
    need = slots - sum(map(is_doc, out[tail:k]))
    donors = ([i for i in range(tail) if is_doc(out[i])] + [i for i in range(k, len(out)) if is_doc(out[i])])[: max(need, 0)]
    for i, j in zip(donors, [i for i in range(tail, k) if not is_doc(out[i])]):
        out[i], out[j] = out[j], out[i]
    return set(out[:k])


def test_docs_reserved(spark):
    import random

    rng = random.Random(4)
    lists = [[(f"p{i}", rng.choice(["Source", "Source", "Documentation", "Config"])) for i in range(rng.randrange(1, 12))] for _ in range(60)]
    rows = [(q, i + 1, p, c) for q, x in enumerate(lists) for i, (p, c) in enumerate(x)]
    ranked = spark.createDataFrame(rows, "query_id int, rank int, path string, file_class string")
    for k, slots in ((5, 2), (3, 2), (2, 2), (4, 0)):
        got = {}
        for r in index.reserve_docs(ranked, k, slots).collect():
            got.setdefault(r["query_id"], set()).add((r["path"], r["file_class"]))
        assert got == {q: reserve(x, k, slots) for q, x in enumerate(lists)}


EDGES = "repository_id string, src string, dst string"


def test_impact_follows_chains_and_cycles(spark):
    edges = spark.createDataFrame([("r", *e) for e in (("a", "b"), ("b", "c"), ("d", "a"), ("c", "d"))] + [("s", "x", "c")], EDGES)
    got = {tuple(r) for r in graph.impact(edges, spark.createDataFrame([("r", "c")], "repository_id string, path string")).collect()}
    assert got == {("r", x) for x in "abcd"}


CODE = "repository_id string, path string, language string, content string"


def test_imports_name_one_file_of_their_repository(spark):
    rows = [
        ("r1", "main.rs", "rust", "use crate::net::client::Client;\nmod util;\nuse std::fmt;\nuse super::deep::mod_::x;"),
        ("r1", "net.rs", "rust", ""), ("r1", "net/client.rs", "rust", ""), ("r1", "util.rs", "rust", ""), ("r1", "util/mod.rs", "rust", ""), ("r1", "deep/mod.rs", "rust", ""),
        ("r2", "main.rs", "rust", "mod util;\nuse crate::net::client;"), ("r2", "net.rs", "rust", ""),
        ("r1", "app.py", "python", "from pkg.module import x\nimport pkg\nimport os"), ("r1", "pkg/__init__.py", "python", ""), ("r1", "pkg/module.py", "python", ""), ("r1", "pkg/module/__init__.py", "python", ""),
        ("r1", "web/a.ts", "typescript", "import { b } from './b';\nimport r from 'react';\nexport * from '../lib'"), ("r1", "b.tsx", "typescript", ""), ("r1", "lib/index.ts", "typescript", ""),
    ]
    got = {tuple(r) for r in graph.dependencies(spark.createDataFrame(rows, CODE)).collect()}
    assert got == {
        ("r1", "main.rs", "net/client.rs"), ("r1", "main.rs", "util.rs"), ("r1", "main.rs", "deep/mod.rs"), ("r2", "main.rs", "net.rs"),
        ("r1", "app.py", "pkg/module/__init__.py"), ("r1", "app.py", "pkg/__init__.py"), ("r1", "web/a.ts", "b.tsx"), ("r1", "web/a.ts", "lib/index.ts"),
    }


def test_call_edges(spark):
    rows = [("r", "a", "rust", "fn f() {\n  gg(x);\n}\n\nfn k() {\n  if (y) { hh(z) }\n}\ngg(top);"), ("r", "b", "rust", "fn gg() {}\nfn hh() {\n}"), ("s", "c", "python", "def f(x):\n  return gg(x)")]
    c = spark.createDataFrame(rows, CODE)
    defs = {(r["path"], r["name"], r["start"], r["end"]) for r in graph.definitions(c).collect()}
    assert defs == {("a", "f", 1, 3), ("a", "k", 5, 7), ("b", "gg", 1, 1), ("b", "hh", 2, 3), ("c", "f", 1, 2)}
    edges = graph.call_edges(graph.calls(c), graph.definitions(c))
    assert {tuple(r) for r in edges.collect()} == {("r", "a", "f", "b", "gg"), ("r", "a", "k", "b", "hh"), ("r", "a", "unknown", "b", "gg")}
    assert {tuple(r) for r in graph.callers_of(edges, "gg").collect()} == {("r", "a", "f"), ("r", "a", "unknown")}


def test_graph_is_stored(spark, tmp_path):
    edges = spark.createDataFrame([("r", "a", "b"), ("s", "a", "c")], EDGES)
    graph.store_edges(edges, str(tmp_path / "g"))
    graph.store_edges(spark.createDataFrame([("r", "a", "d")], EDGES), str(tmp_path / "g"))
    assert {(r["repository_id"], r["dst"]) for r in graph.load_edges(spark, str(tmp_path / "g")).collect()} == {("r", "d"), ("s", "c")}
    assert graph.load_edges(spark, str(tmp_path / "g"), "s").count() == 1


def test_stored_index(spark, tmp_path):
    c = spark.createDataFrame([("a", "x.rs", "rust", "fn alphaBeta() {}\nalpha beta"), ("b", "y.rs", "rust", "alpha"), ("b", "README.md", "markdown", "# Alpha\n## gamma_ray\ntext")], CODE)
    q = spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "gamma"), (3, "none")], "query_id int, term string")
    at = str(tmp_path / "i")
    assert index.validate(spark, at) == "missing"
    index.store(c, at)
    assert index.validate(spark, at) == "ok"
    rows = lambda df: {(r["query_id"], r["path"]): (round(r["score"], 9), r["rank"]) for r in df.collect()}
    assert rows(index.search(spark, at, q)) == rows(index.bm25(c, q)) and len(rows(index.search(spark, at, q))) == 4
    changed = spark.createDataFrame([("b", "y.rs", "rust", "gamma gamma")], CODE)
    assert index.update(spark, at, changed, c.where("path = 'x.rs'")) == 1
    now = c.where("path = 'README.md'").unionByName(changed)
    assert rows(index.search(spark, at, q)) == rows(index.bm25(now, q))
    assert index.update(spark, at, c.where("path = 'x.rs'"), changed) == 2  # a file may come back, a changed one go
    assert rows(index.search(spark, at, q)) == rows(index.bm25(c.where("path <> 'y.rs'"), q))


def test_reindex_and_probe(spark, tmp_path):
    from brackenlake.plans import retrieve, upkeep

    at = str(tmp_path / "i")
    old = spark.createDataFrame([("a", "x.md", "markdown", "# readme alpha"), ("b", "x.md", "markdown", "# readme"), ("b", "y.rs", "rust", "fn old() {}")], CODE)
    new = spark.createDataFrame([("a", "x.md", "markdown", "# readme alpha"), ("b", "x.md", "markdown", "# beta"), ("b", "z.rs", "rust", "fn newer() {}")], CODE)
    assert upkeep.probe(spark, at, old)["index"] == "missing"
    assert upkeep.reindex(spark, at, upkeep.known(old).limit(0), old) == {"new": 3}
    assert upkeep.probe(spark, at, old) == {"index": "ok", "stored": 3, "indexed": 3, "found": 2}
    assert upkeep.reindex(spark, at, upkeep.known(old), new) == {"unchanged": 1, "changed": 1, "deleted": 1, "new": 1}
    assert upkeep.probe(spark, at, new) == {"index": "ok", "stored": 3, "indexed": 3, "found": 1}
    assert upkeep.reindex(spark, at, upkeep.known(new), new) == {"unchanged": 3}
    assert upkeep.languages(spark).where("language = 'rust'").first()["endings"] == ["rs"]
    named = new.withColumn("path", F.concat(F.lit("docs/"), "path"))
    r = retrieve.explain(retrieve.rank(named, spark.createDataFrame([(1, "readme alpha")], "query_id int, query string"))).first()
    assert r["path"] == "docs/x.md" and r["explained"].startswith("docs/x.md score:") and "class:Documentation" in r["explained"]


def test_requests(spark):
    one = lambda x, f: col(spark, x, f)
    assert one("where is the CheckoutModel: (types)?", text.sanitise) == "checkout OR model OR checkoutmodel OR types OR index.d.ts"
    assert one("the of", text.sanitise) == "the of" and one("??", text.sanitise) == "??"
    assert one("find the parse_tree, please!", text.scan_pattern) == "parse_tree|please" and one("the a.b", text.scan_pattern) == "ab"
    assert one("to do (it)", text.scan_pattern) == "to\\ do\\ \\(it\\)" or one("to do (it)", text.scan_pattern) == "to do \\(it\\)"
    assert one("add a package", text.expanded_query) == "add OR create OR new OR package OR workspace" and one("hello", text.expanded_query) is None
    assert one("a\nb" + "c" * 10, lambda x: text.preview(x, 5)) == "a\\nbc… (+9 chars)"


def test_unsafe_roots(spark):
    got = {x: col(spark, x, paths.unsafe_root) for x in ("/", "C:\\", "c:", "\\\\server\\share", "\\\\?\\C:\\", "/home/a", "C:\\work", "\\\\server\\share\\repo")}
    assert [k for k, v in got.items() if not v] == ["/home/a", "C:\\work", "\\\\server\\share\\repo"]


def test_planner_limits():
    assert planner.exhaustive("Structural", "find all functions") == (500, 500) and planner.exhaustive("Debugging", "all errors") is None
    assert planner.structural_stop(20) == 40 and planner.skip_tests("Navigation", "x") and not planner.skip_tests("Navigation", "a Test")
    assert planner.validate({"max_files": 0, "lexical_weight": 11, "docs_share": 2}) == ["max_files must be 1 or more", "lexical_weight must be between 0 and 10", "docs_share must be between 0 and 1"]
    assert planner.merge_settings({"a": {"x": 1, "y": 2}}, {"a": {"x": 3}}) == {"a": {"x": 3}}
    assert planner.max_evidence(20, True) == 30 and not planner.graph_allowed(True, 1, 10, 10)


def test_search_falls_back_to_a_scan(spark):
    from brackenlake.plans import retrieve

    c = spark.createDataFrame([("r", "x.rs", "rust", "one\nfoo_bar9baz")], CODE)
    how, rows = retrieve.search_or_scan(c, "one thing")
    assert how == "Found" and rows.count() == 1
    how, rows = retrieve.search_or_scan(c, "bar9 thing")
    assert how == "FallbackUsed" and [r["line"] for r in rows.collect()] == [2]


def test_truncation_keeps_a_pointer(spark):
    from brackenlake.operators import store

    long = "\n".join(f"line number {i} of this text" for i in range(50))
    t = spark.createDataFrame([(1, long), (2, "short"), (3, "x" * 4000)], "id int, text string")
    got = {r["id"]: r for r in context.truncate(t, 40).collect()}
    assert not got[2]["cut"] and got[2]["text"] == "short" and got[1]["cut"] and got[1]["n_tokens"] <= 40
    key = got[1]["text"].rsplit(" ", 1)[1].rstrip("]")
    assert store.original(store.spill(t.select("text")), key).first()[0] == long and got[3]["text"].startswith("... [truncated")


def test_tree_scan_and_lines(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("one\ntwo\nthree")
    (tmp_path / "src/b.bin").write_bytes(b"\0" * 100)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.js").write_text("x")
    got = corpus.scan_tree(spark, str(tmp_path)).select("content", corpus.line_range(F.col("content"), 2, 9).alias("l")).collect()
    assert [tuple(r) for r in got] == [("one\ntwo\nthree", "two\nthree")]


def test_ignore_rules(spark, tmp_path):
    text = "# made\n*.log\n/out/\ndocs/**/draft?.md\n!keep.log\ncache"
    for name in ("a.log", "keep.log", "out/x.py", "src/out/y.py", "docs/a/b/draft1.md", "docs/draft.md", "cache/z.py", "pic.png"):
        f = tmp_path / "r" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("text of " + name)
    got = {r["path"].split("/r/", 1)[1] for r in corpus.scan_tree(spark, str(tmp_path / "r"), ignore=text).collect()}
    assert got == {"keep.log", "src/out/y.py", "docs/draft.md"}


def test_settings(tmp_path):
    import pytest

    from brackenlake.plans import settings

    (tmp_path / "u.toml").write_text("[retrieval]\nmax_files = 30\n")
    got = settings.load(tmp_path / "u.toml", tmp_path / "none.toml", env={"BRACKENLAKE_CONTEXT__MAX_LINES": "9", "OTHER": "1"})
    assert got["retrieval"] == {"max_files": 30} and got["context"]["max_lines"] == 9 and got["context"]["docs_share"] == 0.45
    with pytest.raises(ValueError):
        settings.load(env={"BRACKENLAKE_CONTEXT__DOCS_SHARE": "1.5"})


def test_tables_are_kept(spark, tmp_path):
    at = str(tmp_path / "t")
    t = lambda rows: spark.createDataFrame(rows, "repository_id string, path string")
    corpus.replace_partition(t([("a", "1"), ("b", "2")]), at)
    corpus.replace_partition(t([("a", "3")]), at)
    assert {tuple(r) for r in spark.read.parquet(at).select("repository_id", "path").collect()} == {("a", "3"), ("b", "2")}


def test_code_behind_and_merge(spark):
    found = spark.createDataFrame([("V.cshtml", 2.0), ("W.cshtml", 1.0), ("W.cshtml.cs", 3.0)], "path string, score double")
    files = spark.createDataFrame([("V.cshtml.cs",), ("W.cshtml.cs",)], "path string")
    assert [tuple(r) for r in index.code_behind(found, files).collect()] == [("V.cshtml.cs", 1.6)]


def test_knowledge(spark):
    k = spark.createDataFrame([("c", "user_key", "v", 0.9, "r"), ("c", "other", "has user", 0.5, "r"), ("c", "user", "x", 0.2, "r")], "category string, key string, value string, confidence double, repository_id string")
    assert [r["key"] for r in knowledge.retrieve(k, "user").collect()] == ["user_key", "other"]
    s = spark.createDataFrame([("r", n) for n in ("UserController", "UserService", "UserRepository", "get_user")], "repository_id string, name string")
    f = spark.createDataFrame([("r", "a/model.py")], "repository_id string, path string")
    assert {r["pattern"] for r in knowledge.architecture(s, f).collect()} == {"controller-service-repository"}


def test_structural_pattern_checks():
    assert symbols.validate_pattern("fn $A($$$)") and not symbols.validate_pattern("fn $A(")


def test_rate_limit_and_debounce(spark):
    rows = [(1, i, 0.0) for i in range(25)] + [(1, 25, 1.0)]
    e = spark.createDataFrame(rows, "user_id long, event_id long, t double").select("user_id", "event_id", F.timestamp_seconds("t").alias("ts"))
    got = events.limit_rate(e, "user_id").orderBy("event_id").collect()
    assert [r["allowed"] for r in got] == [True] * 20 + [False] * 5 + [True]
    assert events.debounce([0.0, 0.2, 0.4, 0.6]) == [0.5, 1.1]


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([("s", "2024-01-01 00:00:00", "x"), ("s", "2024-01-01 00:00:01", "x"), ("s", "2024-01-01 00:00:02", "y")], "session_id string, ts string, content string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("session_id string, ts timestamp, content string").parquet(str(src))
    q = events.keep_indexed(events.first_blocks(stream), lambda df: df.write.mode("append").parquet(str(out)), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(out)).count() == 2


def test_streams_with_state(spark, tmp_path):
    import time

    src = tmp_path / "in"
    rows = [(1, i, f"2024-01-01 00:00:0{i // 25}") for i in range(50)] + [(2, 99, "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "user_id long, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(src))
    stream = lambda: spark.readStream.schema("user_id long, event_id long, ts timestamp").parquet(str(src))
    q = events.limit_stream(stream(), "user_id").writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    got = {(r["session"], r["event_id"]): r["allowed"] for r in spark.table("limited").collect()}
    want = {(r["session"], r["event_id"]): r["allowed"] for r in events.limit_rate(spark.read.parquet(str(src)), "user_id").collect()}
    assert got == want and sum(want.values()) == 31
    q = events.debounce_stream(stream(), "user_id", 200).writeStream.format("memory").queryName("fired").outputMode("append").trigger(processingTime="100 milliseconds").option("checkpointLocation", str(tmp_path / "c2")).start()
    end = time.time() + 60
    while spark.table("fired").count() < 2 and time.time() < end:
        time.sleep(0.5)
    q.stop()
    assert {tuple(r) for r in spark.table("fired").collect()} == {(1, 50), (2, 1)}


def test_debounce_by_key(spark):
    import random

    rng = random.Random(3)
    rows = [(k, rng.choice([0.0, 0.25, 0.5]) + rng.randrange(40) / 4) for k in (1, 2) for _ in range(30)] + [(3, 1.0), (3, 1.0)]
    got = events.debounce_events(spark.createDataFrame(rows, "k long, at double"), "k", 0.5).collect()
    want = [(k, t) for k in (1, 2, 3) for t in events.debounce([a for j, a in set(rows) if j == k], 0.5)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_filtered_search_keeps_statistics(spark):
    c = spark.createDataFrame([("a", "x.rs", "rust", "alpha beta"), ("b", "y.rs", "rust", "alpha"), ("b", "z.py", "python", "gamma")], "repository_id string, path string, language string, content string")
    q = spark.createDataFrame([(1, "alpha")], "query_id int, term string")
    every = {(r["repository_id"], r["path"]): r["score"] for r in index.bm25(c, q).collect()}
    some = {(r["repository_id"], r["path"]): r["score"] for r in index.bm25(c, q, only=F.col("repository_id") == "b").collect()}
    assert len(every) == 2 and some == {("b", "y.rs"): every["b", "y.rs"]}
    assert {tuple(r) for r in index.document_frequency(c, q).collect()} == {("content", "alpha", 2, 2)}
    n = {r["query_id"]: r["n"] for r in index.count_hits(c, q).collect()}
    assert n == {1: 2}


def test_phrase_and_empty_phrase(spark):
    c = spark.createDataFrame([("a", "x", "Licensed, under licensed under"), ("a", "y", "under licensed"), ("a", "z", None)], "repository_id string, path string, content string")
    assert [tuple(r) for r in index.phrase_matches(c, "licensed under").collect()] == [("a", "x", 2)]
    assert index.phrase_matches(c, " ,").count() == 0


def test_evidence_and_words_go_to_the_files(spark, tmp_path, monkeypatch):
    """A request's few rows are sent, so texts and parts of names are not shuffled; more of them meet by shuffle, with the same result."""
    texts = [(f"r{i % 3}", f"src/f{i}.py", f"head {i}\n" + "word " * 50 + f"\ndef run_{i}(x):\n  pass") for i in range(60)]
    spark.createDataFrame(texts, "repository_id string, path string, content string").write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    evidence = spark.createDataFrame([(q, f"r{i % 3}", f"src/f{i}.py", 3, i + 1) for q in (1, 2) for i in range(0, 60, 5)], "query_id int, repository_id string, path string, line int, rank int")
    words = spark.createDataFrame([(1, ["run_1", "of"]), (2, ["run_59"])], "query_id int, words array<string>")
    want = None
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # texts are larger than what Spark sends by itself
    try:
        for most in (store.SENT, 0):
            monkeypatch.setattr(store, "SENT", most)
            joined = context.snippets(evidence, files, 15), symbols.find_each(symbols.symbols(files), words, 30)
            for df in joined if most else ():
                plan = df._jdf.queryExecution().executedPlan().toString()
                assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
            found = [sorted(df.collect()) for df in joined]
            want = want or found
            assert found == want and len(found[0]) == 24 and len(found[1]) == 12
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
