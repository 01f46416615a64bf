"""Closures in few rounds, and a graph kept up with its files."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from brackenlake import queries, queries_code
from brackenlake.operators import graph, store

EDGE = "repository_id string, src string, dst string"
FILE = "repository_id string, path string"


def brute(edges, start):
    seen, front = set(), set(start)
    while front:
        front = {(r, s) for r, s, d in edges if (r, d) in front} - seen
        seen |= front
    return seen


@pytest.mark.parametrize("growth,alone", [(4, 0), (0, 0), (4, 60), (4, 1 << 20)])
def test_impact_of_any_graph(spark, growth, alone):
    r = random.Random(growth)
    edges = {("r", f"f{a}", f"f{b}") for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(70))} | {("q", "f1", "f2"), ("r", "c0", "c1"), ("r", "c1", "c2"), ("r", "c2", "c0"), ("r", "own", "own")}
    for start in ([("r", "f3")], [("r", "c0")], [("q", "f2"), ("r", "f9")], [("r", "own")], [("r", "nowhere")], []):
        got = graph.impact(spark.createDataFrame(list(edges), EDGE), spark.createDataFrame(start, FILE), growth, alone)
        assert {tuple(x) for x in got.select("repository_id", "path").collect()} == brute(edges, start)


def test_impact_of_a_chain_of_ten_thousand(spark):
    chain = spark.range(10_000).select(F.lit("r").alias("repository_id"), F.concat(F.lit("f"), F.col("id")).alias("src"), F.concat(F.lit("f"), F.col("id") + 1).alias("dst"))
    back = spark.createDataFrame([("r", "f10000", "f9990"), ("s", "a", "f10000")], EDGE)
    for alone in (0, 1 << 20):
        got = graph.impact(chain.unionByName(back), spark.createDataFrame([("r", "f10000")], FILE), alone=alone)
        assert got.count() == 10_001  # the cycle at its end leads back to the start
    first = graph.impact(chain, spark.createDataFrame([("r", "f3")], FILE)).select("path").collect()
    assert {x["path"] for x in first} == {"f0", "f1", "f2"}


def test_graph_follows_its_files(spark):
    r = random.Random(4)

    def code(n):
        lines = [f"import pkg.m{r.randrange(40)}" for _ in range(r.randrange(4))] + [f"from pkg.m{r.randrange(40)}.part import x" for _ in range(r.randrange(3))]
        return ("r", f"pkg/m{n}.py" if n % 3 else f"pkg/m{n}/__init__.py", "python", "\n".join(lines))

    schema = f"{FILE}, language string, content string"
    files = {x[1]: x for x in map(code, range(30))}
    corpus = spark.createDataFrame(list(files.values()), schema)
    tried = graph.candidates(graph.imports(corpus))
    resolved = graph.chosen(tried, corpus)
    for _ in range(3):
        before = spark.createDataFrame([x[:2] for x in files.values()], FILE)
        gone = r.sample(sorted(files), 3)
        new = [("r", f"pkg/m{n}.py", "python", f"import pkg.m{n - 1}") for n in r.sample(range(40), 2)] + [("r", f"pkg/m{r.randrange(40)}/part.py", "python", "")]
        changed = {x[1]: x for x in [*new, *[(*files[p][:3], code(1)[3]) for p in r.sample(sorted(set(files) - set(gone)), 3)]] if x[1] not in gone}
        files = {p: x for p, x in files.items() if p not in gone} | changed
        tried, resolved = graph.refresh(tried, resolved, before, spark.createDataFrame(list(changed.values()), schema), spark.createDataFrame([("r", p) for p in gone], FILE))
        tried, resolved = spark.createDataFrame(tried.collect(), tried.schema), spark.createDataFrame(resolved.collect(), resolved.schema)
        whole = spark.createDataFrame(list(files.values()), schema)
        assert {tuple(x) for x in graph.edges_of(resolved).collect()} == {tuple(x) for x in graph.dependencies(whole).collect()}
        assert sorted(map(tuple, tried.collect())) == sorted(map(tuple, graph.candidates(graph.imports(whole)).collect()))


@pytest.mark.parametrize("sent", [100_000, 0])
def test_edges_that_begin_at_some_files(spark, monkeypatch, sent):
    monkeypatch.setattr(store, "SENT", sent)
    r = random.Random(7)
    lines = lambda: "\n".join([f"import pkg.m{r.randrange(30)}" for _ in range(3)] + [f"from pkg.m{r.randrange(30)}.part import x"])
    files = [(repo, f"pkg/m{n}.py" if n % 3 else f"pkg/m{n}/__init__.py", "python", lines()) for repo in ("r", "s") for n in range(25)] + [("r", "pkg/m1.py", "python", "import pkg.m2")]
    corpus = spark.createDataFrame(files, f"{FILE}, language string, content string")
    every = {tuple(x) for x in graph.dependencies(corpus).collect()}
    for some in (r.sample([x[:2] for x in files], 9), [("r", "nowhere")], [x[:2] for x in files]):
        got = graph.dependencies_from(corpus, spark.createDataFrame(some, FILE)).collect()
        assert sorted(map(tuple, got)) == sorted(e for e in every if e[:2] in some)
    assert len(every) > 50


def test_packs_heed_edges_whatever_the_number_of_files(spark, tmp_path):
    """Beyond 5,000 files too; every other file of a like score imports one of the first three."""
    first, own = [1, 9, 17], [25 + 8 * i for i in range(12)]  # src/core/Module{n}.rs, all of one repository
    texts = {n: "config error config error function" for n in first} | {n: "config error" + f"\nuse crate::src::core::Module{first[i % 3]};" * (i % 2) for i, n in enumerate(own)}
    docs = [(n, "rust" if n in texts else "en", "src0" if n in texts else "src1", texts.get(n, "of the")) for n in range(2800) if n % 8 != 3]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    sql = queries.ORACLE["request_packs"]
    run = lambda q: sorted(con.execute(q).fetchall())
    assert con.execute(f"{queries_code.ALL} SELECT count(*) FROM corpus").fetchone()[0] > 5000
    got = sorted(map(tuple, queries.QUERIES["request_packs"](spark, str(tmp_path)).collect()))
    assert got == run(sql)
    assert "intent = 'Debugging'" in sql and got != run(sql.replace("WHERE intent = 'Debugging'", "WHERE false"))
