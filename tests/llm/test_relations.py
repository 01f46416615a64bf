"""op11, op12 and op13 against brute force: nulls, empties, ties, repeats, hot groups, clashing columns; components by both ways."""

import hashlib
import random
import re
import zlib
from math import floor, isqrt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brackenlake.llm import base, codebooks, neardup, prefixes, queries, triejoin

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, p1 string"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_brute(rows):
    by: dict = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            by.setdefault(c, []).append((turn is not None, turn or 0, key, role, text))
    own = {c: [(r[3], r[4]) for r in sorted(x)] for c, x in by.items()}
    nodes: dict = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        lead = c - (c % 5 if c >= 0 else -(-c % 5))
        full = own.get(lead, [])[:h] + seq[h:]
        for d in range(len(full) + 1):
            nodes.setdefault(tuple(full[:d]), []).append((c, d == len(full)))
    children: dict = {}
    for n in nodes:
        if n:
            children.setdefault(n[:-1], []).append(n)
    out = []
    for n, members in nodes.items():
        below, todo, leaves, saved = [n], [n], 0, 0
        while todo:
            kids = children.get(todo.pop(), [])
            below += kids
            todo += kids
        for b in below:
            leaves += b not in children
            saved += (len(nodes[b]) - 1) * (len(b[-1][1].encode()) if b else 0)
        ends = ",".join(map(str, sorted(c for c, e in members if e)))
        parent = min(c for c, _ in nodes[n[:-1]]) if n else None
        out.append((min(c for c, _ in members), len(n), parent, len(members), len(children.get(n, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    r = random.Random(5)
    rows = []
    for c in [*range(0, 40), -7, -5, 123456789012]:
        if c in (10, 23):
            continue  # a family without its first
        for t in range(r.randint(1, 12)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a", "b", "ünï", "c c"]), 1, "x"))
    rows += [(50 + k, t, "user", f"t{t}", 1, "x") for k in range(30) for t in range(6)]  # copies
    rows += [(90, t, "user", "long" * t, 1, "x") for t in range(200)]
    rows += [(91, None, None, None, 1, "x"), (91, None, "", "", 1, "x"), (91, 3, "user", "x" * 100_000, 1, "x"), (91, 3, "user", "x", 1, "x"), (91, 3, "user", "x", 1, "x")]
    rows += [(None, 1, "user", "lost", 1, "x"), (95, 0, "a", "bc", 1, "x"), (96, 0, "ab", "c", 1, "x")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions", ["3", "16"])
def test_prefix_trie(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # conversations go over several partitions
    try:
        rows = conversations()
        got = prefixes.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((tuple(r[c] for c in NODE) for r in got), key=repr) == trie_brute(rows)
    assert sorted(r["position"] for r in got) == list(range(1, len(got) + 1))
    place = {r["position"]: r for r in got}
    for r in got:  # a subtree is what stands from a node to its end
        inside = [place[p] for p in range(r["position"], r["end_position"] + 1)]
        assert sum(x["n_children"] == 0 for x in inside) == r["n_leaves"] and all(x["depth"] > r["depth"] for x in inside[1:])


def test_prefix_trie_of_little(spark):
    assert prefixes.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    assert prefixes.prefix_trie(spark.createDataFrame([(None, 1, "u", "t", 1, "x")], CONVERSATIONS)).count() == 0
    one = [(7, None, None, None, 1, "x")]
    got = prefixes.prefix_trie(spark.createDataFrame(one, CONVERSATIONS)).collect()
    assert sorted((tuple(r[c] for c in NODE) for r in got), key=repr) == trie_brute(one)


def test_scan_over_partitions(spark):
    rows = [(i % 3 if i < 90 else 7, i, i * i, i * 7919) for i in range(200)]
    got = prefixes.scan(spark.createDataFrame(rows, "g long, i long, a long, x long").repartition(7), ["g", "i"], "g", add=("a",), xor=("x",)).collect()
    for g in {r[0] for r in rows}:
        total = mixed = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["i"]):
            total, mixed = total + r["a"], mixed ^ r["x"]
            assert (r["run_a"], r["run_x"]) == (total, mixed)


VECTORS = "vec_id long, embedding array<float>, label int, code string, error long"


def codes_brute(rows):
    kept = [(i, [min(max(floor(256 * x), -isqrt((1 << 62) // len(v)) // 2), isqrt((1 << 62) // len(v)) // 2) for x in map(float, map(np.float32, v))], label) for i, v, label, *_ in rows if v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    named = sorted((r for r in kept if r[0] is not None), key=lambda r: r[:2])
    dim = len(named[0][1]) if named else 0
    fit = [r for r in kept if dim and dim % 16 == 0 and len(r[1]) == dim]
    first: dict = {}
    for r in named:
        if len(r[1]) == dim:
            first.setdefault(r[0], r[1])
    w = dim // 16
    books = [[first[i][p * w : (p + 1) * w] for i in sorted(first)[:64]] for p in range(16)] if dim % 16 == 0 else []

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(2):
        for p, book in enumerate(books):
            parts = [r[1][p * w : (p + 1) * w] for r in fit]
            at = [near(x, book)[1] for x in parts]
            books[p] = [[sum(c) // len(mine) for c in zip(*mine)] if (mine := [x for x, a in zip(parts, at) if a == k]) else e for k, e in enumerate(book)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        if any(r[1] is v for r in fit):
            got = [near(v[p * w : (p + 1) * w], books[p]) for p in range(16)]
            out.append((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), label))
        else:
            out.append((i, None, None, label))
    total: dict = {}
    for _, _, e, label in out:
        if e is not None:
            total[label] = total.get(label, 0) + e
    return sorted(((i, c, e, total.get(label), sha) for i, c, e, label in out), key=repr)


@pytest.mark.parametrize("width", [1, 4])
def test_vector_codes(spark, width):
    r = random.Random(width)
    vector = lambda s: [r.gauss(0, s) for _ in range(16 * width)]
    rows = [(i * 3 - 20, vector(0.3), i % 4 if i % 9 else None) for i in range(150)]
    rows += [(1000, [0.0] * 16 * width, 1), (1001, rows[0][1], 1), (1001, rows[0][1], 1), (1002, vector(30.0), None), (None, vector(0.3), 2), (-20, vector(0.3), 2)]
    rows += [(1003, None, 1), (1004, [None] + vector(1)[1:], 1), (1005, [float("nan")] + vector(1)[1:], 1), (1006, [float("inf")] + vector(1)[1:], 1), (1007, [3e38] * 16 * width, 3), (1008, [1.0, 2.0], 5), (1009, [], 5)]
    rows = [(*x, "own", 5) for x in rows]
    got = sorted(map(tuple, codebooks.compress(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()), key=repr)
    assert got == codes_brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [1.0] * 10, 1), (2, [1.0] * 10, None)], [(1, [0.5] * 32, 1), (2, [0.5] * 32, 1)]])
def test_vector_codes_of_little(spark, rows):
    rows = [(*x, "own", 5) for x in rows]
    got = sorted(map(tuple, codebooks.compress(spark.createDataFrame(rows, VECTORS)).collect()), key=repr)
    assert got == codes_brute(rows)


@pytest.mark.parametrize("spread", [2, 40, 1 << 20])
def test_vantage_point_tree_is_exact(spread):
    rng = np.random.default_rng(spread)
    for n in (1, 2, 7, 64, 200):
        points = rng.integers(-spread, spread + 1, (n, 3))
        points[n // 2 :] = points[: n - n // 2]  # equal entries
        parts = np.concatenate((rng.integers(-2 * spread, 2 * spread, (500, 3)), points))
        index, far, taken = codebooks.nearest(points, codebooks.tree(points), parts)
        full = codebooks._squares(parts, points)
        assert (index == full.argmin(1)).all() and (far == full.min(1)).all() and taken <= full.size
    big = np.sort(rng.integers(-1000, 1000, 64))[:, None] * np.ones((1, 4), np.int64)
    assert codebooks.nearest(big, codebooks.tree(big), rng.integers(-1000, 1000, (2000, 4)))[2] < 0.6 * 2000 * 64  # branches are spared


DOCS = "doc_id long, text string, label string, n int, rep long, shared long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def join_brute(rows, percent=85):
    def shingles(t):
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())

    s = [shingles(r[1]) for r in rows]
    up = list(range(len(s)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            n = len(s[i] & s[j])
            if n and 100 * n >= percent * len(s[i] | s[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return sorted((rows[i][0], len(s[i]), rows[find(i)][0]) for i in range(len(rows)))


def texts():
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(80)] + ["É", "δ,", "x"]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows = [" ".join(some(r.randint(0, 60))) for _ in range(40)]
    for size in (12, 40, 150):  # families around the limit, chains included
        x = some(size)
        for _ in range(25):
            y = list(x)
            for _ in range(r.randint(0, max(1, size // 25))):
                y[r.randrange(size)] = r.choice(vocabulary)
            rows.append(" ".join(y if r.random() < 0.7 else y[: size - size // 12]))
            if r.random() < 0.3:
                x = y
    shared = " ".join(some(90))
    rows += [shared + " " + " ".join(some(30)) for _ in range(15)] + [shared] * 4 + [shared.upper()]
    rows += ["", None, "  \n", "one two", "One  two", "one two three four", "a" * 5000, "ab " * 3000, "ab " * 2000, " ".join(some(20_000))]
    return [(100 + 3 * i, t, "l", 1, 2, 3) for i, t in enumerate(rows)]


@pytest.mark.parametrize("given", [{}, {"group_texts": 4}, {"group_texts": 4, "splits": 1}, {"group_shingles": 300}, {"splits": 0}, {"splits": 0, "group_texts": 6, "pairs": 0}, {"splits": 0, "pairs": 1 << 30}])
def test_ngram_join(spark, given, monkeypatch):
    given = dict(given)
    monkeypatch.setattr(triejoin, "PAIRS", given.pop("pairs", triejoin.PAIRS))
    rows = texts()
    got = triejoin.jaccard_join(spark.createDataFrame(rows, DOCS).repartition(3), **given).collect()
    assert sorted(map(tuple, got)) == join_brute(rows)


def test_ngram_join_of_little(spark):
    assert triejoin.jaccard_join(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c d e", "l", 1, 2, 3), (None, None, "l", 1, 2, 3), (5, "a b c d e", "l", 1, 2, 3), (5, "a b c d e", "l", 1, 2, 3), (4, "A b c d e", "l", 1, 2, 3)]
    got = triejoin.jaccard_join(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 2, None), (None, 0, None), (5, 2, 4), (5, 2, 4), (4, 2, 4)], key=repr)


def test_trie_spares_what_cannot_link():
    r = np.random.default_rng(1)
    family = [np.unique(np.concatenate((np.arange(100), r.integers(100, 10_000, 4)))).astype(np.uint64) for _ in range(200)]
    sizes = np.array([len(x) for x in family])
    labels, whole = triejoin.join(family, sizes, np.arange(200), 85)
    assert set(labels) == {0}
    labels, steps = triejoin.join(family, sizes, np.arange(200), 85, cells=1 << 11)  # blocks of few queries
    assert set(labels) == {0} and steps < whole / 2  # equal labels end the search
    apart = [np.unique(np.concatenate((np.arange(40), r.integers(100, 10_000, 60)))).astype(np.uint64) for _ in range(200)]
    sizes = np.array([len(x) for x in apart])
    labels, steps = triejoin.join(apart, sizes, np.arange(200), 85)
    assert (labels == np.arange(200)).all() and steps < 200 * 200 / 4  # remaining lengths do


@pytest.mark.parametrize("alone", [0, 1 << 20])
def test_components_by_both_ways(spark, alone):
    r = random.Random(alone)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 6000 + i) for i in range(100)] + [(7, 7)]
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {x["node"]: x["label"] for x in base.components(spark.createDataFrame(edges, "a long, b long").repartition(5), alone=alone).collect()}
    assert got == {x: find(x) for x in up}
    assert base.components(spark.createDataFrame([], "a long, b long"), alone=alone).count() == 0


def test_near_duplicates_by_both_ways_of_components(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in texts()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(tuple, neardup.near_duplicates(docs).collect()))
    monkeypatch.setattr(base.components, "__defaults__", (60, 0))
    assert sorted(map(tuple, neardup.near_duplicates(docs).collect())) == one


@pytest.mark.parametrize("name,table", [("op11_prefix_trie", "conversations"), ("op12_vector_codes", "embeddings")])
def test_queries_equal_their_sql(spark, name, table):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_op13_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in base.table(spark, sf, "documents").select("doc_id", "text").orderBy("doc_id").collect()]
    assert sorted(map(tuple, queries.op13_ngram_join(spark, sf).select("doc_id", "n_shingles", "component_id").collect())) == join_brute(rows)


PAGES = "page_id long, url string, html string, host string"


def test_articles_in_usual_markup(spark):
    from brackenlake.llm import pages

    cases = {
        '<article class="post has-sidebar"><p>one</p></article>': "one", '<div class="layout no-sidebar"><article>two</article></div>': "two", "<article><form>text</form></article>": "text",
        '<form id="all"><input type="hidden"><main><p>three</p></main></form>': "three", "<article>a<form><input>b</form>c</article>": "a c", "<form>x<button>go</button></form><article>d</article>": "d",
        '<section class="comments"><article class="comment">e</article></section><article>f</article>': "f", '<article class="comment">g</article>': "", "<form><article>open": "open", "<main>a <select><option>1</select> b</main>": "a b",
        '<div class="site-header">h</div><aside>i</aside><main>j<div class="post-comments">k</div></main>': "j", "<main>" + "word " * 200_000 + "</main>": " ".join(["word"] * 200_000),
    }
    rows = [(i, f"http://h{i}.org/", h, "x") for i, h in enumerate(cases)]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == dict(enumerate(cases.values()))
    assert pages.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_columns_of_users_stay(spark):
    from brackenlake.llm import decontaminate, licenses, pii

    rows = [(1, "call +1 212 555 0100 or a@b.org now", 88, "f", "h"), (2, "one two three four five six seven eight nine ten eleven", 77, "g", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, finds string, HITS string")
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    for sent in (1 << 20, 0):
        left = decontaminate.clean(docs, bench, sent)
        assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == rows[:1]
    out = pii.pseudonymise(docs, "key").orderBy("doc_id").collect()
    assert [(r["row"], r["finds"], r["HITS"], r["n_pii"]) for r in out] == [(88, "f", "h", 2), (77, "g", "i", 0)]
    body = " ".join(licenses.TEMPLATES["mit"].split()) if isinstance(licenses.TEMPLATES["mit"], str) else ""
    twice = spark.createDataFrame([(1, body), (1, body + " " + body), (1, "nothing")], "doc_id long, text string")
    got = licenses.scan(twice).where("template = 'mit'").collect()
    assert len(got) == 1 and got[0]["n_shared"] == got[0]["n_shingles"]


def test_near_duplicates_of_a_family_under_the_limit(spark):
    """Chains between texts that no hub links."""
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(400)]
    base_ = [r.choice(vocabulary) for _ in range(120)]
    rows = []
    for f in range(8):  # families that share half of their words, chains within each
        x = base_[:60] + [r.choice(vocabulary) for _ in range(60)]
        for _ in range(9):
            rows.append(" ".join(x))
            x = list(x)
            at = r.randrange(60, 118)
            x[at : at + 2] = [r.choice(vocabulary) for _ in range(2)]
    rows = [(i, t) for i, t in enumerate(rows)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    assert got == {i: find(i) for i in range(len(rows))}
