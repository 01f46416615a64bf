"""The stored index: phrases, pruning, snapshots, writers that stop, replays, merging."""

import pytest
from pyspark.sql import functions as F

from brackenlake import queries  # noqa: F401
from brackenlake.operators import index, segments
from brackenlake.sources import commits

SCHEMA = "repository_id string, path string, language string, content string"


def rows(df):
    return sorted((r["query_id"], r["rank"], r["repository_id"], r["path"], round(r["score"], 6)) for r in df.collect())


def asked(spark, *requests):
    return spark.createDataFrame([(i, t.split()) for i, r in enumerate(requests) for t in r], "query_id int, tokens array<string>")


@pytest.fixture(scope="module")
def corpus(spark):
    words = ["alpha", "beta", "gamma", "delta", "rare"]
    out = []
    for i in range(600):
        text = " ".join(words[(i * 7 + j * j) % 4] for j in range(3 + i % 11))
        if i % 97 == 0:
            text += " rare" * (1 + i // 97) + " alpha_beta index.d.ts"
        out.append((f"r{i % 2}", f"src/f{i:03d}.py", "python", text))
    return spark.createDataFrame(out + [("r0", "none.py", "python", None), ("r0", "empty.py", "python", "")], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame([(1, "alpha"), (1, "rare"), (2, "gamma"), (2, "f007"), (3, "nowhere")], "query_id int, term string")


def test_search_equals_scan_however_it_prunes(spark, corpus, terms, tmp_path):
    s = segments.build(corpus, str(tmp_path), range_files=16)
    want = rows(index.bm25(corpus, terms, 7))
    for direct, lead in ((1 << 40, 8), (0, 1), (0, 4), (0, 100)):
        report = []
        assert rows(segments.search(s, segments.clauses_of(terms), 7, None, direct, lead, report)) == want
        assert report[0]["ranges"] is None or report[0]["scored"] <= report[0]["ranges"]
    only = F.col("repository_id") == "r1"
    assert rows(segments.search(s, segments.clauses_of(terms), 7, only, 0, 1)) == rows(index.bm25(corpus, terms, 7, only))
    assert segments.search(s, segments.clauses_of(terms.where("query_id = 3")), 7).count() == 0


def test_ranges_below_the_threshold_are_not_scored(spark, corpus, tmp_path):
    s = segments.build(corpus, str(tmp_path), range_files=16)
    report = []
    found = segments.search(s, asked(spark, ["rare", "alpha"]), 2, None, 0, 2, report)
    assert rows(found) == rows(index.bm25(corpus, spark.createDataFrame([(0, "rare"), (0, "alpha")], "query_id int, term string"), 2))
    assert report[0]["scored"] * 2 < report[0]["ranges"] and report[0]["read"] * 2 < report[0]["stored"]


def test_groups_below_the_threshold_are_not_read(spark, tmp_path):
    rows = [("r", f"d{i // 100:02d}/f{i:04d}.txt", "text", ("needle " * (5 if i % 10 == 0 else 1) if i < 200 else "") + "hay " * (1 + i % 3) + f"w{i % 50}") for i in range(2400)]
    c = spark.createDataFrame(rows, SCHEMA).repartitionByRange(24, "path")
    s = segments.build(c, str(tmp_path), range_files=25)
    report = []
    found = segments.search(s, asked(spark, ["needle", "hay"]), 10, None, 0, 4, report)
    assert rows_of(found) == rows_of(index.bm25(c, spark.createDataFrame([(0, "needle"), (0, "hay")], "query_id int, term string"), 10))
    assert report[0]["bytes"] * 4 < report[0]["bytes_stored"] and report[0]["scored"] * 4 < report[0]["ranges"]


def rows_of(df):
    return sorted((r["rank"], r["path"], round(r["score"], 6)) for r in df.collect())


def brute_phrase(texts, tokens):
    def count(words):
        return sum(words[i : i + len(tokens)] == tokens for i in range(len(words) - len(tokens) + 1))

    return {k: count(v) for k, v in texts.items() if count(v)}


def test_phrases_count_consecutive_positions(spark, tmp_path):
    texts = {"a": "x y x y z", "b": "y x", "c": "x x x", "d": "x z y", "e": ""}
    c = spark.createDataFrame([("r", k, "text", v) for k, v in texts.items()], SCHEMA)
    s = segments.build(c, str(tmp_path), range_files=2)
    words = {k: v.split() for k, v in texts.items()}
    n = len(texts)
    average = sum(map(len, words.values())) / n
    import math

    idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t in "xyz" if (d := sum(t in w for w in words.values()))}
    for tokens in (["x", "y"], ["x", "x"], ["y", "x", "y"], ["x", "y", "z"], ["z", "x"]):
        want = {k: sum(idf[t] for t in tokens) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[k]) / average)) for k, tf in brute_phrase(words, tokens).items()}
        for direct in (1 << 30, 0):
            got = {r["path"]: r["score"] for r in segments.search(s, spark.createDataFrame([(1, tokens)], "query_id int, tokens array<string>"), 10, None, direct).collect()}
            assert got == pytest.approx(want), tokens


def test_a_reader_keeps_its_version(spark, corpus, terms, tmp_path):
    at = str(tmp_path)
    first = segments.build(corpus, at, range_files=32)
    before = rows(segments.search(first, segments.clauses_of(terms), 9))
    held = segments.cached(spark, at)
    changed = spark.createDataFrame([("r0", "src/f000.py", "python", "gamma gamma"), ("r0", "new.py", "python", "alpha rare")], SCHEMA)
    second = segments.change(spark, at, changed, corpus.where("path = 'src/f194.py'"))
    assert (first.version, second.version, second.n_files) == (0, 1, 602)
    now = corpus.where("path not in ('src/f000.py', 'src/f194.py')").unionByName(changed)
    want = rows(index.bm25(now, terms, 9))
    assert rows(segments.search(second, segments.clauses_of(terms), 9)) == want and want != before
    assert rows(segments.search(held, segments.clauses_of(terms), 9)) == before
    assert rows(segments.search(segments.open_(spark, at, 0), segments.clauses_of(terms), 9)) == before
    assert segments.cached(spark, at).version == 1  # a commit of this process ends what was kept
    merged = segments.merge(spark, at, range_files=32)
    assert len(merged.state["segments"]) == 1 and not merged.state["gone"] and merged.state["totals"] == second.state["totals"]
    for direct in (1 << 30, 0):
        assert rows(segments.search(merged, segments.clauses_of(terms), 9, None, direct)) == want
    phrase = asked(spark, ["alpha beta"]).select("query_id", F.split(F.concat_ws(" ", "tokens"), " ").alias("tokens"))
    fresh = segments.build(now, str(tmp_path / "fresh"))
    assert rows(segments.search(merged, phrase, 9)) == rows(segments.search(fresh, phrase, 9))
    gone = segments.vacuum(spark, at, keep=1)
    assert any(g.startswith("segments/") for g in gone) and any(g.startswith("gone/") for g in gone)
    assert rows(segments.search(segments.open_(spark, at), segments.clauses_of(terms), 9)) == want
    with pytest.raises(FileNotFoundError):
        segments.open_(spark, at, 0)


def test_small_segments_merge_beside_a_large_one(spark, corpus, terms, tmp_path):
    at = str(tmp_path)
    segments.build(corpus, at)
    for i in range(3):  # each replaces a file of the one before
        segments.change(spark, at, spark.createDataFrame([("r0", "new.py", "python", "alpha " * (i + 1)), ("r1", f"n{i}.py", "python", "rare")], SCHEMA), corpus.where(f"path = 'src/f00{i}.py'"))
    want = rows(segments.search(segments.open_(spark, at), segments.clauses_of(terms), 9))
    merged = segments.merge(spark, at, most=10)
    assert [s["files"] for s in merged.state["segments"]] == [602, 4] and len(merged.state["gone"]) == 3
    assert rows(segments.search(merged, segments.clauses_of(terms), 9)) == want


@pytest.mark.parametrize("stop", ["_write_bounds", "_commit"])
def test_a_writer_that_stops_leaves_the_last_version(spark, corpus, terms, tmp_path, monkeypatch, stop):
    at = str(tmp_path)
    segments.build(corpus, at)
    before = rows(segments.search(segments.open_(spark, at), segments.clauses_of(terms), 9))
    changed = spark.createDataFrame([("r1", "src/f001.py", "python", "rare rare")], SCHEMA)

    def fail(*_, **__):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(segments, stop, fail)
        with pytest.raises(RuntimeError):
            segments.change(spark, at, changed, corpus.where("path = 'src/f002.py'"))
    last = segments.open_(spark, at)
    assert last.version == 0 and rows(segments.search(last, segments.clauses_of(terms), 9)) == before
    after = segments.change(spark, at, changed, corpus.where("path = 'src/f002.py'"))
    now = corpus.where("path not in ('src/f001.py', 'src/f002.py')").unionByName(changed)
    assert rows(segments.search(after, segments.clauses_of(terms), 9)) == rows(index.bm25(now, terms, 9))
    assert segments.vacuum(spark, at, keep=1)  # what the stopped writer left
    assert rows(segments.search(segments.open_(spark, at), segments.clauses_of(terms), 9)) == rows(index.bm25(now, terms, 9))


def test_of_two_writers_of_a_version_one_wins(spark, tmp_path):
    at = str(tmp_path)
    commits.commit(spark, at, 0, {"by": 1})
    with pytest.raises(FileExistsError):
        commits.commit(spark, at, 0, {"by": 2})
    assert commits.versions(spark, at) == [0] and commits.read(spark, at, 0) == {"by": 1}


def test_a_batch_is_applied_once(spark, corpus, terms, tmp_path):
    at = str(tmp_path)
    segments.build(corpus, at)
    changed = spark.createDataFrame([("r1", "src/f001.py", "python", "rare rare")], SCHEMA)
    one = segments.change(spark, at, changed, corpus.limit(0), ("files", 4))
    two = segments.change(spark, at, changed, corpus.limit(0), ("files", 4))
    assert one.version == two.version == 1 and two.n_files == 602
    assert segments.change(spark, at, changed, corpus.limit(0), ("files", 5)).version == 2


def test_larger_batches_are_searched_in_parts(spark, corpus, tmp_path, monkeypatch):
    s = segments.build(corpus, str(tmp_path))
    many = spark.createDataFrame([(i, t) for i in range(20) for t in ("alpha", "rare", f"f{i:03d}")], "query_id int, term string")
    want = rows(segments.search(s, segments.clauses_of(many), 3))
    monkeypatch.setattr(segments, "BATCH", 10)
    reports = []
    assert rows(segments.search(s, segments.clauses_of(many), 3, reports=reports)) == want and len(reports) > 2


def test_empty_index(spark, corpus, terms, tmp_path):
    s = segments.build(corpus.limit(0), str(tmp_path))
    assert s.n_files == 0 and segments.search(s, segments.clauses_of(terms), 3).count() == 0 and index.validate(spark, str(tmp_path)) == "empty"
    s = segments.change(spark, str(tmp_path), corpus, corpus.limit(0))
    assert rows(segments.search(s, segments.clauses_of(terms), 3)) == rows(index.bm25(corpus, terms, 3))


def test_guarded_search(spark, corpus, tmp_path):
    from brackenlake.plans import retrieve

    at = str(tmp_path)
    asked = spark.createDataFrame([(1, "rare"), (2, "lph"), (3, "zzz nothing")], "query_id int, query string")

    def run():
        out = {}
        for r in retrieve.guarded(corpus, asked, at, 5).collect():
            out.setdefault((r["query_id"], r["how"]), []).append((r["path"], r["line"]))
        return out

    first = run()  # there is no index
    assert set(first) == {(1, "FallbackUsed"), (2, "FallbackUsed")} and len(first[2, "FallbackUsed"]) == 5
    segments.build(corpus, at)
    got = run()
    assert set(got) == {(1, "Found"), (2, "FallbackUsed")} and got[2, "FallbackUsed"] == first[2, "FallbackUsed"]
    held = segments.cached(spark, at)
    segments.change(spark, at, corpus.limit(0), corpus.where("path = 'src/f485.py'"))
    segments.merge(spark, at)
    segments.vacuum(spark, at, keep=1)
    segments._OPEN[at] = held  # a reader that opened before the files went
    assert "src/f485.py" in {p for p, _ in got[1, "Found"]} and "src/f485.py" not in {p for p, _ in run()[1, "Found"]}


def test_an_opened_index_is_built_once(spark, corpus, tmp_path, monkeypatch):
    from brackenlake.plans import upkeep

    corpus.write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    monkeypatch.setattr(upkeep.store, "shared_dir", lambda _: str(tmp_path))
    one = upkeep.opened(files, "a")
    assert upkeep.opened(files, "a").path == one.path and one.version == 0
    build = segments.build

    def late(c, at):  # another job commits first
        build(c, at)
        return build_again(c, at)

    def build_again(c, at):
        monkeypatch.setattr(segments, "_last", lambda *_: {"version": -1, "next": 5, "files": 0, "totals": [0] * 6, "segments": [], "gone": [], "batches": {}})
        return build(c, at)

    monkeypatch.setattr(segments, "build", late)
    assert upkeep.opened(files, "b").version == 0


def test_groups_are_bounded_and_written_in_order(spark, corpus, terms, tmp_path, monkeypatch):
    at = str(tmp_path / "a")
    s = segments.build(corpus.coalesce(1), at, range_files=8)  # a group has 16 ranges
    files = s.files().collect()
    names = {}
    for f in files:
        names.setdefault(f["grp"], {})[f["doc"]] = (f["repository_id"], f["path"])
    assert sorted(len(g) for g in names.values()) == [602 - 4 * 128] + [128] * 4
    assert all([g[i] for i in range(len(g))] == sorted(g.values()) for g in names.values())
    assert all(f["range"] == f["doc"] // 8 for f in files)
    want = rows(index.bm25(corpus, terms, 7))
    assert rows(segments.search(s, segments.clauses_of(terms), 7)) == want
    monkeypatch.setattr(segments, "TOKENS", 500)
    s = segments.build(corpus.coalesce(1), str(tmp_path / "b"))
    size = s.files().groupBy("grp").agg(F.sum(F.aggregate("field_lens", F.lit(0), lambda a, x: a + x)).alias("n"))
    assert size.agg(F.max("n")).first()[0] <= 500 and size.count() > 5
    assert rows(segments.search(s, segments.clauses_of(terms), 7)) == want


def test_writing_neither_sorts_nor_shuffles(spark, corpus, tmp_path):
    tracker, group = spark.sparkContext.statusTracker(), f"build-{tmp_path.name}"
    spark.range(1).collect()
    corpus.write.parquet(str(tmp_path / "files"))
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.sparkContext.setJobGroup(group, "build")
    try:
        segments.build(spark.read.schema(SCHEMA).parquet(str(tmp_path / "files")), str(tmp_path / "index"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(group)]
    assert len(stages) >= 3 and stages.count(1) >= len(stages) - 1  # totals alone are summed over tasks
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == kept


def test_level_files_of_a_common_clause_come_out_once(spark, tmp_path):
    """Requests of one common clause and a rare one: rows of a group do not grow with its level files, and names decide."""
    texts = [("r", f"f{i:04d}.txt", "text", f"same words id{i}") for i in range(400)]
    c = spark.createDataFrame(texts, SCHEMA).repartition(3)
    s = segments.build(c, str(tmp_path), range_files=8)
    many = [(i, t) for i in range(0, 400, 10) for t in ("same", f"id{i}")]
    asked_ = spark.createDataFrame(many, "query_id int, term string")
    want = rows(index.bm25(c, asked_, 5))
    for direct in (1 << 30, 0):
        assert rows(segments.search(s, segments.clauses_of(asked_), 5, None, direct, 1)) == want
    only = F.col("path") > "f0200.txt"
    assert rows(segments.search(s, segments.clauses_of(asked_), 5, only)) == rows(index.bm25(c, asked_, 5, only))
    held = segments.clauses_of(asked_).select("query_id", F.array_join("tokens", " ").alias("clause"), F.lit(1).cast("long").alias("times"), F.lit(1).alias("m"), F.posexplode("tokens").alias("j", "term"))
    found = segments.Search(s, held.collect(), held.schema, 5, None, 1 << 30, 1).scored(None, None)
    groups = s.files().select("grp").distinct().count()
    assert found.count() <= 40 + 5 * groups


def test_postings_by_repository(spark, corpus, tmp_path, monkeypatch):
    s = segments.build(corpus, str(tmp_path), range_files=16)
    want = {(r["repository_id"], r["term"]): (r["n"], r["tf"]) for r in index.postings(index.fields(corpus)).where("field = 'content'").groupBy("repository_id", "term").agg(F.count("*").alias("n"), F.sum("tf").alias("tf")).collect()}
    for most in (segments.RUNS, 0):
        monkeypatch.setattr(segments, "RUNS", most)
        o = segments.owned(s, ["content"]).groupBy("repository_id", "term").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"))
        assert {(r["repository_id"], r["term"]): (r["n"], r["tf"]) for r in o.collect()} == want
