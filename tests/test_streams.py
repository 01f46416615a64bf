"""Streams with state across restarts, late data, and index versions by micro-batch."""

import pytest
from pyspark.sql import functions as F

from brackenlake import queries  # noqa: F401
from brackenlake.operators import index, segments
from brackenlake.streaming import sessions

BLOCK = "session_id string, event_id long, ts string, kind string, content string"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    sessions.keep_state(spark)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


class Feed:
    """A folder of rows that a stream reads, a file a call."""

    def __init__(self, spark, at, schema):
        self.spark, self.at, self.schema, self.n = spark, str(at), schema, 0

    def put(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.parquet(f"{self.at}/{self.n}")
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.at}/*")


def run(df, out, checkpoint, mode="append"):
    q = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_sessions_are_not_forgotten_over_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", BLOCK)
    days = [f"2024-0{m}-01 00:00:00" for m in range(1, 8)]
    feed.put(("a", 1, days[0], "block", "x"), ("a", 2, days[0], "block", "x"), ("b", 3, days[0], "block", "x"), ("", 4, days[0], "block", "x"), ("a", 5, days[0], "block", ""), (None, 6, days[0], "block", "x"))
    run(sessions.first_blocks(feed.stream()), tmp_path / "out", tmp_path / "c")
    feed.put(("a", 7, days[3], "block", "x"), ("a", 8, days[3], "block", "y"))  # months later
    run(sessions.first_blocks(feed.stream()), tmp_path / "out", tmp_path / "c")
    feed.put(("a", 9, days[4], "clear", None), ("a", 10, days[5], "block", "x"), ("b", 11, days[5], "block", "x"))
    run(sessions.first_blocks(feed.stream()), tmp_path / "out", tmp_path / "c")
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3, 8, 10]


def test_recent_events_are_a_ring(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "k string, event_id long, ts string")
    out = {}

    def collect(df, _):
        for k in {r["key"] for r in df.select("key").distinct().collect()}:
            out[k] = [r["event_id"] for r in df.where(F.col("key") == k).orderBy("us").collect()]

    for part in range(3):
        feed.put(*[("a", 10 * part + i, f"2024-01-01 00:0{part}:0{i}") for i in range(4)], *([("b", 99, "2024-01-01 00:00:00")] if part == 0 else []))
        q = sessions.recent(feed.stream(), "k", 6).writeStream.foreachBatch(collect).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert out == {"a": [12, 13, 20, 21, 22, 23], "b": [99]}


def test_session_windows_with_late_data(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "user_id long, ts string")
    t = lambda h, m: f"2024-01-01 {h:02d}:{m:02d}:00"
    feed.put((1, t(1, 0)), (1, t(1, 20)), (2, t(1, 5)))
    feed.put((1, t(1, 45)), (1, t(4, 0)))  # joins the span before; then time goes on
    feed.put((1, t(4, 1)))  # rows are late by the mark of the batch before
    feed.put((1, t(1, 50)), (1, t(3, 45)), (9, t(9, 0)))  # the first is too late, the second is not
    feed.put((9, t(12, 0)))
    run(sessions.sessions(feed.stream().withColumn("ts", F.col("ts").cast("timestamp")), "user_id"), tmp_path / "out", tmp_path / "c")
    got = sorted((r["user_id"], r["start"].strftime("%H:%M"), r["end"].strftime("%H:%M"), r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "01:00", "02:15", 3), (1, "03:45", "04:31", 3), (2, "01:05", "01:35", 1), (9, "09:00", "09:30", 1)]


def test_requests_join_completions_or_come_alone(spark, tmp_path):
    kind = "correlation_id string, event_id long, ts string"
    asked, done = Feed(spark, tmp_path / "asked", kind), Feed(spark, tmp_path / "done", kind)
    t = lambda h, m: f"2024-01-01 {h:02d}:{m:02d}:00"
    asked.put(("x", 1, t(1, 0)), ("y", 2, t(1, 0)), ("z", 3, t(1, 10)))
    done.put(("x", 11, t(1, 30)), ("y", 12, t(0, 59)), ("z", 13, t(2, 30)))
    asked.put(("w", 4, t(5, 0)))
    done.put(("w", 14, t(5, 1)), ("x", 15, t(1, 40)))  # the second comes after the watermark has passed, in time or not as the batch falls
    asked.put(("v", 5, t(9, 0)))
    done.put(("v", 16, t(9, 0)))
    run(sessions.answered(asked.stream(), done.stream()), tmp_path / "out", tmp_path / "c")
    got = {(r["correlation_id"], r["request_id"], r["completion_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got >= {("x", 1, 11), ("y", 2, None), ("z", 3, None), ("w", 4, 14), ("v", 5, 16)} and ("x", 1, None) not in got


CHANGE = "repository_id string, path string, language string, content string, deleted boolean, at long"


def test_an_index_follows_changes_once(spark, tmp_path, monkeypatch):
    at, feed = str(tmp_path / "index"), Feed(spark, tmp_path / "in", CHANGE)
    q = spark.createDataFrame([(1, "alpha")], "query_id int, term string")
    files = lambda: sorted(r["path"] for r in index.search(spark, at, q).collect())
    feed.put(("r", "a.py", "python", "alpha", False, 1), ("r", "b.py", "python", "beta", False, 1), ("r", "b.py", "python", "alpha", False, 2), ("r", "c.py", "python", "alpha", False, 1), ("r", "c.py", "python", None, True, 3))
    sessions.follow(feed.stream(), at, str(tmp_path / "c")).awaitTermination(120)
    assert files() == ["a.py", "b.py"] and segments.open_(spark, at).version == 0
    feed.put(("r", "a.py", "python", None, True, 4), ("r", "d.py", "python", "alpha alpha", False, 4))
    change = segments.change

    def stops(*given):
        change(*given)
        raise RuntimeError("stopped after the commit")

    with monkeypatch.context() as m:
        m.setattr(segments, "change", stops)
        broken = sessions.follow(feed.stream(), at, str(tmp_path / "c"))
        with pytest.raises(Exception, match="stopped after the commit"):
            broken.awaitTermination(120)
    segments.invalidate(at)
    assert segments.open_(spark, at).version == 1 and files() == ["b.py", "d.py"]
    size = len(segments.open_(spark, at).state["segments"])
    sessions.follow(feed.stream(), at, str(tmp_path / "c")).awaitTermination(120)  # the batch runs again
    assert segments.open_(spark, at).version == 1 and files() == ["b.py", "d.py"] and len(segments.open_(spark, at).state["segments"]) == size
    feed.put(("r", "b.py", "python", "gamma", False, 5))
    sessions.follow(feed.stream(), at, str(tmp_path / "c")).awaitTermination(120)
    assert segments.open_(spark, at).version == 2 and files() == ["d.py"] and segments.open_(spark, at).n_files == 2
