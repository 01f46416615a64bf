"""Event streams: windows with late data, sessions, rate limits, debounce, incremental upkeep."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scans

RATE, BURST = 10.0, 20.0
DEBOUNCE = 0.5


def windowed(events: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type, for a stream or a table; events later than `late` are left out of a stream."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_blocks(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Blocks that a session has not sent before, within the watermark."""
    return stream.withWatermark("ts", late).withColumn("hash", F.sha2("content", 256)).dropDuplicatesWithinWatermark(["session_id", "hash"])


def _bucket(left: float | None, last: int | None, at: int, rate: float, burst: float) -> tuple[float, bool]:
    """What a bucket holds after an event, in millionths of a token, and whether the event passed; times are microseconds."""
    left = burst * 1e6 if last is None else min(burst * 1e6, left + (at - last) * rate)
    return (left - 1e6, True) if left >= 1e6 else (left, False)


def limit_rate(events: DataFrame, session: str, rate: float = RATE, burst: float = BURST) -> DataFrame:
    """(session, event_id, ts, allowed): a token bucket a session, over events in order of time and event_id.

    Sessions are dealt to sorted partitions and read as a stream, so no session is held in memory.
    """
    kind = dict(events.dtypes)[session]
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        who, left, last = None, None, None
        for pdf in batches:
            out = []
            for s, at in zip(pdf["session"], pdf["us"]):
                if last is None or s != who:
                    who, left, last = s, None, None
                left, ok = _bucket(left, last, at, rate, burst)
                last = at
                out.append(ok)
            yield pd.DataFrame({"session": pdf["session"], "event_id": pdf["event_id"], "ts": pdf["ts"], "allowed": out})

    ts = F.col("ts").cast("timestamp")
    e = events.where(F.col(session).isNotNull() & F.col("ts").isNotNull()).select(F.col(session).alias("session"), "event_id", ts.alias("ts"), F.unix_micros(ts).alias("us"))
    e = e.repartition(n, "session").sortWithinPartitions("session", "us", "event_id")
    return e.mapInPandas(run, f"session {kind}, event_id {dict(events.dtypes)['event_id']}, ts timestamp, allowed boolean")


def limit_stream(stream: DataFrame, session: str, rate: float = RATE, burst: float = BURST) -> DataFrame:
    """(session, event_id, allowed) of a stream of events: each session's bucket is kept as state between micro-batches; it is dropped after a minute without events, when it is full again anyway."""
    kind = dict(stream.dtypes)[session]

    def run(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        left, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(pdfs)).sort_values(["us", "event_id"])
        out = []
        for at in rows["us"].tolist():
            left, ok = _bucket(left, last, at, rate, burst)
            last = at
            out.append(ok)
        state.update((left, last))
        state.setTimeoutDuration(60_000)
        yield pd.DataFrame({"session": rows["session"], "event_id": rows["event_id"], "allowed": out})

    e = stream.select(F.col(session).alias("session"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return e.groupBy("session").applyInPandasWithState(run, f"session {kind}, event_id long, allowed boolean", "left double, last long", "append", "ProcessingTimeTimeout")


def debounce(times: list[float], wait: float = DEBOUNCE) -> list[float]:
    """When a change is acted on: a fixed time after the first event of a burst; later ones don't put it off."""
    out: list[float] = []
    for t in sorted(times):
        if not out or t > out[-1]:
            out.append(t + wait)
    return out


def debounce_events(events: DataFrame, key: str, wait: float = DEBOUNCE) -> DataFrame:
    """(key, fired): when changes (key, at in seconds) are acted on, key by key.

    Keys are dealt to sorted partitions and read as a stream, so no key is held in memory.
    """
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        who, until, begun = None, 0.0, False
        for pdf in batches:
            keys, fired = [], []
            for k, at in zip(pdf[key], pdf["at"]):
                if not begun or k != who or at > until:
                    who, until, begun = k, at + wait, True
                    keys.append(k)
                    fired.append(until)
            yield pd.DataFrame({key: pd.Series(keys, dtype=pdf[key].dtype), "fired": pd.Series(fired, dtype=float)})

    e = events.where(F.col(key).isNotNull() & F.col("at").isNotNull()).select(key, "at")
    e = e.repartition(n, key).sortWithinPartitions(key, "at")
    return e.mapInPandas(run, f"{key} {events.schema[key].dataType.simpleString()}, fired double")


def debounce_stream(stream: DataFrame, key: str, wait_ms: int = 500) -> DataFrame:
    """(key, n) of a stream of changes: a burst comes out once its timer ends, set by its first change and not put off by later ones."""
    kind = dict(stream.dtypes)[key]

    def run(k, pdfs, state):
        if state.hasTimedOut:
            n = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "n": [n]})
            return
        n = sum(map(len, pdfs))
        if state.exists:
            state.update((state.get[0] + n, state.get[1]))
            state.setTimeoutDuration(max(1, state.get[1] - state.getCurrentProcessingTimeMs()))
        else:
            until = state.getCurrentProcessingTimeMs() + wait_ms
            state.update((n, until))
            state.setTimeoutDuration(wait_ms)

    return stream.select(key).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, n long", "n long, until long", "append", "ProcessingTimeTimeout")


def head_changes(commits: DataFrame) -> DataFrame:
    """Rows (repository_id, ts, oid) whose commit is not that of the row before; rows of no repository are left out."""
    known = scans.scan(commits.where("repository_id is not null"), ["repository_id", "ts"], "repository_id", last=("oid",))
    return known.where(F.col("prev_oid").isNull() | (F.col("prev_oid") != F.col("oid"))).drop("prev_oid")


def last_n(events: DataFrame, n: int = 1000) -> DataFrame:
    """The latest events, as a ring buffer would hold them."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def keep_indexed(stream: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str):
    """Run apply on each micro-batch of changed files; started with what is available."""
    return stream.writeStream.foreachBatch(lambda df, _: apply(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def by_correlation(events: DataFrame, correlation: str) -> DataFrame:
    return events.where(F.col("correlation_id") == correlation)


def forget_session(blocks: DataFrame, session: str) -> DataFrame:
    """Blocks seen so far without those of a session, which then counts as new."""
    return blocks.where(F.col("session_id") != session)


def readiness(events: DataFrame) -> DataFrame:
    """(repository_id, since, until, state): spans between events (repository_id, ts, kind) that begin ('started') and end ('completed', 'failed') an indexing.

    A repository is 'indexing' from a start on and 'ready' from its end on; the last span is open.
    """
    state = F.when(F.col("kind") == "started", "indexing").when(F.col("kind").isin("completed", "failed"), "ready")
    s = events.where("repository_id is not null").select("repository_id", "ts", state.alias("state")).where("state is not null")
    s = scans.scan(s, ["repository_id", "ts"], "repository_id", last=("state",))
    turns = s.where(F.col("prev_state").isNull() | (F.col("prev_state") != F.col("state"))).select("repository_id", F.col("ts").alias("since"), "state")
    spans = scans.scan(turns, ["repository_id", F.col("since").desc()], "repository_id", last=("since",))  # the next one is the one before in falling order
    return spans.select("repository_id", "since", F.col("prev_since").alias("until"), "state")


def index_age(events: DataFrame, now) -> DataFrame:
    """(repository_id, age): seconds since the last completed indexing, null while one runs or if there was none."""
    last = events.groupBy("repository_id").agg(F.max_by("kind", "ts").alias("kind"), F.max(F.when(F.col("kind") == "completed", F.col("ts"))).alias("done"))
    return last.select("repository_id", F.when(F.col("kind") != "started", F.greatest(F.lit(0), F.lit(now) - F.col("done"))).alias("age"))
