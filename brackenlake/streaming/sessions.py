"""Sessions: state that does not expire, windows by inactivity, requests joined with their completions, changed files to versions of an index."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import segments

FILE = ["repository_id", "path"]
#: Events that are kept of each key.
RECENT = 1000
#: The kind of an event that makes a session forget.
CLEAR = "clear"


def keep_state(spark: SparkSession) -> None:
    """State of streams that are started after this is held on disk, so it may outgrow memory; tables may be read as one batch."""
    _ = spark.streams.active  # state of a table's batch is found through what this begins
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _FirstBlocks(StatefulProcessor):
    """Blocks by hash that a session has not had since it was cleared."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "hash string", "event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        every = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")  # one micro-batch of one session
        out = []
        for i, (kind, digest, event) in enumerate(zip(every["kind"], every["hash"], every["event_id"])):
            if kind == CLEAR:
                self.seen.clear()
            elif not self.seen.containsKey((digest,)):
                self.seen.updateValue((digest,), (int(event),))
                out.append(i)
        yield every.iloc[out][["session_id", "event_id", "hash"]]

    def close(self) -> None:
        pass


def first_blocks(events: DataFrame) -> DataFrame:
    """(session_id, event_id, hash) of blocks that their session has not sent before, however long ago.

    events: session_id string, event_id long, ts, kind, content; an event of the kind 'clear' makes
    its session forget. Each hash is an entry of its own in the session's state, so what an event
    costs does not grow with the session. Blocks without content, or of no session, are left out,
    as nothing is known of them. For streams, and for a table as one batch.
    """
    e = events.where("session_id is not null and session_id <> '' and (kind = 'clear' or content <> '')")
    e = e.select("session_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "kind", F.sha2("content", 256).alias("hash"))
    return e.groupBy("session_id").transformWithStateInPandas(_FirstBlocks(), StructType.fromDDL("session_id string, event_id long, hash string"), "Append", "None")


class _Recent(StatefulProcessor):
    """The last events of a key, oldest first."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "us long, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        new = [(int(a), int(b)) for pdf in rows for a, b in zip(pdf["us"], pdf["event_id"])]
        held = sorted([*(tuple(map(int, x)) for x in self.held.get()), *new])[-self.most :]
        self.held.put(held)
        yield pd.DataFrame({"key": key[0], "us": [a for a, _ in held], "event_id": [b for _, b in held]})

    def close(self) -> None:
        pass


def recent(events: DataFrame, key: str, most: int = RECENT) -> DataFrame:
    """(key, us, event_id): after each micro-batch the last events of each key it touched, `most` at most; for a table the last of all."""
    kind = dict(events.dtypes)[key]
    e = events.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    return e.groupBy("key").transformWithStateInPandas(_Recent(most), StructType.fromDDL(f"key {kind}, us long, event_id long"), "Update", "None")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): spans of a key's events with no pause of `gap` or more; end is the last event's time and the gap.

    A stream gives a span once the watermark has passed its end; events later than that are left out.
    """
    w = F.session_window("ts", gap)
    e = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def answered(requests: DataFrame, completions: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(correlation_id, asked_at, request_id, done_at, completion_id): requests with their completions, or with nulls.

    Both have correlation_id, ts and event_id; a completion belongs to a request of its correlation
    that is at most `within` older. Both sides are held only until watermark and interval rule out a
    partner; then a request without one comes out by itself.
    """
    r = requests.select("correlation_id", F.col("ts").cast("timestamp").alias("asked_at"), F.col("event_id").alias("request_id")).withWatermark("asked_at", late).alias("r")
    c = completions.select(F.col("correlation_id").alias("its"), F.col("ts").cast("timestamp").alias("done_at"), F.col("event_id").alias("completion_id")).withWatermark("done_at", late).alias("c")
    on = (F.col("correlation_id") == F.col("its")) & (F.col("done_at") >= F.col("asked_at")) & (F.col("done_at") <= F.col("asked_at") + F.expr(f"interval {within}"))
    return r.join(c, on, "left_outer").drop("its")


def latest_changes(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed files, deleted files) of change events (repository_id, path, language, content, deleted, at): the last event of each file counts."""
    last = batch.groupBy(*FILE).agg(F.max_by(F.struct("language", "content", "deleted"), F.struct("at", "deleted")).alias("e"))
    changed = last.where("not coalesce(e.deleted, false)").select(*FILE, "e.language", "e.content")
    return changed, last.where("coalesce(e.deleted, false)").select(*FILE)


def apply_changes(path: str, source: str):
    """What foreachBatch runs: a micro-batch of change events becomes one version of the index; one that was committed before changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changed, deleted = latest_changes(batch)
        segments.change(spark, path, changed, deleted, (source, number))

    return run


def follow(stream: DataFrame, path: str, checkpoint: str, source: str = "files", **trigger):
    """Keep a stored index up with a stream of change events; started, with what is available unless a trigger is given.

    The number of a micro-batch is committed in the same manifest as its segment. If a run stops
    after that commit and before the stream's own, the batch runs again and finds itself done.
    """
    out = stream.writeStream.foreachBatch(apply_changes(path, source)).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()
