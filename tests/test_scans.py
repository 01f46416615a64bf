"""Ordered scans against plain loops, with keys over several partitions."""

import random

import pytest
from pyspark.sql import functions as F

from brackenlake.operators import metrics, scans
from brackenlake.streaming import events


@pytest.fixture
def apart(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scan(spark, apart):
    r = random.Random(2)
    rows = [("hot" if i % 2 else f"k{i % 9}", i, r.randrange(100), r.randrange(1 << 60), None if i % 7 == 0 else f"v{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, a long, x long, v string").repartition(5)
    got = scans.scan(df, ["k", F.col("i").desc()], "k", ("a",), ("x",), ("v", "i")).collect()
    assert len(got) == len(rows)
    for k in {x[0] for x in rows}:
        total, mixed, before = 0, 0, (None, None)
        for x in sorted((x for x in got if x["k"] == k), key=lambda x: -x["i"]):
            total, mixed = total + x["a"], mixed ^ x["x"]
            assert (x["run_a"], x["run_x"], x["prev_v"], x["prev_i"]) == (total, mixed, *before)
            before = (x["v"], x["i"])
    whole = scans.scan(df, ["i"], None, ("a",)).collect()
    assert max(x["run_a"] for x in whole) == sum(x[2] for x in rows)
    assert scans.scan(df.limit(0), ["k", "i"], "k", ("a",), (), ("v",)).count() == 0


def test_percentiles_and_changes_of_a_hot_key(spark, apart):
    r = random.Random(3)
    values = [("hot", r.random()) for _ in range(500)] + [("one", 5.0), ("none", None)] + [("few", float(i % 3)) for i in range(10)]
    got = {x["k"]: (x["n"], x["p50"], x["p95"]) for x in metrics.percentiles(spark.createDataFrame(values, "k string, v double"), "k", "v").collect()}
    for k in ("hot", "one", "few"):
        s = sorted(v for j, v in values if j == k)
        assert got[k] == (len(s), s[min(int(len(s) * 0.5), len(s) - 1)], s[min(int(len(s) * 0.95), len(s) - 1)])
    assert got["none"] == (1, None, None)
    commits = [("hot", t, f"c{t // 3}") for t in range(300)] + [("r", 1, "a"), ("r", 2, None), ("r", 3, "a"), (None, 1, "z")]
    found = sorted((x["repository_id"], x["ts"]) for x in events.head_changes(spark.createDataFrame(commits, "repository_id string, ts long, oid string")).collect())
    assert found == [("hot", t) for t in range(0, 300, 3)] + [("r", 1), ("r", 3)]
    spans = events.readiness(spark.createDataFrame([("hot", t, "started" if t % 4 == 0 else "completed" if t % 4 == 2 else "other") for t in range(200)], "repository_id string, ts long, kind string")).collect()
    assert sorted((x["since"], x["until"], x["state"]) for x in spans) == [(t, t + 2 if t < 198 else None, "ready" if t % 4 else "indexing") for t in range(0, 200, 2)]
