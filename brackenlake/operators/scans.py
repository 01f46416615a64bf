"""Prefix sums and previous rows in an order, over range partitions: no key is held by one task.

Each task reads its sorted rows as they pass. What earlier partitions sum up to, and their last
row, is one row a partition; it is added where a key goes on from one partition to the next.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from . import store


def _runs(values: np.ndarray, starts: np.ndarray, group: np.ndarray, held: int, xor: bool) -> np.ndarray:
    """Running sums (or exclusive ors) that begin anew at starts; the first group goes on from held."""
    values = values.copy()
    join = np.bitwise_xor if xor else np.add
    values[0] = join(values[0], held)
    run = join.accumulate(values)
    before = run[starts] ^ values[starts] if xor else run[starts] - values[starts]
    return run ^ before[group] if xor else run - before[group]


def scan(rows: DataFrame, by: list[Column | str], within: str | None, add: tuple[str, ...] = (), xor: tuple[str, ...] = (), last: tuple[str, ...] = (), cut: Callable[[DataFrame], DataFrame] = store.cut) -> DataFrame:
    """rows with run_<c> for long columns c of add and xor, over the rows up to each, and prev_<c> for columns c of last, of the row before; in the order of by, alike in within if that is given.

    within is the first of by, and not null. cut writes what the tasks give.
    """
    spark, names = rows.sparkSession, [*add, *xor]
    of = {f.name: f for f in rows.schema.fields}
    marks = [StructField(n, LongType()) for n in ("task", "at", *[f"run_{c}" for c in names])]
    schema = StructType([*rows.schema.fields, *marks, *[StructField(f"prev_{c}", of[c].dataType) for c in last]])
    kinds = [to_arrow_type(of[c].dataType) for c in last]

    def run(batches):
        task, at, who, held, tail = TaskContext.get().partitionId(), 0, None, dict.fromkeys(names, 0), [None] * len(last)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731,B023
            own = column(within).to_numpy(zero_copy_only=False) if within else np.zeros(n, np.int64)
            first = np.ones(n, bool)
            first[1:] = own[1:] != own[:-1]
            goes_on = at > 0 and own[0] == who
            starts = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            held = held if goes_on else dict.fromkeys(names, 0)
            new = []
            for c in names:
                new.append(_runs(column(c).to_numpy(zero_copy_only=False), starts, group, held[c], c in xor))
                held[c] = int(new[-1][-1])
            before = []
            for c, kind, t in zip(last, kinds, tail):
                values = column(c).cast(kind)
                shifted = pa.concat_arrays([pa.array([t if goes_on else None], kind), values.slice(0, n - 1)])
                begins = first.copy()
                begins[0] = not goes_on
                before.append(pa.array(shifted.to_pylist(), kind, mask=begins) if begins.any() else shifted)
            tail = [column(c).cast(k)[n - 1].as_py() for c, k in zip(last, kinds)]
            who = own[-1]
            columns = [np.full(n, task), np.arange(at, at + n), *new]
            at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.int64()) for c in columns], *before], names=schema.names)

    out = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema))
    own = F.col(within) if within else F.lit(0).cast("long")
    ends = F.struct(own.alias("hi"), *[f"run_{c}" for c in names], *[F.col(c).alias(f"last_{c}") for c in last])
    each = out.groupBy("task").agg(F.min_by(own, "at").alias("lo"), F.max_by(ends, "at").alias("end")).orderBy("task").collect()
    known, before, tail = [], None, None
    for r in each:  # a row a partition
        on = before is not None and before["hi"] == r["lo"]
        held = {c: before[c] for c in names} if on else dict.fromkeys(names, 0)
        known.append((r["task"], r["lo"], *[held[c] for c in names], *[tail[c] if on else None for c in last]))
        more = held if r["end"]["hi"] == r["lo"] else dict.fromkeys(names, 0)
        before = {"hi": r["end"]["hi"]} | {c: r["end"][f"run_{c}"] ^ more[c] if c in xor else r["end"][f"run_{c}"] + more[c] for c in names}
        tail = {c: r["end"][f"last_{c}"] for c in last}
    group = of[within].dataType if within else LongType()
    carried = StructType([StructField("task", LongType()), StructField("lo", group), *[StructField(f"held_{c}", LongType()) for c in names], *[StructField(f"tail_{c}", of[c].dataType) for c in last]])
    held_ = spark.createDataFrame(known, carried)
    out = out.join(F.broadcast(held_), (held_["task"] == out["task"]) & (own == F.col("lo")), "left")
    held = {c: F.coalesce(F.col(f"held_{c}"), F.lit(0)) for c in names}
    total = {c: F.col(f"run_{c}").bitwiseXOR(held[c]) if c in xor else F.col(f"run_{c}") + held[c] for c in names}
    previous = {c: F.when(F.col("at") == 0, F.col(f"tail_{c}")).otherwise(F.col(f"prev_{c}")) for c in last}
    return out.select(*rows.columns, *[total[c].alias(f"run_{c}") for c in names], *[previous[c].alias(f"prev_{c}") for c in last])
