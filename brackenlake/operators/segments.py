"""The stored index: segments of positional postings, named by snapshots that are committed whole.

A segment holds the files of one build or change. A task's files are dealt to groups of a bounded
number of files and tokens, numbered by their names, and within a group to ranges of a few hundred
files. A posting row holds one term of one field in one range: file numbers, frequencies, lengths
and positions as arrays, beside the greatest frequency and the least length. Three tables by task:
`postings`, in order of terms within a group's fields, `files`, and `bounds`, the postings without
arrays. A group is put in order in memory, so writing neither sorts nor shuffles.

A manifest names the segments and tombstones of a version. Segments and tombstones are written
under new names and never changed, and a manifest is committed by one rename, so a writer that
stops leaves the last version as it was, and a reader keeps its own whatever is committed later.

A search reads the bounds of its terms first. They give document frequencies, and for each range
the most that any of its files can score. Ranges of the highest bounds are scored first; ranges
whose bound lies below the k-th score so found are not read. Scores are the same as without that.
"""

from __future__ import annotations

import math
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field as field_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import vocabulary as V
from ..sources import commits
from . import index
from . import store as store_

FILE = ["repository_id", "path"]
FIELDS = list(index.FIELDS)
#: Files of a range; ranges of a group, and tokens beyond which it has fewer files; rows that a posting batch has at most.
RANGE, RANGES, TOKENS, ROWS = 256, 16, 1 << 21, 1 << 16
#: Groups of a task are numbered from its number times the one, tasks of a segment so that its groups begin at its number times the other.
_TASK, _GROUPS = 1 << 20, 1 << 40
#: Runs of files of a repository that are sent to all tasks.
RUNS = 1 << 17
#: Tokens of a batch that are held on the driver; terms that are handed to the scan; occurrences up to which all ranges are scored at once; bounds of ranges up to which these are pruned; ranges a query scores first.
BATCH, PUSHED, DIRECT, PRUNED, LEAD = 200_000, 2000, 1 << 24, 1 << 24, 8
#: Bounds are rounded up by this, as scores are added in any order.
_SLACK = 1e-6

_POSTING = "range int, field int, term string, n int, max_tf int, min_len int, docs array<int>, tfs array<int>, lens array<int>, positions array<array<int>>"
_FILE = "doc int, repository_id string, path string, language string, field_lens array<int>, terms array<string>"
_WRITTEN = f"kind string, grp long, {_POSTING}, {_FILE}"
_BOUND = "grp long, range int, field int, term string, n int, max_tf int, min_len int"


# --- building ------------------------------------------------------------------------------------


def _runs(column: pa.ListArray, place: np.ndarray, range_files: int):
    """Of one field of some files, with the number of each: (lengths by number, terms in order, positions and where each posting's begin, frequencies, file and term number of each posting, where each row's postings begin)."""
    rows = len(place)
    lens = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(column.flatten())
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    code = number[coded.indices.to_numpy(zero_copy_only=False)]
    at = np.arange(len(code)) - np.repeat(np.cumsum(lens) - lens, lens)
    key = code * rows + np.repeat(place, lens)
    by = np.argsort(key, kind="stable")
    key, at = key[by], at[by]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    tf = np.diff(np.append(starts, len(key)))
    own_doc, own_code = key[starts] % rows, key[starts] // rows
    first = np.flatnonzero(np.diff(own_code * rows + own_doc // range_files, prepend=-1))
    by_number = np.empty(rows, np.int64)
    by_number[place] = lens
    return by_number, coded.dictionary.take(pa.array(order)), at, starts, tf, own_doc, own_code, first


def _blocks(first_group: int, range_files: int):
    """Analysed files to rows of postings and files of this task's group."""
    names = list(index.FIELDS.values())
    schema = pa.schema([
        ("kind", pa.string()), ("grp", pa.int64()), ("range", pa.int32()), ("field", pa.int32()), ("term", pa.string()), ("n", pa.int32()), ("max_tf", pa.int32()), ("min_len", pa.int32()),
        ("docs", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("lens", pa.list_(pa.int32())), ("positions", pa.list_(pa.list_(pa.int32()))),
        ("doc", pa.int32()), ("repository_id", pa.string()), ("path", pa.string()), ("language", pa.string()), ("field_lens", pa.list_(pa.int32())), ("terms", pa.list_(pa.string())),
    ])

    def row(count: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(count, f.type) for f in schema], schema=schema)

    def block(held: list[pa.RecordBatch], group: int):
        table = pa.Table.from_batches(held).combine_chunks()
        rows = table.num_rows
        column = lambda c: table.column(c).combine_chunks() if table.column(c).num_chunks != 1 else table.column(c).chunk(0)
        order = pc.sort_indices(table.select(FILE), sort_keys=[(c, "ascending") for c in FILE], null_placement="at_start").to_numpy()
        place = np.empty(rows, np.int64)
        place[order] = np.arange(rows)
        every_len, every_doc, every_term = [], [], []
        for number, name in enumerate(names):
            lens, terms, at, starts, tf, doc, code, first = _runs(column(name), place, range_files)
            every_len.append(lens)
            if not len(first):
                continue
            ends = pa.array(np.append(first, len(doc)), pa.int32())
            lists = lambda x: pa.ListArray.from_arrays(ends, pa.array(x, pa.int32()))  # noqa: E731,B023
            positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), pa.array(at, pa.int32()))
            n = len(first)
            written = row(
                n, kind=pa.array(["postings"] * n), grp=pa.array(np.full(n, group)), range=pa.array(doc[first] // range_files), field=pa.array(np.full(n, number)), term=terms.take(pa.array(code[first])),
                n=pa.array(np.diff(np.append(first, len(doc)))), max_tf=pa.array(np.maximum.reduceat(tf, first)), min_len=pa.array(np.minimum.reduceat(lens[doc], first)),
                docs=lists(doc), tfs=lists(tf), lens=lists(lens[doc]), positions=pa.ListArray.from_arrays(ends, positions),
            )
            yield from (written.slice(b, ROWS) for b in range(0, n, ROWS))
            every_doc.append(doc)
            every_term.append(pc.binary_join_element_wise(pa.scalar(str(number)), terms.cast(pa.string()), "").take(pa.array(code)))
        doc = np.concatenate(every_doc) if every_doc else np.empty(0, np.int64)
        by = np.argsort(doc, kind="stable")
        terms = pa.concat_arrays(every_term).take(pa.array(by)) if every_term else pa.array([], pa.string())
        own = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[by], np.arange(rows + 1)), pa.int32()), terms)
        lens = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * len(names), pa.int32()), pa.array(np.column_stack(every_len).ravel(), pa.int32()))
        files = {c: column(c).take(pa.array(order)) for c in (*FILE, "language")}
        numbers = np.arange(rows)
        written = row(rows, kind=pa.array(["files"] * rows), grp=pa.array(np.full(rows, group)), range=pa.array(numbers // range_files), doc=pa.array(numbers), field_lens=lens, terms=own, **files)
        yield from (written.slice(b, RANGE) for b in range(0, rows, RANGE))

    def run(batches):
        group, held, files, tokens = first_group + TaskContext.get().partitionId() * _TASK, [], 0, 0
        for batch in batches:
            sizes = sum(pc.fill_null(pc.list_value_length(batch.column(batch.schema.get_field_index(c))), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in names)
            begin = 0
            for i, n in enumerate(sizes.tolist()):
                if files and (files == RANGES * range_files or tokens + n > TOKENS):
                    yield from block([*held, batch.slice(begin, i - begin)], group)
                    group, held, begin, files, tokens = group + 1, [], i, 0, 0
                files, tokens = files + 1, tokens + n
            held.append(batch.slice(begin))
        if files:
            yield from block(held, group)

    return run


def _analysed(corpus: DataFrame) -> DataFrame:
    from ..functions import paths

    terms = index.field_terms(corpus)
    return terms.select(*FILE, paths.language(F.col("path")).alias("language"), *index.FIELDS.values())


@contextmanager
def _settings(spark: SparkSession, **values: int):
    """Settings of the session for what is written meanwhile."""
    names = {"files_at_once": "spark.sql.execution.arrow.maxRecordsPerBatch", "writers": "spark.sql.maxConcurrentOutputFileWriters"}
    old = {names[k]: spark.conf.get(names[k], None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(names[k], str(v))
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _task(grp: str = "grp") -> Column:
    return F.shiftright(F.col(grp), _TASK.bit_length() - 1).alias("task")


def _write_bounds(spark: SparkSession, path: str, name: str) -> None:
    p = spark.read.schema(f"{_POSTING}, grp long").parquet(f"{path}/segments/segment={name}/kind=postings")
    p.select("grp", "range", "field", "term", "n", "max_tf", "min_len").write.parquet(f"{path}/bounds/segment={name}")


def _totals(files: DataFrame) -> tuple[int, list[int]]:
    """Files, and the terms of each field over them."""
    r = files.agg(F.count("*").alias("n"), *[F.sum(F.get("field_lens", F.lit(i))).alias(f"f{i}") for i in range(len(FIELDS))]).first()
    return r["n"], [int(r[f"f{i}"] or 0) for i in range(len(FIELDS))]


def _write_segment(corpus: DataFrame, path: str, number: int, range_files: int) -> dict:
    """Write a segment under a new name, from one analysis of the files; what a manifest says of it."""
    spark = corpus.sparkSession
    name = f"{number:06d}-{uuid.uuid4().hex[:12]}"
    at = f"{path}/segments/segment={name}"
    rows = _analysed(corpus).mapInArrow(_blocks(number * _GROUPS, range_files), _WRITTEN)
    with _settings(spark, files_at_once=RANGE, writers=4):  # a task writes two folders at once, in its own order
        rows.withColumn("task", _task()).write.partitionBy("kind", "task").parquet(at)
    if "kind=files" not in commits.children(spark, at):  # an empty corpus
        return {"name": name, "number": number, "files": 0, "totals": [0] * len(FIELDS), "postings": False}
    files, totals = _totals(spark.read.schema(_FILE).parquet(f"{at}/kind=files"))
    has = "kind=postings" in commits.children(spark, at)
    if has:
        _write_bounds(spark, path, name)
    return {"name": name, "number": number, "files": files, "totals": totals, "postings": has}


# --- snapshots -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Snapshot:
    """One committed version of a stored index; what it reads stays the same."""

    spark: SparkSession
    path: str
    state: dict = field_(repr=False)

    @property
    def version(self) -> int:
        return self.state["version"]

    @property
    def n_files(self) -> int:
        return self.state["files"]

    def _read(self, table: str, part: str, schema: str, wanted) -> DataFrame:
        at = [f"{self.path}/{table}/segment={s['name']}{part}" for s in self.state["segments"] if wanted(s)]
        if not at:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.path}/{table}").schema(schema).parquet(*at).drop("segment", "kind")

    def postings(self) -> DataFrame:
        return self._read("segments", "/kind=postings", f"{_POSTING}, grp long, task long", lambda s: s["postings"])

    def bounds(self) -> DataFrame:
        return self._read("bounds", "", _BOUND, lambda s: s["postings"])

    def _tombstones(self, part: str, schema: str) -> DataFrame:
        at = [f"{self.path}/gone/{g['name']}/{part}" for g in self.state["gone"]]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def gone(self) -> DataFrame:
        """(grp, doc) of files that later versions replaced or dropped."""
        return self._tombstones("files", "grp long, doc int")

    def gone_terms(self) -> DataFrame:
        """(field, term, n): in how many of such files each term was."""
        live = [s["number"] for s in self.state["segments"]]
        return self._tombstones("terms", "segment int, field int, term string, n long").where(F.col("segment").isin(live)).groupBy("field", "term").agg(F.sum("n").alias("n"))

    def files(self) -> DataFrame:
        """(task, grp, range, doc, repository_id, path, language, field_lens, terms) of the files it holds."""
        rows = self._read("segments", "/kind=files", f"range int, {_FILE}, grp long, task long", lambda s: s["files"])
        return rows.join(self.gone(), ["grp", "doc"], "left_anti") if self.state["gone"] else rows

    def posting_bytes(self, groups: set[int] | None = None) -> int:
        """Bytes of the postings of the tasks of some groups or of all, as their files are listed."""
        out = 0
        for s in self.state["segments"]:
            at = f"{self.path}/segments/segment={s['name']}/kind=postings"
            own = {g // _TASK for g in groups or () if g // _GROUPS == s["number"]}
            out += sum(commits.size(self.spark, f"{at}/task={t}") for t in own) if groups is not None else commits.size(self.spark, at)
        return out

    def bytes(self) -> int:
        return sum(commits.size(self.spark, f"{self.path}/{t}/segment={s['name']}") for t in ("segments", "bounds") for s in self.state["segments"])


def open_(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The last committed version, or a given one; FileNotFoundError if there is none."""
    known = commits.versions(spark, f"{path}/manifests")
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no committed version {'' if version is None else version} of an index in {path}")
    return Snapshot(spark, path, commits.read(spark, f"{path}/manifests", known[-1] if version is None else version))


_OPEN: dict[str, Snapshot] = {}


def cached(spark: SparkSession, path: str) -> Snapshot:
    """A snapshot that is kept for further searches until invalidate(), or a commit by this process."""
    held = _OPEN.get(path)
    if held is None or held.spark is not spark:
        held = _OPEN[path] = open_(spark, path)
    return held


def invalidate(path: str) -> None:
    """The next cached() opens the last committed version anew."""
    _OPEN.pop(path, None)


def _commit(spark: SparkSession, path: str, state: dict) -> Snapshot:
    commits.commit(spark, f"{path}/manifests", state["version"], state)
    invalidate(path)
    return Snapshot(spark, path, state)


def _last(spark: SparkSession, path: str) -> dict:
    known = commits.versions(spark, f"{path}/manifests")
    return commits.read(spark, f"{path}/manifests", known[-1]) if known else {"version": -1, "next": 0, "files": 0, "totals": [0] * len(FIELDS), "segments": [], "gone": [], "batches": {}}


def build(corpus: DataFrame, path: str, range_files: int = RANGE) -> Snapshot:
    """A version that holds the corpus (repository_id, path, content) and nothing else."""
    spark = corpus.sparkSession
    old = _last(spark, path)
    s = _write_segment(corpus, path, old["next"], range_files)
    state = {"version": old["version"] + 1, "next": old["next"] + 1, "files": s["files"], "totals": s["totals"], "segments": [s] if s["files"] else [], "gone": [], "batches": old["batches"]}
    return _commit(spark, path, state)


def change(spark: SparkSession, path: str, changed: DataFrame, deleted: DataFrame, batch: tuple[str, int] | None = None, range_files: int = RANGE) -> Snapshot:
    """A version with the changed files anew and without the deleted ones (repository_id, path).

    Writes a segment of the changed files, and tombstones with what the files they replace had
    counted, so frequencies and lengths stay those of a rebuild. batch, a source and its number,
    marks what is applied; a batch that is not above the source's last one changes nothing.
    """
    old = _last(spark, path)
    if batch and old["batches"].get(batch[0], -1) >= batch[1]:
        return Snapshot(spark, path, old)
    now = Snapshot(spark, path, old)
    keys = changed.select(*FILE).unionByName(deleted.select(*FILE)).distinct()
    found = store_.cut(now.files().join(keys, FILE, "left_semi").select("grp", "doc", "field_lens", "terms")) if old["files"] else None
    gone, files, totals = [], old["files"], old["totals"]
    lost, less = _totals(found) if found is not None else (0, [])
    if lost:
        name = uuid.uuid4().hex[:12]
        found.select("grp", "doc").write.parquet(f"{path}/gone/{name}/files")
        segment = F.floor(F.col("grp") / _GROUPS).cast("int").alias("segment")
        terms = found.select(segment, F.explode("terms").alias("t")).select("segment", F.substr("t", F.lit(1), F.lit(1)).cast("int").alias("field"), F.expr("substr(t, 2)").alias("term"))
        terms.groupBy("segment", "field", "term").agg(F.count("*").alias("n")).write.parquet(f"{path}/gone/{name}/terms")
        numbers = [r[0] for r in found.select(segment).distinct().collect()]  # segments at most
        gone, files, totals = [{"name": name, "segments": numbers}], files - lost, [a - b for a, b in zip(totals, less)]
    s = _write_segment(changed, path, old["next"], range_files)
    state = {
        "version": old["version"] + 1, "next": old["next"] + 1, "files": files + s["files"], "totals": [a + b for a, b in zip(totals, s["totals"])],
        "segments": old["segments"] + ([s] if s["files"] else []), "gone": old["gone"] + gone, "batches": old["batches"] | ({batch[0]: batch[1]} if batch else {}),
    }
    return _commit(spark, path, state)


def merge(spark: SparkSession, path: str, most: int | None = None, range_files: int = RANGE) -> Snapshot:
    """A version whose segments are one, or whose segments of at most `most` files are; files that are gone are left out.

    Postings are moved to new file numbers, no text is read. Tombstones go with the segments they are about.
    """
    old = _last(spark, path)
    now = Snapshot(spark, path, old)
    some = [s for s in old["segments"] if most is None or s["files"] <= most]
    if len(some) < 2 and not (some and old["gone"]):
        return now
    number = old["next"]
    part = Snapshot(spark, path, old | {"segments": some})
    at = f"{number:06d}-{uuid.uuid4().hex[:12]}"
    target = f"{path}/segments/segment={at}"
    files = part.files().withColumnsRenamed({"grp": "old_grp", "doc": "old_doc"}).drop("range", "task")
    place = F.monotonically_increasing_id()
    files = files.repartitionByRange(*FILE).sortWithinPartitions(*FILE).withColumn("place", place)
    nth, most_files = F.col("place").bitwiseAND(F.lit((1 << 33) - 1)), range_files * RANGES
    doc = (nth % most_files).cast("int")
    group = F.shiftrightunsigned("place", 33) * _TASK + F.floor(nth / most_files) + number * _GROUPS
    files = store_.cut(files.select(group.alias("grp"), doc.alias("doc"), F.floor(doc / range_files).cast("int").alias("range"), "old_grp", "old_doc", *FILE, "language", "field_lens", "terms"))
    n, totals = _totals(files)
    gone = [g for g in old["gone"] if set(g["segments"]) & {s["number"] for s in old["segments"] if s not in some}]
    kept = [s for s in old["segments"] if s not in some]
    if n:
        files.drop("old_grp", "old_doc").withColumn("task", _task()).sortWithinPartitions("task", "grp", "doc").write.partitionBy("task").parquet(f"{target}/kind=files")
        each = F.explode(F.arrays_zip("docs", "tfs", "lens", "positions"))
        p = part.postings().select(F.col("grp").alias("old_grp"), "field", "term", each.alias("x"))
        p = p.select("old_grp", F.col("x.docs").alias("old_doc"), "field", "term", F.col("x.tfs").alias("tf"), F.col("x.lens").alias("len"), F.col("x.positions").alias("at"))
        p = p.join(files.select("old_grp", "old_doc", "grp", "doc", "range"), ["old_grp", "old_doc"])
        rows = p.groupBy("grp", "range", "field", "term").agg(F.sort_array(F.collect_list(F.struct("doc", "tf", "len", "at"))).alias("x"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"))
        rows = rows.select("grp", "range", "field", "term", F.size("x").alias("n"), "max_tf", "min_len", F.col("x.doc").alias("docs"), F.col("x.tf").alias("tfs"), F.col("x.len").alias("lens"), F.col("x.at").alias("positions"))
        rows.withColumn("task", _task()).repartition("grp").sortWithinPartitions("task", "grp", "field", "term", "range").write.partitionBy("task").parquet(f"{target}/kind=postings")
        has = bool([c for c in commits.children(spark, f"{target}/kind=postings") if c.startswith("task=")])
        if has:
            _write_bounds(spark, path, at)
        kept = [*kept, {"name": at, "number": number, "files": n, "totals": totals, "postings": has}]
    return _commit(spark, path, old | {"version": old["version"] + 1, "next": number + 1, "segments": kept, "gone": gone})


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove what none of the last `keep` versions names: older versions, and segments and tombstones of writers that stopped; what was removed."""
    known = commits.versions(spark, f"{path}/manifests")
    states = [commits.read(spark, f"{path}/manifests", v) for v in known[-keep:]]
    named = {f"{t}/segment={s['name']}" for x in states for s in x["segments"] for t in ("segments", "bounds")} | {f"gone/{g['name']}" for x in states for g in x["gone"]}
    old = [f"{top}/{c}" for top in ("segments", "bounds", "gone") for c in commits.children(spark, f"{path}/{top}") if f"{top}/{c}" not in named]
    old = [f"manifests/{v:08d}.json" for v in known[:-keep]] + old
    for name in old:
        commits.remove(spark, f"{path}/{name}")
    return old


# --- what an index holds ---------------------------------------------------------------------------


def occurrences(snapshot: Snapshot, terms: DataFrame | None = None, fields: list[str] | None = None) -> DataFrame:
    """(grp, range, doc, field, term, tf) of the files it holds, of some terms (a table with a column term) and fields or of all.

    A bounded number of terms reaches the scan of postings as a condition.
    """
    p = snapshot.postings()
    if fields is not None:
        p = p.where(F.col("field").isin([FIELDS.index(f) for f in fields]))
    if terms is not None:
        some = terms.select("term").distinct()
        wanted = [r[0] for r in some.limit(PUSHED + 1).collect()]
        p = p.where(F.col("term").isin(wanted)) if len(wanted) <= PUSHED else p.join(some, "term", "left_semi")
    x = F.explode(F.arrays_zip("docs", "tfs")).alias("x")
    rows = p.select("grp", "range", "field", "term", x).select("grp", "range", F.col("x.docs").alias("doc"), "field", "term", F.col("x.tfs").cast("long").alias("tf"))
    return rows.join(snapshot.gone(), ["grp", "doc"], "left_anti") if snapshot.state["gone"] else rows


def owned(snapshot: Snapshot, fields: list[str] | None = None) -> DataFrame:
    """(repository_id, term, tf) of occurrences().

    Files of a group are numbered in the order of their names, so those of a repository in a range
    are one run of numbers: postings meet the runs of their range, a counted few of which are sent.
    """
    runs = snapshot.files().groupBy("grp", "range", "repository_id").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    runs = store_.cut(runs)
    runs = F.broadcast(runs) if runs.count() <= RUNS else runs
    p = occurrences(snapshot, fields=fields)
    return p.join(runs, ["grp", "range"]).where(F.col("doc").between(F.col("first"), F.col("last"))).select("repository_id", "term", "tf")


def _field_name() -> Column:
    return F.element_at(F.array(*map(F.lit, FIELDS)), F.col("field") + 1).alias("field")


def field_sizes(snapshot: Snapshot) -> DataFrame:
    """(repository_id, field, n_docs, n_terms): files and terms of each field."""
    each = snapshot.files().select("repository_id", F.posexplode("field_lens").alias("field", "len"))
    return each.groupBy("repository_id", "field").agg(F.count("*").alias("n_docs"), F.sum("len").cast("long").alias("n_terms")).select("repository_id", _field_name(), "n_docs", "n_terms")


def document_frequency(snapshot: Snapshot, terms: DataFrame) -> DataFrame:
    """(field, term, n_docs, n_found) of the terms asked for: files that hold each, and how often."""
    n = occurrences(snapshot, terms).groupBy("field", "term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_found"))
    return n.select(_field_name(), "term", "n_docs", "n_found")


def count_hits(snapshot: Snapshot, queries: DataFrame) -> DataFrame:
    """(query_id, n): files that hold any term of each query (query_id, term) in any field, whatever k."""
    held = occurrences(snapshot, queries).select("grp", "doc", "term").distinct()
    return held.join(queries, "term").select("query_id", "grp", "doc").distinct().groupBy("query_id").agg(F.count("*").alias("n"))


# --- searching ---------------------------------------------------------------------------------------


def clauses_of(queries: DataFrame) -> DataFrame:
    """(query_id, tokens) of queries (query_id, term): a clause of one token each."""
    return queries.select("query_id", F.array("term").alias("tokens"))


def _in_groups(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of tables by task that may be in the chosen groups; a bounded number of groups reaches the scan."""
    groups = [r[0] for r in chosen.select("grp").distinct().limit(PUSHED + 1).collect()]
    return rows.where(F.col("task").isin(sorted({g // _TASK for g in groups})) & F.col("grp").isin(groups)) if len(groups) <= PUSHED else rows


class Search:
    """A batch of requests (query_id, tokens) on a snapshot: a clause of several tokens is a phrase, in each field by itself.

    Tokens and weights of a batch are held and go to the tasks; search() cuts larger batches in
    parts. report tells how many occurrences and ranges were scored.
    """

    def __init__(self, snapshot: Snapshot, held: list, kind: StructType, k: int, only: Column | None, direct: int, lead: int):
        self.snapshot, self.k, self.only, self.lead, self.spark, self.kind = snapshot, k, only, lead, snapshot.spark, kind
        state = snapshot.state
        self.tokens = F.broadcast(self.spark.createDataFrame(held, kind))
        self.phrases = any(r["m"] > 1 for r in held)
        terms = {r["term"] for r in held}
        self.wanted = sorted(terms) if len(terms) <= PUSHED else None
        self.averages = {i: t / state["files"] for i, t in enumerate(state["totals"]) if t}
        self.report = {"occurrences": 0, "read": 0, "ranges": None, "scored": None}
        self.weights: list = []
        self.clauses: dict[tuple, dict[int, float]] = {}
        self.asked: dict = {}
        self.bases: dict[tuple, int] = {}
        if not self.averages or not held:
            return
        self.bounds = self._asked(snapshot.bounds())
        self.bounds = self.bounds.join(self.tokens.select("term").distinct(), "term", "left_semi")
        df = self.bounds.groupBy("field", "term").agg(F.sum("n").cast("long").alias("df"), F.count("*").alias("rows"))
        if state["gone"]:
            df = df.join(self._asked(snapshot.gone_terms()), ["field", "term"], "left").select("field", "term", (F.col("df") - F.coalesce("n", F.lit(0))).alias("df"), "rows")
        held_in = df.where("df > 0").collect()  # six fields a term
        known = {(r["term"], r["field"]): r["df"] for r in held_in}
        ranges = {(r["term"], r["field"]): r["rows"] for r in held_in}
        clauses: dict = {}
        for r in held:
            clauses.setdefault((r["query_id"], r["clause"], r["times"]), []).append((r["j"], r["term"]))
        files, pruned = {}, 0  # of each clause the files that it may be in; bounds of ranges of all requests
        for (query, _, times), tokens in clauses.items():
            tokens = tuple(t for _, t in sorted(tokens))
            if tokens not in files:
                files[tokens], own = 0, {}
                for f in self.averages:
                    found = [known.get((t, f)) for t in tokens]
                    if None not in found:
                        own[f] = sum(math.log(1 + (state["files"] - n + 0.5) / (n + 0.5)) for n in found) * V.FIELD_BOOSTS[FIELDS[f]]
                        files[tokens] += min(found)
                if own:
                    self.clauses[tokens] = own
            if files[tokens]:
                self.asked.setdefault(query, []).append((tokens, times))
                self.weights += [(query, tokens, f, w * times) for f, w in self.clauses[tokens].items()]
                pruned += sum(min(ranges[t, f] for t in tokens) for f in self.clauses[tokens])
        self.rarest = {tokens: min(tokens, key=lambda t: sum(known.get((t, f), 0) for f in self.averages)) for tokens in self.clauses}
        self.report["occurrences"] = sum(known.values())
        for parts in self.asked.values():
            parts.sort(key=lambda x: (-files[x[0]], x))  # the most frequent clause is the request's base
            self.bases.setdefault(parts[0], len(self.bases))
            self.report["occurrences"] += sum(files[tokens] for tokens, _ in parts[1:])
        self.direct = self.report["occurrences"] <= direct or pruned > PRUNED

    def _asked(self, rows: DataFrame) -> DataFrame:
        return rows if self.wanted is None else rows.where(F.col("term").isin(self.wanted))

    def _allowed(self) -> DataFrame | None:
        return None if self.only is None else self.snapshot.files().where(self.only).select("grp", "range", "doc")

    def _bounded(self) -> DataFrame:
        """(query_id, grp, range, bound): the most a file of the range can score."""
        kind = StructType([self.kind["query_id"], *StructType.fromDDL("clause string, field int, weight double, m int").fields])
        weights = F.broadcast(self.spark.createDataFrame([(q, " ".join(t), f, w, len(t)) for q, t, f, w in self.weights], kind))
        each = self.bounds.join(self.tokens.select("query_id", "clause", "term"), "term").groupBy("query_id", "clause", "field", "grp", "range").agg(F.count("*").alias("there"), F.min("max_tf").alias("tf"), F.max("min_len").alias("len"))
        j = each.join(weights, ["query_id", "clause", "field"]).where("there = m")
        average = F.create_map(*[F.lit(x) for kv in self.averages.items() for x in kv])[F.col("field")]
        most = F.col("weight") * F.col("tf") * (V.BM25_K1 + 1) / (F.col("tf") + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("len") / average))
        return j.groupBy("query_id", "grp", "range").agg((F.sum(most) + _SLACK).alias("bound"))

    def scored(self, chosen: DataFrame | None, allowed: DataFrame | None) -> DataFrame:
        """(query_id, base, grp, doc, score) in chosen ranges (grp, range) or in all: the best k files of each group.

        Rows with a query_id are files that hold a clause of the request other than its base, the
        most frequent one, with their whole scores. Rows with a base are the best by it alone.
        """
        p = self._asked(self.snapshot.postings())
        if chosen is not None:
            p = _in_groups(p, chosen).join(chosen.select("grp", "range").distinct(), ["grp", "range"], "left_semi")
        p = p.join(self.tokens.select("term").distinct(), "term", "left_semi")
        none = F.lit(None).cast("array<int>")
        places = F.col("positions") if self.phrases else F.lit(None).cast("array<array<int>>")
        p = p.select("grp", "field", "term", "docs", "tfs", "lens", places.alias("positions"))
        marked = [(_GONE, self.snapshot.gone() if self.snapshot.state["gone"] else None), (_ALLOWED, allowed)]
        for mark, docs in marked:  # files of a group, as one more row of it
            if docs is not None:
                rows = docs.groupBy("grp").agg(F.collect_list("doc").alias("docs"))
                p = p.unionByName(rows.select("grp", F.lit(mark).alias("field"), F.lit("").alias("term"), "docs", none.alias("tfs"), none.alias("lens"), F.lit(None).cast("array<array<int>>").alias("positions")))
        schema = StructType([StructField("query_id", self.kind["query_id"].dataType), *StructType.fromDDL("base int, grp long, doc int, score double").fields])
        return p.groupBy("grp").applyInArrow(_scorer(self, to_arrow_type(self.kind["query_id"].dataType), allowed is not None), schema)

    def _best(self, scores: DataFrame, files: DataFrame) -> DataFrame:
        """(query_id, repository_id, path, score, rank): the best k files of each request, of what scored() gives.

        A file without another clause scores as its base does, for all requests of that base alike.
        One that is not among the base's best k has k files before it in each of them: those score
        as much by the base and no less in all. So the best of a base are found once, and given to
        its requests beside the files of their other clauses.
        """
        w = Window.partitionBy("query_id", "base").orderBy(F.desc(F.round("score", 9)))
        some = scores.withColumn("place", F.rank().over(w)).where(F.col("place") <= self.k)
        named = files.join(some, ["grp", "doc"]).select("query_id", "base", *FILE, "score")
        named = store_.cut(index.top_k(named, ["query_id", "base"], self.k).drop("rank"))
        bases = self.spark.createDataFrame([(q, self.bases[parts[0]]) for q, parts in self.asked.items()], StructType([self.kind["query_id"], StructField("base", IntegerType())]))
        shared = named.where("base is not null").drop("query_id").join(F.broadcast(bases), "base").select("query_id", *FILE, "score")
        own = named.where("base is null").select("query_id", *FILE, "score")
        return index.top_k(own.unionByName(shared).groupBy("query_id", *FILE).agg(F.max("score").alias("score")), ["query_id"], self.k)

    def rows(self) -> DataFrame:
        """(query_id, repository_id, path, score, rank)."""
        if not self.report["occurrences"]:
            return self.spark.createDataFrame([], StructType([self.kind["query_id"], *StructType.fromDDL("repository_id string, path string, score double, rank int").fields]))
        allowed = self._allowed()
        if not self.direct:
            return self._pruned(allowed)
        self.report["read"] = self.report["occurrences"]
        return self._best(self.scored(None, allowed), self._files())

    def _files(self, chosen: DataFrame | None = None) -> DataFrame:
        files = self.snapshot.files()
        return (files if chosen is None else _in_groups(files, chosen)).select("grp", "doc", *FILE)

    def _pruned(self, allowed: DataFrame | None) -> DataFrame:
        on = ["query_id", "grp", "range"]
        self.bounds = store_.cut(self.bounds)
        ranges = self._bounded()
        if allowed is not None:
            ranges = ranges.join(allowed.select("grp", "range").distinct(), ["grp", "range"], "left_semi")
        ranges = store_.cut(ranges)
        first = store_.cut(index.top_k(ranges, ["query_id"], self.lead, "bound", ("grp", "range")).drop("rank"))
        files = None if allowed is None else allowed.select("grp", "doc")
        head = store_.cut(self._best(self.scored(first, files), self._files(first)))
        least = head.where(F.col("rank") == self.k).select("query_id", F.col("score").alias("least"))
        rest = ranges.join(first.select("grp", "range").distinct(), ["grp", "range"], "left_anti").join(least, "query_id", "left")
        rest = store_.cut(rest.where(F.col("bound") >= F.coalesce("least", F.lit(0.0))).select(*on))
        taken = store_.cut(first.select("grp", "range").unionByName(rest.select("grp", "range")).distinct())
        read = self.bounds.join(taken, ["grp", "range"], "left_semi").agg(F.sum("n")).first()[0]
        whole = self.bounds.agg(F.sum("n")).first()[0]
        groups = {r[0] for r in taken.select("grp").distinct().limit(PUSHED + 1).collect()}
        self.report |= {"bytes": self.snapshot.posting_bytes(groups if len(groups) <= PUSHED else None), "bytes_stored": self.snapshot.posting_bytes()}
        self.report |= {"ranges": ranges.select("grp", "range").distinct().count(), "scored": taken.count(), "read": int(read or 0), "stored": int(whole or 0)}
        tail = self._best(self.scored(rest, files), self._files(rest))
        return index.top_k(head.unionByName(tail).drop("rank"), ["query_id"], self.k)


#: Fields of rows that name files which are gone, or which alone may be found.
_GONE, _ALLOWED = -1, -2


def _phrase(rows: list[tuple], tokens: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(docs, frequencies, lengths) of files that hold the tokens one after another; rows: docs, tfs, lens and positions of each."""
    begins, span = None, 1 << 32
    for j, (docs, tfs, _, at) in enumerate(rows):
        mine = np.repeat(docs, tfs) * span + (at - j + len(tokens))
        begins = mine if begins is None else np.intersect1d(begins, mine, assume_unique=True)
    docs, tf = np.unique(begins // span, return_counts=True)
    first_docs, _, lens, _ = rows[0]
    by = np.argsort(first_docs)
    return docs, tf, lens[by][np.searchsorted(first_docs[by], docs)]


def _scorer(search: Search, kind: pa.DataType, only: bool):
    """A group's posting rows to its best files: BM25 of each clause once, then of each base, then of requests with another clause there."""
    averages, k, weights = search.averages, search.k, search.clauses
    at_term: dict[str, list[tuple]] = {}
    for tokens, t in search.rarest.items():
        at_term.setdefault(t, []).append(tokens)
    bases = dict(search.bases)
    asked = list(search.asked.items())
    users: dict[tuple, list[int]] = {}
    for q, (_, parts) in enumerate(asked):
        for tokens, _ in parts[1:]:
            users.setdefault(tokens, []).append(q)

    def numbers(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """All values of a column of lists, and where each row's begin."""
        lens = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        return column.flatten(), np.concatenate(([0], np.cumsum(lens))).astype(np.int64)

    def run(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).combine_chunks()
        docs, at = numbers(column("docs"))
        tfs, tf_at = numbers(column("tfs"))
        lens, _ = numbers(column("lens"))
        places, place_at = numbers(column("positions"))
        docs, tfs, lens = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (docs, tfs, lens))
        if len(places):
            places, each_at = numbers(places)
            places = places.to_numpy(zero_copy_only=False).astype(np.int64)
        parts: dict = {}
        marks: dict = {_GONE: [], _ALLOWED: []}
        for i, (f, t) in enumerate(zip(table.column("field").to_pylist(), table.column("term").to_pylist())):
            mine = docs[at[i] : at[i + 1]]
            if f < 0:
                marks[f].append(mine)
                continue
            begins = places[each_at[place_at[i]] : each_at[place_at[i + 1]]] if place_at[i + 1] > place_at[i] else None
            parts.setdefault((t, f), []).append((mine, tfs[tf_at[i] : tf_at[i + 1]], lens[tf_at[i] : tf_at[i + 1]], begins))
        whole = {key: tuple(None if p[0] is None else np.concatenate(p) for p in zip(*rows)) for key, rows in parts.items()}
        size = 1 + max([int(x[0].max()) for x in whole.values()] + [int(d.max()) for ds in marks.values() for d in ds if len(d)], default=0)
        open_ = np.full(size, not only)
        for d in marks[_ALLOWED]:
            open_[d] = True
        for d in marks[_GONE]:
            open_[d] = False
        there = {t for t, _ in whole}
        hits: dict = {}  # of each clause that is here: files and scores
        for tokens in (c for t in there for c in at_term.get(t, ())):
            if not there.issuperset(tokens):
                continue
            total, found = np.zeros(size), False
            for f, weight in weights[tokens].items():
                rows = [whole.get((t, f)) for t in tokens]
                if None in rows:
                    continue
                docs, tf, lens = rows[0][:3] if len(rows) == 1 else _phrase(rows, tokens)
                total[docs] += weight * tf * (V.BM25_K1 + 1) / (tf + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * lens / averages[f]))
                found = found or len(docs) > 0
            docs = np.flatnonzero((total > 0) & open_) if found else ()
            if len(docs):
                hits[tokens] = docs, total[docs]
        out_query, out_base, out_doc, out_score = [], [], [], []

        def put(query, base, docs, scores):
            """The best k by score, then by number, which is the order of names."""
            if len(docs) > k:
                best = np.lexsort((docs, -np.round(scores, 9)))[:k]
                docs, scores = docs[best], scores[best]
            out_query.extend([query] * len(docs))
            out_base.extend([base] * len(docs))
            out_doc.append(docs)
            out_score.append(scores)

        for (tokens, times), base in bases.items():
            if tokens in hits:
                put(None, base, hits[tokens][0], times * hits[tokens][1])
        total, own = np.zeros(size), np.zeros(size, bool)
        for q in sorted({q for tokens in hits for q in users.get(tokens, ())}):
            query, parts = asked[q]
            mine = [(hits[tokens], times, i > 0) for i, (tokens, times) in enumerate(parts) if tokens in hits]
            for (docs, scores), times, other in mine:
                total[docs] += times * scores
                if other:
                    own[docs] = True
            docs = np.flatnonzero(own)
            put(query, None, docs, total[docs])
            for (docs, _), _, _ in mine:
                total[docs], own[docs] = 0, False
        docs = np.concatenate(out_doc) if out_doc else np.empty(0, np.int64)
        group = table.column("grp")[0].as_py()
        scores = np.concatenate(out_score) if out_score else np.empty(0)
        return pa.table({"query_id": pa.array(out_query, kind), "base": pa.array(out_base, pa.int32()), "grp": pa.array(np.full(len(docs), group), pa.int64()), "doc": pa.array(docs, pa.int32()), "score": pa.array(scores, pa.float64())})

    return run


def search(snapshot: Snapshot, clauses: DataFrame, k: int = 50, only: Column | None = None, direct: int = DIRECT, lead: int = LEAD, reports: list | None = None) -> DataFrame:
    """(query_id, repository_id, path, score, rank): the best k files of each request (query_id, tokens).

    only is a condition on repository_id, path and language. reports gets what each part of the batch read.
    """
    c = clauses.where(F.size("tokens") > 0).select("query_id", F.array_join("tokens", " ").alias("clause"), "tokens").groupBy("query_id", "clause").agg(F.first("tokens").alias("tokens"), F.count("*").alias("times"))
    tokens = c.select("query_id", "clause", "times", F.size("tokens").alias("m"), F.posexplode("tokens").alias("j", "term"))
    held = tokens.limit(BATCH + 1).collect()
    parts = [held]
    if len(held) > BATCH:
        tokens = store_.cut(tokens)
        n = -(-2 * tokens.count() // BATCH)
        parts = (tokens.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).collect() for i in range(n))  # about half of BATCH each
    out = None
    for part in parts:
        s = Search(snapshot, part, tokens.schema, k, only, direct, lead)
        found = s.rows()
        out = found if out is None else out.unionByName(found)
        if reports is not None:
            reports.append(s.report)
    return out
