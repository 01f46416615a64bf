"""What the training-data operators share: tables, lineage cuts and a byte-level word scanner."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised scan takes at a time; a longer text is scanned alone.
SCAN_BYTES = 1 << 19

_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone; a null text counts as empty, other columns are left out."""
    return df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df has not got, without regard to case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Hand freed memory back to the system; a worker that is used again by a later stage starts small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the usual C library
    if trim:
        trim(0)


def tidy(run):
    """run, with its memory handed back once a partition is done."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def by_batch(df: DataFrame, run, schema: str, key: str = "doc_id") -> DataFrame:
    """df.mapInPandas(run, key and schema) with the key handed over as text: numbers beside a null would come as floats and lose digits."""
    kind = dict(df.dtypes)[key]
    out = df.withColumn(key, F.col(key).cast("string")).mapInPandas(tidy(run), f"`{key}` string, {schema}")
    return out.withColumn(key, F.col(key).cast(kind))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (tests, local mode) a temporary one."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    jvm_app = spark.sparkContext.applicationId
    return f"file://{tempfile.gettempdir()}/brackenlake-{jvm_app}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: short lineage, and nothing that is lost with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# --- byte-level word scanner -------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BYTE_CASED = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_STEP = _U(0x9E3779B97F4A7C15)

#: Words between white space, and words of letters, digits and bytes above ASCII.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SCAN_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


class Words:
    """The words of some texts: 64-bit hashes, the text each is in, and where it starts and ends in the joined bytes."""

    def __init__(self, rows: list[bytes], kind: np.ndarray, cased: bool = False):
        sep = b" "
        joined = sep.join([b"", *rows, b""])
        buf = np.frombuffer(joined, np.uint8)
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        self.at = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1] + 1  # where each text starts
        inside = kind[buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[::2], edge[1::2]
        up, down = _power(len(buf) + 1)
        sums = np.empty(len(buf) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((_BYTE_CASED if cased else _BYTE)[buf] * up[: len(buf)], out=sums[1:])
        self.hash = _mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64) * _STEP)
        self.row = np.searchsorted(self.at, self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=len(rows))
        self.first = np.concatenate(([0], np.cumsum(self.count)))  # of each text's words; one more at the end
        self.buf = buf

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words of one text, and the index of the first word of each."""
        if len(self.hash) < n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        g = self.hash[: len(self.hash) - n + 1].copy()
        for k in range(1, n):
            g *= _STEP
            g += self.hash[k : len(self.hash) - n + 1 + k]
        at = np.flatnonzero(self.row[: len(g)] == self.row[n - 1 :])
        return _mix(g[at] + _U(n)), at


def blocks(texts_: list[str | None], most: int = SCAN_BYTES):
    """(index of the first, UTF-8 texts) of some texts at a time, of at most so many bytes unless one alone has more."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts_):
        b = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(b) > most:
            yield first, held
            held, size, first = [], 0, i
        held.append(b)
        size += len(b) + 1
    if held:
        yield first, held


def shingle_sets(rows: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct shingles of some words; of fewer words one hash of all; of none, none."""
    w = Words(rows, SPACED)
    g, at = w.grams(words)
    bounds = np.searchsorted(w.row[at], np.arange(len(rows) + 1))
    out = []
    for i in range(len(rows)):
        n = int(w.count[i])
        if n >= words:
            out.append(np.unique(g[bounds[i] : bounds[i + 1]]))
        elif n:
            h = _U(n)
            with np.errstate(over="ignore"):
                for x in w.hash[w.first[i] : w.first[i + 1]]:
                    h = h * _STEP + x
            out.append(_mix(np.array([h], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


# --- connected components ----------------------------------------------------------------------


#: Edges up to which one task finds the components, after a count of them: 16 MB.
ALONE = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of some edges the nodes that have a smaller one in their component, and the smallest one."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(ids))
    while len(x):
        low, high = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        apart = low != high
        x, y = x[apart], y[apart]
        np.minimum.at(up, high[apart], low[apart])
        while (up[up] != up).any():
            up = up[up]
    below = np.flatnonzero(up != np.arange(len(ids)))
    return ids[below], ids[up[below]]


def _forests(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of each partition as its trees, every node with its root: no more edges than nodes, none twice."""

    def run(batches):
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for pdf in batches:
            a, b = forest(np.concatenate((a, pdf["a"].to_numpy())), np.concatenate((b, pdf["b"].to_numpy())))
        yield pd.DataFrame({"a": a, "b": b})

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInPandas(tidy(run), "a long, b long")


def components(edges: DataFrame, rounds: int = 60, alone: int = ALONE) -> DataFrame:
    """(node, label): of every node of edges (a, b) the smallest node that it can reach.

    Each partition contracts its edges to trees. If no more than `alone` are left, one task joins
    them. Else large-star and small-star steps follow in turn until the edges stay as they are;
    each step is one aggregation with partial sums and one join, so a node of very many neighbours
    is split, and a round is one job.
    """
    e = cut(_forests(edges.where("a <> b")))
    if e.count() <= alone:
        e = cut(_forests(e.coalesce(1)))
        roots = e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
        return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
    old = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.greatest("b", "m").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        seen = Observation()
        mark = F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
        e = cut(small.where("a <> b").distinct().observe(seen, *mark))
        new = seen.get
        if new == old:
            break
        old = new
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
