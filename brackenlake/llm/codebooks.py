"""Vector compression by codebooks (op12): each part of a vector becomes the index of its nearest entry.

The entries of each part position stand in a vantage-point tree. Tasks search it for all parts of a
batch at once by branch and bound: a branch is visited unless its distance bound, rounded down, lies
beyond the best distance so far, rounded up; branches at just that distance are visited too, and
only squared distances in integers decide, ties by the lower index. So the result is that of
comparing with all entries. Codebooks are learned in rounds; what a round sends to the driver is a
sum and a count for each component of each entry, which does not grow with the data.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import base

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A component times this, rounded down, is its integer.
SCALE = 256
#: Entries that a leaf of the tree compares one by one.
LEAF = 6
#: Distances and bounds count as off by at most this share.
SLACK = 2.0**-40


def most(dim: int) -> int:
    """Integers are held within this bound on both sides, so that a squared distance of dim components fits a long."""
    return math.isqrt((1 << 62) // max(1, dim)) // 2


# --- vantage-point tree ------------------------------------------------------------------------


@dataclass
class Node:
    """A leaf with entries, or a vantage entry and branches, each with the least and largest distance from it."""

    entries: np.ndarray
    branches: list[tuple[float, float, "Node"]] = field(default_factory=list)


def tree(points: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """The tree over entries (indexes, ascending) of integer points; entries at the median distance or nearer form one branch."""
    entries = np.arange(len(points)) if entries is None else entries
    if len(entries) <= LEAF:
        return Node(entries)
    vantage, rest = entries[:1], entries[1:]
    far = _squares(points[rest], points[vantage])[:, 0]
    near = far <= np.partition(far, (len(far) - 1) // 2)[(len(far) - 1) // 2]
    out = Node(vantage)
    for some in (near, ~near):
        if some.any():
            out.branches.append((math.sqrt(int(far[some].min())), math.sqrt(int(far[some].max())), tree(points, rest[some])))
    return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances in integers of all rows of a to all rows of b."""
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        off = a[:, k, None] - b[None, :, k]
        out += off * off
    return out


def nearest(points: np.ndarray, root: Node, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest point, squared distance) of each row of parts, and how many distances it took."""
    best = np.full(len(parts), np.iinfo(np.int64).max)
    index = np.zeros(len(parts), np.int64)
    taken = 0

    def compare(entries, rows):
        nonlocal taken
        d = _squares(parts[rows], points[entries])
        taken += d.size
        k = d.argmin(1)  # the first of equal ones; entries ascend
        low, at = d[np.arange(len(rows)), k], entries[k]
        better = (low < best[rows]) | ((low == best[rows]) & (at < index[rows]))
        best[rows[better]], index[rows[better]] = low[better], at[better]
        return d

    def visit(node, rows):
        if not len(rows):
            return
        d = compare(node.entries, rows)
        if not node.branches:
            return
        away = np.sqrt(d[:, 0].astype(np.float64))

        def may_hold(branch, mine):
            least, largest, _ = branch
            gap = np.maximum(away[mine] - largest, least - away[mine]) - SLACK * (away[mine] + largest)
            return mine[gap <= np.sqrt(best[rows[mine]].astype(np.float64)) * (1 + SLACK)]

        first_inner = away <= (node.branches[0][1] + node.branches[-1][0]) / 2
        for mine, order in ((np.flatnonzero(first_inner), node.branches), (np.flatnonzero(~first_inner), node.branches[::-1])):
            for branch in order:
                visit(branch[2], rows[may_hold(branch, mine)])

    visit(root, np.arange(len(parts)))
    return index, best, taken


# --- rows --------------------------------------------------------------------------------------


def kept(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there, without null or non-finite components."""
    whole = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vector).isNotNull() & whole)


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    """Components of vectors of one length as integers, a row each."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(values * SCALE), -most(dim), most(dim)).astype(np.int64).reshape(-1, dim)


def _assigned(ints: np.ndarray, books: list[np.ndarray], trees: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) of the parts of each row."""
    width = ints.shape[1] // len(books)
    codes, far = np.empty((len(ints), len(books)), np.int64), np.empty((len(ints), len(books)), np.int64)
    for p, (book, root) in enumerate(zip(books, trees)):
        codes[:, p], far[:, p], _ = nearest(book, root, ints[:, p * width : (p + 1) * width])
    return codes, far


def _sums(vectors: DataFrame, vector: str, dim: int, books: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Of each (part, entry) that some part is nearest to: the count of such parts and the sums of their components."""
    trees, width = [tree(b) for b in books], dim // len(books)

    def run(batches):
        n = np.zeros((len(books), max(map(len, books))), np.int64)
        total = np.zeros((*n.shape, width), np.int64)
        for batch in batches:
            ints = _integers(batch.column(0), dim)
            codes, _ = _assigned(ints, books, trees)
            for p in range(len(books)):
                n[p] += np.bincount(codes[:, p], minlength=n.shape[1])
                np.add.at(total[p], codes[:, p], ints[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(n)
        rows = {"part": np.repeat(part, width), "entry": np.repeat(entry, width), "at": np.tile(np.arange(width), len(part)), "n": np.repeat(n[part, entry], width), "total": total[part, entry].ravel()}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in rows.items()})

    cells = vectors.select(vector).mapInArrow(base.tidy(run), "part long, entry long, at long, n long, total long")
    found = cells.groupBy("part", "entry", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out: dict = {}
    for r in found:  # PARTS * ENTRIES * width rows at most
        out.setdefault((r["part"], r["entry"]), (int(r["n"]), [0] * width))[1][r["at"]] = int(r["total"])
    return out


def _first(vectors: DataFrame, key: str, vector: str, parts: int, entries: int) -> tuple[int, list[np.ndarray]]:
    """The length of vectors that can be coded, and the first codebooks: vectors of the smallest keys."""
    named = vectors.where(F.col(key).isNotNull())
    lowest = named.orderBy(key, vector).select(F.size(vector)).first()
    dim = lowest[0] if lowest else 0
    if not dim or dim % parts:
        return 0, []
    named = named.where(F.size(vector) == dim)
    keys = [r[0] for r in named.select(key).distinct().orderBy(key).limit(entries).collect()]
    rows = named.where(F.col(key).isin(keys)).groupBy(key).agg(F.min(vector).alias("v")).orderBy(key).collect()
    ints = _integers(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), dim)
    return dim, [np.ascontiguousarray(b) for b in np.split(ints, parts, axis=1)]


def learn(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, list[np.ndarray]]:
    """(length of vectors, codebook of each part position) from rows that kept() gives."""
    dim, books = _first(vectors, key, vector, parts, entries)
    for _ in range(rounds if books else 0):
        for (p, e), (n, total) in _sums(vectors.where(F.size(vector) == dim), vector, dim, books).items():
            books[p][e] = [t // n for t in total]
    return dim, books


def encode(vectors: DataFrame, dim: int, books: list[np.ndarray], vector: str = "embedding") -> DataFrame:
    """vectors without their vector, with code (hex) and error; both are null for vectors of another length."""
    others = [f for f in vectors.schema.fields if f.name != vector]
    schema = StructType([*others, StructField("code", StringType()), StructField("error", LongType())])
    trees = [tree(b) for b in books]

    def run(batches):
        for batch in batches:
            codes, far = _assigned(_integers(batch.column(batch.num_columns - 1), dim), books, trees)
            code = pa.array([bytes(c).hex() for c in codes.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], code, pa.array(far.sum(1), pa.int64())], names=schema.names)

    names = [f.name for f in others]
    fits = F.size(vector) == dim if dim else F.lit(False)
    coded = vectors.where(fits).select(*names, vector).mapInArrow(base.tidy(run), schema)
    return coded.unionByName(vectors.where(~fits).select(*names, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components of all entries in order."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector.

    Rows without a vector, or with null or non-finite components, are left out. Rows of a null
    vec_id are coded like others, and start no codebook. Of repeated rows of a vec_id each comes
    out; the smallest of their vectors starts an entry. Vectors whose length is not that of the
    smallest vec_id's, or is no multiple of 16, have a null code and error and add nothing. With
    fewer than 64 vec_ids there are as many entries. An empty table gives an empty one. Components
    are held within most() on both sides (2 ** 27 for 64 components). Other columns are left out.
    """
    rows = kept(vectors.select("vec_id", "label", "embedding"))
    dim, books = learn(rows)
    out = base.cut(encode(rows, dim, books))
    by_label = out.groupBy(F.col("label").alias("its")).agg(F.sum("error").alias("label_error"))
    out = out.join(by_label, F.col("label").eqNullSafe(F.col("its")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def compress_sql() -> str:
    """The same by comparing every part with every entry."""
    assign = """a{i} as (
      select p, vec_id, label, v, arg_min(e, d * 64 + e) as e, min(d) as d from (
        select x.p, x.vec_id, x.label, x.v, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
        from part x join c{i} c on x.p = c.p) group by p, vec_id, label, v)"""
    update = """s{i} as (select p, e, k, sum(v[k + 1])::bigint as s, count(*)::bigint as n from a{i}, range(w) r(k) group by p, e, k),
    m{i} as (select p, e, list((s - ((s % n) + n) % n) // n order by k) as v from s{i} group by p, e),
    c{j} as (select c.p, c.e, coalesce(m.v, c.v) as v from c{i} c left join m{i} m on c.p = m.p and c.e = m.e)"""
    update = update.replace("range(w)", "range((select max(len(v)) from part))")
    steps = ",\n".join([assign.format(i=0), update.format(i=0, j=1), assign.format(i=1), update.format(i=1, j=2), assign.format(i=2)])
    return f"""with rows as (
      select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    part as (select p, vec_id, label, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] as v from rows, range(16) r(p)),
    c0 as (select p, row_number() over (partition by p order by vec_id) - 1 as e, v from part qualify row_number() over (partition by p order by vec_id) <= 64),
    {steps},
    book as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as h from c2),
    coded as (select vec_id, label, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from a2 group by vec_id, label)
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256 from coded, book"""
