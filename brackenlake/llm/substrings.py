"""Repeated substrings (op10): an enhanced suffix array's interval tree gives maximal repeats, of which the first copy stays.

Suffixes can't all be shuffled, so texts are cut where their content says. Of every SPAN bytes the
least GRAM-gram is the anchor; equal spans have equal anchors at equal places. Neighbouring spans
with one anchor make a stretch. Of equal stretches two send their bytes, all further copies are removed
as the second is; stretches whose anchor stands nowhere else send nothing. Split in the half that
reaches left of the anchor and the half that reaches right, they meet by the anchor and the bytes
beside it, and a suffix array over them with a stack scan of its intervals yields the repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import base

SPAN, GRAM = 100, 32
GUARD = SPAN - GRAM + 1
BESIDE = (SPAN - GRAM) // 2
#: Bytes of a text that are scanned at once; longer texts are scanned in pieces that overlap by a span.
PIECE = 2 << 20
#: Pieces of one group that one task takes; larger groups are first freed of equal pieces, then split by more bytes beside the anchor.
GROUP = 3000
#: Bytes of stretches that one suffix array takes.
ARRAY_BYTES = 1 << 20
#: Ids of documents up to which they are sent to all executors to leave out the other texts before a join.
SENT_IDS = 1_000_000
#: Anchors of so many stretches in a sample of one document in SAMPLE are spread over SALTS tasks.
SAMPLE, HOT, SALTS = 64, 40, 64

_POS = np.uint64((1 << 24) - 1)


class Scan:
    """Stretches of some bytes: first and last span, anchor, hashes of the anchor's gram and of the stretch."""

    def __init__(self, data: bytes):
        buf = np.frombuffer(data, np.uint8)
        n = len(buf)
        up, self.down = base._power(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(base._BYTE_CASED[buf] * up[:n], out=self.sums[1:])
        if n < SPAN:
            self.first = self.last = self.anchor = np.empty(0, np.int64)
            self.gram = self.whole = np.empty(0, np.uint64)
            return
        g = self.hash(np.arange(n - GRAM + 1), GRAM)
        low = (g & ~_POS) | np.arange(len(g), dtype=np.uint64)
        reach = 1
        while reach * 2 <= GUARD:  # least of 1, 2, 4 ... in a row
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if GUARD > reach:
            low = np.minimum(low[: len(low) - (GUARD - reach)], low[GUARD - reach :])
        at = (low & _POS).astype(np.int64)  # of each span the anchor
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        self.first, self.last, self.anchor = new, np.append(new[1:], len(at)) - 1, at[new]
        self.gram = g[self.anchor]
        self.whole = self.hash(self.first, self.last - self.first + SPAN, self.anchor - self.first)

    def hash(self, at: np.ndarray, n, salt=0) -> np.ndarray:
        """Of the n bytes from each place on."""
        with np.errstate(over="ignore"):
            x = (self.sums[at + n] - self.sums[at]) * self.down[at]
            return base._mix(x + np.asarray(n, np.uint64) * base._STEP + base._mix(np.asarray(salt, np.uint64) + np.uint64(1)))


def _pieces(text: bytes):
    """(offset, bytes): parts whose spans are, together, those of the text."""
    for at in range(0, max(1, len(text) - SPAN + 1), PIECE):
        yield at, text[at : at + PIECE + SPAN - 1]


def anchors(docs: DataFrame, hot) -> DataFrame:
    """(gram, salt, whole, doc_id, at): stretches; at holds the first span, the number of spans and the anchor's place."""

    def run(batches):
        heavy = np.sort(np.array(hot.value if hot else [], np.int64))
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                out = []
                for d, text in zip(pdf["doc_id"][at : at + 256], pdf["text"][at : at + 256]):
                    for offset, piece in _pieces(text.encode("utf-8", "surrogatepass")):
                        s = Scan(piece)
                        if len(s.first):
                            out.append((np.full(len(s.first), d), s.gram.view(np.int64), s.whole.view(np.int64), (s.first + offset) << 16 | (s.last - s.first) << 8 | (s.anchor - s.first)))
                if out:
                    d, g, w, a = map(np.concatenate, zip(*out))
                    yield pd.DataFrame({"gram": g, "salt": np.where(np.isin(g, heavy), 1 + (w + d) % SALTS, 0).astype(np.int32) if len(heavy) else np.zeros(len(g), np.int32), "whole": w, "doc_id": d, "at": a})

    return docs.select("doc_id", "text").mapInPandas(run, "gram long, salt int, whole long, doc_id long, at long")


def _hot(docs: DataFrame):
    """Anchors that stand in many documents, by a sample; they are only dealt to tasks in another way."""
    some = anchors(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0), None)
    often = some.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n")).limit(10_000)
    return docs.sparkSession.sparkContext.broadcast([r["gram"] for r in often.select("gram").collect()])


def _told_apart(batches):
    """Sorted stretches to what may repeat: kind 1 stretches for the suffix arrays, kind 0 copies beyond the second of one stretch.

    A spread anchor's stretches differ from some in other tasks, and equal ones are in several
    tasks too: the first two that a task has of them are of kind 2, with the stretch's hash.
    """
    held = None  # of the last kind of stretch its first two rows, with whether each has been put out
    for pdf in batches:
        if not len(pdf):
            continue
        g, w, s, d, a = (pdf[c].to_numpy() for c in ("gram", "whole", "salt", "doc_id", "at"))
        done = np.zeros(len(g), bool)
        if held is not None:
            g, w, s, d, a, done = (np.concatenate((x, y)) for x, y in zip(held, (g, w, s, d, a, done)))
        fresh = np.concatenate(([True], (g[1:] != g[:-1]) | (w[1:] != w[:-1]) | (s[1:] != s[:-1])))
        start = np.flatnonzero(fresh)
        size = np.diff(np.append(start, len(g)))
        nth = np.arange(len(g)) - np.repeat(start, size)
        twin = (g[start[1:]] == g[start[:-1]]) & (s[start[1:]] == s[start[:-1]])
        put = (s[start] > 0) | (size > 1) | np.concatenate(([False], twin)) | np.concatenate((twin, [False]))
        go = nth == 1
        go[start] = put
        k = np.flatnonzero((go | (nth > 1)) & ~done)
        spread = (s[k] > 0) & (nth[k] < 2)
        yield pd.DataFrame({"kind": np.where(nth[k] > 1, 0, np.where(spread, 2, 1)), "whole": np.where(spread, w[k], 0), "doc_id": d[k], "at": a[k]})
        last = slice(start[-1], start[-1] + min(2, size[-1]))
        held = (g[last], w[last], s[last], d[last], a[last], (done | go)[last])


def _first_of_spread(told: DataFrame) -> DataFrame:
    """Stretches told apart (kind, doc_id, at): of the 2 * SALTS equal ones at most of kind 2 the first two become kind 1, the others kind 0."""
    nth = F.row_number().over(Window.partitionBy("whole").orderBy("doc_id", "at"))
    again = told.where("kind = 2").select(F.when(nth <= 2, 1).otherwise(0).alias("kind"), "doc_id", "at")
    return told.where("kind < 2").select("kind", "doc_id", "at").unionByName(again)


def _key(b: bytes, anchor: int, near: int, far: int) -> int:
    """What all spans that begin near to far bytes before the anchor have in common, as a number."""
    beside = b[anchor - near : anchor - far + SPAN]
    return int.from_bytes(hashlib.blake2b(beside, digest_size=8, salt=bytes((near, far))).digest(), "little", signed=True)


_PIECE = "key long, doc_id long, start long, off long, near int, far int, bytes binary"


def _pieces_of(rows: list, halves: list[tuple[int, int]]):
    """rows (doc_id, start, off, bytes), anchors off bytes after the start, cut to the spans of each range: a _PIECE table."""
    out = []
    for d, start, off, b in rows:
        for near, far in halves:  # spans that begin near to far bytes before the anchor
            lo, hi = max(0, off - far), min(len(b) - SPAN, off - near)
            if lo <= hi:
                out.append((_key(b, off, near, far), d, start + lo, off - lo, near, far, b[lo : hi + SPAN]))
    return pd.DataFrame(out, columns=["key", "doc_id", "start", "off", "near", "far", "bytes"])


def _halves(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ats) to pieces: the two halves of each stretch, by anchor and bytes beside it."""

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 64):
                rows = []
                for d, text, ats in zip(pdf["doc_id"][i : i + 64], pdf["text"][i : i + 64], pdf["ats"][i : i + 64]):
                    b = text.encode("utf-8", "surrogatepass")
                    for at in sorted(map(int, ats)):
                        first, spans, place = at >> 16, (at >> 8) & 255, at & 255
                        rows.append((d, first, place, b[first : first + spans + SPAN]))
                yield _pieces_of(rows, [(0, BESIDE - 1), (BESIDE, SPAN - GRAM)])

    return docs.select("doc_id", "text", "ats").mapInPandas(run, _PIECE)


def _narrower(pieces: DataFrame) -> DataFrame:
    """Pieces split in two by where their spans begin; each part has a key of more bytes, in the end of a whole span."""

    def run(batches):
        for pdf in batches:
            for (near, far), some in pdf.groupby(["near", "far"]):
                mid = (near + far) // 2
                yield _pieces_of(list(zip(some["doc_id"], some["start"], some["off"], some["bytes"])), [(int(near), int(mid)), (int(mid) + 1, int(far))] if near < far else [(int(near), int(far))])

    return pieces.mapInPandas(run, _PIECE)


class SuffixArray:
    """Suffixes of `least` bytes or more of some byte strings in order, with the lengths that neighbours share.

    Shorter ones hold no repeat of that length. Suffixes are sorted by their first `least` bytes,
    then those that are still equal by WIDTH bytes more at a time, to the strings' ends; no match
    goes over an end.
    """

    WIDTH = 64

    def __init__(self, parts: list[bytes], least: int):
        self.least = least
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        count = np.maximum(sizes - least + 1, 0)
        n = self.n = int(count.sum())
        self.part = np.repeat(np.arange(len(parts)), count)
        self.at = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
        pos = (np.cumsum(sizes) - sizes)[self.part] + self.at
        left = sizes[self.part] - self.at  # bytes to the string's end
        buf = np.frombuffer(b"".join(parts) + bytes(max(least, self.WIDTH)), np.uint8)
        key, some, off, width = np.zeros(n, np.int64), np.arange(n), 0, least
        while len(some):  # key: where the suffixes equal so far begin in the order
            rows = self._bytes(buf, pos[some] + off, left[some] - off, width)
            block = np.unique(rows.view(f"S{width}").ravel(), return_inverse=True)[1]
            take = np.minimum(left[some] - off, width)
            order = np.lexsort((take, block, key[some]))
            some, block, take = some[order], block[order], take[order]
            old = np.concatenate(([True], key[some[1:]] != key[some[:-1]]))
            new = old.copy()
            new[1:] |= (block[1:] != block[:-1]) | (take[1:] != take[:-1])
            at = np.arange(len(some))
            start = np.maximum.accumulate(np.where(new, at, 0))
            key[some] += start - np.maximum.accumulate(np.where(old, at, 0))
            off, width = off + width, self.WIDTH
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(some)))
            some = some[np.repeat((size > 1) & (np.maximum.reduceat(left[some], first) > off), size)]
        self.order = np.argsort(key, kind="stable")
        a, b = pos[self.order[:-1]], pos[self.order[1:]]
        most = np.minimum(left[self.order[:-1]], left[self.order[1:]]) if n > 1 else np.zeros(0, np.int64)
        self.shared = np.zeros(n, np.int64)  # with the suffix before
        some, off = np.arange(len(a)), 0
        while len(some):
            same = self._bytes(buf, a[some] + off, most[some] - off, self.WIDTH) == self._bytes(buf, b[some] + off, most[some] - off, self.WIDTH)
            run = np.where(same.all(1), self.WIDTH, np.argmin(same, 1))
            self.shared[1 + some] = np.minimum(off + run, most[some])
            off += self.WIDTH
            some = some[(run == self.WIDTH) & (most[some] > off)]
        self.before = np.where(self.at > 0, buf[np.maximum(pos - 1, 0)].astype(np.int64), 256 + self.part)  # at a string's start: like no other

    @staticmethod
    def _bytes(buf: np.ndarray, at: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
        """Rows of `width` bytes from each place on; past the `left` ones they are 0."""
        rows = np.lib.stride_tricks.sliding_window_view(buf, width)[np.minimum(at, len(buf) - width)]
        if (left < width).any():
            rows[np.arange(width) >= left[:, None]] = 0
        return rows

    def intervals(self):
        """Of each group of maximal repeats (length, first suffix, children's firsts) from the innermost interval out.

        A stack scan over the shared lengths. An interval's suffixes share `length` bytes; it is
        left-diverse if they don't all have one byte before them, else a longer repeat to the left
        holds it and it yields nothing. Its children are intervals in it and single suffixes, each
        told by the one that comes first in (document, place): all occurrences of the interval's
        repeat are those of its children, of which all but one come later than its first. So every
        suffix is in one yield as a later one at most, and all yields together are no longer than
        the array. self.rank must hold the order of suffixes in (document, place).
        """
        if self.n < 2:
            return
        before = self.before[self.order]
        starts = np.flatnonzero(self.shared < self.least)
        size = np.diff(np.append(starts, self.n))
        lo, hi = np.minimum.reduceat(before, starts), np.maximum.reduceat(before, starts)
        for r in np.flatnonzero((size > 1) & (lo != hi)).tolist():
            a, b = int(starts[r]), int(starts[r] + size[r])
            shared, byte, rank = self.shared[a:b].tolist(), before[a:b].tolist(), self.rank[self.order[a:b]].tolist()
            stack: list[list] = [[0, -1, []]]  # shared length, the byte before all of it (-2: several), firsts of what is in it
            for i in range(1, b - a + 1):
                s = shared[i] if i < b - a else 0
                child = [byte[i - 1], rank[i - 1]]  # the byte before, the first
                while stack[-1][0] > s:
                    length, own, firsts = stack.pop()
                    own = child[0] if own in (-1, child[0]) else -2
                    firsts.append(child[1])
                    first = min(firsts)
                    if own == -2:
                        yield length, first, firsts
                    child = [own, first]
                if stack[-1][0] < s:
                    stack.append([s, child[0], [child[1]]])
                else:
                    top = stack[-1]
                    top[1] = child[0] if top[1] in (-1, child[0]) else -2
                    top[2].append(child[1])


def repeats(ids: np.ndarray, starts: np.ndarray, parts: list[bytes]) -> pd.DataFrame:
    """(doc_id, s, e): of every repeat of SPAN bytes or more all copies but the first, as runs that don't touch."""
    s = SuffixArray(parts, SPAN)
    d, p = ids[s.part], starts[s.part] + s.at
    order = np.lexsort((p, d))
    fresh = np.ones(len(order), bool)  # one place may stand in two parts
    fresh[1:] = (d[order[1:]] != d[order[:-1]]) | (p[order[1:]] != p[order[:-1]])
    s.rank = np.empty(len(order), np.int64)
    s.rank[order] = np.cumsum(fresh) - 1
    place = order[fresh]
    at, n = [], []
    for length, first, firsts in s.intervals():
        for x in firsts:
            if x != first:
                at.append(x)
                n.append(length)
    return _merged(d[place[at]], p[place[at]], np.array(n, np.int64)) if at else pd.DataFrame({"doc_id": [], "s": [], "e": []}, dtype=np.int64)


def _merged(d: np.ndarray, s: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """Runs of n bytes from s on, put together where they meet."""
    order = np.lexsort((s, d))
    d, s, e = d[order], s[order], (s + n)[order]
    doc = np.cumsum(np.concatenate(([0], d[1:] != d[:-1])))
    far = np.int64(e.max() + 1)
    to = np.maximum.accumulate(doc * far + e)
    new = np.concatenate(([True], doc[1:] * far + s[1:] > to[:-1]))
    new[1:] |= doc[1:] != doc[:-1]
    k = np.flatnonzero(new)
    return pd.DataFrame({"doc_id": d[k], "s": s[k], "e": to[np.append(k[1:], len(d)) - 1] - doc[k] * far})


def _by_array(batches):
    """Sorted pieces (key, doc_id, start, bytes) to removed runs; groups are put together to arrays of ARRAY_BYTES."""

    def solve(pdf):
        return repeats(pdf["doc_id"].to_numpy(), pdf["start"].to_numpy(), pdf["bytes"].tolist())

    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        held = None
        if not len(pdf):
            continue
        key = pdf["key"].to_numpy()
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(pdf))  # of groups
        total = np.concatenate(([0], np.cumsum(pdf["bytes"].map(len).to_numpy())))
        at = 0
        for e in ends[:-1].tolist():  # the last group may go on
            if total[e] - total[at] >= ARRAY_BYTES:
                yield solve(pdf.iloc[at:e])
                at = e
        held = pdf.iloc[at:]
    if held is not None and len(held):
        yield solve(held)


def _arrays(pieces: DataFrame) -> DataFrame:
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = pieces.select("key", "doc_id", "start", "bytes").repartition(n, "key").sortWithinPartitions("key")
    return some.mapInPandas(_by_array, "doc_id long, s long, e long")


def _large(pieces: DataFrame, group: int) -> DataFrame:
    """Pieces of groups that no task may hold to removed runs.

    Of equal pieces of a group the first goes on, the others are removed whole. A group that is
    still large is split by where spans begin, which makes its keys longer: after seven rounds at
    most a key is a whole span, of which only one piece can be left.
    """
    out = []
    while True:
        first = base.cut(pieces.groupBy("key", "bytes").agg(F.min(F.struct("doc_id", "start", "off", "near", "far")).alias("o"), F.count("*").alias("m")))
        late = pieces.join(first.where("m > 1"), ["key", "bytes"]).where((F.col("doc_id") != F.col("o.doc_id")) | (F.col("start") != F.col("o.start")))
        out.append(base.cut(late.select("doc_id", F.col("start").alias("s"), (F.col("start") + F.octet_length("bytes")).alias("e"))))
        one = first.select("key", "bytes", "o.*")
        size = base.cut(one.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
        out.append(_arrays(one.join(size.where(F.col("n") <= group).select("key"), "key")))
        pieces = base.cut(_narrower(one.join(size.where(F.col("n") > group).select("key"), "key").select(pieces.columns)))
        if pieces.isEmpty():
            break
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs with one of the ids, before a join; too many ids to send leave all documents to that join."""
    return docs.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= SENT_IDS else docs


_FINAL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _final(batches):
    for pdf in batches:
        rows = []
        for d, text, spans in zip(pdf["doc_id"], pdf["text"], pdf["spans"]):
            b = text.encode("utf-8", "surrogatepass")
            keep, at, removed, n, to = [], 0, 0, 0, -1
            for s, e in sorted((x["s"], x["e"]) for x in spans):
                if s > to:
                    n += 1
                    keep.append(b[at:s])
                    removed += e - s
                    at = to = e
                elif e > to:
                    removed += e - to
                    at = to = e
            keep.append(b[at:])
            rows.append((d, len(b), removed, n, hashlib.sha256(b"".join(keep)).hexdigest()))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed_runs(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, s, e): byte runs of distinct texts (doc_id, text) that repeat earlier ones; they may overlap."""
    spark = docs.sparkSession
    dealt = anchors(docs, _hot(docs))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "gram", "salt").sortWithinPartitions("gram", "salt", "whole", "doc_id", "at")
    told = base.cut(_first_of_spread(base.cut(dealt.mapInPandas(_told_apart, "kind int, whole long, doc_id long, at long"))))
    equal = told.where("kind = 0").select("doc_id", F.shiftright("at", 16).alias("s"), (F.shiftright("at", 16) + F.shiftright("at", 8).bitwiseAND(255) + SPAN).alias("e"))
    ats = told.where("kind = 1").groupBy("doc_id").agg(F.collect_list("at").alias("ats"))  # of one document
    halves = base.cut(_halves(_only(docs, told.where("kind = 1").select("doc_id").distinct()).join(ats, "doc_id")))
    size = base.cut(halves.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    runs = equal.unionByName(_arrays(halves.join(size.where(F.col("m") <= group).select("key"), "key")))
    many = size.where(F.col("m") > group).select("key")
    if many.isEmpty():
        return runs
    return runs.unionByName(_large(base.cut(halves.join(many, "key").select(halves.columns)), group))


def deduplicate(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document, read as UTF-8.

    A text equal to that of a smaller doc_id goes as a whole if it has SPAN bytes, and is compared
    with nothing else. Null and empty texts have 0 bytes; texts under SPAN bytes lose nothing;
    repeated rows with one doc_id and text come out each, alike, and count as one document; a row
    of a null doc_id has no place in the order, so it loses nothing and no other loses by it. Other
    columns are left out.
    """
    nameless = base.texts(docs.where("doc_id is null"))
    docs = base.texts(docs.where("doc_id is not null"))
    name = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("name"), F.sha2("text", 256).alias("sha"))
    name = base.cut(name)
    first = base.cut(name.groupBy("name", "n_bytes").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))  # written, so that Spark can split the join with hot texts
    member = base.cut(name.join(first, ["name", "n_bytes"]).drop("name"))
    again = member.where("doc_id <> first").select("doc_id").distinct()
    distinct = docs.where(F.octet_length("text") >= SPAN)
    distinct = distinct.join(F.broadcast(again), "doc_id", "left_anti") if again.count() <= SENT_IDS else distinct.join(again, "doc_id", "left_anti")
    repeated = base.cut(member.where("copies > 1").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not repeated.isEmpty():
        distinct = distinct.dropDuplicates(["doc_id"])
    runs = base.cut(removed_runs(distinct, group))
    spans = runs.groupBy("doc_id").agg(F.collect_set(F.struct("s", "e")).alias("spans"))  # of one document
    cut_ = _only(distinct, runs.select("doc_id").distinct()).join(spans, "doc_id").select("doc_id", "text", "spans").mapInPandas(_final, _FINAL).withColumnsRenamed({"n_removed": "r", "n_spans": "k", "kept_sha256": "h"}).drop("n_bytes")
    out = member.join(cut_, "doc_id", "left")
    whole = (F.col("doc_id") != F.col("first")) & (F.col("n_bytes") >= SPAN)
    zero = F.lit(0).cast("long")
    nameless = nameless.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    out = out.select("doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("r", zero)).alias("n_removed"), F.when(whole, zero + 1).otherwise(F.coalesce("k", zero)).alias("n_spans"), F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("h", "sha")).alias("kept_sha256"))
    return out.unionByName(nameless)
