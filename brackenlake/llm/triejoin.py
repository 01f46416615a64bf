"""N-gram Jaccard join (op13): exact, by prefix trees over globally ordered shingle sets.

1. Which shingles occur in other texts is counted over all of them: tasks send each bucket of the
   hash space the distinct hashes of a block of texts once, and get counts a text back. A text that
   has too few shingles in common with all others together is linked with none.
2. The shingles of the rest are ordered from rare to frequent. Two linked texts share one of their
   first n - ceil(n * percent / 100) + 1; texts that share one there form a group.
3. A group's sets stand in a trie, frequent shingles first, so that they share long beginnings.
   All queries of a block go down together and share the partial overlaps; a subtree is left out
   if sizes, the shingles that remain on both sides, or equal labels rule out a new link.
4. A group beyond a task's bounds is split by its texts' most frequent key into chunks that each
   hold one text in common. Keys that then still have several labels form the next groups; after
   some rounds the pairs of unlike labels of each key that is left are verified if they are few for
   its texts, else its texts are joined in blocks, two at a time, so that no link is lost.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: Links: 100 * shared shingles >= PERCENT * shingles of both; words of a shingle.
PERCENT, WORDS = 85, 4
#: Texts and shingles of a group that one task joins.
GROUP_TEXTS, GROUP_SHINGLES = 400, 1 << 19
#: Rounds in which large groups are split before the texts of each key are joined in blocks.
SPLITS = 4
#: Pairs of unlike labels that a key may give for each of its texts.
PAIRS = 16
#: Bytes of text whose hashes meet in one bucket, about; least number of buckets; bytes of a block.
BUCKET_BYTES, BUCKETS, BLOCK_BYTES = 32 << 20, 64, 1 << 20
#: Texts up to which their ids are sent to the tasks that read texts, after a count of them: 8 MB.
SENT_IDS = 1 << 20

_U = np.uint64
_ADD = np.random.Generator(np.random.PCG64(13)).integers(1, 2**63, 2, dtype=np.uint64)


def least_common(n, m, percent: int):
    """Shingles that linked sets of n and m have in common at least."""
    return -(-percent * (n + m) // (100 + percent))


# --- the trie -----------------------------------------------------------------------------------


class Trie:
    """Sets of ascending token numbers in lexicographic order; a node is a common beginning, its edge what follows its parent's.

    Each set is a leaf. Nodes stand in preorder; of each: the range of its sets, where its edge lies in
    flat, its depth, the least and largest size of its sets, and the most tokens that any has left.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.order = np.array(sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes()))
        own = [sets[i] for i in self.order]
        self.length = np.fromiter(map(len, own), np.int64, len(own))
        self.size = sizes[self.order]
        self.first = np.concatenate(([0], np.cumsum(self.length)))
        self.flat = np.concatenate(own).astype(np.int64) if own else np.empty(0, np.int64)
        found = [(i, i + 1, int(n)) for i, n in enumerate(self.length)]  # (from, to, depth)
        held: list[tuple[int, int]] = [(0, 0)]  # (depth, from)
        for i in range(1, len(own) + 1):
            common = -1
            if i < len(own):
                k = min(len(own[i - 1]), len(own[i]))
                unlike = np.flatnonzero(own[i - 1][:k] != own[i][:k])
                common = int(unlike[0]) if len(unlike) else k
            start = i - 1
            while held and held[-1][0] > common:
                depth, start = held.pop()
                if i - start > 1 or depth == 0:
                    found.append((start, i, depth))
            if common >= 0 and (not held or held[-1][0] < common):
                held.append((common, start))
        found.sort(key=lambda x: (x[0], -x[1], x[2]))
        self.lo, self.hi, self.depth = (np.array(c, np.int64) for c in zip(*found))
        n = len(found)
        parent = np.full(n, -1)
        path: list[int] = []
        for v in range(n):
            while path and self.hi[path[-1]] <= self.lo[v]:
                path.pop()
            parent[v] = path[-1] if path else -1
            path.append(v)
        self.leaf = np.ones(n, bool)
        self.leaf[parent[1:]] = False
        above = np.where(parent >= 0, self.depth[parent], 0)
        self.edge, self.edge_length = self.first[self.lo] + above, self.depth - above
        ranges = np.column_stack((self.lo, self.hi)).ravel()

        def over(values, join):  # of the sets of each node
            return join.reduceat(np.append(values, values[-1]), ranges)[::2]

        self.least, self.largest = over(self.size, np.minimum), over(self.size, np.maximum)
        self.left = over(self.length, np.maximum) - self.depth
        by_parent = np.argsort(parent[1:], kind="stable") + 1
        self.children = by_parent
        self.child_at = np.searchsorted(parent[by_parent], np.arange(n))
        self.child_n = np.bincount(parent[1:], minlength=n)


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... length[0] of them, and so on."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def join(sets: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, percent: int, cells: int = 1 << 22) -> tuple[np.ndarray, int]:
    """(new labels, trie steps): labels of linked sets become the smallest. Sets hold the hashes that may be in common, sizes count all."""
    flat, counts = np.unique(np.concatenate(sets), return_counts=True)
    number = np.full(len(flat), -1)  # frequent hashes get low numbers, such of one set none
    often = np.lexsort((flat, -counts))
    often = often[counts[often] > 1]
    number[often] = np.arange(len(often))
    dense = []
    for s in sets:
        x = number[np.searchsorted(flat, s)]
        dense.append(np.sort(x[x >= 0]))
    t = Trie(dense, sizes)
    up = {int(x): int(x) for x in labels}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    own, vocabulary, steps = labels[t.order], max(1, len(often)), 0
    ranges = np.column_stack((t.lo, t.hi)).ravel()
    block = max(1, cells // vocabulary)
    for b in range(0, len(sets), block):
        now = np.array([find(int(x)) for x in own])
        padded = np.append(now, now[-1])
        low, high = np.minimum.reduceat(padded, ranges)[::2], np.maximum.reduceat(padded, ranges)[::2]
        rank = np.arange(b, min(b + block, len(sets)))
        has = np.zeros((len(rank), vocabulary), bool)
        at = _spread(t.first[rank], t.length[rank])
        row = np.repeat(np.arange(len(rank)), t.length[rank])
        has[row, t.flat[at]] = True
        keys, key_at = row * vocabulary + t.flat[at], np.concatenate(([0], np.cumsum(t.length[rank])))
        q, v, common = np.arange(len(rank)), np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        while len(q):
            size, mine = t.size[rank[q]], now[rank[q]]
            new = (t.hi[v] - 1 > rank[q]) & (100 * t.largest[v] >= percent * size) & (percent * t.least[v] <= 100 * size) & ~((low[v] == high[v]) & (low[v] == mine))
            q, v, common, size = q[new], v[new], common[new], size[new]
            steps += len(q)
            for part in np.array_split(np.arange(len(q)), 1 + int(t.edge_length[v].sum()) // cells):
                n = t.edge_length[v[part]]
                hit = has[np.repeat(q[part], n), t.flat[_spread(t.edge[v[part]], n)]]
                total = np.concatenate(([0], np.cumsum(hit)))
                ends = np.cumsum(n)
                common[part] += total[ends] - total[ends - n]
            last = np.where(t.depth[v] > 0, t.flat[np.minimum(t.first[t.lo[v]] + np.maximum(t.depth[v], 1) - 1, max(0, len(t.flat) - 1))] if len(t.flat) else 0, -1)
            remain = key_at[q + 1] - np.searchsorted(keys, q * vocabulary + last, "right")
            most = common + np.minimum(remain, t.left[v])
            good = (most >= least_common(size, t.least[v], percent)) & (most > 0)
            leaf = t.leaf[v]
            done = good & leaf & (t.lo[v] > rank[q])
            y = t.lo[v[done]]
            link = 100 * common[done] >= percent * (size[done] + t.size[y] - common[done])
            for a, c in zip(now[rank[q[done][link]]], now[y[link]]):
                a, c = find(int(a)), find(int(c))
                up[max(a, c)] = min(a, c)
            more = good & ~leaf
            n = t.child_n[v[more]]
            q, common, v = np.repeat(q[more], n), np.repeat(common[more], n), t.children[_spread(t.child_at[v[more]], n)]
    return np.array([find(int(x)) for x in labels]), steps


# --- which texts may be linked ----------------------------------------------------------------


def _blocks(buckets: int):
    """Texts to rows (bucket, block, counts, ones, many): hashes that one text of a block has, text by text with their counts; such of several, once; and a row of what is known of the block's texts."""

    def run(batches):
        done = 0
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy()
            for first, rows in base.blocks(pdf["text"].tolist(), BLOCK_BYTES):
                sets = base.shingle_sets(rows, WORDS)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                name = np.zeros((2, len(sets)), np.uint64)
                full = np.flatnonzero(n)
                own = ids[first : first + len(rows)]
                info = lambda got: np.stack([own, n, *name.view(np.int64), got]).tobytes()  # noqa: E731,B023
                block, done = (TaskContext.get().partitionId() << 32) + done, done + 1
                if not len(full):
                    yield pd.DataFrame({"bucket": [-1 - block % buckets], "block": [block], "counts": [info(np.zeros(len(rows), np.int64))], "ones": [b""], "many": [b""]})
                    continue
                flat = np.concatenate([sets[i] for i in full])
                starts = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                for k in range(2):
                    name[k, full] = np.add.reduceat(base._mix(flat + _ADD[k]), starts)
                _, rep, copy_of = np.unique(name[0] ^ (name[1] << _U(1)), return_index=True, return_inverse=True)
                is_rep = np.zeros(len(sets), bool)
                is_rep[rep] = True
                use = np.repeat(is_rep[full], n[full])
                flat, doc = flat[use], np.repeat(full, n[full])[use]
                _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
                several = count[at] > 1
                got = np.bincount(doc[several], minlength=len(sets))[rep][copy_of]
                bucket = ((flat >> _U(32)) % _U(buckets)).astype(np.int64)
                short = flat.astype(np.uint32)
                by = np.argsort(bucket[~several], kind="stable")
                ones, one_bucket, one_doc = short[~several][by], bucket[~several][by], doc[~several][by]
                held = np.bincount(one_bucket * len(sets) + one_doc, minlength=buckets * len(sets)).astype("<u4").reshape(buckets, -1)
                cuts = np.searchsorted(one_bucket, np.arange(buckets + 1))
                known, where = np.unique(flat[several], return_index=True)
                known_bucket = bucket[several][where]
                by = np.argsort(known_bucket, kind="stable")
                many, many_cuts = known[by].astype(np.uint32), np.searchsorted(known_bucket[by], np.arange(buckets + 1))
                out = [(-1 - block % buckets, block, info(got), b"", b"")]
                out += [(k, block, held[k].tobytes(), ones[cuts[k] : cuts[k + 1]].tobytes(), many[many_cuts[k] : many_cuts[k + 1]].tobytes()) for k in range(buckets)]
                yield pd.DataFrame(out, columns=["bucket", "block", "counts", "ones", "many"])

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each block of one bucket how many of each text's hashes other texts have; what is known of blocks passes."""
    if pdf["bucket"].iat[0] < 0:
        return pd.DataFrame({"block": pdf["block"], "known": pdf["counts"], "got": [b""] * len(pdf)})
    ones = [np.frombuffer(x, np.uint32) for x in pdf["ones"]]
    counts = [np.frombuffer(x, "<u4").astype(np.int64) for x in pdf["counts"]]
    flat = np.concatenate(ones)
    seen, often = np.unique(np.concatenate((flat, np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["many"]])))), return_counts=True)
    hot = seen[often > 1]
    hit = np.zeros(len(flat), np.int64)
    if len(hot):
        hit = (hot[np.minimum(np.searchsorted(hot, flat), len(hot) - 1)] == flat).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(hit)))
    ends = np.cumsum(np.concatenate(counts))
    got = total[ends] - total[ends - np.concatenate(counts)]
    cuts = np.cumsum([len(c) for c in counts])[:-1]
    base.give_back()
    return pd.DataFrame({"block": pdf["block"], "known": [b""] * len(pdf), "got": [x.astype("<u4").tobytes() for x in np.split(got, cuts)]})


def _known(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, n, s1, s2, got = np.frombuffer(max(pdf["known"], key=len), np.int64).reshape(5, -1)
    more = np.stack([got.copy(), *[np.frombuffer(x, "<u4").astype(np.int64) for x in pdf["got"] if x]]).sum(0)
    name = pd.DataFrame({"doc_id": ids, "n": n, "s1": s1, "s2": s2, "shared": more})
    name["shared"] = name.groupby(["n", "s1", "s2"])["shared"].transform("max")  # copies within the block sent theirs once
    return name


def shared_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n, s1, s2, shared): size of each text's set, two sums that name it, and how many of it other texts have, or a few more."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS, -(-size // BUCKET_BYTES))
    rows = docs.mapInPandas(base.tidy(_blocks(buckets)), "bucket long, block long, counts binary, ones binary, many binary")
    rows = rows.groupBy("bucket").applyInPandas(_shared, "block long, known binary, got binary")
    return rows.groupBy("block").applyInPandas(_known, "doc_id long, n long, s1 long, s2 long, shared long")


def _sets(batches):
    for pdf in batches:
        for first, rows in base.blocks(pdf["text"].tolist()):
            sets = base.shingle_sets(rows, WORDS)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[first : first + len(rows)], "part": [int(s.sum(dtype=_U).view(np.int64)) if len(s) else 0 for s in sets], "n": list(map(len, sets)), "hashes": [s.view(np.int64) for s in sets]})


def ordered_sets(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, label, n, shared, keys) of texts that may be linked: the hashes that other texts have, and those of them that come early enough in the order from rare to frequent."""
    sets = base.cut(docs.mapInPandas(base.tidy(_sets), "doc_id long, part long, n long, hashes array<long>"))
    each = sets.select("doc_id", "part", "n", F.explode("hashes").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    lists = each.join(often, "h").groupBy("doc_id", "part", "n").agg(F.sort_array(F.collect_set(F.struct("c", "h"))).alias("l")).where(f"100 * size(l) >= {percent} * n")
    early = f"n - ceil({percent} * n / 100) + 1 - (n - size(l))"  # hashes of one text come first
    return lists.select("doc_id", F.col("doc_id").alias("label"), "n", F.expr("l.h").alias("shared"), F.expr(f"slice(l.h, 1, cast(greatest(0, {early}) as int))").alias("keys")).where("size(keys) > 0")


# --- groups ---------------------------------------------------------------------------------------


def _group(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        labels = pdf["label"].to_numpy()
        new, _ = join([np.asarray(x).view(np.uint64) for x in pdf["shared"]], pdf["n"].to_numpy(), labels, percent)
        apart = new != labels
        base.give_back()
        return pd.DataFrame({"a": labels[apart], "b": new[apart]}).drop_duplicates()

    return run


def _rest(sets: DataFrame, keys: DataFrame, percent: int, texts: int) -> DataFrame:
    """Links (a, b) of labels between texts of several labels that share a key, whatever shares it.

    A key with no more than PAIRS pairs of unlike labels a text gives those pairs, so these grow
    with the rows; the texts of any other key are joined in blocks, a trie for each two of them, so
    that no task holds more.
    """
    by_label = keys.groupBy("key", "label").agg(F.count("*").alias("c"))
    cross = by_label.groupBy("key").agg(F.sum("c").alias("of"), F.sum(F.col("c") * F.col("c")).alias("alike"))
    few = (F.col("of") * F.col("of") - F.col("alike")) <= 2 * PAIRS * F.col("of")
    keys = base.cut(keys.join(cross.select("key", few.alias("few")), "key"))
    side = lambda s: keys.where("few").select("key", *[F.col(c).alias(c + s) for c in ("doc_id", "label", "n")])
    pairs = side("_x").join(side("_y"), "key").where(f"doc_id_x < doc_id_y and label_x <> label_y and 100 * n_x >= {percent} * n_y and 100 * n_y >= {percent} * n_x")
    pairs = base.cut(pairs.select("doc_id_x", "doc_id_y").distinct())
    whole = lambda s: sets.select(*[F.col(c).alias(c + s) for c in ("doc_id", "label", "n", "shared")])
    both = pairs.join(whole("_x"), "doc_id_x").join(whole("_y"), "doc_id_y").withColumn("common", F.size(F.array_intersect("shared_x", "shared_y")))
    found = both.where(f"100 * common >= {percent} * (n_x + n_y - common)").select(F.col("label_x").alias("a"), F.col("label_y").alias("b"))
    own = keys.where("not few").select("doc_id", "key", F.ceil(2 * F.col("m") / texts).alias("blocks")).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    units = own.select("doc_id", "key", "block", other).select("doc_id", "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    each = units.join(sets.select("doc_id", "label", "n", "shared"), "doc_id")
    return found.unionByName(each.groupBy("key", "x", "y").applyInPandas(_group(percent), "a long, b long"))


def links(sets: DataFrame, percent: int = PERCENT, group_texts: int = GROUP_TEXTS, group_shingles: int = GROUP_SHINGLES, splits: int = SPLITS) -> DataFrame:
    """(node, label): of each doc_id of sets that is linked with another the smallest doc_id it can reach."""
    found: list[DataFrame] = []
    shape = "a long, b long"
    for turn in range(splits + 1):
        keys = sets.select("doc_id", "label", "n", F.explode("keys").alias("key"))
        mixed = keys.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("doc_id").alias("low"), F.count("*").alias("m")).where("lo <> hi").select("key", "low", "m")
        keys = base.cut(keys.join(mixed, "key"))
        if keys.isEmpty():
            break
        if turn == splits:
            found.append(base.cut(_rest(sets, keys, percent, group_texts)))
            break
        group = base.components(keys.select(F.col("doc_id").alias("a"), F.col("low").alias("b")))
        of = base.cut(sets.drop("keys").join(group.select(F.col("node").alias("doc_id"), F.col("label").alias("cluster")), "doc_id"))
        size = of.groupBy("cluster").agg(F.count("*").alias("texts"), F.sum(F.size("shared")).alias("shingles"))
        size = size.withColumn("small", (F.col("texts") <= group_texts) & (F.col("shingles") <= group_shingles))
        size = base.cut(size)
        small = of.join(size.where("small").select("cluster"), "cluster")
        large = size.where("not small").select("cluster")
        joined = small.groupBy("cluster").applyInPandas(_group(percent), shape)
        if large.isEmpty():
            found.append(base.cut(joined))
            break
        # a large group: its texts by their most frequent key, in chunks that all hold the text with the most of such keys
        wide = of.join(large, "cluster")
        top = keys.groupBy("doc_id").agg(F.max(F.struct("m", "key")).alias("top"), F.sum("m").alias("weight"))
        wide = wide.join(top, "doc_id").withColumn("top", F.col("top.key"))
        wide = base.cut(wide)
        chunks = wide.groupBy("cluster", "top").agg(F.greatest(F.ceil(F.count("*") / group_texts), F.ceil(F.sum(F.size("shared")) / group_shingles)).cast("long").alias("chunks"), F.max_by("doc_id", F.struct("weight", "doc_id")).alias("hub"))
        chunks = base.cut(chunks)
        spread = wide.join(chunks, ["cluster", "top"]).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks"))).where("doc_id <> hub")
        hubs = wide.join(chunks.withColumnRenamed("hub", "doc_id"), ["cluster", "top", "doc_id"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        cols = ["cluster", "top", "chunk", "doc_id", "label", "n", "shared"]
        split = spread.select(cols).unionByName(hubs.select(cols)).groupBy("cluster", "top", "chunk").applyInPandas(_group(percent), shape)
        found.append(base.cut(joined.unionByName(split)))
        label = base.components(reduce(DataFrame.unionByName, found)).select(F.col("node").alias("label"), F.col("label").alias("now"))
        rest = sets.join(wide.select("doc_id").distinct(), "doc_id", "left_semi").join(label, "label", "left")
        sets = base.cut(rest.select("doc_id", F.coalesce("now", "label").alias("label"), "n", "shared", "keys"))
    if not found:
        return sets.select(F.col("doc_id").alias("node"), "label").limit(0)
    return base.components(reduce(DataFrame.unionByName, found))


def _own_size(batches):
    for pdf in batches:
        for first, rows in base.blocks(pdf["text"].tolist()):
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[first : first + len(rows)], "n_shingles": list(map(len, base.shingle_sets(rows, WORDS)))})


def jaccard_join(docs: DataFrame, percent: int = PERCENT, group_texts: int = GROUP_TEXTS, group_shingles: int = GROUP_SHINGLES, splits: int = SPLITS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Null, empty and blank texts have no shingles and are linked with nothing; texts of fewer than
    four words are compared as a whole. Equal sets go through the join as the smallest doc_id; of
    repeated rows of a doc_id each comes out and goes by its own text. A row of a null doc_id can't
    be named: it is linked with nothing and has a null component_id. An empty table gives an empty
    one. Other columns are left out. Shingles are told apart by hashes of 64 bits.
    """
    nameless = base.by_batch(base.texts(docs.where("doc_id is null")), _own_size, "n_shingles long")
    docs = base.texts(docs.where("doc_id is not null")).withColumn("doc_id", F.col("doc_id").cast("long"))
    name = ["n", "s1", "s2"]
    known = base.cut(shared_counts(docs))
    first = base.cut(known.where("n > 0").groupBy(*name).agg(F.min("doc_id").alias("rep"), F.max("shared").alias("shared")))
    member = base.cut(known.select("doc_id", *name).join(first.select(*name, "rep"), name, "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")))
    maybe = base.cut(first.where(f"100 * shared >= {percent} * n").select(F.col("rep").alias("doc_id")).distinct())
    maybe = F.broadcast(maybe) if maybe.count() <= SENT_IDS else maybe
    sets = base.cut(ordered_sets(docs.join(maybe, "doc_id", "left_semi"), percent))
    label = links(sets, percent, group_texts, group_shingles, splits).select(F.col("node").alias("rep"), "label")
    out = member.join(label, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"))
    return out.unionByName(nameless.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
