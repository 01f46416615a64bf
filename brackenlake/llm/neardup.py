"""Near duplicates (op2): MinHash with tensored bands for candidates, full shingle sets to confirm links.

Copies of one shingle set are put together first. Some keys from one small hash collection and as many
from another are combined pairwise to table keys, 8 and 8 to 64, at the cost of 16 keys' hashes.
Texts that share a table key are candidates; the groups of candidates are found as components. A
small group is compared in one task. A large one is compared with hubs first; texts that hubs leave
in different components are searched by prefix filtering, which loses no link between them, so that
no task holds a large group. Pairs within a component are not made; of components that share
prefixes but no link, all pairs that pass the filter are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import base

#: Links: 100 * shared shingles >= percent * shingles of both; this is the percent of op2.
PERCENT = 85
#: Hashes of each key, and the chance at most that a pair at the limit shares no key.
DEEP, MISS = 2, 1e-4
#: Texts and bytes of a group that one task compares.
GROUP_TEXTS, GROUP_BYTES = 400, 6 << 20
#: Hubs that a large group is compared with before the prefix search.
HUBS = 4

_rng = np.random.Generator(np.random.PCG64(7))
_MOST = 40
_MUL = _rng.integers(1, 2**63, 2 * _MOST * DEEP, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 2**63, 2 * _MOST * DEEP, dtype=np.uint64)


def keys_a_side(percent: int) -> int:
    """Keys of each collection so that pairs at the limit are missed with MISS at most: 8 for 85 percent, 10 for 80."""
    for side in range(1, _MOST + 1):
        if 2 * (1 - (percent / 100) ** DEEP) ** side <= MISS:
            return side
    raise ValueError("percent is too low")


def linked(n: int, a: int, b: int, percent: int = PERCENT) -> bool:
    """Whether sets of a and b shingles with n in common are linked."""
    return n > 0 and 100 * n >= percent * (a + b - n)


def sketch(docs: DataFrame, side: int) -> DataFrame:
    """(doc_id, n, size, s1, s2, a, b): size of the shingle set, bytes, two sums that name the set, keys of both collections."""

    def run(batches):
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy()
            for first, rows in base.blocks(pdf["text"].tolist()):
                sets = base.shingle_sets(rows)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                full = np.flatnonzero(n)
                s = np.zeros((2, len(sets)), np.uint64)
                keys = np.zeros((len(sets), 2 * side), np.uint64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                    for k in range(2):
                        s[k, full] = np.add.reduceat(base._mix(flat + _ADD[k]), starts)
                    low = np.empty((2 * side * DEEP, len(full)), np.uint64)
                    for k in range(len(low)):
                        low[k] = np.minimum.reduceat((flat ^ _ADD[k]) * _MUL[k], starts)
                    for k in range(2 * side):
                        x = low[DEEP * k]
                        for j in range(1, DEEP):
                            x = base._mix(x) + low[DEEP * k + j]
                        keys[full, k] = base._mix(x)
                signed = keys.view(np.int64)
                yield pd.DataFrame({"doc_id": ids[first : first + len(rows)], "n": n, "size": list(map(len, rows)), "s1": s[0].view(np.int64), "s2": s[1].view(np.int64), "a": list(signed[:, :side]), "b": list(signed[:, side:])})

    return base.texts(docs).mapInPandas(base.tidy(run), "doc_id long, n long, size long, s1 long, s2 long, a array<long>, b array<long>")


def table_keys(reps: DataFrame, side: int) -> DataFrame:
    """(doc_id, key): every pair of a key of one collection with one of the other."""
    pairs = F.flatten(F.transform("a", lambda x, i: F.transform("b", lambda y, j: F.xxhash64(i * side + j, x, y))))
    return reps.select("doc_id", F.explode(pairs).alias("key"))


def diagonal_keys(reps: DataFrame, side: int) -> DataFrame:
    """(doc_id, key): `side` of the table keys, each of the i-th keys of both collections."""
    return reps.select("doc_id", F.explode(F.transform("a", lambda x, i: F.xxhash64(i * side + i, x, F.get("b", i)))).alias("key"))


def candidate_groups(reps: DataFrame, side: int) -> DataFrame:
    """(node, label): groups of texts that table keys hold together, and only such.

    First each text meets the smallest doc_id at `side` of its table keys. Then every table key is
    looked at by the labels so far, once a label and key; where a key still has several labels
    they meet. So a large group goes through the join of keys with `side` rows a text, not with all
    side * side, and no pair that shares a table key stays apart.
    """
    diagonal = diagonal_keys(reps, side)
    low = diagonal.groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("m")).where("m > 1").select("key", "low")
    near = diagonal.join(low, "key").where("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    label = base.components(near)
    own = base.cut(reps.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(F.coalesce("label", "doc_id").alias("doc_id"), "a", "b"))
    keys = table_keys(own, side).groupBy("key", "doc_id").agg(F.count("*").alias("m"))
    keys = base.cut(keys.select("key", "doc_id"))
    mixed = keys.groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("m")).where("m > 1").select("key", "low")
    more = keys.join(mixed, "key").where("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    return base.components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))


def _union_find(n: int):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(x, y):
        x, y = find(x), find(y)
        up[max(x, y)] = min(x, y)

    return find, join


def _compare(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Components of one small group by its inverted lists: (doc_id, label)."""
    pdf = pdf.sort_values("doc_id")
    sets = []
    for _, rows in base.blocks(pdf["text"].tolist()):
        sets += base.shingle_sets(rows)
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(n)))
    mark = np.zeros(int(flat.max()) + 1, bool)
    find, join = _union_find(len(sets))
    for i in range(len(sets) - 1):
        mine = flat[starts[i] : starts[i + 1]]
        mark[mine] = True
        common = np.add.reduceat(mark[flat[starts[i + 1] :]].astype(np.int64), starts[i + 1 : -1] - starts[i + 1])
        mark[mine] = False
        for j in np.flatnonzero(100 * common >= percent * (n[i] + n[i + 1 :] - common)):
            join(i, i + 1 + int(j))
    ids = pdf["doc_id"].to_numpy()
    return pd.DataFrame({"doc_id": ids, "label": [ids[find(i)] for i in range(len(ids))]})


def _set_of(text: str) -> np.ndarray:
    return base.shingle_sets([text.encode("utf-8", "surrogatepass")])[0]


def _against_hub(rows: DataFrame, percent: int) -> DataFrame:
    """rows (doc_id, hub, text, hub_text) to the (doc_id, hub) that are linked."""

    def run(batches):
        hubs: dict = {}
        for pdf in batches:
            out = []
            for d, h, t, ht in zip(pdf["doc_id"], pdf["hub"], pdf["text"], pdf["hub_text"]):
                if h not in hubs:
                    if len(hubs) > 64:
                        hubs.clear()
                    hubs[h] = _set_of(ht)
                x = _set_of(t)
                if linked(len(np.intersect1d(x, hubs[h], assume_unique=True)), len(x), len(hubs[h]), percent):
                    out.append((d, h))
            yield pd.DataFrame(out, columns=["doc_id", "hub"])

    return rows.select("doc_id", "hub", "text", "hub_text").mapInPandas(run, "doc_id long, hub long")


def _prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """rows (doc_id, cluster, least, text, hubs) to (doc_id, cluster, n, prefix).

    Shingles of no hub come first in the common order, then those of hubs. A text linked to
    another has at least so many shingles in common with it, given the least size in the group,
    that two linked texts share one of their prefixes.
    """

    def run(batches):
        known: dict = {}
        for pdf in batches:
            out = []
            for d, c, least, t, hubs in zip(pdf["doc_id"], pdf["cluster"], pdf["least"], pdf["text"], pdf["hubs"]):
                if c not in known:
                    if len(known) > 16:
                        known.clear()
                    known[c] = np.unique(np.concatenate([_set_of(h) for h in hubs]))
                x = _set_of(t)
                other = max(int(least), -(-percent * len(x) // 100))
                common = -(-percent * (len(x) + other) // (100 + percent))
                late = np.isin(x, known[c], assume_unique=True)
                out.append((d, c, len(x), np.concatenate((x[~late], x[late]))[: max(0, len(x) - common + 1)].view(np.int64)))
            yield pd.DataFrame(out, columns=["doc_id", "cluster", "n", "prefix"])

    return rows.mapInPandas(run, "doc_id long, cluster long, n long, prefix array<long>")


def _mixed(of: DataFrame) -> DataFrame:
    """(cluster, shingle) that texts of several labels have in their prefixes."""
    return of.groupBy("cluster", "shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("cluster", "shingle")


def _large(docs: DataFrame, members: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(doc_id, label) of groups that no task may hold. members: (doc_id, cluster, n)."""
    members = base.cut(members)
    if members.isEmpty():
        return members.select("doc_id", F.col("cluster").alias("label"))
    keys = base.cut(diagonal_keys(reps.join(members.select("doc_id"), "doc_id", "left_semi"), keys_a_side(percent)))
    often = keys.groupBy("key").agg(F.count("*").alias("m"))
    rank = base.cut(keys.join(often, "key").groupBy("doc_id").agg(F.sum("m").alias("rank")).join(members, "doc_id"))
    text = base.cut(docs.join(members, "doc_id"))
    least = members.groupBy("cluster").agg(F.min("n").alias("least"))
    rest, links, hubs = rank, None, None
    for _ in range(HUBS):
        hub = base.cut(rest.groupBy("cluster").agg(F.max_by("doc_id", F.struct("rank", -F.col("doc_id"))).alias("hub")))
        hub_text = hub.join(text.select(F.col("doc_id").alias("hub"), F.col("text").alias("hub_text")), "hub")
        got = base.cut(_against_hub(text.join(hub_text, "cluster"), percent))
        links = got if links is None else links.unionByName(got)
        hubs = hub_text if hubs is None else hubs.unionByName(hub_text)
        rest = base.cut(rest.join(got.select("doc_id"), "doc_id", "left_anti"))
        if rest.limit(2).count() < 2:
            break
    all_hubs = hubs.groupBy("cluster").agg(F.collect_list("hub_text").alias("hubs"))  # HUBS texts at most
    prefix = base.cut(_prefixes(text.join(least, "cluster").join(all_hubs, "cluster").select("doc_id", "cluster", "least", "text", "hubs"), percent))
    parts = base.components(links.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
    named = prefix.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    of = named.select("doc_id", "cluster", "n", F.coalesce("label", "doc_id").alias("label"), F.posexplode("prefix").alias("at", "shingle"))
    of = base.cut(of.join(_mixed(of), ["cluster", "shingle"]))
    # of two texts of such sizes so many shingles must be common that one is within each one's first n - common + 1
    common = f"ceil({percent} * (xn + yn) / {100 + percent})"
    fits = f"xl <> yl and xat <= xn - {common} and yat <= yn - {common}"
    names = ("label", "l"), ("doc_id", ""), ("n", "n"), ("at", "at")
    side = lambda rows, s: rows.select("cluster", "shingle", *[F.col(c).alias(s + k) for c, k in names])

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = base.cut(pairs.select("x", "y").distinct())
        two = pairs.join(text.select(F.col("doc_id").alias("x"), "text"), "x").join(text.select(F.col("doc_id").alias("y"), F.col("text").alias("hub_text")), "y")
        return base.cut(_against_hub(two.select(F.col("x").alias("doc_id"), F.col("y").alias("hub"), "text", "hub_text"), percent))

    # first each shingle's texts against one of its texts, so that what this links needs no pairs; then all pairs of different labels
    one = base.cut(of.groupBy("cluster", "shingle").agg(F.min(F.struct("label", "doc_id", "n", "at")).alias("o")).select("cluster", "shingle", "o.*"))
    links = links.unionByName(confirmed(side(one, "x").join(side(of, "y"), ["cluster", "shingle"]).where(fits)))
    parts = base.components(links.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
    of = of.drop("label").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    of = base.cut(of.join(_mixed(of), ["cluster", "shingle"]))
    more = confirmed(side(of, "x").join(side(of, "y"), ["cluster", "shingle"]).where(f"x < y and {fits}"))
    label = base.components(links.unionByName(more).select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
    return members.select("doc_id").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("label", "doc_id").alias("label"))


def _set_sizes(batches):
    for pdf in batches:
        for first, rows in base.blocks(pdf["text"].tolist()):
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[first : first + len(rows)], "n_shingles": list(map(len, base.shingle_sets(rows)))})


def near_duplicates(docs: DataFrame, group_texts: int = GROUP_TEXTS, group_bytes: int = GROUP_BYTES, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Null, empty and blank texts have no shingles and are linked with nothing; texts of under five
    words are compared as a whole; of repeated rows of a doc_id each comes out, alike if the texts
    are; equal texts are linked through the smallest doc_id. A row of a null doc_id can't be named:
    it is linked with nothing, has a null component_id, and is kept. Other columns are left out. At
    most MISS of links at the limit, fewer above, are not candidates.
    """
    side = keys_a_side(percent)
    nameless = base.by_batch(base.texts(docs.where("doc_id is null")), _set_sizes, "n_shingles long")
    docs = base.texts(docs.where("doc_id is not null"))
    found = base.cut(sketch(docs, side))
    name = ["n", "s1", "s2"]
    first = base.cut(found.where("n > 0").groupBy(*name).agg(F.min("doc_id").alias("rep")))  # written, so that Spark can split the join with hot sets
    member = base.cut(found.select("doc_id", *name).join(first, name, "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")))
    reps = base.cut(found.join(first.withColumnRenamed("rep", "doc_id"), ["doc_id", *name], "left_semi").dropDuplicates(["doc_id"]))

    cluster = candidate_groups(reps, side)
    of = base.cut(cluster.select(F.col("node").alias("doc_id"), F.col("label").alias("cluster")).join(reps.select("doc_id", "n", "size"), "doc_id"))
    sizes = of.groupBy("cluster").agg(F.count("*").alias("texts"), F.sum("size").alias("bytes"))
    split = base.cut(of.join(sizes, "cluster").withColumn("small", (F.col("texts") <= group_texts) & (F.col("bytes") <= group_bytes)))
    small = docs.join(split.where("small").select("doc_id", "cluster"), "doc_id").dropDuplicates(["doc_id"])
    label = small.groupBy("cluster").applyInPandas(lambda pdf: _compare(pdf, percent), "doc_id long, label long")
    label = label.unionByName(_large(docs.join(split.where("not small").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), split.where("not small").select("doc_id", "cluster", "n"), reps, percent))
    label = base.cut(label.select(F.col("doc_id").alias("rep"), "label"))
    out = member.join(label, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").cast(LongType()).alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    return out.unionByName(nameless.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))
