"""Conversation prefix trie (op11): nodes are the distinct beginnings of conversations.

A beginning is named by its depth and a running hash of its turns, so nodes come from one grouping.
The distinct conversations are ranked lexicographically by their branches alone: by the nodes on
their path whose parent branches or ends a conversation. A node's first and last rank then give its
place in preorder, (first rank, depth), and the end of its subtree: the place of the conversation
of its last rank, the deepest node that this rank brings. Leaves and savings of a subtree are the
difference of two prefix sums over the preorder.

Prefix sums run over range partitions: each task sums its own rows as they pass, and what earlier
partitions sum up to, one row a partition, is added afterwards. So a conversation of any length, or
a beginning that any share of them has in common, is dealt over many tasks. A path has at most
sqrt(2 * rows) branches, as each of them needs another conversation that reaches it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scans
from . import base


def scan(rows: DataFrame, by: list[str], within: str | None, add: tuple[str, ...] = (), xor: tuple[str, ...] = ()) -> DataFrame:
    """rows with running sums, written where all executors read."""
    return scans.scan(rows, by, within, add, xor, cut=base.cut)


#: Conversations of one family follow each other, this many; and first turns kept are the checksum's remainder by this.
FAMILY, HEADS = 5, 9
NODE = ["depth", "p1", "p2"]


# --- conversations ----------------------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, key, size): the i-th turn of each conversation, a digest of its role and text, the bytes of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("size"), F.lit(1).cast("long").alias("one"))
    return scan(rows, ["conv_id", "turn", "key"], "conv_id", add=("one",)).select("conv_id", F.col("run_one").alias("i"), "key", "size")


def rebuild(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id and n_turns when rebuilt; their turns: conv_id, depth, key, size, n_turns).

    The first h turns come from the first conversation of the family, the others are the own ones
    after the first h; h is a checksum of conv_id.
    """
    count = numbered.groupBy("conv_id").agg(F.count("*").alias("n"))
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    convs = base.cut(count.select("conv_id", "n", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("lead")))
    lead = convs.select(F.col("conv_id").alias("lead"), F.col("n").alias("lead_n"))
    convs = convs.join(lead, "lead", "left").withColumn("m", F.least("h", F.coalesce("lead_n", F.lit(0))))
    convs = base.cut(convs.select("conv_id", "lead", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")))
    own = numbered.join(convs, "conv_id").where("i > h").select("conv_id", (F.col("m") + F.col("i") - F.col("h")).alias("depth"), "key", "size", "n_turns")
    first = numbered.where(F.col("i") < HEADS).withColumnRenamed("conv_id", "lead").join(convs, "lead").where("i <= h")
    return convs, first.select("conv_id", F.col("i").alias("depth"), "key", "size", "n_turns").unionByName(own)


def _digests(ends: DataFrame) -> DataFrame:
    """ends (depth, p1, p2, conv_id) to (depth, p1, p2, several): the SHA-256 of each node's ids in order, as they pass."""
    schema = "depth long, p1 long, p2 long, several string"

    def run(batches):
        at, sha = None, None
        for batch in batches:
            out = []
            for *node, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if node != at:
                    if at:
                        out.append((*at, sha.hexdigest()))
                    at, sha = node, hashlib.sha256(str(c).encode())
                else:
                    sha.update(b",%d" % c)
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "several"), r)) for r in out], schema=kind)
        if at:
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "several"), (*at, sha.hexdigest())))], schema=kind)

    kind = pa.schema([(n, pa.int64()) for n in NODE] + [("several", pa.string())])
    return ends.select(*NODE, "conv_id").repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(run, schema)


def trie(convs: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """The nodes, with place and subtree end in preorder, from (conv_id, n_turns) and (conv_id, depth, key, size, n_turns)."""
    x1, x2 = F.xxhash64("depth", "key"), F.xxhash64("key", F.lit(1), "depth")
    body = scan(rebuilt.withColumns({"x1": x1, "x2": x2}), ["conv_id", "depth"], "conv_id", xor=("x1", "x2"))
    body = base.cut(
        body.select(
            "conv_id", "depth", "size", (F.col("depth") == F.col("n_turns")).alias("ends"), F.col("run_x1").alias("p1"), F.col("run_x2").alias("p2"),
            F.col("run_x1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("run_x2").bitwiseXOR(F.col("x2")).alias("q2"),
        )
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")

    def counted(ends: Column) -> list[Column]:
        return [F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.count_if(ends).alias("n_ends"), F.min(F.when(ends, F.col("conv_id"))).alias("first_end")]

    nodes = body.groupBy(*NODE).agg(*counted(F.col("ends")), F.max("size").alias("size"), F.max("q1").alias("q1"), F.max("q2").alias("q2"))
    root = convs.agg(*counted(F.col("n_turns") == 0)).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "n_convs", "conv_id", "n_ends", "first_end", zero.alias("size"), none.alias("q1"), none.alias("q2"))
    nodes = base.cut(nodes.unionByName(root))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = base.cut(nodes.join(children, NODE, "left").fillna(0, "n_children"))
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), ((F.col("n_children") > 1) | (F.col("n_ends") > 0)).alias("fork"))
    nodes = base.cut(nodes.join(up, ["depth", "q1", "q2"], "left"))

    # one conversation of each distinct one, ranked by the branches of its path
    distinct = nodes.where("n_ends > 0").select(F.col("first_end").alias("conv_id"))
    mine = base.cut(body.join(distinct, "conv_id", "left_semi").select("conv_id", *NODE))
    branches = mine.join(nodes.where("fork").select(*NODE), NODE, "left_semi")
    paths = branches.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*NODE))).alias("path"))
    paths = distinct.join(paths, "conv_id", "left").select("conv_id", F.coalesce("path", F.array().cast(paths.schema["path"].dataType)).alias("path"))
    ranked = base.cut(paths.orderBy("path").select("conv_id", F.monotonically_increasing_id().alias("rank")))

    span = [F.min("rank").alias("first"), F.max("rank").alias("last")]
    spans = mine.join(ranked, "conv_id").groupBy(*NODE).agg(*span).unionByName(ranked.agg(*span).select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "first", "last"))
    rows = nodes.join(spans, NODE).select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_ends", "first_end", "first", "last", ((F.col("n_convs") - 1) * F.col("size")).alias("gain"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), F.lit(1).cast("long").alias("one"))
    rows = base.cut(scan(rows, ["first", "depth"], None, add=("gain", "leaf", "one")))
    far = rows.where("n_ends > 0").select(F.col("first").alias("last"), F.col("run_gain").alias("end_gain"), F.col("run_leaf").alias("end_leaf"), F.col("run_one").alias("end"))
    many = rows.where("n_ends > 1").select(*NODE)
    ends = body.where("ends").select(*NODE, "conv_id").unionByName(convs.where("n_turns = 0").select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id"))
    sha = _digests(ends.join(many, NODE, "left_semi"))
    out = rows.join(far, "last").join(sha, NODE, "left")
    one = F.sha2(F.coalesce(F.col("first_end").cast("string"), F.lit("")).cast("binary"), 256)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("end_leaf") - F.col("run_leaf") + F.col("leaf")).alias("n_leaves"),
        (F.col("end_gain") - F.col("run_gain") + F.col("gain")).alias("saved_tokens"),
        F.coalesce("several", one).alias("ends_sha256"),
        F.col("run_one").alias("position"), F.col("end").alias("end_position"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie over all rebuilt conversations, a row each, with place and subtree end in preorder.

    Turns without conv_id belong to no conversation and are left out; a null turn comes first, of
    equal turns the smaller digest of role and text; a repeated row is a further turn. Null and
    empty roles and texts are the same. Families of negative ids are cut as % cuts. No conversation
    gives no node. Other columns are left out. Turns are told apart by 128 bits of MD5, beginnings
    by 128 bits of a running hash.
    """
    convs, rebuilt = rebuild(turns(conversations.select("conv_id", "turn", "role", "text")))
    return trie(convs, rebuilt)


def prefix_trie_sql() -> str:
    """The same with whole beginnings as lists, and each node counted for all beginnings of its own."""
    crc = "list_reduce(list_prepend(4294967295, list_transform(range(length(conv_id::varchar)), lambda i: ascii(substr(conv_id::varchar, i::int + 1, 1))::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))"
    return f"""with own as (
      select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, md5(coalesce(role, '') || coalesce(text, ''))) as i
      from conversations where conv_id is not null),
    convs as (select conv_id, count(*) as n, conv_id - conv_id % 5 as lead, xor({crc}, 4294967295) % 9 as h from own group by conv_id),
    heads as (select c.conv_id, c.h, c.lead, least(c.h, coalesce(l.n, 0)) as m from convs c left join convs l on c.lead = l.conv_id),
    rebuilt as (
      select h.conv_id, o.i as depth, o.role, o.text from heads h join own o on o.conv_id = h.lead and o.i <= h.h
      union all select h.conv_id, h.m + o.i - h.h, o.role, o.text from heads h join own o on o.conv_id = h.conv_id and o.i > h.h),
    whole as (
      select c.conv_id, list({{'role': r.role, 'text': r.text}} order by r.depth) filter (where r.depth is not null) as seq, count(r.depth) as n_turns
      from convs c left join rebuilt r on c.conv_id = r.conv_id group by c.conv_id),
    begun as (select conv_id, n_turns, d as depth, case when d = 0 then [] else seq[1:d] end as node, case when d > 1 then seq[1:d-1] else [] end as parent, case when d > 0 then strlen(seq[d].text) else 0 end as size
      from whole, (select unnest(range(1000)) as d) where d <= n_turns),
    nodes as (select depth, node, any_value(parent) as parent, any_value(size) as size, min(conv_id) as conv_id, count(*) as n_convs,
      sha256(coalesce(string_agg(case when n_turns = depth then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256 from begun group by depth, node),
    children as (select depth - 1 as depth, parent as node, count(*) as n_children from nodes where depth > 0 group by 1, 2),
    counted as (select n.*, coalesce(c.n_children, 0) as n_children from nodes n left join children c on n.depth = c.depth and n.node = c.node),
    sums as (select a.depth as depth, case when a.depth = 0 then [] else n.node[1:a.depth] end as node, count(*) filter (where n.n_children = 0) as n_leaves, sum((n.n_convs - 1) * n.size)::bigint as saved_tokens
      from counted n, (select unnest(range(1000)) as depth) a where a.depth <= n.depth group by 1, 2)
    select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
    from counted n join sums s on n.depth = s.depth and n.node = s.node left join nodes p on p.depth = n.depth - 1 and p.node = n.parent"""
