"""Prefix trie of conversations by the Euler-tour technique.

Turns become hashes of 128 bits and lengths where they are read; texts aren't shuffled. Numbers of turns, and the
exclusive or of (position, turn) hashes up to each turn, which names its prefix, are running values over range partitions
(dustloom.operators.ranges), so a conversation or a family of children may lie in many tasks. A node is known by its
smallest member and its depth. Nodes are co-sorted with their children, which gives parents, siblings and first children
without a join on a parent, however many children it has.

Each node has an enter and an exit arc; they form one list, the tour. It is ranked by contraction: in each round the arcs whose
random priority is below both neighbours' (a third of them, no two adjacent) hand their weights to the arc before and go; when
SMALL are left they are summed from the end, and the rounds are undone in reverse, an arc's sum being its own weight and that
of its next arc. Rounds shrink geometrically, so the work is that of a few passes. What the sums at a node's two arcs differ by
is the sum over its subtree: leaves, and savings.

ends_sha256 runs over a byte string that has no bound, in order: ids are joined to text in range partitions, and one task streams the
pieces of a node through its hash, which the definition of the hash can't avoid, without holding them.

Defined results: rows with a null conv_id are left out; null roles and texts are empty; turns are in order of turn (null
first), rows of one turn in order of their hashes; repeated rows are turns of their own; other columns play no part;
an empty table gives no node. Two different prefixes share a name with a chance of 2^-128.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dustloom.llm.common import scratch
from dustloom.operators.ranges import beside, ordered, running

#: Arcs that one task ranks, once the tour is contracted to as many.
SMALL = 8192
#: Conversations take up to so many turns less one of their family's first, which are FAMILY conversations each.
BORROWED, FAMILY = 9, 5
#: Turns of a conversation that share a part of the join with what their conversation borrows.
BLOCK = 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "x1", "x2"]


def numbered_turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, pos from 0, the turn's hash t1 and t2, and bytes of its text."""
    r, t = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256)
    turns = conversations.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.xxhash64(F.lit(1), digest).alias("t1"), F.xxhash64(F.lit(2), digest).alias("t2"), F.octet_length(t).cast("long").alias("bytes")
    )
    o = ordered(turns, ["conv_id"], ["turn", "t1", "t2"])
    counted = running(o.rows, o, {"nth": ("sum", F.lit(1).cast("long"))}, write=False)
    return scratch(counted.select("conv_id", (F.col("nth") - 1).alias("pos"), "t1", "t2", "bytes"), "turns")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns after borrowing, and conv_id and length of each conversation, none left out."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED
    counts = scratch(turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n")), "conversations")
    first = counts.select(F.col("conv_id").alias("family"), F.col("n").alias("n_first"))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = counts.withColumns({"family": family, "h": h}).join(first, "family", "left")
    convs = scratch(convs.select("conv_id", "family", "h", "n", F.least("h", F.coalesce("n_first", F.lit(0))).alias("taken")), "families")
    head = turns.where(F.col("pos") < BORROWED - 1).withColumnRenamed("conv_id", "family")
    borrowed = head.join(convs.select("conv_id", "family", "taken"), "family").where(F.col("pos") < F.col("taken")).drop("family", "taken")
    # only conversations that found fewer turns than they ask for move up; long ones meet their shift block by block
    short = convs.where(F.col("taken") < F.col("h")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / BLOCK))).alias("block"), (F.col("taken") - F.col("h")).alias("shift"))
    own = turns.where(F.col("pos") >= h).withColumn("block", F.floor(F.col("pos") / BLOCK)).join(short, ["conv_id", "block"], "left")
    own = own.withColumn("pos", F.col("pos") + F.coalesce("shift", F.lit(0)))
    lengths = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return borrowed.select(*turns.columns).unionByName(own.select(*turns.columns)), lengths


def _named_prefixes(turns: DataFrame) -> DataFrame:
    """For each turn its conversation's prefix up to it: conv_id, depth, name x1 and x2, its parent's p1 and p2, bytes of the turn, and whether it is the last."""
    hashed = turns.select("conv_id", "pos", "bytes", F.xxhash64("pos", "t1", "t2").alias("e1"), F.xxhash64("pos", "t2", "t1").alias("e2"))
    o = ordered(hashed, ["conv_id"], ["pos"], with_rest=False)
    named = running(o.rows, o, {"x1": ("xor", F.col("e1")), "x2": ("xor", F.col("e2"))}, write=False)
    both = beside(o, ["pos"], named)
    parent = {"p1": F.col("x1").bitwiseXOR(F.col("e1")), "p2": F.col("x2").bitwiseXOR(F.col("e2"))}
    return scratch(both.select("conv_id", (F.col("pos") + 1).alias("depth"), "x1", "x2", *(c.alias(n) for n, c in parent.items()), "bytes", F.col("_b").isNull().alias("last")), "prefixes")


def _stream_hashes(batches):
    """One SHA-256 of each node whose pieces of text follow each other, joined by commas."""
    node, state = None, None
    for batch in batches:
        done: list[tuple] = []
        for *now, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if now == node:
                state.update(b"," + text.encode())
                continue
            if node is not None:
                done.append((*node, state.hexdigest()))
            node, state = now, hashlib.sha256(text.encode())
        yield _hash_batch(done)
    if node is not None:
        yield _hash_batch([(*node, state.hexdigest())])


def _hash_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*NODE, "ends_sha256"])


def _end_hashes(ends: DataFrame) -> DataFrame:
    """ends: node and conv_id. The hash of each node's conv_ids."""
    o = ordered(ends, NODE, ["conv_id"])
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))
    pieces = o.rows.groupBy(*NODE, "_part").agg(F.array_join(ids, ",").alias("text"))
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "_part").mapInArrow(_stream_hashes, "depth long, x1 long, x2 long, ends_sha256 string")


def _linked_nodes(prefixes: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row a node: conv_id, depth, parent, first and last child, siblings before and after, n_children, n_convs, bytes and its name."""
    nodes = prefixes.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = root.select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id", "n_convs", zero.alias("bytes"), none.alias("p1"), none.alias("p2"))
    nodes = scratch(nodes.unionByName(root), "nodes")
    own = nodes.select((F.col("depth") + 1).alias("g"), F.col("x1").alias("k1"), F.col("x2").alias("k2"), F.lit(0).alias("kind"), "conv_id", "n_convs", "bytes")
    child = nodes.where("depth > 0").select(F.col("depth").alias("g"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(1).alias("kind"), "conv_id", none.alias("n_convs"), none.alias("bytes"))
    o = ordered(own.unionByName(child), ["g", "k1", "k2"], ["kind", "conv_id"], with_rest=False)
    family = running(o.rows, o, {"parent": ("max", F.when(F.col("kind") == 0, F.col("conv_id")))}, write=False)
    met = beside(o, ["kind", "conv_id"], family)
    is_child = F.col("kind") == 1
    for_node = F.struct(
        "conv_id", (F.col("g") - 1 + F.col("kind")).alias("depth"), F.when(is_child, F.col("parent")).alias("parent"),
        F.when(~is_child, F.col("_b.conv_id")).alias("first_child"), none.alias("last_child"), F.when(is_child & (F.col("_a.kind") == 1), F.col("_a.conv_id")).alias("before"), F.when(is_child, F.col("_b.conv_id")).alias("after"),
        zero.alias("n_children"), "n_convs", "bytes", F.when(~is_child, F.col("k1")).alias("x1"), F.when(~is_child, F.col("k2")).alias("x2"),
    )
    for_parent = F.struct(
        F.col("parent").alias("conv_id"), (F.col("g") - 1).alias("depth"), none.alias("parent"), none.alias("first_child"), F.col("conv_id").alias("last_child"), none.alias("before"), none.alias("after"),
        F.lit(1).cast("long").alias("n_children"), none.alias("n_convs"), none.alias("bytes"), none.alias("x1"), none.alias("x2"),
    )
    said = met.select(F.explode(F.when(is_child, F.array(for_node, for_parent)).otherwise(F.array(for_node))).alias("r")).select("r.*")
    return scratch(said.groupBy("conv_id", "depth").agg(*((F.sum if c == "n_children" else F.max)(c).alias(c) for c in said.columns[2:])), "linked")


def _tour(nodes: DataFrame) -> DataFrame:
    """Two arcs a node: c and a (twice the depth, one more for exit), the arc after (nc, na) and before (pc, pa), weights w1 and w2."""
    enter, leave = 2 * F.col("depth"), 2 * F.col("depth") + 1
    or_else = lambda c, there, other: F.when(F.col(c).isNotNull(), there).otherwise(other)
    has = F.col("n_children") > 0
    zero = F.lit(0).cast("long")
    arcs = F.array(
        F.struct(
            F.col("conv_id").alias("c"), enter.alias("a"), F.coalesce("first_child", "conv_id").alias("nc"), F.when(has, enter + 2).otherwise(leave).alias("na"),
            F.coalesce("before", "parent").alias("pc"), or_else("before", leave, F.when(F.col("parent").isNotNull(), enter - 2)).alias("pa"),
            F.when(has, zero).otherwise(F.lit(1).cast("long")).alias("w1"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("w2"),
        ),
        F.struct(
            F.col("conv_id").alias("c"), leave.alias("a"), F.coalesce("after", "parent").alias("nc"), or_else("after", enter, F.when(F.col("parent").isNotNull(), leave - 2)).alias("na"),
            F.coalesce("last_child", "conv_id").alias("pc"), F.when(has, leave + 2).otherwise(enter).alias("pa"), zero.alias("w1"), zero.alias("w2"),
        ),
    )
    return scratch(nodes.select(F.explode(arcs).alias("r")).select("r.*"), "tour")


def _goes(level: int):
    """Whether an arc is removed in this round: neither end of the tour, and of lower priority than both neighbours (names break ties)."""
    rank = lambda p: F.struct(F.xxhash64(F.lit(level), f"{p}c", f"{p}a"), F.col(f"{p}c"), F.col(f"{p}a"))
    mine = F.struct(F.xxhash64(F.lit(level), "c", "a"), F.col("c"), F.col("a"))
    return F.col("nc").isNotNull() & F.col("pc").isNotNull() & (mine < rank("n")) & (mine < rank("p"))


def _contracted(arcs: DataFrame, level: int) -> DataFrame:
    none = F.lit(None).cast("long")
    names = ["c", "a", "nc", "na", "pc", "pa", "w1", "w2", "mn", "ma", "mp", "mb"]
    row = lambda *cols: F.struct(*(c.alias(n) for n, c in zip(names, cols, strict=True)))
    col = F.col
    zero = F.lit(0).cast("long")
    kept = row(*(col(n) for n in names[:8]), none, none, none, none)
    to_before = row(col("pc"), col("pa"), none, none, none, none, col("w1"), col("w2"), col("nc"), col("na"), none, none)
    to_after = row(col("nc"), col("na"), none, none, none, none, zero, zero, none, none, col("pc"), col("pa"))
    said = arcs.select(F.explode(F.when(_goes(level), F.array(to_before, to_after)).otherwise(F.array(kept))).alias("r")).select("r.*")
    met = said.groupBy("c", "a").agg(*((F.sum if n in ("w1", "w2") else F.max)(n).alias(n) for n in names[2:]))
    return met.select("c", "a", *(F.coalesce(new, old).alias(old) for old, new in (("nc", "mn"), ("na", "ma"), ("pc", "mp"), ("pa", "mb"))), "w1", "w2")


def _walk(batches):
    """c, a, s1, s2: sums from each arc to the tour's end, of the few arcs that are left."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    c, a, nc, na = (table.column(n).to_pylist() for n in ("c", "a", "nc", "na"))
    place = {key: i for i, key in enumerate(zip(c, a, strict=True))}
    after = [place.get(key, -1) for key in zip(nc, na, strict=True)]
    heads = set(range(len(c))).difference(after)
    order = []
    for at in heads:
        while at >= 0:
            order.append(at)
            at = after[at]
    order = np.array(order, dtype=np.int64)
    sums = []
    for name in ("w1", "w2"):
        total = np.zeros(len(c), dtype=np.int64)
        total[order] = np.cumsum(table.column(name).to_numpy()[order][::-1])[::-1]
        sums.append(pa.array(total))
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(a, pa.int64()), *sums], names=["c", "a", "s1", "s2"])


def ranked(arcs: DataFrame, small: int = SMALL) -> DataFrame:
    """c, a and s1, s2, the sums of weights from each arc of one list to its end."""
    levels = [arcs]
    while levels[-1].count() > small:
        levels.append(scratch(_contracted(levels[-1], len(levels)), "contracted"))
    known = scratch(levels[-1].select("c", "a", "nc", "na", "w1", "w2").coalesce(1).mapInArrow(_walk, "c long, a long, s1 long, s2 long"), "sums")
    for level in range(len(levels) - 1, 0, -1):
        gone = levels[level - 1].where(_goes(level)).select("c", "a", "nc", "na", "w1", "w2")
        after = known.select(F.col("c").alias("nc"), F.col("a").alias("na"), "s1", "s2")
        back = gone.join(after, ["nc", "na"]).select("c", "a", (F.col("w1") + F.col("s1")).alias("s1"), (F.col("w2") + F.col("s2")).alias("s2"))
        known = known.unionByName(scratch(back, "sums"))
    return known


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", small: int = SMALL) -> DataFrame:
    """A row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, lengths = rebuilt_turns(numbered_turns(conversations, conv, turn, role, text))
    prefixes = _named_prefixes(turns)
    nodes = _linked_nodes(prefixes, lengths)
    sums = ranked(_tour(nodes), small)
    sign = F.when(F.col("a") % 2 == 0, 1).otherwise(-1)
    below = sums.groupBy(F.col("c").alias("conv_id"), F.floor(F.col("a") / 2).alias("depth")).agg(F.sum(sign * F.col("s1")).alias("n_leaves"), F.sum(sign * F.col("s2")).alias("saved_tokens"))
    zero = F.lit(0).cast("long")
    at_root = lengths.where("length = 0").select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id")
    ends = _end_hashes(prefixes.where("last").select(*NODE, "conv_id").unionByName(at_root))
    out = nodes.join(below, ["conv_id", "depth"]).join(ends, NODE, "left")
    hashes = F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")
    return out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", hashes)
