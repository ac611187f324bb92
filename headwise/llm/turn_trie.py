"""Prefix trie of conversations, its subtrees summed up along an Euler tour.

A node is a distinct sequence of first turns (role, text). Conversations that start alike share its
path, and a text that several share need be processed once.

1. **Order.** Turns are sorted over the whole table into runs, and numbered within their conversation by
   counts of runs, so a conversation of any length is spread over tasks. A turn is kept as two 64-bit
   hashes of its role and text; a prefix as two running sums (exclusive or) of its turns, each hashed
   with its place.
2. **Nodes.** Prefixes are grouped by depth and sums; the prefix without the last turn names the parent.
3. **Tour.** Each node has an arc in and an arc out. The arc in is followed by that into the first child,
   else by the own arc out; the arc out by that into the next sibling, else by the parent's arc out.
   Siblings stand by their smallest member. The tour is a linked list; ``ordering.list_ranks`` gives
   each arc's place.
4. **Sums.** Arcs are sorted by place; what lies between a node's two arcs is its subtree, so running sums
   at them give its leaves and its savings.

No node's children or members are gathered: siblings are linked in sorted runs, and the ids of the
conversations that end at a node are joined to one string for each run before they are hashed in order.
That hash is sequential by its definition: the strings of one node go through one task, one at a time.

Turns are ordered by ``turn`` (null first), then by role and text, so equal turns have a defined order;
repeated rows are turns of their own. Null role or text is empty. Rows without a conversation id, or
with one that is no whole number, take no part. No conversation: no node. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .ordering import following, in_order, list_ranks, running

KEY = ["depth", "p1", "p2"]


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Stored (conv, place, chars, c1, c2, part, seq): the turns of each conversation, numbered from 1."""
    rows = conversations.select(
        F.col(conv_col).try_cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("role", role_col), ("text", text_col))],
    ).where("conv is not null")
    rows = rows.select("*", F.length("text").cast("long").alias("chars"), F.xxhash64("role", "text").alias("c1"), F.xxhash64(F.lit(3), "text", "role").alias("c2"))
    rows = in_order(rows, ["conv", "turn", "role", "text"], "turns", drop=("turn", "role", "text"))
    return stored(running(rows, ["conv"], F.sum, lambda a, b: a + b, place=F.lit(1).cast("long")), "numbered")


def with_heads_of(turns: DataFrame, base: Column, shared: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) where the first turns of each come from another conversation.

    base and shared: of column ``conv``, the other conversation and how many turns it gives, at most
    ``most``; the own turns after as many follow. Turns as :func:`numbered_turns` gives them.
    """
    convs = turns.select("conv").distinct().select("conv", base.alias("base"), shared.cast("long").alias("shared"))
    bases = convs.select(F.col("base").alias("conv")).distinct()
    heads = stored(turns.where(F.col("place") <= most).join(bases, "conv", "left_semi").select(F.col("conv").alias("base"), "place", "chars", "c1", "c2"), "heads")
    longest = heads.groupBy("base").agg(F.max("place").alias("longest"))
    given = F.least(F.col("shared"), F.coalesce("longest", F.lit(0)))
    convs = stored(convs.join(longest, "base", "left").select("conv", "base", "shared", given.alias("given")), "convs")
    first = convs.join(heads, "base").where(F.col("place") <= F.col("given"))
    first = first.select("conv", "place", "chars", "c1", "c2", F.lit(-1).alias("part"), F.col("place").alias("seq"))
    own = turns.where(F.col("place") > shared).join(convs.select("conv", "shared", "given"), "conv")
    own = own.withColumn("place", F.col("place") - F.col("shared") + F.col("given")).select(*first.columns)
    return first.union(own), convs.select("conv")


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256): of the ids of the conversations that end at each node, ascending."""
    rows = in_order(ends, [*KEY, "conv"], "ends")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    texts = rows.groupBy(*KEY, "part").agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, hashlib.sha256()

        def given(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.string())], [*KEY, "ends_sha256"])

        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if key == at:
                    digest.update(b",")
                else:
                    if at is not None:
                        out.append((*at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield given(out)
        if at is not None:
            yield given([(*at, digest.hexdigest())])

    return texts.repartition(*KEY).sortWithinPartitions(*KEY, "part").select(*KEY, "ids").mapInArrow(run, "depth long, p1 long, p2 long, ends_sha256 string")


def _tour(nodes: DataFrame, small: int) -> DataFrame:
    """(id, n_children, n_leaves, saved_tokens) of nodes (id, parent, conv_id, saved); the root's parent is null."""
    kids = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"), F.min(F.struct("conv_id", "id"))["id"].alias("first"), F.max(F.struct("conv_id", "id"))["id"].alias("last"))
    order = following(in_order(nodes.where("parent is not null").select("parent", "conv_id", "id"), ["parent", "conv_id"], "siblings"), "parent", "id")
    order = stored(order.select("id", F.col("next").alias("sibling")), "siblings")
    elder = order.where("sibling is not null").select(F.col("sibling").alias("id"), F.col("id").alias("elder"))
    tree = nodes.select("id", "parent", "saved").join(kids.withColumnRenamed("parent", "id"), "id", "left").join(order, "id", "left").join(elder, "id", "left")
    tree = stored(tree.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "tree")
    into = lambda c: F.col(c) * 2
    out_of = lambda c: F.col(c) * 2 + 1
    enter = tree.select(into("id").alias("item"), F.coalesce(out_of("elder"), into("parent")).alias("prev"), F.coalesce(into("first"), out_of("id")).alias("next"))
    leave = tree.select(out_of("id").alias("item"), F.coalesce(out_of("last"), into("id")).alias("prev"), F.coalesce(into("sibling"), out_of("parent")).alias("next"))
    ranks = list_ranks(enter.union(leave).withColumn("hop", F.lit(1).cast("long")), small)
    # Fewer arcs to the end: a later place.
    arcs = ranks.select((-F.col("rest")).alias("place"), F.shiftright("item", 1).alias("id"), (F.col("item") % 2 == 0).alias("enters"))
    arcs = arcs.join(tree.select("id", "saved", (F.col("n_children") == 0).cast("long").alias("leaf")), "id")
    weight = lambda c: F.when(F.col("enters"), F.col(c)).otherwise(F.lit(0))
    arcs = in_order(arcs.select("place", "id", "enters", weight("leaf").alias("leaf"), weight("saved").alias("saved")), ["place"], "arcs")
    sums = running(arcs, [], F.sum, lambda a, b: a + b, leaves=F.col("leaf"), savings=F.col("saved"))
    # Up to the arc out, without what came before the arc in.
    span = lambda total, own: F.sum(F.when(F.col("enters"), F.col(own) - F.col(total)).otherwise(F.col(total)))
    totals = sums.groupBy("id").agg(span("leaves", "leaf").alias("n_leaves"), span("savings", "saved").alias("saved_tokens"))
    return tree.select("id", "n_children").join(totals, "id")


def prefix_trie(turns: DataFrame, convs: DataFrame, small: int = 1 << 15) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (conv, place, chars, c1, c2, part, seq), places from 1 without gaps and ascending with part and
    seq; convs: (conv), each once, those without turns included. conv_id: the node's smallest
    conversation; saved_tokens: code points of last texts that need not be processed again.
    """
    steps = turns.select("conv", "part", "seq", F.col("place").alias("depth"), "chars", F.xxhash64("place", "c1", "c2").alias("x1"), F.xxhash64(F.lit(5), "c2", "place", "c1").alias("x2"))
    sums = running(steps, ["conv"], F.bit_xor, lambda a, b: a.bitwiseXOR(b), p1=F.col("x1"), p2=F.col("x2"))
    paths = stored(sums.select("conv", *KEY, "chars", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2")), "paths")
    top = convs.select("conv", *[F.lit(0).cast("long").alias(c) for c in KEY])
    found = paths.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), *[F.max(c).alias(c) for c in ("chars", "q1", "q2")])
    root = top.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).select("*", F.lit(0).cast("long").alias("chars"), *[F.lit(None).cast("long").alias(c) for c in ("q1", "q2")])
    nodes = in_order(root.union(found), ["conv_id", "depth"], "nodes").withColumnRenamed("seq", "id").drop("part")
    above = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").join(above, ["depth", "q1", "q2"])
    base = nodes.where("depth = 0").select("id", "conv_id").first()  # one row, or none
    at = [F.lit(x).cast("long") for x in (base or (None, None))]
    low = nodes.where("depth <= 1").select("*", *[F.when(F.col("depth") == 1, x).alias(c) for x, c in zip(at, ("parent", "parent_conv_id"))])
    nodes = stored(low.unionByName(deep), "nodes").withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
    last = paths.select("conv", *KEY).union(top).groupBy("conv").agg(F.max(F.struct(*KEY)).alias("last")).select("conv", "last.*")
    none = hashlib.sha256().hexdigest()
    out = nodes.join(_tour(nodes, small), "id").join(_digests(last), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
