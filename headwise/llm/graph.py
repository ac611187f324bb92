"""Links between similar sets in common buckets, and connected components, as Spark joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, slices, stored

#: Gives the distinct shingle hashes, ascending, of each text of a column.
Shingler = Callable[[pa.Array], list[np.ndarray]]


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one root that hangs on nothing."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
    return odd.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long), root the smallest node reachable.

    Alternating large and small stars: each round hangs every node's neighbours on its smallest
    one, until each node hangs on a root; the number of rounds grows with the logarithm of a
    component. Each round is written to the shared folder. No group of neighbours is ever
    gathered: a round takes a minimum for each node and joins it back.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(edges):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        older, edges = edges, stored(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(older)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def similar(pairs: DataFrame, texts: DataFrame, shingler: Shingler, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets have ``den * |A & B| >= num * |A | B|``.

    Texts travel to their pairs, being smaller than their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x"):
            keep = []
            for x, y in zip(shingler(batch.column("x")), shingler(batch.column("y"))):
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) * den >= max(len(x), len(y)) * num else 0
                keep.append(both * den >= (len(x) + len(y) - both) * num)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _least_common(x: Column, y: Column, num: int, den: int) -> Column:
    """Common elements that sets of these sizes need."""
    return F.ceil((x + y) * num / (num + den))


#: Gives (node, n, w0, w1, ...) of the nodes in a stored one-column table: the size and the words of parity bits of each one's set.
Sketcher = Callable[[DataFrame], DataFrame]
#: 64-bit words of a set's parity bits.
WORDS = 8
#: Nodes of a bucket that may be compared with each other; larger ones take the prefix filter.
FEW = 64


def parity(hashes: np.ndarray) -> np.ndarray:
    """Bit i tells whether an odd number of ``hashes`` falls in place i; of two sets the common ones cancel out."""
    return np.packbits(np.bincount((hashes & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS).astype(np.uint8) & 1).view(np.int64)


def _words() -> list[str]:
    return [f"w{k}" for k in range(WORDS)]


#: Columns of a sketch.
SKETCH = ", ".join(f"{c} long" for c in ("node", "n", *_words()))


def ends_of(pairs: DataFrame) -> DataFrame:
    """(node): each end of the pairs (a, b) once."""
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _near_enough(num: int, den: int) -> Column:
    """Whether sets x and y can be similar by size and parity bits; never false for a pair that is.

    They differ in at least as many elements as their bits do, and similar ones in at most
    ``(den - num) / (den + num)`` of their sizes together."""
    apart = F.bit_count(F.col("x_w0").bitwiseXOR(F.col("y_w0")))
    for w in _words()[1:]:
        apart = apart + F.bit_count(F.col(f"x_{w}").bitwiseXOR(F.col(f"y_{w}")))
    return apart * (den + num) <= (F.col("x_n") + F.col("y_n")) * (den - num)


def _side(prefix: str, key: str) -> list[Column]:
    return [F.col("node").alias(key), *(F.col(c).alias(f"{prefix}_{c}") for c in ("n", *_words()))]


def _common_shingles(texts: DataFrame, shingler: Shingler, limit: int) -> dict[int, int]:
    """Counts of the shingles of many texts; where they are too many, of the commonest among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found, n = np.unique(np.concatenate(shingler(batch.column("text"))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["shingle", "n"])

    counts = texts.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > 16)
    counts = stored(counts, "common")
    # Powers of two from 16 on: the least above which at most ``limit`` shingles stay.
    sizes = counts.groupBy(F.floor(F.log2("n")).alias("size")).count().orderBy(F.desc("size")).collect()
    least, total = 62, 0
    for size, n in sizes:
        total += n
        if total > limit:
            break
        least = size
    common = {r["shingle"]: r["n"] for r in counts.where(F.col("n") >= 2 ** int(least)).collect()}
    discard(counts)
    return common


def _by_rare_shingles(texts: DataFrame, roots: DataFrame, shingler: Shingler, num: int, den: int, bits: bool = False, limit: int = 200_000) -> DataFrame:
    """Pairs (a, b) with different roots that can be similar, by the exact prefix filter.

    With all sets' shingles in one order, two similar sets share one among the first
    ``n - ceil(n * num / den) + 1`` of both, and from the first that they share enough must be left
    in both. Any order gives the same pairs in the end; the one used puts common shingles last, by the
    counts of at most ``limit`` of them. With ``bits`` a row holds the parity bits of its set, so pairs that these
    rule out are never made.
    """
    common = _common_shingles(texts, shingler, limit)
    names = np.array(sorted(common), dtype=np.int64)
    weights = np.array([common[k] for k in names.tolist()], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for node, root, own in zip(batch.column("node").to_pylist(), batch.column("root").to_pylist(), shingler(batch.column("text"))):
                own = own.view(np.int64)
                n = len(own)
                count = np.zeros(n, dtype=np.int64)
                if len(names):
                    at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                    count = np.where(names[at] == own, weights[at], 0)
                head = np.lexsort((own, count))[: n - -(-n * num // den) + 1]
                row = [node, n, *(parity(own.view(np.uint64)) if bits else ()), root]
                out.append((*(np.full(len(head), c) for c in row), own[head], np.arange(1, len(head) + 1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], [*names_of, "shingle", "at"])

    names_of = ["node", "n", *(_words() if bits else ()), "root"]
    # Roots are joined to the texts, which are fewer than their shingles.
    rooted = texts.join(roots, "node", "left").select("node", "text", F.coalesce("root", "node").alias("root"))
    head = rooted.mapInArrow(run, ", ".join(f"{c} long" for c in [*names_of, "shingle", "at"]))
    x = head.select("shingle", *(F.col(c).alias(f"x_{c}") for c in [*names_of, "at"]))
    y = head.select("shingle", *(F.col(c).alias(f"y_{c}") for c in [*names_of, "at"]))
    left = 1 + F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    able = (F.col("x_node") < F.col("y_node")) & (F.col("x_root") != F.col("y_root")) & (left >= _least_common(F.col("x_n"), F.col("y_n"), num, den))
    if bits:
        able = able & _near_enough(num, den)
    return x.join(y, "shingle").where(able).select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()


def _by_buckets(held: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of a common bucket with different roots that sizes and parity bits leave open.

    held: (bucket, node, root) of buckets of few nodes."""
    rows = held.join(sketches, "node").select("bucket", "root", "node", "n", *_words())
    x = rows.select("bucket", F.col("root").alias("x_root"), *_side("x", "a"))
    y = rows.select("bucket", F.col("root").alias("y_root"), *_side("y", "b"))
    return x.join(y, "bucket").where((F.col("a") < F.col("b")) & (F.col("x_root") != F.col("y_root")) & _near_enough(num, den)).select("a", "b").distinct()


def linked(members: DataFrame | list[DataFrame], texts_of: Callable[[DataFrame], DataFrame], shingler: Shingler, num: int, den: int, sketches_of: Sketcher | None = None) -> DataFrame:
    """(node, root) of the components that confirmed links make; nodes without a link are absent.

    members: (bucket, node), both long, repeated or not; a list of them, of which none has a bucket of
    another, is dealt to its buckets one after another. ``texts_of`` gives (node, text) of the nodes in a stored
    one-column table. In each bucket the smallest node is the centre of a star, so a bucket of n
    nodes gives n - 1 candidate pairs. A bucket whose nodes then lie in several components may hold
    a link that its star did not touch: the nodes of such buckets are compared again, exactly,
    where the prefix filter leaves it open and their components differ. With ``sketches_of``, which pays for
    sets of up to a thousand elements or so, texts are asked for only of pairs that parity bits leave open, and
    buckets of up to FEW nodes are compared by their bits alone, so no node meets more than that many.
    """
    w = W.partitionBy("bucket")
    dealt = []
    for part in members if isinstance(members, list) else [members]:
        part = part.select("bucket", "node", F.min("node").over(w).alias("centre"), F.max("node").over(w).alias("last"))
        dealt.append(stored(part.where("centre <> last").select("bucket", "node", "centre"), "buckets"))
    shared = reduce(DataFrame.union, dealt)
    tried = stored(shared.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    nodes = stored(shared.select("node").distinct(), "nodes")
    few = sketches_of is not None
    used = [*dealt, tried, nodes]
    if few:
        sketches = stored(sketches_of(nodes), "sketches")
        used.append(sketches)
        both = tried.join(sketches.select(*_side("x", "a")), "a").join(sketches.select(*_side("y", "b")), "b")
        first = stored(both.where(_near_enough(num, den)).select("a", "b"), "near")
        nodes = stored(ends_of(first), "nodes")
    else:
        first = tried
    texts = stored(texts_of(nodes), "texts")
    roots = components(similar(first, texts, shingler, num, den))
    if few:
        discard(first, nodes, texts)
    held = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = held.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("n > 2 and low <> high")
    mixed = stored(mixed.select("bucket", "n"), "mixed")
    large = mixed.where(F.col("n") > FEW) if few else mixed
    open_ = stored(shared.join(large.select("bucket"), "bucket", "left_semi").select("node").distinct(), "open")
    rest = stored(texts_of(open_) if few else texts.join(open_, "node", "left_semi"), "rest")
    pairs = _by_rare_shingles(rest, roots, shingler, num, den, few)
    if few:
        small = held.join(mixed.where(F.col("n") <= FEW).select("bucket"), "bucket", "left_semi")
        # Written one after the other, so that what is shuffled for one leaves the disk before the other.
        both = [stored(pairs, "rare"), stored(_by_buckets(small, sketches, num, den), "few")]
        pairs = both[0].union(both[1]).distinct()
        used += both
    pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    discard(*used, mixed, open_, rest)
    if few:
        nodes = stored(ends_of(pairs), "nodes")
        texts = stored(texts_of(nodes), "texts")
        discard(nodes)
    more = similar(pairs, texts, shingler, num, den)
    # New links join components as wholes.
    ends = more.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    ends = stored(ends.select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")), "links")
    discard(pairs, texts)
    if ends.isEmpty():
        discard(ends)
        return roots
    joint = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    every = roots.union(ends.select(F.col("a").alias("node"), F.col("ra").alias("root"))).union(ends.select("b", "rb")).distinct()
    return every.join(joint, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
