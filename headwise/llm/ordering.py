"""Global order without a global task: sorted runs, running values over them, ranks of linked lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Linked items that one task ranks.
SMALL = 1 << 15


def in_order(df: DataFrame, keys: list[str], label: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Stored rows sorted by ``keys`` (null first), with ``part``, their run, and ``seq``, ascending over all runs.

    Runs are ranges of the keys. Rows equal in all of them may stand in several runs, in any order, so
    that no run grows with a repeated key.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    rows = tied.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie", *drop)
    rows = rows.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id())
    return stored(rows, label)


def running(rows: DataFrame, by: list[str], total, join, **values: Column) -> DataFrame:
    """Add the running ``total`` (F.sum or F.bit_xor) of each value within ``by``, own row included.

    rows: as ``in_order`` gives them. Runs are totalled by themselves; what stood before a run comes from
    one row for each run and group. ``join`` puts two totals together.
    """
    within = W.partitionBy(*by, "part").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = rows.groupBy(*by, "part").agg(*[total(v).alias(f"_{k}") for k, v in values.items()])
    runs = runs.select(*by, "part", *[F.coalesce(total(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in values])
    own = rows.select("*", *[total(v).over(within).alias(k) for k, v in values.items()])
    return own.join(runs, [*by, "part"]).select(*rows.columns, *[join(F.col(k), F.col(f"_{k}")).alias(k) for k in values])


def following(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Add ``next``: ``value`` of the next row with the same ``by``; rows: in order of ``by`` first.

    Looks ahead within a run; the last row of a run looks at the first of the next one.
    """
    within = W.partitionBy("part").orderBy("seq")
    firsts = rows.groupBy("part").agg(F.min(F.struct("seq", by, value)).alias("first"))
    firsts = firsts.select("part", F.lead("first").over(W.orderBy("part")).alias("_first"))  # one row a run
    ahead = F.coalesce(F.lead(F.struct("seq", by, value)).over(within), F.col("_first"))
    out = rows.join(firsts, "part").withColumn("_ahead", ahead)
    return out.select(*rows.columns, F.when(F.col(f"_ahead.{by}") == F.col(by), F.col(f"_ahead.{value}")).alias("next"))


def _rank_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = list(batches)
    item, after, hop = (np.concatenate([b.column(c).fill_null(-1).to_numpy() for b in rows] or [np.zeros(0, np.int64)]) for c in ("item", "next", "hop"))
    order = np.argsort(item)
    item, after, n = item[order], after[order], len(item)
    rest = np.append(hop[order], 0)
    at = np.append(np.where(after < 0, n, np.searchsorted(item, after)), n)
    while (at < n).any():
        rest, at = rest + rest[at], at[at]
    yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(rest[:-1])], ["item", "rest"])


def list_ranks(links: DataFrame, small: int = SMALL) -> DataFrame:
    """(item, rest): hops from each item of linked lists to beyond the end of its list.

    links: (item, prev, next, hop), all long and not negative; prev and next null at the ends. While more than ``small``
    items are left, those whose hash is above both neighbours' are taken out, about a third, and
    their neighbours linked; no two of them are neighbours. What is left is ranked by pointer jumping,
    and those taken out get theirs from the item that followed them, last round first. All rounds
    together touch three times the items.
    """
    taken: list[DataFrame] = []
    level = stored(links.select("item", "prev", "next", "hop"), "links")
    while level.count() > small:
        of = lambda c: F.xxhash64(F.lit(len(taken)), F.col(c))  # noqa: B023, E731
        above = (of("item") > of("prev")) & (F.col("next").isNull() | (of("item") > of("next")))
        out = F.col("prev").isNotNull() & above
        gone, kept = level.where(out), level.where(~out)
        after = gone.select(F.col("item").alias("next"), F.col("next").alias("_next"), F.col("hop").alias("_hop"))
        ahead = gone.select(F.col("item").alias("prev"), F.col("prev").alias("_prev"))
        kept = kept.join(after, "next", "left").join(ahead, "prev", "left")
        kept = kept.select(
            "item",
            F.coalesce("_prev", "prev").alias("prev"),
            F.when(F.col("_hop").isNotNull(), F.col("_next")).otherwise(F.col("next")).alias("next"),
            (F.col("hop") + F.coalesce("_hop", F.lit(0))).alias("hop"),
        )
        taken.append(gone)
        level = stored(kept, "links")
    ranks = stored(level.select("item", "next", "hop").coalesce(1).mapInArrow(_rank_small, "item long, rest long"), "ranked")
    for gone in reversed(taken):
        follow = ranks.select(F.col("item").alias("next"), F.col("rest").alias("_rest"))
        found = gone.join(follow, "next", "left").select("item", (F.col("hop") + F.coalesce("_rest", F.lit(0))).alias("rest"))
        ranks = stored(ranks.union(found), "ranked")
    return ranks
