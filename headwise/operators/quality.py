"""Comparison and verification of whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as k
from ..functions import predicates
from ..schemas import VISIT_KEY

COMPARED = ("observed_arrival", "delay_seconds", "scheduled_source", "route_id", "stop_id")


def settled(observations: DataFrame, as_of: Column, settled_s: int = k.SETTLED_S, date: Column | None = None) -> DataFrame:
    """Observations the feed has stopped reporting, optionally of one date."""
    rows = observations.filter(predicates.is_settled(F.col("last_seen_at"), as_of, settled_s))
    return rows if date is None else rows.filter(F.col("service_date") == date)


def table_diff(
    a: DataFrame, b: DataFrame, key: Sequence[str] = VISIT_KEY, tolerance_s: int = k.DIFF_TOLERANCE_S
) -> DataFrame:
    """Full outer comparison of two observation tables.

    ``status`` is only_a, only_b, match, within_tolerance or mismatch, and
    ``diffs`` names the columns that disagree. An arrival missing on one side
    disagrees; a missing delay counts as 0.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, F.struct(*COMPARED).alias(name))

    both = side(a, "a").join(side(b, "b"), list(key), "full_outer")
    arr_a, arr_b = F.col("a.observed_arrival"), F.col("b.observed_arrival")
    # Arrivals are compared at whole seconds.
    apart = F.abs(F.unix_seconds(arr_a) - F.unix_seconds(arr_b))
    same_arrival = F.unix_seconds(arr_a).eqNullSafe(F.unix_seconds(arr_b))
    delays = [F.coalesce(F.col(f"{s}.delay_seconds"), F.lit(0)) for s in "ab"]
    checks = {
        "observed_arrival": ~same_arrival & F.coalesce(apart > tolerance_s, F.lit(True)),
        "delay_seconds": F.abs(delays[0] - delays[1]) > tolerance_s,
        **{
            c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
            for c in ("scheduled_source", "route_id", "stop_id")
        },
    }
    labels = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))
    paired = F.col("a").isNotNull() & F.col("b").isNotNull()
    diffs = F.when(paired, labels).otherwise(F.array().cast("array<string>"))
    status = (
        F.when(F.col("b").isNull(), F.lit("only_a"))
        .when(F.col("a").isNull(), F.lit("only_b"))
        .when(F.size(labels) > 0, F.lit("mismatch"))
        .when(same_arrival, F.lit("match"))
        .otherwise(F.lit("within_tolerance"))
    )
    return both.select(*key, status.alias("status"), diffs.alias("diffs"), "a", "b")


def diff_summary(diff: DataFrame) -> DataFrame:
    """One row: counts per class and the share that agrees.

    ``matching`` includes rows that agree only within the tolerance.
    """
    def count(*names: str) -> Column:
        return F.count_if(F.col("status").isin(*names))

    total = F.count(F.lit(1))
    matching = count("match", "within_tolerance")
    agreement = F.when(total > 0, F.round(matching / total * 100, 4)).otherwise(F.lit(0.0))
    return diff.agg(
        matching.alias("matching"),
        count("within_tolerance").alias("within_tolerance"),
        count("mismatch").alias("mismatched"),
        count("only_a").alias("only_a"),
        count("only_b").alias("only_b"),
        agreement.alias("agreement_pct"),
    )


# -- copies -------------------------------------------------------------------


def snapshot_watermark(copy: DataFrame) -> DataFrame:
    """One row: the newest first_seen_at a copy contains (the epoch if empty)."""
    return copy.agg(F.coalesce(F.max("first_seen_at"), F.timestamp_seconds(F.lit(0))).alias("watermark"))


def up_to_watermark(source: DataFrame, copy: DataFrame) -> DataFrame:
    """Source rows the copy could have seen, by their first_seen_at."""
    return source.filter(F.col("first_seen_at") <= snapshot_watermark(copy).scalar())


def verify_counts(pairs: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Row counts of each (source, copy) pair and whether they match."""
    out = None
    for name, (source, copy) in pairs.items():
        sides = source.select(F.lit(1).alias("s"), F.lit(0).alias("c")).unionAll(copy.select(F.lit(0), F.lit(1)))
        row = sides.agg(
            F.lit(name).alias("table"),
            F.coalesce(F.sum("s"), F.lit(0)).alias("source_rows"),
            F.coalesce(F.sum("c"), F.lit(0)).alias("copy_rows"),
        )
        out = row if out is None else out.unionAll(row)
    return out.withColumn("match", F.col("source_rows") == F.col("copy_rows"))


def row_text(columns: Sequence[str | Column]) -> Column:
    """The columns as one text from which they can be told apart: null is not empty, and no value runs into the next."""
    parts = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def _row_sums(columns: Sequence[str | Column]) -> list[Column]:
    """Two sums of 60 bits of each row's digest: they add up in any order, over any grouping."""
    digest = F.md5(row_text(columns))
    return [F.coalesce(F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(28,0)")), F.lit(0).cast("decimal(38,0)")) for at in (1, 16)]


def content_checksum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Digest of the columns of all rows, in any order; 'empty' without rows."""
    high, low = _row_sums(columns)
    n = F.count(F.lit(1))
    return df.agg(
        F.when(n > 0, F.concat_ws("-", high.cast("string"), low.cast("string"))).otherwise(F.lit("empty")).alias("checksum"),
        n.alias("rows_checked"),
    )


def table_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free digest of all rows: count and two sums of row digests."""
    high, low = _row_sums(columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), high.cast("string").alias("high_sum"), low.cast("string").alias("low_sum"))


# -- digest tree --------------------------------------------------------------

#: Leaves of a digest tree, and children of each node above.
LEAVES, FANOUT = 1 << 14, 1 << 7


def key_bucket(key: Sequence[str], buckets: int = LEAVES) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def digest_leaves(df: DataFrame, key: Sequence[str], columns: Sequence[str | Column]) -> DataFrame:
    """(bucket, n, high, low): the order-free digest of the rows of each bucket of keys.

    Two 64-bit hashes of the values as they are, without a text of each row: leaves are only compared with
    each other. Hashes skip nulls, so each value goes in with whether it is one.
    """
    values = [part for c in columns for part in (F.isnull(c), F.col(c) if isinstance(c, str) else c)]
    hashed = df.select(key_bucket(key).alias("bucket"), *[F.xxhash64(F.lit(seed), *values).alias(name) for seed, name in enumerate(("high", "low"))])
    # Halves add up in longs to four billion rows a bucket.
    total = lambda c: F.sum(F.shiftright(c, 32)).cast("decimal(38,0)") * (1 << 32) + F.sum(F.col(c).bitwiseAND((1 << 32) - 1))
    return hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[total(c).cast("decimal(38,0)").alias(c) for c in ("high", "low")])


def differing_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Buckets whose leaves differ, found from the root down; a and b: stored :func:`digest_leaves`.

    Sums of leaves are the digests of the nodes above, so the tree needs no storing. Only children of
    nodes that differ are compared: equal tables end at the root.
    """
    def level(leaves: DataFrame, width: int) -> DataFrame:
        node = F.floor(F.col("bucket") / width).cast("int").alias("node")
        return leaves.groupBy(node).agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")])

    def unlike(width: int, of: DataFrame | None) -> DataFrame:
        sides = [level(s if of is None else s.join(of, F.floor(F.col("bucket") / (width * FANOUT)).cast("int") == F.col("above"), "left_semi"), width) for s in (a, b)]
        same = sides[0].select("*").intersect(sides[1])
        return sides[0].union(sides[1]).select("node").distinct().join(same.select("node"), "node", "left_anti")

    width, above = LEAVES, None
    while True:
        found = unlike(width, above)
        if width == 1 or found.isEmpty():
            return found.select(F.col("node").alias("bucket"))
        above, width = found.select(F.col("node").alias("above")), max(1, width // FANOUT)


def tree_diff(
    a: DataFrame, b: DataFrame, leaves: tuple[DataFrame, DataFrame], key: Sequence[str] = VISIT_KEY, tolerance_s: int = k.DIFF_TOLERANCE_S
) -> DataFrame:
    """:func:`table_diff` of the rows in buckets that differ; all other rows match.

    leaves: stored :func:`digest_leaves` of both tables over ``key`` and ``COMPARED``. The buckets are at most
    ``LEAVES`` numbers, so they go to every task and rows of equal buckets are left out where they are
    read: equal tables never reach the join.
    """
    found = F.broadcast(differing_buckets(*leaves))
    sides = [df.join(found, key_bucket(key) == F.col("bucket"), "left_semi") for df in (a, b)]
    return table_diff(*sides, key=key, tolerance_s=tolerance_s)


def tree_summary(diff: DataFrame, leaves: DataFrame) -> DataFrame:
    """:func:`diff_summary` of whole tables from a :func:`tree_diff` and the digests of the first."""
    names = ("mismatched", "only_a", "only_b")
    # Rows of ``a`` that the comparison did not reach are equal, so all count that neither differ nor stand alone.
    rows = leaves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    matching = rows - F.col("mismatched") - F.col("only_a")
    whole = diff_summary(diff).select(matching.alias("matching"), "within_tolerance", *names)
    total = F.col("matching") + F.col("mismatched") + F.col("only_a") + F.col("only_b")
    return whole.withColumn("agreement_pct", F.when(total > 0, F.round(F.col("matching") / total * 100, 4)).otherwise(F.lit(0.0)))
