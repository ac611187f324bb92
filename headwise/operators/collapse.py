"""Collapse: every prediction of a stop visit folded into one observation.

The fold depends on order (last arrival, number of changes), and one visit may
hold a large share of all predictions. It therefore runs in two steps. Each visit
is cut into time chunks; a chunk is folded to one partial row (one shuffle and
sort, shared by the window and the aggregation). The few partial rows of a visit
are then folded in chunk order, comparing the last arrival of a chunk with the
first of the next. No task ever sees a whole visit's predictions.

Where predictions come in batches of any order, each batch is folded to mergeable
states (:func:`states`): as a partial row, but with the list of its polls in place
of a count of changes, since a poll that comes later may fall between two earlier
ones. Lists of one visit and hour are joined and put in order when they are read
(:func:`merged`, :func:`visits`); a list holds at most the polls of an hour.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates
from ..schemas import VISIT_KEY

# Filled in by the last prediction that has a value, each on its own.
STICKY = ("vehicle_id", "scheduled_arrival", "scheduled_hour_local", "day_type", "feed_version_id")


def once_per_poll(predictions: DataFrame) -> DataFrame:
    """Drop repeats of a poll, so replays cannot inflate the counts."""
    return predictions.dropDuplicates(["poll_id", *VISIT_KEY])


def collapse(
    predictions: DataFrame,
    order: Sequence[str] = ("observed_at", "fetched_at"),
    chunk_s: int = 3600,
) -> DataFrame:
    """Fold predictions to one row per visit. ``order[0]`` is the event time."""
    at = F.struct(*order)
    chunk = F.floor(F.unix_seconds(order[0]) / chunk_s)
    keyed = predictions.withColumn("_chunk", chunk)

    steps = Window.partitionBy(*VISIT_KEY, "_chunk").orderBy(*order)
    moved = F.lag("observed_arrival").over(steps) != F.col("observed_arrival")
    partial = (
        keyed.withColumn("_moved", F.coalesce(moved.cast("int"), F.lit(0)))
        .groupBy(*VISIT_KEY, "_chunk")
        .agg(
            F.min(
                F.struct(at.alias("at"), "observed_arrival", "route_id", "stop_id", "scheduled_source")
            ).alias("first"),
            F.max(F.struct(at.alias("at"), "observed_arrival", "schedule_relationship")).alias("last"),
            F.min("observed_arrival").alias("min_predicted_arrival"),
            F.max("observed_arrival").alias("max_predicted_arrival"),
            F.sum("_moved").alias("moved"),
            F.count(F.lit(1)).alias("polls"),
            *[_latest(F.col(c), at).alias(f"s_{c}") for c in STICKY],
            _latest(F.when(F.col("scheduled_arrival").isNotNull(), F.col("scheduled_source")), at).alias("s_source"),
        )
    )

    return _visits(partial, "_chunk", order[0])


def _visits(partial: DataFrame, chunk: str, event_time: str) -> DataFrame:
    """Observations from one partial row for each visit and chunk."""
    visits = Window.partitionBy(*VISIT_KEY).orderBy(chunk)
    boundary = F.lag(F.col("last.observed_arrival")).over(visits) != F.col("first.observed_arrival")
    folded = (
        partial.withColumn("_boundary", F.coalesce(boundary.cast("int"), F.lit(0)))
        .groupBy(*VISIT_KEY)
        .agg(
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.min("min_predicted_arrival").alias("min_predicted_arrival"),
            F.max("max_predicted_arrival").alias("max_predicted_arrival"),
            F.sum(F.col("moved") + F.col("_boundary")).alias("change_count"),
            F.sum("polls").alias("poll_count"),
            *[F.max(f"s_{c}").alias(f"s_{c}") for c in STICKY],
            F.max("s_source").alias("s_source"),
        )
    )
    return folded.select(
        *VISIT_KEY,
        F.col("first.route_id").alias("route_id"),
        F.col("first.stop_id").alias("stop_id"),
        *[F.col(f"s_{c}")["value"].alias(c) for c in STICKY],
        F.coalesce(F.col("s_source")["value"], F.col("first.scheduled_source")).alias("scheduled_source"),
        F.col("last.observed_arrival").alias("observed_arrival"),
        F.col("first.observed_arrival").alias("first_predicted_arrival"),
        "min_predicted_arrival",
        "max_predicted_arrival",
        "change_count",
        "poll_count",
        F.col("first.at")[event_time].alias("first_seen_at"),
        F.col("last.at")[event_time].alias("last_seen_at"),
        F.col("last.schedule_relationship").alias("schedule_relationship"),
        predicates.delay_seconds(F.col("last.observed_arrival"), F.col("s_scheduled_arrival")["value"]).alias(
            "delay_seconds"
        ),
    )


ORDER = ("observed_at", "fetched_at")
STATE_KEY = (*VISIT_KEY, "chunk")


def states(predictions: DataFrame, chunk_s: int = 3600) -> DataFrame:
    """One mergeable row for each visit and chunk: ``STATE_KEY``, extremes, latest values, polls in order.

    A poll counts once, however often its rows stand here or in other states.
    """
    at = F.struct(*ORDER)
    chunk = F.floor(F.unix_seconds("observed_at") / chunk_s).alias("chunk")
    return predictions.groupBy(*VISIT_KEY, chunk).agg(
        F.min(F.struct(at.alias("at"), "observed_arrival", "route_id", "stop_id", "scheduled_source")).alias("first"),
        F.max(F.struct(at.alias("at"), "observed_arrival", "schedule_relationship")).alias("last"),
        F.min("observed_arrival").alias("min_predicted_arrival"),
        F.max("observed_arrival").alias("max_predicted_arrival"),
        *[_latest(F.col(c), at).alias(f"s_{c}") for c in STICKY],
        _latest(F.when(F.col("scheduled_arrival").isNotNull(), F.col("scheduled_source")), at).alias("s_source"),
        F.array_sort(F.collect_set(F.struct(*ORDER, "poll_id", "observed_arrival"))).alias("seen"),
    )


def merged(rows: DataFrame) -> DataFrame:
    """States of any batches, one row left for each visit and chunk; in any order and any grouping the same."""
    return rows.groupBy(*STATE_KEY).agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.min("min_predicted_arrival").alias("min_predicted_arrival"),
        F.max("max_predicted_arrival").alias("max_predicted_arrival"),
        *[F.max(f"s_{c}").alias(f"s_{c}") for c in (*STICKY, "source")],
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("seen"),
    )


def visits(rows: DataFrame) -> DataFrame:
    """Observations from states of any batches, as :func:`collapse` gives them from all predictions."""
    n = F.size("seen")
    steps = F.zip_with(F.slice("seen", 1, n - 1), F.slice("seen", 2, n - 1), lambda a, b: a["observed_arrival"] != b["observed_arrival"])
    partial = merged(rows).withColumn("moved", F.size(F.filter(steps, lambda x: x)).cast("long")).withColumn("polls", n.cast("long"))
    return _visits(partial, "chunk", "observed_at")


def _latest(value: Column, at: Column) -> Column:
    """Latest non-null value with its position, so that partial results merge."""
    return F.max(F.when(value.isNotNull(), F.struct(at.alias("at"), value.alias("value"))))


def change_counts(predictions: DataFrame, order: Sequence[str] = ("observed_at", "fetched_at"), chunk_s: int = 3600) -> DataFrame:
    """How often each visit's prediction moved."""
    return collapse(predictions, order, chunk_s).select(*VISIT_KEY, "change_count", "poll_count")


def write_summary(observations: DataFrame) -> DataFrame:
    """One row: visits written, visits seen once, visits whose prediction moved."""
    return observations.agg(
        F.count(F.lit(1)).alias("rows_written"),
        F.count_if(F.col("poll_count") == 1).alias("rows_inserted"),
        F.count_if(F.col("change_count") > 0).alias("rows_with_changes"),
    )
