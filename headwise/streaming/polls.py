"""Structured Streaming over the poll archive.

A micro-batch costs what it holds: it is decoded, matched and folded to states of
visits and hours (:func:`headwise.operators.collapse.states`), which are written as one run of the
``states`` table (:mod:`.runs`). No batch folds earlier predictions again. Observations are the merged
states, and in any order of batches, however late a poll comes, they are those of one batch over
the whole archive: there is no watermark. :func:`publish` writes them out for given days.

Doing a batch twice changes nothing: each table is partitioned by the batch number and a repeated
batch replaces its own rows as a whole, also where a timetable loaded meanwhile gives them other
dates. Polls seen in an earlier batch (a replayed shard) are dropped by an anti-join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .. import schemas
from ..functions import constants as k
from ..functions import times
from ..operators import collapse, flatten, match
from ..schemas import VISIT_KEY
from ..sources import archive, decode, tables
from .runs import RunTable


@dataclass(frozen=True)
class Store:
    """Where a stream keeps its tables."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def states(self) -> RunTable:
        return RunTable(self.path("states"), "service_date", collapse.merged)


def state_schema(spark: SparkSession) -> StructType:
    return collapse.states(spark.createDataFrame([], schemas.PREDICTIONS)).schema


def new_polls(batch: DataFrame, store: Store, batch_id: int) -> DataFrame:
    """Polls of this batch, once each, that no earlier batch has stored."""
    spark = batch.sparkSession
    once = batch.dropDuplicates(["feed", "fetched_at"]).withColumn("poll_date", F.to_date("fetched_at"))
    if not tables.exists(spark, store.path("polls")):
        return once
    # Only the days of the batch are read: a few values, one for each day that it holds.
    days = [row.poll_date for row in once.select("poll_date").distinct().collect()]
    known = spark.read.parquet(store.path("polls")).filter(F.col("poll_date").isin(days) & (F.col("batch") < batch_id))
    return once.join(known.select("poll_date", "feed", "fetched_at"), ["poll_date", "feed", "fetched_at"], "left_anti")


def ingest_batch(
    batch: DataFrame,
    batch_id: int,
    store: Store,
    timetable: match.Timetable | Callable[[], match.Timetable],
    tz: str,
    feeds_decoded: tuple[str, ...] = ("trips",),
) -> None:
    """Decode, match, fold and store one micro-batch.

    Polls of other feeds are recorded as fetched and not decoded. A timetable given as a function
    is asked for in each batch, so a version loaded meanwhile is seen.
    """
    spark = batch.sparkSession
    timetable = timetable() if callable(timetable) else timetable
    fresh = new_polls(batch, store, batch_id)
    # Decoded once into a table: everything below reads it, and a lost executor costs no re-decoding.
    wanted = fresh.filter(F.col("feed").isin(*feeds_decoded))
    tables.replace_partition(decode.decode_polls(wanted), store.path("decoded"), {"batch": batch_id})
    decoded = _batch_of(spark, store, "decoded", batch_id)
    if decoded is None:
        decoded = spark.createDataFrame([], schemas.DECODED)

    feeds = decode.good_feeds(decoded)
    tables.replace_partition(decode.quarantine(decoded), store.path("quarantine"), {"batch": batch_id})

    rows = match.predictions(flatten.trip_updates(feeds), timetable, tz)
    fold(rows, store, batch_id)
    new = new_visits(spark, store, batch_id)
    metrics = poll_metrics(feeds, timetable, tz).join(new, "poll_id", "left").fillna(0, ["rows_changed"])
    tables.replace_partition(metrics, store.path("metrics"), {"batch": batch_id})

    runs = poll_runs(fresh, decoded, _batch_of(spark, store, "metrics", batch_id)).withColumn("batch", F.lit(batch_id))
    tables.replace_partitions(
        runs.withColumn("run_date", F.to_date("started_at")), store.path("ingest_runs"), ["run_date", "batch"]
    )
    polls = fresh.select("feed", "fetched_at", "poll_date").withColumn("batch", F.lit(batch_id))
    tables.replace_partitions(polls, store.path("polls"), ["poll_date", "batch"])
    # The newest batch may yet be repeated; those before it may not.
    store.states.compact(spark, state_schema(spark), batch_id)


def fold(predictions: DataFrame, store: Store, batch_id: int) -> None:
    """Write a batch of predictions as states of its own; those of other batches are not read."""
    rows = collapse.states(predictions)
    store.states.put_batch(rows.select(*state_schema(predictions.sparkSession).names), batch_id)


def _batch_of(spark: SparkSession, store: Store, name: str, batch_id: int) -> DataFrame | None:
    where = f"{store.path(name)}/batch={batch_id}"
    if not tables.exists(spark, where):
        return None
    return spark.read.parquet(where)


def first_sightings(predictions: DataFrame) -> DataFrame:
    """(poll_id, rows_changed): how many visits each poll was the first to predict."""
    return _count_first(predictions.select(*VISIT_KEY, F.struct("observed_at", "fetched_at", "poll_id").alias("first")))


def _count_first(rows: DataFrame) -> DataFrame:
    firsts = rows.groupBy(*VISIT_KEY).agg(F.min("first").alias("first"))
    return firsts.groupBy(F.col("first.poll_id").alias("poll_id")).agg(F.count(F.lit(1)).alias("rows_changed"))


def new_visits(spark: SparkSession, store: Store, batch_id: int) -> DataFrame:
    """First sightings in a batch of visits that no earlier batch has predicted.

    Of the earlier batches only the keys are read, and of these only the days of this batch.
    """
    runs, schema = store.states.runs(spark), state_schema(spark)
    own = store.states.read(spark, schema, [r for r in runs if r.first == batch_id])
    days = [r.service_date for r in own.select("service_date").distinct().collect()]  # one value a day
    earlier = store.states.read(spark, schema, [r for r in runs if r.last < batch_id])
    earlier = earlier.filter(F.col("service_date").isin(days)).select(*VISIT_KEY)
    seen = own.join(earlier, list(VISIT_KEY), "left_anti").select(*VISIT_KEY, F.col("seen")[0].alias("poll"))
    return _count_first(seen.select(*VISIT_KEY, F.struct("poll.observed_at", "poll.fetched_at", "poll.poll_id").alias("first")))


def ingest(
    spark: SparkSession,
    archive_path: str,
    store: Store,
    timetable: match.Timetable | Callable[[], match.Timetable],
    tz: str,
    *,
    max_files: int = 200,
    interval: str | None = None,
) -> StreamingQuery:
    """Start ingesting an archive: to its present end, or for ever every ``interval``."""
    polls = archive.stream_archive(spark, archive_path, max_files)
    writer = polls.writeStream.option("checkpointLocation", store.path("_checkpoint")).foreachBatch(
        lambda batch, batch_id: ingest_batch(batch, batch_id, store, timetable, tz)
    )
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()


def observations(spark: SparkSession, store: Store, days: Iterable[date] | None = None) -> DataFrame:
    """The visits of all batches so far, or those of some service dates; merged when read."""
    rows = store.states.read(spark, state_schema(spark))
    return collapse.visits(rows if days is None else rows.filter(F.col("service_date").isin(list(days))))


def publish(spark: SparkSession, store: Store, days: Iterable[date]) -> None:
    """Write the observations of some days as they stand, in place of those written before."""
    days = list(days)
    rows = observations(spark, store, days)
    layout = {"sort": ["route_id", "stop_id"], "emptied": [{"service_date": d} for d in days]}
    tables.replace_partitions(rows, store.path("observations"), ["service_date"], **layout)


# -- metrics ---------------------------------------------------------------------


def poll_metrics(feeds: DataFrame, timetable: match.Timetable, tz: str) -> DataFrame:
    """Per-poll counters: entities, transformation, vehicles."""
    return flatten.poll_counters(feeds).join(match.transform_stats(feeds, timetable, tz), "poll_id")


def poll_runs(polls: DataFrame, decoded: DataFrame, metrics: DataFrame | None) -> DataFrame:
    """The operational record of each poll, failed and undecoded ones included (ingest_runs).

    ``rows_changed`` counts the visits first seen in the poll; ``duration_ms`` is null, as the
    archive does not record how long a poll took.
    """
    base = polls.select(
        "feed", "fetched_at", "http_status", F.octet_length("payload").alias("payload_bytes"), "attempts"
    ).join(
        decoded.select("poll_id", "feed", "fetched_at", "header_ts", "error"), ["feed", "fetched_at"], "left"
    )
    counters = ("entity_total", "trip_updates", "rows_emitted", "skipped_no_data", "skipped_departure_only", "skipped_no_time", "rows_changed")
    if metrics is None:
        base = base.select("*", *[F.lit(None).cast("bigint").alias(c) for c in counters])
    else:
        base = base.join(metrics.select("poll_id", *counters), "poll_id", "left")
    read = F.col("poll_id").isNotNull() & F.col("error").isNull()
    base = base.withColumn("rows_changed", F.when(read, F.coalesce("rows_changed", F.lit(0))))
    return base.select(
        "feed",
        F.col("fetched_at").alias("started_at"),
        F.lit(None).cast("int").alias("duration_ms"),
        F.col("error").isNull().alias("ok"),
        "http_status",
        times.feed_age_s(F.col("fetched_at"), F.col("header_ts")).alias("feed_age_s"),
        F.col("header_ts").alias("feed_timestamp"),
        "payload_bytes",
        F.col("entity_total").cast("int").alias("entities_total"),
        F.col("trip_updates").cast("int").alias("entities_decoded"),
        F.col("rows_emitted").alias("rows_written"),
        "rows_changed",
        (F.col("skipped_no_data") + F.col("skipped_departure_only") + F.col("skipped_no_time")).alias("rows_skipped"),
        "attempts",
        "error",
    )


STATUS = "rows_last_poll bigint, vehicles_tracked bigint, total_rows bigint, last_poll_at timestamp"
#: The status as kept, with what a repeated batch of the ingestion needs: the newest batch counted, and the total before it.
KEPT_STATUS = f"{STATUS}, newest bigint, total_before bigint"
#: What the status needs of the stored metrics.
STATUS_METRICS = "poll_id string, fetched_at timestamp, rows_emitted bigint, vehicles_tracked bigint, rows_changed bigint, batch bigint"


def live_status(metrics: DataFrame, sightings: DataFrame | None = None, seed_total: int = 0) -> DataFrame:
    """One row: the last poll's rows and vehicles, its time, and the running total of visits.

    ``rows_changed`` of each poll comes with the metrics, as stored, or from ``sightings``.
    """
    last = F.max(F.struct("fetched_at", "rows_emitted", "vehicles_tracked"))
    polls = metrics if sightings is None else metrics.join(sightings.select("poll_id", "rows_changed"), "poll_id", "left")
    total = F.coalesce(F.sum("rows_changed"), F.lit(0)) + seed_total
    return polls.agg(last.alias("last"), total.alias("total_rows")).select(
        F.col("last.rows_emitted").alias("rows_last_poll"),
        F.col("last.vehicles_tracked").alias("vehicles_tracked"),
        "total_rows",
        F.col("last.fetched_at").alias("last_poll_at"),
    )


def _status_rows(spark: SparkSession, store: Store) -> list[int]:
    at = store.path("live_status")
    done = [n for n in tables.names(spark, at) if n.startswith("batch=") and tables.exists(spark, f"{at}/{n}/_SUCCESS")]
    return sorted(int(n[6:]) for n in done)


def push_status(batch: DataFrame, batch_id: int, store: Store, seed_total: int) -> None:
    """Make the status after one batch of metrics the current one.

    The total goes on from the row of the batch before, so no metrics are read twice, and a repeated
    batch writes the same row. Metrics that the ingestion wrote anew for its newest batch take the place
    of those counted. The last two rows are kept, the older for a batch that is repeated.
    """
    spark, at = batch.sparkSession, store.path("live_status")
    before = [n for n in _status_rows(spark, store) if n < batch_id]
    old = spark.read.schema(KEPT_STATUS).parquet(f"{at}/batch={before[-1]}") if before else spark.createDataFrame([(None, None, seed_total, None, None, seed_total)], KEPT_STATUS)
    old = old.select(F.struct("last_poll_at", "rows_last_poll", "vehicles_tracked").alias("last"), "newest", "total_rows", "total_before")
    # One row for each batch of the ingestion, then one in all; the earlier row joins as one more.
    ours = batch.groupBy("batch").agg(F.max(F.struct(F.col("fetched_at").alias("last_poll_at"), F.col("rows_emitted").alias("rows_last_poll"), "vehicles_tracked")).alias("last"), F.sum("rows_changed").alias("n"))
    every = ours.select("last", "batch", "n", *[F.lit(None).cast("bigint").alias(c) for c in ("newest", "total_rows", "total_before")]).union(
        old.select("last", F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), "newest", "total_rows", "total_before")
    )
    one = every.agg(
        F.max("last").alias("last"), F.max("newest").alias("counted"), F.max("total_rows").alias("total"), F.max("total_before").alias("base"),
        F.max("batch").alias("top"), F.collect_list(F.when(F.col("batch").isNotNull(), F.struct("batch", "n"))).alias("parts"),
    )
    again = F.exists("parts", lambda x: x["batch"] == F.col("counted"))
    start = F.when(again, F.col("base")).otherwise(F.col("total"))
    added = lambda test: F.aggregate(F.filter("parts", test), F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    top = F.greatest("counted", "top")
    out = one.select(
        "last.rows_last_poll", "last.vehicles_tracked", (start + added(lambda x: x["batch"].isNotNull())).alias("total_rows"), "last.last_poll_at",
        top.alias("newest"),
        F.when(F.col("top") < F.col("counted"), F.col("base") + added(lambda x: x["batch"].isNotNull()))
        .otherwise(start + added(lambda x: x["batch"] < F.col("top"))).alias("total_before"),
    )
    out.coalesce(1).write.mode("overwrite").parquet(f"{at}/batch={batch_id}")
    for n in before[:-1]:
        tables.delete(spark, f"{at}/batch={n}")


def follow_status(spark: SparkSession, store: Store, seed_total: int = 0, *, interval: str | None = f"{k.STATUS_PUSH_S} seconds") -> StreamingQuery:
    """Start a second stream, over the stored metrics, that renews the status at most once an ``interval``.

    seed_total: visits stored before the first batch (``dataset_summary`` has them); used once, as the
    stream keeps its total. Without an interval it runs to the present end.
    """
    metrics = spark.readStream.schema(STATUS_METRICS).option("ignoreMissingFiles", "true").parquet(store.path("metrics"))
    writer = metrics.writeStream.option("checkpointLocation", store.path("_status_checkpoint")).foreachBatch(
        lambda batch, batch_id: push_status(batch, batch_id, store, seed_total)
    )
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()


def current_status(spark: SparkSession, store: Store) -> DataFrame:
    """The row that :func:`follow_status` wrote last; none before its first batch."""
    rows = _status_rows(spark, store)
    if not rows:
        return spark.createDataFrame([], STATUS)
    return spark.read.schema(STATUS).parquet(f"{store.path('live_status')}/batch={rows[-1]}")


def poll_health(runs: DataFrame, watermark: str | None = None) -> DataFrame:
    """Polls, failures and bytes per feed and hour; works on a stream or a table.

    On a stream without a watermark (complete or update mode) every row counts, however late; the state
    is one row for each feed and hour. Append mode needs a watermark, and rows later than that are lost.
    """
    bounded = runs if watermark is None else runs.withWatermark("started_at", watermark)
    return (
        bounded.groupBy(F.window("started_at", "1 hour"), "feed")
        .agg(
            F.count(F.lit(1)).alias("polls"),
            F.count_if(~F.col("ok")).alias("fails"),
            F.sum("payload_bytes").alias("payload_bytes"),
        )
        .select(F.col("window.start").alias("hour"), "feed", "polls", "fails", "payload_bytes")
    )


# -- folding a stream of predictions ---------------------------------------------------


def follow_visits(predictions: DataFrame, store: Store, *, interval: str | None = None) -> StreamingQuery:
    """Fold a stream of predictions, late ones included, to states as they come; see :func:`observations`."""

    def run(batch: DataFrame, batch_id: int) -> None:
        fold(batch, store, batch_id)
        store.states.compact(batch.sparkSession, state_schema(batch.sparkSession), batch_id)

    writer = predictions.writeStream.option("checkpointLocation", store.path("_visits_checkpoint")).foreachBatch(run)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()
