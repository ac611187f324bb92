"""Queries: the streaming operators, each run to the end of its input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import prepare, scratch_path
from ..sources import archive
from ..streaming import polls
from . import standins as v
from .catalog import query
from .oracle import with_
from .queries_feed import POLL_US
from .queries_sources import D

# The fold of the nested feed's predictions.
_FOLDED = (
    with_("ranked")
    + """, rows AS (SELECT *, """
    + POLL_US
    + """ AS fetched_us FROM ranked WHERE rn = 1),
    moved AS (SELECT *, CASE WHEN lag(arrival_s) OVER (PARTITION BY service_date, trip_id, stop_sequence, is_modified ORDER BY header_s, fetched_us) <> arrival_s
        THEN 1 ELSE 0 END AS m FROM rows),
    folded AS (SELECT service_date, trip_id, stop_sequence, is_modified,
      last(arrival_s ORDER BY header_s, fetched_us) * 1000000 AS observed_arrival,
      min(arrival_s) * 1000000 AS min_predicted_arrival, max(arrival_s) * 1000000 AS max_predicted_arrival,
      CAST(sum(m) AS BIGINT) AS change_count, count(*) AS poll_count,
      min(header_s) * 1000000 AS first_seen_at, max(header_s) * 1000000 AS last_seen_at,
      last(vehicle_id ORDER BY header_s, fetched_us) FILTER (WHERE vehicle_id IS NOT NULL) AS vehicle_id,
      last(sched_s ORDER BY header_s, fetched_us) FILTER (WHERE sched_s IS NOT NULL) * 1000000 AS scheduled_arrival
      FROM moved GROUP BY 1, 2, 3, 4)
    """
)
_LIVE = f"{D}, trip_id, stop_sequence, is_modified, observed_arrival, min_predicted_arrival, max_predicted_arrival, change_count, poll_count, first_seen_at, last_seen_at"
_LIVE_COLUMNS = [
    "service_date", "trip_id", "stop_sequence", "is_modified", "observed_arrival", "min_predicted_arrival",
    "max_predicted_arrival", "change_count", "poll_count", "first_seen_at", "last_seen_at",
]


def _archived_feeds(spark, sf) -> str:
    root = scratch_path(prepare(spark), "archive")
    archive.write_archive(v.encode_feeds(v.feeds(spark, sf)), root)
    return root


def _ingested(spark, sf, replay: bool = False) -> polls.Store:
    """The archive in three batches, its last third first and its middle last, then all of it again."""
    root, store = scratch_path(prepare(spark), "archive"), polls.Store(scratch_path(spark, "stream"))
    payloads = v.stored(v.encode_feeds(v.feeds(spark, sf)), "payloads")
    low, high = payloads.agg(F.percentile_approx("fetched_at", [0.34, 0.67])).first()[0]
    at = F.col("fetched_at")
    parts = [payloads.filter(at >= high), payloads.filter(at < low), payloads.filter((at >= low) & (at < high))]
    for part in parts + [payloads] * replay:
        archive.write_archive(part, root)
        polls.ingest(spark, root, store, v.probe_timetable(spark), v.TZ, max_files=2000).awaitTermination()
    return store


@query(
    "t1_stream_archive",
    with_("updates") + f"SELECT DISTINCT 'trips' AS feed, {POLL_US} AS fetched_at, 200 AS http_status FROM updates",
)
def _(spark, sf):
    root, out = _archived_feeds(spark, sf), scratch_path(spark, "stream")
    stream = archive.stream_archive(spark, root, max_files=500).select("feed", "fetched_at", "http_status")
    (
        stream.writeStream.format("parquet")
        .option("path", f"{out}/polls")
        .option("checkpointLocation", f"{out}/_checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{out}/polls")


@query("t2_t3_stream_ingest", _FOLDED + f"SELECT {_LIVE}, vehicle_id, scheduled_arrival FROM folded")
def _(spark, sf):
    # Batches come out of order and every poll arrives twice; the result must not show it.
    folded = polls.observations(spark, _ingested(spark, sf, replay=True))
    return folded.select(*_LIVE_COLUMNS, "vehicle_id", "scheduled_arrival")


@query(
    "t5_poll_metrics",
    with_("updates", "ranked")
    + """SELECT poll_id, CAST(count(DISTINCT n) AS INT) AS entity_total, coalesce(any_value(emitted), 0) AS rows_emitted,
      coalesce(any_value(tracked), 0) AS vehicles_tracked
    FROM updates LEFT JOIN (SELECT poll_id, count(*) AS emitted FROM ranked WHERE rn = 1 GROUP BY 1) USING (poll_id)
    LEFT JOIN (SELECT poll_id, count(DISTINCT vehicle_id) AS tracked FROM trip_stops GROUP BY 1) USING (poll_id) GROUP BY poll_id""",
)
def _(spark, sf):
    metrics = polls.poll_metrics(v.feeds(spark, sf), v.probe_timetable(spark), v.TZ)
    return metrics.select("poll_id", "entity_total", "rows_emitted", "vehicles_tracked")


@query(
    "t5_live_status",
    with_("updates", "ranked")
    + f""", p AS (SELECT poll_id, max({POLL_US}) AS fetched FROM updates GROUP BY poll_id)
    SELECT (SELECT count(*) FROM ranked WHERE rn = 1 AND poll_id = (SELECT arg_max(poll_id, fetched) FROM p)) AS rows_last_poll,
      (SELECT count(DISTINCT vehicle_id) FROM trip_stops WHERE poll_id = (SELECT arg_max(poll_id, fetched) FROM p)) AS vehicles_tracked,
      (SELECT count(*) FROM (SELECT DISTINCT service_date, trip_id, stop_sequence, is_modified FROM ranked WHERE rn = 1)) + 1000 AS total_rows, (SELECT max(fetched) FROM p) AS last_poll_at""",
)
def _(spark, sf):
    """Two triggers of the status stream, either side of a restart: each renews one row."""
    store = _ingested(spark, sf)
    polls.follow_status(spark, store, 1000, interval=None).awaitTermination()
    again = v.stored(v.encode_feeds(v.feeds(spark, sf)), "payloads").limit(1)
    polls.ingest_batch(again, 1_000_000, store, v.probe_timetable(spark), v.TZ)  # known already: adds no visit
    polls.follow_status(spark, store, 5, interval=None).awaitTermination()
    return polls.current_status(spark, store)


def _event_stream(spark, sf):
    events = v.table(spark, sf, "events")
    return (
        spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    )


@query(
    "t7_poll_health",
    with_("runs")
    + """SELECT epoch_us(date_trunc('hour', started_at)) AS hour, feed, count(*) AS polls, count(*) FILTER (WHERE NOT ok) AS fails,
      CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes FROM runs GROUP BY 1, 2""",
)
def _(spark, sf):
    runs = _event_stream(spark, sf).select(
        F.col("event_type").alias("feed"),
        F.col("ts").cast("timestamp").alias("started_at"),
        (F.col("value") <= 100).alias("ok"),
        F.length("props").alias("payload_bytes"),
    )
    out = scratch_path(spark, "stream")
    (
        polls.poll_health(runs)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", f"{out}/_checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/health"))
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{out}/health")


@query("t4_t6_live_visits", _FOLDED + f"SELECT {_LIVE} FROM folded")
def _(spark, sf):
    """Predictions in four batches, each with polls of every hour and day: rows of days ago, rows between rows."""
    from ..operators import flatten, match

    out = scratch_path(spark, "stream")
    rows = v.stored(match.predictions(flatten.trip_updates(v.feeds(spark, sf)), v.probe_timetable(spark), v.TZ), "rows")
    store = polls.Store(out)
    for n in range(4):
        rows.filter(F.crc32(F.col("poll_id").cast("binary")) % 4 == n).write.mode("append").parquet(f"{out}/predictions")
        polls.follow_visits(spark.readStream.schema(rows.schema).parquet(f"{out}/predictions"), store).awaitTermination()
    return polls.observations(spark, store).select(*_LIVE_COLUMNS)
