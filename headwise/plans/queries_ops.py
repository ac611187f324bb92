"""Queries: table comparison, reconciliation, retention, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import collapse, health, lifecycle, quality
from ..session import scratch_path
from ..sources import archive, tables
from . import standins as v
from .catalog import query
from .oracle import with_
from .queries_stats import ORDER


def _diff(spark, sf):
    return quality.table_diff(*v.diff_sides(spark, sf))


@query(
    "j14_table_diff",
    with_("diff") + "SELECT CAST(k AS VARCHAR) AS trip_id, CAST(seq AS INT) AS stop_sequence, status, diffs FROM diff",
)
def _(spark, sf):
    return _diff(spark, sf).select("trip_id", "stop_sequence", "status", "diffs")


def _leaves(sides):
    columns = [*quality.VISIT_KEY, *quality.COMPARED]
    return tuple(v.stored(quality.digest_leaves(df, quality.VISIT_KEY, columns), "leaves") for df in sides)


@query(
    "j14_tree_diff",
    with_("diff") + "SELECT CAST(k AS VARCHAR) AS trip_id, CAST(seq AS INT) AS stop_sequence, status, diffs FROM diff WHERE status <> 'match'",
)
def _(spark, sf):
    """Differences found by a digest tree: only buckets of keys that differ are joined."""
    sides = v.diff_sides(spark, sf)
    found = quality.tree_diff(*sides, _leaves(sides))
    return found.filter("status <> 'match'").select("trip_id", "stop_sequence", "status", "diffs")


@query(
    "a20_tree_summary",
    with_("diff")
    + """SELECT count(*) FILTER (WHERE status IN ('match', 'within_tolerance')) AS matching,
      count(*) FILTER (WHERE status = 'within_tolerance') AS within_tolerance, count(*) FILTER (WHERE status = 'mismatch') AS mismatched,
      count(*) FILTER (WHERE status = 'only_a') AS only_a, count(*) FILTER (WHERE status = 'only_b') AS only_b,
      round(count(*) FILTER (WHERE status IN ('match', 'within_tolerance')) * 100 / count(*)::DOUBLE, 4) AS agreement_pct FROM diff""",
)
def _(spark, sf):
    sides = v.diff_sides(spark, sf, keep=True)
    leaves = _leaves(sides)
    return quality.tree_summary(quality.tree_diff(*sides, leaves), leaves[0])


@query(
    "a20_diff_summary",
    with_("diff")
    + """SELECT count(*) FILTER (WHERE status IN ('match', 'within_tolerance')) AS matching,
      count(*) FILTER (WHERE status = 'within_tolerance') AS within_tolerance, count(*) FILTER (WHERE status = 'mismatch') AS mismatched,
      count(*) FILTER (WHERE status = 'only_a') AS only_a, count(*) FILTER (WHERE status = 'only_b') AS only_b,
      round(count(*) FILTER (WHERE status IN ('match', 'within_tolerance')) * 100 / count(*)::DOUBLE, 4) AS agreement_pct FROM diff""",
)
def _(spark, sf):
    return quality.diff_summary(_diff(spark, sf))




@query(
    "a21_verify_counts",
    with_("visits", "collapsed")
    + """, seen AS (SELECT count(*) AS n FROM visits WHERE observed_us <= (SELECT max(first_seen_us) FROM collapsed))
    SELECT 'observations' AS "table", n AS source_rows, (SELECT count(*) FROM collapsed) AS copy_rows,
      n = (SELECT count(*) FROM collapsed) AS match FROM seen
    UNION ALL SELECT 'orders', count(*), count(*), true FROM orders""",
)
def _(spark, sf):
    source = v.visits(spark, sf)
    copy = collapse.collapse(v.predictions(spark, sf), ORDER)  # one row per visit, not per prediction
    orders = v.table(spark, sf, "orders")
    return quality.verify_counts(
        {"observations": (quality.up_to_watermark(source, copy), copy), "orders": (orders, orders)}
    )


@query(
    "a21_content_checksum",
    """SELECT sum(CAST('0x' || md5(c)[1:15] AS BIGINT)) || '-' || sum(CAST('0x' || md5(c)[16:30] AS BIGINT)) AS checksum, count(*) AS rows_checked FROM (
      SELECT length(a) || ':' || a || length(b) || ':' || b || coalesce(length(c) || ':' || c, '-') || length(d) || ':' || d AS c FROM (
      SELECT l_orderkey::VARCHAR AS a, l_linenumber::VARCHAR AS b, max(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END) AS c, count(*)::VARCHAR AS d
      FROM lineitem GROUP BY l_orderkey, l_linenumber))""",
)
def _(spark, sf):
    rows = v.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))).alias("flag"), F.count(F.lit(1)).alias("rows")
    )
    return quality.content_checksum(rows, ["l_orderkey", "l_linenumber", "flag", "rows"])


@query(
    "a21_table_fingerprint",
    "SELECT count(*) AS n_rows, true AS same FROM lineitem",
)
def _(spark, sf):
    """The digest of a table equals that of the same rows in another order."""
    items = v.table(spark, sf, "lineitem")
    a = quality.table_fingerprint(items, items.columns)
    b = quality.table_fingerprint(items.hint("rebalance", "l_partkey"), items.columns)
    return a.unionAll(b).agg(
        F.max("n_rows").alias("n_rows"),
        ((F.min("high_sum") == F.max("high_sum")) & (F.min("low_sum") == F.max("low_sum"))).alias("same"),
    )


@query(
    "a25_verify_archive",
    """SELECT event_type AS feed, count(*) FILTER (WHERE value <= 390) AS local_records, count(*) FILTER (WHERE value > 5) AS copy_records,
      CAST(sum(length(props)) FILTER (WHERE value <= 390) AS BIGINT) AS payload_bytes_verified,
      2 * count(*) FILTER (WHERE value > 200 AND value <= 390) + count(*) FILTER (WHERE value <= 5 OR value > 390) AS differing,
      count(*) FILTER (WHERE value > 200 OR value <= 5) = 0 AS verified FROM events GROUP BY 1""",
)
def _(spark, sf):
    """Two archives written as gzip shards and read back: some records were altered, some miss on either side."""
    events = v.table(spark, sf, "events")

    def written(text, kept):
        rows = events.filter(kept).select(
            F.col("event_type").alias("feed"), F.col("ts").cast("timestamp").alias("fetched_at"), F.lit(200).alias("http_status"),
            F.lit(None).cast("timestamp").alias("feed_timestamp"), F.lit(1).alias("attempts"), text.cast("binary").alias("payload"),
        )
        root = scratch_path(spark, "archive")
        archive.write_archive(rows, root)
        return archive.read_archive(spark, root)

    altered = F.when(F.col("value") > 200, F.concat(F.col("props"), F.lit("x"))).otherwise(F.col("props"))
    return archive.verify_archive(written(F.col("props"), "value <= 390"), written(altered, "value > 5"))


_UPLOAD = "status <> 'ok' AS upload, status = 'ok' AS confirmed"


@query("j15_reconcile", with_("manifest") + f"SELECT key, bytes, status, {_UPLOAD} FROM manifest")
def _(spark, sf):
    local, remote = v.manifests(spark, sf)
    return lifecycle.reconcile(local, remote).select("key", "bytes", "status", "upload", "confirmed")


@query(
    "j16_prune_plan",
    with_("manifest")
    + """SELECT key, CASE WHEN status = 'ok' THEN 'prune' ELSE 'withhold' END AS action FROM manifest
    WHERE modified_at < TIMESTAMP '2024-01-31' - INTERVAL 90 DAY""",
)
def _(spark, sf):
    local, remote = v.manifests(spark, sf)
    confirmed = lifecycle.reconcile(local, remote).filter("confirmed")
    return lifecycle.prune_plan(local, confirmed, v.as_of(), 90).select("key", "action")


_EVICT = """SELECT strftime(w, '%Y-%m-%d') AS week_start, count(*) AS days, count(*) FILTER (WHERE missing) AS missing_days,
      'stop_time_observations_w' || strftime(w, '%Y%m%d') AS bucket, count(*) FILTER (WHERE missing) = 0 AS droppable
    FROM (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS w, CAST(o_orderdate AS DATE) AS d, {missing} AS missing FROM orders)
    WHERE w + 6 < DATE '2001-08-01' - 45 GROUP BY w"""


def _ordered_days(spark, sf):
    days = v.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("service_date"))
    return days, days.filter(F.dayofmonth("service_date") != 13)


@query("j17_eviction", _EVICT.format(missing="day(o_orderdate) = 13"))
def _(spark, sf):
    observed, rolled = _ordered_days(spark, sf)
    return lifecycle.eviction_plan(observed, rolled, F.lit("2001-08-01").cast("date"), 45)


@query("j17_eviction_monthly", _EVICT.format(missing="(day(o_orderdate) = 13 OR month(o_orderdate) = 6)"))
def _(spark, sf):
    observed, rolled = _ordered_days(spark, sf)
    months = observed.filter(F.month("service_date") != 6).select(F.to_date(F.trunc("service_date", "MM")).alias("month"))
    return lifecycle.eviction_plan(observed, rolled, F.lit("2001-08-01").cast("date"), 45, months)


@query(
    "w5_dump_retention",
    with_("dumps")
    + """, p AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('day', dumped_at) ORDER BY dumped_at DESC) AS d1,
        row_number() OVER (PARTITION BY date_trunc('week', dumped_at) ORDER BY dumped_at DESC) AS w1,
        row_number() OVER (PARTITION BY date_trunc('month', dumped_at) ORDER BY dumped_at DESC) AS m1,
        dense_rank() OVER (ORDER BY date_trunc('day', dumped_at) DESC) AS d2, dense_rank() OVER (ORDER BY date_trunc('week', dumped_at) DESC) AS w2,
        dense_rank() OVER (ORDER BY date_trunc('month', dumped_at) DESC) AS m2 FROM dumps WHERE dumped_at IS NOT NULL)
    SELECT name, epoch_us(dumped_at) AS dumped_at, concat_ws(',', CASE WHEN d1 = 1 AND d2 <= 7 THEN 'daily' END,
        CASE WHEN m1 = 1 AND m2 <= 12 THEN 'monthly' END, CASE WHEN w1 = 1 AND w2 <= 4 THEN 'weekly' END) AS generations,
      (d1 = 1 AND d2 <= 7) OR (w1 = 1 AND w2 <= 4) OR (m1 = 1 AND m2 <= 12) AS retain FROM p
    UNION ALL SELECT name, NULL, '', true FROM dumps WHERE dumped_at IS NULL""",
)
def _(spark, sf):
    return lifecycle.dump_retention(v.dump_names(spark, sf), "snapshot")


_PATHS = """SELECT feed || '/' || strftime(ts, '%Y-%m-%d') || '/' || strftime(ts, '%Y-%m-%dT%H') || suffix AS path, feed, ts, suffix
    FROM (SELECT DISTINCT event_type AS feed, date_trunc('hour', ts) AS ts,
      CASE user_id % 5 WHEN 0 THEN '.ndjson.gz' WHEN 1 THEN '.ndjson.br' WHEN 2 THEN '.ndjson.gz.partial' WHEN 3 THEN '.ndjson.gz.txt' ELSE 'x.ndjson.gz' END AS suffix
      FROM events)"""


def _shard_paths(spark, sf):
    ts = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    suffix = F.element_at(
        F.array(*map(F.lit, (".ndjson.gz", ".ndjson.br", ".ndjson.gz.partial", ".ndjson.gz.txt", "x.ndjson.gz"))),
        (F.col("user_id") % 5 + 1).cast("int"),
    )
    path = F.concat(
        F.concat_ws("/", "event_type", F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "yyyy-MM-dd'T'HH")), suffix
    )
    return v.table(spark, sf, "events").select(path.alias("path")).distinct()


@query(
    "x12_shard_key",
    f"""SELECT path, CASE WHEN suffix IN ('.ndjson.gz', '.ndjson.br') THEN feed || '/' || strftime(ts, '%Y/%m/%d/%H') || suffix END AS key FROM ({_PATHS})""",
)
def _(spark, sf):
    return _shard_paths(spark, sf).select("path", keys.shard_key(F.col("path")).alias("key"))


@query(
    "s14_shard_manifest",
    f"""SELECT path, suffix = '.ndjson.gz.partial' AS partial,
      CASE WHEN suffix IN ('.ndjson.gz', '.ndjson.br') THEN feed || '/' || strftime(ts, '%Y/%m/%d/%H') || suffix
           WHEN suffix = '.ndjson.gz.partial' THEN path END AS key, suffix <> 'x.ndjson.gz' AS recognised
    FROM ({_PATHS}) WHERE suffix <> '.ndjson.gz.txt'""",
)
def _(spark, sf):
    return archive.shard_manifest(_shard_paths(spark, sf)).select("path", "partial", "key", "recognised")


@query(
    "s14_shard_files",
    """WITH s AS (SELECT event_type AS feed, strftime(ts, '%Y-%m-%d') AS d, CAST(day(ts) AS INT) AS n, max(value > 399) AS changed FROM events GROUP BY 1, 2, 3),
    p AS (SELECT feed, d, changed, CASE n % 5 WHEN 0 THEN '.ndjson.gz.partial' WHEN 1 THEN 'x.ndjson.gz' ELSE '.ndjson.gz' END AS ending FROM s)
    SELECT feed || '/' || d || '/' || d || 'T00' || ending AS path, ending = '.ndjson.gz.partial' AS partial,
      CASE ending WHEN '.ndjson.gz' THEN feed || '/' || replace(d, '-', '/') || '/00.ndjson.gz' WHEN '.ndjson.gz.partial' THEN feed || '/' || d || '/' || d || 'T00' || ending END AS key,
      ending <> 'x.ndjson.gz' AS recognised, NOT changed AS same FROM p""",
)
def _(spark, sf):
    """Manifests of two archives on disk, a shard a day: finished, unfinished and misnamed files; some shards were altered in one."""
    events = v.table(spark, sf, "events")

    def manifest(text):
        root = scratch_path(spark, "shards")
        rows = events.select(
            F.col("event_type").alias("feed"), F.to_date("ts").cast("timestamp").alias("fetched_at"), F.lit(200).alias("http_status"),
            F.lit(None).cast("timestamp").alias("feed_timestamp"), F.lit(1).alias("attempts"), text.cast("binary").alias("payload"),
        )
        archive.write_shards(rows, root, lambda feed, hour: {0: ".ndjson.gz.partial", 1: "x.ndjson.gz"}.get(int(hour[8:10]) % 5, ".ndjson.gz"))
        return archive.shard_manifest(archive.shard_files(spark, root))

    altered = F.when(F.col("value") > 399, F.concat(F.col("props"), F.lit("x"))).otherwise(F.col("props"))
    ours, theirs = manifest(F.col("props")), manifest(altered)
    both = ours.join(theirs.select("path", F.col("md5").alias("other")), "path", "full_outer")
    return both.select("path", "partial", "key", "recognised", (F.col("md5") == F.col("other")).alias("same"))


@query(
    "s13_runs_kept",
    with_("runs")
    + """SELECT feed, count(*) AS polls, count(*) FILTER (WHERE ok) AS good, CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes
    FROM runs WHERE started_at >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY GROUP BY feed""",
)
def _(spark, sf):
    kept = tables.runs_to_keep(v.runs(spark, sf), v.as_of(), 20)
    return kept.groupBy("feed").agg(
        F.count(F.lit(1)).alias("polls"), F.count_if("ok").alias("good"), F.sum("payload_bytes").alias("payload_bytes")
    )


def _report(spark, sf):
    backups = v.dump_names(spark, sf).select("name", F.lit("2024-01-29 12:00:00").cast("timestamp").alias("modified_at"))
    local, _ = v.manifests(spark, sf)
    return health.health_report(
        v.visits(spark, sf), v.day_coverage(spark, sf), v.runs(spark, sf), backups, local, v.as_of()
    )


@query(
    "health_report",
    with_("visits", "coverage", "runs")
    + """, c AS (SELECT coverage_pct, known_gap_reason FROM coverage WHERE service_date = (SELECT max(service_date) FROM coverage)),
    f AS (SELECT 100.0 * count(*) FILTER (WHERE NOT ok) / count(*) AS pct FROM runs WHERE started_at > TIMESTAMP '2024-01-24')
    SELECT code, unit, round(CAST(value AS DOUBLE), 6) AS value, CAST(bound AS DOUBLE) AS bound, ok FROM (
    SELECT 'write_age' AS code, 'minutes' AS unit, (epoch_us(TIMESTAMP '2024-01-31') - max(observed_us)) / 60000000.0 AS value, 15.0 AS bound,
      (epoch_us(TIMESTAMP '2024-01-31') - max(observed_us)) / 60000000.0 < 15 AS ok FROM visits
    UNION ALL SELECT 'week_rows', 'rows', count(*), 500000, count(*) > 500000 FROM visits WHERE observed_us > epoch_us(TIMESTAMP '2024-01-24')
    UNION ALL SELECT 'total_rows', 'rows', count(*), NULL, true FROM visits
    UNION ALL SELECT 'day_coverage', 'percent', coverage_pct, 85, coverage_pct >= 85 OR known_gap_reason IS NOT NULL FROM c
    UNION ALL SELECT 'poll_failures', 'percent', pct, 2, pct < 2 FROM f
    UNION ALL SELECT 'backup_age', 'hours', 36.0, 48, true
    UNION ALL SELECT 'archive_size', 'bytes', sum(n_chars), 0, sum(n_chars) > 0 FROM documents)""",
)
def _(spark, sf):
    return _report(spark, sf).select("code", "unit", "value", "bound", "ok")
