"""Queries: serving figures, rankings, coverage, documents, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import calendar, coverage, lookup, rollup, serving
from . import documents
from . import standins as v
from .catalog import query
from .oracle import LATE, wilson, with_

D = "strftime(service_date, '%Y-%m-%d') AS service_date"
CELL = "stop_id, route_id, hour_of_day, day_type"
LO, HI = wilson("n_late_240", "n")
R = "round({0}, 6) AS {0}".format


# -- widening and windows ---------------------------------------------------------------

_WIDE = """wide AS (SELECT c.stop_id, c.route_id, c.hour_of_day, c.day_type, c.n,
      CASE WHEN c.n >= 5 THEN 'exact' WHEN b >= 5 THEN 'band' WHEN a >= 5 THEN 'allday' END AS scope,
      CASE WHEN c.n >= 5 THEN c.n WHEN b >= 5 THEN b WHEN a >= 5 THEN a END AS wn,
      CASE WHEN c.n >= 5 THEN c.n_late_240 WHEN b >= 5 THEN bl WHEN a >= 5 THEN al END AS wlate,
      CASE WHEN c.n >= 5 THEN c.sum_delay WHEN b >= 5 THEN bs WHEN a >= 5 THEN a_s END AS wsum,
      CASE WHEN c.n >= 5 THEN [c.hour_of_day] WHEN b >= 5 THEN bh WHEN a >= 5 THEN ah END AS whours
    FROM cells c JOIN (
      SELECT x.stop_id, x.route_id, x.hour_of_day, x.day_type,
        CAST(sum(y.n) FILTER (WHERE abs(y.hour_of_day - x.hour_of_day) <= 1) AS BIGINT) AS b,
        CAST(sum(y.n_late_240) FILTER (WHERE abs(y.hour_of_day - x.hour_of_day) <= 1) AS BIGINT) AS bl,
        CAST(sum(y.sum_delay) FILTER (WHERE abs(y.hour_of_day - x.hour_of_day) <= 1) AS BIGINT) AS bs,
        list(y.hour_of_day ORDER BY y.hour_of_day) FILTER (WHERE abs(y.hour_of_day - x.hour_of_day) <= 1) AS bh,
        CAST(sum(y.n) AS BIGINT) AS a, CAST(sum(y.n_late_240) AS BIGINT) AS al, CAST(sum(y.sum_delay) AS BIGINT) AS a_s,
        list(y.hour_of_day ORDER BY y.hour_of_day) AS ah
      FROM cells x JOIN cells y USING (stop_id, route_id, day_type) GROUP BY ALL) w
    USING (stop_id, route_id, hour_of_day, day_type))"""


@query(
    "w4_widened",
    with_("cells")
    + f", {_WIDE} SELECT {CELL}, n, scope, wn AS pooled_n, wlate AS pooled_late, round(wsum / wn::DOUBLE, 6) AS pooled_mean, array_to_string(whours, ',') AS hours FROM wide",
)
def _(spark, sf):
    fb = F.col("fallback")
    return serving.widened(v.cells(spark, sf)).select(
        "stop_id", "route_id", "hour_of_day", "day_type", "n",
        fb["scope"].alias("scope"), fb["n"].alias("pooled_n"), fb["n_late"].alias("pooled_late"),
        fb["mean"].alias("pooled_mean"), fb["hours"].alias("hours"),
    )


@query(
    "a19_day_windows",
    with_("cells")
    + f"""SELECT stop_id, route_id, day_type, "window", hours, n, n_late_240, sum_delay, service_days,
      round(sum_delay / n::DOUBLE, 6) AS mean_delay,
      round(CASE WHEN hours > 1 AND n > hours THEN sqrt(ss / (n - hours)) ELSE first_sd END, 6) AS stddev_delay,
      round({LATE}, 6) AS pct_late_240, round({LO}, 6) AS pct_late_lo, round({HI}, 6) AS pct_late_hi,
      CASE WHEN n >= 20 THEN 'confident' WHEN n >= 5 THEN 'provisional' ELSE 'sparse' END AS confidence
    FROM (SELECT stop_id, route_id, day_type, w AS "window", count(*) AS hours, CAST(sum(n) AS BIGINT) AS n,
        CAST(sum(n_late_240) AS BIGINT) AS n_late_240, CAST(sum(sum_delay) AS BIGINT) AS sum_delay, max(service_days) AS service_days,
        sum(stddev_delay * stddev_delay * (n - 1)) AS ss, arg_min(stddev_delay, hour_of_day) AS first_sd
      FROM cells JOIN (VALUES ('morning', 7), ('morning', 8), ('morning', 9), ('evening', 16), ('evening', 17), ('evening', 18)) t(w, h)
        ON h = hour_of_day GROUP BY ALL)""",
)
def _(spark, sf):
    return serving.pooled_windows(v.cells(spark, sf))


@query(
    "w13_mean_band",
    with_("rs")
    + """SELECT route_id, stop_id, n, round(mean_delay - w, 6) AS mean_lo, round(mean_delay + w, 6) AS mean_hi
    FROM (SELECT *, CASE WHEN n > 1 THEN 1.96 * (stddev_delay / sqrt(n)) ELSE 0 END AS w FROM rs)""",
)
def _(spark, sf):
    band = stats.mean_band(F.col("n"), F.col("mean_delay"), F.col("stddev_delay"))
    return serving.route_stop_totals(v.cells(spark, sf)).select(
        "route_id", "stop_id", "n", band["lo"].alias("mean_lo"), band["hi"].alias("mean_hi")
    )


# -- timetable patterns --------------------------------------------------------------------


def _order(spark, sf):
    trips, times, stops = v.trips(spark, sf), v.stop_times(spark, sf), v.stops(spark, sf)
    return calendar.stop_order(calendar.representative_trips(trips, times), times, stops)


@query("w2_representative_trips", with_("best") + "SELECT route_id, direction_id, trip_id, n_stops FROM best")
def _(spark, sf):
    best = calendar.representative_trips(v.trips(spark, sf), v.stop_times(spark, sf))
    return best.select("route_id", "direction_id", "trip_id", "n_stops")


@query("w8_stop_positions", with_("positions") + "SELECT route_id, stop_id, seq, max_seq FROM positions")
def _(spark, sf):
    return calendar.stop_positions(_order(spark, sf))


@query(
    "o1_stop_order",
    with_("stop_order") + "SELECT * FROM stop_order ORDER BY route_id, direction_id, stop_sequence",
)
def _(spark, sf):
    return _order(spark, sf).orderBy("route_id", "direction_id", "stop_sequence")


@query(
    "j6_service_dates",
    with_("services", "trips")
    + "SELECT service_id, strftime(date, '%Y-%m-%d') AS date, count(*) AS trips FROM services JOIN trips USING (service_id) GROUP BY 1, 2",
)
def _(spark, sf):
    trips = v.trips(spark, sf).select("service_id")
    return v.services(spark).join(trips, "service_id").groupBy("service_id", "date").agg(F.count(F.lit(1)).alias("trips"))


@query(
    "o2_union_of_services",
    with_("services", "trips")
    + "SELECT DISTINCT route_id, strftime(date, '%Y-%m-%d') AS date FROM services JOIN trips USING (service_id)",
)
def _(spark, sf):
    return v.services(spark).join(v.trips(spark, sf), "service_id").select("route_id", "date").distinct()


@query(
    "j7_scheduled_events",
    with_("scheduled") + f"SELECT {D}, stop_sequence, count(*) AS events FROM scheduled GROUP BY scheduled.service_date, 2",
)
def _(spark, sf):
    events = calendar.event_words(v.services(spark), v.trips(spark, sf), v.stop_times(spark, sf))
    return _by_sequence(events, {"events": F.col("bits")})


@query(
    "j7_events_of_a_day",
    with_("scheduled") + f"SELECT {D}, trip_id, stop_sequence FROM scheduled WHERE scheduled.service_date = DATE '2024-01-09'",
)
def _(spark, sf):
    return calendar.scheduled_events(v.services(spark), v.trips(spark, sf), v.stop_times(spark, sf), F.lit("2024-01-09").cast("date"))


def _by_sequence(words, bits):
    """Days of words counted by stop sequence; words of equal bits are counted before their days are told apart."""
    alike = words.groupBy("stop_sequence", "word", *[c.alias(f"_{k}") for k, c in bits.items()]).agg(F.count(F.lit(1)).alias("n"))
    days = alike.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63))))
    has = lambda k: F.getbit(f"_{k}", F.col("i")) == 1
    day = F.date_from_unix_date((F.col("word") * 64 + F.col("i")).cast("int")).alias("service_date")
    first = next(iter(bits))
    sums = [F.sum(F.when(has(k), F.col("n")).otherwise(0)).alias(k) for k in bits]
    return days.filter(has(first)).groupBy(day, "stop_sequence").agg(*sums)


# -- coverage -----------------------------------------------------------------------------


@query(
    "j8_coverage_match",
    with_("scheduled", "seen")
    + """SELECT strftime(c.service_date, '%Y-%m-%d') AS service_date, c.stop_sequence, count(*) AS events, count(e.trip_id) AS observed
    FROM scheduled c LEFT JOIN seen e USING (service_date, trip_id, stop_sequence) GROUP BY c.service_date, 2""",
)
def _(spark, sf):
    events = calendar.event_words(v.services(spark), v.trips(spark, sf), v.stop_times(spark, sf))
    matched = coverage.match_words(events, coverage.observed_words(v.observed(spark, sf)))
    return _by_sequence(matched, {"events": F.col("bits"), "observed": F.col("seen")})


_COVERAGE = with_("coverage") + f"SELECT {D}, scheduled_stop_events, observed_stop_events, coverage_pct, known_gap_reason FROM coverage"


@query("a16_day_coverage", _COVERAGE)
def _(spark, sf):
    return v.day_coverage(spark, sf).select(
        "service_date", "scheduled_stop_events", "observed_stop_events", "coverage_pct", "known_gap_reason"
    )


@query(
    "a16_day_coverage_in_effect",
    with_("seen", "services", "trips", "stop_times")
    + """SELECT strftime(d.service_date, '%Y-%m-%d') AS service_date, count(c.trip_id) AS scheduled_stop_events, count(e.trip_id) AS observed_stop_events, round(count(e.trip_id) * 1000 / count(c.trip_id)::DOUBLE) / 10 AS coverage_pct
    FROM (SELECT DISTINCT service_date FROM seen WHERE service_date < DATE '2024-01-07') d
    JOIN (SELECT date, trip_id, stop_sequence FROM services JOIN trips USING (service_id) JOIN stop_times USING (trip_id)
          WHERE date < DATE '2024-01-04' OR (direction_id = 0 AND stop_sequence <= 4)) c ON c.date = d.service_date
    LEFT JOIN seen e ON e.service_date = d.service_date AND e.trip_id = c.trip_id AND e.stop_sequence = c.stop_sequence GROUP BY d.service_date""",
)
def _(spark, sf):
    """Two versions: from the fourth day on, one that has half the trips and four stops of each."""
    trips, times, services = v.trips(spark, sf), v.stop_times(spark, sf), v.services(spark)
    second = lambda df: df.withColumn("feed_version_id", F.lit(2))
    versions = spark.createDataFrame(
        [(1, "2024-01-01", "2024-01-15", "2023-12-20 00:00:00"), (2, "2024-01-04", "2024-01-25", "2024-01-02 00:00:00")], "feed_version_id int, s string, e string, l string"
    ).selectExpr("feed_version_id", "date(s) as feed_start_date", "date(e) as feed_end_date", "timestamp(l) as loaded_at", "timestamp(l) as load_completed_at")
    both = coverage.day_coverage(
        v.observed(spark, sf), versions, trips.union(second(trips.filter("direction_id = 0"))), times.union(second(times.filter("stop_sequence <= 4"))),
        services.union(second(services).select(*services.columns)), v.gaps(spark).limit(0), F.lit("2024-01-07").cast("date"), policy="in_effect",
    )
    return both.select("service_date", "scheduled_stop_events", "observed_stop_events", "coverage_pct")


@query(
    "p10_coverage_class",
    with_("coverage")
    + f"""SELECT {D}, CASE WHEN known_gap_reason IS NOT NULL THEN 'known_gap' WHEN coverage_pct < 12.2 THEN 'unexplained' ELSE 'none' END AS class
    FROM coverage""",
)
def _(spark, sf):
    label = stats.coverage_class(F.col("coverage_pct"), F.col("known_gap_reason"), 12.2)
    return v.day_coverage(spark, sf).select("service_date", label.alias("class"))


@query(
    "p11_coverage_alerts",
    with_("coverage")
    + f"SELECT {D}, coverage_pct FROM coverage WHERE coverage.service_date = DATE '2024-01-06' AND known_gap_reason IS NULL AND coverage_pct < 85",
)
def _(spark, sf):
    alerts = coverage.coverage_alerts(v.day_coverage(spark, sf), F.lit("2024-01-06").cast("date"))
    return alerts.select("service_date", "coverage_pct")


@query(
    "j21_merge_gaps",
    """SELECT strftime(coalesce(a.d, b.d), '%Y-%m-%d') AS service_date, coalesce(a.r, b.r) AS known_gap_reason FROM
      (SELECT CAST(o_orderdate AS DATE) AS d, max(o_orderstatus) FILTER (WHERE o_orderstatus <> 'O') AS r FROM orders GROUP BY 1) a
      FULL OUTER JOIN (SELECT CAST(l_shipdate AS DATE) AS d, min(l_returnflag) AS r FROM lineitem GROUP BY 1) b ON a.d = b.d""",
)
def _(spark, sf):
    noted = v.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("service_date")).agg(
        F.max(F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))).alias("known_gap_reason")
    )
    seed = v.table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("service_date")).agg(
        F.min("l_returnflag").alias("known_gap_reason")
    )
    return coverage.merge_gaps(noted, seed)


@query(
    "j9_without_gaps",
    with_("daily", "gaps")
    + f"SELECT {D}, CAST(sum(n) AS BIGINT) AS n FROM daily WHERE service_date NOT IN (SELECT service_date FROM gaps) GROUP BY daily.service_date",
)
def _(spark, sf):
    return rollup.growth(rollup.without_gaps(v.daily(spark, sf), v.gaps(spark)))


# -- snapshot --------------------------------------------------------------------------------


def _snapshot(spark, sf):
    """The stored daily buckets and their snapshot day."""
    daily, covered = v.stored(v.daily(spark, sf), "daily"), v.stored(v.day_coverage(spark, sf), "coverage")
    return daily, serving.snapshot_day(daily, covered, F.lit("2024-01-07").cast("date"), ok_pct=12.0)


_DAY = """day AS (SELECT max(service_date) AS d FROM daily WHERE service_date IN
      (SELECT service_date FROM coverage WHERE coverage_pct >= 12.0 AND service_date < DATE '2024-01-07'))"""


@query(
    "j12_rollup_with_coverage",
    with_("daily", "coverage")
    + """SELECT strftime(daily.service_date, '%Y-%m-%d') AS service_date, any_value(coverage_pct) AS coverage_pct, CAST(sum(n) AS BIGINT) AS n
    FROM daily JOIN coverage USING (service_date) GROUP BY daily.service_date""",
)
def _(spark, sf):
    return rollup.growth(v.daily(spark, sf)).join(
        v.day_coverage(spark, sf).select("service_date", "coverage_pct"), "service_date"
    )


@query(
    "w9_snapshot",
    with_("daily", "coverage")
    + f""", {_DAY} SELECT {D}, n, n_late, round(100.0::DOUBLE * n_late / n, 6) AS pct_late,
      round(greatest(0.0, 100 - 100.0::DOUBLE * n_late / n), 6) AS on_time_pct
    FROM (SELECT service_date, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_late_240) AS BIGINT) AS n_late FROM daily, day WHERE service_date = d GROUP BY 1)""",
)
def _(spark, sf):
    return serving.snapshot(*_snapshot(spark, sf))


_WORST = f""", {_DAY}, worst AS (SELECT route_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_late_240) AS BIGINT) AS n_late,
      sum(n_late_240) * 100 / sum(n)::DOUBLE AS pct_late
    FROM daily, day WHERE service_date = d GROUP BY route_id HAVING sum(n) >= 20 ORDER BY pct_late DESC, route_id LIMIT 5)"""


@query(
    "w10_j20_worst_routes",
    with_("daily", "coverage", "routes")
    + _WORST
    + " SELECT route_id, n, n_late, round(pct_late, 6) AS pct_late, route_long_name AS route_name FROM worst LEFT JOIN routes USING (route_id)",
)
def _(spark, sf):
    return serving.worst_routes(*_snapshot(spark, sf), v.routes(spark))


@query(
    "w11_o4_busiest",
    with_("cells")
    + """SELECT * FROM (SELECT 'stop' AS kind, stop_id AS id, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY stop_id HAVING max(n >= 5) ORDER BY n DESC, id LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'route', route_id AS id, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY route_id HAVING sum(n) >= 5 ORDER BY n DESC, id LIMIT 3)""",
)
def _(spark, sf):
    cells = v.cells(spark, sf)
    stops = serving.busiest(serving.stop_totals(cells), "stop_id", 5)
    routes = serving.busiest(serving.route_totals(cells), "route_id", 3)
    return stops.select(F.lit("stop").alias("kind"), F.col("stop_id").alias("id"), "n").unionAll(
        routes.select(F.lit("route").alias("kind"), F.col("route_id").alias("id"), "n")
    )


# -- routes -----------------------------------------------------------------------------------


@query(
    "j10_stop_metadata",
    with_("cells", "stops", "trips", "stop_times")
    + """SELECT o.stop_id, coalesce(stop_name, o.stop_id) AS stop_name, round(stop_lat, 6) AS stop_lat, round(stop_lon, 6) AS stop_lon,
      coalesce(headsigns, '') AS headsigns, coalesce(directions, '') AS directions, routes, n, usable
    FROM (SELECT stop_id, CAST(sum(n) AS BIGINT) AS n, max(n >= 5) AS usable, array_to_string(list_sort(list(DISTINCT route_id)), ',') AS routes FROM cells GROUP BY stop_id) o
    LEFT JOIN stops USING (stop_id)
    LEFT JOIN (SELECT stop_id, array_to_string(list_sort(list(DISTINCT trip_headsign)), ',') AS headsigns,
        array_to_string(list_sort(list(DISTINCT direction_id)), ',') AS directions
      FROM stop_times JOIN trips USING (trip_id) GROUP BY stop_id) l ON l.stop_id = o.stop_id""",
)
def _(spark, sf):
    return serving.stop_metadata(v.cells(spark, sf), v.stops(spark, sf), v.trips(spark, sf), v.stop_times(spark, sf))


@query(
    "j11_route_metadata",
    with_("rt", "routes") + "SELECT route_id, n, n >= 5 AS usable, route_long_name AS route_name FROM rt LEFT JOIN routes USING (route_id)",
)
def _(spark, sf):
    return serving.route_metadata(v.cells(spark, sf), v.routes(spark))


@query(
    "j13_delay_profile",
    with_("rs", "stop_order")
    + """SELECT route_id, stop_id, direction_id, trip_headsign, stop_sequence, stop_name, coalesce(n, 0) AS n,
      round(mean_delay, 6) AS mean_delay, round(stddev_delay, 6) AS stddev_delay,
      round(mean_delay - 1.96 * stddev_delay / sqrt(n), 6) AS mean_lo, round(mean_delay + 1.96 * stddev_delay / sqrt(n), 6) AS mean_hi
    FROM stop_order LEFT JOIN rs USING (route_id, stop_id)""",
)
def _(spark, sf):
    return serving.delay_profile(serving.route_stop_totals(v.cells(spark, sf)), _order(spark, sf))


_RANKED = """cand AS (SELECT rs.*, seq, max_seq, seq / max_seq::DOUBLE AS x FROM rs LEFT JOIN positions USING (route_id, stop_id) WHERE n >= 20),
    fit AS (SELECT route_id, points, slope, CASE WHEN points >= 4 THEN y - slope * xm ELSE 0.0 END AS intercept FROM (
      SELECT route_id, count(*) AS points, avg(mean_delay) AS y, avg(x) AS xm,
        CASE WHEN count(*) >= 4 AND var_pop(x) > 0 THEN regr_slope(mean_delay, x) ELSE 0.0 END AS slope
      FROM cand WHERE seq IS NOT NULL GROUP BY route_id)),
    resid AS (SELECT cand.*, points, slope, intercept, CASE WHEN seq IS NOT NULL THEN mean_delay - (intercept + slope * x) END AS residual
      FROM cand LEFT JOIN fit USING (route_id)),
    spread AS (SELECT route_id, CASE WHEN count(residual) > 1 THEN stddev_samp(residual) ELSE 0.0 END AS residual_sd FROM resid GROUP BY route_id),
    flagged AS (SELECT *, coalesce(residual_sd > 0 AND residual > 1.5 * residual_sd, false) AS flagged FROM resid JOIN spread USING (route_id))"""


def _parts(spark, sf):
    return serving.route_stop_totals(v.cells(spark, sf)), calendar.stop_positions(_order(spark, sf))


@query(
    "a17_position_trend",
    with_("rs", "positions") + f", {_RANKED} SELECT route_id, points, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM fit",
)
def _(spark, sf):
    return serving.position_trend(serving.ranked_candidates(*_parts(spark, sf))).drop("residual_sd")


@query(
    "a18_residual_spread",
    with_("rs", "positions") + f", {_RANKED} SELECT route_id, round(residual_sd, 6) AS residual_sd FROM spread",
)
def _(spark, sf):
    return serving.residual_spread(serving.ranked_candidates(*_parts(spark, sf)))


@query(
    "w7_flagged_stops",
    with_("rs", "positions") + f", {_RANKED} SELECT route_id, stop_id, n, seq, round(residual, 6) AS residual, flagged FROM flagged",
)
def _(spark, sf):
    return serving.flagged_stops(*_parts(spark, sf)).select("route_id", "stop_id", "n", "seq", "residual", "flagged")


@query(
    "w7_flagged_at_half_an_sd",
    with_("rs", "positions") + f", {_RANKED} SELECT route_id, stop_id, coalesce(residual_sd > 0 AND residual > 0.5 * residual_sd, false) AS flagged FROM flagged",
)
def _(spark, sf):
    """A lower bound, which some stops pass and others don't."""
    return serving.flagged_stops(*_parts(spark, sf), sds=0.5).select("route_id", "stop_id", "flagged")


@query(
    "w6_best_and_worst",
    with_("rs", "positions")
    + f""", {_RANKED}, ends AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY round(pct_late_240, 1), stop_id) AS up,
        row_number() OVER (PARTITION BY route_id ORDER BY round(pct_late_240, 1) DESC, stop_id DESC) AS down FROM flagged)
    SELECT route_id, 'best' AS list, CAST(up AS INT) AS rank, stop_id, n, round(pct_late_240, 1) AS pct_late FROM ends WHERE up <= 5
    UNION ALL SELECT route_id, 'worst', CAST(down AS INT), stop_id, n, round(pct_late_240, 1) FROM ends WHERE down <= 5""",
)
def _(spark, sf):
    ranked = serving.best_and_worst(serving.flagged_stops(*_parts(spark, sf)))
    return ranked.select("route_id", "list", "rank", "stop_id", "n", F.round("pct_late_240", 1).alias("pct_late"))


# -- documents ----------------------------------------------------------------------------------


def _stamp():
    return F.lit("2024-01-31T00:00:00Z")


def _metadata(spark, sf, cells):
    return serving.stop_metadata(cells, v.stops(spark, sf), v.trips(spark, sf), v.stop_times(spark, sf))


def _route_documents(spark, sf, cells):
    order = v.stored(_order(spark, sf), "order")
    return documents.route_documents(
        cells, v.routes(spark), order, calendar.stop_positions(order), v.stops(spark, sf), _stamp()
    )


_r1 = "round({0}, 1)".format
WLO, WHI = wilson("wlate", "wn")


@query(
    "s10_stop_documents",
    with_("cells")
    + f""", {_WIDE}, entry AS (SELECT c.stop_id, c.route_id, c.hour_of_day, c.day_type, c.n, round(c.mean_delay, 1) AS mean, round(c.stddev_delay, 1) AS sd,
      round(c.pct_late_240, 1) AS pct_late, c.p50_delay_approx AS p50, service_days AS days,
      CASE WHEN c.n >= 20 THEN 'confident' WHEN c.n >= 5 THEN 'provisional' ELSE 'sparse' END AS confidence,
      CASE WHEN c.n < 5 THEN scope END AS fb_scope, CASE WHEN c.n < 5 THEN wn END AS fb_n,
      CASE WHEN c.n < 5 AND scope IS NOT NULL THEN round({WLO}, 1) END AS fb_lo, CASE WHEN c.n < 5 THEN round(wsum / wn::DOUBLE, 1) END AS fb_mean,
      CASE WHEN c.n < 5 THEN array_to_string(whours, ',') END AS fb_hours,
      row_number() OVER (PARTITION BY c.stop_id ORDER BY c.route_id, c.day_type, c.hour_of_day) - 1 AS position
    FROM cells c JOIN wide USING (stop_id, route_id, hour_of_day, day_type))
    SELECT stop_id, CAST(position AS INT) AS position, route_id, hour_of_day, day_type, n, mean, sd, pct_late, p50, days, confidence,
      fb_scope, fb_n, fb_lo, fb_mean, fb_hours FROM entry""",
)
def _(spark, sf):
    """Each document parsed back into its cells."""
    cells = v.stored(v.cells(spark, sf), "cells")
    docs = documents.stop_documents(cells, _metadata(spark, sf, cells), _stamp())
    schema = (
        "struct<cells: array<struct<r string, h int, d int, n bigint, mean double, sd double, pctLate double, p50 int, days int, "
        "confidence string, fallback struct<scope string, n bigint, pctLateLo double, mean double, hours array<int>>>>>"
    )
    cell = docs.select("stop_id", F.posexplode(F.from_json("json", schema)["cells"]).alias("position", "c"))
    fb = F.col("c.fallback")
    return cell.select(
        "stop_id", "position", F.col("c.r").alias("route_id"), F.col("c.h").alias("hour_of_day"), F.col("c.d").alias("day_type"),
        "c.n", "c.mean", "c.sd", F.col("c.pctLate").alias("pct_late"), "c.p50", "c.days", "c.confidence",
        fb["scope"].alias("fb_scope"), fb["n"].alias("fb_n"), fb["pctLateLo"].alias("fb_lo"), fb["mean"].alias("fb_mean"),
        fb["hours"].alias("fb_hours"),
    )


@query(
    "s11_route_documents",
    with_("rt", "rs", "rh", "stop_order", "positions", "routes")
    + f""", {_RANKED}, ends AS (SELECT route_id, stop_id, row_number() OVER (PARTITION BY route_id ORDER BY round(pct_late_240, 1), stop_id) AS up,
        row_number() OVER (PARTITION BY route_id ORDER BY round(pct_late_240, 1) DESC, stop_id DESC) AS down FROM flagged)
    SELECT rt.route_id, route_long_name AS name, n, n >= 5 AS usable, {_r1('mean_delay')} AS mean, {_r1('pct_late_240')} AS pct_late,
      round({LO}, 1) AS pct_late_lo, n_late_240 AS n_late, n_early_60 AS n_early,
      (SELECT string_agg(direction_id || ':' || stop_sequence || ':' || stop_id, ',' ORDER BY direction_id, stop_sequence) FROM stop_order o WHERE o.route_id = rt.route_id) AS profile,
      (SELECT string_agg(stop_id, ',' ORDER BY up) FROM ends e WHERE e.route_id = rt.route_id AND up <= 5) AS best,
      (SELECT string_agg(stop_id, ',' ORDER BY down) FROM ends e WHERE e.route_id = rt.route_id AND down <= 5) AS worst,
      (SELECT string_agg(hour_of_day || ':' || day_type || ':' || n, ',' ORDER BY hour_of_day, day_type) FROM rh h WHERE h.route_id = rt.route_id) AS hours
    FROM rt LEFT JOIN routes USING (route_id)""",
)
def _(spark, sf):
    """Each document parsed back into its parts."""
    schema = (
        "struct<route struct<name string>, n bigint, hasUsableData boolean, mean double, pctLate double, pctLateLo double, nLate bigint, "
        "nEarly bigint, profile array<struct<direction int, stops array<struct<seq int, id string>>>>, best array<struct<id string>>, "
        "worst array<struct<id string>>, hours array<struct<h int, d int, n bigint>>>"
    )
    d = F.col("d")
    profile = F.flatten(
        F.transform(
            d["profile"],
            lambda p: F.transform(
                p["stops"], lambda s: F.concat_ws(":", p["direction"].cast("string"), s["seq"].cast("string"), s["id"])
            ),
        )
    )
    hours = F.transform(d["hours"], lambda h: F.concat_ws(":", *[h[x].cast("string") for x in "hdn"]))
    docs = _route_documents(spark, sf, v.stored(v.cells(spark, sf), "cells"))
    return docs.select("route_id", F.from_json("json", schema).alias("d")).select(
        "route_id",
        d["route"]["name"].alias("name"),
        d["n"].alias("n"),
        d["hasUsableData"].alias("usable"),
        d["mean"].alias("mean"),
        d["pctLate"].alias("pct_late"),
        d["pctLateLo"].alias("pct_late_lo"),
        d["nLate"].alias("n_late"),
        d["nEarly"].alias("n_early"),
        profile.alias("profile"),
        F.transform(d["best"], lambda s: s["id"]).alias("best"),
        F.transform(d["worst"], lambda s: s["id"]).alias("worst"),
        hours.alias("hours"),
    )


def _index(spark, sf, daily, cells):
    covered = v.stored(v.day_coverage(spark, sf), "coverage")
    day = serving.snapshot_day(daily, covered, F.lit("2024-01-07").cast("date"), ok_pct=12.0)
    return documents.index_entries(
        rollup.dataset_summary(daily, cells),
        serving.day_types_present(cells),
        rollup.growth(daily),
        covered,
        serving.snapshot(daily, day),
        serving.worst_routes(daily, day, v.routes(spark)),
        _metadata(spark, sf, cells),
        serving.route_metadata(cells, v.routes(spark)),
    )


def _tiers(spark, sf):
    """The daily buckets and the serving tier, stored."""
    daily = v.stored(v.daily(spark, sf), "daily")
    return daily, v.stored(rollup.serving_stats(daily, v.gaps(spark)), "cells")


@query(
    "s12_index",
    with_("daily", "cells", "coverage", "routes", "rt")
    + _WORST
    + """SELECT 'dataset' AS section, '' AS position, CAST(sum(n) AS BIGINT) AS n, NULL AS label FROM daily
    UNION ALL SELECT 'thresholds', '', NULL, NULL
    UNION ALL SELECT 'growth', strftime(service_date, '%Y-%m-%d'), CAST(sum(n) AS BIGINT), strftime(service_date, '%Y-%m-%d') FROM daily GROUP BY service_date
    UNION ALL SELECT 'dayCoverage', strftime(service_date, '%Y-%m-%d'), NULL, strftime(service_date, '%Y-%m-%d') FROM coverage
    UNION ALL SELECT 'systemSnapshot', '', CAST(sum(n) AS BIGINT), strftime(d, '%Y-%m-%d') FROM daily, day WHERE service_date = d GROUP BY d
    UNION ALL SELECT 'worstRoutes', route_id, n, route_long_name FROM worst LEFT JOIN routes USING (route_id)
    UNION ALL SELECT 'stops', stop_id, CAST(sum(n) AS BIGINT), 'Supplier#' || lpad(stop_id, 9, '0') FROM cells GROUP BY stop_id
    UNION ALL SELECT 'routes', route_id, n, route_long_name FROM rt LEFT JOIN routes USING (route_id)""",
)
def _(spark, sf):
    """The entries' counts and labels, read back from their JSON."""
    j = F.from_json("json", "n bigint, totalObservations bigint, date string, name string")
    return _index(spark, sf, *_tiers(spark, sf)).select(
        "section",
        "position",
        F.coalesce(j["n"], j["totalObservations"]).alias("n"),
        F.coalesce(j["name"], j["date"]).alias("label"),
    )


# -- lookups --------------------------------------------------------------------------------------


@query(
    "j18_nearest_stops",
    with_("stops")
    + """SELECT point_id, stop_id, round(km, 6) AS km, CAST(rank AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY km, stop_id) AS rank FROM (
        SELECT point_id, stop_id, sqrt(pow((stop_lon - lon) * cos(radians((lat + stop_lat) / 2)), 2) + pow(stop_lat - lat, 2)) * 111.32::DOUBLE AS km
        FROM (SELECT c_custkey AS point_id, 43 + (c_custkey % 100) * 0.001::DOUBLE AS lat, -89.5::DOUBLE + c_nationkey * 0.01::DOUBLE AS lon FROM customer), stops))
    WHERE rank <= 10""",
)
def _(spark, sf):
    return lookup.nearest_stops(v.riders(spark, sf), v.stops(spark, sf))


_TERMS = "terms AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(v.SEARCHES)) + ") t(query_id, q))"


@query(
    "j19_search_stops",
    f"""WITH {_TERMS} SELECT query_id, CAST(rank AS INT) AS rank, id, usable, n FROM (
      SELECT query_id, CAST(p_partkey AS VARCHAR) AS id, p_size >= 20 AS usable, p_size AS n,
        row_number() OVER (PARTITION BY query_id ORDER BY p_size >= 20 DESC, p_size DESC, CAST(p_partkey AS VARCHAR)) AS rank
      FROM terms, part WHERE length(q) >= 2 AND list_bool_and(list_transform(string_split(lower(q), ' '),
        lambda t: contains(lower(p_name || ' ' || p_brand || ' ' || p_type), t)))) WHERE rank <= 25""",
)
def _(spark, sf):
    return lookup.search_stops(v.searches(spark), v.searched_stops(spark, sf))


@query(
    "j19_search_routes",
    f"""WITH {_TERMS} SELECT query_id, CAST(rank AS INT) AS rank, id, usable, n FROM (
      SELECT query_id, CAST(p_partkey AS VARCHAR) AS id, p_size >= 20 AS usable, p_size AS n,
        row_number() OVER (PARTITION BY query_id ORDER BY p_size >= 20 DESC, p_size DESC, CAST(p_partkey AS VARCHAR)) AS rank
      FROM terms, part WHERE contains(lower(p_partkey || ' ' || p_name), lower(q))) WHERE rank <= 5""",
)
def _(spark, sf):
    routes = v.searched_stops(spark, sf).select(
        F.col("stop_id").alias("route_id"), F.col("stop_name").alias("route_name"), "n", "usable"
    )
    return lookup.search_routes(v.searches(spark), routes)
