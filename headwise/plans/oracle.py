"""DuckDB twins of the stand-in views, as common table expressions."""

from __future__ import annotations

from . import standins as v


def _case(column: str, pairs) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN {b}" for a, b in pairs) + " END"


_SEQUENCE = _case("event_type", [(r, i + 1) for i, r in enumerate(v.EVENT_ROUTES)])
_ROUTE = _case("o_orderpriority", [(a, f"'{b}'") for a, b in v.PRIORITY_ROUTES.items()])
_DAY_TYPE = "CASE isodow({0}) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END"


def day_type(date: str) -> str:
    return _DAY_TYPE.format(date)


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql)


def with_(*names: str) -> str:
    """``WITH`` clause holding the named views and all they need, in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered) + "\n"


_cte(
    "pred",
    f"""
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS poll_id, event_id AS entity_pos,
           CAST(ts AS DATE) AS service_date, CAST(user_id % 30 AS VARCHAR) AS trip_id,
           {_SEQUENCE} AS stop_sequence, user_id % 7 = 0 AS is_modified, event_type AS route_id,
           CAST(user_id % 10 AS VARCHAR) AS stop_id,
           CASE WHEN user_id % 11 <> 0 THEN CAST(hour(ts) AS INT) END AS scheduled_hour_local,
           CASE WHEN user_id % 11 <> 0 THEN {day_type('ts')} END AS day_type,
           CASE WHEN user_id % 11 <> 0 THEN epoch_us(date_trunc('hour', ts)) // 1000000 END AS scheduled_s,
           CASE WHEN user_id % 11 <> 0 THEN 1 ELSE 0 END AS scheduled_source,
           CASE WHEN user_id % 11 <> 0 THEN 1 END AS feed_version_id,
           epoch_us(date_trunc('hour', ts)) // 1000000 + CAST(floor(value * 16) AS INT) - 200 AS observed_s,
           CASE WHEN user_id % 13 = 0 THEN 1 ELSE 0 END AS schedule_relationship,
           CASE WHEN user_id % 4 <> 0 THEN CAST(user_id AS VARCHAR) END AS vehicle_id,
           epoch_us(ts) AS observed_us
    FROM events""",
)
_cte("visits", "SELECT *, CAST(observed_s - scheduled_s AS INT) AS delay FROM pred", "pred")
_cte(
    "countable",
    """SELECT service_date, route_id, stop_id, scheduled_hour_local AS hour_of_day, day_type, delay
    FROM visits
    WHERE scheduled_source = 1 AND schedule_relationship = 0 AND delay IS NOT NULL AND abs(delay) < 7200
      AND scheduled_hour_local IS NOT NULL AND day_type IS NOT NULL""",
    "visits",
)
MEASURES = """CAST(count(*) AS BIGINT) AS n, CAST(sum(delay) AS BIGINT) AS sum_delay,
    CAST(sum(CAST(delay AS BIGINT) * delay) AS BIGINT) AS sum_delay_sq,
    min(delay) AS min_delay, max(delay) AS max_delay,
    CAST(round(quantile_cont(delay, 0.5), 6) AS INT) AS p50_delay, CAST(round(quantile_cont(delay, 0.9), 6) AS INT) AS p90_delay,
    count(*) FILTER (WHERE delay >= 240) AS n_late_240, count(*) FILTER (WHERE delay >= 300) AS n_late_300,
    count(*) FILTER (WHERE delay <= -60) AS n_early_60"""
DIMS = "route_id, stop_id, hour_of_day, day_type"
_cte("daily", f"SELECT service_date, {DIMS}, {MEASURES} FROM countable GROUP BY service_date, {DIMS}", "countable")
_cte(
    "monthly",
    f"""SELECT CAST(date_trunc('month', service_date) AS DATE) AS month, {DIMS}, {MEASURES}
    FROM countable GROUP BY ALL""",
    "countable",
)
_cte("gaps", "SELECT * FROM (VALUES " + ", ".join(f"(DATE '{d}', '{r}')" for d, r in v.GAPS) + ") g(service_date, known_gap_reason)")
SUMS = """CAST(sum(n) AS BIGINT) AS n, CAST(sum(sum_delay) AS BIGINT) AS sum_delay,
    CAST(sum(sum_delay_sq) AS BIGINT) AS sum_delay_sq, CAST(sum(n_late_240) AS BIGINT) AS n_late_240,
    CAST(sum(n_late_300) AS BIGINT) AS n_late_300, CAST(sum(n_early_60) AS BIGINT) AS n_early_60"""
# Derived figures over summed columns.
MEAN = "sum_delay / n::DOUBLE"
SD = "sqrt(greatest(0.0, CAST(n::HUGEINT * sum_delay_sq - sum_delay::HUGEINT * sum_delay AS DOUBLE))) / n"
LATE = "n_late_240 * 100 / n::DOUBLE"
_cte(
    "cells",
    f"""SELECT *, {MEAN} AS mean_delay, {SD} AS stddev_delay, {LATE} AS pct_late_240 FROM (
      SELECT stop_id, route_id, hour_of_day, day_type, {SUMS},
             min(min_delay) AS min_delay, max(max_delay) AS max_delay,
             CAST(round(sum(p50_delay * n) / sum(n)::DOUBLE) AS INT) AS p50_delay_approx,
             CAST(round(sum(p90_delay * n) / sum(n)::DOUBLE) AS INT) AS p90_delay_approx,
             min(service_date) AS first_service_date, max(service_date) AS last_service_date,
             CAST(count(DISTINCT service_date) AS INT) AS service_days
      FROM daily WHERE NOT EXISTS (SELECT 1 FROM gaps WHERE gaps.service_date = daily.service_date)
      GROUP BY stop_id, route_id, hour_of_day, day_type)""",
    "daily",
    "gaps",
)


def combined(keys: str) -> str:
    return f"SELECT *, {MEAN} AS mean_delay, {SD} AS stddev_delay, {LATE} AS pct_late_240 FROM (SELECT {keys}, {SUMS} FROM cells GROUP BY {keys})"


_cte("rs", combined("route_id, stop_id"), "cells")
_cte("rh", combined("route_id, hour_of_day, day_type"), "cells")
_cte("rt", combined("route_id"), "cells")


def wilson(s: str, n: str) -> tuple[str, str]:
    zz = "3.8416"
    centre = f"({s} + {zz} / 2)"
    half = f"1.96 * sqrt({s} * ({n} - {s}) / {n}::DOUBLE + {zz} / 4)"
    lo = f"CASE WHEN {n} = 0 THEN 0.0 ELSE greatest(0.0, ({centre} - {half}) / ({n} + {zz}) * 100) END"
    hi = f"CASE WHEN {n} = 0 THEN 100.0 ELSE least(100.0, ({centre} + {half}) / ({n} + {zz}) * 100) END"
    return lo, hi


CONFIDENCE = "CASE WHEN n >= 20 THEN 'confident' WHEN n >= 5 THEN 'provisional' ELSE 'sparse' END"

# -- timetable ------------------------------------------------------------------

_cte(
    "versions",
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"({i}, DATE '{s}', DATE '{e}', TIMESTAMP '{at}', {str(done).lower()})" for i, _, s, e, at, done in v.PROBE_VERSIONS
    )
    + ") t(id, s, e, loaded, done)",
)
_cte(
    "trips",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS trip_id, {_ROUTE} AS route_id, o_orderpriority AS service_id,
           'to ' || o_orderstatus AS trip_headsign, CAST(o_custkey % 2 AS INT) AS direction_id
    FROM orders""",
)
_cte(
    "stop_times",
    """SELECT CAST(l_orderkey AS VARCHAR) AS trip_id, l_linenumber AS stop_sequence,
           CAST(min(l_suppkey) % 12 AS VARCHAR) AS stop_id,
           CAST((l_orderkey % 24) * 3600 + l_linenumber * 300 AS INT) AS arrival_s
    FROM lineitem GROUP BY l_orderkey, l_linenumber""",
)
_cte(
    "stops",
    """SELECT CAST(s_suppkey AS VARCHAR) AS stop_id, s_name AS stop_name, 43 + s_suppkey * 0.001::DOUBLE AS stop_lat,
           -89.5::DOUBLE + s_nationkey * 0.01::DOUBLE AS stop_lon FROM supplier""",
)
_cte(
    "routes",
    "SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{r} line')" for r in v.EVENT_ROUTES if r != "view") + ") r(route_id, route_long_name)",
)
_cte("days", "SELECT CAST(d AS DATE) AS date FROM range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 DAY) r(d)")
_cte(
    "calendar",
    "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{days}')" for s, days in v.CALENDAR.items()) + ") c(service_id, flags)",
)
_cte(
    "exceptions",
    "SELECT * FROM (VALUES " + ", ".join(f"('{s}', DATE '{d}', {t})" for s, d, t in v.EXCEPTIONS) + ") x(service_id, date, kind)",
)
_cte(
    "services",
    """SELECT service_id, date FROM calendar, days WHERE substr(flags, CAST(isodow(date) AS INT), 1) = '1'
      AND NOT EXISTS (SELECT 1 FROM exceptions x WHERE x.service_id = calendar.service_id AND x.date = days.date AND kind = 2)
    UNION SELECT service_id, date FROM exceptions WHERE kind = 1""",
    "days",
    "calendar",
    "exceptions",
)
_cte(
    "observed",
    """SELECT DATE '2024-01-01' + CAST(l_suppkey % 7 AS INT) AS service_date, CAST(l_orderkey AS VARCHAR) AS trip_id,
           l_linenumber AS stop_sequence FROM lineitem WHERE l_returnflag <> 'A'""",
)
_cte("seen", "SELECT DISTINCT * FROM observed", "observed")
_cte(
    "scheduled",
    """SELECT date AS service_date, trip_id, stop_sequence
    FROM services JOIN trips USING (service_id) JOIN stop_times USING (trip_id)""",
    "services",
    "trips",
    "stop_times",
)
_cte(
    "coverage",
    """SELECT service_date, scheduled_stop_events, observed_stop_events,
           CASE WHEN scheduled_stop_events = 0 THEN 0.0
                ELSE round(observed_stop_events * 1000 / scheduled_stop_events::DOUBLE) / 10 END AS coverage_pct,
           known_gap_reason
    FROM (SELECT coalesce(service_date, g.service_date) AS service_date, coalesce(s, 0) AS scheduled_stop_events,
                 coalesce(o, 0) AS observed_stop_events, known_gap_reason
          FROM (SELECT d.service_date, count(c.trip_id) AS s, count(e.trip_id) AS o
                FROM (SELECT DISTINCT service_date FROM seen WHERE service_date < DATE '2024-01-07') d
                LEFT JOIN scheduled c ON c.service_date = d.service_date
                LEFT JOIN seen e ON e.service_date = c.service_date AND e.trip_id = c.trip_id AND e.stop_sequence = c.stop_sequence
                GROUP BY d.service_date)
          FULL OUTER JOIN gaps g USING (service_date))""",
    "seen",
    "scheduled",
    "gaps",
)
_cte(
    "best",
    """SELECT * FROM (
      SELECT route_id, direction_id, trip_id, trip_headsign, count(*) AS n_stops,
             row_number() OVER (PARTITION BY route_id, direction_id ORDER BY count(*) DESC, trip_id) AS rn
      FROM trips JOIN stop_times USING (trip_id) GROUP BY route_id, direction_id, trip_id, trip_headsign) WHERE rn = 1""",
    "trips",
    "stop_times",
)
_cte(
    "stop_order",
    """SELECT route_id, direction_id, trip_headsign, stop_sequence, st.stop_id, stop_name
    FROM best JOIN stop_times st USING (trip_id) LEFT JOIN stops USING (stop_id)""",
    "best",
    "stop_times",
    "stops",
)
_cte(
    "positions",
    """SELECT route_id, stop_id, last(stop_sequence ORDER BY direction_id, stop_sequence) AS seq,
           max(max(stop_sequence)) OVER (PARTITION BY route_id) AS max_seq
    FROM stop_order GROUP BY route_id, stop_id""",
    "stop_order",
)

# -- nested feed, in flat form -----------------------------------------------------

_cte(
    "fe",
    f"""SELECT *, CASE WHEN poll_no % 7 = 0 AND (n % {v.POLL_EVENTS // v.ENTITY_EVENTS}) % 2 = 1 THEN n - 1 ELSE n END % 30 AS trip_no,
           epoch_us(min(ts) OVER (PARTITION BY poll_no)) // 1000000 AS header_s,
           epoch_us(min(ts) OVER (PARTITION BY n)) // 1000000 AS first_s,
           min(event_type) OVER (PARTITION BY n) AS first_type,
           row_number() OVER (PARTITION BY n ORDER BY event_id) - 1 AS stop_pos,
           dense_rank() OVER (PARTITION BY poll_no ORDER BY n) - 1 AS entity_pos
    FROM (SELECT *, event_id // {v.ENTITY_EVENTS} AS n, event_id // {v.POLL_EVENTS} AS poll_no, epoch_us(ts) // 1000000 AS t FROM events)""",
)
_cte(
    "updates",
    """SELECT *, 'trips@' || CAST(header_s * 1000000 + poll_no % 1000000 AS VARCHAR) AS poll_id,
           n % 31 <> 30 AS has_update, n % 7 = 0 AS is_modified,
           CASE WHEN (n % 7 <> 0 AND n % 29 <> 0) OR n % 77 = 0 THEN 'T' || trip_no END AS own_trip,
           CASE WHEN n % 7 = 0 AND n % 29 <> 0 THEN 'T' || trip_no END AS affected_trip,
           CASE WHEN n % 17 <> 0 THEN first_type ELSE '' END AS route_id,
           CASE WHEN n % 4 <> 0 THEN 'V' || (n % 97) END AS vehicle_id,
           CASE WHEN n % 5 <> 0 THEN first_s END AS trip_ts,
           CASE WHEN event_id % 50 <> 49 THEN CAST(event_id % 6 + 1 AS INT) END AS stop_sequence,
           CASE WHEN user_id % 41 <> 0 THEN CAST(user_id % 10 AS VARCHAR) END AS stop_id,
           CASE user_id % 13 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS rel,
           CASE WHEN user_id % 9 <> 0 THEN t END AS arrival_s,
           CASE WHEN user_id % 18 <> 0 THEN t + 20 END AS departure_s
    FROM fe""",
    "fe",
)
_cte(
    "trip_stops",
    """SELECT *, coalesce(own_trip, affected_trip) AS trip_id,
           CASE WHEN rel = 2 THEN 'no_data' WHEN arrival_s IS NOT NULL THEN NULL
                WHEN departure_s IS NOT NULL THEN 'departure_only' ELSE 'no_time' END AS skip_reason
    FROM updates WHERE has_update AND coalesce(own_trip, affected_trip) IS NOT NULL""",
    "updates",
)
_cte("stop_rows", "SELECT * FROM trip_stops WHERE stop_sequence IS NOT NULL AND stop_id IS NOT NULL", "trip_stops")
_cte(
    "bound",
    """SELECT d AS poll_date, coalesce(
             (SELECT arg_max(id, loaded) FROM versions WHERE done AND s <= d AND e >= d),
             (SELECT arg_max(id, loaded) FROM versions WHERE done)) AS feed_version_id
    FROM (SELECT DISTINCT CAST(to_timestamp(header_s - 6 * 3600) AT TIME ZONE 'UTC' AS DATE) AS d FROM stop_rows)""",
    "versions",
    "stop_rows",
)
# Winter only: the zone is six hours behind UTC on every date of the tables.
_cte(
    "timed",
    """SELECT r.*, poll_date, feed_version_id, trip_no < 26 AS known,
           CASE WHEN trip_no < 26 AND stop_sequence BETWEEN 1 AND 6 AND NOT (trip_no % 2 = 0 AND stop_sequence = 5)
                THEN trip_no * 3000 + 1800 + stop_sequence * 120 END AS sched
    FROM (SELECT *, CAST(to_timestamp(header_s - 6 * 3600) AT TIME ZONE 'UTC' AS DATE) AS pd FROM stop_rows) r
    JOIN bound ON bound.poll_date = r.pd""",
    "stop_rows",
    "bound",
)
_cte(
    "resolved",
    """SELECT event_id, min_by(d, abs(gap) * 10 + o) AS date, min_by(o - 1, abs(gap) * 10 + o) AS day_offset FROM (
      SELECT event_id, o, d, epoch_us(CAST(d AS TIMESTAMP)) // 1000000 + 6 * 3600 + sched - arrival_s AS gap
      FROM (SELECT *, CAST(to_timestamp(arrival_s - 6 * 3600) AT TIME ZONE 'UTC' AS DATE) + CAST(o - 1 AS INT) AS d
            FROM timed, range(3) r(o) WHERE arrival_s IS NOT NULL AND sched IS NOT NULL)
      WHERE trip_no >= 3 AND ((d - DATE '2024-01-01') + trip_no + 30) % 3 <> 0)
    GROUP BY event_id""",
    "timed",
)
_cte(
    "anchors",
    """SELECT n, arg_min(date, stop_pos) AS anchor FROM timed JOIN resolved USING (event_id) GROUP BY n""",
    "timed",
    "resolved",
)
_cte(
    "eligible",
    """SELECT *, sched_s IS NOT NULL AS hit FROM (
      SELECT timed.*, anchor IS NOT NULL AS anchored, coalesce(anchor, poll_date) AS service_date,
             CASE WHEN anchor IS NOT NULL THEN epoch_us(CAST(anchor AS TIMESTAMP)) // 1000000 + 6 * 3600 + sched END AS sched_s
      FROM timed LEFT JOIN anchors USING (n))""",
    "timed",
    "anchors",
)
_cte(
    "ranked",
    """SELECT *, row_number() OVER (PARTITION BY poll_id, service_date, trip_id, stop_sequence, is_modified
             ORDER BY vehicle_id IS NOT NULL DESC, coalesce(trip_ts, 0) DESC, entity_pos DESC, stop_pos DESC) AS rn
    FROM eligible WHERE skip_reason IS NULL""",
    "eligible",
)

# -- operations -----------------------------------------------------------------------

_cte(
    "diff_base",
    """SELECT l_orderkey AS k, l_linenumber AS seq, min(epoch_us(l_shipdate) // 1000000) AS t, min(l_suppkey) AS r
    FROM lineitem GROUP BY 1, 2""",
)
_cte(
    "diff",
    """SELECT coalesce(a.k, b.k) AS k, coalesce(a.seq, b.seq) AS seq,
           CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b'
                WHEN b.shift > 60 OR a.r <> b.r THEN 'mismatch'
                WHEN b.shift > 0 THEN 'within_tolerance' ELSE 'match' END AS status,
           CASE WHEN a.k IS NULL OR b.k IS NULL THEN ''
                ELSE concat_ws(',', CASE WHEN b.shift > 60 THEN 'observed_arrival,delay_seconds' END,
                                    CASE WHEN a.r <> b.r THEN 'route_id' END) END AS diffs
    FROM (SELECT * FROM diff_base WHERE seq <> 7) a
    FULL OUTER JOIN (SELECT k, seq, CASE k % 10 WHEN 0 THEN 30 WHEN 1 THEN 90 ELSE 0 END AS shift,
                            CASE WHEN k % 50 = 3 THEN r + 1 ELSE r END AS r FROM diff_base WHERE seq <> 1) b
      ON a.k = b.k AND a.seq = b.seq""",
    "diff_base",
)
_cte(
    "manifest",
    """SELECT CAST(doc_id AS VARCHAR) AS key, n_chars AS bytes, TIMESTAMP '2024-01-01' - to_days(CAST(doc_id % 200 AS INT)) AS modified_at,
           CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 23 = 0 THEN 'size'
                WHEN doc_id % 10 = 0 THEN 'md5' WHEN doc_id % 17 = 0 THEN 'nohash' ELSE 'ok' END AS status
    FROM documents""",
)
_cte(
    "dumps",
    """SELECT DISTINCT 'snapshot-' || strftime(o_orderdate, '%Y-%m-%d') || 'T0830Z.dump' AS name,
           date_trunc('day', o_orderdate) + INTERVAL '8 hours 30 minutes' AS dumped_at FROM orders
    UNION SELECT s_name, NULL FROM supplier""",
)
_cte("runs", "SELECT event_type AS feed, ts AS started_at, value <= 100 AS ok, length(props) AS payload_bytes FROM events")
_cte(
    "collapsed",
    """SELECT *, count(*) OVER () AS total, CAST(observed_s - scheduled_s AS INT) AS delay FROM (
      SELECT service_date, trip_id, stop_sequence, is_modified,
        first(route_id ORDER BY observed_us, entity_pos) AS route_id,
        first(stop_id ORDER BY observed_us, entity_pos) AS stop_id,
        last(vehicle_id ORDER BY observed_us, entity_pos) FILTER (WHERE vehicle_id IS NOT NULL) AS vehicle_id,
        last(scheduled_s ORDER BY observed_us, entity_pos) FILTER (WHERE scheduled_s IS NOT NULL) AS scheduled_s,
        last(scheduled_hour_local ORDER BY observed_us, entity_pos) FILTER (WHERE scheduled_hour_local IS NOT NULL) AS scheduled_hour_local,
        last(day_type ORDER BY observed_us, entity_pos) FILTER (WHERE day_type IS NOT NULL) AS day_type,
        last(feed_version_id ORDER BY observed_us, entity_pos) FILTER (WHERE feed_version_id IS NOT NULL) AS feed_version_id,
        coalesce(last(scheduled_source ORDER BY observed_us, entity_pos) FILTER (WHERE scheduled_s IS NOT NULL),
                 first(scheduled_source ORDER BY observed_us, entity_pos)) AS scheduled_source,
        last(observed_s ORDER BY observed_us, entity_pos) AS observed_s,
        first(observed_s ORDER BY observed_us, entity_pos) AS first_s,
        min(observed_s) AS min_s, max(observed_s) AS max_s,
        CAST(sum(moved) AS BIGINT) AS change_count, count(*) AS poll_count,
        min(observed_us) AS first_seen_us, max(observed_us) AS last_seen_us,
        last(schedule_relationship ORDER BY observed_us, entity_pos) AS schedule_relationship
      FROM (SELECT *, CASE WHEN lag(observed_s) OVER w <> observed_s THEN 1 ELSE 0 END AS moved FROM pred
            WINDOW w AS (PARTITION BY service_date, trip_id, stop_sequence, is_modified ORDER BY observed_us, entity_pos))
      GROUP BY service_date, trip_id, stop_sequence, is_modified)""",
    "pred",
)
