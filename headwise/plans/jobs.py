"""Command-line jobs over a store of tables.

    python -m headwise.plans.jobs load-static --store S --gtfs DIR [--force]
    python -m headwise.plans.jobs rollup      --store S [--date D | --backfill N] [--monthly [YYYY-MM]]
    python -m headwise.plans.jobs export      --store S --out DIR [--window DAYS]
    python -m headwise.plans.jobs diff        --store A --other B [--date D] [--tolerance S] [--settled-mins M]
    python -m headwise.plans.jobs summary     --store S
    python -m headwise.plans.jobs prune       --store S [--keep-days N]
    python -m headwise.plans.jobs evict       --store S --keep-days N
    python -m headwise.plans.jobs seed-gaps   --store S --gaps CSV
    python -m headwise.plans.jobs ingest      --store S --archive DIR --tz ZONE [--interval "2 minutes"]
    python -m headwise.plans.jobs live-status --store S

``--as-of`` (UTC, default now) stands for the present in all of them.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import constants as k
from ..operators import calendar, coverage, health, lifecycle, match, quality, rollup, serving
from ..session import build_session
from ..sources import gtfs, tables
from ..streaming import polls
from . import documents


class Tables:
    """The tables of one store, by name; absent optional ones are empty."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str, empty: str | None = None) -> DataFrame:
        if empty is not None and not tables.exists(self.spark, self.path(name)):
            return self.spark.createDataFrame([], empty)
        return self.spark.read.parquet(self.path(name))

    def static(self, name: str, latest: bool = True) -> DataFrame:
        df = gtfs.stored_table(self.spark, self.path("static"), name)
        if latest:
            version = calendar.latest_version(self.versions()).scalar()
            df = df.filter(F.col("feed_version_id") == version)
        return df

    def versions(self) -> DataFrame:
        return gtfs.registry(self.spark, self.path("static"))

    def services(self, latest: bool = False) -> DataFrame:
        return calendar.service_dates(self.static("calendar", latest), self.static("calendar_dates", latest))

    def timetable(self) -> match.Timetable:
        stored = self.path("trip_schedules")
        return match.Timetable(
            self.versions(), self.static("trips", False), self.static("stop_times", False), self.services(),
            self.read("trip_schedules") if tables.exists(self.spark, stored) else None,
        )

    def gaps(self) -> DataFrame:
        """Known gaps as last merged by ``seed-gaps``, else as the operator's table has them."""
        if tables.exists(self.spark, self.path("known_gaps_versions")):
            return tables.current(self.spark, self.path("known_gaps_versions"))
        return self.read("known_gaps", schemas.KNOWN_GAPS)


def rebuild_coverage(store: Tables, today: date) -> DataFrame:
    """Recompute coverage of all finished days and keep it as a table."""
    result = coverage.day_coverage(
        store.read("observations"),
        store.versions(),
        store.static("trips", False),
        store.static("stop_times", False),
        store.services(),
        store.gaps(),
        F.lit(today),
    )
    coverage.write_coverage(result, store.path("day_coverage"))
    return store.read("day_coverage")


def publish(store: Tables, dates: list[date]) -> None:
    """Bring the observations of some days up to what the stream has folded.

    Days of which the stream has nothing stay as they are: they came from elsewhere.
    """
    spark, kept = store.spark, polls.Store(store.root)
    if not tables.exists(spark, kept.states.path):
        return
    rows = kept.states.read(spark, polls.state_schema(spark)).filter(F.col("service_date").isin(dates))
    held = [r.service_date for r in rows.select("service_date").distinct().collect()]
    if held:
        polls.publish(spark, kept, held)


def rollup_job(store: Tables, dates: list[date], month: str | None, today: date) -> int:
    """Rebuild daily buckets, coverage and, if asked, a month. Returns an exit code."""
    publish(store, dates)
    observations = store.read("observations")
    tables.write_period(
        rollup.rollup_daily(observations, dates), store.path("rollup_daily"), "service_date", [str(d) for d in dates]
    )
    alerts = coverage.coverage_alerts(rebuild_coverage(store, today), F.lit(max(dates))).collect()  # one day
    for alert in alerts:
        print(f"coverage {alert.coverage_pct}% on {alert.service_date} with no diagnosed cause", file=sys.stderr)
    if month is not None:
        first = f"{month}-01"
        tables.write_period(
            rollup.rollup_monthly(observations, [first]), store.path("rollup_monthly"), "month", [first]
        )
    return 1 if alerts else 0


def export_job(store: Tables, out: str, today: date, window: int | None) -> None:
    """Rebuild the serving tier and coverage, then write all documents."""
    daily = store.read("rollup_daily")
    covered = rebuild_coverage(store, today)
    tables.swap(rollup.serving_stats(daily, covered, F.lit(today), window), store.path("serving"), "cells")
    cells = tables.current(store.spark, store.path("serving"))

    stops, routes = store.static("stops"), store.static("routes")
    trips, stop_times = store.static("trips"), store.static("stop_times")
    metadata = serving.stop_metadata(cells, stops, trips, stop_times)
    order = calendar.stop_order(calendar.representative_trips(trips, stop_times), stop_times, stops)
    day = serving.snapshot_day(daily, covered, F.lit(today))
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    documents.write_site(
        documents.stop_documents(cells, metadata, stamp),
        documents.route_documents(cells, routes, order, calendar.stop_positions(order), stops, stamp),
        documents.index_entries(
            rollup.dataset_summary(daily, cells),
            serving.day_types_present(cells),
            rollup.growth(daily),
            covered,
            serving.snapshot(daily, day),
            serving.worst_routes(daily, day, routes),
            metadata,
            serving.route_metadata(cells, routes),
        ),
        out,
    )


def diff_job(a: Tables, b: Tables, as_of: Column, settled_s: int, tolerance_s: int, on: date | None) -> DataFrame:
    """Summary of the differences between the settled observations of two stores."""
    day = None if on is None else F.lit(on)
    sides = [quality.settled(t.read("observations"), as_of, settled_s, day) for t in (a, b)]
    return quality.diff_summary(quality.table_diff(*sides, tolerance_s=tolerance_s))


def summary_job(store: Tables, as_of: Column) -> DataFrame:
    manifest = "name string, key string, bytes bigint, modified_at timestamp"
    return health.health_report(
        store.read("observations"),
        store.read("day_coverage"),
        store.read("ingest_runs", schemas.INGEST_RUNS),
        store.read("backups", manifest),
        store.read("archive_manifest", manifest),
        as_of,
    )


def evict_job(store: Tables, today: date, keep_days: int) -> list[str]:
    """Drop the days of weeks past retention whose days are all rolled up. Returns those weeks.

    Each day is a partition of its own, so a run that ends early leaves whole days, and the next one
    finds the rest of the week.
    """
    observations = store.read("observations")
    plan = lifecycle.eviction_plan(
        observations, store.read("rollup_daily"), F.lit(today), keep_days, store.read("rollup_monthly", "month date")
    )
    weeks = [r.week_start for r in plan.filter("droppable").select("week_start").orderBy("week_start").collect()]
    days = [week + timedelta(days=n) for week in weeks for n in range(7)]
    polls.Store(store.root).states.forget(store.spark, days)
    for day in days:
        tables.delete(store.spark, f"{store.path('observations')}/service_date={day}")
    return [str(week) for week in weeks]


def seed_gaps_job(store: Tables, path: str) -> None:
    """Add the known gaps of a CSV file (service_date, known_gap_reason) to those that are set."""
    seed = store.spark.read.schema(schemas.KNOWN_GAPS).option("header", "true").csv(path)
    merged = coverage.merge_gaps(store.gaps(), seed)
    tables.swap(merged, store.path("known_gaps_versions"), "gaps", sort=["service_date"])


def ingest_job(store: Tables, archive: str, tz: str, interval: str | None) -> None:
    """Follow an archive: to its present end, or for ever every ``interval``."""
    polls.ingest(store.spark, archive, polls.Store(store.root), store.timetable, tz, interval=interval).awaitTermination()


def live_status_job(store: Tables, interval: str | None) -> DataFrame:
    """The last poll and the running total, once, or renewed for ever every ``interval``.

    The total starts from the observations rolled up before the stream began.
    """
    spark, kept = store.spark, polls.Store(store.root)
    seed = 0
    if tables.exists(spark, store.path("rollup_daily")) and not tables.exists(spark, kept.path("_status_checkpoint")):
        first = polls.observations(spark, kept).agg(F.min("service_date")).first()[0]
        daily = store.read("rollup_daily").filter(F.col("service_date") < F.lit(first)) if first else store.read("rollup_daily")
        seed = daily.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    polls.follow_status(spark, kept, int(seed), interval=interval).awaitTermination()
    return polls.current_status(spark, kept)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="headwise", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    parser.add_argument("job", choices=["load-static", "rollup", "export", "diff", "summary", "prune", "evict", "seed-gaps", "ingest", "live-status"])
    parser.add_argument("--store", required=True)
    parser.add_argument("--other")
    parser.add_argument("--gtfs")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--strict", action="store_true")
    parser.add_argument("--out")
    parser.add_argument("--gaps")
    parser.add_argument("--archive")
    parser.add_argument("--interval")
    parser.add_argument("--date", type=date.fromisoformat)
    parser.add_argument("--backfill", type=int, default=0)
    parser.add_argument("--monthly", nargs="?", const="current")
    parser.add_argument("--window", type=int)
    parser.add_argument("--tolerance", type=int, default=k.DIFF_TOLERANCE_S)
    parser.add_argument("--settled-mins", type=int, default=k.SETTLED_S // 60)
    parser.add_argument("--keep-days", type=int, default=k.RUNS_KEPT_DAYS)
    parser.add_argument("--tz", default="UTC", help="the agency's zone")
    parser.add_argument("--as-of", type=datetime.fromisoformat)
    args = parser.parse_args(argv)

    spark = build_session()
    store = Tables(spark, args.store)
    now = args.as_of or datetime.now(UTC).replace(tzinfo=None)
    as_of = F.lit(now.isoformat(sep=" ")).cast("timestamp")
    today = now.replace(tzinfo=UTC).astimezone(ZoneInfo(args.tz)).date()

    if args.job == "load-static":
        result = gtfs.load_static(spark, args.gtfs, store.path("static"), force=args.force, strict=args.strict)
        if not result.skipped or not tables.exists(spark, f"{store.path('trip_schedules')}/feed_version_id={result.feed_version_id}"):
            match.store_schedules(replace(store.timetable(), schedules=None), result.feed_version_id, store.path("trip_schedules"))
        print(f"version {result.feed_version} is {result.feed_version_id}{' (already loaded)' if result.skipped else ''}")
    elif args.job == "rollup":
        days = [args.date] if args.date else [today - timedelta(days=i) for i in range(1, max(1, args.backfill) + 1)]
        month = None if args.monthly is None else f"{today:%Y-%m}" if args.monthly == "current" else args.monthly
        return rollup_job(store, days, month, today)
    elif args.job == "export":
        export_job(store, args.out, today, args.window)
    elif args.job == "diff":
        diff_job(store, Tables(spark, args.other), as_of, args.settled_mins * 60, args.tolerance, args.date).show()
    elif args.job == "summary":
        report = summary_job(store, as_of)
        report.show(truncate=False)
        return 1 if health.verdict(report).first().failing else 0
    elif args.job == "prune":
        tables.prune_runs(spark, store.path("ingest_runs"), as_of, args.keep_days)
    elif args.job == "evict":
        print(*evict_job(store, today, args.keep_days))
    elif args.job == "seed-gaps":
        seed_gaps_job(store, args.gaps)
    elif args.job == "ingest":
        ingest_job(store, args.archive, args.tz, args.interval)
    elif args.job == "live-status":
        live_status_job(store, args.interval).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
