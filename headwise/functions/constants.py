"""Thresholds, codes and formats that results depend on."""

# Stop-level schedule relationship codes of the public GTFS-realtime spec.
REL_SCHEDULED = 0
REL_SKIPPED = 1
REL_NO_DATA = 2
REL_UNSCHEDULED = 3

# Where a scheduled arrival came from.
SOURCE_UNMATCHED = 0
SOURCE_STATIC = 1
SOURCE_PRE_MODIFICATION = 2

# Day types of a service date.
WEEKDAY = 0
SATURDAY = 1
SUNDAY = 2

# calendar_dates.exception_type
SERVICE_ADDED = 1
SERVICE_REMOVED = 2

# Delay thresholds, seconds.
LATE_S = 240
VERY_LATE_S = 300
EARLY_S = -60
MAX_PLAUSIBLE_DELAY_S = 7200

# Sample sizes.
N_CONFIDENT = 20
N_PROVISIONAL = 5

# Statistics.
Z95 = 1.96
OUTLIER_SDS = 1.5
MIN_FIT_POINTS = 4
RANKED_STOPS = 5

# Coverage, percent.
COVERAGE_OK_PCT = 85

# Operations.
SETTLED_S = 15 * 60
DIFF_TOLERANCE_S = 60
HEARTBEAT_S = 10 * 60
NO_HEARTBEAT_AGE = 999999
RUNS_KEPT_DAYS = 30
STATUS_PUSH_S = 120

# Day windows offered to riders: name -> local hours.
DAY_WINDOWS = {"morning": (7, 8, 9), "evening": (16, 17, 18)}

# Lookups.
NEAREST_STOPS = 10
KM_PER_DEGREE = 111.32
ROUTE_HITS = 5
STOP_HITS_COMBINED = 8
STOP_HITS = 25
MIN_ROUTE_QUERY = 1
MIN_STOP_QUERY = 2
HEADSIGNS_SHOWN = 4

# Patterns.
GTFS_TIME = r"^(\d{1,3}):([0-5]\d):([0-5]\d)$"
SHARD_NAME = r"\.ndjson\.(gz|br)(\.partial.*)?$"
SHARD_PATH = r"^(?!\.\.?/)([^/]+)/[^/]*/(\d{4})-(\d{2})-(\d{2})T(\d{2})\.ndjson\.(gz|br)$"
