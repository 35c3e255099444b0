"""Fixed values that results depend on."""

# Event-time and tenant column names, in order of preference.
TIME_NAMES = ["event_time", "occurred_at", "created_at", "timestamp", "ts", "time", "inserted_at", "logged_at"]
TENANT_NAMES = [
    "tenant_id", "account_id", "org_id", "organization_id", "workspace_id", "project_id", "customer_id", "user_id",
]
# Fixed value: names of time columns that updates rewrite (matched on the lower-case name).
REWRITTEN_NAME = (
    r"(^|_)(updated|modified|changed|edited|synced|touched|refreshed|deleted)(_|$)|^last_|_last$"
)
# Thresholds and defaults.
ENTITY_SHARE = 0.05
MIN_ROWS = 100_000
BUCKETS = 64
SNAPSHOT_PARTITION_ROWS = 100_000
STREAM_TRIGGER_SECONDS = 10
SHADOW_RATE = 0.05
SHADOW_TIMEOUT_SECONDS = 30
SIGNIFICANT_DIGITS = 9
FIELD_SEPARATOR = "\x1f"
BENCH_RUNS = 5
MATCH_TIMEOUT_SECONDS = 300
SETTLE_SECONDS = 120
RESTART_GRACE_SECONDS = 120
OUTAGE_DEFAULT_SECONDS = 600
FIRST_CYCLE_SECONDS = 900
FAULT_EVERY_SECONDS = 2400
FAULT_TOLERANCE_SECONDS = 120
MIN_HOURS = 5.5
MAX_P99_SECONDS = 150
SKIP_NOT_SINGLE_KEY = "skipped: checksums need a single-column integer primary key"

# Names of the columns a version log carries beside the source columns.
VERSION = "_version"
DELETED = "_is_deleted"
SYNCED = "_synced_at"
