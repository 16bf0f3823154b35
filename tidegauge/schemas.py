"""Limits, type lists, code tables and table schemas (Spark DDL).

Everything in this module must equal the wire contract exactly; no logic here.
"""

from __future__ import annotations

# --- limits (fixed values) ---------------------------------------------------
MAX_BATCH_BYTES = 1024 * 1024
MAX_BATCH_EVENTS = 1000
MAX_EVENT_BYTES = 64 * 1024
MAX_PROPERTIES_BYTES = 16 * 1024
MAX_FUTURE_MS = 5 * 1000
MAX_PAST_MS = 24 * 60 * 60 * 1000
SESSION_TIMEOUT_MINUTES = 30

# Character limits of the typed SDK fields, checked in this order (fixed values).
FIELD_MAX_CHARS = {
    "url": 2048,
    "userAgent": 512,
    "userId": 128,
    "path": 2000,
    "referrer": 2048,
}

# --- event types (fixed values) ----------------------------------------------
CORE_TYPES = [
    "pageview", "pageleave", "click", "scroll", "mouse_move", "keydown", "keypress", "keyup",
    "form_focus", "form_blur", "form_submit", "form_abandon", "error", "visibility_change",
    "resource_load", "session_start", "session_end", "performance", "custom",
]
TRIGGER_TYPES = [
    "exit_intent", "idle_start", "idle_end", "engagement_snapshot", "trigger_registered",
    "trigger_fired", "trigger_dismissed", "trigger_action", "trigger_error",
]
EVENT_TYPES = CORE_TYPES + TRIGGER_TYPES
HIGH_VOLUME_TYPES = ["mouse_move", "engagement_snapshot"]
LEGACY_TYPES = ["pageview", "click", "scroll", "performance", "custom"]

# Top-level keys of an SDK event that are typed; every other key is "extra" (fixed values).
KNOWN_KEYS = [
    "id", "type", "timestamp", "sessionId", "url", "userAgent", "userId", "path", "referrer",
    "deviceInfo", "location",
]

# --- outcome codes (fixed values) --------------------------------------------
HTTP_STATUS = {
    "AUTH_001": 401,
    "AUTH_002": 401,
    "AUTH_003": 401,
    "AUTH_004": 401,
    "AUTH_005": 403,
    "VALID_001": 400,
    "VALID_002": 400,
    "VALID_003": 400,
    "DB_001": 500,
    "RATE_001": 429,
}
API_KEY_PATTERN = "^owk_(live|test)_[a-zA-Z0-9]{32}$"

# --- feature flags: flag -> event types it gates (fixed values) --------------
FEATURE_TYPES = {
    "pageviews": ["pageview", "pageleave"],
    "clicks": ["click"],
    "scrolling": ["scroll"],
    "mouse_move": ["mouse_move"],
    "forms": ["form_focus", "form_blur", "form_submit", "form_abandon", "keydown", "keypress", "keyup"],
    "performance": ["performance"],
    "errors": ["error"],
    "visibility": ["visibility_change"],
    "resources": ["resource_load"],
    "location": [],
    "exit_intent": ["exit_intent"],
    "idle_detection": ["idle_start", "idle_end"],
    "engagement_scoring": ["engagement_snapshot"],
    "triggers": ["trigger_registered", "trigger_fired", "trigger_dismissed", "trigger_action", "trigger_error"],
}
FEATURE_DEFAULT_OFF = ["location"]
TRIGGER_FEATURES = ["exit_intent", "idle_detection", "engagement_scoring", "triggers"]

# --- retention tiers (fixed values; hours, events per second) ----------------
TIERS = {
    "free": {"raw_hours": 24, "aggregate_hours": 168, "compress_hours": 24, "rate_limit": 100},
    "paid": {"raw_hours": 2160, "aggregate_hours": 8760, "compress_hours": 720, "rate_limit": 10000},
    "enterprise": {"raw_hours": 8760, "aggregate_hours": 26280, "compress_hours": 2160, "rate_limit": 100000},
}
DATA_TABLE_KEEP_MONTHS = 3
METRICS_KEEP_MONTHS = 1

# --- monitoring (fixed values) -----------------------------------------------
LATENCY_BOUNDS_MS = [1, 5, 10, 25, 50, 100, 250, 500, 1000, 5000, 10000]
ERROR_RATE_LIMIT = 0.1
ERROR_RATE_MIN_EVENTS = 100
HIGH_FILE_COUNT = 300
SMALL_FILE_BYTES = 128 * 1024 * 1024
DISK_USAGE_LIMIT_PCT = 85.0
ERROR_RATE_TEXT = "High validation error rate: "
BACKPRESSURE_TEXT = "Backpressure active - system under load"
DISK_USAGE_TEXT = "Disk usage high"
COUNTERS = [
    "events_received", "events_validated", "events_failed_validation", "batches_received",
    "batches_sent_to_redpanda", "events_sent_to_redpanda", "redpanda_send_errors",
    "clickhouse_inserts", "clickhouse_insert_errors",
]

# Legacy topics: type -> partitions (replication 3, 7 days) (fixed values).
LEGACY_TOPIC_PARTITIONS = {"pageview": 12, "click": 12, "scroll": 6, "performance": 6, "custom": 12}

# --- inputs ------------------------------------------------------------------
RAW_BATCH = """
    batch_id BIGINT, project_id STRING, authorization STRING, x_api_key STRING,
    x_forwarded_for STRING, x_real_ip STRING, body STRING, received_at TIMESTAMP
"""

# JSON value of one broker record; `type` is the stored `event_type`.
BROKER_RECORD = """
    event_id STRING, project_id STRING, session_id STRING, user_id STRING, type STRING,
    custom_name STRING, timestamp BIGINT, url STRING, path STRING, referrer STRING,
    user_agent STRING, device_type STRING, browser STRING, browser_version STRING, os STRING,
    country STRING, region STRING, city STRING, data STRING
"""
BROKER_OPTIONAL = ["user_id", "custom_name", "region", "city"]

# --- tables (fixed values) ------------------------------------------------------------------
LEGACY_EVENT_ROW = """
    id STRING, tenant_id STRING, session_id STRING, user_id STRING, event_type STRING,
    timestamp BIGINT, received_at BIGINT,
    page_title STRING, page_path STRING, load_time DOUBLE, time_to_first_byte DOUBLE,
    referrer STRING, click_element STRING, click_selector STRING, click_x DOUBLE, click_y DOUBLE,
    is_double_click INT, click_text STRING, scroll_depth DOUBLE, scroll_direction STRING,
    scroll_element STRING, perf_lcp DOUBLE, perf_fid DOUBLE, perf_cls DOUBLE, perf_ttfb DOUBLE,
    perf_fcp DOUBLE, perf_dom_content_loaded DOUBLE, perf_load_complete DOUBLE,
    perf_resource_count BIGINT, perf_memory_usage BIGINT, custom_event_name STRING,
    custom_properties STRING, user_agent STRING, ip STRING, screen_width BIGINT,
    screen_height BIGINT, viewport_width BIGINT, viewport_height BIGINT,
    device_pixel_ratio DOUBLE, timezone STRING, language STRING
"""

_KEYS = "project_id STRING, session_id STRING, timestamp TIMESTAMP"

TABLES = {
    "events": """
        event_id STRING, project_id STRING, session_id STRING, user_id STRING, event_type STRING,
        custom_name STRING, timestamp TIMESTAMP, url STRING, path STRING, referrer STRING,
        user_agent STRING, device_type STRING, browser STRING, browser_version STRING, os STRING,
        country STRING, region STRING, city STRING, data STRING, created_at TIMESTAMP
    """,
    "sessions": """
        session_id STRING, project_id STRING, user_id STRING, started_at TIMESTAMP,
        ended_at TIMESTAMP, event_count BIGINT, duration_ms BIGINT, entry_url STRING,
        entry_path STRING, exit_url STRING, exit_path STRING, referrer STRING,
        pageview_count BIGINT, click_count BIGINT, scroll_max_depth DOUBLE, device_type STRING,
        browser STRING, os STRING, country STRING, created_at TIMESTAMP, updated_at TIMESTAMP
    """,
    "internal_metrics": """
        timestamp TIMESTAMP, events_received BIGINT, events_validated BIGINT,
        events_failed_validation BIGINT, batches_received BIGINT,
        batches_sent_to_redpanda BIGINT, events_sent_to_redpanda BIGINT,
        redpanda_send_errors BIGINT, clickhouse_inserts BIGINT, clickhouse_insert_errors BIGINT,
        ingest_latency_mean_ms DOUBLE, redpanda_latency_mean_ms DOUBLE,
        clickhouse_latency_mean_ms DOUBLE, active_connections BIGINT, queue_depth BIGINT,
        backpressure_active INT
    """,
    "pageviews": f"""
        {_KEYS}, url STRING, path STRING, title STRING, referrer STRING, user_agent STRING,
        device_type STRING, browser STRING, browser_version STRING, os STRING, country STRING,
        region STRING, city STRING, time_on_page_seconds BIGINT, scroll_depth_percentage INT,
        page_load_time_ms BIGINT
    """,
    "clicks": f"""
        {_KEYS}, url STRING, x DOUBLE, y DOUBLE, selector STRING, target STRING,
        element_text STRING, element_tag STRING, element_id STRING, element_class STRING,
        viewport_width INT, viewport_height INT
    """,
    "scroll_events": f"{_KEYS}, depth DOUBLE, max_depth DOUBLE, url STRING",
    "mouse_moves": f"{_KEYS}, x DOUBLE, y DOUBLE, viewport_x DOUBLE, viewport_y DOUBLE, url STRING",
    "form_events": f"{_KEYS}, form_id STRING, field_name STRING, event_type STRING, url STRING",
    "errors": f"{_KEYS}, message STRING, stack STRING, url STRING, line BIGINT, column BIGINT",
    "performance_metrics": f"{_KEYS}, lcp DOUBLE, fid DOUBLE, cls DOUBLE, ttfb DOUBLE, fcp DOUBLE, url STRING",
    "visibility_events": f"{_KEYS}, state STRING, hidden_duration BIGINT, url STRING",
    "resource_loads": f"{_KEYS}, resource_url STRING, resource_type STRING, duration DOUBLE, size BIGINT, url STRING",
    "geographic": f"{_KEYS}, country STRING, region STRING, city STRING, lat DOUBLE, lng DOUBLE, url STRING",
    "custom_events": f"{_KEYS}, name STRING, properties STRING, url STRING",
    "alerts": "timestamp TIMESTAMP, kind STRING, key STRING, severity STRING, message STRING, payload STRING",
    "legacy_events": LEGACY_EVENT_ROW,
}

# Columns whose month is the partition, and the clustered order inside a partition.
PARTITION_TIME = {name: "timestamp" for name in TABLES} | {"sessions": "started_at"}
SORT_KEYS = {name: ["project_id", "timestamp"] for name in TABLES} | {
    "events": ["project_id", "timestamp", "event_id"],
    "sessions": ["project_id", "session_id"],
    "internal_metrics": ["timestamp"],
    "alerts": ["kind", "timestamp"],
    "legacy_events": ["tenant_id", "timestamp"],
}

DAILY_ROLLUP = """
    project_id STRING, date DATE, event_type STRING, count BIGINT,
    unique_sessions BIGINT, unique_users BIGINT
"""
