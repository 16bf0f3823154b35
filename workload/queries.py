"""Every registered query with its DuckDB twin (``None``: not expressible in SQL)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge import schemas as S
from tidegauge.functions.times import cutoff_month, month
from tidegauge.functions.urls import extract_path
from tidegauge.operators import (
    dedupe, enrich, features, flatten, legacy, payload, projections, quality, reads, requests, retention,
    rollups, routing, rules, sessions,
)
from tidegauge.plans import ingest, maintenance, reconcile, rollup_store
from tidegauge.session import shared_dir
from tidegauge.sources import broker, tables
from workload import adapters as A, dimensions as D, guards as G, sql as Q
from workload.legacy_records import legacy_records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Types any SQL engine returns alike: zone-less timestamps, 64-bit integers."""
    target = {"timestamp": "timestamp_ntz", "int": "bigint", "smallint": "bigint", "tinyint": "bigint"}
    return df.select(
        *[F.col(f"`{n}`").cast(target[t]).alias(n) if t in target else F.col(f"`{n}`") for n, t in df.dtypes]
    )


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(build(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


# --- request bodies ---------------------------------------------------------------


@register(
    "parse_payload_shapes",
    f"""WITH {Q.BATCHED}
    SELECT batch_id, CASE WHEN any_value(cut) THEN NULL ELSE (['array', 'wrapper', 'single'])[any_value(form) + 1] END AS shape,
           CASE WHEN any_value(bad_batch) THEN 'VALID_001' END AS code,
           CASE WHEN any_value(bad_batch) THEN 0 ELSE count(*) END::BIGINT AS received
    FROM e GROUP BY batch_id""",
)
def parse_payload_shapes(spark, sf_dir):
    return payload.parse_batches(A.raw_batches(spark, sf_dir)).select("batch_id", "shape", "code", "received")


@register(
    "batch_outcomes",
    f"WITH {Q.OUTCOMES} SELECT * FROM o",
)
def batch_outcomes(spark, sf_dir):
    found = ingest.outcomes_by_batch(A.raw_batches(spark, sf_dir))
    return found.withColumn("errors", F.array_join("errors", " | "))


@register("batch_guards", f"WITH {G.guard_outcomes()} SELECT * FROM o")
def batch_guards(spark, sf_dir):
    """Every length, size, count and time limit, broken in turn."""
    return ingest.outcomes_by_batch(G.guard_bodies(spark, sf_dir)).withColumn("errors", F.array_join("errors", " | "))


@register(
    "batch_outcomes_event_guard",
    f"WITH {G.guard_outcomes(event_guard=True)} SELECT code, http_status, count(*)::BIGINT AS batches, sum(accepted)::BIGINT AS accepted FROM o GROUP BY ALL",
)
def batch_outcomes_event_guard(spark, sf_dir):
    return (
        ingest.outcomes_by_batch(G.guard_bodies(spark, sf_dir), max_event_bytes=S.MAX_EVENT_BYTES)
        .groupBy("code", "http_status")
        .agg(F.count("*").alias("batches"), F.sum("accepted").alias("accepted"))
    )


@register(
    "validate_events",
    f"""WITH {Q.BATCHED}
    SELECT batch_id, idx, 'e-' || eid AS event_id, error IS NULL AS ok, error FROM e WHERE NOT bad_batch""",
)
def validate_events(spark, sf_dir):
    validated = ingest.validate_batches(A.raw_batches(spark, sf_dir)).filter(F.col("idx").isNotNull())
    return validated.select("batch_id", "idx", "event_id", F.col("error").isNull().alias("ok"), "error")


_QUARANTINE = f"""WITH {Q.BATCHED}
    SELECT batch_id, batch_project AS project_id, idx, 'e-' || eid AS event_id, 'VALID_001' AS code,
           'validation error: event[' || idx || ']: validation error: ' || error AS error,
           make_timestamp(rms * 1000) AS received_at
    FROM e WHERE NOT bad_batch AND error IS NOT NULL
    UNION ALL
    SELECT batch_id, any_value(batch_project), NULL, NULL, 'VALID_001', 'batch rejected',
           make_timestamp(any_value(rms) * 1000)
    FROM e WHERE bad_batch GROUP BY batch_id"""


@register("quarantine", _QUARANTINE)
def quarantine(spark, sf_dir):
    return ingest.quarantined(A.raw_batches(spark, sf_dir)).drop("payload")


@register("flatten_events", f"WITH {Q.BATCH_FLAT} SELECT {Q.FLAT_LIST} FROM g")
def flatten_events(spark, sf_dir):
    return ingest.accepted_events(A.raw_batches(spark, sf_dir))


@register("extra_json", f"WITH {Q.BATCH_FLAT} SELECT event_id, data FROM g")
def extra_json(spark, sf_dir):
    return ingest.accepted_events(A.raw_batches(spark, sf_dir)).select("event_id", "data")


def typed_sdk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-event bodies of all 28 types; every fifth event breaks a rule of its type."""
    core = F.to_json(
        F.struct(
            F.concat(F.lit("e-"), F.col("eid")).alias("id"),
            A.typed_type().alias("type"),
            F.col("ms").alias("timestamp"),
            F.col("session_id").alias("sessionId"),
            F.lit("https://example.com/").alias("url"),
            F.lit("agent").alias("userAgent"),
        )
    )
    extra = A.payload_json(A.typed_type(), faulty=True)
    body = F.when(extra == "{}", core).otherwise(
        F.concat(F.regexp_replace(core, "}$", ","), F.regexp_replace(extra, "^[{]", ""))
    )
    rows = A.base_events(spark, sf_dir).select(
        F.col("eid").alias("batch_id"),
        "project_id",
        body.alias("body"),
        F.col("ts").alias("received_at"),
    )
    return A.balanced(rows)


_TYPED_ERROR = """CASE WHEN eid % 5 <> 0 THEN NULL ELSE CASE event_type
    WHEN 'mouse_move' THEN 'mouse_move data: velocity is out of range'
    WHEN 'exit_intent' THEN 'exit_intent data: scroll_depth is out of range'
    WHEN 'idle_start' THEN 'idle_start data: last_activity_type is not an allowed value'
    WHEN 'idle_end' THEN 'idle_end data: idle_duration is missing or not a valid long'
    WHEN 'engagement_snapshot' THEN 'engagement_snapshot data: score is out of range'
    WHEN 'trigger_registered' THEN 'trigger_registered data: priority is out of range'
    WHEN 'trigger_fired' THEN 'trigger_fired data: page_count is missing or not a valid uint32'
    WHEN 'trigger_dismissed' THEN 'trigger_dismissed data: method is not an allowed value'
    WHEN 'trigger_action' THEN 'trigger_action data: action_type is out of range'
    WHEN 'trigger_error' THEN 'trigger_error data: error_type is not an allowed value'
    WHEN 'custom' THEN 'custom data: name is out of range' END END"""


@register(
    "validate_event_payloads",
    f"""WITH {Q.flat(typed=True)}
    SELECT event_id, event_type, {_TYPED_ERROR} IS NULL AS ok, {_TYPED_ERROR} AS error FROM f""",
)
def validate_event_payloads(spark, sf_dir):
    validated = ingest.validate_batches(typed_sdk_events(spark, sf_dir))
    return validated.select("event_id", "event_type", F.col("error").isNull().alias("ok"), "error")


_SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*://"
# What is put behind the page's address, by page_id, and what it does to the path.
_SUFFIXES = {
    1: ("?f=a|b", ""), 2: ("/a b", "/a%20b"), 3: ("/{id}/x", "/%7Bid%7D/x"), 4: ("/100%", "/100%"),
    5: ("?q={x}/../y", ""), 6: ("/x/../y/./z", "/y/z"), 7: ("/x/%2e%2E/ü^", "/%C3%BC%5E"), 8: ("#a/../b", ""),
}
_ENDINGS = " ".join(f"WHEN {v} THEN '{end}'" for v, (_, end) in _SUFFIXES.items())


@register(
    "extract_path",
    f"""SELECT page_id, CASE WHEN regexp_matches(url, '{_SCHEME}') THEN coalesce(nullif(
            regexp_extract(url, '{_SCHEME}[^/?#]*([^?#]*)', 1) || CASE page_id % {len(_SUFFIXES) + 1} {_ENDINGS} ELSE '' END, ''), '/')
        ELSE '/' END AS path
    FROM pages""",
)
def extract_path_query(spark, sf_dir):
    """Page addresses, most with an odd path, query or fragment behind them."""
    cases = F.col("page_id") % (len(_SUFFIXES) + 1)
    bare = F.regexp_replace("url", "[?#].*$", "")
    url = reduce(
        lambda c, v: F.when(cases == v, F.concat(bare, F.lit(_SUFFIXES[v][0]))).otherwise(c), _SUFFIXES, F.col("url")
    )
    return A.table(spark, sf_dir, "pages").select("page_id", extract_path(url).alias("path"))


_TRIGGERS = Q.text_list(S.TRIGGER_TYPES)


@register(
    "classify_events",
    f"""WITH {Q.flat(typed=True)}
    SELECT event_type, list_contains({_TRIGGERS}, event_type) AS is_trigger_event,
           list_contains({Q.text_list(S.HIGH_VOLUME_TYPES)}, event_type) AS is_high_volume, count(*)::BIGINT AS count
    FROM f GROUP BY ALL""",
)
def classify_events(spark, sf_dir):
    flagged = flatten.classify(A.flat_events(spark, sf_dir, typed=True))
    return flagged.groupBy("event_type", "is_trigger_event", "is_high_volume").agg(F.count("*").alias("count"))


# --- request headers, projects, features ----------------------------------------------

_REQUESTS = f"""{Q.BASE}, q0 AS (
    SELECT *, eid % 11 AS v, md5('key-' || (uid % 40)) AS digest, 'owk_live_' || md5('key-' || (uid % 40)) AS good,
           (uid % 32) || '.' || k || '.' || (cents % 256) || '.' || (eid % 256) AS ip
    FROM b), q AS (
    SELECT eid AS request_id,
           CASE WHEN v = 1 THEN 'Bearer key_' || digest WHEN v = 2 THEN 'Basic abc'
                WHEN v = 5 THEN 'Bearer owk_prod_' || digest
                WHEN v = 6 THEN 'Bearer owk_live_' || substr(digest, 1, 31) || '!'
                WHEN v = 7 THEN 'Bearer ' WHEN v = 8 THEN 'Bearer   ' || good || ' '
                WHEN v = 9 THEN 'Bearer owk_test_' || md5('none-' || eid)
                WHEN v IN (4, 10) THEN 'Bearer ' || good END AS authorization_,
           CASE WHEN v IN (2, 3) THEN good WHEN v = 4 THEN 'garbage' END AS x_api_key,
           CASE WHEN eid % 3 = 0 THEN ip || ' , 10.0.0.1' WHEN eid % 3 = 1 THEN ip END AS x_forwarded_for,
           CASE WHEN eid % 4 <> 0 THEN '192.168.0.' || k END AS x_real_ip, ip, eid, uid, k, cents
    FROM q0), c AS (
    SELECT *, trim(CASE WHEN starts_with(authorization_, 'Bearer ') THEN substr(authorization_, 8) ELSE x_api_key END) AS api_key
    FROM q), c2 AS (
    SELECT *, CASE WHEN coalesce(api_key, '') = '' THEN 'AUTH_001'
                   WHEN NOT regexp_matches(api_key, '{S.API_KEY_PATTERN}') THEN 'AUTH_002' END AS key_code,
           CASE WHEN regexp_matches(api_key, '{S.API_KEY_PATTERN}') THEN split_part(api_key, '_', 2) END AS key_env
    FROM c)"""


@register(
    "classify_api_keys",
    f"WITH {_REQUESTS} SELECT request_id, api_key, key_code, key_env, CASE WHEN key_code IS NULL THEN 200 ELSE 401 END::BIGINT AS http_status FROM c2",
)
def classify_api_keys(spark, sf_dir):
    return requests.classify_api_keys(D.requests(spark, sf_dir)).select(
        "request_id", "api_key", "key_code", "key_env", payload.http_status(F.col("key_code")).alias("http_status")
    )


@register(
    "client_ip",
    f"""WITH {_REQUESTS}
    SELECT request_id, CASE WHEN eid % 3 < 2 THEN ip ELSE x_real_ip END AS client_ip FROM c""",
)
def client_ip(spark, sf_dir):
    ip = requests.client_ip(F.col("x_forwarded_for"), F.col("x_real_ip"))
    return D.requests(spark, sf_dir).select("request_id", ip.alias("client_ip"))


@register(
    "resolve_projects",
    f"""WITH {_REQUESTS}, keys AS (
        SELECT sha256('owk_live_' || md5('key-' || c_custkey)) AS key_hash, 'proj-' || c_custkey AS tenant_id,
               c_custkey % 12 <> 11 AND (c_custkey % 5 <> 0
                   OR {Q.NOW} + to_days(CAST(c_custkey % 3 - 1 AS INTEGER)) > {Q.NOW}) AS live,
               c_custkey % 10 <> 9 AS tenant_active, c_custkey % 8 <> 7 AS may_write
        FROM customer), j AS (
        SELECT c2.*, keys.*, CASE WHEN key_code IS NOT NULL THEN key_code WHEN tenant_id IS NULL THEN 'AUTH_003'
               WHEN NOT live OR NOT tenant_active THEN 'AUTH_004' WHEN NOT may_write THEN 'AUTH_005' END AS code
        FROM c2 LEFT JOIN keys ON sha256(api_key) = keys.key_hash)
    SELECT request_id, key_env, code, CASE WHEN code IS NULL THEN tenant_id END AS project_id FROM j""",
)
def resolve_projects(spark, sf_dir):
    found = requests.resolve_projects(
        D.requests(spark, sf_dir), D.api_keys(spark, sf_dir), D.tenants(spark, sf_dir), A.as_of()
    )
    return found.select("request_id", "key_env", "code", "project_id")


def _flag_sql(index: int, flag: str) -> str:
    default = "FALSE" if flag in S.FEATURE_DEFAULT_OFF else "TRUE"
    return f"coalesce(CASE WHEN c_custkey % 4 <> 3 THEN (c_custkey + {index}) % 3 <> 0 END, {default}) AS {flag}"


_ALL_FEATURES = f"""features AS (
    SELECT 'proj-' || c_custkey AS project_id, {", ".join(_flag_sql(i, f) for i, f in enumerate(S.FEATURE_TYPES))}
    FROM customer)"""
# Without some customers, whose projects are unknown.
_FEATURES = _ALL_FEATURES.replace("FROM customer)", "FROM customer WHERE c_custkey % 9 <> 6)")
_ENABLED = (
    "CASE "
    + " ".join(f"WHEN list_contains({Q.text_list(types)}, event_type) THEN {flag}" for flag, types in S.FEATURE_TYPES.items() if types)
    + " ELSE TRUE END"
)


@register(
    "feature_gate",
    f"""WITH {Q.flat(typed=True)}, {_FEATURES}
    SELECT event_id, f.project_id, event_type, features.project_id IS NOT NULL AS known_project,
           coalesce({_ENABLED}, TRUE) AS enabled
    FROM f LEFT JOIN features USING (project_id)""",
)
def feature_gate(spark, sf_dir):
    gated = features.feature_gate(A.flat_events(spark, sf_dir, typed=True), D.features(spark, sf_dir))
    return gated.select("event_id", "project_id", "event_type", "known_project", "enabled")


@register(
    "unknown_project_events",
    f"""WITH {Q.flat()}, {_FEATURES}
    SELECT project_id, count(*)::BIGINT AS count FROM f
    WHERE NOT EXISTS (SELECT 1 FROM features WHERE features.project_id = f.project_id) GROUP BY project_id""",
)
def unknown_project_events(spark, sf_dir):
    return reads.count_by_project(features.unknown_projects(A.flat_events(spark, sf_dir), D.features(spark, sf_dir)))


@register(
    "triggers_enabled",
    f"WITH {_ALL_FEATURES} SELECT project_id, {' OR '.join(S.TRIGGER_FEATURES)} AS triggers_enabled FROM features",
)
def triggers_enabled(spark, sf_dir):
    return features.triggers_enabled(D.features(spark, sf_dir, every=True))


# --- per-type tables ---------------------------------------------------------------------

_PROJECTION_SQL = {
    "pageviews": """timestamp, url, path, 'Page ' || k AS title, nullif(referrer, '') AS referrer, user_agent,
        device_type, browser, browser_version, os, country, region, city, k AS time_on_page_seconds,
        CASE WHEN eid % 3 <> 0 THEN k ELSE 0 END::BIGINT AS scroll_depth_percentage, cents AS page_load_time_ms
        FROM f WHERE event_type = 'pageview'""",
    "clicks": """timestamp, url, k::DOUBLE AS x, value AS y, '#b' || k AS selector,
        CASE WHEN eid % 3 = 0 THEN '_blank' END AS target, 'Buy ' || k AS element_text, 'button' AS element_tag,
        'el-' || k AS element_id, NULL::VARCHAR AS element_class, 1280::BIGINT AS viewport_width,
        CASE WHEN eid % 2 = 0 THEN 720 END::BIGINT AS viewport_height FROM f WHERE event_type = 'click'""",
    "scroll_events": """timestamp, k::DOUBLE AS depth, max(k) OVER (PARTITION BY project_id, session_id, url
        ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS max_depth, url
        FROM f WHERE event_type = 'scroll'""",
    "mouse_moves": """timestamp, k::DOUBLE AS x, value AS y, k::DOUBLE AS viewport_x, value AS viewport_y, url
        FROM f WHERE event_type = 'mouse_move'""",
    "form_events": """timestamp, 'form-' || (k % 5) AS form_id, 'field-' || (k % 11) AS field_name, event_type, url
        FROM f WHERE starts_with(event_type, 'form_')""",
    "errors": """timestamp, 'error ' || k AS message, 'at main' AS stack, url, k AS line, k % 13 AS "column"
        FROM f WHERE event_type = 'error'""",
    "performance_metrics": """timestamp, value AS lcp, CASE WHEN eid % 3 = 0 THEN k END::DOUBLE AS fid, k / 1000 AS cls,
        cents::DOUBLE AS ttfb, value AS fcp, url FROM f WHERE event_type = 'performance'""",
    "visibility_events": """timestamp, CASE WHEN k % 2 = 0 THEN 'hidden' ELSE 'visible' END AS state,
        CASE WHEN k % 2 = 0 THEN cents END AS hidden_duration, url FROM f WHERE event_type = 'visibility_change'""",
    "resource_loads": """timestamp, 'https://cdn.example.com/r' || k AS resource_url, 'script' AS resource_type,
        value AS duration, cents AS size, url FROM f WHERE event_type = 'resource_load'""",
    "geographic": """timestamp, country, region, city, NULL::DOUBLE AS lat, NULL::DOUBLE AS lng, url
        FROM f WHERE country <> 'unknown'""",
    "custom_events": """timestamp, kind AS name, '{"cents":' || cents || ',"k":' || k || '}' AS properties, url
        FROM f WHERE event_type = 'custom'""",
}
_PROJECTION_KEYS = {
    "project_pageviews": "pageviews", "project_clicks": "clicks", "project_scrolls": "scroll_events",
    "project_mouse_moves": "mouse_moves", "project_forms": "form_events", "project_errors": "errors",
    "project_performance": "performance_metrics", "project_visibility": "visibility_events",
    "project_resources": "resource_loads", "project_geographic": "geographic", "project_custom": "custom_events",
}


def _register_projection(key: str, name: str) -> None:
    # Scrolls need sessions of more than one event, so their time is squeezed.
    dense = name == "scroll_events"
    source = Q.flat(typed=True, ts=Q.DENSE_TS if dense else "ts")

    @register(key, f"WITH {source} SELECT project_id, session_id, {_PROJECTION_SQL[name]}")
    def build(spark, sf_dir):
        events = A.dense_events if dense else A.flat_events
        return tables.conform(projections.PROJECTIONS[name](events(spark, sf_dir, typed=True)), name)


for _key, _name in _PROJECTION_KEYS.items():
    _register_projection(_key, _name)


# --- enrichment ------------------------------------------------------------------------


@register("enrich_user_agent", f"WITH {Q.flat()} SELECT {Q.ENRICHED_LIST}, {Q.AGENT} FROM f")
def enrich_user_agent(spark, sf_dir):
    return enrich.enrich_user_agent(A.flat_events(spark, sf_dir))


@register(
    "geo_enrich",
    f"""WITH {_REQUESTS}, ranges AS (
        SELECT (s_suppkey % 32) * 16777216 + (s_suppkey // 32) * 524288 AS start, 'N' || s_nationkey AS country,
               CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS region,
               (s_suppkey % 180 - 90)::DOUBLE AS lat, s_acctbal AS lng
        FROM supplier), a AS (
        SELECT *, (uid % 32) * 16777216 + k * 65536 + (cents % 256) * 256 + eid % 256 AS number FROM c)
    SELECT request_id, ip, country AS geo_country, region AS geo_region, NULL::VARCHAR AS geo_city,
           lat AS geo_lat, lng AS geo_lng
    FROM a LEFT JOIN ranges ON number BETWEEN start AND start + 524187""",
)
def geo_enrich(spark, sf_dir):
    rows = D.requests(spark, sf_dir).select("request_id", "ip")
    return enrich.enrich_geo(rows, D.ip_ranges(spark, sf_dir))


_NETWORKS = """n AS (
        SELECT (s_suppkey % 32) || '.0.0.0/8' AS network, 4 AS family, 8 AS bits, (s_suppkey % 32) * 256 AS base, s_nationkey FROM supplier
        UNION ALL SELECT (s_suppkey % 32) || '.' || (s_suppkey % 100) || '.0.0/16', 4, 16, (s_suppkey % 32) * 256 + s_suppkey % 100, s_nationkey
        FROM supplier WHERE s_suppkey % 3 = 0
        UNION ALL SELECT '2001:db8:' || format('{:x}', s_suppkey % 64) || '::/48', 6, 48, (s_suppkey % 64) * 256, s_nationkey FROM supplier
        UNION ALL SELECT '2001:db8:' || format('{:x}', s_suppkey % 64) || ':' || format('{:x}', s_suppkey % 100) || '::/64', 6, 64,
            (s_suppkey % 64) * 256 + s_suppkey % 100, s_nationkey FROM supplier WHERE s_suppkey % 2 = 0)"""


@register(
    "geo_networks",
    f"""WITH {Q.BASE}, {_NETWORKS}, a AS (
        SELECT eid, k, CASE WHEN eid % 2 = 0 THEN 4 ELSE 6 END AS family, CASE WHEN eid % 2 = 0 THEN uid % 32 ELSE uid % 64 END AS top,
               CASE WHEN eid % 2 = 0 THEN (uid % 32) || '.' || k || '.' || (cents % 256) || '.' || (eid % 256)
                    ELSE '2001:db8:' || format('{{:x}}', uid % 64) || ':' || format('{{:x}}', k) || '::' || format('{{:x}}', eid % 65536) END AS ip FROM b),
    m AS (SELECT eid, network, 'N' || s_nationkey AS country, row_number() OVER (PARTITION BY eid ORDER BY bits DESC, network, 'N' || s_nationkey) AS turn
          FROM a JOIN n ON a.family = n.family AND base = top * 256 + CASE WHEN bits IN (16, 64) THEN k ELSE 0 END)
    SELECT a.eid AS event_no, ip, network AS geo_network, country AS geo_country FROM a LEFT JOIN m ON m.eid = a.eid AND turn = 1""",
)
def geo_networks(spark, sf_dir):
    """IPv4 and IPv6 addresses in nested networks: the longest prefix."""
    rows = A.base(A.table(spark, sf_dir, "events"))
    number = lambda c: F.lower(F.hex(c))
    four = F.concat_ws(".", F.col("uid") % 32, "k", F.col("cents") % 256, F.col("eid") % 256)
    six = F.concat(F.lit("2001:db8:"), number(F.col("uid") % 64), F.lit(":"), number(F.col("k")), F.lit("::"), number(F.col("eid") % 65536))
    events = rows.select(F.col("eid").alias("event_no"), F.when(F.col("eid") % 2 == 0, four).otherwise(six).alias("ip"))
    found = enrich.enrich_geo_networks(events, D.ip_networks(spark, sf_dir))
    return found.select("event_no", "ip", "geo_network", "geo_country")


@register(
    "session_sequence",
    f"""WITH {Q.flat(ts=Q.DENSE_TS)}
    SELECT event_id, session_id, row_number() OVER (PARTITION BY project_id, session_id
        ORDER BY timestamp, event_id)::BIGINT AS sequence_number FROM f""",
)
def session_sequence(spark, sf_dir):
    rows = A.dense_events(spark, sf_dir).select("event_id", "project_id", "session_id", "timestamp")
    return enrich.session_sequence(rows).select("event_id", "session_id", "sequence_number")


# --- sinks ------------------------------------------------------------------------------

_RECORD_JSON = "json_object(" + ", ".join(
    f"'{c}', " + {"type": "event_type", "timestamp": "ms"}.get(c, c) for c in routing.RECORD_COLUMNS
) + ")::VARCHAR"


@register(
    "broker_records",
    f"WITH {Q.flat()} SELECT project_id || ':' || session_id AS key, {_RECORD_JSON} AS value FROM f",
)
def broker_records(spark, sf_dir):
    return routing.broker_records(A.flat_events(spark, sf_dir))


@register(
    "decode_broker_records",
    f"""WITH {Q.flat()}
    SELECT event_id, project_id, session_id, user_id, event_type, custom_name, make_timestamp(ms * 1000) AS timestamp,
           url, path, referrer, user_agent, device_type, browser, browser_version, os, country, region, city, data
    FROM f WHERE eid % 13 <> 0 AND eid % 17 <> 0""",
)
def decode_broker_records(spark, sf_dir):
    return broker.good_records(broker.decode_records(A.balanced(faulty_records(A.flat_events(spark, sf_dir)))))


def faulty_records(events: DataFrame) -> DataFrame:
    """Broker records, some cut short (every 13th) or without a required field (every 17th)."""
    number = F.substring("event_id", 3, 20).cast("bigint")
    value = F.col("value")
    records = routing.broker_records(events.withColumn("session_id", F.concat_ws("#", "session_id", number)))
    number = F.regexp_extract("key", "#(\\d+)$", 1).cast("bigint")
    clean = F.regexp_replace(value, '("session_id":"[^#"]*)#\\d+"', '$1"')
    broken = (
        F.when(number % 13 == 0, F.regexp_replace(clean, "}$", ""))
        .when(number % 17 == 0, F.regexp_replace(clean, '"path":"[^"]*",', ""))
        .otherwise(clean)
    )
    return records.select(broken.alias("value"))


@register(
    "route_by_type",
    f"""WITH {Q.flat(typed=True)}
    SELECT event_type, CASE WHEN list_contains({Q.text_list(S.LEGACY_TYPES)}, event_type)
        THEN 'events_' || event_type END AS topic, count(*)::BIGINT AS count FROM f GROUP BY ALL""",
)
def route_by_type(spark, sf_dir):
    routed = routing.route_by_type(A.flat_events(spark, sf_dir, typed=True))
    return routed.groupBy("event_type", "topic").agg(F.count("*").alias("count"))


@register(
    "partition_key_strategies",
    f"""WITH {Q.flat()}
    SELECT event_id, session_id AS by_session, project_id AS by_tenant, NULL::VARCHAR AS round_robin FROM f""",
)
def partition_key_strategies(spark, sf_dir):
    keys = {
        "by_session": routing.partition_key("session", F.col("session_id"), F.col("project_id")),
        "by_tenant": routing.partition_key("tenant", F.col("session_id"), F.col("project_id")),
        "round_robin": routing.partition_key("round_robin", F.col("session_id"), F.col("project_id")),
    }
    return A.flat_events(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in keys.items()])


@register(
    "schema_conform",
    f"""WITH {Q.flat()} SELECT {", ".join({"custom_name": "NULL::VARCHAR AS custom_name", "city": "'nowhere' AS city", "event_type": "CASE WHEN eid % 4 = 0 THEN 'new' ELSE event_type END AS event_type"}.get(c, c) for c in Q.FLAT_COLUMNS)} FROM f""",
)
def schema_conform(spark, sf_dir):
    """Rows of the older layout: ``type`` beside an often missing ``event_type``, no ``custom_name``, cities to fill."""
    number = F.substring("event_id", 3, 20).cast("bigint")
    old = A.flat_events(spark, sf_dir).withColumnRenamed("event_type", "type").drop("custom_name")
    old = old.withColumn("event_type", F.when(number % 4 == 0, "new")).withColumn("extra", F.lit(1))
    return tables.conform(tables.conform(old, "events", {"city": F.lit("nowhere")}), "events")


@register(
    "migrate_events",
    f"""WITH {Q.flat(ts=Q.SPREAD_TS)} SELECT {", ".join({"custom_name": "NULL::VARCHAR AS custom_name", "city": "CASE WHEN eid % 2 = 1 THEN city END AS city"}.get(c, c) for c in Q.FLAT_COLUMNS)},
    strftime(timestamp, '%Y%m') AS month FROM f""",
)
def migrate_events(spark, sf_dir):
    """A table of the older layout with half of the events, migrated twice; the rest appended; all read back."""
    database = tables.fresh_database(spark, "migration", shared_dir(spark, "migration"))
    name, odd = f"{database}.events", F.substring("event_id", 3, 20).cast("bigint") % 2 == 1
    spark.sql(f"DROP TABLE {name}")
    events = tables.arranged(A.spread_events(spark, sf_dir).withColumn("custom_name", F.lit(None).cast("string")), "events")
    old = events.filter(~odd).drop("custom_name", "city").withColumnRenamed("event_type", "type")
    old.write.partitionBy("month").saveAsTable(name)
    if tables.migrate(spark, database, "events") != ["event_type", "custom_name", "city"] or tables.migrate(spark, database, "events"):
        raise ValueError("the second migration must find nothing to do")
    new = events.filter(odd).withColumn("type", F.lit(None).cast("string"))
    new.select(*spark.table(name).columns).write.mode("append").insertInto(name)
    return tables.read(spark, database, "events")


@register(
    "delete_project",
    f"WITH {Q.flat(ts=Q.SPREAD_TS)} SELECT event_id, project_id, timestamp FROM f WHERE project_id <> 'proj-3'",
)
def delete_project(spark, sf_dir):
    """Stored by month, deleted from the table, read back."""
    database = tables.fresh_database(spark, "deletion", shared_dir(spark, "deletion"))
    tables.append(A.spread_events(spark, sf_dir), database, "events")
    maintenance.delete_project(spark, database, "proj-3")
    return spark.table(f"{database}.events").select("event_id", "project_id", "timestamp")


# --- reads ---------------------------------------------------------------------------------


@register("count_events_by_project", f"WITH {Q.flat()} SELECT project_id, count(*)::BIGINT AS count FROM f GROUP BY project_id")
def count_events_by_project(spark, sf_dir):
    return reads.count_by_project(A.flat_events(spark, sf_dir))


@register("count_project_events", f"WITH {Q.flat()} SELECT count(*)::BIGINT AS count FROM f WHERE project_id = 'proj-3'")
def count_project_events(spark, sf_dir):
    return reads.count_events(A.flat_events(spark, sf_dir), "proj-3")


@register("count_all_events", "SELECT count(*)::BIGINT AS count FROM events")
def count_all_events(spark, sf_dir):
    return reads.count_all_events(A.flat_events(spark, sf_dir))


_LATEST = ", ".join(reads.LATEST_COLUMNS)


@register(
    "latest_project_events",
    f"WITH {Q.flat()} SELECT {_LATEST} FROM f WHERE project_id = 'proj-3' ORDER BY timestamp DESC, event_id DESC LIMIT 50",
)
def latest_project_events(spark, sf_dir):
    return reads.latest_events(A.flat_events(spark, sf_dir), 50, "proj-3")


@register("latest_events", f"WITH {Q.flat()} SELECT {_LATEST} FROM f ORDER BY timestamp DESC, event_id DESC LIMIT 100")
def latest_events(spark, sf_dir):
    return reads.latest_events(A.flat_events(spark, sf_dir), 100)


@register(
    "ingest_rate",
    f"""WITH {Q.flat()} SELECT count(*)::BIGINT AS events, count(*) / 3600 AS events_per_second
    FROM f WHERE timestamp > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 HOUR AND timestamp <= TIMESTAMP '2024-01-30 12:00:00'""",
)
def ingest_rate(spark, sf_dir):
    return reads.ingest_rate(A.flat_events(spark, sf_dir), F.lit("2024-01-30 12:00:00").cast("timestamp"))


@register(
    "ingest_rate_by_minute",
    f"WITH {Q.flat()} SELECT date_trunc('minute', timestamp) AS minute, count(*)::BIGINT AS events, count(*) / 60 AS events_per_second FROM f GROUP BY 1",
)
def ingest_rate_by_minute(spark, sf_dir):
    return reads.ingest_rate_by_minute(A.flat_events(spark, sf_dir))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data files of all given tables."""
    return reduce(DataFrame.unionByName, [reads.file_sizes(A.table(spark, sf_dir, n), n) for n in A.TABLES])


_TABLE_ROWS = " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*)::BIGINT AS rows FROM {n}" for n in A.TABLES)


@register("storage_by_table")
def storage_by_table(spark, sf_dir):
    return reads.storage_by_table(_files(spark, sf_dir))


@register("storage_rows_by_table", _TABLE_ROWS)
def storage_rows_by_table(spark, sf_dir):
    """Of ``storage_by_table``, what SQL can count too."""
    return reads.storage_by_table(_files(spark, sf_dir)).select("table", "rows")


@register(
    "storage_by_partition",
    f"""WITH {Q.flat(ts=Q.SPREAD_TS)} SELECT 'events' AS "table", strftime(timestamp, '%Y%m') AS partition, count(*)::BIGINT AS rows
    FROM f GROUP BY 2""",
)
def storage_by_partition(spark, sf_dir):
    """Over events stored by month."""
    root = shared_dir(spark, "events-by-month")
    tables.arranged(A.spread_events(spark, sf_dir), "events").write.partitionBy("month").parquet(root)
    stored = spark.read.parquet(root)
    return reads.storage_by_partition(reads.file_sizes(stored, "events")).select("table", "partition", "rows")


@register(
    "disk_usage_alerts",
    f"""WITH {Q.DISKS} SELECT name, path, free_space, total_space, round(100 - free_space / total_space * 100, 2) AS usage_percent
    FROM disks WHERE total_space > 0 AND 100 - free_space / total_space * 100 > 85""",
)
def disk_usage_alerts(spark, sf_dir):
    return reads.disk_usage(D.disks(spark, sf_dir), S.DISK_USAGE_LIMIT_PCT)


@register(
    "disk_usage",
    f"""WITH {Q.DISKS} SELECT name, path, free_space, total_space, round(100 - free_space / total_space * 100, 2) AS usage_percent
    FROM disks WHERE total_space > 0""",
)
def disk_usage(spark, sf_dir):
    return reads.disk_usage(D.disks(spark, sf_dir))


# --- rollups -----------------------------------------------------------------------------------

_DAILY = """SELECT project_id, timestamp::DATE AS date, event_type, count(*)::BIGINT AS count,
    count(DISTINCT session_id)::BIGINT AS unique_sessions, count(DISTINCT user_id)::BIGINT AS unique_users"""


@register("daily_rollup", f"WITH {Q.flat()} {_DAILY} FROM f GROUP BY 1, 2, 3")
def daily_rollup(spark, sf_dir):
    return rollups.daily_rollup(A.flat_events(spark, sf_dir))


@register("ingest_daily_rollup", f"WITH {Q.BATCH_FLAT} {_DAILY} FROM g GROUP BY 1, 2, 3")
def ingest_daily_rollup(spark, sf_dir):
    """The flagship: request bodies, validated and flattened, then rolled up by day."""
    return rollups.daily_rollup(ingest.accepted_events(A.raw_batches(spark, sf_dir)))


@register("daily_rollup_approx")
def daily_rollup_approx(spark, sf_dir):
    return rollups.daily_rollup_approx(A.flat_events(spark, sf_dir))


@register("monthly_rollup_sketch")
def monthly_rollup_sketch(spark, sf_dir):
    return rollups.merge_sketches(rollups.daily_sketches(A.flat_events(spark, sf_dir)))


def _close(estimate: str, exact: str) -> Column:
    """Within a tenth, or two for small counts."""
    return F.abs(F.col(estimate) - F.col(exact)) <= F.greatest(F.lit(2.0), F.col(exact) * 0.1)


def _both(estimated: DataFrame, exact: DataFrame, keys: list[str]) -> DataFrame:
    counts = ["count", "unique_sessions", "unique_users"]
    joined = estimated.join(exact.select(*keys, *[F.col(c).alias(f"exact_{c}") for c in counts]), keys, "full")
    close = [_close(c, f"exact_{c}").alias(f"{c}_close") for c in counts[1:]]
    return joined.select(*keys, "count", *close)


@register(
    "daily_rollup_approx_error",
    f"WITH {Q.flat()} SELECT project_id, timestamp::DATE AS date, event_type, count(*)::BIGINT AS count, "
    "TRUE AS unique_sessions_close, TRUE AS unique_users_close FROM f GROUP BY 1, 2, 3",
)
def daily_rollup_approx_error(spark, sf_dir):
    """The estimates of ``daily_rollup_approx`` against exact counts."""
    events = A.flat_events(spark, sf_dir)
    keys = ["project_id", "date", "event_type"]
    return _both(rollups.daily_rollup_approx(events), rollups.daily_rollup(events), keys)


@register(
    "monthly_rollup_sketch_error",
    f"WITH {Q.flat()} SELECT project_id, strftime(timestamp, '%Y%m') AS month, event_type, count(*)::BIGINT AS count, "
    "TRUE AS unique_sessions_close, TRUE AS unique_users_close FROM f GROUP BY 1, 2, 3",
)
def monthly_rollup_sketch_error(spark, sf_dir):
    """The estimates of ``monthly_rollup_sketch`` against exact counts."""
    events = A.flat_events(spark, sf_dir)
    keys = ["project_id", "month", "event_type"]
    exact = events.groupBy("project_id", month(F.col("timestamp")).alias("month"), "event_type").agg(
        F.count("*").alias("count"),
        F.count_distinct("session_id").alias("unique_sessions"),
        F.count_distinct("user_id").alias("unique_users"),
    )
    return _both(rollups.merge_sketches(rollups.daily_sketches(events)), exact, keys)


def _stored_rollups(spark: SparkSession, sf_dir: str) -> str:
    """A store filled day range by day range, one of them twice."""
    root, events = shared_dir(spark, "rollups"), A.flat_events(spark, sf_dir)
    parts = [events.filter("timestamp < '2024-01-11'"), events.filter("timestamp >= '2024-01-11'")]
    for part in [*parts, parts[0]]:
        rollup_store.add_days(part, root)
    return root


@register("daily_rollup_bitmap", f"WITH {Q.flat()} {_DAILY} FROM f GROUP BY 1, 2, 3")
def daily_rollup_bitmap(spark, sf_dir):
    """Exact distinct counts from stored bitmaps."""
    return rollup_store.daily(spark, _stored_rollups(spark, sf_dir))


@register(
    "monthly_rollup_bitmap",
    f"""WITH {Q.flat()} SELECT project_id, strftime(timestamp, '%Y%m') AS month, event_type, count(*)::BIGINT AS count,
    count(DISTINCT session_id)::BIGINT AS unique_sessions, count(DISTINCT user_id)::BIGINT AS unique_users FROM f GROUP BY 1, 2, 3""",
)
def monthly_rollup_bitmap(spark, sf_dir):
    """The days' bitmaps merged into months."""
    return rollup_store.monthly(spark, _stored_rollups(spark, sf_dir))


_HOURLY = "SELECT date_trunc('hour', timestamp) AS hour, project_id, event_type, count(*)::BIGINT AS count"


@register("hourly_rollup", f"WITH {Q.flat()} {_HOURLY} FROM f GROUP BY 1, 2, 3")
def hourly_rollup(spark, sf_dir):
    return rollups.hourly_rollup(A.flat_events(spark, sf_dir))


_MAU = f"""limits AS (SELECT 'proj-' || c_custkey AS project_id, (c_custkey % 5 * 4 + 10)::BIGINT AS mau_limit FROM customer),
    u AS (SELECT project_id, strftime(timestamp, '%Y%m') AS month, count(DISTINCT user_id)::BIGINT AS active_users
          FROM f GROUP BY 1, 2),
    mau AS (SELECT project_id, month, active_users, mau_limit, coalesce(active_users > mau_limit, FALSE) AS is_over_limit
            FROM u LEFT JOIN limits USING (project_id))"""


@register(
    "mau_bitmap",
    f"""WITH {Q.flat()} SELECT project_id, strftime(timestamp, '%Y%m') AS month, count(DISTINCT user_id)::BIGINT AS active_users
    FROM f WHERE user_id IS NOT NULL GROUP BY 1, 2""",
)
def mau_bitmap(spark, sf_dir):
    """Active users of a month: the bitmaps of its days and types merged."""
    return rollup_store.active_users(spark, _stored_rollups(spark, sf_dir))


@register("mau_status", f"WITH {Q.flat()}, {_MAU} SELECT * FROM mau")
def mau_status(spark, sf_dir):
    return rollups.mau_status(A.flat_events(spark, sf_dir), D.mau_limits(spark, sf_dir))


@register(
    "rate_limit_audit",
    f"""WITH {Q.flat(ts=Q.DENSE_TS)}, {Q.TENANTS}, s AS (
        SELECT project_id, date_trunc('second', timestamp) AS second, count(*)::BIGINT AS events FROM f GROUP BY 1, 2),
    l AS (SELECT id AS project_id, coalesce(rate_limit, {Q.tier_case("rate_limit")})::BIGINT AS rate_limit FROM tenants)
    SELECT project_id, second, events, rate_limit, events - rate_limit AS excess
    FROM s JOIN l USING (project_id) WHERE events > rate_limit""",
)
def rate_limit_audit(spark, sf_dir):
    return rollups.rate_limit_audit(A.dense_events(spark, sf_dir), D.tenants(spark, sf_dir))


@register(
    "rate_limit_audit_by_minute",
    f"""WITH {Q.flat(ts=Q.DENSE_TS)}, {Q.TENANTS}, s AS (
        SELECT project_id, date_trunc('minute', timestamp) AS second, count(*)::BIGINT AS events FROM f GROUP BY 1, 2),
    l AS (SELECT id AS project_id, coalesce(rate_limit, {Q.tier_case("rate_limit")})::BIGINT AS rate_limit FROM tenants)
    SELECT project_id, second, events, rate_limit, events - rate_limit AS excess
    FROM s JOIN l USING (project_id) WHERE events > rate_limit""",
)
def rate_limit_audit_by_minute(spark, sf_dir):
    return rollups.rate_limit_audit(A.dense_events(spark, sf_dir), D.tenants(spark, sf_dir), "minute")


_STAGES = [t for t in S.TRIGGER_TYPES if t.startswith("trigger_")]


@register(
    "trigger_funnel",
    f"""WITH {Q.flat(typed=True)}, t AS (
        SELECT project_id, 't-' || (k % 10) AS trigger_id,
               {", ".join(f"count(*) FILTER (WHERE event_type = '{s}')::BIGINT AS {s.removeprefix('trigger_')}" for s in _STAGES)}
        FROM f WHERE list_contains({Q.text_list(_STAGES)}, event_type) GROUP BY 1, 2)
    SELECT *, CASE WHEN fired > 0 THEN round(action / fired, 4) END AS action_rate,
           CASE WHEN fired > 0 THEN round(dismissed / fired, 4) END AS dismissed_rate,
           CASE WHEN fired > 0 THEN round(error / fired, 4) END AS error_rate FROM t""",
)
def trigger_funnel(spark, sf_dir):
    return rollups.trigger_funnel(A.flat_events(spark, sf_dir, typed=True))


@register(
    "engagement_averages",
    f"""WITH {Q.flat(typed=True)} SELECT project_id, count(*)::BIGINT AS snapshots, round(avg(k), 4) AS avg_score,
        round(avg(cents), 4) AS avg_time_on_page, round(avg(k), 4) AS avg_scroll_depth, round(avg(k % 7), 4) AS avg_click_count,
        round(avg(value), 4) AS avg_mouse_activity, round(avg(cents), 4) AS avg_focus_time
    FROM f WHERE event_type = 'engagement_snapshot' GROUP BY 1""",
)
def engagement_averages(spark, sf_dir):
    found = rollups.engagement(A.flat_events(spark, sf_dir, typed=True))
    return found.select(*[F.round(c, 4).alias(c) if c.startswith("avg_") else F.col(c) for c in found.columns])


# --- sessions ----------------------------------------------------------------------------------

_SESSIONS = f"""SELECT session_id, project_id,
    arg_min(user_id, (timestamp, event_id)) FILTER (WHERE user_id IS NOT NULL) AS user_id,
    min(timestamp) AS started_at, max(timestamp) AS ended_at, count(*)::BIGINT AS event_count,
    (epoch_us(max(timestamp)) // 1000 - epoch_us(min(timestamp)) // 1000)::BIGINT AS duration_ms,
    arg_min(url, (timestamp, event_id)) AS entry_url, arg_min(path, (timestamp, event_id)) AS entry_path,
    arg_max(url, (timestamp, event_id)) AS exit_url, arg_max(path, (timestamp, event_id)) AS exit_path,
    arg_min(referrer, (timestamp, event_id)) AS referrer,
    count(*) FILTER (WHERE event_type = 'pageview')::BIGINT AS pageview_count,
    count(*) FILTER (WHERE event_type = 'click')::BIGINT AS click_count,
    (max(k) FILTER (WHERE event_type = 'scroll'))::DOUBLE AS scroll_max_depth,
    arg_min(device_type, (timestamp, event_id)) AS device_type, arg_min(browser, (timestamp, event_id)) AS browser,
    arg_min(os, (timestamp, event_id)) AS os, arg_min(country, (timestamp, event_id)) AS country,
    {Q.NOW} AS created_at, {Q.NOW} AS updated_at"""


@register("sessions", f"WITH {Q.flat(typed=True, ts=Q.DENSE_TS)} {_SESSIONS} FROM f GROUP BY project_id, session_id")
def sessions_query(spark, sf_dir):
    return sessions.sessions(A.dense_events(spark, sf_dir, typed=True), A.as_of())


def _visits(minutes: int) -> str:
    return f"""v0 AS (
        SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w <= INTERVAL {minutes} MINUTES THEN 0 ELSE 1 END AS starts
        FROM f0 WINDOW w AS (PARTITION BY project_id, uid ORDER BY timestamp, eid)),
    v1 AS (SELECT *, sum(starts) OVER (PARTITION BY project_id, uid ORDER BY timestamp, eid ROWS UNBOUNDED PRECEDING) AS visit FROM v0),
    visits AS (SELECT project_id, uid, visit::BIGINT AS visit, min(timestamp) AS started_at, max(timestamp) AS last_active_at,
           count(*)::BIGINT AS event_count FROM v1 GROUP BY 1, 2, 3)"""


_DENSE_F0 = f"""{Q.BASE}, f0 AS (SELECT * EXCLUDE (ts), {Q.DENSE_TS} AS timestamp FROM b)"""
_VISIT_AS_OF = "2024-01-02 12:00:00"


@register(
    "sessionize_30min",
    f"""WITH {_DENSE_F0}, {_visits(30)}
    SELECT project_id, uid, visit, started_at, last_active_at, event_count,
           (epoch_us(last_active_at) // 1000 - epoch_us(started_at) // 1000)::BIGINT AS duration_ms,
           TIMESTAMP '{_VISIT_AS_OF}' - last_active_at <= INTERVAL 30 MINUTES AS active
    FROM visits""",
)
def sessionize_30min(spark, sf_dir):
    return sessions.sessionize(
        _dense_activity(spark, sf_dir), ["project_id", "uid"], F.lit(_VISIT_AS_OF).cast("timestamp")
    )


def _dense_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project, user number and time of every event, squeezed like ``dense_events``."""
    rows = A.dense_events(spark, sf_dir)
    uid = F.split_part("session_id", F.lit("-"), F.lit(2)).cast("bigint")
    return rows.select("project_id", uid.alias("uid"), "timestamp")


@register(
    "session_window_30min",
    f"WITH {_DENSE_F0}, {_visits(30)} SELECT project_id, uid, started_at, last_active_at, event_count FROM visits",
)
def session_window_30min(spark, sf_dir):
    return sessions.session_windows(_dense_activity(spark, sf_dir), ["project_id", "uid"])


def _versions(rows: DataFrame) -> DataFrame:
    """Three versions of each session row, as repeated recomputation would append them."""
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("version")).select(
        *[c for c in rows.columns if c not in ("updated_at", "event_count")],
        (F.col("event_count") + F.col("version")).alias("event_count"),
        (F.col("updated_at") + F.col("version") * F.expr("INTERVAL 1 HOUR")).alias("updated_at"),
    )


@register(
    "latest_sessions",
    f"""WITH {Q.flat(ts=Q.DENSE_TS)}
    SELECT project_id, session_id, count(*)::BIGINT + 2 AS event_count, {Q.NOW} + INTERVAL 2 HOURS AS updated_at
    FROM f GROUP BY 1, 2""",
)
def latest_sessions(spark, sf_dir):
    rows = sessions.sessions(A.dense_events(spark, sf_dir), A.as_of())
    return sessions.latest_sessions(_versions(rows)).select("project_id", "session_id", "event_count", "updated_at")


@register(
    "dedupe_events",
    f"WITH {Q.flat()} SELECT {Q.FLAT_LIST} FROM f",
)
def dedupe_events(spark, sf_dir):
    """Every third event delivered twice more, stored later and with other data; the first delivery stays."""
    copies = F.when(F.crc32("event_id") % 3 == 0, 2).otherwise(0)
    late = F.col("_n") > 0
    delivered = (
        A.flat_events(spark, sf_dir)
        .withColumn("_n", F.explode(F.sequence(F.lit(0), copies)))
        .withColumn("created_at", F.col("created_at") + F.col("_n") * F.expr("INTERVAL 1 MINUTE"))
        .withColumn("data", F.when(late, "{}").otherwise(F.col("data")))
    )
    return dedupe.dedupe_events(delivered.drop("_n"))


@register(
    "sample_high_volume",
    f"""WITH {Q.flat(typed=True)} SELECT event_id, event_type, session_id FROM f
    WHERE NOT list_contains({Q.text_list(S.HIGH_VOLUME_TYPES)}, event_type)
       OR ('0x' || substr(md5(session_id), 1, 8))::BIGINT % 100 < 25""",
)
def sample_high_volume(spark, sf_dir):
    kept = dedupe.sample_high_volume(A.flat_events(spark, sf_dir, typed=True), 25)
    return kept.select("event_id", "event_type", "session_id")


# --- quality ----------------------------------------------------------------------------------

_MINUTES = """m AS (
    SELECT date_trunc('minute', received_at) AS timestamp, sum(received)::BIGINT AS events_received,
           sum(accepted)::BIGINT AS events_validated, sum(rejected)::BIGINT AS events_failed_validation,
           count(*)::BIGINT AS batches_received, count(*) FILTER (WHERE accepted > 0)::BIGINT AS batches_sent_to_redpanda,
           sum(accepted)::BIGINT AS events_sent_to_redpanda, 0::BIGINT AS redpanda_send_errors,
           0::BIGINT AS clickhouse_inserts, 0::BIGINT AS clickhouse_insert_errors,
           round(coalesce(avg(latency_ms) FILTER (WHERE code IS NULL), 0), 4) AS ingest_latency_mean_ms,
           0::DOUBLE AS redpanda_latency_mean_ms, 0::DOUBLE AS clickhouse_latency_mean_ms,
           0::BIGINT AS active_connections, 0::BIGINT AS queue_depth, 0::BIGINT AS backpressure_active
    FROM o GROUP BY 1)"""


def _minute_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.metrics_by_minute(ingest.outcomes_by_batch(A.raw_batches(spark, sf_dir)))
    return rows.withColumn("ingest_latency_mean_ms", F.round("ingest_latency_mean_ms", 4))


@register("metrics_snapshot", f"WITH {Q.OUTCOMES}, {_MINUTES} SELECT * FROM m")
def metrics_snapshot(spark, sf_dir):
    return tables.conform(_minute_metrics(spark, sf_dir), "internal_metrics")


@register(
    "metrics_cumulative",
    f"""WITH {Q.OUTCOMES}, {_MINUTES} SELECT * REPLACE (
        {", ".join(f"sum({c}) OVER (ORDER BY timestamp ROWS UNBOUNDED PRECEDING)::BIGINT AS {c}" for c in S.COUNTERS)})
    FROM m""",
)
def metrics_cumulative(spark, sf_dir):
    return quality.cumulative_metrics(_minute_metrics(spark, sf_dir))


_BOUNDS = S.LATENCY_BOUNDS_MS


@register(
    "latency_histogram",
    f"""WITH {Q.OUTCOMES}, bounds AS (SELECT unnest({_BOUNDS})::BIGINT AS bound_ms),
    x AS (SELECT coalesce((SELECT min(bound_ms) FROM bounds WHERE latency_ms <= bound_ms), 10000) AS bound_ms, latency_ms FROM o WHERE success),
    t AS (SELECT count(*)::BIGINT AS total, sum(latency_ms)::BIGINT AS sum, avg(latency_ms) AS mean FROM o WHERE success)
    SELECT bounds.bound_ms, count(x.latency_ms)::BIGINT AS count, any_value(total) AS total, any_value(sum) AS sum,
           round(any_value(mean), 4) AS mean
    FROM bounds LEFT JOIN x USING (bound_ms) CROSS JOIN t GROUP BY bounds.bound_ms""",
)
def latency_histogram(spark, sf_dir):
    found = quality.latency_histogram(ingest.outcomes_by_batch(A.raw_batches(spark, sf_dir)).filter("success"))
    return found.withColumn("mean", F.round("mean", 4))


@register(
    "latency_summary",
    f"""WITH {Q.OUTCOMES} SELECT project_id, count(latency_ms)::BIGINT AS count, min(latency_ms) AS min_ms,
        max(latency_ms) AS max_ms, round(avg(latency_ms), 4) AS mean_ms, round(quantile_cont(latency_ms, 0.5), 4) AS p50_ms,
        round(quantile_cont(latency_ms, 0.95), 4) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 4) AS p99_ms
    FROM o WHERE success GROUP BY project_id""",
)
def latency_summary(spark, sf_dir):
    passed = ingest.outcomes_by_batch(A.raw_batches(spark, sf_dir)).filter("success")
    found = quality.latency_summary(passed, ["project_id"])
    rounded = ["mean_ms", "p50_ms", "p95_ms", "p99_ms"]
    return found.select(*[F.round(c, 4).alias(c) if c in rounded else F.col(c) for c in found.columns])


def _latency_sketches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Successful batches, and their latencies sketched by minute and merged over all time."""
    passed = ingest.outcomes_by_batch(A.raw_batches(spark, sf_dir)).filter("success")
    minutes = quality.latency_sketches(passed, ["project_id"])
    return passed, quality.merge_latency_sketches(quality.merge_latency_sketches(minutes, ["project_id"]), ["project_id"], "year")


@register("latency_summary_sketch")
def latency_summary_sketch(spark, sf_dir):
    return quality.sketch_summary(_latency_sketches(spark, sf_dir)[1], ["project_id", "time"])


@register(
    "latency_summary_sketch_error",
    f"""WITH {Q.OUTCOMES} SELECT project_id, date_trunc('year', received_at)::TIMESTAMP AS time, count(latency_ms)::BIGINT AS count,
        min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, round(avg(latency_ms), 4) AS mean_ms,
        TRUE AS p50_close, TRUE AS p95_close, TRUE AS p99_close
    FROM o WHERE success GROUP BY 1, 2""",
)
def latency_summary_sketch_error(spark, sf_dir):
    """The ranks of the percentiles of ``latency_summary_sketch`` among all latencies: within a hundredth, or one row."""
    passed, sketches = _latency_sketches(spark, sf_dir)
    keys = ["project_id", "time"]
    found = quality.sketch_summary(sketches, keys)
    rows = passed.select("project_id", F.date_trunc("year", "received_at").alias("time"), "latency_ms")
    ranks = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    counted = rows.join(found.select(*keys, *[f"{p}_ms" for p in ranks]), keys).groupBy(*keys).agg(
        *[F.count_if(F.col("latency_ms") < F.col(f"{p}_ms")).alias(f"{p}_below") for p in ranks],
        *[F.count_if(F.col("latency_ms") <= F.col(f"{p}_ms")).alias(f"{p}_to") for p in ranks],
    )
    slack = F.greatest(F.col("count") * 0.01, F.lit(1.0))
    close = [
        (F.col("count") * rank).between(F.col(f"{p}_below") - slack, F.col(f"{p}_to") + slack).alias(f"{p}_close")
        for p, rank in ranks.items()
    ]
    return found.join(counted, keys).select(*keys, "count", "min_ms", "max_ms", F.round("mean_ms", 4).alias("mean_ms"), *close)


# Tables written in one, two, three files and so on.
_SPLIT = ["region", "nation", "supplier", "customer", "part", "orders"]
_SPLIT_FILES = " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", {k}::BIGINT AS files, count(*)::BIGINT AS rows FROM {n}" for k, n in enumerate(_SPLIT, 1)
)


def _split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File statistics of those tables, written and listed; every file counts as small."""
    root, listed = shared_dir(spark, "files"), []
    for k, name in enumerate(_SPLIT, 1):
        A.table(spark, sf_dir, name).repartition(k).write.parquet(f"{root}/{name}")
        listed.append(reads.file_sizes(spark.read.parquet(f"{root}/{name}"), name))
    return quality.file_stats(reduce(DataFrame.unionByName, listed), small_bytes=2**50)


@register("file_stats", _SPLIT_FILES)
def file_stats(spark, sf_dir):
    """Data files of tables written in different numbers of files."""
    return _split_files(spark, sf_dir).select("table", "files", "rows")


@register("high_file_count_tables", f"SELECT * FROM ({_SPLIT_FILES}) WHERE files > 3")
def high_file_count_tables(spark, sf_dir):
    """With a limit that half of them exceed."""
    return quality.high_file_count(_split_files(spark, sf_dir), 3).select("table", "files", "rows")


def _payload_sql(time: str, kind: str, fields: str) -> str:
    return (
        f"""'{{"timestamp":"' || strftime({time}, '%Y-%m-%dT%H:%M:%S') || '+00:00","source":"event-engine","""
        f""""notification":{{"type":"{kind}",' || {fields} || '}}}}'"""
    )


_RATE_MESSAGE = "'High validation error rate: ' || printf('%.2f', events_failed_validation / events_received * 100) || '%'"
_ERROR_FIELDS = f"""'"message":"' || {_RATE_MESSAGE} || '","severity":"warning"'"""
_SYSTEM_ALERTS = f"""SELECT timestamp, 'system_alert' AS kind, 'error_rate' AS key, 'warning' AS severity, {_RATE_MESSAGE} AS message,
        {_payload_sql("timestamp", "system_alert", _ERROR_FIELDS)} AS payload
    FROM d WHERE events_received > 100 AND events_failed_validation / events_received > 0.1"""
_LOADED = "'Backpressure active - system under load'"
_LOADED_FIELDS = f"""'"message":"' || {_LOADED} || '","severity":"warning"'"""
_SYSTEM_ALERTS += f""" UNION ALL SELECT timestamp, 'system_alert', 'backpressure', 'warning', {_LOADED},
        {_payload_sql("timestamp", "system_alert", _LOADED_FIELDS)} FROM d WHERE backpressure_active > 0"""
_DAYS = """d AS (SELECT date_trunc('day', received_at) AS timestamp, sum(received)::BIGINT AS events_received,
    sum(rejected)::BIGINT AS events_failed_validation, max((coalesce(code, '') = 'VALID_002')::INT) AS backpressure_active FROM o GROUP BY 1)"""
_DISK_FIELDS = """'"disk_name":"' || name || '","usage_percent":' || round(100 - free_space / total_space * 100, 2)
    || ',"free_gb":' || CAST(floor(free_space / 1000000000) AS BIGINT)"""


def _daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics per day, so that enough events fall into one row; a day that refused a batch for its size is under load."""
    found = ingest.outcomes_by_batch(G.guard_bodies(spark, sf_dir))
    return found.groupBy(F.date_trunc("day", "received_at").alias("timestamp")).agg(
        F.sum("received").alias("events_received"),
        F.sum("rejected").alias("events_failed_validation"),
        F.max((F.coalesce("code", F.lit("")) == "VALID_002").cast("int")).alias("backpressure_active"),
    )


@register(
    "alerts",
    f"""WITH {G.guard_outcomes()}, {Q.DISKS}, {_DAYS}
    {_SYSTEM_ALERTS}
    UNION ALL
    SELECT {Q.NOW}, 'disk_usage', name, 'warning', 'Disk usage high', {_payload_sql(Q.NOW, "disk_usage", _DISK_FIELDS)}
    FROM disks WHERE total_space > 0 AND 100 - free_space / total_space * 100 > 85""",
)
def alerts(spark, sf_dir):
    return quality.alerts(_daily_metrics(spark, sf_dir), D.disks(spark, sf_dir), A.as_of())


@register(
    "alert_cooldown",
    f"""WITH {G.guard_outcomes()}, {_DAYS}, a AS ({_SYSTEM_ALERTS})
    SELECT timestamp, kind, key, message FROM a
    QUALIFY lag(timestamp) OVER (PARTITION BY kind, key ORDER BY timestamp) IS NULL
         OR timestamp - lag(timestamp) OVER (PARTITION BY kind, key ORDER BY timestamp) > INTERVAL 1 DAY""",
)
def alert_cooldown(spark, sf_dir):
    found = quality.system_alerts(_daily_metrics(spark, sf_dir))
    return quality.alert_cooldown(found, 24 * 60).select("timestamp", "kind", "key", "message")


@register(
    "tenant_alerts",
    f"""WITH {Q.flat()}, {_MAU}, {Q.POLICIES}, {Q.OUTCOMES.removeprefix(Q.BASE + ", ")}, x AS (
        SELECT project_id, sum(received) AS received, sum(rejected) AS rejected FROM o GROUP BY 1), y AS (
        SELECT project_id, floor((raw_hours * 3600000 - (epoch_us({Q.NOW}) // 1000 - epoch_us(min(timestamp)) // 1000)) / 86400000)::BIGINT AS days
        FROM f JOIN p USING (project_id) GROUP BY project_id, raw_hours)
    SELECT 'high_error_rate' AS kind, project_id AS tenant_id, round(rejected / received, 6) AS value, 0.1::DOUBLE AS threshold,
           NULL::BIGINT AS days_remaining FROM x WHERE received > 100 AND rejected / received > 0.1
    UNION ALL
    SELECT 'quota_warning', project_id, round(active_users / mau_limit * 100, 6), 80, NULL FROM mau
    WHERE month = '202401' AND active_users / mau_limit * 100 >= 80
    UNION ALL
    SELECT 'retention_warning', project_id, NULL, 60, days FROM y WHERE days BETWEEN 0 AND 60""",
)
def tenant_alerts(spark, sf_dir):
    events = A.flat_events(spark, sf_dir)
    mau = quality.current_month(rollups.mau_status(events, D.mau_limits(spark, sf_dir)), A.as_of())
    oldest = quality.oldest_rows(events, retention.effective_retention(D.policies(spark, sf_dir)))
    found = quality.tenant_alerts(
        ingest.outcomes_by_batch(A.raw_batches(spark, sf_dir)), mau, oldest, A.as_of(), warn_days=60
    )
    return found.withColumn("value", F.round("value", 6))


# --- retention ------------------------------------------------------------------------------

_SPREAD = Q.flat(ts=Q.SPREAD_TS)
_STATS_SQL = """st AS (SELECT strftime(timestamp, '%Y%m') AS partition, count(*)::BIGINT AS rows,
    sum(strlen(data))::BIGINT AS bytes FROM f GROUP BY 1)"""
_SIZE = """CASE WHEN bytes >= 1073741824 THEN printf('%.2f GB', bytes / 1073741824) WHEN bytes >= 1048576
    THEN printf('%.2f MB', bytes / 1048576) WHEN bytes >= 1024 THEN printf('%.2f KB', bytes / 1024)
    ELSE bytes || ' B' END"""
_CUTOFF = f"strftime({Q.NOW} - INTERVAL 3 MONTHS, '%Y%m')"


@register("partition_stats", f"WITH {_SPREAD}, {_STATS_SQL} SELECT * FROM st")
def partition_stats(spark, sf_dir):
    return retention.partition_stats(A.spread_events(spark, sf_dir))


@register("expired_partitions", f"WITH {_SPREAD}, {_STATS_SQL} SELECT *, {_SIZE} AS size FROM st WHERE partition < {_CUTOFF}")
def expired_partitions(spark, sf_dir):
    return retention.expired_partitions(
        retention.partition_stats(A.spread_events(spark, sf_dir)), A.as_of(), S.DATA_TABLE_KEEP_MONTHS
    )


@register(
    "retention_survivors",
    f"WITH {_SPREAD} SELECT event_id, project_id, timestamp FROM f WHERE strftime(timestamp, '%Y%m') >= {_CUTOFF}",
)
def retention_survivors(spark, sf_dir):
    kept = retention.survivors(A.spread_events(spark, sf_dir), A.as_of(), S.DATA_TABLE_KEEP_MONTHS)
    return kept.select("event_id", "project_id", "timestamp")


@register(
    "retention_cutoffs",
    f"""WITH {_SPREAD}, days AS (SELECT DISTINCT timestamp::DATE AS as_of FROM f)
    SELECT as_of, keep::BIGINT AS keep_months, strftime(as_of - to_months(keep), '%Y%m') AS cutoff
    FROM days CROSS JOIN (SELECT unnest([1, 3]) AS keep)""",
)
def retention_cutoffs(spark, sf_dir):
    """The cutoff month of both table groups, had retention run on each day of the data."""
    days = A.spread_events(spark, sf_dir).select(F.to_date("timestamp").alias("as_of")).distinct()
    keeps = F.array(F.lit(S.METRICS_KEEP_MONTHS), F.lit(S.DATA_TABLE_KEEP_MONTHS))
    rows = days.select("as_of", F.explode(keeps).alias("keep_months"))
    return rows.withColumn("cutoff", cutoff_month(F.col("as_of"), F.col("keep_months")))


@register("effective_retention", f"WITH {Q.POLICIES} SELECT * FROM p")
def effective_retention(spark, sf_dir):
    return retention.effective_retention(D.policies(spark, sf_dir))


_AGE = f"(epoch_us({Q.NOW}) // 1000 - epoch_us(timestamp) // 1000)"


@register(
    "tier_retention",
    f"""WITH {Q.flat()}, {Q.POLICIES}
    SELECT event_id, project_id, timestamp, coalesce({_AGE} > raw_hours * 3600000, FALSE) AS expired
    FROM f LEFT JOIN p USING (project_id)""",
)
def tier_retention(spark, sf_dir):
    rows = A.flat_events(spark, sf_dir).select("event_id", "project_id", "timestamp")
    return retention.tier_retention(rows, D.policies(spark, sf_dir), A.as_of())


@register(
    "compress_free_tier",
    f"""WITH {Q.flat()}, {Q.POLICIES}
    {_DAILY} FROM f JOIN p USING (project_id) WHERE tier = 'free' AND {_AGE} > compress_hours * 3600000 GROUP BY 1, 2, 3""",
)
def compress_free_tier(spark, sf_dir):
    return retention.compress(A.flat_events(spark, sf_dir), D.policies(spark, sf_dir), A.as_of())


@register(
    "cold_export",
    f"""WITH {Q.flat()}, {Q.POLICIES}
    SELECT project_id, strftime(timestamp, '%Y%m') AS month, event_id, data
    FROM f JOIN p USING (project_id) WHERE {_AGE} > raw_hours * 3600000""",
)
def cold_export(spark, sf_dir):
    cold = maintenance.cold_rows(A.flat_events(spark, sf_dir), D.policies(spark, sf_dir), A.as_of())
    return cold.select("project_id", month(F.col("timestamp")).alias("month"), "event_id", "data")


_RANGE = "timestamp >= TIMESTAMP '2024-01-01 06:00:00' AND timestamp < TIMESTAMP '2024-01-01 18:00:00'"


@register(
    "backfill_range",
    f"""WITH {Q.flat(ts=Q.DENSE_TS)}, w AS (SELECT * FROM f WHERE {_RANGE}),
    d AS (SELECT project_id, count(*) AS daily_rows, sum(c) AS events_processed FROM (
        SELECT project_id, timestamp::DATE, event_type, count(*) AS c FROM w GROUP BY 1, 2, 3) GROUP BY 1),
    h AS (SELECT project_id, count(*) AS hourly_rows FROM (
        SELECT DISTINCT project_id, date_trunc('hour', timestamp), event_type FROM w) GROUP BY 1),
    s AS (SELECT project_id, count(DISTINCT session_id) AS sessions_recomputed FROM w GROUP BY 1)
    SELECT project_id, daily_rows::BIGINT AS daily_rows, events_processed::BIGINT AS events_processed,
           hourly_rows::BIGINT AS hourly_rows, sessions_recomputed::BIGINT AS sessions_recomputed
    FROM d JOIN h USING (project_id) JOIN s USING (project_id)""",
)
def backfill_range(spark, sf_dir):
    start, end = (F.lit(f"2024-01-01 {h}:00:00").cast("timestamp") for h in ("06", "18"))
    parts = maintenance.backfill(A.dense_events(spark, sf_dir), None, start, end, A.as_of())
    return maintenance.backfill_report(parts)


_LOST = "project_id = 'proj-3' AND timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-12'"


@register("reconcile_rollups", f"WITH {Q.flat()}, k AS (SELECT * FROM f WHERE NOT ({_LOST})) {_DAILY} FROM k GROUP BY 1, 2, 3")
def reconcile_rollups(spark, sf_dir):
    """All days stored, then two days of a project that lost their events recomputed, and the table read back."""
    root, events = shared_dir(spark, "reconcile"), A.flat_events(spark, sf_dir)
    reconcile.reconcile(events, root, None, dt.date(2024, 1, 1), dt.date(2024, 2, 1))
    left = events.filter(~F.expr(_LOST))
    reconcile.reconcile(left, root, "proj-3", dt.date(2024, 1, 9), dt.date(2024, 1, 13))
    return reconcile.read(spark, root, "daily_rollup")


# --- legacy events -------------------------------------------------------------------------------

_LEGACY = f"""{Q.BASE}, l0 AS (
    SELECT *, {Q.pick(S.LEGACY_TYPES, "eid")} AS type_,
           CASE WHEN eid % 50 = 0 THEN ms - 6000 WHEN eid % 53 = 0 THEN ms + 90000000 ELSE ms + 1000 END AS received FROM b),
    l AS (SELECT *,
           CASE WHEN eid % 71 = 0 THEN 'type is not known' WHEN eid % 73 = 0 THEN 'id is not a UUID' END AS decode_error,
           CASE WHEN eid % 71 = 0 THEN 'type is not known' WHEN eid % 73 = 0 THEN 'id is not a UUID'
                WHEN eid % 61 = 0 THEN 'user_id is longer than 128 characters'
                WHEN eid % 50 = 0 THEN 'timestamp cannot be more than 5s in the future'
                WHEN eid % 53 = 0 THEN 'timestamp cannot be more than 24h in the past'
                WHEN eid % 46 = 0 THEN 'metadata: language is out of range'
                WHEN type_ = 'pageview' AND eid % 43 = 0 THEN 'pageview: title is out of range'
                WHEN type_ = 'scroll' AND eid % 41 = 0 THEN 'scroll: scroll_depth is out of range'
                WHEN type_ = 'performance' AND eid % 37 = 0 THEN 'performance: cls is out of range' END AS error
    FROM l0)"""


def _uuid_sql(text: str) -> str:
    return f"regexp_replace(md5({text}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


@register("legacy_validate", f"WITH {_LEGACY} SELECT eid AS record_no, error IS NULL AS ok, error FROM l")
def legacy_validate(spark, sf_dir):
    validated = legacy.validate(legacy.decode(legacy_records(spark, sf_dir)))
    return validated.select("record_no", F.col("error").isNull().alias("ok"), "error")


@register(
    "legacy_batches",
    f"""WITH {_LEGACY} SELECT eid // 20 AS batch_id, count(*)::BIGINT AS events, count(error)::BIGINT AS failed,
        count(*) BETWEEN 1 AND 1000 AS accepted FROM l GROUP BY 1""",
)
def legacy_batches(spark, sf_dir):
    return legacy.batch_errors(legacy.validate(legacy.decode(legacy_records(spark, sf_dir))))


@register(
    "legacy_batch_messages",
    f"""WITH {_LEGACY} SELECT eid // 20 AS batch_id, eid % 20 AS idx,
        'validation error: event[' || (eid % 20) || ']: validation error: ' || error AS message FROM l WHERE error IS NOT NULL""",
)
def legacy_batch_messages(spark, sf_dir):
    return legacy.batch_messages(legacy.validate(legacy.decode(legacy_records(spark, sf_dir))))


def _of(kind: str, value: str, cast: str) -> str:
    return f"CASE WHEN type_ = '{kind}' THEN {value} END::{cast}"


def _meta(value: str, cast: str) -> str:
    return f"CASE WHEN eid % 2 = 0 THEN {value} END::{cast}"


_LEGACY_FLAT = f"""SELECT {_uuid_sql("'e' || eid")} AS id, {_uuid_sql("'t' || (uid % 7)")} AS tenant_id,
    {_uuid_sql("'s' || session_id")} AS session_id,
    CASE WHEN eid % 61 = 0 THEN repeat('u', 129) ELSE user_id END AS user_id, type_ AS event_type, ms AS timestamp,
    received AS received_at,
    {_of("pageview", "CASE WHEN eid % 43 = 0 THEN repeat('t', 501) ELSE 'Page ' || k END", "VARCHAR")} AS page_title,
    {_of("pageview", "'/p/' || k", "VARCHAR")} AS page_path, {_of("pageview", "cents", "DOUBLE")} AS load_time,
    {_of("pageview", "CASE WHEN k % 2 = 0 THEN value END", "DOUBLE")} AS time_to_first_byte, NULL::VARCHAR AS referrer,
    {_of("click", "'button'", "VARCHAR")} AS click_element, {_of("click", "'#b' || k", "VARCHAR")} AS click_selector,
    {_of("click", "CASE WHEN eid % 3 = 0 THEN k END", "DOUBLE")} AS click_x,
    {_of("click", "CASE WHEN eid % 3 = 0 THEN value END", "DOUBLE")} AS click_y,
    {_of("click", "CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END", "BIGINT")} AS is_double_click,
    {_of("click", "'Buy'", "VARCHAR")} AS click_text,
    {_of("scroll", "CASE WHEN eid % 41 = 0 THEN k + 101 ELSE k END", "DOUBLE")} AS scroll_depth,
    {_of("scroll", "CASE WHEN k % 2 = 0 THEN 'up' ELSE 'down' END", "VARCHAR")} AS scroll_direction,
    {_of("scroll", "CASE WHEN k % 2 = 0 THEN 'main' END", "VARCHAR")} AS scroll_element,
    {_of("performance", "value", "DOUBLE")} AS perf_lcp, NULL::DOUBLE AS perf_fid,
    {_of("performance", "CASE WHEN eid % 37 = 0 THEN 11.0 ELSE k / 100 END", "DOUBLE")} AS perf_cls,
    NULL::DOUBLE AS perf_ttfb, NULL::DOUBLE AS perf_fcp, NULL::DOUBLE AS perf_dom_content_loaded,
    NULL::DOUBLE AS perf_load_complete, {_of("performance", "k", "BIGINT")} AS perf_resource_count,
    {_of("performance", "cents", "BIGINT")} AS perf_memory_usage,
    {_of("custom", "kind", "VARCHAR")} AS custom_event_name,
    {_of("custom", "'{" + chr(34) + "k" + chr(34) + ":' || k || '}'", "VARCHAR")} AS custom_properties,
    {_meta("'agent'", "VARCHAR")} AS user_agent, {_meta("'10.0.0.' || k", "VARCHAR")} AS ip,
    {_meta("1280", "BIGINT")} AS screen_width, NULL::BIGINT AS screen_height, NULL::BIGINT AS viewport_width,
    NULL::BIGINT AS viewport_height, {_meta("2", "DOUBLE")} AS device_pixel_ratio, {_meta("'UTC'", "VARCHAR")} AS timezone,
    {_meta("CASE WHEN eid % 46 = 0 THEN repeat('l', 17) ELSE 'en' END", "VARCHAR")} AS language
    FROM l WHERE decode_error IS NULL"""


@register("legacy_flatten", f"WITH {_LEGACY} {_LEGACY_FLAT}")
def legacy_flatten(spark, sf_dir):
    return legacy.flatten(legacy.decode(legacy_records(spark, sf_dir)))
