"""The adapters' arithmetic once more, as DuckDB common table expressions."""

from __future__ import annotations

from tidegauge import schemas as S
from workload.adapters import AS_OF, USER_AGENTS

NOW = f"TIMESTAMP '{AS_OF}'"


def text_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values: list[str], index: str) -> str:
    return f"({text_list(values)})[({index}) % {len(values)} + 1]"


BASE = """b AS (
    SELECT event_id AS eid, user_id AS uid, ts, (epoch_us(ts) // 1000)::BIGINT AS ms, event_type AS kind, value,
           CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
           'proj-' || (user_id % 7) AS project_id,
           's-' || user_id || '-' || strftime(ts, '%Y%m%d') AS session_id,
           CASE WHEN event_id % 10 <> 0 THEN user_id::VARCHAR END AS user_id
    FROM events)"""

MAPPED = "CASE WHEN kind = 'view' THEN 'pageview' WHEN kind IN ('click', 'error') THEN kind ELSE 'custom' END"
TYPED = pick(S.EVENT_TYPES, "eid")


def flat(typed: bool = False, ts: str = "ts") -> str:
    """``b`` and ``f``: the flat events; ``f`` also keeps the source numbers."""
    kind = TYPED if typed else MAPPED
    return f"""{BASE}, f0 AS (SELECT * REPLACE ({ts} AS ts) FROM b), f AS (
    SELECT 'e-' || eid AS event_id, project_id, session_id, user_id, {kind} AS event_type,
           CASE WHEN {kind} = 'custom' THEN kind END AS custom_name, ts AS timestamp,
           'https://example.com/p/' || (eid % 50) AS url, '/p/' || (eid % 50) AS path,
           CASE WHEN eid % 6 = 0 THEN 'https://search.example.org/' ELSE '' END AS referrer,
           {pick(USER_AGENTS, "eid")} AS user_agent,
           CASE WHEN eid % 8 = 0 THEN 'tablet' ELSE 'unknown' END AS device_type,
           'unknown' AS browser, 'unknown' AS browser_version, 'unknown' AS os,
           CASE WHEN eid % 4 <> 0 THEN 'C' || (uid % 5) ELSE 'unknown' END AS country,
           CASE WHEN eid % 4 <> 0 AND eid % 3 = 0 THEN 'R' || (uid % 3) END AS region,
           NULL::VARCHAR AS city, '{{"cents":' || cents || ',"k":' || k || '}}' AS data, ts AS created_at,
           eid, uid, kind, k, cents, value, ms
    FROM f0)"""


DENSE_TS = (
    "make_timestamp((epoch_us(TIMESTAMP '2024-01-01 00:00:00') + "
    "CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 20) AS BIGINT))::BIGINT)"
)
SPREAD_TS = "ts - to_months(CAST(eid % 12 AS INTEGER))"
FLAT_COLUMNS = [part.split()[0] for part in S.TABLES["events"].split(",")]
FLAT_LIST = ", ".join(FLAT_COLUMNS)

# Events inside their request batches: position, receive time, whole-batch faults, event faults.
BATCHED = f"""{BASE}, n AS (
    SELECT *, eid // 20 AS bno, (eid // 20) % 3 AS form,
           CASE WHEN (eid // 20) % 3 = 2 THEN -1 - eid ELSE eid // 20 END AS batch_id
    FROM b), r AS (
    SELECT *, max(ms) OVER (PARTITION BY batch_id) + 1000 AS rms,
           CAST(row_number() OVER (PARTITION BY batch_id ORDER BY eid) - 1 AS BIGINT) AS idx,
           bno % 71 = 0 AS cut,
           bool_or(eid % 997 = 0 OR eid % 991 = 0) OVER (PARTITION BY batch_id) AS mistyped
    FROM n), e AS (
    SELECT *, 'proj-' || (bno % 7) AS batch_project, cut OR mistyped AS bad_batch,
           {MAPPED} AS event_type,
           CASE WHEN eid % 50 = 0 THEN rms + 6000 WHEN eid % 53 = 0 THEN rms - 90000000 ELSE ms END AS sent_ms,
           CASE WHEN cut OR mistyped THEN NULL
                WHEN eid % 61 = 0 THEN 'userId is longer than 128 characters'
                WHEN eid % 59 = 0 THEN 'url is required'
                WHEN eid % 50 = 0 THEN 'timestamp cannot be more than 5s in the future'
                WHEN eid % 53 = 0 THEN 'timestamp cannot be more than 24h in the past'
           END AS error
    FROM r)"""

BATCH_FLAT = f"""{BATCHED}, g AS (
    SELECT 'e-' || eid AS event_id, batch_project AS project_id, session_id, user_id, event_type,
           CASE WHEN event_type = 'custom' THEN kind END AS custom_name,
           make_timestamp(sent_ms * 1000) AS timestamp,
           'https://example.com/p/' || (eid % 50) || '?q=1' AS url,
           CASE WHEN eid % 7 = 0 THEN '/given' ELSE '/p/' || (eid % 50) END AS path,
           CASE WHEN eid % 5 = 0 THEN 'https://search.example.org/' ELSE '' END AS referrer,
           {pick(USER_AGENTS, "eid")} AS user_agent,
           CASE WHEN eid % 4 <> 0 THEN 'desktop' ELSE 'unknown' END AS device_type,
           CASE WHEN eid % 4 <> 0 THEN 'Firefox' ELSE 'unknown' END AS browser,
           CASE WHEN eid % 4 <> 0 THEN (eid % 100) || '.0' ELSE 'unknown' END AS browser_version,
           CASE WHEN eid % 4 <> 0 AND eid % 3 <> 0 THEN 'Linux' ELSE 'unknown' END AS os,
           CASE WHEN eid % 6 <> 0 THEN 'C' || (uid % 5) ELSE 'unknown' END AS country,
           CASE WHEN eid % 6 <> 0 AND eid % 3 = 0 THEN 'R' || (uid % 3) END AS region,
           NULL::VARCHAR AS city,
           '{{"cents":' || cents || ',"k":' || k ||
             CASE WHEN event_type = 'custom' THEN ',"name":"' || kind || '","properties":{{"k":' || k || '}}' ELSE '' END
             || '}}' AS data,
           make_timestamp(rms * 1000) AS created_at
    FROM e WHERE NOT bad_batch AND error IS NULL)"""

OUTCOMES = f"""{BATCHED}, o AS (
    SELECT batch_id, any_value(batch_project) AS project_id, make_timestamp(any_value(rms) * 1000) AS received_at,
           CASE WHEN any_value(cut) THEN NULL ELSE (['array', 'wrapper', 'single'])[any_value(form) + 1] END AS shape,
           CASE WHEN any_value(bad_batch) THEN 0 ELSE count(*) END::BIGINT AS received,
           count(*) FILTER (WHERE NOT bad_batch AND error IS NULL)::BIGINT AS accepted,
           count(error)::BIGINT AS rejected,
           CASE WHEN any_value(bad_batch) THEN 'VALID_001' END AS code,
           CASE WHEN any_value(bad_batch) THEN 400 ELSE 200 END::BIGINT AS http_status,
           NOT any_value(bad_batch) AS success,
           coalesce(string_agg('validation error: event[' || idx || ']: validation error: ' || error, ' | '
                    ORDER BY idx) FILTER (WHERE error IS NOT NULL), '') AS errors,
           (any_value(bno) * 37 % 12000)::BIGINT AS latency_ms
    FROM e GROUP BY batch_id)"""

# The user agent read back from its text.
AGENT = """
    CASE WHEN user_agent LIKE '%Googlebot%' THEN 'Googlebot' WHEN user_agent LIKE '%Chrome/%' THEN 'Chrome'
         WHEN user_agent LIKE '%Firefox/%' THEN 'Firefox' WHEN user_agent LIKE '%Safari/%' THEN 'Safari'
         ELSE browser END AS browser,
    CASE WHEN user_agent LIKE '%Chrome/%' THEN regexp_extract(user_agent, 'Chrome/([0-9.]+)', 1)
         WHEN user_agent LIKE '%Firefox/%' THEN regexp_extract(user_agent, 'Firefox/([0-9.]+)', 1)
         WHEN user_agent LIKE '%Safari/%' THEN regexp_extract(user_agent, 'Version/([0-9.]+)', 1)
         ELSE browser_version END AS browser_version,
    CASE WHEN user_agent LIKE '%Macintosh%' THEN 'Mac OSX' WHEN user_agent LIKE '%Windows NT 10.0%' THEN 'Windows 10'
         WHEN user_agent LIKE '%iPhone;%' THEN 'iPhone' WHEN user_agent LIKE '%X11; Linux%' THEN 'Linux'
         ELSE os END AS os,
    CASE WHEN device_type NOT IN ('', 'unknown') THEN device_type WHEN user_agent LIKE '%Googlebot%' THEN 'bot'
         WHEN user_agent LIKE '%iPhone%' THEN 'mobile' WHEN user_agent LIKE 'Mozilla%' THEN 'desktop'
         ELSE device_type END AS device_type"""
ENRICHED_LIST = ", ".join(c for c in FLAT_COLUMNS if c not in ("browser", "browser_version", "os", "device_type"))

TIERS = text_list(list(S.TIERS))


def tier_case(setting: str) -> str:
    return "CASE tier " + " ".join(f"WHEN '{t}' THEN {v[setting]}" for t, v in S.TIERS.items()) + " END"


TENANTS = f"""tenants AS (
    SELECT 'proj-' || c_custkey AS id, ({TIERS})[c_custkey % 3 + 1] AS tier, c_custkey % 10 <> 9 AS active,
           CASE WHEN c_custkey % 4 = 0 THEN 1 END AS rate_limit
    FROM customer)"""
POLICIES = f"""policies AS (
    SELECT 'proj-' || c_custkey AS project_id, ({TIERS})[c_custkey % 3 + 1] AS tier,
           CASE WHEN c_custkey % 4 = 1 THEN 240 END AS raw_override,
           CASE WHEN c_custkey % 6 = 1 THEN 100 END AS aggregate_override,
           CASE WHEN c_custkey % 6 = 3 THEN 48 END AS compress_override
    FROM customer), p AS (
    SELECT project_id, tier, coalesce(raw_override, {tier_case("raw_hours")})::BIGINT AS raw_hours,
           coalesce(aggregate_override, {tier_case("aggregate_hours")})::BIGINT AS aggregate_hours,
           coalesce(compress_override, {tier_case("compress_hours")})::BIGINT AS compress_hours
    FROM policies)"""
DISKS = """disks AS (
    SELECT s_name AS name, '/data/' || s_suppkey AS path,
           CAST(floor((s_acctbal + 1000) * 90000000) AS BIGINT) AS free_space,
           CASE WHEN s_suppkey % 17 = 0 THEN 0 ELSE 1000000000000 END::BIGINT AS total_space
    FROM supplier)"""
