"""Turns the given tables into the engine's inputs, by arithmetic any SQL can repeat.

Nothing here belongs to the library: it is the test bed's data mapping. Every
row of the source tables is used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge import schemas as S
from tidegauge.session import configure

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
AS_OF = "2024-01-31 00:00:00"

USER_AGENTS = [
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_4) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0.6367.91 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; WOW64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/109.0.5414.168 Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 16_5 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/16.5 Mobile/20F66 Safari/604.1",
    "Mozilla/5.0 (X11; Linux x86_64; rv:115.3) Gecko/20100101 Firefox/115.3",
    "Mozilla/5.0 (compatible; Googlebot/2.2; made for this test bed)",
    "teapot, short and stout",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def base(events: DataFrame) -> DataFrame:
    """The source events with the derived numbers every adapter uses."""
    eid, uid = F.col("event_id"), F.col("user_id")
    ts = F.col("ts").cast("timestamp")
    return events.select(
        eid.alias("eid"),
        uid.alias("uid"),
        ts.alias("ts"),
        F.unix_millis(ts).alias("ms"),
        F.col("event_type").alias("kind"),
        F.col("value"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.concat(F.lit("proj-"), uid % 7).alias("project_id"),
        F.concat(F.lit("s-"), uid, F.lit("-"), F.date_format(ts, "yyyyMMdd")).alias("session_id"),
        F.when(eid % 10 != 0, uid.cast("string")).alias("user_id"),
    )


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(table(spark, sf_dir, "events"))


def balanced(built: DataFrame) -> DataFrame:
    """Built bodies are many times the size of their source rows: partitions by their own size, set at run time."""
    return built.hint("rebalance")


def mapped_type(kind: Column | None = None) -> Column:
    kind = F.col("kind") if kind is None else kind
    return F.when(kind == "view", "pageview").when(kind.isin("click", "error"), kind).otherwise(F.lit("custom"))


def typed_type() -> Column:
    return pick(S.EVENT_TYPES, F.col("eid"))


# --- payloads of the 28 types -------------------------------------------------


def _struct(**columns: Column) -> Column:
    return F.struct(*[c.alias(name) for name, c in columns.items()])


def payload_json(event_type: Column, faulty: bool = False) -> Column:
    """JSON payload for a type; with ``faulty`` every fifth event breaks one rule of its type."""
    eid, k, value = F.col("eid"), F.col("k"), F.col("value")
    bad = (eid % 5 == 0) if faulty else F.lit(False)

    def text(value: str) -> Column:
        return F.lit(value)

    position = _struct(x=k, y=value)
    trigger_id = F.concat(F.lit("t-"), k % 10)
    factors = _struct(
        time_on_page=F.col("cents"), scroll_depth=k, click_count=k % 7, mouse_activity=value, focus_time=F.col("cents")
    )
    context = _struct(
        time_on_page=F.col("cents"),
        scroll_depth=k,
        engagement_score=k,
        session_duration=F.col("cents"),
        page_count=F.when(~bad, k % 5),
    )
    form = _struct(form_id=F.concat(F.lit("form-"), k % 5), field_name=F.concat(F.lit("field-"), k % 11))
    payloads = {
        "pageview": _struct(
            title=F.concat(F.lit("Page "), k),
            timeOnPageSeconds=k,
            scroll_depth_percentage=F.when(eid % 3 != 0, k),
            page_load_time_ms=F.col("cents"),
        ),
        "click": _struct(
            x=k,
            y=value,
            selector=F.concat(F.lit("#b"), k),
            target=F.when(eid % 3 == 0, text("_blank")),
            elementText=F.concat(F.lit("Buy "), k),
            element_tag=text("button"),
            element_id=F.concat(F.lit("el-"), k),
            viewport_width=F.lit(1280),
            viewportHeight=F.when(eid % 2 == 0, F.lit(720)),
        ),
        "scroll": _struct(depth=k),
        "mouse_move": _struct(
            position=position,
            velocity=F.when(bad, F.lit(-1)).otherwise(k),
            viewport_x=k,
            viewport_y=value,
        ),
        "form_focus": form,
        "form_blur": form,
        "form_submit": form,
        "form_abandon": form,
        "error": _struct(
            message=F.concat(F.lit("error "), k), stack=text("at main"), line=k, column=k % 13
        ),
        "performance": _struct(
            lcp=value, fid=F.when(eid % 3 == 0, k), cls=k / 1000, ttfb=F.col("cents"), fcp=value
        ),
        "visibility_change": _struct(
            state=F.when(k % 2 == 0, text("hidden")).otherwise(text("visible")),
            hiddenDuration=F.when(k % 2 == 0, F.col("cents")),
        ),
        "resource_load": _struct(
            resource_url=F.concat(F.lit("https://cdn.example.com/r"), k),
            resource_type=text("script"),
            duration=value,
            size=F.col("cents"),
        ),
        "custom": _struct(
            name=F.when(bad, text("")).otherwise(F.col("kind")), properties=_struct(k=k, cents=F.col("cents"))
        ),
        "exit_intent": _struct(
            position=position,
            velocity=k,
            time_on_page=F.col("cents"),
            scroll_depth=F.when(bad, F.lit(101)).otherwise(k),
        ),
        "idle_start": _struct(
            last_activity_type=F.when(bad, text("gaze")).otherwise(text("mouse")), time_on_page=F.col("cents")
        ),
        "idle_end": _struct(
            idle_duration=F.when(~bad, F.col("cents")),
            resume_activity_type=text("touch"),
            time_on_page=F.col("cents"),
        ),
        "engagement_snapshot": _struct(score=F.when(bad, k + 100.5).otherwise(k.cast("double")), factors=factors),
        "trigger_registered": _struct(
            trigger_id=trigger_id,
            condition=text("scroll_depth>50"),
            priority=F.when(bad, F.lit(1001)).otherwise(k),
            once=text("session"),
        ),
        "trigger_fired": _struct(
            trigger_id=trigger_id, condition=text("scroll_depth>50"), priority=k, context=context
        ),
        "trigger_dismissed": _struct(
            trigger_id=trigger_id, method=F.when(bad, text("other")).otherwise(text("snooze")), snooze_duration=k
        ),
        "trigger_action": _struct(
            trigger_id=trigger_id, action_type=F.when(bad, text("")).otherwise(text("click"))
        ),
        "trigger_error": _struct(
            trigger_id=trigger_id, error_type=F.when(bad, text("x")).otherwise(text("storage")), message=text("boom")
        ),
    }
    first, *rest = payloads.items()
    case = F.when(event_type == first[0], F.to_json(first[1]))
    case = reduce(lambda c, item: c.when(event_type == item[0], F.to_json(item[1])), rest, case)
    return case.otherwise(F.lit("{}"))


# --- flat events ----------------------------------------------------------------


def flat(derived: DataFrame, typed: bool = False) -> DataFrame:
    """Rows of the ``events`` table straight from the derived source rows (narrow)."""
    eid = F.col("eid")
    event_type = typed_type() if typed else mapped_type()
    data = payload_json(typed_type()) if typed else F.to_json(F.struct("cents", "k"))
    known_place = eid % 4 != 0
    return derived.select(
        F.concat(F.lit("e-"), eid).alias("event_id"),
        "project_id",
        "session_id",
        "user_id",
        event_type.alias("event_type"),
        F.when(event_type == "custom", F.col("kind")).alias("custom_name"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("https://example.com/p/"), eid % 50).alias("url"),
        F.concat(F.lit("/p/"), eid % 50).alias("path"),
        F.when(eid % 6 == 0, F.lit("https://search.example.org/")).otherwise(F.lit("")).alias("referrer"),
        pick(USER_AGENTS, eid).alias("user_agent"),
        F.when(eid % 8 == 0, F.lit("tablet")).otherwise(F.lit("unknown")).alias("device_type"),
        F.lit("unknown").alias("browser"),
        F.lit("unknown").alias("browser_version"),
        F.lit("unknown").alias("os"),
        F.when(known_place, F.concat(F.lit("C"), F.col("uid") % 5)).otherwise(F.lit("unknown")).alias("country"),
        F.when(known_place & (eid % 3 == 0), F.concat(F.lit("R"), F.col("uid") % 3)).alias("region"),
        F.lit(None).cast("string").alias("city"),
        data.alias("data"),
        F.col("ts").alias("created_at"),
    )


def flat_events(spark: SparkSession, sf_dir: str, typed: bool = False) -> DataFrame:
    return flat(base_events(spark, sf_dir), typed)


def dense_events(spark: SparkSession, sf_dir: str, typed: bool = False) -> DataFrame:
    """Flat events with time squeezed twentyfold, so that visits have more than one event."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    squeezed = F.timestamp_micros(
        F.unix_micros(start) + F.floor((F.unix_micros("ts") - F.unix_micros(start)) / 20).cast("bigint")
    )
    return flat(base_events(spark, sf_dir).withColumn("ts", squeezed), typed)


def spread_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat events over twelve months, for retention."""
    moved = F.col("ts") - F.make_ym_interval(F.lit(0), (F.col("eid") % 12).cast("int"))
    return flat(base_events(spark, sf_dir).withColumn("ts", moved))


# --- request batches --------------------------------------------------------------


def _sdk_event(
    m: Column, event_type: Column, timestamp: Column, url: Column, user_id: Column, extra: list[Column]
) -> Column:
    eid, uid = m["eid"], m["uid"]
    device = F.when(
        eid % 4 != 0,
        F.struct(
            F.struct(F.lit("desktop").alias("type"), F.when(eid % 3 != 0, F.lit("Linux")).alias("os")).alias("device"),
            F.struct(F.lit("Firefox").alias("name"), F.concat(eid % 100, F.lit(".0")).alias("version")).alias(
                "browser"
            ),
        ),
    )
    place = F.when(
        eid % 6 != 0,
        F.struct(
            F.concat(F.lit("C"), uid % 5).alias("country"),
            F.when(eid % 3 == 0, F.concat(F.lit("R"), uid % 3)).alias("region"),
        ),
    )
    return F.struct(
        F.concat(F.lit("e-"), eid).alias("id"),
        event_type.alias("type"),
        timestamp.alias("timestamp"),
        m["session_id"].alias("sessionId"),
        url.alias("url"),
        pick(USER_AGENTS, eid).alias("userAgent"),
        user_id.alias("userId"),
        F.when(eid % 7 == 0, F.lit("/given")).alias("path"),
        F.when(eid % 5 == 0, F.lit("https://search.example.org/")).alias("referrer"),
        device.alias("deviceInfo"),
        place.alias("location"),
        *extra,
    )


def _event_json(m: Column, received_ms: Column) -> Column:
    """The SDK event of a batch's member with the injected faults, as JSON text."""
    eid, event_type = m["eid"], mapped_type(m["kind"])
    timestamp = (
        F.when(eid % 50 == 0, received_ms + 6000)
        .when(eid % 53 == 0, received_ms - 25 * 3600 * 1000)
        .otherwise(m["ms"])
    )
    custom = event_type == "custom"
    event = _sdk_event(
        m,
        F.when(eid % 997 == 0, F.lit("unheard_of")).otherwise(event_type),
        timestamp,
        F.when(eid % 59 == 0, F.lit("")).otherwise(F.concat(F.lit("https://example.com/p/"), eid % 50, F.lit("?q=1"))),
        F.when(eid % 61 == 0, F.repeat(F.lit("u"), 129)).otherwise(m["user_id"]),
        [
            F.when(custom, m["kind"]).alias("name"),
            F.when(custom, F.struct(m["k"].alias("k"))).alias("properties"),
            m["cents"].alias("cents"),
            m["k"].alias("k"),
        ],
    )
    text = F.to_json(event)
    # A quoted timestamp: the type is wrong although the value would convert.
    return F.when(eid % 991 == 0, F.regexp_replace(text, '"timestamp":(\\d+)', '"timestamp":"$1"')).otherwise(text)


def raw_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies in all three shapes; 20 source events make up a batch."""
    return batches_from(base_events(spark, sf_dir))


def batches_from(derived: DataFrame) -> DataFrame:
    number = F.floor(F.col("eid") / 20).cast("bigint")
    numbered = derived.withColumn("batch_no", number).withColumn("form", F.col("batch_no") % 3)
    single = F.col("form") == 2
    keyed = numbered.withColumn("batch_id", F.when(single, -1 - F.col("eid")).otherwise(F.col("batch_no")))
    columns = ["eid", "uid", "ms", "kind", "cents", "k", "session_id", "user_id"]
    # One grouping: a second one, of the built texts, would have to sort and spill them.
    grouped = keyed.groupBy("batch_id", "batch_no", "form").agg(
        F.max("ms").alias("last_ms"), F.collect_list(F.struct(*columns)).alias("members")
    )
    bodies = grouped.withColumn("received_ms", F.col("last_ms") + 1000).withColumn(
        "parts", F.transform(F.array_sort("members"), lambda m: _event_json(m, F.col("received_ms")))
    )
    listed = F.array_join("parts", ",")
    body = (
        F.when(F.col("form") == 0, F.concat(F.lit("["), listed, F.lit("]")))
        .when(
            F.col("form") == 1,
            F.concat(F.lit('{"events":['), listed, F.lit('],"metadata":{"sdkVersion":"1.0.0","queueSize":3}}')),
        )
        .otherwise(listed)
    )
    return bodies.withColumn("_body", body).select(
        "batch_id",
        F.concat(F.lit("proj-"), F.col("batch_no") % 7).alias("project_id"),
        F.when(F.col("batch_no") % 71 == 0, F.expr("substring(_body, 1, length(_body) - 5)"))
        .otherwise(F.col("_body"))
        .alias("body"),
        F.timestamp_millis("received_ms").alias("received_at"),
        (F.col("batch_no") * 37 % 12000).alias("latency_ms"),
    )
