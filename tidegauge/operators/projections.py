"""Per-type tables: typed columns read out of the events' JSON ``data``.

A column is looked up under its own name, then in camelCase, then under the
aliases given here. Each projection is a filter and a narrow projection, except
scrolls, whose ``max_depth`` runs along a session's page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions import variants as V
from tidegauge.functions.running import prefix_scan
from tidegauge.operators.rules import camel

KEYS = ["project_id", "session_id", "timestamp"]
DOC = "_doc"


def _field(name: str, kind: str, *aliases: str) -> Column:
    paths = list(dict.fromkeys([name, camel(name), *aliases]))
    return F.coalesce(*[F.try_variant_get(DOC, f"$.{p}", kind) for p in paths]).alias(name)


def _of_type(events: DataFrame, *types: str) -> DataFrame:
    return events.filter(F.col("event_type").isin(*types)).withColumn(DOC, F.try_parse_json("data"))


def pageviews(events: DataFrame) -> DataFrame:
    return _of_type(events, "pageview").select(
        *KEYS,
        "url",
        "path",
        _field("title", "string"),
        F.nullif("referrer", F.lit("")).alias("referrer"),
        "user_agent",
        "device_type",
        "browser",
        "browser_version",
        "os",
        "country",
        "region",
        "city",
        _field("time_on_page_seconds", "bigint"),
        F.coalesce(_field("scroll_depth_percentage", "int"), F.lit(0)).alias("scroll_depth_percentage"),
        _field("page_load_time_ms", "bigint", "load_time"),
    )


def clicks(events: DataFrame) -> DataFrame:
    return _of_type(events, "click").select(
        *KEYS,
        "url",
        _field("x", "double", "coordinates.x"),
        _field("y", "double", "coordinates.y"),
        _field("selector", "string"),
        _field("target", "string"),
        _field("element_text", "string", "text"),
        _field("element_tag", "string", "element"),
        _field("element_id", "string"),
        _field("element_class", "string"),
        _field("viewport_width", "int"),
        _field("viewport_height", "int"),
    )


def scrolls(events: DataFrame) -> DataFrame:
    rows = _of_type(events, "scroll").select(
        *KEYS, "event_id", _field("depth", "double", "scroll_depth", "scrollDepth"), "url"
    )
    running = prefix_scan(
        rows,
        keys=["project_id", "session_id", "url"],
        order=["timestamp", "event_id"],
        values={"max_depth": F.col("depth")},
        combine="max",
    )
    return running.select(*KEYS, "depth", "max_depth", "url")


def mouse_moves(events: DataFrame) -> DataFrame:
    return _of_type(events, "mouse_move").select(
        *KEYS,
        _field("x", "double", "position.x"),
        _field("y", "double", "position.y"),
        _field("viewport_x", "double"),
        _field("viewport_y", "double"),
        "url",
    )


def form_events(events: DataFrame) -> DataFrame:
    return _of_type(events, "form_focus", "form_blur", "form_submit", "form_abandon").select(
        *KEYS, _field("form_id", "string"), _field("field_name", "string"), "event_type", "url"
    )


def errors(events: DataFrame) -> DataFrame:
    return _of_type(events, "error").select(
        *KEYS,
        _field("message", "string"),
        _field("stack", "string"),
        "url",
        _field("line", "bigint"),
        _field("column", "bigint"),
    )


def performance_metrics(events: DataFrame) -> DataFrame:
    metrics = [_field(m, "double", f"metrics.{m}") for m in ("lcp", "fid", "cls", "ttfb", "fcp")]
    return _of_type(events, "performance").select(*KEYS, *metrics, "url")


def visibility_events(events: DataFrame) -> DataFrame:
    return _of_type(events, "visibility_change").select(
        *KEYS, _field("state", "string"), _field("hidden_duration", "bigint"), "url"
    )


def resource_loads(events: DataFrame) -> DataFrame:
    return _of_type(events, "resource_load").select(
        *KEYS,
        _field("resource_url", "string"),
        _field("resource_type", "string"),
        _field("duration", "double"),
        _field("size", "bigint"),
        "url",
    )


def geographic(events: DataFrame) -> DataFrame:
    """Events of any type that carry a place."""
    placed = events.filter((F.col("country") != "unknown") | F.col("region").isNotNull() | F.col("city").isNotNull())
    return placed.withColumn(DOC, F.try_parse_json("data")).select(
        *KEYS, "country", "region", "city", _field("lat", "double"), _field("lng", "double"), "url"
    )


def custom_events(events: DataFrame) -> DataFrame:
    properties = F.coalesce(F.to_json(V.at(F.col(DOC), "$.properties")), F.lit("{}"))
    return _of_type(events, "custom").select(*KEYS, _field("name", "string"), properties.alias("properties"), "url")


PROJECTIONS = {
    "pageviews": pageviews,
    "clicks": clicks,
    "scroll_events": scrolls,
    "mouse_moves": mouse_moves,
    "form_events": form_events,
    "errors": errors,
    "performance_metrics": performance_metrics,
    "visibility_events": visibility_events,
    "resource_loads": resource_loads,
    "geographic": geographic,
    "custom_events": custom_events,
}
