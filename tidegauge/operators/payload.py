"""Request bodies to events: shape detection, size guards, all-or-nothing decode.

A body is a JSON array of events, an object with an ``events`` array, or one
event. One badly typed event rejects its whole batch, so that decision is taken
on the array *before* it is exploded: no shuffle between the scan and the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import schemas as S
from tidegauge.functions import variants as V
from tidegauge.functions.seals import sealed, unsealed
from tidegauge.operators import rules

# One cast of the whole array reads every typed field. A BINARY target accepts a JSON
# string and nothing else, so a null there means "absent or not a string".
_STRICT = """struct<
    id binary, type binary, timestamp bigint, sessionId binary, url binary, userAgent binary,
    userId binary, path binary, referrer binary,
    deviceInfo struct<device struct<type binary, os binary>, browser struct<name binary, version binary>>,
    location struct<country binary, region binary, city binary>>"""
REQUIRED_TEXT = ["id", "type", "sessionId", "url", "userAgent"]
OPTIONAL_TEXT = [
    "userId", "path", "referrer",
    "deviceInfo.device.type", "deviceInfo.device.os", "deviceInfo.browser.name", "deviceInfo.browser.version",
    "location.country", "location.region", "location.city",
]
OPTIONAL_OBJECTS = ["deviceInfo", "deviceInfo.device", "deviceInfo.browser", "location"]
METADATA = {"sdkVersion": "string", "timestamp": "long", "queueSize": "uint32"}


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


# Fields of a zipped item, by position: the casts of one event.
RAW, STRICT, PAYLOAD, ENTRIES = (f"i.`{n}`" for n in range(4))


def _event_decodes() -> str:
    """SQL: every typed SDK field of item ``i`` is present and exactly typed."""

    def fits(name: str) -> str:
        # The untyped field is read only where the cast gave null: to tell a badly typed one from an absent one.
        parent, _, _ = name.rpartition(".")
        top, *rest = name.split(".")
        value = f"try_element_at({ENTRIES}, '{top}')"
        if rest:
            target = reduce(lambda inner, key: f"struct<{key} {inner}>", reversed(rest), "variant")
            value = f"try_variant_get({value}, '$', '{target}').{'.'.join(rest)}"
        checks = [f"{STRICT}.{parent} IS NULL"] if parent else []
        checks += [f"{STRICT}.{name} IS NOT NULL", f"{value} IS NULL", f"is_variant_null({value})"]
        return f"({' OR '.join(checks)})"

    types = ", ".join(f"'{t}'" for t in S.EVENT_TYPES)
    return " AND ".join(
        [f"{STRICT}.{name} IS NOT NULL" for name in REQUIRED_TEXT]
        + [f"CAST({STRICT}.type AS STRING) IN ({types})"]
        + [V.is_stored_sql(f"try_element_at({ENTRIES}, 'timestamp')", "long")]
        + [fits(name) for name in OPTIONAL_OBJECTS + OPTIONAL_TEXT]
    )


def _extra_json() -> str:
    """SQL: the keys of item ``i`` that are not typed SDK fields, as canonical JSON (``{}`` if none)."""
    known = ", ".join(f"'{k}'" for k in S.KNOWN_KEYS)
    return f"to_json(map_filter({ENTRIES}, (k, v) -> k NOT IN ({known})))"


def _listed(target: str) -> str:
    """SQL: the document's events cast to ``array<target>``; null if it is none of the shapes."""
    return (
        f"CASE shape WHEN 'array' THEN try_variant_get(_doc, '$[0]', 'array<{target}>') "
        f"WHEN 'wrapper' THEN try_variant_get(_doc, '$[0].events', 'array<{target}>') "
        f"WHEN 'single' THEN array(try_variant_get(_doc, '$[0]', '{target}')) END"
    )


def parse_batches(
    raw: DataFrame,
    max_bytes: int = S.MAX_BATCH_BYTES,
    max_events: int = S.MAX_BATCH_EVENTS,
    max_event_bytes: int | None = None,
    key_style: str = "snake",
) -> DataFrame:
    """Add ``shape``, ``events`` (array of decoded events), ``received`` and ``code``.

    ``code`` is null for a batch that is let through. ``received`` counts decoded
    events, also of a batch that then has too many. ``max_event_bytes`` turns on
    the single-event guard (``VALID_003``), which is off by default.
    """
    body = F.col("body")
    if dict(raw.dtypes)["body"] == "binary":
        raw = raw.withColumn("body", F.try_validate_utf8(body.cast("string")))
    small = F.octet_length(body) <= max_bytes
    parsed = raw.withColumn("_doc", F.when(small, sealed(body)))

    # Keys are read by casts: a path that leads nowhere costs far more than a cast that finds nothing, and a cast
    # to booleans tells a list without copying it.
    shaped = (
        parsed.withColumn("_doc", unsealed(F.col("_doc"), body))
        .withColumn(
            "_keys",
            F.try_variant_get(F.col("_doc"), "$[0]", "struct<events array<boolean>, id variant, type variant>"),
        )
        .withColumn(
            "shape",
            # The document is valid JSON, so its first character tells an array.
            F.when(F.col("_doc").isNotNull() & F.ltrim(body, F.lit(" \t\n\r")).startswith("["), "array")
            .when(
                F.col("_keys.events").isNotNull()
                | F.try_variant_get(F.col("_doc"), "$[0]", "struct<events variant>")["events"].isNotNull(),
                "wrapper",
            )
            .when(F.col("_keys.id").isNotNull() & F.col("_keys.type").isNotNull(), "single"),
        )
        .withColumn("_metadata", F.when(F.col("shape") == "wrapper", V.at(F.col("_doc"), "$[0].metadata")))
    )
    casts = ["variant", _STRICT, rules.PayloadRules(rules.PAYLOAD_RULES, key_style).ddl, "map<string,variant>"]
    zipped = f"arrays_zip({', '.join(_listed(target) for target in casts)})"
    checked = rules.payload_error(PAYLOAD, RAW, f"CAST({STRICT}.type AS STRING)", key_style)
    oversized = "false" if max_event_bytes is None else f"exists(items, i -> octet_length(to_json({RAW})) > {max_event_bytes})"
    # The casts are bound to a name inside one expression, so that they are made
    # once and never written to a row: a VARIANT leaf drags along the key list of
    # its whole document. Everything costly about an event happens here, ahead of
    # the explode, where a later filter cannot make the optimizer repeat it.
    result = F.expr(f"""
        transform(array({zipped}), items -> named_struct(
            'ok', forall(items, i -> {_event_decodes()}),
            'oversized', {oversized},
            'events', transform(items, i -> named_struct(
                'event', {RAW}, 'sdk', {STRICT}, 'data', {_extra_json()}, 'payload_error', {checked}
            ))
        ))[0]""")
    metadata = _all(
        [V.is_stored(F.col("_metadata"), "object")]
        + [V.is_optional(F.col("_metadata"), f"$.{name}", kind) for name, kind in METADATA.items()]
    ) | V.is_absent(F.col("_metadata"), "$")
    decoded = shaped.withColumns(
        {"_result": result, "_metadata_ok": (F.col("shape") != "wrapper") | metadata}
    ).withColumn("_decoded", F.coalesce(F.col("_metadata_ok") & F.col("_result.ok"), F.lit(False)))
    size = F.size("_result.events")
    code = (
        F.when(~small, "VALID_002")
        .when(~F.col("_decoded"), "VALID_001")
        .when(size > max_events, "VALID_002")
        .when(F.col("_result.oversized"), "VALID_003")
    )
    return (
        decoded.withColumn("code", code)
        .withColumn("received", F.when(F.col("_decoded"), size).otherwise(0).cast("bigint"))
        .withColumn("events", F.when(F.col("code").isNull(), F.col("_result.events")))
        # Only a rejected body is carried on, for the quarantine.
        .withColumn("body", F.when(F.col("code").isNotNull(), body))
        .drop("_doc", "_keys", "_metadata", "_decoded", "_result", "_metadata_ok")
    )


def explode_events(parsed: DataFrame) -> DataFrame:
    """One row per event: ``idx`` from 0, ``event`` VARIANT, ``sdk`` typed fields, ``data``, ``payload_error``.

    A rejected or empty batch keeps one row with a null ``idx``, so nothing is
    lost for accounting.
    """
    others = [c for c in parsed.columns if c != "events"]
    rows = parsed.select(*others, F.posexplode_outer("events").alias("idx", "_item"))
    fields = ["event", "sdk", "data", "payload_error"]
    return rows.select(*others, "idx", *[F.col(f"_item.{name}").alias(name) for name in fields])


def http_status(code: Column) -> Column:
    """Status of an outcome code; null (accepted) is 200."""
    status = F.when(code.isNull(), F.lit(200))
    for name, value in S.HTTP_STATUS.items():
        status = status.when(code == name, F.lit(value))
    return status.otherwise(F.lit(500))
