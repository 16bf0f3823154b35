"""The older tagged event: decode, validate, flatten to one wide row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import schemas as S
from tidegauge.functions import variants as V
from tidegauge.functions.once import with_columns_once
from tidegauge.functions.seals import sealed, unsealed
from tidegauge.operators.rules import Field, PayloadRules, first_error

_UUID = "^(urn:uuid:)?[{]?([0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12})[}]?$"
_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def _optional(name: str, kind: str, **limits) -> Field:
    return Field(name, kind, required=False, nullable=True, **limits)


# Payload rules per legacy type (fixed values).
LEGACY_RULES: dict[str, tuple[Field, ...]] = {
    "pageview": (
        Field("title", "string", max_chars=500),
        Field("path", "string", max_chars=2000),
        _optional("load_time", "double"),
        _optional("time_to_first_byte", "double"),
        _optional("referrer", "string", max_chars=2048),
    ),
    "click": (
        Field("element", "string", max_chars=64),
        _optional("selector", "string", max_chars=1000),
        _optional("coordinates", "object", fields=(Field("x", "double"), Field("y", "double"))),
        Field("is_double_click", "bool", required=False),
        _optional("text", "string", max_chars=200),
    ),
    "scroll": (
        Field("scroll_depth", "double", lo=0, hi=100),
        Field("direction", "string", among=("up", "down")),
        _optional("element", "string", max_chars=256),
    ),
    "performance": (
        Field(
            "metrics",
            "object",
            check_fields=True,
            fields=(
                _optional("lcp", "double", lo=0, hi=60000),
                _optional("fid", "double", lo=0, hi=10000),
                _optional("cls", "double", lo=0, hi=10),
                _optional("ttfb", "double", lo=0, hi=60000),
                _optional("fcp", "double", lo=0, hi=60000),
                _optional("dom_content_loaded", "double", lo=0, hi=120000),
                _optional("load_complete", "double", lo=0, hi=300000),
                _optional("resource_count", "uint32", hi=10000),
                _optional("memory_usage", "uint64"),
            ),
        ),
    ),
    "custom": (
        Field("event_name", "string", min_chars=1, max_chars=100),
        Field("properties", "json", max_bytes=S.MAX_PROPERTIES_BYTES),
    ),
}
METADATA_FIELDS = (
    _optional("user_agent", "string", max_chars=512),
    _optional("ip", "string", max_chars=45),
    _optional("screen_width", "uint32"),
    _optional("screen_height", "uint32"),
    _optional("viewport_width", "uint32"),
    _optional("viewport_height", "uint32"),
    _optional("device_pixel_ratio", "double"),
    _optional("timezone", "string", max_chars=64),
    _optional("language", "string", max_chars=16),
)
MAX_USER_ID_CHARS = 128
_RULES = PayloadRules(LEGACY_RULES)
_METADATA = PayloadRules({"metadata": METADATA_FIELDS})


def _uuid(text: Column) -> Column:
    """Lower-case hyphenated form of a UUID, null if it is none."""
    digits = F.lower(F.regexp_replace(F.regexp_extract(text, _UUID, 2), "-", ""))
    dashed = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.nullif(dashed, F.lit(""))


def _instant(text: Column) -> Column:
    return F.when(text.rlike(_RFC3339), F.try_to_timestamp(F.upper(text)))


def _per_type(build) -> Column:
    branches = " ".join(f"WHEN '{name}' THEN {build(name)}" for name in LEGACY_RULES)
    return F.expr(f"CASE type {branches} END")


def decode(records: DataFrame, value: str = "value", arrived: str = "arrived_at") -> DataFrame:
    """Parse records; ``decode_error`` is null for well-formed ones.

    ``received_at`` defaults to the arrival time.
    """
    doc = F.col("doc")
    closed = with_columns_once(records, {"_sealed": sealed(F.col(value))})
    whole = F.try_variant_get(unsealed(F.col("_sealed"), F.col(value)), "$[0]", "variant")
    documents = with_columns_once(closed, {"doc": whole}).drop("_sealed")
    parsed = with_columns_once(
        documents,
        {
            "payload": F.try_variant_get(doc, "$", _RULES.ddl),
            "metadata": F.try_variant_get(doc, "$.metadata", _METADATA.ddl),
            "type": V.text(doc, "$.type"),
            "id": _uuid(V.text(doc, "$.id")),
            "tenant_id": _uuid(V.text(doc, "$.tenant_id")),
            "session_id": _uuid(V.text(doc, "$.session_id")),
            "user_id": V.text(doc, "$.user_id"),
            "timestamp": _instant(V.text(doc, "$.timestamp")),
            "_received": _instant(V.text(doc, "$.received_at")),
        },
    )
    has_metadata = ~V.is_absent(doc, "$.metadata")
    envelope = first_error(
        [
            (doc.isNull(), "not JSON"),
            (~F.coalesce(F.col("type").isin(S.LEGACY_TYPES), F.lit(False)), "type is not known"),
            (F.col("id").isNull(), "id is not a UUID"),
            (F.col("tenant_id").isNull(), "tenant_id is not a UUID"),
            (F.col("session_id").isNull(), "session_id is not a UUID"),
            (~V.is_optional(doc, "$.user_id", "string"), "user_id is not a valid string"),
            (F.col("timestamp").isNull(), "timestamp is not a date and time"),
            (
                V.at(doc, "$.received_at").isNotNull() & F.col("_received").isNull(),
                "received_at is not a date and time",
            ),
            (has_metadata & F.col("metadata").isNull(), "metadata is not a valid object"),
        ]
    )
    error = F.coalesce(
        envelope,
        _per_type(lambda name: _RULES.type_error(name, "payload", "doc")),
        F.when(has_metadata, F.expr(_METADATA.type_error("metadata", "metadata", "doc", "$.metadata"))),
    )
    received = F.coalesce("_received", F.col(arrived))
    decoded = with_columns_once(parsed, {"received_at": received, "decode_error": error})
    return decoded.drop("_received")


def validate(decoded: DataFrame) -> DataFrame:
    """Add ``error``: why a decoded event is refused, or null."""
    age = F.unix_millis("received_at") - F.unix_millis("timestamp")
    basic = first_error(
        [
            (F.char_length("user_id") > MAX_USER_ID_CHARS, f"user_id is longer than {MAX_USER_ID_CHARS} characters"),
            (age < -S.MAX_FUTURE_MS, "timestamp cannot be more than 5s in the future"),
            (age > S.MAX_PAST_MS, "timestamp cannot be more than 24h in the past"),
        ]
    )
    metadata = F.concat(F.lit("metadata: "), F.expr(_METADATA.value_error("metadata", "metadata")))
    payload = F.concat(
        F.col("type"), F.lit(": "), _per_type(lambda name: _RULES.value_error(name, "payload"))
    )
    return decoded.withColumn("error", F.coalesce("decode_error", basic, metadata, payload))


def batch_errors(events: DataFrame) -> DataFrame:
    """Reject batches that do not hold 1 to 1000 events: ``events(batch_id, ...)`` to one row per batch."""
    size = F.count("*")
    return events.groupBy("batch_id").agg(
        size.alias("events"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        size.between(1, S.MAX_BATCH_EVENTS).alias("accepted"),
    )


def batch_messages(events: DataFrame, idx: str = "idx") -> DataFrame:
    """One row per refused event: its batch, its position there (column ``idx``) and the message with that position."""
    at = F.col(idx).cast("bigint")
    message = F.concat(F.lit("validation error: event["), at.cast("string"), F.lit("]: validation error: "), "error")
    return events.filter(F.col("error").isNotNull()).select("batch_id", at.alias("idx"), message.alias("message"))


def flatten(decoded: DataFrame) -> DataFrame:
    """The 41-column row; only the columns of the event's own type are filled."""
    doc, kind = F.col("doc"), F.col("type")

    def of(name: str, value: Column) -> Column:
        return F.when(kind == name, value)

    def text(name: str, path: str) -> Column:
        return of(name, V.text(doc, path))

    def number(name: str, path: str) -> Column:
        return of(name, V.double(doc, path))

    metadata = {
        "user_agent": V.text, "ip": V.text, "screen_width": V.long, "screen_height": V.long,
        "viewport_width": V.long, "viewport_height": V.long, "device_pixel_ratio": V.double,
        "timezone": V.text, "language": V.text,
    }
    double_click = F.coalesce(V.boolean(doc, "$.is_double_click"), F.lit(False)).cast("int")
    performance = ["lcp", "fid", "cls", "ttfb", "fcp", "dom_content_loaded", "load_complete"]
    return decoded.filter(F.col("decode_error").isNull()).select(
        "id",
        "tenant_id",
        "session_id",
        "user_id",
        kind.alias("event_type"),
        F.unix_millis("timestamp").alias("timestamp"),
        F.unix_millis("received_at").alias("received_at"),
        text("pageview", "$.title").alias("page_title"),
        text("pageview", "$.path").alias("page_path"),
        number("pageview", "$.load_time").alias("load_time"),
        number("pageview", "$.time_to_first_byte").alias("time_to_first_byte"),
        text("pageview", "$.referrer").alias("referrer"),
        text("click", "$.element").alias("click_element"),
        text("click", "$.selector").alias("click_selector"),
        number("click", "$.coordinates.x").alias("click_x"),
        number("click", "$.coordinates.y").alias("click_y"),
        of("click", double_click).alias("is_double_click"),
        text("click", "$.text").alias("click_text"),
        number("scroll", "$.scroll_depth").alias("scroll_depth"),
        text("scroll", "$.direction").alias("scroll_direction"),
        text("scroll", "$.element").alias("scroll_element"),
        *[number("performance", f"$.metrics.{m}").alias(f"perf_{m}") for m in performance],
        of("performance", V.long(doc, "$.metrics.resource_count")).alias("perf_resource_count"),
        of("performance", V.long(doc, "$.metrics.memory_usage")).alias("perf_memory_usage"),
        text("custom", "$.event_name").alias("custom_event_name"),
        of("custom", F.to_json(V.at(doc, "$.properties"))).alias("custom_properties"),
        *[get(doc, f"$.metadata.{name}").alias(name) for name, get in metadata.items()],
    )
