"""Event rules as data, turned into one ``error`` column (first failing rule wins).

Order: field lengths, required text, time window, payload of the type, size of
the extra data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import schemas as S
from tidegauge.functions import variants as V


@dataclass(frozen=True)
class Field:
    """One payload field: its exact JSON type and the values it may take."""

    name: str
    kind: str  # string, long, uint32, double, bool, object, json
    required: bool = True
    nullable: bool = False  # an absent or null value is fine
    lo: float | None = None
    hi: float | None = None
    min_chars: int | None = None
    max_chars: int | None = None
    max_bytes: int | None = None
    among: tuple[str, ...] = ()
    fields: tuple["Field", ...] = ()  # of a nested object
    check_fields: bool = False  # also check the values of the nested fields


_POSITION = Field("position", "object", fields=(Field("x", "double"), Field("y", "double")))
_TRIGGER_ID = Field("trigger_id", "string", min_chars=1, max_chars=128)
_CONDITION = Field("condition", "string", max_chars=1000)
_PRIORITY = Field("priority", "uint32", lo=0, hi=1000)
_TIME_ON_PAGE = Field("time_on_page", "long", lo=0)
_ACTIVITIES = ("mouse", "keyboard", "scroll", "click", "touch")

# Payload rules per event type (fixed values). Types not listed have no rule;
# nested objects are checked for types and presence only.
PAYLOAD_RULES: dict[str, tuple[Field, ...]] = {
    "mouse_move": (
        _POSITION,
        Field("velocity", "double", lo=0),
        Field("exit_intent", "bool", required=False),
        Field("hover_target", "string", required=False, nullable=True, max_chars=1000),
    ),
    "exit_intent": (
        _POSITION,
        Field("velocity", "double", lo=0),
        _TIME_ON_PAGE,
        Field("scroll_depth", "double", lo=0, hi=100),
    ),
    "idle_start": (Field("last_activity_type", "string", among=_ACTIVITIES), _TIME_ON_PAGE),
    "idle_end": (
        Field("idle_duration", "long", lo=0),
        Field("resume_activity_type", "string", among=_ACTIVITIES),
        _TIME_ON_PAGE,
    ),
    "engagement_snapshot": (
        Field("score", "double", lo=0, hi=100),
        Field(
            "factors",
            "object",
            fields=(
                Field("time_on_page", "long"),
                Field("scroll_depth", "double"),
                Field("click_count", "uint32"),
                Field("form_interaction", "bool", required=False),
                Field("mouse_activity", "double"),
                Field("focus_time", "long"),
            ),
        ),
    ),
    "trigger_registered": (
        _TRIGGER_ID,
        _CONDITION,
        _PRIORITY,
        Field("once", "string", among=("page", "session", "user", "false")),
    ),
    "trigger_fired": (
        _TRIGGER_ID,
        _CONDITION,
        _PRIORITY,
        Field(
            "context",
            "object",
            fields=(
                Field("time_on_page", "long"),
                Field("scroll_depth", "double"),
                Field("engagement_score", "double"),
                Field("session_duration", "long"),
                Field("page_count", "uint32"),
            ),
        ),
    ),
    "trigger_dismissed": (
        _TRIGGER_ID,
        Field("method", "string", among=("user", "snooze", "limit")),
        Field("snooze_duration", "long", required=False, nullable=True),
    ),
    "trigger_action": (
        _TRIGGER_ID,
        Field("action_type", "string", min_chars=1, max_chars=64),
        Field("data", "json", required=False, nullable=True, max_bytes=S.MAX_PROPERTIES_BYTES),
    ),
    "trigger_error": (
        _TRIGGER_ID,
        Field("error_type", "string", among=("condition_eval", "fire_callback", "storage")),
        Field("message", "string", max_chars=1000),
        Field("stack", "string", required=False, nullable=True, max_chars=4000),
    ),
    "custom": (
        Field("name", "string", min_chars=1, max_chars=100),
        Field("properties", "object", max_bytes=S.MAX_PROPERTIES_BYTES),
    ),
}


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part.capitalize() for part in rest)


def first_error(checks: list[tuple[Column, str]]) -> Column:
    """Text of the first condition that holds, or null."""
    if not checks:
        return F.lit(None).cast("string")
    head, *rest = checks
    return reduce(lambda case, c: case.when(c[0], F.lit(c[1])), rest, F.when(head[0], F.lit(head[1])))


def case_sql(checks: list[tuple[str, str]]) -> str:
    """The same over SQL conditions."""
    if not checks:
        return "CAST(NULL AS STRING)"
    return "CASE " + " ".join(f"WHEN {broken} THEN '{reason}'" for broken, reason in checks) + " END"


class PayloadRules:
    """Checks for a rule table, as SQL text. All fields of all types are read in one cast.

    ``ddl`` is the type to cast a document to. Text that is always required is
    read as BINARY, which only a JSON string converts to; any other leaf stays
    VARIANT, so that its stored type can be tested.
    """

    def __init__(self, table: dict[str, tuple[Field, ...]], key_style: str = "snake"):
        if key_style not in ("snake", "camel"):
            raise ValueError("key_style is 'snake' or 'camel'")
        self.table = table
        self.key = camel if key_style == "camel" else (lambda name: name)
        self.ddl = self._struct([f for fields in table.values() for f in fields])

    def _struct(self, fields: list[Field]) -> str:
        by_name: dict[str, list[Field]] = {}
        for field in fields:
            by_name.setdefault(field.name, []).append(field)
        return "struct<" + ", ".join(f"{self.key(n)} {self._leaf(same)}" for n, same in by_name.items()) + ">"

    def _leaf(self, same: list[Field]) -> str:
        children = [child for field in same for child in field.fields]
        if children:
            return self._struct(children)
        return "binary" if self._always_text(same) else "variant"

    @staticmethod
    def _always_text(same: list[Field]) -> bool:
        return all(f.kind == "string" and f.required and not f.nullable for f in same)

    def _is_binary(self, field: Field, siblings: list[Field]) -> bool:
        return self._always_text([f for f in siblings if f.name == field.name])

    def type_error(self, name: str, payload: str, doc: str, root: str = "$") -> str:
        """SQL for the first field of a type that is missing or badly typed, or null."""
        everything = [f for fields in self.table.values() for f in fields]
        return case_sql([c for f in self.table[name] for c in self._types(f, payload, doc, root, everything)])

    def value_error(self, name: str, payload: str) -> str:
        """SQL for the first field of a type whose value is out of range, or null."""
        everything = [f for fields in self.table.values() for f in fields]
        return case_sql([c for f in self.table[name] for c in self._values(f, payload, everything)])

    def _types(self, field: Field, parent: str, doc: str, root: str, siblings: list[Field]) -> list[tuple[str, str]]:
        value, path = f"{parent}.`{self.key(field.name)}`", f"{root}.{self.key(field.name)}"
        missing = "missing or " if field.required else ""
        reason = f"{field.name} is {missing}not a valid {field.kind}"
        if field.fields:
            fits = f"{value} IS NOT NULL"
            if not field.required:
                at = f"try_variant_get({doc}, '{path}', 'variant')"
                fits = f"({fits} OR {at} IS NULL OR is_variant_null({at}))"
            checks = [(f"NOT {fits}", reason)]
            for child in field.fields:
                inner = self._types(child, value, doc, path, list(field.fields))
                checks += [(f"{value} IS NOT NULL AND ({broken})", text) for broken, text in inner]
            return checks
        if self._is_binary(field, siblings):
            checks = [(f"{value} IS NULL", reason)]
        elif field.kind == "json":
            checks = [(f"{value} IS NULL", reason)] if field.required else []
        else:
            fits = V.is_stored_sql(value, field.kind)
            if not field.required:
                fits = f"{value} IS NULL OR {fits}"
            if field.nullable:
                fits = f"coalesce(is_variant_null({value}), false) OR {fits}"
            checks = [(f"NOT ({fits})", reason)]
        if field.among:
            allowed = ", ".join(f"'{v}'" for v in field.among)
            text = self._text(value, field, siblings)
            checks.append((f"{text} NOT IN ({allowed})", f"{field.name} is not an allowed value"))
        return checks

    def _text(self, value: str, field: Field, siblings: list[Field]) -> str:
        if self._is_binary(field, siblings):
            return f"CAST({value} AS STRING)"
        return f"try_cast({value} AS STRING)"

    def _values(self, field: Field, parent: str, siblings: list[Field]) -> list[tuple[str, str]]:
        value = f"{parent}.`{self.key(field.name)}`"
        number, text = f"try_cast({value} AS DOUBLE)", f"char_length({self._text(value, field, siblings)})"
        limits = [
            (field.lo, f"{number} < "),
            (field.hi, f"{number} > "),
            (field.min_chars, f"{text} < "),
            (field.max_chars, f"{text} > "),
            (field.max_bytes, f"octet_length(to_json({value})) > "),
        ]
        broken = [f"{comparison}{limit}" for limit, comparison in limits if limit is not None]
        checks = [(" OR ".join(broken), f"{field.name} is out of range")] if broken else []
        if field.check_fields:
            checks += [check for child in field.fields for check in self._values(child, value, list(field.fields))]
        return checks


def payload_error(payload: str, event: str, event_type: str, key_style: str = "snake") -> str:
    """SQL for the payload error of an SDK event, null when its type's rules hold.

    ``payload`` names the event cast to the type of ``PayloadRules(PAYLOAD_RULES)``.
    """
    rules = PayloadRules(PAYLOAD_RULES, key_style)
    branches = [
        f"WHEN '{name}' THEN '{name} data: ' || "
        f"coalesce({rules.type_error(name, payload, event)}, {rules.value_error(name, payload)})"
        for name in PAYLOAD_RULES
    ]
    return f"CASE {event_type} {' '.join(branches)} END"


def event_error(read: Callable[[str], Column] = F.col) -> Column:
    """Reason a typed event is rejected, or null.

    ``read`` gives the columns of ``typed_events`` by name: those of a row, or those of an item of an event array.
    """
    limits = S.FIELD_MAX_CHARS
    columns = {
        "url": "url",
        "userAgent": "user_agent",
        "userId": "user_id",
        "path": "given_path",
        "referrer": "given_referrer",
    }
    checks = [
        (F.char_length(read(columns[name])) > limits[name], f"{name} is longer than {limits[name]} characters")
        for name in limits
    ]
    checks += [
        (read(column) == "", f"{name} is required")
        for name, column in {
            "id": "event_id",
            "sessionId": "session_id",
            "url": "url",
            "userAgent": "user_agent",
        }.items()
    ]
    # Compared, not subtracted: any 64-bit time is possible here.
    received, sent = F.unix_millis(read("received_at")), read("timestamp_ms")
    checks += [
        (sent > received + S.MAX_FUTURE_MS, "timestamp cannot be more than 5s in the future"),
        (sent < received - S.MAX_PAST_MS, "timestamp cannot be more than 24h in the past"),
    ]
    basic = first_error(checks)
    size = F.octet_length(read("data"))
    too_big = F.when(
        size > S.MAX_PROPERTIES_BYTES,
        F.format_string(
            f"extra data %dKB exceeds {S.MAX_PROPERTIES_BYTES // 1024}KB limit", F.floor(size / 1024)
        ),
    )
    return F.coalesce(basic, read("payload_error"), too_big)


def validate_events(typed: DataFrame) -> DataFrame:
    """Add ``error`` to every event row; rows of rejected or empty batches get none."""
    return typed.withColumn("error", F.when(F.col("idx").isNotNull(), event_error())).drop("payload_error")
