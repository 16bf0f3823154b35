import json

import pytest

from tests.conftest import NOW_MS, sdk_event
from tidegauge.operators.rules import PAYLOAD_RULES
from tidegauge.plans import ingest

POSITION = {"x": 1, "y": 2.5}
FACTORS = {"time_on_page": 1, "scroll_depth": 500, "click_count": 0, "mouse_activity": 1.5, "focus_time": 2}
CONTEXT = {"time_on_page": 1, "scroll_depth": 1, "engagement_score": 2, "session_duration": 3, "page_count": 4}
VALID = {
    "mouse_move": {"position": POSITION, "velocity": 0},
    "exit_intent": {"position": POSITION, "velocity": 1, "time_on_page": 0, "scroll_depth": 100},
    "idle_start": {"last_activity_type": "mouse", "time_on_page": 5},
    "idle_end": {"idle_duration": 0, "resume_activity_type": "touch", "time_on_page": 5},
    "engagement_snapshot": {"score": 100.0, "factors": FACTORS},
    "trigger_registered": {"trigger_id": "t" * 128, "condition": "c" * 1000, "priority": 1000, "once": "false"},
    "trigger_fired": {"trigger_id": "t", "condition": "", "priority": 0, "context": CONTEXT},
    "trigger_dismissed": {"trigger_id": "t", "method": "snooze", "snooze_duration": None},
    "trigger_action": {"trigger_id": "t", "action_type": "a" * 64, "data": {"any": [1]}},
    "trigger_error": {"trigger_id": "t", "error_type": "storage", "message": "m" * 1000, "stack": "s" * 4000},
    "custom": {"name": "n" * 100, "properties": {}},
}
INVALID = [
    ("mouse_move", {"velocity": -0.1}),
    ("mouse_move", {"velocity": "1"}),
    ("mouse_move", {"position": {"x": 1}}),
    ("mouse_move", {"position": [1, 2]}),
    ("mouse_move", {"exit_intent": None}),
    ("mouse_move", {"hover_target": "h" * 1001}),
    ("exit_intent", {"scroll_depth": 100.01}),
    ("exit_intent", {"time_on_page": -1}),
    ("exit_intent", {"time_on_page": 1.0}),
    ("idle_start", {"last_activity_type": "gaze"}),
    ("idle_end", {"idle_duration": ...}),
    ("engagement_snapshot", {"score": 100.5}),
    ("engagement_snapshot", {"factors": {**FACTORS, "click_count": -1}}),
    ("engagement_snapshot", {"factors": {**FACTORS, "focus_time": None}}),
    ("trigger_registered", {"trigger_id": "t" * 129}),
    ("trigger_registered", {"trigger_id": ""}),
    ("trigger_registered", {"priority": 1001}),
    ("trigger_registered", {"once": False}),
    ("trigger_fired", {"context": {}}),
    ("trigger_fired", {"condition": "c" * 1001}),
    ("trigger_dismissed", {"method": "other"}),
    ("trigger_dismissed", {"snooze_duration": "5"}),
    ("trigger_action", {"action_type": "a" * 65}),
    ("trigger_action", {"data": "d" * 16385}),
    ("trigger_error", {"error_type": "x"}),
    ("trigger_error", {"stack": "s" * 4001}),
    ("custom", {"name": ""}),
    ("custom", {"name": "n" * 101}),
    ("custom", {"name": ...}),
    ("custom", {"properties": "text"}),
    ("custom", {"properties": ...}),
    ("custom", {"properties": {"x": "y" * 16384}}),
]
EXTRA_OK = [
    ("mouse_move", {"exit_intent": True, "hover_target": None, "unknown": [1]}),
    ("mouse_move", {"velocity": 1e3}),
    ("engagement_snapshot", {"factors": {**FACTORS, "form_interaction": True}}),
]


def errors(df):
    return {r["batch_id"]: r["error"] for r in ingest.validate_batches(df).collect()}


def test_every_rule_at_its_bounds(raw):
    assert set(VALID) == set(PAYLOAD_RULES)
    good = [sdk_event(type=t, **fields) for t, fields in VALID.items()]
    good += [sdk_event(type=t, **{**VALID[t], **change}) for t, change in EXTRA_OK]
    bad = [sdk_event(type=t, **{**VALID[t], **change}) for t, change in INVALID]
    found = errors(raw(*good, *bad))
    for i, event in enumerate(good):
        assert found[i] is None, event
    for i, event in enumerate(bad):
        assert found[len(good) + i] is not None, json.dumps(event)[:200]
        assert found[len(good) + i].startswith(event["type"] + " data: ")


def test_types_without_rules_take_anything(raw):
    assert errors(raw(sdk_event(type="keydown", position="x", velocity=-1))) == {0: None}


def test_camel_case_payload_keys(raw):
    camel = sdk_event(type="idle_start", lastActivityType="mouse", timeOnPage=5)
    assert errors(raw(camel))[0] is not None
    found = ingest.validate_batches(raw(camel), key_style="camel").first()
    assert found["error"] is None


@pytest.mark.parametrize(
    "change,reason",
    [
        ({"url": "u" * 2048}, None),
        ({"url": "u" * 2049}, "url is longer than 2048 characters"),
        ({"url": "é" * 2048}, None),
        ({"userAgent": "a" * 512}, None),
        ({"userAgent": "a" * 513}, "userAgent is longer than 512 characters"),
        ({"userId": "a" * 128}, None),
        ({"userId": "a" * 129}, "userId is longer than 128 characters"),
        ({"path": "a" * 2001}, "path is longer than 2000 characters"),
        ({"referrer": "a" * 2049}, "referrer is longer than 2048 characters"),
        ({"id": ""}, "id is required"),
        ({"sessionId": ""}, "sessionId is required"),
        ({"url": ""}, "url is required"),
        ({"userAgent": ""}, "userAgent is required"),
        ({"timestamp": NOW_MS + 5000}, None),
        ({"timestamp": NOW_MS + 5001}, "timestamp cannot be more than 5s in the future"),
        ({"timestamp": NOW_MS - 86400000}, None),
        ({"timestamp": NOW_MS - 86400001}, "timestamp cannot be more than 24h in the past"),
        ({"userId": "a" * 129, "url": "", "timestamp": 0}, "userId is longer than 128 characters"),
        ({"x": "y" * 16376}, None),
        ({"x": "y" * 16377}, "extra data 16KB exceeds 16KB limit"),
    ],
)
def test_event_rules(raw, change, reason):
    assert errors(raw(sdk_event(**change))) == {0: reason}


def test_flattening(raw):
    device = {"device": {"type": "tablet"}, "browser": {"name": "Firefox", "version": "1.2"}}
    event = sdk_event(
        type="custom", name="purchase", properties={"b": 1, "a": [True, None]}, deviceInfo=device,
        location={"country": "US", "city": "X"}, userId="u",
    )
    row = ingest.accepted_events(raw(event)).first().asDict()
    assert (row["device_type"], row["os"], row["browser"], row["browser_version"]) == ("tablet", "unknown", "Firefox", "1.2")
    assert (row["country"], row["region"], row["city"]) == ("US", None, "X")
    assert (row["custom_name"], row["path"], row["referrer"]) == ("purchase", "/foo/bar", "")
    assert json.loads(row["data"]) == {"name": "purchase", "properties": {"b": 1, "a": [True, None]}}
    plain = ingest.accepted_events(raw(sdk_event(name="x"))).first()
    assert (plain["custom_name"], plain["device_type"], plain["country"], plain["data"]) == (
        None, "unknown", "unknown", '{"name":"x"}',
    )
    assert ingest.accepted_events(raw(sdk_event())).first()["data"] == "{}"
