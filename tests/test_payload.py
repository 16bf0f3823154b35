import pytest
from pyspark.sql import functions as F

from tests.conftest import NOW_MS, sdk_event
from tidegauge.operators import payload
from tidegauge.plans import ingest
from workload import adapters


def outcome(df):
    return {r["batch_id"]: r.asDict() for r in ingest.outcomes_by_batch(df).collect()}


def test_shapes_and_whole_batch_rejections(raw):
    one = sdk_event()
    cases = [
        ([one] * 5, "array", None, 5),
        ({"events": [sdk_event(type="click")] * 3, "metadata": {"sdkVersion": "1.0.0"}}, "wrapper", None, 3),
        (sdk_event(type="scroll"), "single", None, 1),
        ([sdk_event(type=t) for t in ("pageview", "click", "scroll", "performance", "error")], "array", None, 5),
        ([], "array", None, 0),
        ("not json at all", None, "VALID_001", 0),
        ('[{"id": "123", "type": ', None, "VALID_001", 0),
        ([one] * 1000, "array", None, 1000),
        ([one] * 1001, "array", "VALID_002", 1001),
        ([sdk_event(type=...)], "array", "VALID_001", 0),
        ([one, sdk_event(type="invalid_type")], "array", "VALID_001", 0),
        ({"a": 1}, None, "VALID_001", 0),
        ("5", None, "VALID_001", 0),
        ("[] junk", None, "VALID_001", 0),
        ("[], []", None, "VALID_001", 0),
        ("", None, "VALID_001", 0),
        (" \n [] ", "array", None, 0),
        ({"events": None}, "wrapper", "VALID_001", 0),
        ({"events": [], "id": "x", "type": "click"}, "wrapper", None, 0),
        ({"events": [one], "metadata": {"queueSize": -1}}, "wrapper", "VALID_001", 0),
        ({"events": [one], "metadata": None}, "wrapper", None, 1),
        ([one, 5], "array", "VALID_001", 0),
        ("[" + " " * (1024 * 1024) + "]", None, "VALID_002", 0),
        ("[" + " " * (1024 * 1024 - 2) + "]", "array", None, 0),
    ]
    found = outcome(raw(*[c[0] for c in cases]))
    for i, (_, shape, code, received) in enumerate(cases):
        got = found[i]
        assert (got["shape"], got["code"], got["received"]) == (shape, code, received), i
        assert got["http_status"] == (200 if code is None else 400)
        assert got["accepted"] == (received if code is None else 0)


@pytest.mark.parametrize(
    "change,ok",
    [
        ({"timestamp": "1704110400000"}, False),
        ({"timestamp": 1704110400000.0}, False),
        ({"timestamp": None}, False),
        ({"id": 5}, False),
        ({"id": None}, False),
        ({"url": ...}, False),
        ({"userId": 5}, False),
        ({"userId": None}, True),
        ({"userId": "u"}, True),
        ({"referrer": ["x"]}, False),
        ({"deviceInfo": "desktop"}, False),
        ({"deviceInfo": None}, True),
        ({"deviceInfo": {}}, True),
        ({"deviceInfo": {"device": 5}}, False),
        ({"deviceInfo": {"device": {"type": 5}}}, False),
        ({"deviceInfo": {"device": {"type": None, "os": "Linux"}, "screen": {"w": 1}}}, True),
        ({"location": {"country": True}}, False),
        ({"location": {"country": "US"}}, True),
    ],
)
def test_strict_types(raw, change, ok):
    got = payload.parse_batches(raw([sdk_event(**change)])).first()
    assert (got["code"] is None) == ok


def test_repeated_key_keeps_the_last(raw):
    body = f'[{{"id":"a","id":"b","type":"click","timestamp":{NOW_MS},"sessionId":"s","url":"u","userAgent":"x"}}]'
    assert ingest.accepted_events(raw(body)).first()["event_id"] == "b"


def test_event_size_guard_is_optional(raw):
    big = raw([sdk_event(type="custom", name="n", properties={"x": "y" * 70000})])
    assert payload.parse_batches(big).first()["code"] is None
    assert payload.parse_batches(big, max_event_bytes=64 * 1024).first()["code"] == "VALID_003"


def test_messages_carry_the_index(raw):
    got = outcome(raw([sdk_event(), sdk_event(id=""), sdk_event(), sdk_event(url="")]))[0]
    assert (got["accepted"], got["rejected"], got["success"]) == (2, 2, True)
    assert got["errors"] == [
        "validation error: event[1]: validation error: id is required",
        "validation error: event[3]: validation error: url is required",
    ]


def test_binary_bodies(raw):
    bodies = raw([sdk_event()]).selectExpr("batch_id", "project_id", "cast(body AS BINARY) AS body", "received_at")
    invalid = bodies.selectExpr("1L AS batch_id", "project_id", "unhex('5BFF5D') AS body", "received_at")
    codes = {r["batch_id"]: r["code"] for r in payload.parse_batches(bodies.union(invalid)).collect()}
    assert codes == {0: None, 1: "VALID_001"}


def test_no_shuffle_until_outcomes(raw):
    plan = ingest.accepted_events(raw([sdk_event()]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchEvalPython" not in plan


def test_outcomes_need_no_shuffle_and_read_a_body_once(raw):
    found = ingest.outcomes_by_batch(raw([sdk_event(id="")], "not json"))
    plan = found.filter("success")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.lower().count("parsejson(") == 1
    assert found.filter("NOT success").first()["errors"] == []


def test_a_batch_delivered_twice_has_two_outcomes(raw):
    bodies = raw([sdk_event(), sdk_event(url="")])
    assert [r["accepted"] for r in ingest.outcomes_by_batch(bodies.union(bodies)).collect()] == [1, 1]


def test_bodies_are_built_by_one_grouping(spark):
    plan = adapters.raw_batches(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("collect_list(") == 2 and plan.count("Exchange hashpartitioning") == 1, plan


def test_absent_keys_are_not_looked_up_by_path(raw):
    one = sdk_event(location={"country": "C"}, deviceInfo={"device": {"type": "x"}})
    plan = payload.parse_batches(raw(one, [one, one], {"events": [one]}))._jdf.queryExecution().optimizedPlan().toString()
    assert "$.deviceInfo" not in plan and "$[2]" not in plan, plan


@pytest.mark.parametrize(
    "change,ok",
    [
        ({"deviceInfo": {"device": {"os": 5}}}, False),
        ({"deviceInfo": {"device": {"os": None}, "browser": None}}, True),
        ({"deviceInfo": {"device": "x"}}, False),
        ({"deviceInfo": []}, False),
        ({"deviceInfo": None, "location": None}, True),
        ({"location": {"city": ["x"]}}, False),
        ({"location": {"country": "C", "city": None}}, True),
        ({"location": "x"}, False),
        ({"referrer": False}, False),
        ({"referrer": None, "path": None}, True),
        ({"timestamp": None}, False),
        ({"timestamp": 1.5}, False),
    ],
)
@pytest.mark.parametrize("form", ["array", "wrapper", "single"])
def test_fields_of_every_shape_are_told_from_absent_ones(raw, form, change, ok):
    event = sdk_event(**change)
    body = {"array": [event], "wrapper": {"events": [event]}, "single": event}[form]
    row = payload.parse_batches(raw(body)).first()
    assert (row["shape"], row["code"], row["received"]) == (form, None if ok else "VALID_001", int(ok))


def test_an_events_key_of_any_type_makes_a_wrapper(raw):
    bodies = [{"events": e, "id": "x", "type": "click"} for e in (None, 5, "x", {}, {"id": "x"})]
    rows = payload.parse_batches(raw(*bodies, {"id": None, "type": None}, {"id": "x"})).orderBy("batch_id").collect()
    assert [(r["shape"], r["code"]) for r in rows] == [("wrapper", "VALID_001")] * 5 + [
        ("single", "VALID_001"), (None, "VALID_001"),
    ]
