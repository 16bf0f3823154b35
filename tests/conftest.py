import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidegauge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = tmp_path_factory.mktemp("spark")
    session = local_session(
        8,
        "tests",
        **{
            "spark.sql.warehouse.dir": str(scratch / "warehouse"),
            "spark.checkpoint.dir": str(scratch / "checkpoints"),
        },
    )
    yield session
    session.stop()


NOW_MS = 1704110400000  # 2024-01-01 12:00:00 UTC
NOW = "2024-01-01 12:00:00"


def sdk_event(**changes):
    event = {
        "id": "e-1",
        "type": "pageview",
        "timestamp": NOW_MS,
        "sessionId": "s-1",
        "url": "https://example.com/foo/bar?x=1",
        "userAgent": "agent",
    }
    event.update(changes)
    return {k: v for k, v in event.items() if v is not ...}


@pytest.fixture
def raw(spark):
    """Bodies (text or JSON values) to a raw batch table; batch_id is the position."""

    def build(*bodies):
        rows = [
            (i, "proj-1", b if isinstance(b, str) else json.dumps(b, ensure_ascii=False)) for i, b in enumerate(bodies)
        ]
        frame = spark.createDataFrame(rows, "batch_id BIGINT, project_id STRING, body STRING")
        return frame.selectExpr("*", f"timestamp'{NOW}' AS received_at")

    return build
