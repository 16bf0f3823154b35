"""Sessions as custom state: they end on an explicit event or by timeout."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.schemas import SESSION_TIMEOUT_MINUTES
from tidegauge.session import ship_package
from tidegauge.streaming.windows import DELAY

_COMBINED = "project_id string, session_id string, slot bigint, first_ms bigint, last_ms bigint, events bigint, ended boolean, last_at timestamp"
_RESULT = "project_id string, session_id string, started_at timestamp, last_active_at timestamp, event_count bigint, duration_ms bigint, end_reason string"
#: The entries of a bucket as an Arrow stream.
_STATE = "entries binary"
_SLOT_MS = 1000
_SESSION = ["project_id", "session_id"]
_FIELDS = ["slot", "first_ms", "last_ms", "events", "ended"]
#: Rows of new batches that are merged at once, at least.
_MERGE_ROWS = 10_000


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """One entry per session and second."""
    return rows.groupby([*_SESSION, "slot"], as_index=False, sort=False, dropna=False).agg(
        first_ms=("first_ms", "min"), last_ms=("last_ms", "max"), events=("events", "sum"), ended=("ended", "any")
    )


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shrink each Arrow batch to one row per session and second before the shuffle."""
    for batch in batches:
        merged = _merged(batch)
        merged["last_at"] = pd.to_datetime(merged["last_ms"], unit="ms")
        yield merged


def _fold(held: pd.DataFrame | None, batches: Iterable[pd.DataFrame]) -> pd.DataFrame:
    """Merge entries into ``held`` as they stream in, as many at a time as are held: each is merged a few times only."""
    parts, waiting, size = [] if held is None else [held], 0, 0 if held is None else len(held)
    for batch in batches:
        parts.append(batch[[*_SESSION, *_FIELDS]])
        waiting += len(batch)
        if waiting >= max(size, _MERGE_ROWS):
            parts, waiting = [_merged(pd.concat(parts))], 0
            size = len(parts[0])
    return _merged(pd.concat(parts)) if len(parts) > 1 or waiting else parts[0]


def _packed(entries: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(entries, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def _visits(entries: pd.DataFrame, gap_ms: int) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
    """Neighbouring slots of a session at most ``gap_ms`` apart with no end between them.

    The visits, with the time at which each closes; the entries in order of session and time; the visit of each.
    """
    session = entries.groupby(_SESSION, sort=False, dropna=False).ngroup().to_numpy()
    order = np.lexsort((entries["slot"].to_numpy(), session))
    entries, session = entries.iloc[order], session[order]
    slot, first, last, events, ended = (entries[name].to_numpy() for name in _FIELDS)
    opens = np.ones(len(entries), dtype=bool)
    opens[1:] = (session[1:] != session[:-1]) | ended[:-1] | (first[1:] - last[:-1] > gap_ms)
    starts = np.flatnonzero(opens)
    ends = np.append(starts[1:], len(entries)) - 1
    visits = entries[_SESSION].iloc[starts].assign(
        first_ms=first[starts],
        last_ms=last[ends],
        events=np.add.reduceat(events, starts),
        ended=ended[ends],
        close_at=np.where(ended[ends], (slot[ends] + 1) * _SLOT_MS, last[ends] + gap_ms + 1),
    )
    return visits, entries, np.cumsum(opens) - 1


def stateful_sessions(
    events: DataFrame, minutes: int = SESSION_TIMEOUT_MINUTES, delay: str = DELAY, buckets: int = 1024
) -> DataFrame:
    """Closed sessions: ``end_reason`` is "ended" after a ``session_end`` event, else "timeout".

    What follows an end opens a new session; events of the same second still belong to the ended one. A session is
    returned once the watermark has passed its end, so the result does not depend on how events fall into
    micro-batches. Rows reach the state function combined per second, and the state holds one entry per second with
    events of the sessions still open: a session of any number of events stays bounded by its time.

    A call of the state function costs milliseconds, whatever it holds, so sessions share one by hash: a bucket is
    handled as arrays. A bucket with news or with sessions to close is read and stored whole, and it is one unit of
    memory, about a hundred bytes an entry: let ``buckets`` be several times the cores, and a millionth of the open
    entries at least. Like the number of shuffle partitions it is fixed with the first start on a checkpoint.
    """
    gap_ms = minutes * 60_000
    ship_package(events.sparkSession)
    millis = F.unix_millis("timestamp")
    prepared = events.where("timestamp IS NOT NULL").select(
        "project_id",
        "session_id",
        F.floor(millis / _SLOT_MS).cast("bigint").alias("slot"),
        millis.alias("first_ms"),
        millis.alias("last_ms"),
        F.lit(1).cast("bigint").alias("events"),
        F.coalesce(F.col("event_type") == "session_end", F.lit(False)).alias("ended"),
    )
    combined = prepared.mapInPandas(_combine, _COMBINED).withWatermark("last_at", delay)
    bucketed = combined.withColumn("bucket", F.pmod(F.xxhash64(*_SESSION), F.lit(buckets)))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _unpacked(state.get[0]) if state.exists else None
        visits, entries, visit = _visits(_fold(held, () if state.hasTimedOut else batches), gap_ms)
        open_ = visits["close_at"].to_numpy() > state.getCurrentWatermarkMs()
        if open_.any():
            state.update((_packed(entries[open_[visit]]),))
            # Something closes when the watermark is beyond this.
            state.setTimeoutTimestamp(max(int(visits["close_at"][open_].min()) - 1, 1))
        elif state.exists:
            state.remove()
        closed = visits[~open_]
        if len(closed):
            yield pd.DataFrame(
                {
                    "project_id": closed["project_id"],
                    "session_id": closed["session_id"],
                    "started_at": pd.to_datetime(closed["first_ms"], unit="ms"),
                    "last_active_at": pd.to_datetime(closed["last_ms"], unit="ms"),
                    "event_count": closed["events"],
                    "duration_ms": closed["last_ms"] - closed["first_ms"],
                    "end_reason": np.where(closed["ended"], "ended", "timeout"),
                }
            )

    return bucketed.groupBy("bucket").applyInPandasWithState(
        update, _RESULT, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
