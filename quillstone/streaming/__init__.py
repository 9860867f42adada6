"""Structured Streaming forms. Each returns a started query that ends when its input is read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship


def session_stream(events: DataFrame, out: str, checkpoint: str, late: str = "30 minutes", gap: str = "4 hours") -> StreamingQuery:
    """Closed sessions of a stream of events, appended to Parquet once the watermark has passed them."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    rows = rows.select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ends"), "n")
    return rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def injected_stream(events: DataFrame, out: str, checkpoint: str, late: str = "4 hours") -> StreamingQuery:
    """The first event of each user and kind, again after the watermark has passed the last one."""
    rows = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(log: DataFrame, refresh, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Call refresh(batch) for each micro-batch of a log's change feed, so that a burst of writes makes
    one refresh; every: the trigger's interval, or once over all that is there."""
    w = log.writeStream.foreachBatch(lambda batch, _: refresh(batch)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def state_stream(events: DataFrame, out: str, checkpoint: str, late: str = "30 minutes", gap: int = 4 * 3600) -> StreamingQuery:
    """The state of each user's session over events (user_id, event_id, ts, event_type, note), in the order in
    which micro-batches bring them, by time within one.

    A row (user_id, event_id, phase, null) follows each event, with the phase that `sessions.phases` gives.
    Notes that aren't null are queued, and come as one row (user_id, null, null, notes) when the session has
    been idle for more than `gap` seconds: at the user's next event, or when the watermark passes that time.
    The state holds six tools, the last build, the last time and the queue; the checkpoint keeps it.
    """
    ship(events.sparkSession)
    columns = ["user_id", "event_id", "phase", "notes"]

    def phase(tools: list[str], build: tuple[int, str], us: int) -> str:
        if build[1] and us - build[0] < 300_000_000:
            return "verify" if build[1] == "signup" else "debug"
        reads, edits, runs = (tools.count(k) for k in ("view", "click", "purchase"))
        if len(tools) < 3:
            return "unknown"
        if runs:
            return "debug" if runs >= 2 and edits else "verify" if not edits else "build" if edits >= 2 else "research" if reads >= 3 else "unknown"
        return "build" if edits >= 2 else "research" if reads >= 3 else "unknown"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tools, at, kind, last, notes = state.get if state.exists else ([], 0, "", 0, [])
        tools, notes, rows = list(tools), list(notes), []
        if state.hasTimedOut:
            state.remove()
            if notes:
                yield pd.DataFrame([(key[0], None, None, notes)], columns=columns).astype({"event_id": "Int64"})
            return
        new = pd.concat(list(batches)).sort_values(["us", "event_id"])
        for event, us, what, note in zip(new["event_id"], new["us"], new["event_type"], new["note"], strict=True):
            if last and us - last > gap * 1_000_000:
                if notes:
                    rows.append((key[0], None, None, notes))
                tools, at, kind, notes = [], 0, "", []
            last, tools = max(last, us), (tools + [what])[-6:]
            if what in ("error", "signup"):
                at, kind = us, what
            if isinstance(note, str):
                notes = [*notes, note]
            rows.append((key[0], event, phase(tools, (at, kind), us), None))
        state.update((tools, int(at), kind, int(last), notes))
        state.setTimeoutTimestamp(max(int(last) // 1000 + gap * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=columns).astype({"event_id": "Int64"})

    rows = events.withWatermark("ts", late).select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "note")
    kept = rows.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_id long, phase string, notes array<string>", "tools array<string>, at long, kind string, last long, notes array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return kept.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
