"""Sessions and state over events (user_id, ts, event_type): batch forms.

A session is a user's events without a gap of more than four hours.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_SECONDS = 4 * 3600


def _us(ts: str = "ts"):
    """Microseconds of a timestamp with or without zone; no session time zone comes in."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def numbered(events: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """events with session, the number of the user's session."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    late = _us() - F.lag(_us()).over(w) > gap * 1_000_000
    return events.withColumn("session", F.sum(F.when(late, 1).otherwise(0)).over(w))


def sessions(events: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    return numbered(events, gap).groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("last_active"), F.count("*").alias("n"))


def phases(events: DataFrame) -> DataFrame:
    """(event_id, phase) after each event. view reads, click edits, purchase runs, signup and error are
    builds that end well or badly. A build less than 300 s ago decides; else the last six tools do, of the
    session only: an expired one leaves no state."""
    events = numbered(events)
    w = Window.partitionBy("user_id", "session").orderBy("ts", "event_id")
    six = w.rowsBetween(-5, 0)
    n = lambda kind: F.count_if(F.col("event_type") == kind).over(six)
    build = F.when(F.col("event_type").isin("error", "signup"), F.struct(_us().alias("us"), "event_type"))
    last = F.last(build, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    fresh = _us() - last.us < 300_000_000
    rules = (
        F.when(F.count("*").over(w.rowsBetween(-2, 0)) < 3, "unknown").when((n("purchase") >= 2) & (n("click") >= 1), "debug").when((n("purchase") >= 1) & (n("click") == 0), "verify")
        .when(n("click") >= 2, "build").when(n("view") >= 3, "research").otherwise("unknown")
    )
    return events.select("event_id", F.when(fresh & (last.event_type == "signup"), "verify").when(fresh, "debug").otherwise(rules).alias("phase"))


def first_injected(events: DataFrame, item: str = "event_type") -> DataFrame:
    """The first event of each item in each session."""
    return numbered(events).groupBy("user_id", "session", item).agg(F.min(F.struct("ts", "event_id")).alias("m")).select("user_id", "session", item, "m.event_id")


def not_yet_injected(items: DataFrame, injected: DataFrame, keys: list[str]) -> DataFrame:
    return items.join(injected, keys, "left_anti")


def debounced(events: DataFrame, seconds: int = 120) -> DataFrame:
    """(event_id): events that notify; others follow their user's last notice within `seconds`. The last
    notice depends on all before it, so a user's event times are folded."""

    def fold(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out, last = [], None
        for t, e in sorted(zip(table["us"].to_pylist(), table["event_id"].to_pylist(), strict=True)):
            if last is None or t - last >= seconds * 1_000_000:
                out.append(e)
                last = t
        return pa.table({"event_id": pa.array(out, pa.int64())})

    return events.select("user_id", "event_id", _us().alias("us")).groupBy("user_id").applyInArrow(fold, "event_id long")


def focus(events: DataFrame, item: str = "event_type", least: int = 3) -> DataFrame:
    """(user_id, session, item, n): items with `least` hits in a session."""
    return numbered(events).groupBy("user_id", "session", item).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def latest(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the latest value of each key."""
    return events.groupBy(key).agg(F.max_by(value, F.struct("ts", "event_id")).alias(value))


def build_results(outputs: DataFrame) -> DataFrame:
    """outputs (id, command, output): builds with ok and up to five error lines of 11 to 299 characters."""
    lines = F.filter(F.split("output", "\n"), lambda x: x.contains("error") & (F.length(x) > 10) & (F.length(x) < 300))
    rows = outputs.where(F.col("command").rlike(r"\b(cargo (build|test|check)|make|npm (run|test))\b"))
    return rows.select("id", (F.size(lines) == 0).alias("ok"), F.slice(lines, 1, 5).alias("errors"))
