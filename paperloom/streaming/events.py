"""File-style events: debouncing, settling, suppression, routing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wanted(events: DataFrame, kinds: list[str] | None = None, glob: str | None = None) -> DataFrame:
    """Events of the kinds (`existing` always passes) whose path meets the glob."""
    from paperloom.functions.text import base_name, glob_pattern

    if kinds:
        events = events.where(F.col("event_type").isin(*kinds, "existing"))
    return events if glob is None else events.where(base_name(F.col("path")).rlike(glob_pattern(glob)))


def debounce(events: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """(path, start, end, n_events, last_type): bursts of a path with no pause over the gap.

    Works on batches and, with a watermark, on streams; an event at just the gap belongs to the burst.
    """
    if watermark:
        events = events.withWatermark("ts", watermark)
    window = F.session_window("ts", gap)
    grouped = events.groupBy("path", window.alias("w")).agg(F.count("*").alias("n_events"), F.max("ts").alias("end"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    return grouped.select("path", F.col("w.start").alias("start"), "end", "n_events", "last_type")


def settled(events: DataFrame, stable_seconds: float, timeout_seconds: float) -> DataFrame:
    """(path, fired_at, reason): when a path's signature (value) stayed the same long enough, or too long was waited.

    One path's events are folded in order of time, in microseconds; `deleted` passes at once.
    The same state machine serves batches (here) and streams (state.settle_stream).
    """
    stable, timeout = int(stable_seconds * 1_000_000), int(timeout_seconds * 1_000_000)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, state = [], None
        for r in pdf.sort_values(["us", "event_id"]).itertuples():
            state, fired = step(state, r.us, r.event_type, r.signature, stable, timeout)
            rows += [(r.path, t, why) for t, why in fired]
        if state:
            t = min(state[1] + stable, state[2] + timeout)
            rows.append((pdf.path.iloc[0], t, "stable" if t == state[1] + stable else "timeout"))
        return pd.DataFrame(rows, columns=["path", "us", "reason"]).astype({"us": "int64"})

    found = events.select("path", "event_id", F.unix_micros("ts").alias("us"), "event_type", "signature").groupBy("path").applyInPandas(fold, "path string, us bigint, reason string")
    return found.select("path", F.timestamp_micros("us").alias("fired_at"), "reason")


def step(state, now: int, kind: str, signature, stable: int, timeout: int):
    """(new state, fired): state is (signature, unchanged since, first seen) or None."""
    fired = []
    if state:
        due = min(state[1] + stable, state[2] + timeout)
        if now >= due:
            fired.append((due, "stable" if due == state[1] + stable else "timeout"))
            state = None
    if kind == "deleted":
        return None, [*fired, (now, "deleted")]
    if state is None:
        return (signature, now, now), fired
    return (state if state[0] == signature else (signature, now, state[2])), fired


def suppress_own(events: DataFrame, moves: DataFrame, seconds: float = 2.0) -> DataFrame:
    """Events that do not follow an own move of the path within some seconds."""
    own = moves.select("path", F.col("ts").alias("_moved"))
    near = (events["path"] == own["path"]) & (F.col("ts") >= F.col("_moved")) & (F.col("ts") <= F.col("_moved") + F.expr(f"INTERVAL {seconds} SECOND"))
    return events.join(own, near, "left_anti")


def stem_key(path: Column) -> Column:
    """The first segment of a file's name, which it shares with all outputs that keep its stem."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.element_at(F.split(name, r"\."), 1)


def without_inflight(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Events but those during a run (path, started, finished) on its own file or on outputs that keep its stem.

    An output is named after the source's stem with a further segment: report.txt of
    report.pdf, not report-2.pdf. A run without an end is in work for good; at its very start
    and end events count as within and after it.
    """
    source = runs.select(stem_key(F.col("path")).alias("_key"), F.col("path").alias("_source"), F.col("started").alias("_from"), F.col("finished").alias("_to"))
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    own = F.element_at(F.split(F.col("_source"), "/"), -1)
    stem = F.coalesce(F.nullif(F.regexp_extract(own, r"^(.+)\.[^.]*$", 1), F.lit("")), own)
    within = (F.col("ts") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("ts") < F.col("_to")))
    blocked = within & ((F.col("path") == F.col("_source")) | F.startswith(name, F.concat(stem, F.lit("."))))
    keyed = events.withColumn("_stem", stem_key(F.col("path")))
    return keyed.join(source, (F.col("_stem") == F.col("_key")) & blocked, "left_anti").drop("_stem")


def route(batch: DataFrame, done: str, failed: str, ok: Column) -> None:
    """For foreachBatch: records of good runs to one folder, of failed ones to another, as JSON lines."""
    batch.where(ok).write.mode("append").json(done)
    batch.where(~ok).write.mode("append").json(failed)
