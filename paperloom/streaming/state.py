"""Stateful forms of the event operators, on transformWithState.

Each one is keyed, keeps its rows in state until the watermark has passed them, and takes
them then in order of (ts, event_id): late batches and any split into batches give what the
batch forms in `events` give. Timers wake a key at its next row or when something is due; a
key that waits for nothing holds no state. They need the RocksDB state store
(`use_rocksdb`), as transformWithState does.

Defined cases: rows with a null key are a key of their own; rows behind the watermark are
dropped by Spark; equal (ts, event_id) go in the order of their arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from paperloom.streaming.events import stem_key, step

_BUFFER = "us bigint, event_id bigint, kind string, path string, extra string"


def use_rocksdb(spark: SparkSession) -> None:
    """Set the state store that transformWithState asks for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Holds a key's rows back until the watermark has passed them; subclasses say what a row and a due time do.

    `held` is a subclass's state as a tuple, kept between calls in a value state of `schema`.
    """

    schema = "a string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", _BUFFER)
        self.state = handle.getValueState("held", self.schema)

    def row(self, held, r) -> tuple:
        """(new held, output rows) for a buffered row (us, event_id, kind, path, extra)."""
        raise NotImplementedError

    def due(self, held) -> int | None:
        """When held wants to be woken, in microseconds."""
        return None

    def wake(self, held, us: int) -> tuple:
        """(new held, output rows) at a due time that no row came before."""
        return None, []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for f in rows for r in f[["us", "event_id", "kind", "path", "extra"]].itertuples(index=False)]
        self.rows.appendList([(int(us), int(n), *rest) for us, n, *rest in new])
        yield self._advance(timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(timerValues.getCurrentWatermarkInMs())

    def _advance(self, watermark_ms: int) -> pd.DataFrame:
        """What rows and due times up to the watermark give; a timer for the next."""
        upto, held, out = watermark_ms * 1000, tuple(self.state.get()) if self.state.exists() else None, []
        rows = sorted((tuple(r) for r in self.rows.get()), key=lambda r: r[:2])
        ripe = [r for r in rows if r[0] < upto]
        for r in ripe:
            while held is not None and (due := self.due(held)) is not None and due < r[0]:
                held, more = self.wake(held, due)
                out += more
            held, more = self.row(held, r)
            out += more
        while held is not None and (due := self.due(held)) is not None and due < upto:
            held, more = self.wake(held, due)
            out += more
        left = rows[len(ripe) :]
        self.rows.put(left) if left else self.rows.clear()
        self.state.update(held) if held is not None else self.state.clear()
        next_ = [left[0][0]] if left else []
        next_ += [due] if held is not None and (due := self.due(held)) is not None else []
        if next_:
            self.handle.registerTimer(min(next_) // 1000 + 1)
        return pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class Settle(InOrder):
    """Fires a path once its signature has not changed for so long, or too long was waited, or at its deletion."""

    schema, columns = "signature string, since bigint, first bigint", ["path", "us", "reason"]

    def __init__(self, stable: float, timeout: float):
        self.stable, self.timeout = int(stable * 1_000_000), int(timeout * 1_000_000)

    def row(self, held, r):
        us, _, kind, path, signature = r
        self.path = path
        held, fired = step(held, us, kind, signature, self.stable, self.timeout)
        return held, [(path, t, why) for t, why in fired]

    def due(self, held):
        return min(held[1] + self.stable, held[2] + self.timeout)

    def wake(self, held, us):
        return None, [(self.key_path, us, "stable" if us == held[1] + self.stable else "timeout")]

    def handleInputRows(self, key, rows, timerValues):
        self.key_path = key[0]
        yield from super().handleInputRows(key, rows, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.key_path = key[0]
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)


class Suppress(InOrder):
    """Passes events but those within some seconds of an own move of the path."""

    schema, columns = "until bigint", ["path", "us", "event_id", "kind"]

    def __init__(self, seconds: float, own: str):
        self.us, self.own = int(seconds * 1_000_000), own

    def row(self, held, r):
        us, n, kind, path, _ = r
        if kind == self.own:
            return (us + self.us,), []
        return held, [] if held is not None and us <= held[0] else [(path, us, n, kind)]

    def due(self, held):
        return held[0]


class Inflight(InOrder):
    """Passes events but those on files in work and on outputs that keep a stem of one; keyed by what both begin with."""

    schema, columns = "working array<string>", ["path", "us", "event_id", "kind"]

    def __init__(self, start: str, end: str):
        self.start, self.end = start, end

    def row(self, held, r):
        us, n, kind, path, _ = r
        working = list(held[0]) if held is not None else []
        if kind == self.start:
            working.append(path)
        elif kind == self.end:
            if path in working:
                working.remove(path)
        else:
            return held, [] if any(output_of(path, w) for w in working) else [(path, us, n, kind)]
        return ((working,) if working else None), []


def output_of(path: str, source: str) -> bool:
    """Whether path is source, or is named after its stem with a further segment."""
    name, own = path.rsplit("/", 1)[-1], source.rsplit("/", 1)[-1]
    stem = own[: own.rindex(".")] if "." in own[1:] else own
    return path == source or name.startswith(stem + ".")


def _run(events: DataFrame, key, processor: InOrder, delay: str, schema: str) -> DataFrame:
    rows = events.withWatermark("ts", delay).select(
        key.alias("key"), "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("bigint").alias("event_id"), F.col("event_type").alias("kind"), "path", F.col("signature").cast("string").alias("extra")
    )
    return rows.groupBy("key").transformWithStateInPandas(processor, schema, "append", "EventTime")


def settle_stream(events: DataFrame, stable_seconds: float, timeout_seconds: float, delay: str = "0 seconds") -> DataFrame:
    """The streaming form of events.settled: (path, fired_at, reason) of events (path, ts, event_id, event_type, signature), in event time."""
    out = _run(events, F.col("path"), Settle(stable_seconds, timeout_seconds), delay, "path string, us bigint, reason string")
    return out.select("path", F.timestamp_micros("us").alias("fired_at"), "reason")


def suppress_stream(events: DataFrame, seconds: float = 2.0, own: str = "own-move", delay: str = "0 seconds") -> DataFrame:
    """The streaming form of events.suppress_own: own moves are events of their own kind in the stream."""
    out = _run(events, F.col("path"), Suppress(seconds, own), delay, "path string, us bigint, event_id bigint, kind string")
    return out.select("path", F.timestamp_micros("us").alias("ts"), "event_id", F.col("kind").alias("event_type"))


def inflight_stream(events: DataFrame, start: str = "started", end: str = "finished", delay: str = "0 seconds") -> DataFrame:
    """The streaming form of events.without_inflight: an action's start and end are events of its source's path."""
    out = _run(events, stem_key(F.col("path")), Inflight(start, end), delay, "path string, us bigint, event_id bigint, kind string")
    return out.select("path", F.timestamp_micros("us").alias("ts"), "event_id", F.col("kind").alias("event_type"))
