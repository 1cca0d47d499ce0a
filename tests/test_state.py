"""Streams of events against their batch forms."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from paperloom.streaming import events as batch
from paperloom.streaming import state

SCHEMA = "path string, event_id bigint, ts timestamp, event_type string, signature string"
START = dt.datetime(2024, 1, 1)


def made(seed, kinds, paths, n=120, seconds=900):
    """Batches of events: late by up to 60 s, and split at random; a last event far ahead closes all."""
    r = random.Random(seed)
    rows = [(r.choice(paths), i, START + dt.timedelta(milliseconds=r.randrange(seconds * 1000)), r.choice(kinds), r.choice("abc")) for i in range(n)]
    rows.sort(key=lambda x: (x[2] + dt.timedelta(seconds=r.uniform(0, 60))))
    cut = sorted(r.sample(range(1, n), 4))
    batches = [rows[a:b] for a, b in zip([0, *cut], [*cut, n])]
    return rows, [*batches, [("zz.end", 10**6, START + dt.timedelta(days=9), "seen", "a")], [("zz.end", 10**6 + 1, START + dt.timedelta(days=10), "seen", "a")]]


def streamed(spark, tmp_path, batches, make):
    """Rows of make(stream) over the batches, one micro-batch each."""
    state.use_rocksdb(spark)
    folder, name = f"{tmp_path}/in", f"t{uuid.uuid4().hex}"
    spark.createDataFrame([], SCHEMA).write.json(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(folder)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        for b in batches:
            spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").json(folder)
            q.processAllAvailable()
        q.processAllAvailable()
        return spark.table(name).where("path <> 'zz.end'").collect()
    finally:
        q.stop()


@pytest.mark.parametrize("stable,timeout", [(40.0, 150.0), (7.5, 1e6)])
def test_settle(spark, tmp_path, stable, timeout):
    rows, batches = made(1, ["created", "modified", "modified", "deleted"], ["a", "b", "c/d"])
    expected = batch.settled(spark.createDataFrame(rows, SCHEMA), stable, timeout).collect()
    got = streamed(spark, tmp_path, batches, lambda s: state.settle_stream(s, stable, timeout, "70 seconds"))
    key = lambda r: (r["path"], r["fired_at"], r["reason"])
    assert sorted(map(key, got)) == sorted(map(key, expected)) and len(got) > 10


def test_suppress(spark, tmp_path):
    rows, batches = made(2, ["created", "modified", "own-move"], ["a", "b"])
    df = spark.createDataFrame(rows, SCHEMA)
    expected = batch.suppress_own(df.where("event_type <> 'own-move'"), df.where("event_type = 'own-move'"), 12.0).select("event_id").collect()
    got = streamed(spark, tmp_path, batches, lambda s: state.suppress_stream(s, 12.0, delay="70 seconds"))
    assert sorted(r["event_id"] for r in got) == sorted(r["event_id"] for r in expected) and 0 < len(got) < len(rows)


def test_inflight(spark, tmp_path):
    rows, _ = made(3, ["created", "modified"], ["in/report.pdf", "out/report.txt", "out/report.thumb.png", "report-2.pdf", "a.tar.gz", "x/a.tar.zip", "x/a.txt", "plain", "plain.md"], 200)
    r, n = random.Random(4), 1000
    runs = []
    for source in ("in/report.pdf", "a.tar.gz", "plain"):
        at = START
        for _ in range(6):
            begin = at + dt.timedelta(seconds=r.uniform(20, 90))
            at = begin + dt.timedelta(seconds=r.uniform(5, 60))
            runs.append((source, begin, at))
            rows += [(source, n, begin, "started", None), (source, n + 1, at, "finished", None)]
            n += 2
    rows.sort(key=lambda x: x[2])
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)] + [[("zz.end", 10**6 + k, START + dt.timedelta(days=9 + k), "seen", "a")] for k in (0, 1)]
    events = spark.createDataFrame(rows, SCHEMA).where("event_type NOT IN ('started', 'finished')")
    expected = {x["event_id"] for x in batch.without_inflight(events, spark.createDataFrame(runs, "path string, started timestamp, finished timestamp")).collect()}
    plain = {e[1] for e in rows if e[3] not in ("started", "finished") and not any(a <= e[2] < b and state.output_of(e[0], s) for s, a, b in runs)}
    got = streamed(spark, tmp_path, batches, lambda s: state.inflight_stream(s))
    assert {x["event_id"] for x in got} == expected == plain and 0 < len(expected) < 200


def test_batch_forms_keep_rows_that_nothing_blocks(spark):
    e = spark.createDataFrame([("a.b", 1, START, "created", "x"), (None, 2, START, "created", "x")], SCHEMA)
    runs = spark.createDataFrame([("a.c", START, None)], "path string, started timestamp, finished timestamp")
    assert [r["event_id"] for r in batch.without_inflight(e, runs).collect()] == [2]
    assert e.select(batch.stem_key(F.col("path")).alias("k")).collect()[0]["k"] == "a"
