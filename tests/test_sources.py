import io
import time
import zipfile

from pyspark.sql import functions as F

from paperloom.operators import catalog
from paperloom.operators.graph import components, depths
from paperloom.plans import intake
from paperloom.sources import files, html, mail
from paperloom.streaming import events

MAIL = b"""From: "Ann Acme" <ann@acme.example>
To: bob@example.org
Date: Tue, 03 Mar 2026 10:00:00 +0100
Subject: Invoice
Message-ID: <2@x>
In-Reply-To: <1@x>
Content-Type: text/plain; charset=utf-8

Invoice # INV-77
Total: $12.50
"""


def test_scan_detect_extract(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes("﻿hello".encode())
    (tmp_path / "a" / "m.eml").write_bytes(MAIL)
    (tmp_path / "p.html").write_text("<p>One</p><script>x</script><h1>Two &amp; three</h1>")
    (tmp_path / "j.json").write_text('{"a": {"b": [1, null]}}')
    (tmp_path / "fake.txt").write_bytes(b"%PDF-1.4")
    (tmp_path / ".hidden").write_text("no")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", "<x/>")
    (tmp_path / "d.bin").write_bytes(z.getvalue())
    found = {r["path"]: (r["type"], r["text"]) for r in files.extract_text(files.with_type(files.scan(spark, f"file://{tmp_path}"))).collect()}
    assert found["a/x.txt"] == ("txt", "hello") and found["fake.txt"] == ("pdf", None) and found["d.bin"] == ("docx", None)
    assert found["p.html"] == ("html", "One\n\nTwo & three") and found["j.json"] == ("json", "a.b.0: 1\na.b.1: None")
    assert found["a/m.eml"][0] == "eml" and "Subject: Invoice" in found["a/m.eml"][1] and ".hidden" not in found


def test_ignore_rules(spark):
    rules = files.parse_ignore("*.log\n!keep.log\nbuild/\n/top.txt\n# no\n")
    rows = spark.createDataFrame([(p,) for p in ("a.log", "x/b.log", "keep.log", "build/a", "x/build/a", "build", "top.txt", "x/top.txt")], "p string")
    assert {r[0] for r in rows.where(files.ignored(F.col("p"), rules)).collect()} == {"a.log", "x/b.log", "build/a", "x/build/a", "top.txt"}


def test_mail(spark):
    box = b"From a Tue 2026\n" + MAIL + b"\nFrom b Tue 2026\nSubject: two\n\n>From here\n"
    assert len(mail.split_mbox(box)) == 2 and b"\nFrom here" in mail.split_mbox(box)[1]
    s = spark.createDataFrame([(MAIL,)], "m binary").select(mail.summary("m").alias("s")).first()["s"]
    assert s["sender"] == ["ann@acme.example"] and s["in_reply_to"] == "<1@x>" and s["date"].hour == 9
    rows = spark.createDataFrame([("1", None, [], None), ("2", "1", ["1"], None), ("3", None, ["2", "0"], None), ("9", None, None, None)], "message_id string, in_reply_to string, references array<string>, date timestamp")
    got = mail.threads(rows, "message_id").select("message_id", "thread", "depth").collect()
    assert {tuple(r) for r in got} == {("1", "1", 1), ("2", "1", 2), ("3", "1", 1), ("9", "9", 1)}


def test_html():
    assert html.to_text("<div>a<br>b</div><style>c</style>") == "a\nb"


def test_intake_plan(spark):
    rows = [("in/1.txt", 0.0, b"Acme Ltd\nInvoice # INV-77\nInvoice date: 2026-03-04\nTotal: $12.50\n"), ("in/2.txt", 0.0, b"Acme Ltd\nInvoice # INV-78\nInvoice date: 2026-03-04\nTotal: $12.50\n"), ("in/3.txt", 86400.0, b"")]
    got = {r["path"]: r for r in intake.plan(spark.createDataFrame(rows, "path string, mtime double, content binary")).collect()}
    assert got["in/1.txt"]["to"] == "2026/03/2026-03-04_Acme_Ltd_12.50.txt" and got["in/2.txt"]["to"] == "2026/03/2026-03-04_Acme_Ltd_12.50-1.txt"
    assert got["in/1.txt"]["tags"] == ["ref:invoice:inv-77"] and got["in/3.txt"]["to"] == "1970/01/3.txt"


def test_one_target_for_many_files(spark):
    """Lists as long as a target's files, one for each of them, took 20,000 files (5,000 a target) beyond any time."""
    plan = spark.range(60_000).select(F.format_string("%06d", "id").alias("path"), F.concat(F.lit("a"), (F.col("id") % 2).cast("string"), F.lit(".txt")).alias("to"))
    held = [("a0-3.txt",), ("a0-02.txt",), ("a1.txt",), ("a1-1.txt",)]
    started = time.monotonic()
    got = {r["path"]: r["to"] for r in files.unique_targets(plan, spark.createDataFrame(held, "`to` string")).collect()}
    assert time.monotonic() - started < 60
    assert [got[f"{i:06d}"] for i in (0, 2, 4, 6, 59998)] == ["a0.txt", "a0-1.txt", "a0-4.txt", "a0-5.txt", "a0-30001.txt"]
    assert [got[f"{i:06d}"] for i in (1, 3, 59999)] == ["a1-2.txt", "a1-3.txt", "a1-30001.txt"] and len(set(got.values())) == 60_000


def test_graph(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a bigint, b bigint")
    assert {(r[0], r[1]) for r in components(chain).collect()} == {(i, 0) for i in range(51)} | {(100, 100), (101, 100)}
    replies = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (8, 9), (9, 8)], "n bigint, p bigint")
    assert {r["n"]: r["depth"] for r in depths(replies, "n", "p").collect()} == {1: 1, 2: 2, 3: 3, 8: None, 9: None}


def test_catalog(spark):
    tags = catalog.tags_add(spark.createDataFrame([], "path string, tag string"), spark.createDataFrame([("a", " X "), ("a", "x"), ("b", "y")], "path string, tag string"))
    assert sorted(map(tuple, tags.collect())) == [("a", "x"), ("b", "y")]
    assert catalog.tags_remove(tags, spark.createDataFrame([("a", "X")], "path string, tag string")).count() == 1
    moved = catalog.rename(tags, spark.createDataFrame([("a", "z")], "path string, to string"))
    assert {r["path"] for r in moved.collect()} == {"z", "b"}


def test_settling():
    state, fired = events.step(None, 0.0, "created", "s1", 5, 20)
    state, fired = events.step(state, 3.0, "modified", "s2", 5, 20)
    assert state == ("s2", 3.0, 0.0) and fired == []
    assert events.step(state, 9.0, "modified", "s3", 5, 20)[1] == [(8.0, "stable")]
    assert events.step(state, 4.0, "deleted", "s3", 5, 20) == (None, [(4.0, "deleted")])


def test_debounce_stream_agrees_with_batch(spark, tmp_path):
    rows = spark.sql("SELECT CAST(id % 3 AS STRING) path, id event_id, 'modified' event_type, timestamp_seconds(1700000000 + id * id) ts FROM range(60)")
    rows.write.parquet(f"{tmp_path}/in")
    batch = {(r["path"], r["start"], r["n_events"]) for r in events.debounce(rows, "30 seconds").collect()}
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = events.debounce(stream, "30 seconds", "1 second").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["path"], r["start"], r["n_events"]) for r in spark.table("bursts").collect()}
    assert got and got <= batch and len(batch - got) <= 3
