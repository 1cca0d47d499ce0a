"""Ranked search over blocks against the search that reads all postings."""

import random

import pyarrow as pa
import pytest

from paperloom.operators import index, search

WORDS = ["common", "often", "seldom", "rare", "once"]


def docs(seed, n=3_000):
    r, out = random.Random(seed), []
    for i in range(n):
        length = r.choice([3, 10, 40, 400 if i % 50 == 0 else 30])
        out.append((f"d{i:05}", " ".join(r.choices([*WORDS, "filler", "stuff"], [30, 8, 2, 0.4, 0.03, 100, 100], k=length))))
    return out + [(f"dense{i}", "common " * 60 + "often seldom") for i in range(25)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = docs(5)
    folder = "file://" + str(tmp_path_factory.mktemp("index"))
    index.write(spark.createDataFrame(rows, "path string, content string"), folder)
    return spark.createDataFrame(rows, "path string, content string").cache(), folder


QUERIES = ["common", "rare", "once OR rare", "common often", "often NOT common", "(common OR seldom) rare", "common OR often OR seldom OR rare OR once", "absent", "absent OR rare", "absent common", '"common often"', "seld*"]


@pytest.mark.parametrize("q", QUERIES)
def test_top_gives_the_best_rows(spark, stored, q):
    table, folder = stored
    expected = [(r["path"], round(r["score"], 9)) for r in search.search(table, q, 20).collect()]
    assert [(r["path"], round(r["score"], 9)) for r in index.top(spark, folder, q, 20).collect()] == expected


def test_top_reads_few_postings(spark, stored):
    _, folder = stored
    heard = []
    assert index.top(spark, folder, "common", 20, heard).count() == 20
    whole = index.postings(spark, folder, ["common"]).count()
    assert sum(n for _, n in heard) < whole / 2, (heard, whole)


def test_top_over_generations(spark, tmp_path):
    folder, r = f"file://{tmp_path}/i", random.Random(3)
    rows = dict(docs(6, 600))
    old = {p: r.choice(["common common common", "rare", t]) for p, t in rows.items() if r.random() < 0.8}
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, content string")
    index.write(frame(old | {"gone1": "common rare", "gone2": "rare rare"}), folder)
    index.update(frame({p: rows[p] for p in rows if old.get(p) != rows[p]}), folder, removed=frame({"gone1": "", "gone2": ""}))
    index.compact(spark, folder, f"file://{tmp_path}/c")
    for q in ("common OR rare", "rare", "often seldom"):
        expected = [(x["path"], round(x["score"], 9)) for x in search.search(frame(rows), q, 15).collect()]
        for f in (folder, f"file://{tmp_path}/c"):
            assert [(x["path"], round(x["score"], 9)) for x in index.top(spark, f, q, 15).collect()] == expected


def test_index_of_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/e"
    index.write(spark.createDataFrame([("a", None), ("b", " .")], "path string, content string"), folder)
    assert index.top(spark, folder, "x").collect() == [] and index.search(spark, folder, "x").collect() == []


def test_postings_in_small_steps(spark, monkeypatch):
    """A batch is cut by its terms, so that a worker's memory doesn't grow with texts; rows of one key meet all the same."""
    batch = pa.RecordBatch.from_pydict({"path": ["a", "n", "b", "c"], "ts": [["x", "y", "x"], None, ["y"] * 5, []]})
    monkeypatch.setattr(search, "STEP", 3)
    got = [b.to_pylist() for b in search.posted(["path"])([batch])]
    assert got == [[{"term": "x", "path": "a", "tf": 2, "positions": [0, 2]}, {"term": "y", "path": "a", "tf": 1, "positions": [1]}], [{"term": "y", "path": "b", "tf": 5, "positions": [0, 1, 2, 3, 4]}]]
    shared = spark.createDataFrame([("k", "x"), ("k", "y x"), (None, "x"), (None, "x")], "path string, content string")
    assert sorted((r["term"], r["path"] or "", r["positions"], r["tf"]) for r in search.postings(shared).collect()) == [("x", "", [0, 0], 2), ("x", "k", [0, 1], 2), ("y", "k", [0], 1)]
    rows = search.postings(spark.createDataFrame([("a", "x y x"), ("b", None)], "path string, content string"))
    assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().toString() and rows.rdd.getNumPartitions() > 4


def test_marked_runs(spark, tmp_path):
    folder = f"file://{tmp_path}/m"
    df = spark.createDataFrame([("a", "One two, three; four five six seven eight nine ten eleven twelve Thirteen fourteen."), ("b", "thirteen two")], "path string, content string")
    index.write(df, folder)
    q = '"two three" OR thirteen'
    found = index.search(spark, folder, q)
    got = {r["path"]: r["snippet"] for r in index.marked(spark, folder, q, found, df).collect()}
    assert got == {"a": "… [two] [three] four five six seven eight nine ten eleven twelve [Thirteen] …", "b": "[thirteen] two"}
