"""Walks with inherited rules and CSV rows against plain versions."""

import csv
import random
from fnmatch import fnmatchcase

import pytest

from paperloom.functions.patterns import custom, resolve
from paperloom.sources import csvrows, listing


def plain_walk(paths, rules, top, bound):
    """Folder by folder, outer rule files before inner ones."""
    read = {}
    for folder, text in rules:
        out = []
        for line in map(str.strip, text.splitlines()):
            if line and not line.startswith("#"):
                again = line.startswith("!")
                line = line[1:].strip() if again else line[1:] if line.startswith("\\!") else line
                if line.rstrip("/"):
                    out.append((line.rstrip("/"), line.endswith("/"), again))
        read[folder] = out

    def out(node, is_folder):
        parts, gone = node.split("/"), False
        start = top if bound is None else bound
        for k in range(0, len(parts)):
            folder = "/".join(parts[:k])
            if not (folder == start or start == "" or folder.startswith(start + "/")):
                continue
            rel = "/".join(parts[k:])
            for pattern, only, again in read.get(folder, []):
                if only and not is_folder:
                    continue
                if fnmatchcase(rel, pattern.lstrip("/")) if "/" in pattern else fnmatchcase(parts[-1], pattern):
                    gone = not again
        return gone

    kept = []
    for p in paths:
        if top and not p.startswith(top + "/"):
            continue
        parts = p.split("/")
        if ".git" in parts[len(top.split("/")) if top else 0 :]:
            continue
        first = len(top.split("/")) + 1 if top else 1
        if not any(out("/".join(parts[:k]), k < len(parts)) for k in range(first, len(parts) + 1)):
            kept.append(p)
    return sorted(kept)


@pytest.mark.parametrize("top,bound", [("", None), ("a", None), ("a", ""), ("a/b", "a")])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_walk(spark, seed, top, bound):
    r = random.Random(seed)
    names = ["a", "b", "c.txt", "d.log", "e [1].txt", ".git", "build"]
    paths = sorted({"/".join([*(r.choice(["a", "b", "build", ".git", "a"]) for _ in range(r.randint(0, 4))), r.choice(names) + r.choice(["", ".x"])]) for _ in range(150)})
    paths = [p for p in paths if not any(q.startswith(p + "/") for q in paths)]
    lines = ["*.txt", "!c.txt", "build/", "/a/b", "a/*.x", "!a", "b", "# no", "", "\\!x", "*[1]*", "!*.log.x", "/*", "!/a/", "b/**"]
    rules = [(f, "\n".join(r.sample(lines, r.randint(0, 4)))) for f in ["", "a", "a/a", "a/b", "b", "a/b/a", "nowhere"]]
    got = listing.walk(spark.createDataFrame([(p,) for p in paths], "path string").repartition(2), spark.createDataFrame(rules, "folder string, text string"), top, bound)
    assert sorted(x["path"] for x in got.collect()) == plain_walk(paths, rules, top, bound)


def test_walk_patterns(spark):
    df = spark.createDataFrame([("a/b.py",), ("a/c/d.txt",), ("x/.h/e.py",), ("x/e.py",), (None,)], "path string")
    paths = lambda **k: sorted(x["path"] for x in listing.walk(df, **k).collect())
    assert paths(include=["*.py"]) == ["a/b.py", "x/.h/e.py", "x/e.py"]
    assert paths(exclude=["c", "x/.h"]) == ["a/b.py", "x/e.py"]
    assert paths(hidden=False, top="x") == ["x/e.py"]


CELLS = ["", "plain", "a,b", 'say "hi"', "two\nlines", '"', "\n\n", "x;y", " ", 'end,"\n']


def written(path, rows, delimiter=","):
    with open(path, "w", newline="") as f:
        csv.writer(f, delimiter=delimiter, lineterminator="\n").writerows(rows)
    return f"file://{path}"


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_by_number_over_splits(spark, tmp_path, seed):
    r = random.Random(seed)
    header = ["k", "v", "w"]
    rows = [[f"k{i}", r.choice(CELLS), r.choice(CELLS)] for i in range(400)]
    path = written(f"{tmp_path}/a.csv", [header, *rows])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got_header, got = csvrows.read_rows(spark, path)
        assert got_header == header and [(x["row"], x["cells"]) for x in got.orderBy("row").collect()] == [(i + 1, row) for i, row in enumerate(rows)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_differences_of_files(spark, tmp_path):
    a = written(f"{tmp_path}/a.csv", [["id", "x", "gone"], ["1", "a\nb", "-"], ["2", "c", "-"], ["3", "d", "-"]], ";")
    b = written(f"{tmp_path}/b.csv", [["x", "id", "new"], ["a\nc", "1", ""], ["c", "2", ""], ["d", "3", ""], ["e", "4", ""], ["f"]], ";")
    got = {tuple(r) for r in csvrows.file_diff(spark, a, b).collect()}
    assert got == {("column added", "new", None, None, None, None), ("column removed", "gone", None, None, None, None), ("rows added", None, 4, 5, None, None), ("changed", "x", 1, 1, "a\nb", "a\nc")}
    assert {tuple(r)[:4] for r in csvrows.file_diff(spark, b, a).collect()} >= {("rows removed", None, 4, 5)}
    empty = f"{tmp_path}/e.csv"
    open(empty, "w").close()
    assert {r["change"] for r in csvrows.file_diff(spark, f"file://{empty}", a).collect()} == {"column added", "rows added"}


def test_default_kinds_leave_personal_data_out():
    assert {k.group for k in resolve()} == {"reference", "identifier"} and [k.name for k in resolve(["CC ", "email", "cc"])] == ["cc", "email"]
    assert custom(" Tick=a+").name == "tick" and [k.name for k in resolve(group="pii")][:2] == ["email", "phone"]
