"""Links, listings, line differences and threads against plain versions."""

import difflib
import os
import random

from paperloom.operators import changes, linediff
from paperloom.sources import links, mail


def walk(path, table):
    """Where a path leads, step by step; None in a loop."""
    done, rest, nest = [], [(p, 0) for p in path.split("/") if p not in ("", ".")], []
    rooted = path.startswith("/")
    while rest:
        p, _ = rest.pop(0)
        nest = [n for n in nest if n[1] <= len(rest)]
        if p == "..":
            done = done[:-1]
            continue
        at = ("/" if rooted else "") + "/".join([*done, p])
        if at not in table:
            done.append(p)
            continue
        if table[at] is None or at in [n[0] for n in nest]:
            return None
        nest.append((at, len(rest)))
        if table[at].startswith("/"):
            rooted, done = True, []
        rest = [(q, 0) for q in table[at].split("/") if q not in ("", ".")] + rest
    return ("/" if rooted else "") + "/".join(done)


def test_links_against_a_walk(spark):
    rng = random.Random(3)
    names = "abcd"
    some = lambda n: "/".join(rng.choice(names) for _ in range(rng.randint(1, n)))
    table = {}
    for _ in range(14):
        table[some(3)] = rng.choice(["", "", "../", "../../", "/", "./"]) + some(3) + rng.choice(["", "", "/..", "/"])
    chain = {f"x/{i}": f"{i + 1}" for i in range(9)}
    table |= chain | {"self": "self", "grows": "grows/a", "p": "q", "q": "p", "n": None, "twice": "x/0"}
    paths = [some(5) for _ in range(200)] + ["x/0", "x/0/y", "self", "self/z", "grows", "p/x", "n", "twice/../x/3", "a//b/./c", "/a/b", "../a", "a/../../b"]
    got = links.resolved(spark.createDataFrame([(p,) for p in [*paths, None, paths[0]]], "path string"), spark.createDataFrame([*table.items(), (None, "a")], "path string, target string")).collect()
    assert {r["path"]: r["resolved"] for r in got} == {p: walk(p, table) for p in paths}
    assert all(r["looped"] == (r["resolved"] is None) for r in got) and len(got) == len(set(paths)) and sum(r["looped"] for r in got) >= 5
    none = spark.createDataFrame([], "path string, target string")
    assert links.resolved(none.select("path"), none).count() == 0


def test_links_of_a_disk(spark, tmp_path):
    root = os.path.realpath(tmp_path)
    for f in ("in/a/f", "out/f", "in/b/g"):
        os.makedirs(os.path.dirname(f"{root}/{f}"), exist_ok=True)
        open(f"{root}/{f}", "w").close()
    made = {"in/l": "a", "in/o": "../out", "in/b/up": "../l/f", "in/abs": f"{root}/out/f", "in/gone": "nothing/here", "in/l2": "l/../b"}
    for at, to in made.items():
        os.symlink(to, f"{root}/{at}")
    paths = [f"{root}/{p}" for p in ("in/a/f", "in/l/f", "in/o/f", "in/b/up", "in/abs", "in/gone", "in/l2/g", "in/../out/f", "input")]
    files = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, `x.y` int")
    table = spark.createDataFrame([(f"{root}/{a}", t) for a, t in made.items()], "path string, target string")
    assert {r["path"]: r["resolved"] for r in links.resolved(files, table).collect()} == {p: os.path.realpath(p) for p in paths}
    kept = links.confined(files, table, f"{root}/in/")
    assert kept.columns == ["path", "x.y"] and {r["path"] for r in kept.collect()} == {p for p in paths if os.path.realpath(p).startswith(f"{root}/in/")}


def test_changes(spark):
    rng = random.Random(1)
    old = {f"{rng.choice('ab')}/{rng.choice('xyz')}/{i}" if i % 9 else f"top{i}": str(rng.randint(0, 3)) for i in range(200)}
    new = {p + rng.choice([""] * 30 + ["n"]): h if rng.random() < 0.95 else None for p, h in old.items() if rng.random() < 0.97}
    frame = lambda x: spark.createDataFrame([*x.items(), (None, "h")], "path string, hash string")
    want = {(p, "removed") for p in old if p not in new} | {(p, "added") for p in new if p not in old} | {(p, "changed") for p in old if p in new and old[p] != new[p]}
    assert {tuple(r) for r in changes.changed_paths(frame(old), frame(new)).collect()} == want
    assert changes.changed_paths(frame(old), frame(old)).count() == 0
    assert {tuple(r) for r in changes.changed_paths(frame(old).limit(0), frame(old)).collect()} == {(p, "added") for p in old}
    sums = {r["folder"]: r["files"] for r in changes.tree_sums(frame(old)).collect()}
    assert sums[""] == 200 and sums["a"] == sum(p.startswith("a/") for p in old) and sums["b/x"] == sum(p.startswith("b/x/") for p in old)


def test_line_differences(spark):
    rng = random.Random(7)
    old, new = {}, {}
    for k in range(21):
        words = [f"w{rng.randrange(4 if k % 3 else 1000)}" for _ in range(rng.randint(0, 18))]
        out = []
        for w in words:
            r = rng.random()
            out += [] if r < 0.1 else [f"n{rng.random()}"] if r < 0.2 else [w, rng.choice(words)] if r < 0.3 else [w]
        old[k], new[k] = words, out if k % 10 else words
    old[100], new[101] = ["only", "here"], ["only", "there"]
    old[102], new[102] = ["a", "b"], []
    frame = lambda x: spark.createDataFrame([*((k, "\n".join(v)) for k, v in x.items()), (None, "t"), (200, None)], "id int, body string")
    # A joined empty list and one empty line are the same text.
    rows = linediff.edits(frame(old), frame(new), "id", "body").orderBy("key", "place").collect()
    sides = {s: {} for s in "-+"}
    for r in rows:
        for s in "-+":
            if r["sign"] in (" ", s):
                sides[s].setdefault(r["key"], []).append(r["line"])
    assert sides["-"] == {k: v for k, v in old.items() if v} and sides["+"] == {k: v for k, v in new.items() if v}
    gaps = {}
    for r in rows:
        gap = gaps.setdefault(r["key"], [])
        if r["sign"] == " ":
            gap.clear()
        else:
            assert all(s == r["sign"] or line != r["line"] for s, line in gap)
            gap.append((r["sign"], r["line"]))
    assert all(r["sign"] == " " for r in rows if r["key"] < 21 and r["key"] % 10 == 0)


def test_line_differences_keep_little(spark, monkeypatch):
    """What the rounds keep and shuffle are open lines with digests of 16 bytes."""
    seen, keep = [], linediff.keep
    monkeypatch.setattr(linediff, "keep", lambda df: seen.append(keep(df)) or seen[-1])
    rows = lambda mark: spark.createDataFrame([(k, "\n".join(f"{k} line {i}{mark if i % 7 == 3 else ''}" for i in range(30))) for k in range(3)], "key int, text string")
    a, b = linediff.lines(rows("")), linediff.lines(rows("x"))
    assert sorted(map(tuple, linediff.matched(a, b).collect())) == [(k, i, i) for k in range(3) for i in range(1, 31) if (i - 1) % 7 != 3]
    sides = [df for df in seen if "h" in df.columns]
    assert {len(r["h"]) for df in sides for r in df.collect()} == {16}
    assert [df.count() for df in sides] == [90, 90, 12, 12]


def test_unified(spark):
    """Where lines stand once, the difference has one best form."""
    rng = random.Random(2)
    old = {k: [f"{k} line {i}" for i in range(rng.choice([1, 5, 40, 120]))] for k in range(25)}
    new = {k: [x for i, v in enumerate(old[k]) for x in ([] if rng.random() < 0.05 else [f"new {i}", v] if rng.random() < 0.05 else [f"other {i}"] if rng.random() < 0.04 else [v])] for k in old}
    frame = lambda x: spark.createDataFrame([(k, "\n".join(v) + "\n" * bool(v)) for k, v in x.items()], "key int, text string")
    got = {r["key"]: r["diff"] for r in linediff.unified(frame(old), frame(new)).collect()}
    want = {k: "\n".join(difflib.unified_diff(old[k], new[k], "a", "b", lineterm="")) for k in old if old[k] != new[k]}
    assert got == want and len(want) > 10


def test_threads(spark):
    """Against links followed one by one: absent parents, copies, mails without ids, loops."""
    rng = random.Random(11)
    mails = []
    for i in range(300):
        name = lambda: f"<{rng.randrange(260)}>"
        mails.append((f"{i:04d}", rng.choice([None, "", *[name() for _ in range(8)]]), rng.choice([None, None, name()]), [name() for _ in range(rng.choice([0, 0, 0, 0, 1]))] or None))
    mails += [("x1", "<x1>", "<x2>", None), ("x2", "<x2>", "<x1>", []), ("x3", "<x3>", "<x2>", []), ("x4", "<x4>", "<x4>", []), ("y1", "<y1>", "<gone>", []), ("y2", "<y2>", "<gone>", [])]
    holder = {}
    for w, id_, *_ in mails:
        if id_:
            holder.setdefault(id_, w)
    group = {w: {w} for w, *_ in mails}
    up = {w: holder.get(p) for w, _, p, _ in mails}
    for w, id_, p, refs in mails:
        for name in [id_, p, *(refs or [])]:
            if name in holder and group[w] is not group[holder[name]]:
                both = group[w] | group[holder[name]]
                for x in both:
                    group[x] = both

    def depth(w):
        seen = []
        while w and w not in seen:
            seen.append(w)
            w = up[w]
        return len(seen)

    day = {w: None if i % 4 == 0 else f"2024-01-{1 + i * 7 % 28:02d} 00:00:00" for i, (w, *_) in enumerate(mails)}
    first = {w: min(group[w], key=lambda x: (day[x] is None, day[x] or "", x)) for w, *_ in mails}
    rows = spark.createDataFrame([(*m, day[m[0]], 1) for m in mails], "where string, message_id string, in_reply_to string, references array<string>, d string, thread int").selectExpr("*", "CAST(d AS timestamp) AS date")
    got = {r["where"]: (r["thread"], r["depth"]) for r in mail.threads(rows).collect()}
    assert got == {w: (first[w], depth(w)) for w, *_ in mails}
    assert got["x1"][1] == 2 and got["x3"][1] == 3 and got["x4"][1] == 1 and got["y1"][0] != got["y2"][0]
    assert mail.threads(rows.limit(0)).count() == 0
