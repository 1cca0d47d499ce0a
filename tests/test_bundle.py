"""Bundles against rendering and filling one after another."""

import json
import math
import random
import re

import pytest

from paperloom.operators import bundle

KINDS = "path string, content string, size bigint, kind string"
LIMIT = 300


def files(seed, n=40):
    r = random.Random(seed)
    out = []
    for i in range(n):
        line = lambda: "".join(r.choice("ab `]>\"\\é") for _ in range(r.choice([0, 3, 20, 400])))
        text = r.choice(["\n", "\r\n", "\n\n"]).join(line() for _ in range(r.choice([0, 1, 4, 60]))) + r.choice(["", "\n", "\n\n"])
        folder = r.choice(["", "a/", "a/b/", "z z/", "a-b/"])
        out.append((f"{folder}f{i}{r.choice(['.py', '.txt', '.MD', '', '.q'])}", text, len(text.encode()), r.choice(["text"] * 5 + ["image", "binary"])))
    out += [(f"copy{i}.txt", out[i][1], out[i][2], "text") for i in range(5)]
    r.shuffle(out)
    return out


def plain_entries(rows, most, budget):
    used, hit, seen, out = 0, False, {}, {}
    for path, text, size, kind in sorted(rows):
        same = None
        if size > most:
            why = "too-large"
        elif kind != "text":
            why = kind
        elif text in seen:
            why, same = "copy", seen[text]
        elif hit or used + size > budget:
            hit, why = True, "over-budget"
        else:
            why, used, seen[text] = None, used + size, path
        out[path] = (why, same)
    return out


def plain_tree(notes, root):
    top = {}
    for path, note in notes.items():
        *folders, name = path.split("/")
        at = top
        for f in folders:
            at = at.setdefault((0, f), {})
        at[(1, name)] = note
    lines = [root + "/"]

    def walk(node, before):
        for i, (key, below) in enumerate(sorted(node.items())):
            end = i == len(node) - 1
            lines.append(before + ("└── " if end else "├── ") + key[1] + ("/" if not key[0] else below))
            if not key[0]:
                walk(below, before + ("    " if end else "│   "))

    walk(top, "")
    return lines


@pytest.mark.parametrize("seed", [1, 2])
def test_entries(spark, seed):
    rows = files(seed)
    got = bundle.entries(spark.createDataFrame(rows, KINDS).repartition(3), most=5_000, budget=9_000, dedupe=True).collect()
    assert {r["path"]: (r["skipped"], r["same_as"]) for r in got} == plain_entries(rows, 5_000, 9_000)


def test_tree(spark):
    rows = {r[0]: f" [{i}]" for i, r in enumerate(files(3))}
    lines = bundle.tree_lines(spark.createDataFrame(list(rows.items()), "path string, note string").repartition(3), "desk").orderBy("place").collect()
    assert [r["line"] for r in lines] == plain_tree(rows, "desk")


def fence(text):
    return "`" * max(3, 1 + max((len(x) for x in re.findall("`+", text)), default=0))


def plain_document(head, tree, parts):
    """A markdown document as it is told: lines joined, ends cut."""
    out = [head.rstrip("\n")]
    if tree is not None:
        mark = fence("\n".join(tree))
        out += ["", "## Tree", "", mark, *tree, mark]
    if parts:
        out += ["", "## Files", ""] + parts
    return "\n".join(out).rstrip("\n") + "\n"


def plain_section(path, text, continued):
    body = text.rstrip("\n")
    suffix = re.search(r"(?<=.)\.[^./]*$", path.rsplit("/")[-1])
    suffix = suffix[0].lower() if suffix else ""
    return f"### `{path}`{' (continued)' if continued else ''}\n\n{fence(body)}{bundle.LANGUAGES.get(suffix, suffix[1:])}\n{body}\n{fence(body)}\n"


def tokens(text):
    return math.ceil(len(text) / 3.6)


def plain_parts(head, tree, texts, most):
    """[(path, text, continued)] of each document."""
    pieces = []
    for path, text in sorted(texts.items()):
        if tokens(plain_document(head, None, [plain_section(path, text, False)])) <= most:
            pieces.append((path, text, False))
            continue
        room = int((most - tokens(plain_document(head, None, [plain_section(path, "", True)]))) * 3.6 * 0.97)
        while True:
            bits = [line[i : i + room] for line in text.splitlines(keepends=True) for i in range(0, len(line), room)]
            cut = []
            for bit in bits:
                if cut and len(cut[-1]) + len(bit) <= room:
                    cut[-1] += bit
                else:
                    cut.append(bit)
            if all(tokens(plain_document(head, None, [plain_section(path, c, True)])) <= most for c in cut):
                break
            room = int(room * 0.8)
        pieces += [(path, c, i > 0) for i, c in enumerate(cut)]
    done, now, first = [], [], True
    for p in pieces:
        if now or first:
            if tokens(plain_document(head, tree if first else None, [plain_section(*x) for x in [*now, p]])) > most and (now or first):
                done.append(now)
                now, first = [], False
        now.append(p)
    return [*done, now]


@pytest.mark.parametrize("seed,most", [(1, LIMIT), (2, 700), (3, 5_000)])
def test_markdown_documents(spark, seed, most):
    rows = files(seed)
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    listed = bundle.entries(df, most=50_000, dedupe=True)
    got = {r["part"]: r["document"] for r in bundle.documents(bundle.sections(df, listed, most, root="desk")).collect()}
    kept = plain_entries(rows, 50_000, 1 << 60)
    texts = {p: t for p, t, _, _ in rows if kept[p][0] is None}
    head = got[1][: got[1].index("- part: ")] + "- part: 1/1\n"
    assert f"files: {len(texts)} included, {len(rows) - len(texts)} skipped" in head
    notes = {p: f"  [same as {s}]" if s else f"  [skipped: {w}] ({n} B)" if w else "" for (p, _, n, _), (w, s) in ((r, kept[r[0]]) for r in rows)}
    tree = plain_tree(notes, "desk")
    tree = [re.sub(r"\((\d{4,}) B\)", lambda m: f"({int(m[1]) / 1024:.1f} KB)", x) for x in tree]
    parts = plain_parts(head, tree, texts, most)
    assert len(got) == len(parts)
    for i, part in enumerate(parts):
        own = head.replace("part: 1/1", f"part: {i + 1}/{len(parts)}")
        assert got[i + 1] == plain_document(own, None if i else tree, [plain_section(*p) for p in part])


@pytest.mark.parametrize("fmt", ["xml", "json"])
def test_other_formats(spark, fmt):
    from xml.etree import ElementTree

    rows = [r for r in files(4) if r[3] == "text"]
    df = spark.createDataFrame(rows, KINDS)
    for most in (None, 600):
        found = {}
        for r in bundle.documents(bundle.sections(df, bundle.entries(df), most, fmt=fmt)).orderBy("part").collect():
            assert most is None or r["part"] == 1 or tokens(r["document"]) <= most + 2  # the part's own number is longer than 1/1
            if fmt == "json":
                read = json.loads(r["document"])
                pieces, tree = [(f["path"], f["content"]) for f in read["files"]], read["tree"]
            else:
                read = ElementTree.fromstring(r["document"])
                pieces, tree = [(f.get("path"), f.text or "") for f in read.iter("file")], read.findtext("tree", "")
            assert bool(tree) == (r["part"] == 1)
            for path, text in pieces:
                found[path] = found.get(path, "") + text
        same = (lambda t: t.replace("\r\n", "\n")) if fmt == "xml" else (lambda t: t)
        assert found == {p: same(t) for p, t, _, _ in rows}


def test_no_files_and_no_room(spark):
    empty = spark.createDataFrame([], KINDS)
    got = bundle.documents(bundle.sections(empty, bundle.entries(empty), 100)).collect()
    assert len(got) == 1 and got[0]["document"].endswith("```\n./\n```\n")
    df = spark.createDataFrame([("a", "x" * 1000, 1000, "text")], KINDS)
    with pytest.raises(ValueError):
        bundle.sections(df, bundle.entries(df), 40)
