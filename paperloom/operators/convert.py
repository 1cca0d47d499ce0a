"""Conversions among CSV, JSON, XML, HTML and Markdown."""

from __future__ import annotations

import csv
import io
import json
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import html_escape
from paperloom.operators.diff import _leaves
from paperloom.functions.udf import arrow_udf

INT, FLOAT = r"^[+-]?\d+$", r"^[+-]?(\d+\.\d*|\.?\d+)([eE][+-]?\d+)?$"


def cell_kind(value: Column) -> Column:
    """bool, int, float or str, as a CSV cell's text shows."""
    return F.when(value.isin("true", "false"), "bool").when(value.rlike(INT), "int").when(value.rlike(FLOAT), "float").otherwise("str")


def cell_json(value: Column) -> Column:
    """The cell as a JSON literal."""
    return F.when(cell_kind(value) == "str", F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2)).otherwise(value)


def _infer(cell: str):
    if cell in ("true", "false"):
        return cell == "true"
    if re.match(INT, cell):
        return int(cell)
    return float(cell) if re.match(FLOAT, cell) else cell


def _rows(text: str) -> list[list[str]]:
    try:
        dialect = csv.Sniffer().sniff(text[:65536], ",;\t|")
    except csv.Error:
        dialect = csv.excel
    return [r for r in csv.reader(io.StringIO(text), dialect) if r]


def _csv_json(text: str) -> str:
    rows = _rows(text)
    head = rows[0] if rows else []
    return json.dumps([{h: _infer(c) for h, c in zip(head, r)} for r in rows[1:]], ensure_ascii=False)


def _json_csv(text: str) -> str:
    data = json.loads(text)
    flat = [dict(_leaves(x, "", "convert")) for x in (data if isinstance(data, list) else [data])]
    names = list(dict.fromkeys(k for r in flat for k in r))
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(names)
    w.writerows([[r.get(n, "") for n in names] for r in flat])
    return out.getvalue()


def _csv_table(text: str, kind: str) -> str:
    rows = _rows(text)
    width = len(rows[0]) if rows else 0
    rows = [(r + [""] * width)[:width] for r in rows]
    if kind == "md":
        cell = lambda c: c.replace("|", "\\|").replace("\n", " ")
        lines = ["| " + " | ".join(map(cell, r)) + " |" for r in rows]
        return "\n".join([*lines[:1], "|" + " --- |" * width, *lines[1:]]) + "\n"
    from html import escape

    part = lambda r, t: "<tr>" + "".join(f"<{t}>{escape(c)}</{t}>" for c in r) + "</tr>"
    return "<table>" + "".join(part(r, "td" if i else "th") for i, r in enumerate(rows)) + "</table>"


def _xml_value(e: ET.Element):
    out: dict = {f"@{k}": v for k, v in e.attrib.items()}
    for child in e:
        value = _xml_value(child)
        if child.tag in out:
            out[child.tag] = [*(out[child.tag] if isinstance(out[child.tag], list) else [out[child.tag]]), value]
        else:
            out[child.tag] = value
    text = (e.text or "").strip()
    if not out:
        return text
    if text:
        out["#text"] = text
    return out


def _xml_json(text: str) -> str:
    root = ET.fromstring(text)
    return json.dumps({root.tag: _xml_value(root)}, ensure_ascii=False)


def _json_xml(text: str) -> str:
    def build(parent, name, value):
        good = re.match(r"^[A-Za-z_][\w.-]*$", name)
        e = ET.SubElement(parent, name if good else "item", {} if good else {"key": name})
        fill(e, value)

    def fill(e, value):
        if isinstance(value, dict):
            for k, v in value.items():
                build(e, str(k), v)
        elif isinstance(value, list):
            for v in value:
                fill(ET.SubElement(e, "item"), v)
        elif value is not None:
            e.text = str(value).lower() if isinstance(value, bool) else str(value)

    root = ET.Element("root")
    fill(root, json.loads(text))
    return ET.tostring(root, encoding="unicode")


def _edit_json(text: str, path: str, value: str | None) -> str:
    """Set (value given) or delete (None) at a dotted path; lists take indexes, also negative or one past the end."""
    data = json.loads(text)
    *way, last = path.split(".")
    here = data
    for step in way:
        here = here[int(step)] if isinstance(here, list) else here.setdefault(step, {})
    if value is None:
        del here[int(last) if isinstance(here, list) else last]
        return json.dumps(data, ensure_ascii=False)
    try:
        new = json.loads(value)
    except ValueError:
        new = value
    if isinstance(here, list):
        at = int(last)
        if at == len(here):
            here.append(new)
        else:
            here[at] = new
    else:
        here[last] = new
    return json.dumps(data, ensure_ascii=False)


def _guarded(f):
    def run(*values):
        try:
            return f(*values) if values[0] is not None else None
        except (ValueError, KeyError, IndexError, TypeError, ET.ParseError):
            return None

    return run


def _udf(f):
    @arrow_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(_guarded(f))

    return convert


#: (from, to) -> a function of a text column; bad input gives null.
ROUTES = {
    ("csv", "json"): _udf(_csv_json),
    ("json", "csv"): _udf(_json_csv),
    ("csv", "md"): _udf(lambda t: _csv_table(t, "md")),
    ("csv", "html"): _udf(lambda t: _csv_table(t, "html")),
    ("json", "html"): _udf(lambda t: _csv_table(_json_csv(t), "html")),
    ("xml", "json"): _udf(_xml_json),
    ("json", "xml"): _udf(_json_xml),
    ("txt", "html"): lambda c: F.concat(F.lit("<pre>"), html_escape(c), F.lit("</pre>")),
    ("txt", "md"): lambda c: c,
}


@arrow_udf("boolean")
def xml_parses(texts: pd.Series) -> pd.Series:
    """Whether a text is well-formed XML."""

    def fine(t: str | None) -> bool:
        try:
            return t is not None and ET.fromstring(t) is not None
        except ET.ParseError:
            return False

    return texts.map(fine)


def convert(text: Column, source: str, target: str) -> Column:
    if (source, target) == ("html", "txt"):
        from paperloom.sources.html import html_text

        return html_text(text)
    if (source, target) not in ROUTES:
        raise ValueError(f"no route from {source} to {target}")
    return ROUTES[source, target](text)


@arrow_udf("string")
def edit_json(texts: pd.Series, paths: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([_guarded(_edit_json)(t, p, v) for t, p, v in zip(texts, paths, values)])


def edit_text(text: Column, pattern: str, replacement: str, regex: bool = False) -> Column:
    """struct<text,count>: the text with every occurrence replaced, and how many there were.

    A regular expression's replacement names groups as Java does ($1).
    """
    if regex:
        return F.struct(F.regexp_replace(text, pattern, replacement).alias("text"), F.regexp_count(text, F.lit(pattern)).cast("bigint").alias("count"))
    left = F.replace(text, F.lit(pattern), F.lit(""))
    n = ((F.char_length(text) - F.char_length(left)) / len(pattern)).cast("bigint") if pattern else F.lit(0).cast("bigint")
    return F.struct(F.replace(text, F.lit(pattern), F.lit(replacement)).alias("text"), n.alias("count"))
