"""What a file is like: common facts, and details by type; outlines of markdown and Python sources."""

from __future__ import annotations

import ast
import csv
import io
import json
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import base_name, human_size, line_count, suffix, word_count
from paperloom.functions.udf import arrow_udf

#: What opens and closes a block of code in markdown.
FENCE = r"^\s*(?:```|~~~)"


def common(files: DataFrame) -> DataFrame:
    """(path, name, suffix, size, human, mtime, sha256) of files (path, size, mtime, content)."""
    return files.select(
        "path", base_name(F.col("path")).alias("name"), suffix(F.col("path")).alias("suffix"), "size", human_size(F.col("size")).alias("human"), "mtime", F.sha2(F.col("content").cast("binary"), 256).alias("sha256")
    )


def headings(text: Column) -> Column:
    """array<struct<line,level,text>>: markdown headings outside of code blocks, lines from 1."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r")
    shape = "array<struct<line:int,level:int,text:string>>"
    zero = F.struct(F.lit(0).alias("n"), F.lit(False).alias("code"), F.array().cast(shape).alias("out"))

    def step(acc, line):
        turns, mark = line.rlike(FENCE), F.regexp_extract(line, r"^\s*(#{1,6})(?!#)\s*\S", 1)
        title = F.trim(F.regexp_replace(F.regexp_replace(line, r"^\s*#+", ""), r"\s+$", ""))
        new = F.array(F.struct((acc["n"] + 1).alias("line"), F.length(mark).alias("level"), title.alias("text")))
        found = ~acc["code"] & ~turns & (mark != "")
        return F.struct((acc["n"] + 1).alias("n"), (acc["code"] != turns).alias("code"), F.when(found, F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(lines, zero, step)["out"]


def markdown(text: Column) -> Column:
    """struct<headings,words>."""
    return F.struct(headings(text).alias("headings"), word_count(text).alias("words"))


def plain(text: Column) -> Column:
    """struct<lines,words,chars>."""
    return F.struct(line_count(text).alias("lines"), word_count(text).alias("words"), F.char_length(F.coalesce(text, F.lit(""))).cast("bigint").alias("chars"))


def outline_md(text: Column) -> Column:
    """One entry `L<line> <marks> <title>` for each heading."""
    return F.transform(headings(text), lambda h: F.concat(F.lit("L"), h["line"].cast("string"), F.lit(" "), F.repeat(F.lit("#"), h["level"]), F.lit(" "), h["text"]))


@arrow_udf("array<string>")
def outline_py(texts: pd.Series) -> pd.Series:
    """One entry `L<line> def|async def|class <name>` for each definition at the top level."""
    words = {ast.ClassDef: "class", ast.FunctionDef: "def", ast.AsyncFunctionDef: "async def"}

    def read(source):
        try:
            return [f"L{n.lineno} {words[type(n)]} {n.name}" for n in ast.parse(source or "").body if type(n) in words]
        except (SyntaxError, ValueError):
            return ["[unparsable]"]

    return texts.map(read)


def _depth_of(root, inner) -> int:
    """How many levels of containers a value has, without recursion."""
    deepest, todo = 0, [(root, 0)]
    while todo:
        value, depth = todo.pop()
        below = inner(value)
        if below is not None:
            deepest = max(deepest, depth + 1)
            todo.extend((v, depth + 1) for v in below)
    return deepest


@arrow_udf("struct<shape:string,keys:bigint,depth:bigint,error:boolean>")
def json_detail(texts: pd.Series) -> pd.DataFrame:
    """Whether a JSON text is an object, an array or a scalar, its number of keys, and its depth."""

    def read(t):
        try:
            value = json.loads(t or "")
        except ValueError:
            return (None, None, None, True)
        shape = {dict: "object", list: "array"}.get(type(value), "scalar")
        inner = lambda v: v.values() if isinstance(v, dict) else v if isinstance(v, list) else None
        return (shape, 0 if shape == "scalar" else len(value), _depth_of(value, inner), False)

    return pd.DataFrame([read(t) for t in texts], columns=["shape", "keys", "depth", "error"])


@arrow_udf("struct<delimiter:string,columns:array<string>,column_count:bigint,rows:bigint>")
def csv_detail(texts: pd.Series) -> pd.DataFrame:
    """Delimiter, header, and the rows below it."""

    def read(t):
        try:
            mark = csv.Sniffer().sniff((t or "")[: 64 * 1024]).delimiter
        except csv.Error:
            mark = ","
        rows = csv.reader(io.StringIO(t or ""), delimiter=mark)
        head = next(rows, [])
        return (mark, head, len(head), sum(1 for _ in rows))

    return pd.DataFrame([read(t) for t in texts], columns=["delimiter", "columns", "column_count", "rows"])


@arrow_udf("struct<root:string,elements:bigint,depth:bigint,error:boolean>")
def xml_detail(texts: pd.Series) -> pd.DataFrame:
    """Root tag, number of elements, and depth."""

    def read(t):
        try:
            root = ET.fromstring(t or "")
        except ET.ParseError:
            return (None, None, None, True)
        return (root.tag, sum(1 for _ in root.iter()), _depth_of(root, list), False)

    return pd.DataFrame([read(t) for t in texts], columns=["root", "elements", "depth", "error"])
