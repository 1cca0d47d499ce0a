"""Structural and positional differences."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.udf import arrow_udf


def leaf_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change, old, new) of two leaf tables (keys, value): added, removed and changed leaves."""
    joined = old.select(*keys, F.col("value").alias("old"), F.lit(True).alias("_o")).join(new.select(*keys, F.col("value").alias("new"), F.lit(True).alias("_n")), keys, "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return joined.select(*keys, change.alias("change"), "old", "new").where("change IS NOT NULL")


def row_diff(old: DataFrame, new: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """(position, column, change, old, new) of two tables compared row by row at equal positions."""

    def leaves(df: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
        return df.select(position, F.explode(pairs).alias("p")).select(position, "p.*")

    return leaf_diff(leaves(old), leaves(new), [position, "column"])


def _leaves(value, path: str, mode: str):
    inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
    if inner is None:
        if mode == "text":
            yield path, str(value)
        elif mode == "convert":
            yield path or "value", "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
        else:
            yield path or "$", json.dumps(value, ensure_ascii=False)
        return
    if not value and mode == "diff":
        yield path or "$", "{}" if isinstance(value, dict) else "[]"
    for k, v in inner:
        yield from _leaves(v, f"{path}.{k}" if path else str(k), mode)


def json_leaves(mode: str):
    """A pandas UDF from JSON text to (path, value) leaves. The modes differ: `text` spells values
    as Python does and drops empty containers, `convert` names a bare scalar `value` and spells
    them as CSV cells, `diff` keeps empty containers as leaves and calls the root `$`."""

    @arrow_udf("array<struct<path:string,value:string>>")
    def flatten(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append([{"path": p, "value": v} for p, v in _leaves(json.loads(t), "", mode)])
            except (TypeError, ValueError):
                out.append(None)
        return pd.Series(out)

    return flatten


@arrow_udf("array<struct<path:string,value:string>>")
def xml_leaves(texts: pd.Series) -> pd.Series:
    """XML text to (path, value) leaves: `a.b`, `a.b.0` among siblings of one name, `a.@name` for attributes; null if it can't be read."""

    def read(t):
        try:
            root = ET.fromstring(t or "")
        except ET.ParseError:
            return None
        out, todo = [], [(root, root.tag)]
        while todo:
            element, path = todo.pop()
            out += [{"path": f"{path}.@{k}", "value": v} for k, v in element.attrib.items()]
            if not len(element):
                out.append({"path": path, "value": (element.text or "").strip()})
                continue
            several, seen = Counter(c.tag for c in element), Counter()
            for child in element:
                place = f".{seen[child.tag]}" if several[child.tag] > 1 else ""
                seen[child.tag] += 1
                todo.append((child, f"{path}.{child.tag}{place}"))
        return sorted(out, key=lambda x: x["path"])

    return texts.map(read)


def text_diff(old: DataFrame, new: DataFrame, key: str, text: str, leaves) -> DataFrame:
    """(key, path, change, old, new): structural differences of two tables of json or xml texts, by a flattener of them."""

    def flat(df: DataFrame) -> DataFrame:
        return df.select(key, F.explode(leaves(F.col(text))).alias("l")).select(key, "l.path", "l.value")

    return leaf_diff(flat(old), flat(new), [key, "path"])
