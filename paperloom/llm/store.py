"""Shared storage: lineage cuts and scratch folders below spark.checkpoint.dir."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import drop_path, keep, shared_dir

__all__ = ["drop_path", "keep", "literal_table", "quoted", "scratch", "shared_dir"]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def literal_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small driver-side table as a JSON literal, parsed by the JVM: no Python workers, no RDD.

    rows are tuples in schema's order. For tables whose size is bounded by parameters.
    """
    names = [c.strip().split(" ")[0] for c in _top_level(schema)]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    parsed = F.from_json(F.lit(text), f"array<struct<{','.join(c.strip().replace(' ', ':', 1) for c in _top_level(schema))}>>")
    return spark.range(1).select(F.explode(parsed).alias("r")).select("r.*")


def _top_level(schema: str) -> list[str]:
    out, depth = [""], 0
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def quoted(name: str) -> str:
    """A column's name as an expression that means it alone, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"
