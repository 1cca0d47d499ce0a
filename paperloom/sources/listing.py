"""Walks over a listing of files, with rule files that folders inherit.

A folder's rule file tells what below it is left out: in a line, a shell pattern; with a
slash inside it meets the path from that folder on, else a name; with a slash at its end
folders only; with ! before it what it meets is let in again. Of all rules of the folders
above, outer before inner and each in its order, the last that meets a file or folder
decides; what lies in a folder that is left out is never reached.

On a listing this is two joins: every file and folder with the rule files of its ancestors,
and every file with the folders above that are left out. Rule files are read once each.

Defined cases: null paths are dropped; rule files without rules, or of folders that hold
nothing, change nothing; a null text has no rules; repeated paths stay repeated.
"""

from __future__ import annotations

from fnmatch import fnmatchcase

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import glob_pattern
from paperloom.functions.udf import arrow_udf

#: Fixed value: folders that no walk enters.
NEVER = (".git",)
_RULES = "array<struct<pattern:string,folder:boolean,again:boolean>>"


@arrow_udf(_RULES)
def rules_of(texts: pd.Series) -> pd.Series:
    """A rule file's rules in order."""

    def read(text: str | None) -> list[dict]:
        out = []
        for line in map(str.strip, (text or "").splitlines()):
            if not line or line[0] == "#":
                continue
            again, escaped = line[0] == "!", line[:2] == "\\!"
            pattern = line[1:].strip() if again else line[escaped:]
            if stripped := pattern.rstrip("/"):
                out.append({"pattern": stripped, "folder": pattern.endswith("/"), "again": again})
        return out

    return texts.map(read)


@arrow_udf("int")
def verdict(below: pd.Series, is_folder: pd.Series, rules: pd.Series) -> pd.Series:
    """What the last rule that meets a path (from the rule file's folder on) says: 1 out, 0 in; null if none meets it."""

    def meets(rule, path: str, folder: bool) -> bool:
        if rule["folder"] and not folder:
            return False
        return fnmatchcase(path, rule["pattern"].lstrip("/")) if "/" in rule["pattern"] else fnmatchcase(path.rsplit("/", 1)[-1], rule["pattern"])

    def one(path, folder, found):
        return next((int(not r["again"]) for r in reversed(list(found)) if meets(r, path, folder)), None)

    return pd.Series([one(*row) for row in zip(below, is_folder, rules)], dtype="Int32")


def _upto(parts: Column, k: Column) -> Column:
    return F.array_join(F.slice(parts, 1, k), "/")


def nodes(files: DataFrame, top: str = "") -> DataFrame:
    """(node, depth, is_folder) of all files and of the folders between them and top."""
    from_ = len([p for p in top.split("/") if p]) + 1
    parts = F.split("path", "/")
    each = files.select("path").where("path IS NOT NULL").distinct().select(F.posexplode(F.transform(F.sequence(F.lit(from_), F.greatest(F.size(parts), F.lit(from_))), lambda k: F.struct(_upto(parts, k).alias("node"), k.alias("depth"), (k < F.size(parts)).alias("is_folder")))).alias("_i", "n"))
    return each.select("n.*").distinct()


def left_out(files: DataFrame, rule_files: DataFrame, top: str = "", bound: str | None = None) -> DataFrame:
    """(node) of the files and folders that rules leave out by themselves.

    rule_files (folder, text): the root's folder is the empty text. Those above top count
    from bound on, which must be top or above it; without a bound none above top count.
    """
    start = top if bound is None or not (top == bound or bound == "" or top.startswith(bound + "/")) else bound
    first = len([p for p in start.split("/") if p])
    ruled = rule_files.select(F.col("folder"), rules_of("text").alias("rules")).where(F.size("rules") > 0)
    parts = F.split("node", "/")
    above = nodes(files, top).select("node", "depth", "is_folder", F.explode(F.sequence(F.lit(first), F.col("depth") - 1)).alias("level"))
    above = above.withColumn("folder", _upto(parts, F.col("level"))).withColumn("below", F.array_join(F.slice(parts, F.col("level") + 1, F.size(parts)), "/"))
    said = above.join(ruled, "folder").withColumn("out", verdict("below", "is_folder", "rules")).where("out IS NOT NULL")
    return said.groupBy("node").agg(F.max_by("out", "level").alias("out")).where("out = 1").select("node")


def walk(files: DataFrame, rule_files: DataFrame | None = None, top: str = "", bound: str | None = None, include: list[str] = (), exclude: list[str] = (), hidden: bool = True) -> DataFrame:
    """The files (path, ...) that a walk from top reaches.

    exclude's patterns leave out files and folders by name or whole path, include's keep
    files alone; without hidden, names that begin with a dot are left out as well.
    """
    path, name = F.col("path"), F.element_at(F.split("path", "/"), -1)
    out = files.where(path.isNotNull() & (F.lit(top == "") | path.startswith(top.rstrip("/") + "/")))
    inner = F.substring(path, F.lit(len(top.rstrip("/")) + 2 if top else 1), F.length(path))
    out = out.where(~F.exists(F.split(inner, "/"), lambda p: p.isin(*NEVER)))
    if not hidden:
        out = out.where(~inner.rlike(r"(^|/)\."))
    parts = F.split(inner, "/")
    for g in exclude:
        rx = glob_pattern(g)
        out = out.where(~F.exists(parts, _meets(rx)) & ~F.exists(F.transform(F.sequence(F.lit(1), F.size(parts)), _prefix(parts)), _meets(rx)))
    if include:
        meets = F.lit(False)
        for g in include:
            meets = meets | inner.rlike(glob_pattern(g)) | name.rlike(glob_pattern(g))
        out = out.where(meets)
    if rule_files is None:
        return out
    gone = left_out(out, rule_files, top, bound)
    steps = F.split("path", "/")
    hit = out.select("path").distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), _prefix(steps))).alias("node")).join(gone, "node", "left_semi").select("path").distinct()
    return out.join(hit, "path", "left_anti").select(*files.columns)


def _meets(rx: str):
    return lambda p: p.rlike(rx)


def _prefix(parts: Column):
    return lambda k: _upto(parts, k)
