"""Symbolic links in a listing: where paths lead, and which of them stay below a root.

A path is walked from its start: the parts up to the first link are plain, the link gives way
to its target, and what follows is walked on from there. `..` goes up from where the link
led, not from where it stood. Each round does this once for every path that still meets a
link, by one join of the paths' prefixes with the links, so rounds are as many as the longest
chain of links and paths without links leave after the first.

Defined cases: null paths are dropped, repeated ones stay repeated in `confined` and are one
row in `resolved`; a link without a target leads nowhere and counts as a loop; a link that
needs itself to be resolved is a loop, which leads nowhere; links to what the listing does not
hold lead there all the same; `.` and repeated slashes say nothing; `..` above the top stays
at the top. Of several links at one path that with the least target counts. Relative paths
lie below the top of the listing, absolute ones begin with a slash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import keep


def _steps(path: Column) -> Column:
    """The parts of a path that lead somewhere."""
    return F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))


def _walked(done: Column, steps: Column) -> Column:
    """Where steps lead from done, if none of them is a link."""
    up = lambda at: F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))
    return F.aggregate(steps, done, lambda at, p: F.when(p == "..", up(at)).otherwise(F.concat(at, F.array(p))))


def _text(rooted: Column, parts: Column) -> Column:
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))


def resolved(paths: DataFrame, links: DataFrame) -> DataFrame:
    """(path, resolved, looped) of the distinct paths (path), through links (path, target).

    resolved is null where a loop is met.
    """
    none = F.array().cast("array<string>")
    by_path = links.where("path IS NOT NULL").groupBy("path").agg(F.min("target").alias("target"))
    by_path = by_path.select(_text(F.startswith("path", F.lit("/")), _walked(none, _steps(F.col("path")))).alias("_at"), "target").groupBy("_at").agg(F.min("target").alias("target"))
    state = paths.where("path IS NOT NULL").select("path").distinct()
    state = state.select("path", F.startswith("path", F.lit("/")).alias("rooted"), none.alias("done"), _steps(F.col("path")).alias("rest"), F.array().cast("array<struct<at:string,left:int>>").alias("within"))
    over = None
    while True:
        # Every prefix of what is left, until the first link; the end of the walk is beside them.
        k = F.explode(F.when(F.size("rest") > 0, F.sequence(F.lit(1), F.size("rest"))).otherwise(F.array().cast("array<int>"))).alias("k")
        prefixes = state.select("path", "rooted", "done", "rest", k).select("path", "k", _text(F.col("rooted"), _walked(F.col("done"), F.slice("rest", F.lit(1), F.col("k")))).alias("_at"))
        met = prefixes.where("_at <> ''").join(by_path, "_at").groupBy("path").agg(F.min(F.struct("k", "_at", "target")).alias("m"))
        both = state.join(met, "path", "left")
        left = F.slice("rest", F.col("m.k") + 1, F.size("rest"))
        # Links whose target is walked to its end are behind; one of the others again is a loop.
        nest = F.filter("within", lambda w: w["left"] <= F.size(left))
        looped = F.col("m.target").isNull() | F.exists(nest, lambda w: w["at"] == F.col("m._at"))
        absolute = F.startswith(F.col("m.target"), F.lit("/"))
        before = _walked(F.col("done"), F.slice("rest", F.lit(1), F.col("m.k") - 1))
        both = keep(both.select(
            "path", F.col("m").isNotNull().alias("hit"), F.coalesce(F.col("m").isNotNull() & looped, F.lit(False)).alias("looped"),
            F.when(F.col("m").isNull(), _text(F.col("rooted"), _walked(F.col("done"), F.col("rest")))).alias("resolved"),
            (F.col("rooted") | F.coalesce(absolute, F.lit(False))).alias("rooted"), F.when(absolute, none).otherwise(before).alias("done"), F.concat(_steps(F.col("m.target")), left).alias("rest"),
            F.concat(nest, F.array(F.struct(F.col("m._at").alias("at"), F.size(left).alias("left")))).alias("within"),
        ))
        ended = both.where("NOT hit OR looped").select("path", "resolved", "looped")
        over = ended if over is None else over.unionByName(ended)
        state = both.where("hit AND NOT looped").select("path", "rooted", "done", "rest", "within")
        if state.isEmpty():
            return over


def confined(files: DataFrame, links: DataFrame, root: str) -> DataFrame:
    """The files (path, ...) that lie below root once their links are followed; loops lie nowhere.

    root is a plain path of the listing, without links of its own; the empty text is the top
    of relative paths.
    """
    base = root.rstrip("/")
    # Only a path with a link in it can lead out of the folder that it names.
    where = F.col("resolved")
    inside = (where == base) | where.startswith(base + "/") if base or root == "/" else ~where.startswith("/")
    good = resolved(files, links).where(inside).select("path")
    return files.join(good, "path", "left_semi").select(*("`" + c.replace("`", "``") + "`" for c in files.columns))
