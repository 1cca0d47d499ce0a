"""What changed between two listings of files, and files narrowed by what changed.

Each folder has one sum over its own files' paths and contents, made of 120 bits of their digests in
four parts that add up in any order: no list of children is gathered, however many there
are. Folders whose sums are equal hold the same files, so only files of the other folders
are shuffled and compared by path. A descent by levels would read the sums once a level; one
join of them reads them once.

Defined cases: files with a null path are dropped; a null hash is a hash like any other;
repeated paths count with the least hash; empty listings give added or removed files alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import glob_pattern

_PARTS = 4


def _folder(path: str = "path") -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _listing(files: DataFrame) -> DataFrame:
    return files.where("path IS NOT NULL").groupBy("path").agg(F.min("hash").alias("hash"))


def folder_sums(files: DataFrame) -> DataFrame:
    """(folder, files, sum) of the folders that hold files (path, hash) themselves."""
    digest = F.sha2(F.concat(F.col("path"), F.lit("\0"), F.coalesce(F.concat(F.lit("="), F.col("hash")), F.lit(""))), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(_PARTS)]
    sums = files.groupBy(_folder().alias("folder")).agg(F.count("*").alias("files"), *parts)
    return sums.select("folder", "files", F.array(*[f"s{i}" for i in range(_PARTS)]).alias("sum"))


def tree_sums(files: DataFrame) -> DataFrame:
    """(folder, files, sum) of all folders, each over all that lies below it; the top is the empty text."""
    own = folder_sums(_listing(files))
    steps = F.split("folder", "/")
    above = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/")))
    each = own.select(F.explode(above).alias("folder"), "files", *[F.col("sum")[i].alias(f"s{i}") for i in range(_PARTS)])
    return each.groupBy("folder").agg(F.sum("files").alias("files"), F.array(*[F.sum(f"s{i}") for i in range(_PARTS)]).alias("sum"))


def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of two listings (path, hash): added, removed or changed files."""
    old, new = _listing(old), _listing(new)
    sums = folder_sums(old).select("folder", F.struct("files", "sum").alias("o")).join(folder_sums(new).select("folder", F.struct("files", "sum").alias("n")), "folder", "full_outer")
    differ = sums.where("NOT o <=> n").select("folder")
    some = lambda f, c: f.withColumn("folder", _folder()).join(differ, "folder", "left_semi").select("path", F.struct("hash").alias(c))
    both = some(old, "o").join(some(new, "n"), "path", "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed")
    return both.where("NOT o <=> n").select("path", change.alias("change"))


def narrowed(files: DataFrame, changes: DataFrame | None = None, hits: DataFrame | None = None, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """The files (path, ...) that changed (path, change), that a search hit (path, score) and that patterns let in, with the hit's score.

    Each condition that is not given lets all files in. Patterns meet whole paths or names.
    Removed files of changes are not among the files; `removed` names them.
    """
    name = F.element_at(F.split("path", "/"), -1)
    meets = lambda g: F.col("path").rlike(glob_pattern(g)) | name.rlike(glob_pattern(g))
    out = files
    if include:
        wanted = F.lit(False)
        for g in include:
            wanted = wanted | meets(g)
        out = out.where(wanted)
    for g in exclude:
        out = out.where(~meets(g))
    if changes is not None:
        out = out.join(changes.where("change <> 'removed'").select("path"), "path", "left_semi")
    return out if hits is None else out.join(hits.groupBy("path").agg(F.min("score").alias("score")), "path")


def removed(changes: DataFrame) -> DataFrame:
    """(path) of the files that are gone."""
    return changes.where("change = 'removed'").select("path")
