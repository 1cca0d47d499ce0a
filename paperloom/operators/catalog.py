"""The catalog as tables: tags, notes, typed metadata, merges and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.meta import canonical, condition, infer_kind, normal_key, parse_condition

SCHEMA_VERSION = 2


def tags_add(tags: DataFrame, new: DataFrame) -> DataFrame:
    """Tags are stripped, in lower case, and stand once for each path."""
    clean = new.select("path", F.lower(F.trim("tag")).alias("tag")).where("tag <> ''")
    return tags.unionByName(clean).dropDuplicates(["path", "tag"])


def tags_remove(tags: DataFrame, gone: DataFrame) -> DataFrame:
    return tags.join(gone.select("path", F.lower(F.trim("tag")).alias("tag")), ["path", "tag"], "left_anti")


def tags_find(tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Paths that have every wanted tag."""
    names = sorted({t.strip().lower() for t in wanted})
    return tags.where(F.col("tag").isin(*names)).groupBy("path").agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(names)).select("path")


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("files"))


def notes_of(notes: DataFrame, path: str | None = None) -> DataFrame:
    """Newest first."""
    own = notes if path is None else notes.where(F.col("path") == path)
    return own.orderBy(F.desc("created"), F.desc("note_id"))


def meta_rows(facts: DataFrame) -> DataFrame:
    """(path, key, value, kind) with inferred kinds and canonical values from (path, key, value) texts."""
    typed = facts.select("path", normal_key(F.col("key")).alias("key"), "value", infer_kind(F.col("value")).alias("kind"))
    return typed.withColumn("value", canonical(F.col("value"), F.col("kind")))


def upsert_latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the last in order."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).agg(last.alias("_last")).select("_last.*")


def meta_find(meta: DataFrame, conditions: list[str]) -> DataFrame:
    """Paths that meet all conditions, by one aggregation; a condition needs a row with its key."""
    parsed = [parse_condition(c) for c in conditions]
    wanted = meta.where(F.col("key").isin(*sorted({k for k, _, _ in parsed})))
    marks = [F.max((F.col("key") == k) & F.coalesce(condition(op, v), F.lit(False))).alias(f"c{i}") for i, (k, op, v) in enumerate(parsed)]
    met = wanted.groupBy("path").agg(*marks)
    for i in range(len(parsed)):
        met = met.where(f"c{i}")
    return met.select("path")


def meta_keys(meta: DataFrame) -> DataFrame:
    return meta.groupBy("key").agg(F.count("*").alias("files"))


def meta_export(meta: DataFrame, keys: list[str]) -> DataFrame:
    """One row per path, one column per key, '' where it is missing."""
    return meta.groupBy("path").pivot("key", keys).agg(F.first("value")).na.fill("", keys)


def merge_meta(base: DataFrame, new: DataFrame) -> DataFrame:
    """(path, key, value, change): the union of both, new values winning; change is added, changed or kept."""
    joined = base.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), ["path", "key"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNotNull() & (F.col("new") != F.col("old")), "changed").otherwise("kept")
    return joined.select("path", "key", F.coalesce("new", "old").alias("value"), change.alias("change"))


def status(listing: DataFrame, files: DataFrame) -> DataFrame:
    """(path, state) of changed, missing and unindexed files; fresh means equal size and mtime within a microsecond."""
    a, b = listing.select("path", F.col("size").alias("s1"), F.col("mtime").alias("m1")), files.select("path", F.col("size").alias("s2"), F.col("mtime").alias("m2"))
    joined = a.join(b, "path", "full_outer")
    fresh = (F.col("s1") == F.col("s2")) & (F.abs(F.col("m1") - F.col("m2")) < 1e-6)
    state = F.when(F.col("s1").isNull(), "missing").when(F.col("s2").isNull(), "unindexed").when(~fresh, "changed")
    return joined.select("path", state.alias("state")).where("state IS NOT NULL")


def stale(listing: DataFrame, files: DataFrame) -> DataFrame:
    """The listing's rows that an incremental index run must read."""
    return listing.join(status(listing, files).where("state <> 'missing'").select("path"), "path", "left_semi")


def prune(table: DataFrame, listing: DataFrame) -> DataFrame:
    return table.join(listing.select("path"), "path", "left_semi")


def rename(table: DataFrame, moves: DataFrame) -> DataFrame:
    """Paths follow a plan of (path, to)."""
    return table.join(moves.select("path", "to"), "path", "left").withColumn("path", F.coalesce("to", "path")).drop("to")


def export(files: DataFrame, tags: DataFrame, notes: DataFrame, meta: DataFrame) -> DataFrame:
    """(path, document): one JSON document for each file that has tags, notes or metadata."""
    t = tags.groupBy("path").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    n = notes.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("created", "body"))).alias("notes"))
    m = meta.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("key", "value", "kind"))).alias("meta"))
    joined = files.select("path").join(t, "path", "left").join(n, "path", "left").join(m, "path", "left").where("tags IS NOT NULL OR notes IS NOT NULL OR meta IS NOT NULL")
    return joined.select("path", F.to_json(F.struct("path", "tags", "notes", "meta")).alias("document"))


def resume(manifest: DataFrame) -> DataFrame:
    """Paths whose last manifest record, by time, was ok: a resumed batch skips them."""
    return upsert_latest(manifest, ["path"], ["time", "seq"]).where("ok").select("path")


#: The shape of an exported catalog.
FILES = "array<struct<path:string,tags:array<string>,notes:array<struct<created:double,body:string>>,meta:array<struct<key:string,value:string,kind:string,source:string>>>>"


def envelope(documents: DataFrame) -> DataFrame:
    """(catalog): one JSON document {schema, files} of export()'s documents, in order of path; for catalogs that fit one row."""
    parts = documents.agg(F.array_sort(F.collect_list(F.struct("path", "document"))).alias("d"))
    return parts.select(F.concat(F.lit('{"schema":%d,"files":[' % SCHEMA_VERSION), F.array_join(F.transform("d", lambda x: x["document"]), ","), F.lit("]}")).alias("catalog"))


def imported(catalogs: DataFrame, column: str = "catalog") -> DataFrame:
    """(path, tags, notes, meta, problem) of the files of catalogs {schema, files}; problem says why a file or catalog can't be taken.

    Tags are cleaned, keys must be keys, kinds known; a catalog of a later schema, or one that is no JSON, gives one row without a path.
    """
    read = catalogs.select(F.from_json(column, f"schema int, files {FILES}").alias("c"))
    bad = F.when(F.col("c").isNull() | F.col("c.schema").isNull(), "not a catalog").when(F.col("c.schema") > SCHEMA_VERSION, "later schema").when(F.col("c.files").isNull(), "no files")
    rows = read.select(bad.alias("problem"), F.explode_outer(F.when(bad.isNull(), F.col("c.files"))).alias("f")).where("problem IS NOT NULL OR f IS NOT NULL")
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("f.tags", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t != "")))
    wrong_key = F.exists("f.meta", lambda m: normal_key(m["key"]).isNull())
    wrong_kind = F.exists("f.meta", lambda m: ~F.coalesce(m["kind"], F.lit("str")).isin("bool", "num", "date", "str"))
    why = F.coalesce("problem", F.when(F.coalesce(F.trim("f.path"), F.lit("")) == "", "no path").when(F.coalesce(wrong_key, F.lit(False)), "bad key").when(F.coalesce(wrong_kind, F.lit(False)), "bad kind"))
    return rows.select(F.col("f.path").alias("path"), clean.alias("tags"), F.col("f.notes").alias("notes"), F.col("f.meta").alias("meta"), why.alias("problem"))


def merge_notes(base: DataFrame, new: DataFrame) -> DataFrame:
    """(path, created, body, added): the union of both; a note of the same time and body counts once."""
    both = base.select("path", "created", "body", F.lit(False).alias("added")).unionByName(new.select("path", "created", "body", F.lit(True).alias("added")))
    return both.groupBy("path", "created", "body").agg(F.min("added").alias("added"))


def manifest_lines(files: DataFrame) -> DataFrame:
    """(line): `sha256  path` for each file (path, content); a null content is an empty file."""
    return files.select(F.concat(F.sha2(F.coalesce(F.col("content").cast("binary"), F.lit(b"")), 256), F.lit("  "), F.col("path")).alias("line"))


def verify_manifest(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(path, state) of a manifest's lines (`<sha256>  <path>`) against files (path, content): ok, changed, missing or malformed."""
    sha, path = F.regexp_extract("line", r"^([0-9a-fA-F]{64}) [ *](.+)$", 1), F.regexp_extract("line", r"^[0-9a-fA-F]{64} [ *](.+)$", 1)
    listed = lines.select(F.lower(sha).alias("sha"), F.when(sha == "", F.col("line")).otherwise(path).alias("path"), (sha == "").alias("bad"))
    have = files.select(F.col("path").alias("_path"), F.sha2(F.col("content").cast("binary"), 256).alias("_sha"))
    joined = listed.join(have, F.col("path") == F.col("_path"), "left")
    return joined.select("path", F.when(F.col("bad"), "malformed").when(F.col("_sha").isNull(), "missing").when(F.col("sha") == F.col("_sha"), "ok").otherwise("changed").alias("state"))
