"""The intake pipeline: files to typed, named, placed and tagged catalog rows, as a plan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import fiscal_quarter, fiscal_year, slug, stem, suffix
from paperloom.operators import fields, refs
from paperloom.session import keep
from paperloom.sources.files import extract_text, unique_targets, with_type


def name_column(template: str, values: dict[str, Column]) -> Column:
    """A template with {placeholder} or {placeholder:format} as a Column; a date takes a Spark date format.

    A missing value makes the whole name null.
    """
    parts, at = [], 0
    for m in re.finditer(r"\{([a-z_]+)(?::([^}]*))?\}", template):
        if m[1] not in values:
            raise ValueError(f"unknown placeholder {m[1]!r}")
        parts.append(F.lit(template[at : m.start()]))
        value = values[m[1]]
        parts.append(F.date_format(value.try_cast("date"), m[2]) if m[2] else slug(value.cast("string")))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def destination(day: Column, layout: str = "ym", fiscal_start: int = 1) -> Column:
    if layout == "flat":
        return F.lit("")
    if layout == "period":
        return F.concat(F.lit("FY"), fiscal_year(day, fiscal_start), F.lit("/Q"), fiscal_quarter(day, fiscal_start))
    return F.date_format(day, "yyyy/MM")


def plan(files: DataFrame, template: str = "{date:yyyy-MM-dd}_{vendor}_{total}", layout: str = "ym", kinds: list[str] | None = None, fiscal_start: int = 1) -> DataFrame:
    """(path, to, type, fields, tags) for raw files (path, mtime, content): what would be moved where and saved.

    Documents without all that the template needs keep their own name; the date falls back to the file's.
    """
    texts = extract_text(with_type(files)).select("path", "type", "mtime", F.col("text").alias("content"))
    found = fields.extract(texts)
    joined = texts.join(found, "path")
    value = lambda f: F.col(f"fields.{f}.value")
    day = F.coalesce(value("date").try_cast("date"), F.timestamp_seconds("mtime").cast("date"))
    known = {f: value(f) for f in fields.FIELDS} | {"date": day, "stem": stem(F.col("path")), "type": F.col("type")}
    own = F.concat(F.coalesce(name_column(template, known), slug(stem(F.col("path")))), suffix(F.col("path")))
    named = joined.select("path", "type", "fields", "content", F.concat_ws("/", F.nullif(destination(day, layout, fiscal_start), F.lit("")), own).alias("wish"))
    targets = unique_targets(keep(named.select("path", F.col("wish").alias("to"))))
    tags = refs.find(named, kinds).groupBy("path").agg(F.array_sort(F.collect_set(refs.tag(F.col("kind"), F.col("value")))).alias("tags"))
    return named.join(targets, "path").join(tags, "path", "left").select("path", "to", "type", "fields", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def watch(spark, inbox: str, schema_of, sink, checkpoint: str, **how):
    """Run the plan on files as they arrive: sink(batch of plan rows, batch id); one pass over what is there."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(inbox)

    def run(batch: DataFrame, number: int) -> None:
        files = batch.select(schema_of(F.col("path")).alias("path"), F.col("modificationTime").cast("double").alias("mtime"), "content")
        sink(plan(files, **how), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


