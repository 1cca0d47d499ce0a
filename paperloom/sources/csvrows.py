"""Rows of CSV files by number, and differences of two files by position.

A file is read in splits, line by line. Quotes decide which line ends end a record: sums of
quotes are taken over splits first and within each after that, so a record may span lines
and splits. Record numbers come the same way: counts of splits, then places within. Only a
row a split reaches the driver.

Defined cases: an empty file has no header and no rows; short rows have empty cells; empty
lines outside quotes are no records; a file whose quotes don't close ends in one long record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.operators.diff import leaf_diff
from paperloom.session import keep


def _prefix_sums(rows, key, value) -> dict:
    """{key: sum of value before it} in order of key."""
    out, run = {}, 0
    for r in sorted(rows, key=key):
        out[key(r)] = run
        run += value(r)
    return out


def _lookup(spark: SparkSession, sums: dict, to: str) -> DataFrame:
    """A row a split: small by construction, as the driver lists splits itself when it plans the scan."""
    return F.broadcast(spark.createDataFrame([(f, b, n) for (f, b), n in sums.items()], f"file string, block bigint, {to} bigint"))


def records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(row, record, file): the records of a file, or of a folder's files in order of their names, numbered from 1 in each file."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = keep(text.withColumn("at", F.monotonically_increasing_id()))
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    split = lambda r: (r["file"], r["block"])
    counts = lines.groupBy("file", "block").agg(F.sum(quotes).alias("q"), F.count("*").alias("n")).collect()
    within = Window.partitionBy("file", "block").orderBy("at")
    before = F.coalesce(F.sum(quotes).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_q")
    files = {f: i for i, f in enumerate(sorted({r["file"] for r in counts}))}
    sums = {}
    for f in files:
        sums |= _prefix_sums([r for r in counts if r["file"] == f], split, lambda r: r["q"])
    if not sums:
        return lines.select(F.lit(0).cast("bigint").alias("row"), F.col("value").alias("record"), "file").limit(0)
    opened = lines.join(_lookup(spark, sums, "_q"), ["file", "block"]).withColumn("_open", before % 2 == 0)
    opened = keep(opened.where(~(F.col("_open") & (F.col("value") == ""))).select("file", "block", "at", "value", "_open"))
    starts = opened.groupBy("file", "block").agg(F.count_if("_open").alias("n")).collect()
    sums = {}
    for f in files:
        sums |= _prefix_sums([r for r in starts if r["file"] == f], split, lambda r: r["n"])
    numbered = opened.join(_lookup(spark, sums, "_n"), ["file", "block"]).withColumn("row", F.col("_n") + F.sum(F.col("_open").cast("bigint")).over(within))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "\n")
    return numbered.groupBy("file", "row").agg(whole.alias("record")).select("row", "record", "file")


def cells(record: Column, delimiter: str = ",", quote: str = '"') -> Column:
    """The cells of a record: quotes taken off, doubled ones made single."""
    d, q = _class(delimiter), _class(quote)
    parts = F.regexp_extract_all(F.concat(F.lit(delimiter), record), F.lit(f"(?s){d}({q}(?:[^{quote}]|{q}{q})*{q}|[^{delimiter}]*)"), F.lit(1))
    bare = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit(quote * 2), F.lit(quote))
    return F.transform(parts, lambda c: F.when(c.startswith(quote) & c.endswith(quote) & (F.length(c) > 1), bare(c)).otherwise(c))


def _class(c: str) -> str:
    return "\\" + c if not c.isalnum() else c


def sniff(header: str) -> str:
    """The delimiter that a header has most of; a comma if none."""
    return max(",;\t|", key=lambda d: (header.count(d), d == ","))


def read_rows(spark: SparkSession, path: str, delimiter: str | None = None) -> tuple[list[str], DataFrame]:
    """(header, rows (row from 1, cells)); each file of a folder begins with the header, rows go on from file to file."""
    found = keep(records(spark, path))
    first = found.where("row = 1").orderBy("file").select("record").first()
    if first is None:
        return [], found.select("row", F.array().cast("array<string>").alias("cells"))
    delimiter = delimiter or sniff(first["record"])
    header = spark.range(1).select(cells(F.lit(first["record"]), delimiter).alias("c")).first()["c"]
    sums = _prefix_sums(found.groupBy("file").agg(F.count("*").alias("n")).collect(), lambda r: r["file"], lambda r: r["n"] - 1)
    base = F.broadcast(spark.createDataFrame(list(sums.items()), "file string, _n bigint"))
    return header, found.where("row > 1").join(base, "file").select((F.col("row") - 1 + F.col("_n")).alias("row"), cells(F.col("record"), delimiter).alias("cells"))


def file_diff(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(change, column, row, to_row, old, new) of two CSV files by position.

    Changed cells of columns that both have; columns added and removed; rows that only one
    has, as one range each, as they are the longer one's last.
    """
    (ha, a), (hb, b) = read_rows(spark, old), read_rows(spark, new)
    shared = [c for c in ha if c in hb]
    rows = [{"change": "column added", "column": c} for c in hb if c not in ha] + [{"change": "column removed", "column": c} for c in ha if c not in hb]
    na, nb = a.count(), b.count()
    if na != nb:
        rows.append({"change": "rows added" if nb > na else "rows removed", "row": min(na, nb) + 1, "to_row": max(na, nb)})
    schema = "change string, column string, row bigint, to_row bigint, old string, new string"
    whole = spark.createDataFrame([tuple(r.get(c) for c in ("change", "column", "row", "to_row")) + (None, None) for r in rows], schema)
    if not shared:
        return whole

    def leaves(df: DataFrame, header: list[str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.get("cells", F.lit(header.index(c))), F.lit("")).alias("value")) for c in dict.fromkeys(shared)])
        return df.where(F.col("row") <= min(na, nb)).select("row", F.explode(pairs).alias("p")).select("row", "p.*")

    changed = leaf_diff(leaves(a, ha), leaves(b, hb), ["row", "column"])
    return whole.unionByName(changed.select("change", "column", "row", F.col("row").alias("to_row"), "old", "new"))
