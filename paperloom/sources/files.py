"""Files as rows: scans, type detection, ignore rules, text extraction, incremental listings."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import base_name, glob_pattern, suffix
from paperloom.functions.udf import arrow_udf

#: Type by extension.
EXTENSIONS = {
    ".pdf": "pdf", ".md": "md", ".markdown": "md", ".jpg": "jpg", ".jpeg": "jpg", ".png": "png", ".ico": "ico", ".txt": "txt", ".text": "txt",
    ".html": "html", ".htm": "html", ".json": "json", ".xml": "xml", ".csv": "csv", ".docx": "docx", ".odt": "odt", ".epub": "epub", ".rtf": "rtf",
    ".xlsx": "xlsx", ".xlsm": "xlsx", ".eml": "eml", ".mbox": "mbox", ".mbx": "mbox",
}
#: First bytes.
MAGIC = [(b"%PDF", "pdf"), (b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpg"), (b"\x00\x00\x01\x00", "ico"), (b"{\\rtf", "rtf")]
#: Extensions and names of source code.
CODE = ".py .js .ts .java .c .h .cpp .go .rs .rb .php .sh .sql .toml .yaml .yml .ini .cfg .css .scala .kt .swift .r .lua .pl".split()
CODE_NAMES = ("Makefile", "Dockerfile", "Rakefile", "Gemfile")
#: Where organising puts a type.
FOLDERS = {"pdf": "pdf", "jpg": "images", "png": "images", "ico": "images", "json": "data", "xml": "data", "csv": "data", "md": "docs", "txt": "docs", "html": "docs", "eml": "mail", "mbox": "mail"}


def scan(spark: SparkSession, root: str, hidden: bool = False, with_content: bool = True) -> DataFrame:
    """(path, size, mtime, content) of all files below a root, on any Hadoop file system; path is relative."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace(F.col("path"), r"^.*?" + _quoted(root.split("://")[-1].strip("/")) + "/", "")
    out = files.select(relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"), *(["content"] if with_content else []))
    return out if hidden else out.where(~F.col("path").rlike(r"(^|/)\."))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == "/" else "\\" + c for c in text)


@arrow_udf("string")
def zip_flavour(content: pd.Series) -> pd.Series:
    """docx, xlsx, epub or odt of a zip's first bytes and entries, else null."""

    def look(data):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = z.namelist()[:64]
                if "mimetype" in names:
                    kind = z.read("mimetype").strip()
                    return {b"application/epub+zip": "epub", b"application/vnd.oasis.opendocument.text": "odt"}.get(kind)
                return "docx" if any(n.startswith("word/") for n in names) else "xlsx" if any(n.startswith("xl/") for n in names) else None
        except (zipfile.BadZipFile, TypeError, KeyError):
            return None

    return content.map(look)


def detect(path: Column, content: Column) -> Column:
    """First bytes, then extension (a .eml that starts like a mailbox is one), then source code, then the look of mail."""
    head = F.substring(content, 1, 8)
    by_magic = F.lit(None).cast("string")
    for bytes_, kind in reversed(MAGIC):
        by_magic = F.when(F.substring(head, 1, len(bytes_)) == F.lit(bytes_), kind).otherwise(by_magic)
    ext = suffix(path)
    by_ext = F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), ext)
    start = F.decode(F.substring(content, 1, 2048), "ISO-8859-1")
    mailbox = start.rlike(r"^From \S+.*\d{4}\r?\n")
    mail = start.rlike(r"(?im)\A(?:[!-9;-~]+:[^\n]*\n(?:[ \t][^\n]*\n)*){2,}") & start.rlike(r"(?im)^(from|message-id|received):")
    code = ext.isin(*CODE) | base_name(path).isin(*CODE_NAMES)
    named = F.when((by_ext == "eml") & mailbox, "mbox").otherwise(by_ext)
    return F.coalesce(by_magic, named, F.when(code, "code"), F.when((ext == "") & mailbox, "mbox"), F.when((ext == "") & mail, "eml"), F.lit("unknown"))


def with_type(files: DataFrame) -> DataFrame:
    """files with type; only zip containers are opened."""
    plain = files.withColumn("type", detect(F.col("path"), F.col("content")))
    zipped = F.substring("content", 1, 4) == F.unhex(F.lit("504B0304"))
    opened = plain.where(zipped).withColumn("type", F.coalesce(zip_flavour("content"), "type"))
    return plain.where(~zipped).unionByName(opened)


def parse_ignore(text: str) -> list[tuple[str, bool, bool]]:
    """(regex, folders only, re-included) of each rule, in order."""
    rules = []
    for line in text.splitlines():
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        again = rule.startswith("!")
        rule = rule[1:] if again else rule
        folder = rule.endswith("/")
        rule = rule.rstrip("/")
        anchored = "/" in rule
        body = glob_pattern(rule.lstrip("/"))[len("(?s)^") : -1]
        rules.append((f"(?s)^(?:.*/)?{body}(/|$)" if not anchored else f"(?s)^{body}(/|$)", folder, again))
    return rules


def ignored(path: Column, rules: list[tuple[str, bool, bool]]) -> Column:
    """Whether the last rule that meets the path excludes it."""
    out = F.lit(False)
    for rx, folder, again in rules:
        meets = path.rlike(rx[: -len("(/|$)")] + "/") if folder else path.rlike(rx)
        out = F.when(meets, F.lit(not again)).otherwise(out)
    return out


def plain_text(content: Column) -> Column:
    """Bytes as UTF-8 without a byte-order mark; what can't be read becomes replacement characters."""
    return F.regexp_replace(content.cast("string"), "^\uFEFF", "")


@arrow_udf("string")
def json_lines(texts: pd.Series) -> pd.Series:
    """JSON as `dotted.path: value` lines."""
    from paperloom.operators.diff import _leaves

    def read(t):
        try:
            return "\n".join(f"{p}: {v}" for p, v in _leaves(json.loads(t), "", "text"))
        except (ValueError, TypeError):
            return t

    return texts.map(read)


@arrow_udf("string")
def csv_lines(texts: pd.Series) -> pd.Series:
    """Rows of CSV as lines of cells with `, ` between."""
    csv.field_size_limit(2**31 - 1)
    return texts.map(lambda t: None if t is None else "\n".join(", ".join(row) for row in csv.reader(io.StringIO(t, newline=""))))


def extract_text(files: DataFrame, final_newline: bool = False) -> DataFrame:
    """files (path, type, content) with text: each type by its own reader, null where none is at hand (PDF, images, office).

    final_newline ends the last lines of HTML, XML, JSON and CSV texts, as texts that are written to files end.
    """
    from paperloom.sources.html import html_text
    from paperloom.sources.mail import eml_text, mbox_text

    body, last = plain_text(F.col("content")), F.lit("\n" if final_newline else "")
    marked = F.concat(F.regexp_replace(html_text(body), r"\n\z", ""), last)
    readers = {("txt", "md", "code", "rtf"): lambda: body, ("csv",): lambda: F.concat(csv_lines(body), last), ("html", "xml"): lambda: marked, ("json",): lambda: F.concat(json_lines(body), last), ("eml",): lambda: eml_text("content"), ("mbox",): lambda: mbox_text("content")}
    parts = [files.where(F.col("type").isin(*kinds)).withColumn("text", read()) for kinds, read in readers.items()]
    known = [k for kinds in readers for k in kinds]
    out = files.where(~F.col("type").isin(*known)).withColumn("text", F.lit(None).cast("string"))
    for p in parts:
        out = out.unionByName(p)
    return out


def organise_plan(files: DataFrame, by: str = "type") -> DataFrame:
    """(path, to): a folder by type or by month, names made unique in order of path."""
    from pyspark.sql import Window

    folder = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv]), F.col("type")), F.lit("other"))
    if by == "date":
        folder = F.date_format(F.timestamp_seconds("mtime"), "yyyy/MM")
    name = base_name(F.col("path"))
    return unique_targets(files.select("path", F.concat_ws("/", folder, name).alias("to")))


def unique_targets(plan: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(path, to) with targets made unique in order of path: -1, -2, ... before the extension.

    taken (to) are targets that exist. A number that another target already bears is passed over:
    targets of one stem and extension, bare or numbered, are settled together. One target may be
    wished for by all rows: places are counted over ranges, and no list of a group is built.
    """
    from paperloom.operators.binning import numbered
    from paperloom.session import keep

    stem = lambda c: F.regexp_replace(c, r"(?:-[0-9]{1,9})?(\.[^./]*)?$", "")
    ext = lambda c: F.regexp_extract(c, r"(\.[^./]*)$", 1)
    number = lambda c: F.coalesce(F.regexp_extract(c, r"-([0-9]{1,9})(?:\.[^./]*)?$", 1).try_cast("bigint"), F.lit(0))

    def placed(rows: DataFrame, group: list[str], order: list[str], to: str) -> DataFrame:
        """rows with their place, from 1, in their group."""
        n = numbered(rows, [*group, *order], "_nth")
        first = n.groupBy(*[F.col(c).alias(f"{c}_g") for c in group]).agg(F.min("_nth").alias("_first"))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_g")) for c in group])
        return n.join(first, same).withColumn(to, F.col("_nth") - F.col("_first") + 1).select(*rows.columns, to)

    ranked = placed(plan.select("path", "to"), ["to"], ["path"], "_r")
    used = ranked.where("_r = 1").select("to")
    if taken is not None:
        ranked = ranked.join(taken.select("to", F.lit(True).alias("_held")).distinct(), "to", "left")
        used = used.unionByName(taken.select("to"))
    else:
        ranked = ranked.withColumn("_held", F.lit(None).cast("boolean"))
    # The k-th row that needs a number; the first of a free target keeps it.
    ranked = ranked.withColumn("_k", F.when(F.col("_held"), F.col("_r")).otherwise(F.col("_r") - 1))
    moved = ranked.where("_k > 0").select("path", F.regexp_replace("to", r"(\.[^./]*)?$", "").alias("_root"), ext(F.col("to")).alias("_e"), "_k")
    groups = moved.where("_k = 1").select("_root", "_e")
    numbers = used.select(stem(F.col("to")).alias("_root"), ext(F.col("to")).alias("_e"), number(F.col("to")).alias("_n")).where("_n > 0").distinct()
    numbers = keep(numbers.join(groups, ["_root", "_e"], "left_semi"))
    if not numbers.isEmpty():
        # The i-th used number n has n - i free ones below it, so it precedes every k above that: with both in one order, a row's place is its number.
        below = placed(numbers, ["_root", "_e"], ["_n"], "_i").select(F.lit(None).cast("string").alias("path"), "_root", "_e", (F.col("_n") - F.col("_i")).alias("_k"), F.lit(0).alias("_row"))
        both = below.unionByName(moved.withColumn("_k", F.col("_k") - 1).withColumn("_row", F.lit(1)))
        moved = placed(both, ["_root", "_e"], ["_k", "_row"], "_place").where("_row = 1").select("path", "_root", "_e", F.col("_place").alias("_k"))
    return ranked.where("_k = 0").select("path", "to").unionByName(moved.select("path", F.concat("_root", F.lit("-"), F.col("_k").cast("string"), "_e").alias("to")))
