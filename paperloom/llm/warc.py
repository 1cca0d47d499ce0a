"""WARC archives: a writer with revisit records and a salvage reader.

Writer: each task writes its rows into archives of a bounded size, one gzip member per
record (or plain records), through pyarrow's file systems, so that any shared store
works. An archive appears under its final name only when it is whole, the name depends
only on the partition and its content, and only the rows of a checkpointed manifest are
read back, so repeated and lost tasks leave nothing that counts twice.

Salvage reader: a record is good if it has a version line, a header of fields and as many
bytes as Content-Length says, closed by two line ends, and its block agrees with its
digests. A gzip member must inflate to its checksum and may hold any number of records.
After a failed check the reader searches for the next place where the checks hold (a gzip
magic or a `WARC/1.` version line), goes on from there and reports the bytes between as a
gap; gaps inside a sound member are told by their places in the inflated bytes.

Archives are read in pieces, so a task holds one member or record. Large archives are cut
into splits for several tasks: a split's reader yields the records that start in it. What a
reader takes for records inside the payload of a record that began before its split is
dropped afterwards, by the spans of each archive in order.

Defined cases: null payloads are empty; null ids and targets become empty headers and
read back as null; equal payloads under the revisit bound are all responses; of equal
payloads all rows with the largest id are responses, and those with a null id revisit it;
an empty table gives no archive and no rows, an empty archive no rows; headers may have any
length; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.store import drop_path, keep, scratch

#: Payloads of fewer bytes are never stored as revisits.
REVISIT_BYTES = 1000
#: An archive is closed when it has this many bytes.
ARCHIVE_BYTES = 16 << 20
#: One task reads at most this much of an archive, and what the last record of it needs beyond.
SPLIT_BYTES = 64 << 20
#: Bytes read at once, and fed at once to the inflater.
WINDOW_BYTES, FEED_BYTES = 1 << 20, 1 << 14

#: Fixed values of the WARC format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"

MANIFEST = "path string, records bigint, bytes bigint"
RECORDS = (
    "path string, start bigint, end bigint, inner_start bigint, inner_end bigint, kind string, page_id bigint, url string, record_type string, "
    "payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
)


def _filesystem(path: str):
    """(file system, path in it) for a URI or a local path; s3a is s3 to pyarrow."""
    path = re.sub(r"^s3[an]:", "s3:", path)
    path = re.sub(r"^file:/+", "file:///", path)
    return pafs.FileSystem.from_uri(path)


def encode_record(page_id, url, kind: str, payload: bytes, size: int, sha1: bytes, refers_to=None) -> bytes:
    """One record without compression; a revisit has no block but tells the digest and size of its payload."""
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"[\r\n]", "", url or "")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode()),
        ("X-Payload-Length", str(size)),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        payload = b""
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + payload + END


class Source:
    """Bytes by place, of a random-access file or of memory; one window is held."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.window = file, size, 0, b""

    @staticmethod
    def of(data: bytes) -> Source:
        whole = Source(None, len(data))
        whole.window = data
        return whole

    def get(self, at: int, n: int) -> bytes:
        """n bytes from a place on, fewer at the end."""
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if at < self.at or at + n > self.at + len(self.window):
            self.file.seek(at)
            self.at, self.window = at, self.file.read(max(n, WINDOW_BYTES))
        return self.window[at - self.at : at - self.at + n]

    def find(self, pattern: re.Pattern, at: int, width: int) -> int:
        """The next place of a pattern of up to width bytes, -1 if there is none."""
        while at < self.size:
            data = self.get(at, min(WINDOW_BYTES, self.size - at))
            m = pattern.search(data)
            if m:
                return at + m.start()
            if at + len(data) >= self.size:
                return -1
            at += len(data) - width + 1
        return -1


_STARTS = re.compile(re.escape(GZIP_MAGIC) + rb"|WARC/1\.")
_LINE_END = re.compile(rb"\r\n")
_FIELD = re.compile(rb"[!#-'*+.0-9A-Z^-z|~-]{1,256}[ \t]*:")


def _header(source: Source, at: int) -> tuple[dict, int] | None:
    """(fields, place of the block) of the record at a place; a line that is no field ends the attempt."""
    if not re.fullmatch(rb"WARC/1\.\d\r\n", source.get(at, 10)):
        return None
    at, fields, last = at + 10, {}, None
    while True:
        head = source.get(at, 300)
        if head[:2] == b"\r\n":
            return fields, at + 2
        name = _FIELD.match(head)
        if not name and not (last and head[:1] in (b" ", b"\t")):
            return None
        end = source.find(_LINE_END, at, 2)
        if end < 0:
            return None
        line = source.get(at, end - at)
        if name:
            last = name[0][:-1].strip().lower().decode("latin1")
            fields[last] = line[name.end() :].strip().decode("utf-8", "replace")
        else:  # a folded line
            fields[last] += " " + line.strip().decode("utf-8", "replace")
        at = end + 2


def _agrees(digest: str, data: bytes) -> bool:
    """Whether a labelled digest, in hex or base 32, is that of the data; of unknown kinds it is taken to be."""
    label, _, value = digest.partition(":")
    if label.lower() not in ("sha1", "sha256", "md5") or not value:
        return True
    own = hashlib.new(label.lower(), data).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def _record(source: Source, at: int) -> tuple[dict, bytes, int] | None:
    """(fields, block, end) of the record at a place, or None if any check fails."""
    found = _header(source, at)
    if not found:
        return None
    fields, start = found
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return None
    end = start + int(length)
    if source.get(end, 4) != END:
        return None
    block = source.get(start, int(length))
    # The payload of an HTTP record is not its block, and a revisit has none.
    own = fields.get("warc-type") != "revisit" and not fields.get("content-type", "").startswith("application/http")
    if not _agrees(fields.get("warc-block-digest", ""), block) or own and not _agrees(fields.get("warc-payload-digest", ""), block):
        return None
    return fields, block, end + 4


def _member(source: Source, at: int) -> tuple[bytes, int] | None:
    """(inflated bytes, end) of the gzip member at a place, checksum and all, or None."""
    inflater, out, fed = zlib.decompressobj(31), [], at
    try:
        while not inflater.eof:
            piece = source.get(fed, FEED_BYTES)
            if not piece:
                return None
            fed += len(piece)
            out.append(inflater.decompress(piece))
    except zlib.error:
        return None
    return b"".join(out), fed - len(inflater.unused_data)


def records(source: Source, lo: int = 0, hi: int | None = None) -> Iterator[tuple]:
    """What starts from lo to hi: (kind, start, end, inner start, inner end, fields, block).

    kind is record, or gap for what no record of a sound gzip member covers. The inner places,
    in a member's inflated bytes, are None outside of members.
    """
    at, hi = lo, source.size if hi is None else hi
    while at < hi:
        if source.get(at, 3) == GZIP_MAGIC and (member := _member(source, at)):
            data, end = member
            for kind, a, b, _, _, fields, block in with_gaps(records(Source.of(data)), len(data)):
                yield kind, at, end, a, b, fields, block
            at = end
        elif found := _record(source, at):
            yield "record", at, found[2], None, None, found[0], found[1]
            at = found[2]
        else:
            at = source.find(_STARTS, at + 1, 7)
            if at < 0:
                return


def with_gaps(found: Iterator[tuple], size: int) -> Iterator[tuple]:
    """What was found in order, and a gap for each stretch between, before and behind."""
    at = 0
    for row in found:
        if row[1] > at:
            yield "gap", at, row[1], None, None, None, None
        yield row
        at = row[2]
    if at < size:
        yield "gap", at, size, None, None, None, None


def salvage(data: bytes) -> Iterator[tuple]:
    """Records and gaps of an archive in memory, as records() gives them."""
    return with_gaps(records(Source.of(data)), len(data))


def _int(text: str | None):
    digits = re.search(r"-?\d+", text or "")
    return int(digits[0]) if digits else None


def _writer(folder: str, compress: bool, archive_bytes: int):
    """A mapInArrow function: (page_id, url, payload, sha1, refers_to) rows in, manifest rows out."""

    def write(batches):
        from pyspark import TaskContext

        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        task, serial = TaskContext.get(), 0
        buffer, count, done = io.BytesIO(), 0, []

        def close():
            nonlocal buffer, count, serial
            name = f"{base}/part-{task.partitionId():05d}-{serial:05d}.warc{'.gz' if compress else ''}"
            draft = f"{name}.{task.taskAttemptId()}.open"
            with fs.open_output_stream(draft) as f:
                f.write(buffer.getbuffer())
            fs.move(draft, name)
            done.append((f"{folder}/{name.rpartition('/')[2]}", count, buffer.tell()))
            buffer, count, serial = io.BytesIO(), 0, serial + 1

        for batch in batches:
            for page, url, payload, sha1, refers in zip(*(c.to_pylist() for c in batch.columns)):
                payload = payload or b""
                record = encode_record(page, url, "response" if refers is None else "revisit", payload, len(payload), bytes.fromhex(sha1), refers)
                if compress:
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    record = z.compress(record) + z.flush()
                buffer.write(record)
                count += 1
                if buffer.tell() >= archive_bytes:
                    close()
        if count:
            close()
        if done:
            paths, counts, sizes = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return write


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
    compress: bool = True,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write one record per row below folder; the (checkpointed) manifest of archives.

    Of equal payloads of revisit_bytes or more, the row with the largest id holds the payload.
    """
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"), F.sha1(body).alias("sha1")
    )
    large = F.octet_length("payload") >= revisit_bytes
    groups = rows.where(large).groupBy(F.col("sha1").alias("g")).agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1")
    # The side with the payloads is split by adaptive execution if one digest is hot; the other has one row per digest.
    marked = rows.join(groups, large & (F.col("sha1") == F.col("g")), "left")
    refers = F.when(F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder"))
    marked = marked.select("page_id", "url", "payload", "sha1", refers.alias("refers_to"))
    return keep(marked.mapInArrow(_writer(folder, compress, archive_bytes), MANIFEST))


def _splitter(split_bytes: int):
    """Paths in; (path, size, lo, hi, whole) of their splits out."""

    def split(batches):
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                fs, inner = _filesystem(path)
                size = fs.get_file_info(inner).size
                rows += [(path, size, lo, min(lo + split_bytes, size), size <= split_bytes) for lo in range(0, size, split_bytes)]
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["path", "size", "lo", "hi", "whole"])

    return split


def _reader(with_payload: bool):
    schema = pa.schema(
        [("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("inner_start", pa.int64()), ("inner_end", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()),
         ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    )

    def row_of(path, kind, start, end, inner, to, fields, block):
        if kind == "gap":
            return (path, start, end, inner, to, kind, None, None, None, (end - start) if inner is None else to - inner, None, None, None)
        revisit = fields.get("warc-type") == "revisit"
        digest = fields.get("warc-payload-digest", "")
        try:
            digest = base64.b32decode(digest.removeprefix("sha1:")).hex() if digest.startswith("sha1:") and len(digest) == 37 else hashlib.sha1(block).hexdigest()
        except ValueError:
            digest = hashlib.sha1(block).hexdigest()
        size = _int(fields.get("x-payload-length")) if revisit else len(block)
        return (path, start, end, inner, to, kind, _int(fields.get("warc-record-id")), fields.get("warc-target-uri") or None, fields.get("warc-type"),
                size, digest, _int(fields.get("warc-refers-to")), block if with_payload else None)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    def read(batches):
        for batch in batches:
            for path, size, lo, hi, whole in zip(*(c.to_pylist() for c in batch.columns)):
                fs, inner = _filesystem(path)
                rows, held = [], 0
                with fs.open_input_file(inner) as f:
                    found = records(Source(f, size), lo, hi)
                    for x in with_gaps(found, size) if whole else found:
                        rows.append(row_of(path, *x))
                        held += len(x[6]) if with_payload and x[6] else 0
                        if len(rows) >= 2000 or held >= WINDOW_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return read


def read_warc(archives: DataFrame, path_col: str = "path", with_payload: bool = True, parallel: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records and quarantined gaps (kind `record` or `gap`) of the archives listed in a column of paths.

    start and end are places in the archive; inner_start and inner_end those in the inflated
    bytes of a gzip member. A gap's payload_bytes is its length.
    """
    splits = archives.select(path_col).mapInArrow(_splitter(split_bytes), "path string, size bigint, lo bigint, hi bigint, whole boolean")
    n = parallel or archives.sparkSession.sparkContext.defaultParallelism
    splits = keep(splits.repartition(n, "path", "lo"))
    single = splits.where("whole").mapInArrow(_reader(with_payload), RECORDS)
    if splits.where("NOT whole").isEmpty():
        return single
    names = single.columns
    found = splits.where("NOT whole").mapInArrow(_reader(with_payload), RECORDS)
    earlier = Window.partitionBy("path").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_before", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    # What starts inside an earlier span is no record of its own, but part of a payload.
    found = found.where(F.col("start") >= F.col("_before"))
    spans = found.select("path", "start", "end", "_before").distinct()
    sizes = splits.where("NOT whole AND lo = 0").select("path", "size")
    ends = sizes.join(spans.groupBy("path").agg(F.max("end").alias("_last")), "path", "left").select("path", F.coalesce("_last", F.lit(0)).alias("a"), F.col("size").alias("b"))
    holes = spans.select("path", F.col("_before").alias("a"), F.col("start").alias("b")).unionByName(ends).where("a < b")
    gap = {"path": F.col("path"), "start": F.col("a"), "end": F.col("b"), "kind": F.lit("gap"), "payload_bytes": F.col("b") - F.col("a")}
    gaps = holes.select(*[gap.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in single.schema])
    return single.unionByName(found.select(*names)).unionByName(gaps)


def round_trip(pages: DataFrame, folder: str | None = None, compress: bool = True, **options) -> DataFrame:
    """Write pages as archives in the shared folder, then all records read back, without their payloads.

    Without a folder of the caller's, the archives are deleted once they are read.
    """
    spark = pages.sparkSession
    own = folder or scratch(spark, "warc")
    read = keep(read_warc(write_warc(pages, own, compress=compress, **options), with_payload=False))
    if not folder:
        drop_path(spark, own)
    return read
