"""Removal of repeated passages with FM-indexes over content-routed shards.

A window is WINDOW consecutive words of one document; a word goes if a window that covers
it also starts in a document with a smaller id. An index of everything would have to be
streamed by everything, so text is routed by content: each window has a minimizer, the
least code of its GRAM-word sequences. Equal windows have equal minimizers, so only runs of
windows whose minimizer occurs in two documents or more can repeat. Those runs, with their
words, are sent to the shard of their minimizer; the shard builds a compressed FM-index of
its segments (see fm_index) and streams the same segments through it by backward search.
Matching statistics of WINDOW or more report the windows to remove.

Equal documents are one class from the start: all but the least id lose all words, if they
have WINDOW or more. A minimizer of more than HOT runs (counted by their words, long ones cut) is salted over several shards; what
its shards leave unmatched is matched among them in further rounds, by the windows' own
codes, as long as any shard is split. There one start stands for all starts of a window in
documents of one id, and its verdict holds for all. So no shard grows with one frequent
passage, and of each split window a round leaves one id a shard, which ends the rounds.

Words are compared by 64-bit codes. Nothing but counts reaches the driver.

Defined cases: null and empty texts have no words and keep the hash of nothing; rows with
a null id are kept whole and remove nothing; rows with equal ids do not count as smaller
than one another; repeated rows are judged alike; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.fm_index import FMIndex
from paperloom.llm.hyperminhash import _whole_groups
from paperloom.llm.store import keep
from paperloom.llm.wordcodes import U, grams, mix, ragged, text_buffers, word_codes

WINDOW, GRAM = 50, 12
#: Segments of one minimizer in one shard, each of SEGMENT_WORDS words or a part of them, and words in one index.
HOT, SEGMENT_WORDS, SHARD_WORDS = 512, 256, 300_000
#: A longer run of windows with one minimizer, as periodic texts have, is cut into segments.
MOST_WINDOWS = 2_048
#: Up to so many ids are broadcast to the scan of the texts.
BROADCAST_IDS = 500_000

NOTHING = hashlib.sha256(b"").hexdigest()


def window_minima(codes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """For each window start the least gram code of the window."""
    g = grams(codes, min(gram, window))
    span = window - min(gram, window) + 1
    width, now = 1, g
    while 2 * width <= span:
        now = np.minimum(now[:-width], now[width:])
        width *= 2
    rest = span - width
    return np.minimum(now[: len(now) - rest], now[rest:]) if rest else now


def window_codes(codes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A code of each window."""
    return grams(codes, window)


def _pieces(starts: np.ndarray, n: int) -> np.ndarray:
    """Run starts among n windows, with further ones so that no run exceeds MOST_WINDOWS."""
    sizes = np.diff(np.append(starts, n))
    parts = -(-sizes // MOST_WINDOWS)
    at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(starts, parts) + at * MOST_WINDOWS


def _profiler(window: int, gram: int):
    def profile(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                codes, offs = word_codes(part.column(1), lower=False)
                raw, bounds = text_buffers(part.column(1))
                view = memoryview(np.ascontiguousarray(raw))
                keys, starts, counts, digests, plain = [], [], [], [], []
                for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                    c = codes[a:b]
                    plain.append(hashlib.sha256(b" ".join(bytes(view[bounds[i] : bounds[i + 1]]).split())).hexdigest())
                    if b - a < window:
                        keys.append(np.zeros(0, U))
                        starts.append(np.zeros(0, np.int64))
                        counts.append(0)
                        digests.append(None)
                        continue
                    digests.append(xxhash.xxh3_128_digest(c.tobytes()))
                    m = window_minima(c, window, gram)
                    s = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
                    if len(m) > MOST_WINDOWS:
                        s = _pieces(s, len(m))
                    keys.append(mix(m[s]))
                    starts.append(s)
                    counts.append(len(s))
                ends = [np.append(s[1:], n - window + 1) if len(s) else s for s, n in zip(starts, np.diff(offs).tolist())]
                flat = np.concatenate(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(np.diff(offs)), pa.array(digests, pa.binary()), pa.array(plain),
                        ragged(np.concatenate(keys).view(np.int64), counts, pa.int64()),
                        ragged(flat.astype(np.int32), counts, pa.int32()),
                        ragged((np.concatenate(ends) - flat).astype(np.int32), counts, pa.int32()),
                    ],
                    ["id", "n", "digest", "plain", "keys", "starts", "counts"],
                )

    return profile


PROFILE = "id bigint, n bigint, digest binary, plain string, keys array<bigint>, starts array<int>, counts array<int>"
SEGMENT = "key bigint, salt int, id bigint, h bigint, start int, windows int, split boolean, codes binary"


def _segmenter(window: int):
    """(id, h, text, runs of (key, start, windows, salt, split)) in, segments with their words' codes out."""

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                codes, offs = word_codes(part.column(2), lower=False)
                runs = part.column(3)
                if isinstance(runs, pa.ChunkedArray):
                    runs = runs.combine_chunks()
                bounds = runs.offsets.to_numpy()
                flat = [np.asarray(f) for f in runs.values.flatten()]
                ids, hs = part.column(0).to_numpy(), part.column(1).to_numpy()
                owner = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                key, start, windows, salt, split = (f[bounds[0] : bounds[-1]] for f in flat)
                base = offs[owner]
                # A row that shares its id and hash with others of another text could be shorter than its runs.
                ok = start + windows + window - 1 <= offs[owner + 1] - base
                out = [codes[b + s : b + s + w + window - 1].tobytes() for b, s, w in zip(base[ok].tolist(), start[ok].tolist(), windows[ok].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[ok]), pa.array(salt[ok]), pa.array(ids[owner[ok]]), pa.array(hs[owner[ok]]), pa.array(start[ok]), pa.array(windows[ok]),
                     pa.array(split[ok]), pa.array(out, pa.binary())],
                    ["key", "salt", "id", "h", "start", "windows", "split", "codes"],
                )

    return cut


RESOLVED = "id bigint, h bigint, a int, b int, codes binary"


def _runs_of(hit: np.ndarray):
    """(first, behind last) of the runs of True."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _resolver(window: int, shard_words: int):
    """Segments in, sorted by (key, salt); removed word ranges out and, of split minimizers, what is unmatched yet."""

    def matched(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        ids, hs, start, windows, split = (table.column(c).to_numpy() for c in ("id", "h", "start", "windows", "split"))
        words = [np.frombuffer(x.as_buffer(), U) for x in table.column("codes")]
        lengths = np.array([len(w) for w in words])
        index = FMIndex(np.concatenate(words), lengths, ids, window)
        stats = index.matching_statistics(full_only=True)
        out = []
        for i in range(len(ids)):
            hit = stats[index.starts[i] : index.starts[i] + windows[i]] >= window
            for a, b in zip(*_runs_of(hit)):
                out.append((ids[i], hs[i], start[i] + a, start[i] + b - 1 + window, None))
            if split[i]:
                for a, b in zip(*_runs_of(~hit)):
                    out.append((ids[i], hs[i], start[i] + a, start[i] + b, words[i][a : b - 1 + window].tobytes()))
        return out

    def resolve(batches):
        held, size = [], 0
        for batch in _whole_groups(batches):
            held.append(batch)
            size += sum(len(x.as_buffer()) for x in batch.column(7)) // 8
            if size >= shard_words:
                yield from emit(matched(held))
                held, size = [], 0
        if held:
            yield from emit(matched(held))

    def emit(rows):
        if rows:
            cols = list(zip(*rows))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "h", "a", "b", "codes"])

    return resolve


def _windows_mapper(window: int):
    """Unmatched segments in, (code, id, h, start) of their windows out."""

    def mapper(batches):
        for batch in batches:
            w = [window_codes(np.frombuffer(x.as_buffer(), U), window) for x in batch.column(3)]
            n = [len(x) for x in w]
            starts = [np.arange(len(x)) + s for x, s in zip(w, batch.column(2).to_pylist())]
            rep = np.repeat(np.arange(batch.num_rows), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(w).view(np.int64)), pa.array(batch.column(0).to_numpy()[rep]), pa.array(batch.column(1).to_numpy()[rep]), pa.array(np.concatenate(starts).astype(np.int32))],
                ["key", "id", "h", "start"],
            )

    return mapper


def _repeated(runs: DataFrame, hot: int, turn: int = 0) -> DataFrame:
    """The runs whose key two documents or more have, with salt (another each turn) and split."""
    size = F.ceil((F.col("windows") + WINDOW - 1) / SEGMENT_WORDS)
    keys = runs.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum(size).alias("m")).where("lo <> hi")
    parts = F.ceil(F.col("m") / hot).cast("int")
    marked = runs.join(keys.select("key", parts.alias("_parts")), "key")
    return marked.withColumn("salt", F.pmod(F.xxhash64("id", "h", "start", F.lit(turn)), F.col("_parts")).cast("int")).withColumn("split", F.col("_parts") > 1).drop("_parts")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs' rows with one of the (checkpointed, distinct) ids; broadcast up to a checked number."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def _hash_of(digest: str):
    return F.xxhash64(digest)


def removed_ranges(docs: DataFrame, profile: DataFrame, window: int = WINDOW, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id, h, a, b): words a to b - 1 of a class's least document repeat from a smaller id."""
    long = profile.where("digest IS NOT NULL AND id IS NOT NULL")
    least = long.groupBy("digest").agg(F.min("id").alias("id"))
    first = long.join(least, ["digest", "id"], "left_semi").dropDuplicates(["id", "digest"])
    runs = first.select("id", _hash_of("digest").alias("h"), F.explode(F.arrays_zip("keys", "starts", "counts")).alias("r"))
    runs = runs.select(F.col("r.keys").alias("key"), "id", "h", F.col("r.starts").alias("start"), F.col("r.counts").alias("windows"))
    repeated = _repeated(runs, hot)
    per_doc = keep(repeated.groupBy("id", "h").agg(F.collect_list(F.struct("key", "start", "windows", "salt", "split")).alias("runs")))
    texts = _texts_of(docs, keep(per_doc.select("id").distinct()))
    rows = per_doc.join(texts, "id").select("id", "h", "text", "runs")
    segments = rows.mapInArrow(_segmenter(window), SEGMENT)

    def resolve(segments):
        placed = segments.select("key", "salt", "id", "h", "start", "windows", "split", "codes").repartition("key", "salt").sortWithinPartitions("key", "salt")
        done = keep(placed.mapInArrow(_resolver(window, shard_words), RESOLVED))
        return done.where("codes IS NULL").select("id", "h", "a", "b"), done.where("codes IS NOT NULL")

    found, left = resolve(segments)
    if left.isEmpty():
        return found
    # Between the shards of a split minimizer: whole windows, by their own codes.
    every = keep(left.select("id", "h", "a", "codes").mapInArrow(_windows_mapper(window), "key bigint, id bigint, h bigint, start int"))
    one = every.groupBy("key", "id").agg(F.min(F.struct("h", "start")).alias("f")).select("key", "id", "f.h", "f.start")
    # Their words, from the segment that holds them.
    again = _repeated(one.withColumn("windows", F.lit(1)), hot, 1)
    joined = again.join(left.select("id", "h", "a", "b", F.col("codes").alias("seg")), ["id", "h"]).where("start >= a AND start < b")
    piece = F.substring(F.col("seg"), (F.col("start") - F.col("a")) * 8 + 1, F.lit(8 * window))
    segments = keep(joined.select("key", "salt", "id", "h", "start", "windows", "split", piece.alias("codes")).dropDuplicates(["key", "id"]))
    placed, gone, turn = segments.select("key", "id", "h", "start"), None, 1
    while True:
        cuts, left = resolve(segments)
        cuts = cuts.select("id", "h", F.col("a").alias("start"))
        gone = cuts if gone is None else gone.unionByName(cuts)
        if left.isEmpty():
            break
        turn += 1
        # An unmatched segment is one window here.
        rest = left.select("id", "h", F.col("a").alias("start"), "codes").join(placed, ["id", "h", "start"]).withColumn("windows", F.lit(1))
        segments = _repeated(rest, hot, turn)
    verdict = placed.join(gone, ["id", "h", "start"]).select("key", "id").distinct()
    return found.unionByName(every.join(verdict, ["key", "id"]).select("id", "h", F.col("start").alias("a"), (F.col("start") + window).alias("b")))


def _cutter():
    """(id, h, n, text, ranges) in, (id, h, n_removed, kept_sha256) out."""

    def cut(batches):
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = (text or "").encode().split()
                gone = np.zeros(len(words), bool)
                for r in ranges:
                    gone[r["a"] : r["b"]] = True
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode()))
            removed, digest, text = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(text, pa.string())], ["id", "h", "n_removed", "kept_sha256", "kept_text"]
            )

    return cut


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = False, **how) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every row, and kept_text if asked for (null where nothing was removed)."""
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    profile = keep(rows.mapInArrow(_profiler(window, GRAM), PROFILE))
    ranges = removed_ranges(rows, profile, window, **how)
    per_doc = keep(ranges.groupBy("id", "h").agg(F.collect_set(F.struct("a", "b")).alias("ranges")))
    texts = _texts_of(rows, keep(per_doc.select("id").distinct()))
    # Rows of one id with several texts are told apart by their words' hash.
    cut_rows = per_doc.join(texts, "id").select("id", "h", "text", "ranges")
    done = cut_rows.mapInArrow(_cutter(), "id bigint, h bigint, n_removed bigint, kept_sha256 string, kept_text string")
    done = done.drop("kept_text") if not with_text else done
    done = done.dropDuplicates(["id", "h"])
    classes = profile.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("least"))
    base = profile.select("id", "n", "digest", "plain").join(classes, "digest", "left").withColumn("h", _hash_of("digest"))
    joined = base.join(done.withColumnsRenamed({"id": "_id", "h": "_h"}), (F.col("id") == F.col("_id")) & (F.col("h") == F.col("_h")) & F.col("least").isNotNull(), "left")
    copy = F.coalesce(F.col("least") < F.col("id"), F.lit(False))
    out = [
        F.col("id").alias(key),
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, F.lit(NOTHING)).otherwise(F.coalesce("kept_sha256", "plain")).alias("kept_sha256"),
    ]
    if with_text:
        out.append(F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    return joined.select(*out)
