"""Language-model scoring by prediction by partial matching on bytes.

The text of the model is a document's words in lower case (A-Z), joined by one blank and
closed by an end byte. The trie holds, for byte contexts of up to ORDER bytes, how often
each byte followed in the training documents. A byte is coded from the longest context
that the trie has; where it was not seen, the model escapes to the context one byte
shorter, and so on down to a uniform law. Escape estimation is method D: each of a context's
q kinds gives half an event to the escape, which has q / 2 of T events. Symbol exclusion: after an escape the kinds
seen in the longer context are taken out of the shorter one. All sums that this needs
depend on the trie only, so they are worked out once, and scoring is a few table lookups
per byte, vectorised over whole batches.

The counts cover all training documents: each task counts its grams, and sums are joined
in one aggregation; lower orders are sums of the highest. The whole trie stays distributed:
per order a table of grams and one of contexts with their escapes and exclusions. Only the
finished logs of at most GRAMS frequent grams of the highest order are broadcast; a text's
other grams, counted per row, meet theirs in a join, where those that no training document
has go down the orders by joins as well. So each score reads the whole trie at any size.

Beside it stands the unigram base score on words. Word counts cover all training tokens
and stay distributed: only the HOT_WORDS most frequent are broadcast, and tokens of all
other words meet their counts in a join.

Defined cases: null and empty texts have the end token only; without training documents
every byte is uniform and every count 0; null keys are never held out; repeated rows are
rows of their own; an empty table gives an empty result; extra columns pass through
score_documents, those named like an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.store import keep
from paperloom.llm.wordcodes import U, mix, ragged, text_buffers, word_codes

ORDER, DISCOUNT = 5, 0.5
GRAMS, HOT_WORDS = 1_500_000, 400_000
END = 0x0A
#: The code of the end token among word codes.
END_CODE = np.uint64(0x1D)
#: Bytes of text worked on at once.
CHUNK = 1 << 20
#: Rows scored at once.
SLICE = 500
_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def stream(texts, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first coded byte of each text, behind its end byte): each text after order pad bytes."""
    pad = bytes([END]) * order
    parts = [b" ".join(bytes(t).translate(_LOWER).split()) for t in texts]
    data = np.frombuffer(b"".join(pad + p + b"\n" for p in parts), np.uint8)
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    ends = np.cumsum(sizes + order)
    return data, ends - sizes, ends


def gram_keys(data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte the number made of it (lowest) and the order bytes before it."""
    key = data.astype(U)
    for j in range(1, order + 1):
        key[j:] |= data[:-j].astype(U) << U(8 * j)
    return key


def _coded(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]).astype(bool)


def _pieces(column: pa.Array, rows: np.ndarray):
    """Lists of (row, bytes) of about CHUNK bytes."""
    raw, offs = text_buffers(column)
    view = memoryview(np.ascontiguousarray(raw))
    part, size = [], 0
    for r in rows.tolist():
        part.append((r, view[offs[r] : offs[r + 1]]))
        size += int(offs[r + 1] - offs[r])
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


class _Counts:
    """Counts by 64-bit key, merged as they come; drained when they get many."""

    def __init__(self, most: int = 1_000_000):
        self.keys, self.n, self.parts, self.most = np.zeros(0, U), np.zeros(0, np.int64), [], most

    def add(self, keys: np.ndarray, n: np.ndarray):
        self.parts.append((keys, n))
        if sum(len(k) for k, _ in self.parts) > self.most // 4:
            self.merge()
        return len(self.keys) > self.most

    def merge(self):
        keys = np.concatenate([self.keys, *(k for k, _ in self.parts)])
        n = np.concatenate([self.n, *(c for _, c in self.parts)])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.n, self.parts = keys[first], np.add.reduceat(n, first) if len(first) else n[:0], []

    def drain(self, kind: int):
        self.merge()
        for at in range(0, len(self.keys), 100_000):
            k = self.keys[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(self.n[at : at + 100_000])], ["kind", "key", "n"]
            )
        self.keys, self.n = np.zeros(0, U), np.zeros(0, np.int64)


def _counter(order: int):
    """(text, learn) in; (kind, key, n) out: kind 0 grams of the highest order, 1 word codes, 2 documents."""

    def count(batches):
        grams, words, docs = _Counts(), _Counts(), 0
        for batch in batches:
            learn = np.flatnonzero(batch.column(1).to_numpy(zero_copy_only=False))
            docs += len(learn)
            for part in _pieces(batch.column(0), learn):
                data, starts, ends = stream([t for _, t in part], order)
                keys = gram_keys(data, order)[_coded(starts, ends, len(data))]
                if grams.add(*np.unique(keys, return_counts=True)):
                    yield from grams.drain(0)
                codes, _ = word_codes(pa.array([bytes(t) for _, t in part], pa.binary()), lower=True)
                if words.add(*np.unique(codes, return_counts=True)):
                    yield from words.drain(1)
        yield from grams.drain(0)
        yield from words.drain(1)
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int8()), pa.array([0], pa.int64()), pa.array([docs], pa.int64())], ["kind", "key", "n"])

    return count


def _least(counts: DataFrame, most: int) -> int:
    """The count from which on at most `most` of the (key, n) rows are left."""
    histogram = counts.groupBy(F.least("n", F.lit(1 << 20)).alias("c")).count().collect()  # at most 2**20 rows; few in fact
    total = 0
    for c, m in sorted(histogram, reverse=True):
        total += m
        if total > most:
            return c + 1
    return 1


class Table:
    """Open-addressing hash table from 64-bit keys to rows, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, int(1.5 * len(keys)).bit_length())
        self.mask = size - 1
        self.slot_key = np.zeros(size, U)
        self.slot_row = np.full(size, -1, np.int32)
        left, step = np.arange(len(keys)), 0
        home = (mix(keys) & U(self.mask)).astype(np.int64)
        while len(left):
            at = (home[left] + step) & self.mask
            free = self.slot_row[at] < 0
            self.slot_row[at[free]] = left[free]  # of several, the last one written stays
            won = free & (self.slot_row[at] == left)
            self.slot_key[at[won]] = keys[left[won]]
            left = left[~won]
            step += 1

    @staticmethod
    def made(parts) -> Table:
        t = Table.__new__(Table)
        t.mask, t.slot_key, t.slot_row = parts
        return t

    @property
    def parts(self):
        return self.mask, self.slot_key, self.slot_row

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if it is not there."""
        home = (mix(keys) & U(self.mask)).astype(np.int64)
        row = self.slot_row[home]
        out = np.where(self.slot_key[home] == keys, row, -1).astype(np.int32)
        open_ = np.flatnonzero((out < 0) & (row >= 0))
        step = 1
        while len(open_):
            at = (home[open_] + step) & self.mask
            row = self.slot_row[at]
            hit = (row >= 0) & (self.slot_key[at] == keys[open_])
            out[open_[hit]] = row[hit]
            open_ = open_[(row >= 0) & ~hit]
            step += 1
        return out


@dataclass
class Trie:
    """The trie in one place, the plain form of trie_tables and gram_logs.

    Per order k: gram keys (k context bytes and the symbol), their log counts, context keys and their four logs.
    """

    order: int
    grams: list[np.ndarray]
    counts: list[np.ndarray]

    def prepare(self) -> Trie:
        """Work out escapes and exclusions."""
        self.log_n, self.gram_table, self.contexts, self.context_table = [], [], [], []
        before = None
        for k in range(self.order + 1):
            keys, n = self.grams[k], self.counts[k].astype(np.float64)
            by = np.argsort(keys, kind="stable")
            keys, n = keys[by], n[by]
            table = Table(keys)
            ctx = keys >> U(8)
            first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, np.int64)
            names = ctx[first]
            total = np.add.reduceat(n, first) if len(first) else np.zeros(0)
            kinds = np.diff(np.append(first, len(keys))).astype(np.float64)
            # Without exclusion: the context that coding starts from.
            stay0, esc0 = np.log10(total), np.log10(DISCOUNT * kinds) - np.log10(total)
            # In the context one byte shorter, without this context's kinds.
            if k == 0:
                stay1, esc1 = np.log10(np.maximum(256 - kinds, 1)), np.zeros(len(names))
            else:
                short_mask = U((1 << (8 * k)) - 1)
                lower = self.gram_table[k - 1].rows(keys & short_mask)
                low_n = np.where(lower >= 0, before["n"][lower], 0)
                parent = self.context_table[k - 1].rows(names & U((1 << (8 * (k - 1))) - 1))
                rest_total = before["total"][parent] - np.add.reduceat(low_n, first) if len(first) else np.zeros(0)
                rest_kinds = before["kinds"][parent] - (np.add.reduceat((lower >= 0).astype(float), first) if len(first) else 0)
                stay1 = np.log10(np.maximum(rest_total, 1e-300))
                esc1 = np.where(rest_kinds > 0, np.log10(np.maximum(DISCOUNT * rest_kinds, 1e-300)) - stay1, 0.0)
            before = {"n": n, "total": total, "kinds": kinds}
            self.log_n.append(np.log10(n - DISCOUNT))
            self.gram_table.append(table)
            self.contexts.append(np.stack([stay0, esc0, stay1, esc1], 1))
            self.context_table.append(Table(names))
            if k == self.order:
                self.top = (np.log10(n - DISCOUNT) - np.repeat(stay0, kinds.astype(np.int64))).astype(np.float32)
        return self

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each byte, given by its gram key of the highest order."""
        row = self.gram_table[self.order].rows(keys)
        out = np.where(row >= 0, self.top[row] if len(self.top) else 0, 0).astype(np.float64)
        todo = np.flatnonzero(row < 0)
        if not len(todo):
            return out
        keys, score = keys[todo], np.zeros(len(todo))
        longer = np.full(len(todo), -1, np.int64)  # row of the context escaped from, of order k + 1
        open_ = np.arange(len(todo))
        for k in range(self.order, -1, -1):
            key = keys[open_] & U((1 << (8 * (k + 1))) - 1)
            ctx = self.context_table[k].rows(key >> U(8)).astype(np.int64)
            gram = self.gram_table[k].rows(key)
            here = ctx >= 0
            started = longer[open_] >= 0
            stay0, esc0 = self.contexts[k][ctx, 0] if len(self.contexts[k]) else 0, self.contexts[k][ctx, 1] if len(self.contexts[k]) else 0
            if k < self.order and len(self.contexts[k + 1]):
                stay1, esc1 = self.contexts[k + 1][longer[open_], 2], self.contexts[k + 1][longer[open_], 3]
            else:
                stay1 = esc1 = np.zeros(len(open_))
            seen = here & (gram >= 0)
            log_n = self.log_n[k][gram] if len(self.log_n[k]) else np.zeros(len(open_))
            score[open_] += np.where(seen, log_n - np.where(started, stay1, stay0), np.where(here, np.where(started, esc1, esc0), 0.0))
            longer[open_] = np.where(here, ctx, longer[open_] if k == self.order else -1)
            open_ = open_[~seen]
        # Uniform over the bytes that no training document has (over all bytes, without training).
        if len(open_):
            root = self.contexts[0]
            score[open_] -= root[0, 2] if len(root) else np.log10(256.0)
        out[todo] = score
        return out


def _low(key, size: int):
    """The last size bytes of a gram key."""
    return F.col(key).bitwiseAND(F.lit((1 << (8 * size)) - 1))


def trie_tables(top: DataFrame, order: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Per order k the grams (key, n) and the contexts (ctx, total, kinds, rest_total, rest_kinds); top has those of the highest order.

    rest is what the context one byte shorter has besides this context's kinds. Grams of up
    to two bytes and contexts of up to two are few whatever the corpus, and are broadcast.
    """
    grams = [top]
    for k in range(order - 1, -1, -1):
        grams.insert(0, keep(grams[0].select(_low("key", k + 1).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n"))))
    contexts: list[DataFrame] = []
    for k in range(order + 1):
        own = grams[k].withColumn("ctx", F.shiftrightunsigned("key", 8))
        if k == 0:
            found = own.groupBy("ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
            contexts.append(keep(found.withColumns({"rest_total": F.lit(0).cast("bigint"), "rest_kinds": F.lit(0).cast("bigint")})))
            continue
        short = grams[k - 1].select(F.col("key").alias("_short"), F.col("n").alias("_n"))
        met = own.withColumn("_short", _low("key", k)).join(F.broadcast(short) if k < 3 else short, "_short")
        found = met.groupBy("ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("_n").alias("_n"))
        parent = contexts[k - 1].select(F.col("ctx").alias("_parent"), F.col("total").alias("_total"), F.col("kinds").alias("_kinds"))
        found = found.withColumn("_parent", _low("ctx", k - 1)).join(F.broadcast(parent) if k < 4 else parent, "_parent")
        contexts.append(keep(found.select("ctx", "total", "kinds", (F.col("_total") - F.col("_n")).alias("rest_total"), (F.col("_kinds") - F.col("kinds")).alias("rest_kinds"))))
    return grams, contexts


def gram_logs(keys: DataFrame, grams: list[DataFrame], contexts: list[DataFrame]) -> DataFrame:
    """(key, log) of distinct gram keys of the highest order: log10 of the probability of their last byte."""
    order = len(grams) - 1
    state = ["key", "log", "done", "rest_total", "rest_kinds"]
    none = F.lit(None).cast("bigint")
    open_ = keys.select("key", F.lit(0.0).alias("log"), F.lit(False).alias("done"), none.alias("rest_total"), none.alias("rest_kinds"))
    settled = None
    for k in range(order, -1, -1):
        g = grams[k].select(F.col("key").alias("_g"), F.col("n").alias("_n"))
        c = contexts[k].select(F.col("ctx").alias("_c"), F.col("total").alias("_total"), F.col("kinds").alias("_kinds"), F.col("rest_total").alias("_rt"), F.col("rest_kinds").alias("_rk"))
        met = open_.withColumn("_g", _low("key", k + 1)).join(F.broadcast(g) if k < 2 else g, "_g", "left").withColumn("_c", F.shiftrightunsigned("_g", 8))
        met = met.join(F.broadcast(c) if k < 3 else c, "_c", "left")
        # A longer context that was escaped from takes its kinds out of this one.
        started = F.col("rest_total").isNotNull()
        stay = F.log10(F.when(started, F.col("rest_total")).otherwise(F.col("_total")))
        left = F.when(started, F.col("rest_kinds")).otherwise(F.col("_kinds"))
        escape = F.when(left > 0, F.log10(F.lit(DISCOUNT) * left) - stay).otherwise(0.0)
        here = F.when(F.col("_n").isNotNull(), F.log10(F.col("_n") - F.lit(DISCOUNT)) - stay).when(F.col("_total").isNotNull(), escape).otherwise(0.0)
        if k == 0:  # what no training document has shares the bytes that are left
            here += F.when(F.col("_n").isNull(), -F.log10(F.greatest(F.lit(256) - F.coalesce("_kinds", F.lit(0)), F.lit(1)))).otherwise(0.0)
        new = met.select("key", F.when(F.col("done"), F.col("log")).otherwise(F.col("log") + here).alias("log"), (F.col("done") | F.col("_n").isNotNull()).alias("done"), F.col("_rt").alias("rest_total"), F.col("_rk").alias("rest_kinds"))
        if k == order:
            new = keep(new)
            settled, open_ = new.where("done"), new.where("NOT done")
        else:
            open_ = new.select(*state)
    if order == 0:
        return new.select("key", "log")
    return settled.select("key", "log").unionByName(open_.select("key", "log"))


def _distinct(owner: np.ndarray, keys: np.ndarray, rows: int):
    """(keys, times, how many keys each row has) of the distinct keys of each row."""
    by = np.lexsort((keys, owner))
    owner, keys = owner[by], keys[by]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]) if len(keys) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    lens = np.bincount(owner[first], minlength=rows)
    return ragged(keys[first].view(np.int64), lens, pa.int64()), ragged(np.diff(np.append(first, len(keys))).astype(np.int32), lens, pa.int32())


def _scorer(grams, hot, order: int):
    """(row columns..., text, held) in; the columns with token counts, sums over frequent words and grams, other words and grams out."""

    def score(batches):
        model, words = grams.value, hot.value
        gram_table, gram_logs_, table, logs = Table.made(model["table"]), model["logs"], Table.made(words["table"]), words["logs"]
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            at = batch.num_columns - 1
            column, rows = batch.column(at), batch.num_rows
            total, owners, others = np.zeros(rows), [np.zeros(0, np.int64)], [np.zeros(0, U)]
            for part in _pieces(column, np.arange(rows)):
                data, starts, ends = stream([t for _, t in part], order)
                keys = gram_keys(data, order)[_coded(starts, ends, len(data))]
                row = gram_table.rows(keys)
                known = row >= 0
                owner = np.repeat([r for r, _ in part], ends - starts)
                total += np.bincount(owner[known], gram_logs_[row[known]], rows)
                owners.append(owner[~known])
                others.append(keys[~known])
            tail = _distinct(np.concatenate(owners), np.concatenate(others), rows)
            codes, offs = word_codes(column, lower=True)
            row = table.rows(codes)
            known = row >= 0
            owner = np.repeat(np.arange(rows), np.diff(offs))
            base = np.bincount(owner[known], logs[row[known]], rows) + words["end"]
            n_known = np.bincount(owner[known], minlength=rows) + words["end_known"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(at)),
                    pa.array(np.diff(offs) + 1), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(total),
                    *_distinct(owner[~known], codes[~known], rows), *tail,
                ],
                [*(batch.schema.names[:at]), "n_tokens", "_known", "_base", "_score", "_rare", "_times", "_grams", "_gram_times"],
            )

    return score


def train(docs: DataFrame, learn: Column, text: str = "text", order: int = ORDER) -> tuple[DataFrame, DataFrame, int]:
    """(checkpointed word counts (key, n), those of the highest order's grams, number of training documents)."""
    seen = docs.select(F.col(text).alias("t"), F.coalesce(learn, F.lit(False)).alias("l"))
    counted = seen.mapInArrow(_counter(order), "kind tinyint, key bigint, n bigint")
    counted = keep(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    total = counted.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counted.where("kind = 1").select("key", "n"), counted.where("kind = 0").select("key", "n"), int(total)


def score_documents(docs: DataFrame, held_out: Column, text: str = "text", carry: list[str] | None = None, order: int = ORDER) -> DataFrame:
    """docs' columns (or those of carry) with held_out, n_tokens, n_known, train_tokens, base_score, score; learns from the rest."""
    spark = docs.sparkSession
    made = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    names = [c for c in (docs.columns if carry is None else carry) if c not in made]
    words, top, documents = train(docs, ~held_out, text, order)
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, kinds = int(size[0]) + documents, int(size[1]) + (1 if documents else 0)
    unit = np.log10(float(tokens + kinds + 1))
    got = words.where(F.col("n") >= _least(words, HOT_WORDS)).toArrow()  # at most HOT_WORDS rows
    keys, n = got.column("key").to_numpy().view(U), got.column("n").to_numpy()
    hot = {"table": Table(keys).parts, "logs": np.log10(n + 1.0) - unit, "end": float(np.log10(documents + 1.0) - unit), "end_known": int(documents > 0)}
    grams, contexts = trie_tables(top, order)
    often = top.where(F.col("n") >= _least(top, GRAMS)).withColumn("ctx", F.shiftrightunsigned("key", 8))
    got = often.join(contexts[order], "ctx").select("key", (F.log10(F.col("n") - F.lit(DISCOUNT)) - F.log10("total")).alias("log")).toArrow()  # at most GRAMS rows
    known = {"table": Table(got.column("key").to_numpy().view(U)).parts, "logs": got.column("log").to_numpy()}
    shared = spark.sparkContext.broadcast(known), spark.sparkContext.broadcast(hot)  # bounded by GRAMS and HOT_WORDS
    # Carried columns go by their places, so that none is named like a column made here.
    placed = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    inputs = docs.select(*placed, held_out.alias("held_out"), F.monotonically_increasing_id().alias("_uid"), F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.drop("_text").schema)
    schema += ", n_tokens bigint, _known bigint, _base double, _score double, _rare array<bigint>, _times array<int>, _grams array<bigint>, _gram_times array<int>"
    scored = keep(inputs.mapInArrow(_scorer(*shared, order), schema))
    rare = scored.select("_uid", F.explode(F.arrays_zip("_rare", "_times")).alias("r")).select("_uid", F.col("r._rare").alias("key"), F.col("r._times").alias("m"))
    # Frequent words are not among these, so no key of the join is hot.
    met = rare.join(words, "key", "left")
    each = F.col("m") * (F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0)) - F.lit(float(unit)))
    sums = met.groupBy("_uid").agg(F.sum(each).alias("_more"), F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("_found"))
    tail = scored.select("_uid", F.explode(F.arrays_zip("_grams", "_gram_times")).alias("r")).select("_uid", F.col("r._grams").alias("key"), F.col("r._gram_times").alias("m"))
    gram_log = gram_logs(tail.select("key").distinct(), grams, contexts)
    gram_sums = tail.join(gram_log, "key").groupBy("_uid").agg(F.sum(F.col("m") * F.col("log")).alias("_tail"))
    joined = scored.drop("_rare", "_times", "_grams", "_gram_times").join(sums, "_uid", "left").join(gram_sums, "_uid", "left")
    return joined.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(names)),
        "held_out",
        "n_tokens",
        (F.col("_known") + F.coalesce("_found", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_more", F.lit(0.0))).alias("base_score"),
        (F.col("_score") + F.coalesce("_tail", F.lit(0.0))).alias("score"),
    )
