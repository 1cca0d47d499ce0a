"""Quality classifier by compression with dictionaries of good and of bad text.

Two zstandard dictionaries are trained on labelled text, one of each class. A document is
compressed with both, whole, in pieces of equal length so that the dictionaries keep their
weight in long texts. The difference of the compressed sizes, normalised by the length and
by the sizes themselves (which brings it out in texts of mere repetition), says which class
its text is closer to. A logistic curve, piecewise linear in the two normalised differences
and fitted on labelled documents that the dictionaries have not seen, makes a calibrated
probability of label 1 of them.

Fitting uses a bounded sample: at most PER_CLASS documents of each label, chosen by hash,
whole texts. One half of them trains the dictionaries, a task for each class holding the
texts of that half; the other half is compressed where it lies. Only two dictionaries and
three numbers a document reach the driver. Scoring covers whole texts of all documents and
holds one batch at a time.

Defined cases: null and empty texts get the score of no evidence; null labels and labels
other than 0 and 1 teach nothing; without labelled documents of both classes every score
is the share of label 1 (1 if there are no labels at all); repeated rows are scored alike;
an empty table gives an empty result; extra columns pass through score_quality, those
named like an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.store import keep, quoted
from paperloom.llm.wordcodes import text_buffers

PER_CLASS, DICT_BYTES = 2_000, 110_000
PIECE, LEVEL, THRESHOLD = 2_048, 3, 0.3


@dataclass
class Model:
    """What scoring needs: two dictionaries (None: a constant score) and the calibration."""

    good: bytes | None
    bad: bytes | None
    centre: list[float]
    scale: list[float]
    weights: list[float]
    prior: float


def _compressors(good: bytes, bad: bytes):
    out = []
    for data in (bad, good):
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def _sizes(text, compressors) -> tuple[int, int, int]:
    n, sizes = len(text), [0, 0]
    for at in range(0, n, PIECE):
        part = text[at : at + PIECE]
        for i, c in enumerate(compressors):
            sizes[i] += len(c.compress(part))
    return n, sizes[0], sizes[1]


#: Frame header bytes, which carry no evidence, are taken as this many per piece.
_FRAME = 9
#: Bounds of the pieces in which the score is linear: of the difference by length, and by compressed size.
_BY_LENGTH = (-1.0, -0.1, -0.05, -0.02, 0.0, 0.02, 0.05, 0.1, 1.0)
_BY_SIZE = (-1.0, -0.3, -0.1, -0.05, 0.0, 0.05, 0.1, 0.3, 1.0)


def _features(sizes: np.ndarray) -> np.ndarray:
    """Columns from (length, size with the bad dictionary, size with the good one): both normalised differences, cut into pieces."""
    n, bad, good = (sizes[:, i].astype(float) for i in range(3))
    by_length = (bad - good) / (n + 24)
    by_size = (bad - good) / (bad + good - 2 * _FRAME * np.ceil(n / PIECE) + 48)
    return np.stack([np.clip(d, a, b) for d, edges in ((by_length, _BY_LENGTH), (by_size, _BY_SIZE)) for a, b in zip(edges[:-1], edges[1:])], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights (the last is the intercept) by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[i : i + 1024] for t in texts for i in range(0, len(t), 1024)]
    room = min(DICT_BYTES, max(512, sum(map(len, pieces)) // 8))
    try:
        return zstandard.train_dictionary(room, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: it serves as it is
        return b"".join(pieces)[-DICT_BYTES:]


def _train_class(key, table):
    """The rows (q, half, o, t) of one class in; its dictionary out."""
    rows = sorted(zip(table.column("o").to_pylist(), table.column("t").to_pylist()))
    return pa.table({"q": pa.array([key[0].as_py()], pa.int32()), "dict": pa.array([_dictionary([t for _, t in rows])], pa.binary())})


def _measurer(bad: bytes, good: bytes):
    """(q, t) in; (q, length, size with the bad dictionary, size with the good one) out."""

    def measure(batches):
        both = _compressors(good, bad)
        for batch in batches:
            sizes = np.array([_sizes(t.as_buffer(), both) for t in batch.column(1)], np.int64).reshape(batch.num_rows, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(sizes[:, i]) for i in range(3))], ["q", "n", "bad", "good"])

    return measure


def calibrate(good: bytes, bad: bytes, sizes: np.ndarray, labels: np.ndarray, prior: float) -> Model:
    x = _features(sizes)
    centre, scale = x.mean(0), x.std(0) + 1e-9
    return Model(good, bad, centre.tolist(), scale.tolist(), _logistic((x - centre) / scale, labels.astype(float)).tolist(), prior)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", may_learn: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """Train on at most per_class labelled documents of each class, the first by a hash of their keys."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    if may_learn is not None:
        known = known.where(may_learn)
    order = F.xxhash64(F.col(key).cast("string"), F.lit(7))
    chosen = None
    for q in (0, 1):
        part = known.where(F.col(label) == q).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_q")).orderBy(order, "_k").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * per_class rows: a bounded broadcast.
    texts = docs.select(F.col(key).alias("_k"), F.col(text).cast("binary").alias("_t"))
    once = texts.join(F.broadcast(chosen), "_k").groupBy("_k").agg(F.min("_q").alias("q"), F.min("_t").alias("t"))
    o = F.xxhash64(F.col("_k").cast("string"), F.lit(11))
    sample = keep(once.select("q", F.pmod(o, F.lit(2)).cast("int").alias("half"), o.alias("o"), F.coalesce("t", F.lit(b"")).alias("t")))
    counts = {(r["q"], r["half"]): r["n"] for r in sample.where(F.octet_length("t") > 0).groupBy("q", "half").agg(F.count("*").alias("n")).collect()}
    prior = sample.agg(F.avg("q")).first()[0]
    none = Model(None, None, [], [], [], 1.0 if prior is None else float(prior))
    if min(counts.get((q, half), 0) for q in (0, 1) for half in (0, 1)) < 4:
        return none
    dicts = {r["q"]: bytes(r["dict"]) for r in sample.where("half = 0").groupBy("q").applyInArrow(_train_class, "q int, dict binary").collect()}
    measured = sample.where("half = 1").select("q", "t").mapInArrow(_measurer(dicts[0], dicts[1]), "q int, n bigint, bad bigint, good bigint").orderBy("q", "n", "bad", "good").toPandas()
    return calibrate(dicts[1], dicts[0], measured[["n", "bad", "good"]].to_numpy(), measured["q"].to_numpy(), none.prior)


def _scorer(model: Model, at: int, schema_names: list[str]):
    def score(batches):
        both = _compressors(model.good, model.bad) if model.good is not None else None
        for batch in batches:
            n = batch.num_rows
            if both is None:
                scores = np.full(n, model.prior)
            else:
                raw, offs = text_buffers(batch.column(at))
                view = memoryview(np.ascontiguousarray(raw))
                sizes = np.array([_sizes(view[a:b], both) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], np.int64).reshape(n, 3)
                x = (_features(sizes) - np.array(model.centre)) / np.array(model.scale)
                w = np.array(model.weights)
                scores = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            kept = [batch.column(i) for i in range(batch.num_columns) if schema_names[i] is not None]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores)], [*(c for c in schema_names if c is not None), "score"])

    return score


def score_quality(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs' columns (or those of carry) with score (0 to 1) and predicted (1 if score >= threshold)."""
    names = [c for c in (docs.columns if carry is None else carry) if c not in ("score", "predicted")]
    # The text is read once more under a name of its own; it is not sent back unless it is carried. Columns go by their places.
    own = docs.select(*(F.col(quoted(c)).alias(f"_c{i}") for i, c in enumerate(names)), F.col(text).alias("_scored"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in own.drop("_scored").schema), "score double"])
    scored = own.mapInArrow(_scorer(model, len(names), [*own.columns[:-1], None]), schema).toDF(*names, "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(key: str, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves the given remainder (a null key: no)."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))
