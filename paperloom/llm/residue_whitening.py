"""Embedding whitening by an exact scatter matrix in residue numbers.

Entries become integers, x = floor(SCALE * c). The model is fitted on each distinct vector
once: n vectors with sums S. The scatter matrix of n * x - S, which is n**3 times the
covariance, is exact: every task reduces its vectors modulo several primes, multiplies the
centred residues in blocks (a floating product of residues below 2**20 over BLOCK rows
stays below 2**53, so it is exact too) and adds the products modulo each prime; the sums of
the tasks meet by matrix row, where Chinese remaindering gives back the integers, and each
is divided by n**3, rounded once. The primes are the largest below 2**20, as many as the
entries' bound asks for. A double symmetric eigenvalue decomposition of the result follows.

Spark keeps the distinct vectors as a table in the shared folder, reads them three times
(sums and bounds; scatter; the whitened covariance, which is measured on what comes out)
and the rows once more for the result. The driver and each task hold matrices of dim * dim.

Defined cases: rows whose vector is null, or holds null or non-finite entries, are dropped;
the dimension is the most frequent length among the distinct vectors (the greater of equally
frequent ones) and vectors of other lengths are dropped too. Entries beyond the range of a
long stop at its ends. Rows with a null or repeated id stay. A component without variance
(eigenvalue at most dim * 2**-52 of the greatest) has null whitened values and is no part of
identity_error; without any, identity_error and explained are null. A component's sign makes
its largest entry positive. deviation is a decimal(38,0), null beyond that. An empty table
gives an empty result; extra columns pass through `carry`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.store import scratch
from paperloom.session import drop_path

SCALE, COMPONENTS = 256, 4
#: Rows of one floating product of residues: (2**19)**2 * BLOCK < 2**53.
BLOCK = 8_192
LIMIT = 1 << 20
LIMB = 1 << 62


@dataclass
class Model:
    """A fitted whitening: x -> (x - S / n) @ axes / sqrt(values)."""

    dim: int
    n: int
    sums: list[int]
    bound: int  # greatest |n * x - S|
    reach: int  # greatest of bound, |n * x| and |S|
    axes: np.ndarray  # dim x components
    values: np.ndarray
    trace: float
    live: np.ndarray  # components with variance
    identity_error: float | None = None


def primes(beyond: int) -> list[int]:
    """The largest primes below LIMIT whose product exceeds beyond."""
    sieve = np.ones(LIMIT, bool)
    sieve[:2] = False
    for i in range(2, int(LIMIT**0.5) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    falling = np.nonzero(sieve)[0][::-1]
    k = 1
    while prod(int(p) for p in falling[:k]) <= beyond:
        k += 1
    return [int(p) for p in falling[:k]]


def integers(rows: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """rows that take part, with _x array<bigint> for the vector."""
    v = F.col("`" + vector.replace("`", "``") + "`").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.coalesce(fine, F.lit(False))).withColumn("_x", F.transform(v, lambda c: F.floor(c * F.lit(float(scale)))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums_mapper(batches):
    """(dim, j, n, s, low, high) of a task's vectors, for every length that it has."""
    found = {}
    for batch in batches:
        column = batch.column(0)
        lengths = np.diff(column.offsets.to_numpy())
        for dim in np.unique(lengths):
            x = _matrix(column.filter(pa.array(lengths == dim)), int(dim)) if dim else np.zeros((int((lengths == 0).sum()), 0), np.int64)
            # Sums of 32-bit halves are exact in 64 bits.
            part = [len(x), [int(a) * (1 << 32) + int(b) for a, b in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))], x.min(0), x.max(0)]
            if dim in found:
                n, s, low, high = found[dim]
                part = [n + part[0], [a + b for a, b in zip(s, part[1])], np.minimum(low, part[2]), np.maximum(high, part[3])]
            found[dim] = part
    rows = [(int(dim), j, n, Decimal(s[j]), int(low[j]), int(high[j])) for dim, (n, s, low, high) in found.items() for j in range(dim)]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["dim", "j", "n", "s", "low", "high"])


def _scatter_mapper(dim: int, n: int, sums: list[int], moduli: list[int]):
    """A task's sums of products of centred residues: a row of each prime's matrix in a row."""

    def mapper(batches):
        total = np.zeros((len(moduli), dim, dim), np.int64)
        for batch in batches:
            whole = _matrix(batch.column(0), dim)
            for at in range(0, len(whole), BLOCK):
                x = whole[at : at + BLOCK]
                for k, p in enumerate(moduli):
                    r = (np.mod(x, p) * (n % p) - np.array([s % p for s in sums])) % p
                    r = np.where(r > p // 2, r - p, r).astype(np.float64)
                    total[k] = (total[k] + (r.T @ r).astype(np.int64)) % p
        k, i = np.divmod(np.arange(len(moduli) * dim), dim)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, dim), pa.int32()), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(k, pa.int32()), flat], names=["i", "k", "row"])

    return mapper


def _remainders(dim: int, n: int, moduli: list[int]):
    """A row of the covariance from all tasks' residues of that row."""
    whole = prod(moduli)
    weights = [whole // p * pow(whole // p, -1, p) for p in moduli]

    def join(key, table):
        ks, rows = table.column("k").to_numpy(), _matrix(table.column("row").combine_chunks(), dim)
        parts = [rows[ks == k].sum(0) % p for k, p in enumerate(moduli)]
        values = []
        for j in range(dim):
            c = sum(int(parts[k][j]) * w for k, w in enumerate(weights)) % whole
            c = c - whole if c > whole // 2 else c
            values.append(c / n**3)  # one rounding, of integers of any length
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([values], pa.list_(pa.float64()))})

    return join


def covariance(vectors: DataFrame, dim: int, n: int, sums: list[int], bound: int) -> np.ndarray:
    """The covariance (divisor n) of vectors (_x), from the exact scatter matrix."""
    moduli = primes(2 * n * bound * bound)
    parts = vectors.mapInArrow(_scatter_mapper(dim, n, sums, moduli), "i int, k int, row array<bigint>")
    rows = parts.groupBy("i").applyInArrow(_remainders(dim, n, moduli), "i int, v array<double>").collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])])


def _centred(x: np.ndarray, m: Model) -> np.ndarray:
    """x - S / n in double precision."""
    if m.reach < 1 << 62:
        return (x * m.n - np.array(m.sums, np.int64)).astype(np.float64) / m.n
    whole = np.array([s // m.n for s in m.sums], np.int64)
    rest = np.array([(s % m.n) / m.n for s in m.sums])
    apart = x.astype(np.float64) - whole  # where the difference of longs may not fit
    return np.where(np.abs(apart) < 2.0**62, (x - whole).astype(np.float64), apart) - rest


def _whitened(x: np.ndarray, m: Model) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(m.live, _centred(x, m) @ m.axes / np.sqrt(m.values), np.nan)


def _identity_mapper(m: Model):
    """A task's sums of whitened values and of their products."""

    def mapper(batches):
        c = m.axes.shape[1]
        one, two = np.zeros(c), np.zeros((c, c))
        for batch in batches:
            w = _whitened(_matrix(batch.column(0), m.dim), m)
            one, two = one + w.sum(0), two + w.T @ w
        both = np.concatenate([one, two.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both)), pa.int32()), pa.array(both)], names=["at", "s"])

    return mapper


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of the table vectors (_x array<bigint>), each row one vector; None without any entries."""
    reduced = vectors.mapInArrow(_sums_mapper, "dim int, j int, n bigint, s decimal(38,0), low bigint, high bigint")
    reduced = reduced.groupBy("dim", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
    # Only the most frequent length's rows come to the driver, dim of them.
    top = reduced.where("j = 0").orderBy(F.desc("n"), F.desc("dim")).first()
    if top is None:
        return None
    rows = sorted(reduced.where(F.col("dim") == top["dim"]).collect(), key=lambda r: r["j"])
    dim, n, sums = top["dim"], top["n"], [int(r["s"]) for r in rows]
    bound = max(max(abs(n * r["low"] - s), abs(n * r["high"] - s)) for r, s in zip(rows, sums))
    reach = max(bound, n * max(max(abs(r["low"]), abs(r["high"])) for r in rows))  # no |S| exceeds that
    fitting = vectors.where(F.size("_x") == dim)
    v = covariance(fitting, dim, n, sums, bound)
    values, axes = np.linalg.eigh(v)
    top_values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.where(np.take_along_axis(axes, np.argmax(np.abs(axes), 0)[None], 0) < 0, -1.0, 1.0)
    trace = float(np.trace(v))
    live = (top_values > dim * 2.0**-52 * max(float(values[-1]), 0.0)) & (top_values > 0)
    model = Model(dim, n, sums, bound, reach, axes, top_values, trace, live)
    if live.any():
        c = len(top_values)
        sums_ = fitting.mapInArrow(_identity_mapper(model), "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
        both = np.array([r["s"] for r in sorted(sums_, key=lambda r: r["at"])])
        one, two = both[:c] / n, both[c:].reshape(c, c) / n
        model.identity_error = float(np.abs(two - np.outer(one, one) - np.eye(c))[np.ix_(live, live)].max())
    return model


def _apply_mapper(m: Model, at: int):
    """The columns before at as they are, then deviation in two limbs and the whitened values."""

    def mapper(batches):
        short = m.dim * m.bound**2 < 1 << 63 and m.reach < 1 << 62
        for batch in batches:
            x = _matrix(batch.column(at), m.dim)
            w = _whitened(x, m)
            if short:
                y = x * m.n - np.array(m.sums, np.int64)
                d = (y * y).sum(1)
                high, low = d >> 62, d & (LIMB - 1)
            else:
                y = x.astype(object) * m.n - np.array(m.sums, object)
                d = [divmod(int(v), LIMB) for v in (y * y).sum(1)]
                high, low = [h if h < 1 << 63 else None for h, _ in d], [r for _, r in d]
            flat = pa.array(np.where(np.isnan(w), 0.0, w).ravel(), mask=np.isnan(w).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(high, pa.int64()), pa.array(low, pa.int64()), lists], names=[*batch.schema.names[:at], "_high", "_low", "_w"])

    return mapper


def whiten(rows: DataFrame, vector: str = "embedding", carry: list[str] | None = None, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """carry's columns, component, n, deviation, whitened, explained and identity_error: a row for each row that takes part and each component."""
    spark = rows.sparkSession
    carry = [c for c in rows.columns if c != vector] if carry is None else carry
    named = rows.toDF(*[f"_{i}" for i in range(len(rows.columns))])  # any names, clashes of case and dots included
    places = [f"_{rows.columns.index(c)}" for c in carry]
    taking = integers(named, f"_{rows.columns.index(vector)}", scale).select(*places, "_x")
    path = scratch(spark, "whitening")
    taking.select("_x").distinct().write.parquet(path)
    model = fit(spark.read.parquet(path), components)
    drop_path(spark, path)
    kinds = ", ".join(f"{p} {taking.schema[p].dataType.simpleString()}" for p in places)
    if model is None:
        model, taking = Model(1, 1, [0], 0, 0, np.zeros((1, 1)), np.zeros(1), 0.0, np.zeros(1, bool)), taking.where("false")
    done = taking.where(F.size("_x") == model.dim).mapInArrow(_apply_mapper(model, len(places)), kinds + ", " * bool(kinds) + "_high bigint, _low bigint, _w array<double>")
    number = lambda v: F.lit(v).cast("double")
    explained = F.array(*(number(float(e) / model.trace if model.trace > 0 else None) for e in model.values))
    exact = F.try_add(F.try_multiply(F.col("_high").cast("decimal(20,0)"), F.lit(LIMB).cast("decimal(19,0)")), F.col("_low").cast("decimal(20,0)")).cast("decimal(38,0)")
    out = done.select(*places, exact.alias("_d"), F.posexplode("_w").alias("_c", "_v"))
    return out.select(
        *(F.col(p).alias(c) for p, c in zip(places, carry)), (F.col("_c") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), F.col("_d").alias("deviation"),
        F.col("_v").alias("whitened"), F.get(explained, F.col("_c")).alias("explained"), number(model.identity_error).alias("identity_error"),
    )
