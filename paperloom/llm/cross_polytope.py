"""Near-duplicate vectors by cross-polytope hashing.

A hash turns a unit vector by three rounds of random signs and a fast Hadamard transform
(the vector padded with zeros to a power of two) and takes the nearest vertex of the
cross-polytope: the coordinate of greatest absolute value, with its sign. A table joins
HASHES such hashes to a bucket; multiprobe adds, for each vector, the buckets that the next
best vertices give, nearest first, PROBES in all. Vectors that share one bucket of a table
are compared by cosine in double precision.

HASHES grows with the logarithm of the rows of the largest label, so that buckets of
unrelated vectors stay small. TABLES follows from it: pairs are drawn at the threshold's
angle, hashed, and as many tables are taken as let a pair miss all of them with a
probability under MISSED. Pairs nearer than the threshold are missed less often.

On Spark: equal vectors of one label are one node from the start, with a weight. Nodes send
their bucket keys alone; only those of buckets with two nodes or more go on, and fetch the
vectors. A bucket of more than BLOCK nodes is cut into blocks that meet two and two. A pair
that meets in several buckets counts in the first alone, which both vectors' keys tell; so
no pair leaves a task: what does are each node's number of links (weights of the others) in
a block and the least node of its part of the block, from which components follow. A
family of many different vectors, all near each other, costs its pairs' products within
tasks, as its number of links asks for; it is spread over blocks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing, nor do rows with a null label or a null id (whose component is null), nor
vectors of different lengths; rows of one id are told apart by their vectors; a repeated
row links with its copies; 0.0 and -0.0 are equal; an empty table gives an empty result;
extra columns pass through near_duplicates, whatever their names.
"""

from __future__ import annotations

from math import ceil, log, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.store import keep
from paperloom.operators.graph import components

THRESHOLD, MISSED = 0.98, 1e-6
PROBES = 4
#: In fewer dimensions signs and Hadamard transforms give few different rotations.
LEAST_DIM = 32
#: Nodes of a bucket that one task compares among themselves or with another block.
BLOCK = 1_024
#: Pairs drawn to learn how often one table misses.
DRAWN = 2_000
KEY = ["label", "dim", "t", "code"]
#: The side of a block that meets itself; else sides are 0 and 1.
ALONE = 2


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of x's rows, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def padded(dim: int) -> int:
    return max(LEAST_DIM, 1 << (dim - 1).bit_length())


def turned(x: np.ndarray, table: int, hash_: int) -> np.ndarray:
    """x's rows (padded) after one pseudo-random rotation."""
    r = np.random.default_rng((x.shape[1], table, hash_))
    for _ in range(3):
        x = hadamard(x * r.choice([-1.0, 1.0], x.shape[1]))
    return x


def buckets(x: np.ndarray, table: int, hashes: int) -> np.ndarray:
    """PROBES bucket numbers of each of x's rows (padded, of length 1) in one table, nearest first."""
    d, each = x.shape[1], min(PROBES, x.shape[1])
    vertices, loss = [], []
    for k in range(hashes):
        z = turned(x, table, k)
        best = np.argsort(-np.abs(z), axis=1, kind="stable")[:, :each]
        at = np.take_along_axis(z, best, 1)
        vertices.append(best * 2 + (at > 0))
        loss.append((np.abs(at[:, :1]) - np.abs(at)) ** 2)
    choices = _choices(hashes, each)
    costs = np.stack([sum(loss[k][:, c[k]] for k in range(hashes)) for c in choices], 1)
    codes = np.stack([sum(vertices[k][:, c[k]].astype(np.int64) * (2 * d) ** k for k in range(hashes)) for c in choices], 1)
    return np.take_along_axis(codes, np.argsort(costs, axis=1, kind="stable")[:, :PROBES], 1)


def _choices(hashes: int, each: int) -> list[tuple[int, ...]]:
    """Which vertex, by nearness, each hash may take: those that can be among the PROBES nearest.

    The product of (place + 1) counts the choices that are nowhere further, itself included.
    """
    out = [()]
    for _ in range(hashes):
        out = [(*c, i) for c in out for i in range(each) if prod(k + 1 for k in c) * (i + 1) <= PROBES]
    return sorted(out, key=lambda c: (sum(c), c))


def plan(rows: int, dim: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(hashes, tables) for so many rows of a label."""
    d = padded(dim)
    r = np.random.default_rng(dim)
    a, g = r.normal(size=(2, DRAWN, max(dim, 2)))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    g -= (g * a).sum(1, keepdims=True) * a
    b = threshold * a + (1 - threshold**2) ** 0.5 * g / np.linalg.norm(g, axis=1, keepdims=True)
    a, b = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, b))
    hashes = min(int(60 / log(2 * d, 2)), max(1, ceil(log(max(rows, 1) * PROBES * 4) / log(2 * d))))
    while True:
        met = np.mean([(buckets(a, t, hashes)[:, :, None] == buckets(b, t, hashes)[:, None, :]).any((1, 2)).mean() for t in (1_000_001, 1_000_002)])
        if met > 0.1 or hashes == 1:  # below, more tables cost more than larger buckets do
            met = min(max(met, 1e-3), 1 - 1e-9)
            return hashes, max(2, ceil(log(MISSED) / log(1 - met)))
        hashes -= 1


def nodes(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, v) of the rows that take part; v in its own type, without -0.0."""
    v = F.col(vector)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    taking = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(fine, F.lit(False)))
    return taking.select(F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"), F.transform(v, lambda c: c + F.lit(0).cast("tinyint")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x's rows scaled so that no square over- or underflows, and their lengths."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x, np.sqrt(np.einsum("ij,ij->i", x, x))


def _hasher(hashes: int, tables: int):
    """A node's bucket numbers, PROBES of each table in turn."""

    def mapper(batches):
        for batch in batches:
            column, lengths = batch.column("v"), batch.column("dim").to_numpy()
            out = np.zeros((len(batch), tables * PROBES), np.int64)
            for dim in np.unique(lengths):
                x, norm = _scaled(_matrix(column.filter(pa.array(lengths == dim)), int(dim)))
                x = np.pad(x / norm[:, None], ((0, 0), (0, padded(int(dim)) - int(dim))))
                each = [buckets(x, t, hashes) for t in range(tables)]
                each = [np.pad(c, ((0, 0), (0, PROBES - c.shape[1])), mode="edge") for c in each]
                out[lengths == dim] = np.concatenate(each, 1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=[*batch.schema.names, "codes"])

    return mapper


def _first_meeting(a: np.ndarray, b: np.ndarray, t: int, code: int) -> np.ndarray:
    """Whether pairs of rows of bucket numbers (tables x PROBES) meet first in table t, at code."""
    earlier = np.zeros(len(a), bool)
    for s in range(t):
        earlier |= (a[:, s, :, None] == b[:, s, None, :]).any((1, 2))
    same = (a[:, t, :, None] == b[:, t, None, :]).any(2)
    least = np.where(same, a[:, t], np.iinfo(np.int64).max).min(1)
    return ~earlier & (least == code)


def _group(x, norm, weight, codes, side, t, code, threshold):
    """(links, root) of a part's nodes: weights of linked partners that meet first here, and the least row they are linked to."""
    n = len(x)
    links, root = np.zeros(n, np.int64), np.arange(n)
    across = side[0] != ALONE
    left, others = (np.nonzero(side == s)[0] for s in ((0, 1) if across else (ALONE, ALONE)))
    unit = x / norm[:, None]
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        i, j = np.nonzero(unit[rows] @ unit[others].T >= threshold - 1e-9)
        i, j = rows[i], others[j]
        if not across:
            i, j = i[i < j], j[i < j]
        near = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= threshold
        i, j = i[near], j[near]
        first = np.concatenate([_first_meeting(codes[i[p : p + 65_536]], codes[j[p : p + 65_536]], t, code) for p in range(0, len(i), 65_536)] or [np.zeros(0, bool)])
        np.add.at(links, i[first], weight[j[first]])
        np.add.at(links, j[first], weight[i[first]])
        root = _joined(root, i, j)
    return links, root


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root after the pairs (i, j) are joined: the least row of each component."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        i, j = i[apart], j[apart]


def _comparer(threshold: float):
    """Parts in a row of (part's key, id, h, w, side, v, codes) in; (id, h, links, root_id, root_h) of nodes with a link out."""
    names = [*KEY, "part"]

    def solve(table):
        dim, t, code = (table.column(c)[0].as_py() for c in ("dim", "t", "code"))
        x, norm = _scaled(_matrix(table.column("v").combine_chunks(), dim))
        codes = table.column("codes").combine_chunks().flatten().to_numpy().reshape(len(x), -1, PROBES)
        side = table.column("side").to_numpy()
        links, root = _group(x, norm, table.column("w").to_numpy(), codes, side, t, code, threshold)
        ids, hs = table.column("id").to_numpy(), table.column("h").to_numpy()
        some = (links > 0) | (root != np.arange(len(root)))
        return [c[some] for c in (ids, hs, links, ids[root], hs[root])]

    def mapper(batches):
        held, held_key = [], None
        for batch in batches:
            if not len(batch):
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in names)))
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
            done = []
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                if keys[a] != held_key:
                    if len(held) and sum(map(len, held)) > 1:
                        done.append(solve(pa.Table.from_batches(held)))
                    held, held_key = [], keys[a]
                held.append(batch.slice(a, b - a))
            if done:
                yield _links(done)
        if held and sum(map(len, held)) > 1:
            yield _links([solve(pa.Table.from_batches(held))])

    return mapper


def _links(parts):
    columns = [np.concatenate(c) for c in zip(*parts)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "h", "links", "root_id", "root_h"])


def _parts(shared: DataFrame) -> DataFrame:
    """shared (bucket's key, m, id, h) with part and side: blocks of a bucket meet two and two, and each itself."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id", "h", F.lit(7)), blocks).cast("int")

    def meeting(j: Column) -> Column:
        low, high = F.least(j, F.col("_own")), F.greatest(j, F.col("_own"))
        return F.struct((low.cast("bigint") * F.col("_n") + high).alias("part"), F.when(j == F.col("_own"), ALONE).otherwise((j < F.col("_own")).cast("int")).alias("side"))

    met = shared.withColumn("_n", blocks).withColumn("_own", own)
    return met.select(*KEY, "id", "h", F.explode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), meeting)).alias("_p")).select(*KEY, "id", "h", "_p.part", "_p.side")


def links(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(label, v, id, h, w, n_links, component): the distinct vectors that take part, as nodes.

    id is the least of a vector's rows, w their number, n_links the rows linked with each
    of them, other copies included; component is null where no other vector is linked.
    """
    distinct = nodes(rows, key, vector, label).groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("w"))
    distinct = keep(distinct.select("id", F.xxhash64("label", "v").alias("h"), "label", F.size("v").alias("dim"), "w", "v"))
    most = distinct.groupBy("label", "dim").count().agg(F.max("count").alias("n"), F.max("dim").alias("dim")).first()
    hashes, tables = plan(most["n"], most["dim"], threshold) if most["n"] else (1, 2)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema)
    hashed = keep(distinct.mapInArrow(_hasher(hashes, tables), f"{kinds}, codes array<bigint>"))
    keys = hashed.select("label", "dim", "id", "h", F.posexplode("codes").alias("_at", "code")).select("label", "dim", F.floor(F.col("_at") / PROBES).cast("int").alias("t"), "code", "id", "h")
    keys = keys.distinct() if hashes == 1 else keys  # only then a node may lack PROBES different vertices
    shared = keys.join(keys.groupBy(*KEY).agg(F.count("*").alias("m")).where("m > 1"), KEY)
    met = _parts(shared).join(hashed.select("id", "h", "w", "v", "codes"), ["id", "h"])
    order = [*KEY, "part"]
    dealt = met.select(*order, "id", "h", "w", "side", "v", "codes").repartition(*order).sortWithinPartitions(*order, "id", "h")
    found = keep(dealt.mapInArrow(_comparer(threshold), "id bigint, h bigint, links bigint, root_id bigint, root_h bigint"))
    counts = found.groupBy("id", "h").agg(F.sum("links").alias("links"))
    edges = found.select(F.struct("id", "h").alias("a"), F.struct(F.col("root_id").alias("id"), F.col("root_h").alias("h")).alias("b"))
    classes = components(edges).select(F.col("node.id").alias("id"), F.col("node.h").alias("h"), F.col("component.id").alias("component"))
    out = hashed.join(counts, ["id", "h"], "left").join(classes, ["id", "h"], "left")
    return out.select("label", "v", "id", "h", "w", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")


def linked_rows(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """rows (with plain column names) and n_links, component_id and kept."""
    met = links(rows, key, vector, label, threshold).withColumnRenamed("label", "_label").withColumnRenamed("h", "_h").select("_label", "v", F.col("id").alias("_least"), "_h", "n_links", "component")
    same = F.transform(F.col(vector), lambda c: c + F.lit(0).cast("tinyint"))
    hashed = rows.withColumn("_v", same).withColumn("_hash", F.when(F.col(key).isNotNull() & F.col(label).isNotNull(), F.xxhash64(label, "_v")))
    # A hot vector's rows meet one row here, which an adaptive join splits.
    out = hashed.join(met, (F.col("_hash") == F.col("_h")) & (F.col(label) == F.col("_label")) & (F.col("_v") == F.col("v")), "left")
    component = F.when(F.col(key).isNotNull(), F.coalesce("component", "_least", F.col(key).cast("bigint")))
    return out.select(*rows.columns, F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(key).cast("bigint") == F.col("component_id"), F.lit(False)))


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """rows without those that are linked to one of a smaller id, directly or over others; rows with a null id stay."""
    named = rows.toDF(*[f"_{i}" for i in range(len(rows.columns))])
    k, v, g = (f"_{rows.columns.index(c)}" for c in (key, vector, label))
    found = linked_rows(named, k, v, g, threshold)
    return found.where(F.col("kept") | F.col(k).isNull()).select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(rows.columns)))
