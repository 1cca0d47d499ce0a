"""Approximate nearest neighbours by inner product: an HNSW graph per shard, shard results merged.

Rows are dealt to shards of a bounded size by a hash of their id. A shard's graph is built
by insertion: levels are drawn from the geometric law, points come in order of level and
else at random, and each batch of points searches the graph made so far, level by level, with
a beam of CONSTRUCTION, to find its neighbours; points of one batch see each other too. Of
the candidates, neighbours are chosen by the diversity rule (a candidate nearer to a chosen
neighbour than to the point is passed over), and link back; lists that outgrow their room are
pruned by the same rule. A level starts from the graph of the level above, whose points are
the first in order. So the work grows as n log n, and nothing compares all pairs of a shard.
Neighbours are stored as flat int32 arrays, one row of fixed width per point and level.

Inner product becomes distance by one more coordinate, sqrt(max |x|**2 - |x|**2), so that
the graph is metric; queries get 0 there. Search descends greedily, then keeps a beam;
all queries of a block move at once.

Points with equal vectors are one node with a list of ids, of which each query gets as many
of the least as it needs, so ties cost no recall. Scores are inner products of the original
vectors in double precision.

The index table has one row per shard and is checkpointed. Queries are packed in blocks and
travel to the shards; a shard's index is sent once for GROUP blocks, so of both sides the
queries move most: queries times shards, as the task states it. Each task holds one shard
and one group of blocks.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no
part; so do null ids and vectors of another length than most; fewer candidates than asked
are all returned; ties go to the smaller id; repeated rows (equal id and vector) count once;
of rows with one id and several vectors each is a candidate, the id is returned once with
its best score, and the least vector is the query; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.store import keep

K, M, EF, SHARD_ROWS, QUERY_BLOCK, GROUP, SEED = 20, 16, 192, 16_384, 1_024, 16, 5
#: Beam, points inserted at once, and points that start a graph.
CONSTRUCTION, BATCH, FIRST = 64, 512, 64

INDEX = "shard int, dim int, single boolean, ids binary, counts binary, vectors binary, levels binary, links binary"


def _diverse(sim: np.ndarray, among: np.ndarray, most: int) -> np.ndarray:
    """Mask of the chosen of each row's candidates, which are sorted from near to far; -inf marks none.

    sim: similarity to the row's point; among: similarities of the candidates. First those that
    are nearer to the point than to any chosen one, then the nearest of the others.
    """
    rows, width = sim.shape
    chosen, count = np.zeros((rows, width), bool), np.zeros(rows, np.int64)
    nearest = np.full((rows, width), -np.inf, np.float32)  # similarity to the nearest chosen one
    for c in range(width):
        take = (count < most) & np.isfinite(sim[:, c]) & (nearest[:, c] < sim[:, c])
        chosen[:, c] = take
        count += take
        np.maximum(nearest, among[:, c], out=nearest, where=take[:, None])
    spare = ~chosen & np.isfinite(sim)
    chosen |= spare & (np.cumsum(spare, 1) <= (most - count)[:, None])
    return chosen


def _pruned(x: np.ndarray, points: np.ndarray, lists: np.ndarray, most: int) -> np.ndarray:
    """The lists (-1 for none) cut to the most neighbours of each point by the diversity rule, same width."""
    out = np.full_like(lists, -1)
    for at in range(0, len(points), 256):
        part = slice(at, at + 256)
        cand = lists[part]
        v = x[np.maximum(cand, 0)]
        sim = np.einsum("rcd,rd->rc", v, x[points[part]])
        sim[cand < 0] = -np.inf
        by = np.argsort(-sim, axis=1, kind="stable")
        cand, sim, v = np.take_along_axis(cand, by, 1), np.take_along_axis(sim, by, 1), np.take_along_axis(v, by[:, :, None], 1)
        chosen = _diverse(sim, v @ v.transpose(0, 2, 1), most)
        first = np.argsort(~chosen, axis=1, kind="stable")[:, :most]
        out[part, :most] = np.where(np.take_along_axis(chosen, first, 1), np.take_along_axis(cand, first, 1), -1)
    return out


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray, lists: np.ndarray, width: int) -> None:
    """Add the points new to the lists of their neighbours; lists without room are pruned to width."""
    source, target = np.repeat(new, lists.shape[1]), lists.ravel()
    source, target = source[target >= 0], target[target >= 0]
    by = np.argsort(target, kind="stable")
    source, target = source[by], target[by]
    while len(target):
        used = (links[target] >= 0).sum(1)
        start = np.concatenate([[True], target[1:] != target[:-1]])
        rank = np.arange(len(target)) - np.maximum.accumulate(np.where(start, np.arange(len(target)), 0))
        fits = used + rank < links.shape[1]
        links[target[fits], (used + rank)[fits]] = source[fits]
        source, target = source[~fits], target[~fits]
        full = np.unique(target)
        links[full] = _pruned(x, full, links[full], width)


def build_graph(vectors: np.ndarray, m: int = M, seed: int = SEED, construction: int = CONSTRUCTION):
    """(order of insertion, levels of the points in that order, one flat neighbour array per level)."""
    n, width = len(vectors), 2 * m
    rng = np.random.default_rng([seed, n])
    order = rng.permutation(n)
    levels = np.minimum((-np.log(np.maximum(rng.random(n), 1e-12)) / np.log(m)).astype(np.int64), 12)
    by = np.argsort(-levels, kind="stable")
    order, levels = order[by], levels[by]
    x = vectors[order].astype(np.float32)
    norm = (x.astype(np.float64) ** 2).sum(1)
    x = np.concatenate([x, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None].astype(np.float32)], 1)
    # Lists have room for m more than they are pruned to, so that pruning is rare.
    links = np.full((n, width + m), -1, np.int32)
    layers: list = []  # from the top level down
    done = 0
    for level in range(int(levels.max()), -1, -1):
        members = int((levels >= level).sum())
        while done < members:
            end = min(members, done + (BATCH if done >= FIRST else FIRST - done))
            batch = np.arange(done, end)
            own = x[batch] @ x[batch].T
            own[np.arange(len(batch))[:, None] <= np.arange(len(batch))[None, :]] = -np.inf
            ids, sim = np.broadcast_to(batch, own.shape), own
            if done:
                above = [(np.arange(len(g), dtype=np.int32), g) for g in reversed(layers)]
                got, score = search_graph(x[:done], [(np.arange(done, dtype=np.int32), links[:done]), *above], x[batch], construction)
                ids, sim = np.concatenate([ids, got], 1), np.concatenate([sim, score], 1)
            top = np.argsort(-sim, axis=1, kind="stable")[:, :construction]
            ids, sim = np.take_along_axis(ids, top, 1), np.take_along_axis(sim, top, 1)
            v = x[np.maximum(ids, 0)]
            chosen = _diverse(sim, v @ v.transpose(0, 2, 1), m)
            first = np.argsort(~chosen, axis=1, kind="stable")[:, :m]
            lists = np.where(np.take_along_axis(chosen, first, 1), np.take_along_axis(ids, first, 1), -1).astype(np.int32)
            links[batch, : lists.shape[1]] = lists
            _link_back(x, links, batch, lists, width)
            done = end
        over = np.flatnonzero((links[:done, width:] >= 0).any(1))
        cut = links[:done].copy()
        cut[over] = _pruned(x, over, cut[over], width)
        layers.append(cut[:, :width])
    return order, levels, [(np.arange(len(g), dtype=np.int32), g) for g in reversed(layers)]


def search_graph(x: np.ndarray, layers, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(points, scores) of the ef best found for each query, best first; -1 fills up. x: vectors in insertion order."""
    q, n = len(queries), len(x)
    members, _ = layers[-1]
    now = np.full(q, members[0], np.int64)
    best = np.einsum("qd,qd->q", queries, x[now])
    for members, links in reversed(layers[1:]):
        place = np.full(n, -1, np.int64)
        place[members] = np.arange(len(members))
        moving = np.arange(q)
        while len(moving):
            near = links[place[now[moving]]]
            score = np.einsum("qwd,qd->qw", x[np.maximum(near, 0)], queries[moving])
            score[near < 0] = -np.inf
            top = score.argmax(1)
            got = score[np.arange(len(moving)), top]
            up = got > best[moving]
            moved = moving[up]
            now[moved], best[moved] = near[up, top[up]], got[up]
            moving = moved
    links = layers[0][1]
    width = links.shape[1]
    ef = min(ef, n)
    ids = np.full((q, ef), -1, np.int64)
    scores = np.full((q, ef), -np.inf, np.float32)
    fresh = np.zeros((q, ef), bool)
    seen = np.zeros((q, n), bool)
    ids[:, 0], scores[:, 0], fresh[:, 0] = now, best, True
    seen[np.arange(q), now] = True
    active = np.arange(q)
    while len(active):
        # Two unexpanded points of each beam, the best ones.
        for_ = np.where(fresh[active], scores[active], -np.inf)
        pick = np.argpartition(-for_, 1, axis=1)[:, :2] if ef > 2 else np.zeros((len(active), 1), np.int64)
        open_ = np.take_along_axis(for_, pick, 1) > -np.inf
        alive = open_.any(1)
        active, pick, open_ = active[alive], pick[alive], open_[alive]
        if not len(active):
            break
        every = np.arange(len(active))
        fresh[active[:, None], pick] &= ~open_
        near, new = [], []
        for e in range(pick.shape[1]):  # one list after the other, so that no point of both counts twice
            points = ids[active, pick[:, e]]
            got = links[np.where(open_[:, e], points, 0)]
            fine = (got >= 0) & open_[:, e, None]
            fine &= ~seen[active[:, None], np.maximum(got, 0)]
            r, c = np.nonzero(fine)
            seen[active[r], got[r, c]] = True
            near.append(got)
            new.append(fine)
        near, new = np.concatenate(near, 1), np.concatenate(new, 1)
        # New points of each row side by side: rows hold few.
        r, c = np.nonzero(new)
        place = np.cumsum(new, 1)[r, c] - 1
        width = int(place.max()) + 1 if len(place) else 0
        if not width:
            continue
        found, score, isnew = np.full((len(every), width), -1, np.int64), np.full((len(every), width), -np.inf, np.float32), np.zeros((len(every), width), bool)
        found[r, place] = near[r, c]
        score[r, place] = np.einsum("nd,nd->n", x[near[r, c]], queries[active[r]])
        isnew[r, place] = True
        all_scores = np.concatenate([scores[active], score], 1)
        top = np.argpartition(-all_scores, ef - 1, axis=1)[:, :ef]
        row = every[:, None]
        ids[active] = np.concatenate([ids[active], found], 1)[row, top]
        scores[active] = all_scores[row, top]
        fresh[active] = np.concatenate([fresh[active], isnew], 1)[row, top] & (scores[active] > -np.inf)
    order = np.argsort(-scores, axis=1, kind="stable")
    scores = np.take_along_axis(scores, order, 1)
    return np.where(scores > -np.inf, np.take_along_axis(ids, order, 1), -1), scores


def clean(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return rows.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(
        F.coalesce(fine, F.lit(False))
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def _indexer(m: int, most: int):
    """A shard's rows (shard, id, v), whole and in order, in; its index row out."""

    def index(key, table):
        ids = table.column("id").to_numpy()
        v = _matrix(table.column("v"))
        # Equal vectors are one node, with their ids in order.
        v = v + 0.0  # -0.0 is 0.0
        rows = np.ascontiguousarray(v).view([("", v.dtype)] * v.shape[1]).ravel()
        _, first, node = np.unique(rows, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([node, ids], 1), axis=0)
        at = np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]])
        rank = np.arange(len(pairs)) - np.maximum.accumulate(np.where(at, np.arange(len(pairs)), 0))
        pairs = pairs[rank <= most]  # the least ids of a node; one more than is asked, for the query's own
        order, levels, layers = build_graph(v[first], m)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs[:, 0] = place[pairs[:, 0]]
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        counts = np.bincount(pairs[:, 0], minlength=len(order)).astype(np.int32)
        links = b"".join(np.int32(len(a)).tobytes() + a.tobytes() + np.ascontiguousarray(b).tobytes() for a, b in layers)
        single = bool((v.astype(np.float32) == v).all())  # then half the bytes say the same
        return pa.table(
            {
                "shard": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([v.shape[1]], pa.int32()), "single": pa.array([single], pa.bool_()),
                **{k: pa.array([data], pa.binary()) for k, data in (
                    ("ids", pairs[:, 1].astype(np.int64).tobytes()), ("counts", counts.tobytes()),
                    ("vectors", v[first][order].astype(np.float32 if single else np.float64).tobytes()), ("levels", levels.astype(np.int8).tobytes()), ("links", links))},
            }
        )

    return index


def _unpack(row: dict, m: int):
    v = np.frombuffer(row["vectors"], np.float32 if row["single"] else np.float64).reshape(-1, row["dim"])
    data, at, layers = row["links"], 0, []
    while at < len(data):
        n = int(np.frombuffer(data, np.int32, 1, at)[0])
        members = np.frombuffer(data, np.int32, n, at + 4)
        links = np.frombuffer(data, np.int32, n * 2 * m, at + 4 + 4 * n).reshape(n, 2 * m)
        layers.append((members, links))
        at += 4 + 4 * n + 8 * n * m
    counts = np.frombuffer(row["counts"], np.int32)
    return v, layers, np.frombuffer(row["ids"], np.int64), np.concatenate([[0], np.cumsum(counts)])


def _nearest(nodes: np.ndarray, score: np.ndarray, own: int, ids: np.ndarray, bounds: np.ndarray, k: int):
    """(ids, scores) of the k nearest other ids among found nodes: each id once, ties to the smaller."""
    every = np.concatenate([ids[bounds[c] : bounds[c + 1]] for c in nodes.tolist()]) if len(nodes) else np.zeros(0, np.int64)
    score = np.repeat(score, bounds[nodes + 1] - bounds[nodes])
    by = np.lexsort((every, -score))
    every, score = every[by], score[by]
    first = np.sort(np.unique(every, return_index=True)[1])
    first = first[every[first] != own][:k]
    return every[first], score[first]


def _searcher(k: int, m: int, ef: int):
    """One shard's index row and a group of query blocks in; the k nearest of each query out."""

    def search(index, blocks):
        out = [np.zeros((0, 3))]
        if index.num_rows:
            v, layers, ids, bounds = _unpack(index.to_pylist()[0], m)
            x, exact = v.astype(np.float32), v.astype(np.float64)
            for row in blocks.to_pylist():
                qid = np.frombuffer(row["qids"], np.int64)
                q = np.frombuffer(row["qs"], np.float64).reshape(len(qid), -1)
                for at in range(0, len(qid), 256):
                    part = slice(at, at + 256)
                    got, _ = search_graph(x, layers, q[part].astype(np.float32), ef)
                    score = np.einsum("qkd,qd->qk", exact[np.maximum(got, 0)], q[part])
                    for i in range(len(got)):
                        good = got[i] >= 0
                        near, s = _nearest(got[i][good], score[i][good], int(qid[at + i]), ids, bounds, k)
                        out.append(np.stack([np.full(len(near), qid[at + i]).view(np.float64), near.view(np.float64), s], 1))
        rows = np.concatenate(out)
        return pa.table({"query_id": rows[:, 0].copy().view(np.int64), "vec_id": rows[:, 1].copy().view(np.int64), "score": rows[:, 2].copy()})

    return search


def build_index(rows: DataFrame, k: int = K, m: int = M, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The checkpointed index table of clean rows (id, v): one row per shard, flat arrays in binary columns."""
    rows = keep(rows)
    shards = max(1, -(-rows.count() // shard_rows))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dealt = rows.where(F.size("v") == (dims[0] if dims else 0)).withColumn("shard", F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(shards)).cast("int"))
    # More partitions than shards, so that few share one.
    return keep(dealt.repartition(8 * shards, "shard").groupBy("shard").applyInArrow(_indexer(m, k), INDEX))


def search(index: DataFrame, queries: DataFrame, k: int = K, m: int = M, ef: int = EF, block: int = QUERY_BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best found for each clean query (id, v), other than itself."""
    one = index.agg(F.max("dim"), F.max("shard")).first()
    if one[0] is None:
        return queries.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, shards = one[0], one[1] + 1
    queries = keep(queries.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")))
    blocks = max(1, -(-queries.count() // block))
    packed = queries.withColumn("b", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(blocks)).cast("int")).groupBy("b").applyInArrow(
        _pack, "b int, qids binary, qs binary"
    )
    groups = -(-blocks // group)
    met = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.floor(F.col("b") / group).cast("int").alias("g"), "qids", "qs")
    sent = index.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "*")
    found = sent.groupBy("shard", "g").cogroup(met.groupBy("shard", "g")).applyInArrow(_searcher(k, m, ef), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _pack(key, table):
    ids = table.column("id").to_numpy()
    return pa.table({"b": pa.array([key[0].as_py()], pa.int32()), "qids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "qs": pa.array([_matrix(table.column("v")).tobytes()], pa.binary())})
