"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a 64-bit ring. A row's key hashes to a place on the ring
and belongs to the next point clockwise. No shard takes more than its bound: what
overflows a full shard continues clockwise to the next point whose shard has room. With
the tightest bounds (quotas that differ by one row at most) balance is exact, and only
rows of overfull arcs leave their home shard.

All is DataFrame functions. The ring is cut into a fixed number of cells, so the only
thing the driver sees is one count per cell (bounded by shards * vnodes * cells_per_arc,
whatever the input); the clockwise overflow is settled on those counts. A row then needs
its rank in its cell, a window over one cell, and a lookup in the broadcast cell table.

Defined cases: null keys and null texts take part (a null text counts 0 bytes and hashes
as empty); equal keys are told apart by the hash of the text, and
rows equal in everything get distinct slots (an overfull cell is ranked in parts); an empty table gives an empty result; extra
columns pass through, those named like an output column are replaced.
"""

from __future__ import annotations

import bisect
import json
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.store import keep, literal_table, quoted

SHARDS, VNODES, CELLS_PER_ARC, SEED = 24, 32, 16, 42


def ring_points(shards: int, vnodes: int, seed: int = SEED) -> list[tuple[int, int]]:
    """Sorted (place, shard) of all virtual nodes; places are 32-bit."""
    out = {}
    for s in range(shards):
        rng = np.random.default_rng([seed, s])
        for p in rng.integers(0, 1 << 32, vnodes).tolist():
            out.setdefault(p, s)
    return sorted(out.items())


def ring_cells(points: list[tuple[int, int]], per_arc: int) -> list[tuple[int, int]]:
    """Sorted (upper place, index of the owning point): arcs cut into cells."""
    cells, before = [], points[-1][0] - (1 << 32)
    for i, (place, _) in enumerate(points):
        for j in range(1, per_arc + 1):
            upper = before + (place - before) * j // per_arc
            if j == per_arc or upper > before:
                cells.append((upper % (1 << 32), i))
        before = place
    return sorted(dict(sorted(cells)).items())


def settle(counts: list[int], owner: list[int], shard_of: list[int], quota: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each cell (in ring order) pieces (first rank, shard, first slot).

    Home rows are taken first, as far as the quota allows; the rest walks clockwise.
    """
    room, filled = list(quota), [0] * len(quota)
    pieces: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    over: list[tuple[int, int]] = [(0, 0)] * len(counts)  # (first rank left, rows left)
    for c, n in enumerate(counts):
        s = shard_of[owner[c]]
        take = min(n, room[s])
        if take:
            pieces[c].append((0, s, filled[s]))
            room[s] -= take
            filled[s] += take
        over[c] = (take, n - take)
    queue: deque[list[int]] = deque()
    order = sorted(range(len(shard_of)))
    by_owner: list[list[int]] = [[] for _ in order]
    for c, o in enumerate(owner):
        by_owner[o].append(c)
    for lap in range(2):
        for o in order:
            s = shard_of[o]
            while queue and room[s]:
                cell, rank, left = queue[0]
                take = min(left, room[s])
                pieces[cell].append((rank, s, filled[s]))
                room[s] -= take
                filled[s] += take
                if take == left:
                    queue.popleft()
                else:
                    queue[0] = [cell, rank + take, left - take]
            if lap == 0:
                queue.extend([c, *over[c]] for c in by_owner[o] if over[c][1])
    return pieces


def quotas(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def ring_shard(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shards: int = SHARDS,
    vnodes: int = VNODES,
    cells_per_arc: int = CELLS_PER_ARC,
    seed: int = SEED,
    carry: list[str] | None = None,
    apart: bool = False,
) -> DataFrame:
    """df's rows (all columns, or those of carry) with size, text_crc32, law, shard, slot, home_shard, grown_shard.

    Law `rows`: shard counts differ by one at most; slots are gapless from 0 in each shard.
    apart: rows of one key get places of their own, by a number that each row gets once and
    keeps in a checkpoint; so copies neither share a shard nor stand side by side.
    """
    spark = df.sparkSession
    made = ["size", "text_crc32", "law", "shard", "slot", "home_shard", "grown_shard"]
    names = [c for c in (df.columns if carry is None else carry) if c not in made]
    points = ring_points(shards, vnodes, seed)
    cells = ring_cells(points, cells_per_arc)
    uppers = [u for u, _ in cells]

    # Columns go by their places, so that none is named like a column made here.
    at = {c: f"c{i}" for i, c in enumerate(dict.fromkeys([*names, key, text]))}
    df = df.select(*(F.col(quoted(c)).alias(a) for c, a in at.items()))
    body = F.coalesce(F.col(at[text]), F.lit(""))
    if apart:
        df = keep(df.withColumn("_row", F.monotonically_increasing_id()))
    of_key = F.xxhash64(F.col(at[key]), *([F.col("_row")] if apart else []), F.lit(seed))
    place = F.shiftrightunsigned(of_key, 32)
    placed = df.select(
        *(at[c] for c in names),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        of_key.alias("_h"),
        F.xxhash64(body, F.lit(seed)).alias("_t"),
        _cell(place, uppers).alias("_cell"),
    )
    light = names == [key]
    if light:
        placed = keep(placed)
    counted = dict(placed.groupBy("_cell").count().collect())  # one row per cell at most
    counts = [counted.get(c, 0) for c in range(len(cells))]
    pieces = settle(counts, [o for _, o in cells], [s for _, s in points], quotas(sum(counts), shards))
    rows = [
        (c, points[cells[c][1]][1], [{"lo": lo, "shard": s, "base": base} for lo, s, base in ps])
        for c, ps in enumerate(pieces)
        if ps
    ]
    where = literal_table(spark, rows, "_c int, home_shard int, _pieces array<struct<lo:bigint,shard:int,base:bigint>>")

    placed, within, offset = _spread_hot(placed, counts)
    rank = F.row_number().over(Window.partitionBy(*within).orderBy("_h", "_t")) - 1 + offset
    piece = F.element_at(F.filter("_pieces", lambda p: p["lo"] <= F.col("_rank")), -1)
    return (
        placed.withColumn("_rank", rank.cast("long"))
        .join(F.broadcast(where), F.col("_cell") == F.col("_c"))  # at most one row per cell, a constant
        .withColumn("_p", piece)
        .select(
            *(F.col(at[c]).alias(c) for c in names),
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("_p.shard").alias("shard"),
            (F.col("_p.base") + F.col("_rank") - F.col("_p.lo")).alias("slot"),
            "home_shard",
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


#: A place is looked up in the sorted cell bounds through this many equal sections.
SECTIONS = 1 << 12
#: A cell is hot from HOT_SHARE times the mean count and HOT_ROWS rows on; its rows are ranked in HOT_PARTS parts.
HOT_SHARE, HOT_ROWS, HOT_PARTS = 8, 5_000, 256


def _spread_hot(placed: DataFrame, counts: list[int]):
    """(rows, columns to rank within, what to add to the rank). One key may fill a cell: its rows are dealt to parts."""
    mean = sum(counts) / max(1, len(counts))
    hot = [c for c, n in enumerate(counts) if n >= max(HOT_ROWS, HOT_SHARE * mean)]
    if not hot:
        return placed, ["_cell"], F.lit(0)
    part = F.pmod(F.xxhash64("_t", F.monotonically_increasing_id()), F.lit(HOT_PARTS)).cast("int")
    placed = keep(placed.withColumn("_part", F.when(F.col("_cell").isin(hot), part).otherwise(-1)))
    sizes = sorted(tuple(r) for r in placed.where("_part >= 0").groupBy("_cell", "_part").count().collect())
    rows, before = [], {}
    for c, p, n in sizes:
        rows.append((c, p, before.get(c, 0)))
        before[c] = before.get(c, 0) + n
    starts = literal_table(placed.sparkSession, rows, "_hc int, _hp int, _off bigint")
    on = (F.col("_cell") == F.col("_hc")) & (F.col("_part") == F.col("_hp"))
    return placed.join(F.broadcast(starts), on, "left"), ["_cell", "_part"], F.coalesce("_off", F.lit(0))


def _constant(values: list[int]):
    """A constant array, folded by the optimizer."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _cell(place, uppers: list[int]):
    """Cell number of a 32-bit place: the first cell of its section, moved on past the bounds below it."""
    first = _constant([bisect.bisect_left(uppers, (i << 32) // SECTIONS) for i in range(SECTIONS + 1)])
    section = F.shiftrightunsigned(place, 20).cast("int")
    lo, hi = (F.element_at(first, section + i).cast("int") for i in (1, 2))
    inside = F.slice(_constant(uppers), lo + 1, hi - lo)
    return F.pmod(lo + F.size(F.filter(inside, lambda u: u < place)), F.lit(len(uppers))).cast("int")
