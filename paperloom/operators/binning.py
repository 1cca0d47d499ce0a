"""Greedy sequential bins, worked out in parallel.

Pieces of a group go, in order, into the open bin while its sum stays within the budget; the
piece that would exceed it opens the next bin (a piece above the budget fills one alone).
Each bin's start decides the next one's: the first piece at which the running sum passes the
start's own by more than the budget. So bins are the path from a group's first piece along
this successor, and the path is found without walking it in one task:

* pieces are dealt in ranges of their order, and running sums of the ranges (a row each on
  the driver) make sums global;
* within a range, successors come from a binary search, and doubling them leads each piece
  to the last start in the range. Only starts whose bin stays open at a range's end matter
  beyond it, at most as many as a bin holds pieces;
* those are a small graph over ranges: an open bin's budget ends in some later range, at a
  piece whose own path leads to an open start there. Doubling these edges in joins marks the
  true ones in a logarithmic number of rounds, and adds up how many bins lie between;
* with its range's true open bin known, every range numbers its pieces on its own.

Pieces carry keys and sizes only. One group may hold all rows.

Defined cases: null sizes count as 0, as negative ones do; null groups are a group; pieces
of equal order keys go in an arbitrary order; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import keep

_SHIFT = 33  # of monotonically_increasing_id: the range's number stands above


class Block:
    """One range: g tells groups apart, s are sizes, base is the sum of all ranges before; each row has its group's budget."""

    def __init__(self, g: np.ndarray, s: np.ndarray, base: int, budget: np.ndarray):
        self.n, self.base = len(s), base
        self.end = base + np.cumsum(s)
        self.start = self.end - s
        self.budget = budget
        change = np.concatenate([[True], (g[1:] != g[:-1]).any(1)]) if self.n else np.zeros(0, bool)
        self.runs = np.nonzero(change)[0]  # first rows of groups
        run = np.cumsum(change) - 1
        self.run_end = np.append(self.runs[1:], self.n)[run] if self.n else run
        after = np.maximum(np.searchsorted(self.end, self.start + budget, "right"), np.arange(self.n) + 1)
        self.open = after >= self.run_end  # the bin holds the rest of the group's rows here
        self.next = np.where(self.open, np.arange(self.n), after)

    def last(self) -> tuple[np.ndarray, np.ndarray]:
        """(last start that each row's path comes to, how many starts lie between)."""
        to, steps = self.next, (self.next != np.arange(self.n)).astype(np.int64)
        while (to[to] != to).any():
            steps, to = steps + steps[to], to[to]
        return to, steps

    def landing(self, t: np.ndarray) -> np.ndarray:
        """First rows whose sum passes t."""
        return np.searchsorted(self.end, t, "right")

    def numbers(self, carried: tuple[int, int] | None) -> np.ndarray:
        """Each row's bin; carried is the number of the bin that is open before, and the sum it reaches to."""
        out = np.zeros(self.n, np.int64)
        for k, first in enumerate(self.runs):
            stop, number, at = self.run_end[first], 1, int(first)
            if k == 0 and carried is not None:
                at = min(int(self.landing(np.array([carried[1]]))[0]), int(stop))
                out[first:at] = carried[0]
                number = carried[0] + 1
            while at < stop:
                upto = int(stop) if self.open[at] else int(self.next[at])
                out[at:upto] = number
                at, number = upto, number + 1
        return out


def _arrays(batches, want=("_g", "_h", "_s", "_b", "_at")):
    columns = [[b.column(c).to_numpy(zero_copy_only=False) for b in batches] for c in want]
    g, h, s, b, at = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)
    return np.stack([g, h.astype(np.int64)], 1), s, b, at


def _shape(batches):
    """One row of a range: what it holds and which groups it begins and ends with."""
    g, s, b, at = _arrays(list(batches))
    if not len(s):
        return
    same = (g == g[0]).all(1)
    lead = int(np.argmin(same)) if not same.all() else len(s)
    values = [at[0] >> _SHIFT, len(s), s.sum(), s[:lead].sum(), int(lead == len(s)), g[0, 0], g[0, 1], g[-1, 0], g[-1, 1]]
    names = ["part", "n", "total", "lead", "whole", "g0", "h0", "g1", "h1"]
    yield pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in values], names=names)


class Ranges:
    """What the driver knows of all ranges, in order: sums before each, and how far its last group goes."""

    def __init__(self, rows):
        rows = sorted(rows, key=lambda r: r["part"])
        self.parts = np.array([r["part"] for r in rows], np.int64)
        totals = np.array([r["total"] for r in rows], np.int64)
        self.ends = np.cumsum(totals)
        self.base = self.ends - totals
        n = len(rows)
        self.continued = np.zeros(n, bool)  # its first group began before
        for k in range(1, n):
            self.continued[k] = (rows[k]["g0"], rows[k]["h0"]) == (rows[k - 1]["g1"], rows[k - 1]["h1"])
        self.whole = np.array([bool(r["whole"]) for r in rows], bool)
        self.reach = np.zeros(n, np.int64)  # sum at the end of its last group
        for k in range(n - 1, -1, -1):
            on = k + 1 < n and self.continued[k + 1]
            self.reach[k] = (self.reach[k + 1] if self.whole[k + 1] else self.base[k + 1] + rows[k + 1]["lead"]) if on else self.ends[k]

    def at(self, part: int) -> int:
        return int(np.searchsorted(self.parts, part))

    def goes_on(self, k: int) -> bool:
        return k + 1 < len(self.parts) and bool(self.continued[k + 1])

    def land(self, k: int, t: np.ndarray) -> np.ndarray:
        """The parts where bins that reach to t, from range k, end; -1 where the group ends first."""
        to = np.maximum(np.searchsorted(self.ends, t, "right"), k + 1)
        return np.where(t >= self.reach[k], -1, self.parts[np.minimum(to, len(self.parts) - 1)])


_NODES = "at bigint, t bigint, land bigint, number bigint"


def _nodes_mapper(ranges: Ranges):
    """Starts whose bin is open at their range's end; number is known where the group began in the range."""

    def mapper(batches):
        g, s, b, at = _arrays(list(batches))
        if not len(s):
            return
        k = ranges.at(int(at[0] >> _SHIFT))
        if not ranges.goes_on(k):
            return
        block = Block(g, s, int(ranges.base[k]), b)
        first = int(block.runs[-1])
        if len(block.runs) == 1 and ranges.continued[k]:
            nodes = np.nonzero(block.open)[0]
            numbers = pa.nulls(len(nodes), pa.int64())
        else:
            to, steps = block.last()
            nodes, numbers = to[[first]], pa.array([int(steps[first]) + 1], pa.int64())
        t = block.start[nodes] + block.budget[nodes]
        yield pa.RecordBatch.from_arrays([pa.array(at[nodes]), pa.array(t), pa.array(ranges.land(k, t)), numbers], names=["at", "t", "land", "number"])

    return mapper


def _edges_joiner(ranges: Ranges):
    """Open starts that land in a range, with that range: where each leads to and how many bins that opens."""

    def join(landing: pa.Table, rows: pa.Table) -> pa.Table:
        none = pa.table({c: pa.array([], pa.int64()) for c in ("at", "to", "bins")})
        if not len(landing) or not len(rows):
            return none
        rows = rows.sort_by("_at")
        g, s, b, at = _arrays([rows])
        k = ranges.at(int(at[0] >> _SHIFT))
        block = Block(g, s, int(ranges.base[k]), b)
        if not (len(block.runs) == 1 and ranges.goes_on(k)):
            return none  # the group ends here
        to, steps = block.last()
        j = block.landing(landing.column("t").to_numpy())
        return pa.table({"at": landing.column("at").combine_chunks(), "to": pa.array(at[to[j]]), "bins": pa.array(steps[j] + 1)})

    return join


def _numbers_mapper(ranges: Ranges, carried: dict[int, tuple[int, int]]):
    def mapper(batches):
        batches = list(batches)
        g, s, b, at = _arrays(batches)
        if not len(s):
            return
        k = ranges.at(int(at[0] >> _SHIFT))
        numbers = Block(g, s, int(ranges.base[k]), b).numbers(carried.get(k))
        done = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-5], pa.array(numbers[done : done + len(batch)])], names=[*batch.schema.names[:-5], "_bin"])
            done += len(batch)

    return mapper


def greedy_bins(rows: DataFrame, budget: int | str, size: str, order: list[str], group: list[str] = (), to: str = "bin") -> DataFrame:
    """rows (group, order and size columns) with the number, from 1, of each one's bin in its group.

    budget is a number, or the column that has it, one value for all rows of a group.
    """
    group = list(group)
    names = list(dict.fromkeys([*group, *order, size]))
    by = [F.col(c) for c in [*group, *order]]
    s = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    identity = [F.xxhash64(*group), F.hash(*group)] if group else [F.lit(0).cast("bigint"), F.lit(0)]
    most = F.col(budget).cast("bigint") if isinstance(budget, str) else F.lit(budget).cast("bigint")
    ranged = rows.select(*names, most.alias("_b")).repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = keep(ranged.select(*names, identity[0].alias("_g"), identity[1].alias("_h"), s.alias("_s"), "_b", F.monotonically_increasing_id().alias("_at")))
    light = ranged.select("_g", "_h", "_s", "_b", "_at")
    shape = light.mapInArrow(_shape, "part bigint, n bigint, total bigint, lead bigint, whole bigint, g0 bigint, h0 bigint, g1 bigint, h1 bigint")
    ranges = Ranges(shape.collect())  # a row a range
    nodes = keep(light.mapInArrow(_nodes_mapper(ranges), _NODES))
    blocks = light.withColumn("_part", F.shiftright("_at", _SHIFT))
    landing = nodes.where("land >= 0").groupBy("land").cogroup(blocks.groupBy("_part"))
    jumps = keep(landing.applyInArrow(_edges_joiner(ranges), "at bigint, to bigint, bins bigint"))
    reached = nodes.where("number IS NOT NULL").select("at", "number")
    while not jumps.isEmpty():
        further = reached.join(jumps, "at").select(F.col("to").alias("at"), (F.col("number") + F.col("bins")).alias("number"))
        reached = keep(reached.unionByName(further).distinct())
        second = jumps.select(F.col("at").alias("to"), F.col("to").alias("_to"), F.col("bins").alias("_bins"))
        jumps = keep(jumps.join(second, "to").select("at", F.col("_to").alias("to"), (F.col("bins") + F.col("_bins")).alias("bins")))
    true = {ranges.at(r["at"] >> _SHIFT): (r["number"], r["t"]) for r in reached.join(nodes.select("at", "t"), "at").collect()}  # one start a range at most
    carried, held = {}, None
    for k in range(len(ranges.parts)):
        if ranges.continued[k]:
            carried[k] = held
        held = true.get(k, held)
    kinds = ", ".join(f"`{c}` {ranged.schema[c].dataType.simpleString()}" for c in names)
    return ranged.mapInArrow(_numbers_mapper(ranges, carried), f"{kinds}, _bin bigint").withColumnRenamed("_bin", to)


def numbered(rows: DataFrame, order: list[str], to: str = "n") -> DataFrame:
    """rows with their number, from 1, in one global order: counts of ranges first, then places within each."""
    ranged = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    counts = ranged.groupBy(F.shiftright("_at", _SHIFT).alias("p")).count().orderBy("p").collect()  # a row a range
    before, run = [0] * (max((r["p"] for r in counts), default=0) + 1), 0
    for r in counts:
        before[r["p"]], run = run, run + r["count"]
    base = F.get(F.from_json(F.lit(str(before)), "array<bigint>"), F.shiftright("_at", _SHIFT).cast("int"))
    return ranged.withColumn(to, base + F.col("_at").bitwiseAND(F.lit((1 << _SHIFT) - 1)) + 1).drop("_at")
