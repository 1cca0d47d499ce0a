"""Near-duplicate detection with HyperMinHash registers.

A document's set is its distinct five-word shingles. Its sketch has 8 tables of 64
buckets; a table deals the shingles to buckets by the first bits of a hash of their own
and keeps each bucket's minimum as leading-zero count and mantissa bits: 6 + 10 bits for
banding, folded to one byte for estimation. Empty buckets borrow from another bucket that
is chosen by hash alone, so equal registers keep the probability of the Jaccard index.

Candidates: each band joins the registers of 4 tables. There are 20 bands, and more where a
lower threshold needs them (27 at 0.8): a pair at the threshold shares no band with
probability under 10**-6. Sets of up to 64 shingles, for which
registers say little, are found exactly instead: two such sets over the threshold share
one of the least hashes of either set (15% at 0.85; prefix filter), which serve as keys beside the
bands. A pair over the threshold has both sets on the same side or the smaller at 55 or
more, so keys overlap there.

In a bucket, pairs are compared on the 512 registers; the estimate corrects for chance
collisions of registers. What lies 5.5 standard deviations or less below the threshold is
a candidate, and is given by the first band that the pair shares; fewer registers count
for small sets, whose minima are few.
Rounds keep the work on a group of copies linear: first each document with its block's
least document and with its nearest earlier one, blocks of BLOCK members on their own; in
buckets of several blocks then one member of each component with those of the others, as
long as that finds links; at last all pairs of members that verified links have not yet
joined, where blocks of one component do not meet. Every link is confirmed on the full sets; in
the last round within the task, where the members that have a candidate bring their sets, as a
family of unlinked but similar texts makes pairs by the square.

Equal sets are one class from the start: only the least row of each is sketched into
buckets, and copies join its component. A class is named by its least id; where different
sets share that, by a hash of id and set.

Defined cases: null and empty texts, and texts without words, have empty sets, link with
nothing and are components of their own; rows with a null id take no part and get a null
component; rows with equal ids and different texts are judged by their texts; an empty
table gives an empty result; extra columns pass through near_duplicates, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.store import keep
from paperloom.llm.wordcodes import U, mix, ragged, shingle_sets, word_codes
from paperloom.operators.graph import components

SHINGLE, THRESHOLD = 5, 0.85
TABLES, BUCKETS = 8, 64
BANDS, ROWS, MISSED = 20, 4, 1e-6
SMALL = 64
#: Standard deviations under the threshold at which an estimate still makes a candidate.
MARGIN = 5.5
#: Members of a bucket that one task compares among themselves, or with another block.
BLOCK = 2_048
MANTISSA = 10
#: Up to so many ids are broadcast to the scan of the texts.
BROADCAST_IDS = 500_000

_SEEDS = mix(np.arange(1, TABLES + 1, dtype=U) * U(0x632BE59BD9B4E019)) | U(1)
_REST = 64 - 6
_LOW, _EMPTY = U((1 << _REST) - 1), U((1 << 64) - 1)


def _borrow_order() -> np.ndarray:
    """For each bucket the other buckets in the order in which it would borrow from them."""
    out = np.zeros((BUCKETS, BUCKETS), np.int64)
    for b in range(BUCKETS):
        order = np.argsort(mix(np.arange(BUCKETS, dtype=U) + U(b * 7919 + 104729)), kind="stable")
        out[b] = np.concatenate([[b], order[order != b]])
    return out


_BORROW = _borrow_order()


def registers(flat: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
    """sets x TABLES x BUCKETS minima of the sets' hashes below the bucket bits, empty buckets filled.

    flat: the codes of all sets, none of them empty; owner: which set each belongs to.
    """
    out = np.empty((sets, TABLES, BUCKETS), U)
    for t in range(TABLES):
        h = mix(flat * _SEEDS[t])
        low = np.full(sets * BUCKETS, _EMPTY)
        np.minimum.at(low, owner * BUCKETS + (h >> U(_REST)).astype(np.int64), h & _LOW)
        low = low.reshape(sets, BUCKETS)
        has = low != _EMPTY
        filled = low.copy()
        d, b = np.nonzero(~has)
        for step in range(1, BUCKETS):
            if not len(d):
                break
            donor = _BORROW[b, step]
            got = has[d, donor]
            filled[d[got], b[got]] = low[d[got], donor[got]]
            d, b = d[~got], b[~got]
        out[:, t] = filled
    return out


def compress(low: np.ndarray) -> np.ndarray:
    """16-bit registers: leading-zero count (6 bits) and the MANTISSA bits that follow the first one."""
    x = low.astype(np.float64)
    zeros = np.where(low > 0, _REST - 1 - np.floor(np.log2(np.maximum(x, 1))), _REST).astype(np.int64)
    # log2 in floating point may be one off at the edge of a power of two; equal inputs stay equal.
    body = (low << np.minimum(zeros + 1, 63).astype(U)) & U((1 << _REST) - 1)
    return (zeros.astype(U) << U(MANTISSA) | body >> U(_REST - MANTISSA)).astype(np.uint16)


def fold(reg: np.ndarray) -> np.ndarray:
    """One byte of each 16-bit register, for estimation."""
    return (mix(reg.astype(U)) & U(255)).astype(np.uint8)


def collisions(ratio: float = 1.0, load: float = 64.0) -> float:
    """How often 16-bit registers of different minima agree by chance, for buckets of load and of ratio * load hashes.

    The sum over all register values of the product of both laws; a minimum of k hashes is
    exponential with rate k. It hardly depends on load, as leading zeros only shift.
    """
    zeros = np.arange(0, 40)[:, None]
    lower = 2.0 ** -(zeros + 1.0) * (1 + np.arange(1 << MANTISSA)[None, :] / (1 << MANTISSA))
    upper = lower + 2.0 ** -(zeros + 1.0 + MANTISSA)
    law = [np.exp(-k * lower) - np.exp(-k * upper) for k in (load, ratio * load)]
    return float((law[0] * law[1]).sum())


#: How often one-byte registers of different minima agree by chance: by the fold, or before it.
CHANCE = 1 / 256 + (1 - 1 / 256) * collisions()


def estimate(equal_share):
    """Jaccard estimate from the share of equal registers, chance collisions taken off."""
    return (equal_share - CHANCE) / (1 - CHANCE)


def least_estimate(threshold: float, sizes):
    """The estimate that makes a candidate, by the smaller set's size (a small set has few minima to sample)."""
    p = threshold + (1 - threshold) * CHANCE
    samples = TABLES * np.minimum(np.maximum(sizes, 1), BUCKETS)
    return estimate(p - MARGIN * np.sqrt(p * (1 - p) / samples))


def n_bands(percent: int) -> int:
    """So many bands that a pair at the threshold shares none with probability under MISSED; BANDS at least."""
    return min(BUCKETS, max(BANDS, int(np.ceil(np.log(MISSED) / np.log1p(-((percent / 100) ** ROWS))))) if percent < 100 else BANDS)


def band_keys(reg: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """Keys (sets x bands), each of ROWS registers from as many tables."""
    key = np.zeros((len(reg), bands), U)
    for r in range(ROWS):
        key = mix(key * U(31) + reg[:, r, :bands].astype(U) + U(r + 1))
    return mix(key + np.arange(bands, dtype=U) * U(0x9E3779B97F4A7C15))


def prefix_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """The least hashes of a small set, of which any set over the threshold has one among its own."""
    n = len(s)
    take = n - -(-percent * n // 100) + 1
    return mix(np.sort(mix(s))[:take] ^ U(0x5851F42D4C957F2D))


def _has_bands(n, percent: int):
    """Whether a set of n can be over the threshold with one that is not small."""
    return n * 100 > SMALL * percent - 100


def sketch(sets: list[np.ndarray], percent: int) -> tuple[list, list, list]:
    """(digests, keys, one-byte registers) of shingle sets; None, no keys and None for an empty one."""
    full = [i for i, s in enumerate(sets) if len(s)]
    digests, keys, regs = [None] * len(sets), [np.zeros(0, np.int64)] * len(sets), [None] * len(sets)
    if not full:
        return digests, keys, regs
    sizes = np.array([len(sets[i]) for i in full])
    flat, first = np.concatenate([sets[i] for i in full]), np.cumsum(sizes) - sizes
    sums = np.stack([np.add.reduceat(mix(flat), first), np.add.reduceat(mix(flat ^ U(0x94D049BB133111EB)), first) + sizes.astype(U)], 1)
    reg = compress(registers(flat, np.repeat(np.arange(len(full)), sizes), len(full)))
    bands, small = band_keys(reg, n_bands(percent)).view(np.int64), fold(reg)
    for at, i in enumerate(full):
        digests[i], regs[i] = sums[at].tobytes(), small[at].tobytes()
        mine = [bands[at]] if _has_bands(sizes[at], percent) else []
        if sizes[at] <= SMALL:
            mine.append(prefix_keys(sets[i], percent).view(np.int64))
        keys[i] = mine[0] if len(mine) == 1 else np.concatenate(mine)
    return digests, keys, regs


def _sketcher(percent: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sets = shingle_sets(*word_codes(part.column(2), lower=True), SHINGLE)
                digests, keys, regs = sketch(sets, percent)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        ragged(np.concatenate(keys), [len(k) for k in keys], pa.int64()),
                        pa.array(regs, pa.binary()),
                    ],
                    ["id", "th", "n", "digest", "keys", "reg"],
                )

    return run


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, th, text): th, a hash of the text, tells rows of one id apart."""
    return docs.select(F.col(key).cast("bigint").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).cast("string").alias("text"))


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, th, n, digest, keys, reg) of every row."""
    return _rows(docs, key, text).mapInArrow(_sketcher(round(threshold * 100)), "id bigint, th bigint, n bigint, digest binary, keys array<bigint>, reg binary")


def _tiles(bucket: int, sizes, labels, regs, bands, threshold: float, nearest: bool):
    """Candidate pairs (later index, earlier index, equal registers) of one bucket's members, which are sorted by id, tile by tile.

    Of the bands that a pair shares, only the first gives the pair, unless the nearest are asked for.
    Labels are read anew for each tile.
    """
    m, percent = len(sizes), round(threshold * 100)
    for i in range(0, m, 256):
        rows = slice(i, min(i + 256, m))
        for j in range(0, i + 1, 256):
            cols = slice(j, min(j + 256, m))
            lo, hi = np.minimum(sizes[rows, None], sizes[None, cols]), np.maximum(sizes[rows, None], sizes[None, cols])
            ok = (lo * 100 >= percent * hi) & (labels[rows, None] != labels[None, cols])
            ok &= np.arange(i, rows.stop)[:, None] > np.arange(j, cols.stop)[None, :]
            if not ok.any():
                continue
            same = (regs[rows, None, :] == regs[None, cols, :]).sum(2, dtype=np.int32)
            ok &= estimate(same / (TABLES * BUCKETS)) >= least_estimate(threshold, lo)
            a, b = np.nonzero(ok)
            if not nearest:
                shared = (bands[a + i] == bands[b + j]) & (bands[a + i] != 0)
                first = bands[a + i, shared.argmax(1)]
                mine = ~shared.any(1) | (first == bucket)
                a, b = a[mine], b[mine]
            yield a + i, b + j, same[a, b]


def _pairs_of(bucket: int, sizes, labels, regs, bands, threshold: float, nearest: bool):
    """All candidate pairs (later index, earlier index); if asked for, only the nearest and the first of each member."""
    tiles = list(_tiles(bucket, sizes, labels, regs, bands, threshold, nearest))
    found, score = [np.stack(t[:2], 1) for t in tiles], [t[2] for t in tiles]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs, score = np.concatenate(found), np.concatenate(score)
    if nearest and len(pairs):
        by = np.lexsort((pairs[:, 1], -score, pairs[:, 0]))
        top = by[np.diff(pairs[by, 0], prepend=-1) != 0]
        pairs = pairs[np.unique(np.concatenate([top, np.flatnonzero(pairs[:, 1] == 0)]))]
    return pairs[:, 0], pairs[:, 1]


def _parts(batch, threshold: float):
    """(order, across, what _tiles asks for) of each part of a batch that holds several labels; order: its rows sorted by id."""
    key, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    side, ids, sizes, labels = (batch.column(i).to_numpy() for i in (2, 3, 4, 5))
    regs = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(len(ids), TABLES * BUCKETS)
    bands = _bands(batch.column(7), sizes, threshold)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
    bounds = [*np.flatnonzero(new).tolist(), len(key)]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo < 2 or (labels[lo:hi] == labels[lo]).all():
            continue
        o = lo + np.argsort(ids[lo:hi], kind="stable")

        def across(a, b, s=side[o], two=part[lo] >= 0):  # two blocks: pairs within one belong to that block's own task
            return s[a] != s[b] if two else np.ones(len(a), bool)

        yield o, across, (key[lo], sizes[o], labels[o], regs[o], bands[o])


def _bucket_mapper(threshold: float, nearest: bool):
    def mapper(batches):
        for batch in _whole_groups(batches):
            ids, out = batch.column(3).to_numpy(), []
            for o, across, members in _parts(batch, threshold):
                a, b = _pairs_of(*members, threshold, nearest)
                ok = across(a, b)
                if ok.any():
                    out.append(np.stack([ids[o][b[ok]], ids[o][a[ok]]], 1))
            if out:
                pairs = np.unique(np.concatenate(out), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return mapper


def _paired_mapper(threshold: float):
    """The rows, as they are, of members that are in a candidate pair of their part."""

    def mapper(batches):
        for batch in _whole_groups(batches):
            has = np.zeros(batch.num_rows, bool)
            for o, across, members in _parts(batch, threshold):
                for a, b, _ in _tiles(*members, threshold, False):
                    ok = across(a, b)
                    has[o[a[ok]]] = has[o[b[ok]]] = True
            if has.any():
                yield batch.filter(pa.array(has))

    return mapper


def common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The intersection sizes of the sets a[i] and b[i]; of many pairs at once by a product of membership matrices."""
    if len(a) < 64:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], np.int64)
    sides, kinds = [], None
    for which in (a, b):
        rows, at = np.unique(which, return_inverse=True)
        flat = np.concatenate([sets[r] for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
        order = np.argsort(flat, kind="stable")
        sides.append((len(rows), at, flat[order], owner[order]))
        kinds = np.unique(flat) if kinds is None else np.intersect1d(kinds, np.unique(flat), assume_unique=True)
    out = np.zeros((sides[0][0], sides[1][0]), np.int64)
    for lo in range(0, len(kinds), 4096):
        part, has = kinds[lo : lo + 4096], []
        for n, _, flat, owner in sides:
            here = slice(np.searchsorted(flat, part[0]), np.searchsorted(flat, part[-1], "right"))
            col = np.searchsorted(part, flat[here])
            ok = part[col] == flat[here]
            has.append(np.zeros((n, len(part)), np.float32))
            has[-1][owner[here][ok], col[ok]] = 1
        out += (has[0] @ has[1].T).astype(np.int64)
    return out[sides[0][1], sides[1][1]]


def _within_mapper(threshold: float):
    """Links that join a part's labels, confirmed on the full sets (column 8): fewer than the part has members."""
    percent = round(threshold * 100)

    def mapper(batches):
        for batch in _whole_groups(batches):
            ids, out = batch.column(3).to_numpy(), []
            for o, across, (key, sizes, labels, regs, bands) in _parts(batch, threshold):
                sets = [np.frombuffer(batch.column(8)[int(i)].as_buffer(), U) for i in o]
                labels = labels.copy()
                for a, b, _ in _tiles(key, sizes, labels, regs, bands, threshold, False):
                    ok = across(a, b)
                    a, b = a[ok], b[ok]
                    both = common(sets, a, b)
                    good = 100 * both >= percent * (sizes[a] + sizes[b] - both)
                    for x, y in zip(a[good].tolist(), b[good].tolist()):
                        if labels[x] != labels[y]:
                            labels[labels == labels[x]] = labels[y]
                            out.append((ids[o[y]], ids[o[x]]))
            if out:
                pairs = np.array(out, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return mapper


def _bands(keys: pa.Array, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """The band keys of each row, 0 for sets that have none."""
    percent = round(threshold * 100)
    bands = n_bands(percent)
    out = np.zeros((len(sizes), bands), np.int64)
    has = np.flatnonzero(_has_bands(sizes, percent))
    at = keys.offsets.to_numpy()[:-1][has].astype(np.int64)
    out[has] = keys.values.to_numpy()[at[:, None] + np.arange(bands)]
    return out


def _whole_groups(batches):
    """Re-cut a sorted stream of batches so that no group of the first two columns is split."""

    def joined(parts):
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        now = (int(key[-1]), int(part[-1]))
        cut = int(np.flatnonzero((key == now[0]) & (part == now[1]))[0])
        if cut:
            yield joined([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and now != last:
            yield joined(held)
            held = [batch]
        else:
            held.append(batch)
        last = now
    if held:
        yield joined(held)


def bucket_members(sig: DataFrame) -> DataFrame:
    """(bucket, id, m) for each key that two or more classes share. sig has one row per class."""
    flat = sig.select("id", F.explode("keys").alias("bucket"))
    shared = flat.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    return flat.join(shared, "bucket")


def own_blocks(members: DataFrame) -> DataFrame:
    """members (bucket, id, m, label) with part and side: each bucket's members in blocks of about BLOCK, which meet no other block."""
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(F.col("m") / BLOCK)).cast("int")
    return members.select("bucket", "id", "label", (-1 - part).alias("part"), F.lit(0).alias("side"))


def cross_blocks(members: DataFrame) -> DataFrame:
    """members with part and side: every two members of different labels meet in some part.

    A bucket of up to BLOCK members is one part. In a larger one, each label of BLOCK members or
    more has blocks of its own, the other labels are dealt to shared blocks; a block meets each
    other one, but for blocks of its own label, whose members are linked already.
    """
    counts = members.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    large = F.when(F.col("c") >= BLOCK, F.struct("label", F.ceil(F.col("c") / BLOCK).cast("int").alias("k"), "c"))
    shape = counts.groupBy("bucket").agg(F.sum("c").alias("m"), F.array_sort(F.collect_list(large)).alias("large")).where(F.col("m") > BLOCK)
    shared = F.ceil((F.col("m") - F.aggregate("large", F.lit(0).cast("bigint"), lambda a, x: a + x["c"])) / BLOCK).cast("int")
    own = F.flatten(F.transform("large", lambda x: F.array_repeat(x["label"], x["k"])))
    shape = shape.select(F.col("bucket").alias("_b"), shared.alias("_shared"), own.alias("_own"))
    met = members.join(shape, F.col("bucket") == F.col("_b"), "left")
    first = F.array_position("_own", F.col("label")).cast("int")  # from 1; 0 if the label has no blocks of its own
    mine = F.size(F.filter("_own", lambda x: x == F.col("label")))
    at = F.when(first > 0, F.col("_shared") + first - 1 + F.pmod(F.xxhash64("id", F.lit(3)), mine)).otherwise(F.pmod(F.xxhash64("label", F.lit(3)), F.greatest("_shared", F.lit(1))))
    met = met.withColumn("_at", at.cast("int")).withColumn("_n", F.col("_shared") + F.size("_own"))

    def with_block(j):
        owner = F.get("_own", j - F.col("_shared"))
        low, high = F.least(j, F.col("_at")), F.greatest(j, F.col("_at"))
        pair = F.struct((low * F.col("_n") + high).alias("part"), (j > F.col("_at")).cast("int").alias("side"))
        alone = F.struct((-2 - j).alias("part"), F.lit(0).alias("side"))
        return F.when((j >= F.col("_shared")) & (owner == F.col("label")), F.lit(None)).when(j == F.col("_at"), alone).otherwise(pair)

    blocks = F.array_compact(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), with_block))
    one = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).alias("side")))
    return met.select("bucket", "id", "label", F.explode(F.when(F.col("_n").isNull(), one).otherwise(blocks)).alias("p")).select("bucket", "id", "label", "p.part", "p.side")


MEMBER = "bucket bigint, part bigint, side int, id bigint, n bigint, label bigint, reg binary, keys array<bigint>"


def _met(rows: DataFrame) -> DataFrame:
    """The rows of each part in one task, one after the other."""
    return rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part")


def _members(dealt: DataFrame, sig: DataFrame) -> DataFrame:
    return dealt.join(sig.select("id", "n", "reg", "keys"), "id").select("bucket", F.col("part").cast("bigint"), F.col("side").cast("int"), "id", "n", "label", "reg", "keys")


def bucket_pairs(dealt: DataFrame, sig: DataFrame, threshold: float, nearest: bool) -> DataFrame:
    """Distinct candidate pairs (a, b), a < b, of differing labels, within the parts of dealt (bucket, id, label, part, side)."""
    return _met(_members(dealt, sig)).mapInArrow(_bucket_mapper(threshold, nearest), "a bigint, b bigint").distinct()


def _set_mapper():
    def mapper(batches):
        for batch in batches:
            sets = shingle_sets(*word_codes(batch.column(1), lower=True), SHINGLE)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "s"])

    return mapper


def _checker(percent: int):
    def check(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * both >= percent * (len(s) + len(t) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return check


def _sets_of(needed: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, s) of the needed nodes; classes has (node, id, th), texts (id, th, text).

    The rows whose sets are needed are broadcast to the scan of the texts up to a checked
    number; beyond it the texts are shuffled to them.
    """
    wanted = keep(classes.join(needed, "node", "left_semi").select("node", "id", "th"))
    few = wanted.count() <= BROADCAST_IDS
    rows = texts.join(F.broadcast(wanted) if few else wanted, ["id", "th"]).select("node", "text")
    return rows.mapInArrow(_set_mapper(), "id bigint, s binary").dropDuplicates(["id"])


def confirm(pairs: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs of nodes whose full shingle sets reach the threshold; classes has (node, id, th), texts (id, th, text)."""
    pairs = keep(pairs)
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), classes, texts)
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(_checker(round(threshold * 100)), "a bigint, b bigint").distinct()


def confirm_within(dealt: DataFrame, sig: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): confirmed links that join the labels of each part of dealt, as all its confirmed pairs would.

    Pairs do not leave the task: the members that have a candidate pair get their full sets,
    and those of a part meet there. So rows are as many as members, however many pairs they make.
    """
    paired = keep(_met(_members(dealt, sig)).mapInArrow(_paired_mapper(threshold), MEMBER))
    sets = _sets_of(paired.select(F.col("id").alias("node")).distinct(), classes, texts)
    return _met(paired.join(sets, "id").select(*paired.columns, "s")).mapInArrow(_within_mapper(threshold), "a bigint, b bigint")


def _unsettled(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members (bucket, id, m, label), their component as label, of the buckets that hold several components."""
    found = components(links).withColumnRenamed("node", "id")
    marked = members.select("bucket", "id").join(found, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("label"))
    mixed = marked.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
    return marked.join(mixed.select("bucket", "m"), "bucket")


def linked(sig: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): confirmed links between nodes; their components are those of all links. sig has one row per node, as id."""
    members = keep(bucket_members(sig))
    first = bucket_pairs(own_blocks(members.withColumn("label", F.col("id"))), sig, threshold, True)
    links = keep(confirm(first, classes, texts, threshold))
    left = keep(_unsettled(members, links))
    while True:
        # Of large buckets one member per component meets those of the others, block by block, as long as links are found.
        heads = left.where(F.col("m") > BLOCK).groupBy("bucket", "label").agg(F.min("id").alias("id"))
        heads = heads.join(heads.groupBy("bucket").agg(F.count("*").alias("m")), "bucket")
        if heads.isEmpty():
            break
        more = keep(confirm(bucket_pairs(own_blocks(heads), sig, threshold, True), classes, texts, threshold))
        if more.isEmpty():
            break
        links = links.unionByName(more)
        left = keep(_unsettled(left, links))
    return links.unionByName(confirm_within(cross_blocks(left), sig, classes, texts, threshold))


def _classes(rows: DataFrame) -> DataFrame:
    """(digest, id, th, node): the least row of each set; node names it, the id itself unless other sets have it too."""
    least = keep(rows.groupBy("digest").agg(F.min(F.struct("id", "th")).alias("r")).select("digest", "r.id", "r.th"))
    several = keep(least.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select("id", F.lit(True).alias("_several")))
    if several.isEmpty():
        return least.withColumn("node", F.col("id"))
    named = least.join(several, "id", "left").withColumn("node", F.when(F.col("_several"), F.xxhash64("id", "digest")).otherwise(F.col("id")))
    return keep(named.select("digest", "id", "th", "node"))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, th, n, component, family) of every row; family names the component, also where several share their least id."""
    sig = keep(signatures(docs, key, text, threshold))
    rows = sig.where("id IS NOT NULL AND digest IS NOT NULL")
    classes = _classes(rows)
    one = rows.join(classes.select("id", "th", "digest", "node"), ["id", "th", "digest"]).select(F.col("node").alias("id"), "n", "keys", "reg").dropDuplicates(["id"])
    found = components(linked(keep(one), classes, _rows(docs, key, text), threshold))
    # The many-rows side of each join is split by adaptive execution if one class is hot.
    families = classes.join(found, "node", "left").select("digest", "id", F.coalesce("component", "node").alias("family"))
    least = families.groupBy("family").agg(F.min("id").alias("component"))
    named = keep(families.select("digest", "family").join(least, "family"))
    out = rows.select("id", "th", "n", "digest").join(named, "digest").select("id", "th", "n", "component", "family")
    alone = sig.where("id IS NULL OR digest IS NULL").select("id", "th", "n", F.col("id").alias("component"), F.lit(None).cast("bigint").alias("family"))
    return out.unionByName(alone)


def duplicate_components(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n, component) of every row."""
    return judged(docs, key, text, threshold).select("id", "n", "component")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each component: one with its least id; a row without words once for each id. Rows with a null id are kept.

    Equal ids do not make rows alike: of several texts under one id each component keeps its own.
    """
    found = judged(docs, key, text, threshold).where("id = component")
    heads = found.where("family IS NOT NULL").groupBy("family").agg(F.min(F.struct("id", "th")).alias("r")).select("r.id", "r.th")
    kept = keep(heads.unionByName(found.where("family IS NULL").select("id", "th")).distinct())
    names = {c: f"_doc_{i}" for i, c in enumerate(docs.columns)}
    own = docs.withColumnsRenamed(names)
    th = F.xxhash64(F.col(names[text]).cast("string"))
    chosen = own.withColumn("_th", th).join(kept, (F.col(names[key]).cast("bigint") == F.col("id")) & (F.col("_th") == F.col("th")), "left_semi")
    chosen = chosen.dropDuplicates([names[key], "_th"]).drop("_th").unionByName(own.where(F.col(names[key]).isNull()))
    return chosen.withColumnsRenamed({v: k for k, v in names.items()})
