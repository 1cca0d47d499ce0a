"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Blocks: a permutation hash deals each source's documents to BLOCKS blocks, so a block is a
random sample of its source; a block's size is the sum of its documents' words. Block
quotas: a source's target is met by whole passes over all its blocks and, for the rest, by
the blocks from the start of a random order that fit, of which the last few (up to TRIES)
may give way to two blocks whose sizes come nearest to what is left. So each source has an
exact quota of block draws.

The splitting tree deals the quotas to output shards: at each node the draws are split
between the two halves of its shards by a draw from the multivariate hypergeometric law,
exactly, down to single shards. Each source's draws, in random order, are then cut by these
counts, so shards draw disjoint blocks, and a document is in the mix as often as shards
have drawn its block: nothing else decides what is taken. Within a shard, rows are shuffled
by a hash of document, draw and seed.

Quotas of blocks are worked out in executors, one bounded group of at most BLOCKS rows a
source. The driver holds names, sizes and quotas, one row a source, and SHARDS counts each;
the drawn blocks are a table in the shared folder that is joined with the documents by
source and block, broadcast only up to a checked number of rows. A source with a third of
all rows has its rows in BLOCKS groups.

Defined cases: a null text has size 0 and stays with its block; a source whose texts have no
words has target 0 and nothing is taken; a null source is a source of its own, last in
order; repeated rows share a block and are drawn alike; an empty table gives an empty
result; extra columns pass through mix_sources whatever their names, but mix_shard and
mix_order, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.store import keep, quoted, scratch

WEIGHTS, MOST, SHARDS, SEED, BLOCKS = (5, 2, 1), 3, 16, 17, 1024
#: Up to so many rows the table of drawn blocks (about 60 bytes each) is broadcast.
BROADCAST_ROWS = 200_000
#: So many of the last blocks that fit may give way to two others.
TRIES = 64
#: Parts of a shard's order that are sorted on their own.
PARTS = 8

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def shares(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Targets by weight that sum to all sizes, none above most times its size; the excess is reshared by weight."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in full:
            target[i] = float(most * sizes[i])
            left -= target[i]
            open_.discard(i)
    return target


def drawn_blocks(sizes: np.ndarray, target: float, most: int, order: np.ndarray) -> np.ndarray:
    """How often each block is drawn, so that the drawn sizes come near the target; order: the blocks at random."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(len(sizes), np.int64)
    passes = min(int(target // total), most)
    draws = np.full(len(sizes), passes, np.int64)
    rest = target - passes * total
    if passes >= most or rest <= 0:
        return draws
    sums = np.concatenate([[0], np.cumsum(sizes[order])])
    fit = int(np.searchsorted(sums, rest, "right")) - 1  # so many blocks fit
    best = (np.inf, 0, ())
    for taken in range(fit, max(fit - TRIES, -1), -1):
        left, open_ = rest - int(sums[taken]), order[taken:]
        by = open_[np.argsort(sizes[open_], kind="stable")]
        values = np.concatenate([[0], sizes[by]])  # place 0 is no block
        # Of all pairs of places the one whose sum is nearest to what is left: each place's partners by bisection.
        partner = np.clip(np.searchsorted(values, left - values), 1, len(values) - 1)
        for p in (partner, partner - 1):
            off = np.abs(left - values - values[p])
            off[(p == np.arange(len(values))) & (p > 0)] = np.inf  # a block can't be its own partner
            i = int(off.argmin())
            if off[i] < best[0]:
                best = float(off[i]), taken, tuple(by[x - 1] for x in {i, int(p[i])} if x)
        if best[0] < 1:
            break
    draws[order[: best[1]]] += 1
    draws[list(best[2])] += 1
    return draws


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """Block draws of each source for each shard: [shard][source]. Node by node, by multivariate hypergeometric draws."""
    out = [[0] * len(quotas) for _ in range(shards)]

    def split(node: tuple[int, int], quota: np.ndarray):
        lo, hi = node
        if hi - lo == 1:
            out[lo] = quota.tolist()
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        total = int(quota.sum())
        # The left half gets its share of all draws, rounded; which sources they are of is drawn.
        n = (total * (mid - lo) * 2 + (hi - lo)) // (2 * (hi - lo))
        left = rng.multivariate_hypergeometric(quota, n, method="marginals") if total else quota
        split((lo, mid), left)
        split((mid, hi), quota - left)

    split((0, shards), np.asarray(quotas, np.int64))
    return out


def deal(draws: np.ndarray, counts: list[int], seed: list[int]) -> list[list[int]]:
    """The shards that draw each block: all draws in random order, cut by the shards' counts."""
    blocks = np.repeat(np.arange(len(draws)), draws)
    blocks = np.random.default_rng(seed).permutation(blocks)
    out: list[list[int]] = [[] for _ in draws]
    for shard, block in zip(np.repeat(np.arange(len(counts)), counts).tolist(), blocks.tolist()):
        out[block].append(shard)
    return out


def _block(key: str, text: str, blocks: int, seed: int) -> Column:
    """The block of a row within its source, alike on every run."""
    return F.pmod(permuted(key, text, seed), F.lit(blocks)).cast("int")


def permuted(key: str, text: str, seed: int) -> Column:
    """A hash that orders a source's documents at random, alike on every run."""
    return F.xxhash64(F.col(key), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")), F.lit(seed))


def plan(base: DataFrame, weights=WEIGHTS, most: int = MOST, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(_s, _b, source_size, target, _shards) of every block, read from the shared folder; base has source, block and size."""
    spark = base.sparkSession
    blocks = keep(base.groupBy("source", "block").agg(F.sum("size").alias("size")))
    sources = blocks.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("b")).collect()  # one row per source
    sources.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["n"] or 0) for r in sources]
    target = shares(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    place = {r["source"]: i for i, r in enumerate(sources)}
    goals = spark.createDataFrame(pd.DataFrame({"place": range(len(sources)), "source": [r["source"] for r in sources], "source_size": sizes, "target": target}).astype({"place": "int64", "source_size": "int64", "target": float}),
                                  "place bigint, source string, source_size bigint, target double")
    known = blocks.withColumnRenamed("source", "_s").join(_small(goals, len(place)), F.col("_s").eqNullSafe(F.col("source")))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        place = int(pdf["place"][0])
        order = np.random.default_rng([seed, 1, place]).permutation(len(pdf))
        pdf["draws"] = drawn_blocks(pdf["size"].to_numpy(), float(pdf["target"][0]), most, order)
        return pdf[["_s", "place", "block", "source_size", "target", "draws"]]

    drawn = keep(known.groupBy("place").applyInPandas(choose, "_s string, place bigint, block int, source_size bigint, target double, draws bigint"))
    quota = {r["place"]: int(r["q"]) for r in drawn.groupBy("place").agg(F.sum("draws").alias("q")).collect()}
    tree = split_quotas([quota.get(i, 0) for i in range(len(sources))], shards, seed)
    leaves = pd.DataFrame({"place": range(len(sources)), "counts": [[tree[s][i] for s in range(shards)] for i in range(len(sources))]}).astype({"place": "int64"})
    counts = spark.createDataFrame(leaves, "place bigint, counts array<bigint>")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        pdf["_shards"] = deal(pdf["draws"].to_numpy(), list(pdf["counts"][0]), [seed, 2, int(pdf["place"][0])])
        return pdf[["_s", "block", "source_size", "target", "_shards"]].rename(columns={"block": "_b"})

    dealt = drawn.join(_small(counts, len(place)), "place").groupBy("place").applyInPandas(cut, "_s string, _b int, source_size bigint, target double, _shards array<int>")
    path = scratch(spark, "blocks")
    dealt.write.parquet(path)
    return spark.read.parquet(path)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def mixed(docs: DataFrame, table: DataFrame) -> DataFrame:
    """docs (with _source and _block) and source_size, target and _shards of their blocks."""
    return docs.join(_small(table, table.count()), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))


def sized(docs: DataFrame, text: str, source: str, key: str, seed: int, blocks: int = BLOCKS) -> DataFrame:
    """Checkpointed (key, source, size, block): all that planning needs."""
    return keep(docs.select(key, F.col(source).cast("string").alias("source"), word_count(text).alias("size"), _block(key, text, blocks, seed).alias("block")))


def mix_report(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = SEED, blocks: int = BLOCKS, **how) -> DataFrame:
    """Per document: key, source, size, source_size, target, taken (words, repeats counted), copies and the shards that draw it."""
    base = sized(docs, text, source, key, seed, blocks)
    got = mixed(base.withColumnsRenamed({"source": "_source", "block": "_block"}), plan(base, seed=seed, **how))
    copies = F.size("_shards").cast("int")
    return got.select(
        key, F.col("_source").alias("source"), "size", "source_size", "target", (copies * F.col("size")).cast("bigint").alias("taken"), copies.alias("copies"), F.col("_shards").alias("shards")
    )


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = SEED, blocks: int = BLOCKS, **how) -> DataFrame:
    """The mix itself: docs' rows, each as often as shards draw its block, with mix_shard and mix_order, shuffled.

    Tasks hold PARTS parts of each shard, sorted by mix_order, so what is written is in the shuffled order.
    """
    names = [c for c in docs.columns if c not in ("mix_shard", "mix_order")]
    table = plan(sized(docs, text, source, key, seed, blocks), seed=seed, **how)
    kept = {c: f"_doc_{i}" for i, c in enumerate(names)}
    own = docs.select(*(F.col(quoted(c)).alias(n) for c, n in kept.items()))
    own = own.withColumns({"_source": F.col(kept[source]).cast("string"), "_block": _block(kept[key], kept[text], blocks, seed), "_h": permuted(kept[key], kept[text], seed)})
    drawn = mixed(own, table).select(*kept.values(), "_h", F.posexplode("_shards").alias("_draw", "mix_shard"))
    drawn = drawn.withColumn("mix_order", F.xxhash64("_h", "_draw", F.lit(seed)))
    part = F.shiftrightunsigned("mix_order", 64 - (PARTS - 1).bit_length())
    shards = how.get("shards", SHARDS)
    dealt = drawn.repartition(shards * PARTS, "mix_shard", part).sortWithinPartitions("mix_shard", "mix_order")
    return dealt.select(*(F.col(n).alias(c) for c, n in kept.items()), "mix_shard", "mix_order")
