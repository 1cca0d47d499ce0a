"""Exact groups and perceptual near-duplicates."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.graph import components


#: What a probe costs, in comparisons, and the most probes of a signature.
PROBE_COST, MOST_PROBES = 50, 5_000


def exact_groups(files: DataFrame, path: str = "path", digest: str = "hash") -> DataFrame:
    """(hash, n_files, first, last): groups of more than one file."""
    return files.groupBy(digest).agg(F.count("*").alias("n_files"), F.min(path).alias("first"), F.max(path).alias("last")).where("n_files > 1")


def kept_and_reclaimable(files: DataFrame, path: str = "path", digest: str = "hash", size: str = "size", order: str = "mtime") -> DataFrame:
    """(hash, kept, n_deleted, reclaimable): the oldest file of a group is kept."""
    oldest = F.struct(F.col(order), F.col(path))
    grouped = files.groupBy(digest).agg(F.count("*").alias("n"), F.min_by(path, oldest).alias("kept"), F.sum(size).alias("total"), F.min_by(size, oldest).alias("own"))
    return grouped.where("n > 1").select(digest, "kept", (F.col("n") - 1).alias("n_deleted"), (F.col("total") - F.col("own")).alias("reclaimable"))


def gradient_bits(vector: Column) -> Column:
    """63 bits: whether each component is below the next."""
    steps = F.zip_with(F.slice(vector, 1, 63), F.slice(vector, 2, 63), lambda a, b: F.when(a < b, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(x))


def _balls(bits: int, radius: int) -> int:
    """How many codes of so many bits lie within the radius."""
    return sum(comb(bits, i) for i in range(radius + 1))


def bands_for(rows: int, most: int, bits: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each band of a multi-index for pairs at a distance of most or less.

    With k bands and most = k * a + b, such a pair is within a in one of the first b + 1 bands
    or within a - 1 in one of the others: else its distance were more. Few wide bands make few
    candidates and many probes; k is what costs least for so many rows, a probe being a
    shuffled row and a candidate a comparison in a task.
    """
    best = None
    for k in range(1, most + 2):
        a, b = divmod(most, k)
        edges = [bits * i // k for i in range(k + 1)]
        bands = [(edges[i], edges[i + 1] - edges[i], a if i <= b else a - 1) for i in range(k) if (a if i <= b else a - 1) >= 0]
        probes = sum(_balls(w, r) for _, w, r in bands)
        candidates = sum(_balls(w, r) / 2**w for _, w, r in bands)
        cost = rows * probes * PROBE_COST + rows * rows / 2 * candidates
        if probes <= MOST_PROBES and (best is None or cost < best[0]):
            best = cost, bands
    return best[1]


def near_pairs(rows: DataFrame, most: int = 8, key: str = "path", signature: str = "dhash", bits: int = 63, bands: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """(a, b, distance) of all pairs at Hamming distance of most or less.

    Multi-index hashing: one side stores each band of its signatures, the other probes all
    codes within the band's radius, so no such pair is missed. A pair counts in the first band
    that brings it together, so none comes twice. For 63 random bits the candidates are 0.3 %
    of all pairs at a distance of 8 and four bands; at 16 no choice of bands makes few.
    """
    bands = bands or bands_for(rows.count(), most, bits)
    part = lambda s, i: F.shiftright(s, bands[i][0]).bitwiseAND(F.lit((1 << bands[i][1]) - 1))
    masks = [[sum(1 << p for p in c) for r in range(radius + 1) for c in combinations(range(width), r)] for _, width, radius in bands]
    near = lambda i: F.transform(F.from_json(F.lit(str(masks[i])), "array<bigint>"), lambda m: F.struct(F.lit(i).alias("band"), part(F.col("sa"), i).bitwiseXOR(m).alias("bits")))
    probes = rows.select(F.col(key).alias("a"), F.col(signature).alias("sa")).where("sa IS NOT NULL")
    probes = probes.select("a", "sa", F.explode(F.flatten(F.array(*[near(i) for i in range(len(bands))]))).alias("p")).select("a", "sa", "p.band", "p.bits")
    stored = rows.select(F.col(key).alias("b"), F.col(signature).alias("sb")).where("sb IS NOT NULL")
    stored = stored.select("b", "sb", F.posexplode(F.array(*[part(F.col("sb"), i) for i in range(len(bands))])).alias("band", "bits"))
    apart = F.col("sa").bitwiseXOR(F.col("sb"))
    distance = F.bit_count(apart)
    earlier = F.lit(False)
    for i, (_, _, radius) in enumerate(bands):
        earlier = earlier | ((F.col("band") > i) & (F.bit_count(part(apart, i)) <= radius))
    return probes.join(stored, ["band", "bits"]).where(F.col("a") < F.col("b")).where(distance <= most).where(~earlier).select("a", "b", distance.cast("bigint").alias("distance"))


def near_clusters(pairs: DataFrame) -> DataFrame:
    """(node, component) of the files with a near pair."""
    return components(pairs)


def same_as(docs: DataFrame, order: list[str], path: str = "path", text: str = "content") -> DataFrame:
    """docs' path with same_as: the first path, in the given order, that has the same content (null for it)."""
    w = Window.partitionBy(F.sha2(text, 256)).orderBy(*order)
    first = F.first_value(path).over(w)
    return docs.select(path, F.when(F.row_number().over(w) > 1, first).alias("same_as"))
