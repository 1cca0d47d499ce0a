"""Connected components and reply chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import keep as cut


#: Edges of one task: fewer make one task, in which a round needs no shuffle.
TASK_EDGES = 100_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable from each node that has an edge to another.

    Alternates large-star and small-star steps: each node links its larger neighbours, then
    its smaller ones, to the least node it knows. Every step is one grouped minimum and one
    join on a table of at most twice as many rows as there are edges; hubs are met by the partial
    aggregation and by adaptive splitting of the join. Only a row count and a checksum reach
    the driver, and rounds go on until neither changes. A round has as many tasks as its
    edges ask for, not as many as the table that they come from.
    """

    def state(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def pairs(rows, *two):
        return rows.select(F.explode(F.array(*[F.struct(u.alias("u"), v.alias("v")) for u, v in two])).alias("e")).select("e.u", "e.v")

    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before, now = None, state(e)
    while now != before:
        tasks = now[0] // TASK_EDGES + 1
        e = e.coalesce(tasks)
        # Large star: every neighbour larger than u is linked to the least of u and its neighbours.
        both = pairs(e, (F.col("u"), F.col("v")), (F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.coalesce(1) if tasks == 1 else large
        # Small star: every smaller neighbour, and u itself, is linked to the least of them.
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = pairs(joined, (F.col("v"), F.col("m")), (F.col("u"), F.col("m")))
        e = cut(small.where("u <> v").distinct())
        before, now = now, state(e)
    stars = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("u")).distinct().join(stars, "u", "left_anti")
    return stars.select(F.col("u").alias("node"), "component").unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("component")))


def depths(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """rows with depth: 1 for nodes whose parent is absent, one more than the parent's else; null in cycles.

    Each node points to an ancestor and knows the distance; in each round it goes on by what
    that one knows, so chains halve. A round in which no node ends leaves cycles only.
    """
    known = cut(rows.groupBy(F.col(node).alias("_n")).agg(F.min(parent).alias("_p")))
    ids = known.select(F.col("_n").alias("_to"), F.lit(True).alias("_is"))
    state = known.withColumnRenamed("_p", "_to").join(ids, "_to", "left").select("_n", F.when(F.col("_is"), F.col("_to")).alias("_to"), F.when(F.col("_is"), 1).otherwise(0).cast("bigint").alias("_d"))
    state = cut(state)
    left = state.where("_to IS NOT NULL").count()
    while left:
        next_ = state.select(F.col("_n").alias("_to"), F.col("_to").alias("_next"), F.col("_d").alias("_more"))
        going = state.where("_to IS NOT NULL").join(next_, "_to").select("_n", F.col("_next").alias("_to"), (F.col("_d") + F.col("_more")).alias("_d"))
        state = cut(state.where("_to IS NULL").unionByName(going))
        now = state.where("_to IS NOT NULL").count()
        if now == left:
            break
        left = now
    done = state.where("_to IS NULL").select("_n", (F.col("_d") + 1).alias("depth"))
    return rows.join(done, rows[node] == done["_n"], "left").drop("_n")


def chain_lengths(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, depth) like depths, but whole: a node in a loop has the loop's length, one that leads into it as many more as it is away.

    Loops are rare and cost nothing where there are none: only nodes without an end are
    followed, by jumps of doubling length, after which what is still reached is the loops.
    """
    known = cut(rows.groupBy(F.col(node).alias("n_")).agg(F.min(parent).alias("p_")))
    deep = cut(depths(known, "n_", "p_"))
    open_ = cut(deep.where("depth IS NULL").select("n_", "p_"))
    count, jump = open_.count(), 1
    if not count:
        return deep.select(F.col("n_").alias(node), "depth")
    state = open_
    while jump < count:
        state = cut(state.join(state.select(F.col("n_").alias("p_"), F.col("p_").alias("_next")), "p_").select("n_", F.col("_next").alias("p_")))
        jump *= 2
    on_loop = state.select(F.col("p_").alias("n_")).distinct()
    around = components(open_, "n_", "p_").select(F.col("node").alias("n_"), "component")
    # A message that answers itself is a loop of one.
    around = open_.select("n_").join(around, "n_", "left").select("n_", F.coalesce("component", "n_").alias("component"))
    length = around.join(on_loop, "n_").groupBy("component").agg(F.count("*").alias("length"))
    ends = open_.join(on_loop.withColumn("_on", F.lit(True)), "n_", "left").select("n_", F.when(F.col("_on").isNull(), F.col("p_")).alias("p_"))
    away = depths(ends, "n_", "p_").select("n_", (F.col("depth") - 1).alias("away"))
    looped = away.join(around, "n_").join(length, "component").select("n_", (F.col("away") + F.col("length")).alias("depth"))
    return deep.where("depth IS NOT NULL").select("n_", "depth").unionByName(looped).withColumnRenamed("n_", node)
