"""Packing files into budgeted bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import fence, token_estimate
from paperloom.operators.binning import greedy_bins
from paperloom.operators.graph import cut


def skip_reason(size: Column, kind: Column, most: int) -> Column:
    """Why a file is not inlined, before any budget: too large, binary, image; null if it may be."""
    return F.when(size > most, "too-large").when(kind == "image", "image").when(kind == "binary", "binary")


def within_budget(files: DataFrame, budget: int, order: list[str], size: str = "size", skipped: str = "skipped") -> DataFrame:
    """files with the reason over-budget from the first file on that would exceed the budget.

    The running sum is over files in one global order. It is taken in two steps, so that no
    task sorts all rows: sums of ranges of the order first, then within each range.
    """
    live = F.when(F.col(skipped).isNull(), F.col(size)).otherwise(0)
    ranged = files.withColumn("_live", live).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged)
    sums = ranged.groupBy("_part").agg(F.sum("_live").alias("n")).orderBy("_part").collect()  # one row per partition
    before, run = {}, 0
    for p, n in sums:
        before[p] = run
        run += n or 0
    table = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    inner = F.sum("_live").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = inner + F.try_element_at(table, F.col("_part"))
    return ranged.withColumn("_sum", total).withColumn(skipped, F.coalesce(skipped, F.when(F.col("_sum") > budget, "over-budget"))).drop("_live", "_part", "_sum")


def chunks(files: DataFrame, budget: int, group: str, order: list[str], tokens: str = "tokens") -> DataFrame:
    """files with chunk: the greedy bin, in order within each group, of at most budget tokens (a larger file fills one)."""
    return greedy_bins(files, budget, tokens, order, [group], "chunk")


def stats(files: DataFrame) -> DataFrame:
    """(included, skipped, bytes, tokens) of a pack."""
    inside = F.col("skipped").isNull()
    return files.agg(
        F.count_if(inside).alias("included"), F.count_if(~inside).alias("skipped"), F.coalesce(F.sum(F.when(inside, F.col("size"))), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.when(inside, F.col("tokens"))), F.lit(0)).alias("tokens"),
    )


def markdown_section(path: Column, text: Column, language: str = "") -> Column:
    return F.concat(F.lit("## "), path, F.lit("\n\n"), fence(text), F.lit(language + "\n"), text, F.lit("\n"), fence(text), F.lit("\n"))
