"""Parallel bins against filling one after another."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators.binning import greedy_bins


def plain(rows, budget):
    """{(group, order): bin} of (group, order, size) rows."""
    out, now, used, number = {}, object(), 0, 0
    for g, o, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        n = max(n or 0, 0)
        if g != now:
            now, used, number, held = g, 0, 1, False
        if held and used + n > budget:
            number, used = number + 1, 0
        used, held = used + n, True
        out[g, o] = number
    return out


@pytest.mark.parametrize("seed,budget,parts", [(1, 10, 4), (2, 100, 9), (3, 1, 3), (4, 1000, 16), (5, 7, 1), (6, 0, 5), (7, 60, 25)])
def test_bins_against_a_fold(spark, seed, budget, parts):
    r = random.Random(seed)
    sizes = [0, 0, 1, 2, 3, 5, 8, budget, budget + 1, 3 * budget + 2, None, -4]
    groups = [("hot", 400), ("a", 3), ("b", 1), (None, 30), ("z", 90)]
    rows = [(g, i, r.choice(sizes)) for g, n in groups for i in range(n)]
    r.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "g string, o int, n int").repartition(3)
        got = {(x["g"], x["o"]): x["bin"] for x in greedy_bins(df, budget, "n", ["o"], ["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == plain(rows, budget)


def test_bins_of_one_group_of_many_rows_use_many_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(0, 1_000_000, 1, 4).select("id", (F.pmod(F.xxhash64("id"), F.lit(100)) + 1).alias("n"))
        done = greedy_bins(rows, 5_000, "n", ["id"], to="at")
        shares = [r["k"] for r in done.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("k")).collect()]
        assert len(shares) >= 20 and max(shares) < 100_000
        got = [r["at"] for r in done.orderBy("id").collect()]
        sizes = [r["n"] for r in rows.orderBy("id").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    number, used = 1, 0
    for n, at in zip(sizes, got):
        if used + n > 5_000:
            number, used = number + 1, 0
        used += n
        assert at == number


def test_bins_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, o int, n int")
    assert greedy_bins(empty, 5, "n", ["o"], ["g"]).collect() == [] and greedy_bins(empty, 5, "n", ["o"]).columns == ["o", "n", "bin"]


def test_bins_of_budgets_of_their_own(spark):
    rows = [(g, i, i % 4, 3 + k) for k, g in enumerate("abc") for i in range(40)]
    got = {(x["g"], x["o"]): x["bin"] for x in greedy_bins(spark.createDataFrame(rows, "g string, o int, n int, most int"), "most", "n", ["o"], ["g"]).collect()}
    for k, g in enumerate("abc"):
        assert {x: b for x, b in got.items() if x[0] == g} == plain([(g, i, i % 4) for i in range(40)], 3 + k)
