"""Line differences of texts, by lines that stand equally often on either side.

Lines of both texts are rows. In each round every gap between lines already matched gives
its equal lines at the head and at the tail, and of the rest those that stand in it once, or
equally often, on both sides (the first with the first, and so on) and keep their order (the
longest such run): these split the gap. A gap without such lines takes those that stand on both
sides at all. A round that finds none leaves no gap with a line on both sides: what is left
is removed on one side and added on the other. All joins and counts are by (text,
gap, line) or (text, gap, place); only the longest run of one gap, two numbers a line, is
found by a small function.

A gap is known by the old side's number of the matched line before it, which both sides know.

Defined cases: a null or empty text has no lines; a line end at the end of a text makes no
line; texts with a null key are dropped, keys must be unique otherwise; a key on one side only
has all its lines removed or added; equal texts have no hunks.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.udf import arrow_udf
from paperloom.session import keep


@arrow_udf("array<int>")
def rising(numbers: pd.Series) -> pd.Series:
    """The places (from 0) of one longest rising run of each list of distinct numbers."""

    def one(values) -> list[int]:
        tops, at, before = [], [], []
        for place, v in enumerate(values):
            k = bisect_left(tops, v)
            before.append(at[k - 1] if k else -1)
            if k == len(tops):
                tops.append(v)
                at.append(place)
            else:
                tops[k], at[k] = v, place
        run, place = [], at[-1] if at else -1
        while place >= 0:
            run.append(place)
            place = before[place]
        return run[::-1]

    return numbers.map(one)


def lines(texts: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, i, line) of the lines of texts, numbered from 1."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    cells = F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))
    return texts.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.posexplode(cells).alias("i", "line")).withColumn("i", F.col("i") + 1)


def _gaps(side: DataFrame, at: str, fresh: DataFrame | None = None) -> DataFrame:
    """(key, gap, at, h, p, q) of side's lines (key, gap, at, h) that fresh leaves open; p and q count from the gap's head and tail."""
    if fresh is not None:
        marked = side.select("key", "gap", at, "h").join(fresh.select("key", "gap", at, F.col("i").alias("hit")), ["key", "gap", at], "left")
        before = F.last("hit", True).over(Window.partitionBy("key", "gap").orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
        side = marked.withColumn("to", F.coalesce(before, "gap")).where("hit IS NULL").select("key", F.col("to").alias("gap"), at, "h")
    w = Window.partitionBy("key", "gap")
    return side.withColumn("p", F.row_number().over(w.orderBy(at))).withColumn("q", F.count("*").over(w) - F.col("p") + 1)


def matched(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, i, j) of the lines (key, i, line) of old and new that stay, in rising order on both sides."""
    # Every round shuffles the digests of all open lines; half of SHA-256 is enough to tell lines apart.
    digest = F.substring(F.unhex(F.sha2("line", 256)), 1, 16).alias("h")
    whole = F.lit(0).alias("gap")
    ga = keep(_gaps(old.select("key", whole, "i", digest), "i"))
    gb = keep(_gaps(new.select("key", whole, F.col("i").alias("j"), digest), "j"))
    found = None
    while True:
        by = lambda at: ga.select("key", "gap", at, "i", F.col("h").alias("ha")).join(gb.select("key", "gap", at, "j", F.col("h").alias("hb")), ["key", "gap", at])
        first = lambda at, name: by(at).groupBy("key", "gap").agg(F.count("*").alias("n"), F.coalesce(F.min(F.when(F.col("ha") != F.col("hb"), F.col(at))) - 1, F.count("*")).alias(name))
        ends = first("p", "head").join(first("q", "tail").drop("n"), ["key", "gap"]).select("key", "gap", "head", F.least("tail", F.col("n") - F.col("head")).alias("tail"))
        ends = keep(ends)
        heads = by("p").join(ends, ["key", "gap"]).where("p <= head").select("key", "gap", "i", "j")
        tails = by("q").join(ends, ["key", "gap"]).where("q <= tail").select("key", "gap", "i", "j")
        alike = Window.partitionBy("key", "gap", "h")
        inner = lambda g, at: g.join(ends, ["key", "gap"]).where("p > head AND q > tail").select("key", "gap", "h", at, F.row_number().over(alike.orderBy(at)).alias("k"), F.count("*").over(alike).alias(f"n{at}"))
        # A gap's anchors are two numbers a line of one text, which came from one cell.
        pairs = inner(ga, "i").join(inner(gb, "j"), ["key", "gap", "h", "k"])
        pairs = pairs.withColumn("some", F.max(F.expr("ni = nj")).over(Window.partitionBy("key", "gap"))).where("ni = nj OR NOT some")
        anchors = pairs.groupBy("key", "gap").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("both"))
        run = anchors.select("key", "gap", "both", F.explode(rising(F.transform("both", lambda x: x["j"]))).alias("at")).select("key", "gap", F.get("both", F.col("at")).alias("m")).select("key", "gap", "m.i", "m.j")
        fresh = keep(heads.unionByName(tails).unionByName(run))
        found = fresh if found is None else found.unionByName(fresh)
        if fresh.isEmpty():
            return found.drop("gap")
        # Only what is open goes on.
        ga, gb = keep(_gaps(ga, "i", fresh)), keep(_gaps(gb, "j", fresh))


def edits(old: DataFrame, new: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, place, sign, i, j, line): what makes new of old, in order.

    sign is a blank for lines that stay, - for lines of old and + for lines of new; i and j
    are line numbers, of the line before where a side has none.
    """
    a, b = lines(old, key, text), lines(new, key, text)
    same = matched(a, b)
    # The gap that a line stands in, and within it removed before added before the line that ends it.
    count = lambda at, other: F.coalesce(F.count(other).over(Window.partitionBy("key").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = a.join(same, ["key", "i"], "left").select("key", "i", "j", "line")
    left = left.withColumn("gap", count("i", "j")).withColumn("kind", F.when(F.col("j").isNull(), 0).otherwise(2))
    right = b.withColumnRenamed("i", "j").join(same.select("key", "j", "i"), ["key", "j"], "left").select("key", "i", "j", "line")
    right = right.withColumn("gap", count("j", "i")).where("i IS NULL").withColumn("kind", F.lit(1))
    w = Window.partitionBy("key").orderBy("gap", "kind", F.coalesce("i", "j"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    sign = F.when(F.col("kind") == 0, "-").when(F.col("kind") == 1, "+").otherwise(" ")
    return left.unionByName(right).select("key", F.row_number().over(w).alias("place"), sign.alias("sign"), F.coalesce("i", F.max("i").over(upto), F.lit(0)).alias("i"), F.coalesce("j", F.max("j").over(upto), F.lit(0)).alias("j"), "line")


def _span(first: Column, n: Column) -> Column:
    """A hunk's range as it is written: the line before where it holds none, the length unless it is one."""
    return F.concat(F.when(n == 0, first - 1).otherwise(first).cast("string"), F.when(n == 1, "").otherwise(F.concat(F.lit(","), n.cast("string"))))


def hunks(changes: DataFrame, context: int = 3) -> DataFrame:
    """(key, hunk, head, body) of edits: changed lines with context lines around them; hunks that touch are one."""
    w = Window.partitionBy("key").orderBy("place")
    near = F.max(F.col("sign") != " ").over(w.rowsBetween(-context, context))
    shown = changes.withColumn("near", near).where("near").withColumn("new", F.coalesce(F.col("place") - F.lag("place").over(w) > 1, F.lit(True)))
    shown = shown.withColumn("hunk", F.count_if("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = lambda other: F.count_if(F.col("sign") != other)
    first = lambda at, other: F.coalesce(F.min(F.when(F.col("sign") != other, F.col(at))), F.max(at) + 1)
    got = shown.groupBy("key", "hunk").agg(
        first("i", "+").alias("a"), n("+").alias("an"), first("j", "-").alias("b"), n("-").alias("bn"), F.array_sort(F.collect_list(F.struct("place", F.concat("sign", "line").alias("line")))).alias("rows")
    )
    head = F.concat(F.lit("@@ -"), _span(F.col("a"), F.col("an")), F.lit(" +"), _span(F.col("b"), F.col("bn")), F.lit(" @@"))
    return got.select("key", "hunk", head.alias("head"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("body"))


def unified(old: DataFrame, new: DataFrame, key: str = "key", text: str = "text", names: tuple[str, str] = ("a", "b"), context: int = 3) -> DataFrame:
    """(key, diff) of the texts that differ, as a unified difference."""
    rows = hunks(edits(old, new, key, text), context).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("hunk", F.concat("head", F.lit("\n"), "body").alias("t")))).alias("h"))
    return rows.select("key", F.concat_ws("\n", F.lit(f"--- {names[0]}"), F.lit(f"+++ {names[1]}"), F.array_join(F.transform("h", lambda x: x["t"]), "\n")).alias("diff"))
