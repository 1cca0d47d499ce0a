"""A stored full-text index with incremental upkeep.

The index is a folder of generations. Each holds the postings (bucket, term, window, path,
tf, n, positions) of some documents, laid out by bucket of term and sorted by term and
window, their lengths (path, n), and blocks (bucket, term, window, df, most, dense). A new
generation replaces what earlier ones say of its paths, also where a document is gone;
compacting makes one generation of all. A query reads the buckets of its terms only, never a
document's text; a prefix reads the sorted runs of all buckets.

Windows are runs of WINDOW documents in order of their length. A block is a term in a
window: how many documents hold it, how often at most, and at most how often a term of
length. Ranked search over words (`top`) reads blocks first: they bound each window's
scores, as a score rises with the hits and with the hits a term of length. Windows are scored from the best bound on, in
rounds that grow; each round raises the score to beat, and windows whose bound stays below
it are never read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import terms
from paperloom.operators.search import B, K1, Phrase, _all, _holds, idf, parse, phrases, posted
from paperloom.session import keep, spread

SCHEMAS = {
    "postings": "term string, window bigint, path string, tf bigint, n bigint, positions array<int>, generation int, bucket int",
    "blocks": "term string, window bigint, df bigint, most bigint, dense double, generation int, bucket int",
    "lengths": "path string, n bigint, generation int",
}
BUCKETS = 64
#: Documents of a window, and over how many files a bucket's windows are spread.
WINDOW, SPREAD = 128, 8
#: Windows of the first round of a ranked search, and the most that a round lists by number.
ROUND, LISTED = 4, 256
#: A term as it stands in a text.
TERM = r"[\p{L}\p{N}]+"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write(docs: DataFrame, folder: str, generation: int = 0, removed: DataFrame | None = None, key: str = "path", text: str = "content") -> None:
    """Write a generation with the postings of docs; removed (key) are documents that are gone. A null text has no terms.

    A document's terms meet within its row, so only finished postings are shuffled, once.
    """
    each = spread(docs.select(F.col(key).alias("path"), F.col(text).alias("_t"))).select("path", terms(F.col("_t")).alias("ts"))
    lengths = keep(each.select("path", F.size("ts").cast("bigint").alias("n")))
    rows = _windowed(each.withColumn("n", F.size("ts").cast("bigint")), lengths).mapInArrow(posted(["window", "path", "n"]), "term string, window bigint, path string, n bigint, tf bigint, positions array<int>")
    if removed is not None:
        lengths = lengths.unionByName(removed.select(F.col(key).alias("path"), F.lit(None).cast("bigint").alias("n")))
    _store(rows, folder, generation)
    lengths.write.mode("overwrite").parquet(f"{folder}/lengths/generation={generation}")


def _windowed(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """rows (path, n, ...) with window: documents in order of length (three digits of it), then of a hash, in runs of about WINDOW."""
    digits = F.greatest(F.length(F.col("n").cast("string")) - 3, F.lit(0))
    size = F.floor(F.col("n") / F.pow(F.lit(10), digits)) * F.pow(F.lit(10), digits).cast("bigint")
    counts = lengths.where("n IS NOT NULL").groupBy(size.alias("size")).count().orderBy("size").collect()  # 900 rows at most for each power of ten
    run, before = 0, []
    for r in counts:
        before.append((r["size"], r["count"], run))
        run += r["count"]
    table = rows.sparkSession.createDataFrame(before, "_size bigint, _count bigint, _before bigint")
    met = rows.withColumn("_size", size).join(F.broadcast(table), "_size")
    share = F.pmod(F.xxhash64("path"), F.lit(1 << 20)) / F.lit(1 << 20)
    return met.withColumn("window", F.floor((F.col("_before") + share * F.col("_count")) / WINDOW).cast("bigint")).drop("_size", "_count", "_before")


def _runs(batches):
    """Stored postings in their order in; a block for each run of a term in a window out. A run that is split between batches or tasks gives two."""
    for batch in batches:
        if not len(batch):
            continue
        words = batch.column("term").dictionary_encode()
        code, window, tf, n = words.indices.to_numpy(zero_copy_only=False), *(batch.column(c).to_numpy() for c in ("window", "tf", "n"))
        start = np.nonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (window[1:] != window[:-1])]))[0]
        rows = pa.array(start)
        yield pa.RecordBatch.from_arrays(
            [batch.column("bucket").take(rows), batch.column("term").take(rows), batch.column("window").take(rows), pa.array(np.diff(np.append(start, len(code)))), pa.array(np.maximum.reduceat(tf, start)), pa.array(np.maximum.reduceat(tf / n, start))],
            names=["bucket", "term", "window", "df", "most", "dense"],
        )


def _store(posted: DataFrame, folder: str, generation: int) -> None:
    """Write postings (term, path, positions, tf, n, window) and their blocks."""
    posted = posted.withColumn("bucket", _bucket(F.col("term")))
    # A frequent term's postings are spread over several files by window, so that a window's stand together.
    spread = posted.repartition("bucket", F.pmod(F.xxhash64("window"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term", "window", "path")
    spread.select("bucket", "term", "window", "path", "tf", "n", "positions").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings/generation={generation}")
    kept = _read(posted.sparkSession, folder, "postings").where(F.col("generation") == generation)
    blocks = kept.select("bucket", "term", "window", "tf", "n").mapInArrow(_runs, "bucket int, term string, window bigint, df bigint, most bigint, dense double")
    blocks.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/blocks/generation={generation}")


def _read(spark: SparkSession, folder: str, part: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[part]).option("basePath", f"{folder}/{part}").parquet(f"{folder}/{part}/generation=*")


def lengths(spark: SparkSession, folder: str) -> DataFrame:
    """(path, n, generation) of the documents that the index holds, each from its last generation."""
    last = _read(spark, folder, "lengths").groupBy("path").agg(F.max_by("n", "generation").alias("n"), F.max("generation").alias("generation"))
    return last.where("n IS NOT NULL")


def postings(spark: SparkSession, folder: str, words: list[str] | None = None, prefixes: list[str] = ()) -> DataFrame:
    """(term, path, tf, positions) of the wanted terms (default: all), of each document's last generation."""
    found = _read(spark, folder, "postings")
    if words is not None:
        wanted = [_of(spark, words)] if words else []
        wanted += [F.col("term").startswith(p) for p in prefixes]
        found = found.where(reduce(lambda a, b: a | b, wanted))
    return _current(spark, folder, found).select("term", "path", "tf", "positions", "n", "generation", "window")


def _current(spark: SparkSession, folder: str, found: DataFrame) -> DataFrame:
    """found without what later generations replace."""
    if len(_generations(spark, folder)) == 1:
        return found
    return found.join(lengths(spark, folder).select("path", "generation"), ["path", "generation"], "left_semi")


def _of(spark: SparkSession, words: list[str]) -> Column:
    """Whether a row is of one of the words; their buckets prune the folders."""
    row = spark.range(1).select(F.array(*[_bucket(F.lit(w)) for w in words])).first()[0]
    return F.col("bucket").isin(*sorted(set(row))) & F.col("term").isin(*sorted(set(words)))


def _generations(spark: SparkSession, folder: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/lengths")
    return sorted(int(s.getPath().getName().partition("=")[2]) for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path) if "=" in s.getPath().getName())


def update(docs: DataFrame, folder: str, removed: DataFrame | None = None, **names) -> None:
    """Add or replace documents, and drop removed ones, in a generation of their own."""
    write(docs, folder, _generations(docs.sparkSession, folder)[-1] + 1, removed, **names)


def _hits(phrase: Phrase, at: dict[str, str]) -> Column:
    """How often a phrase stands in a row that has each term's positions in a column; null positions are none."""
    return F.size(_starts(phrase, at))


def _moved(by: int):
    return lambda p: p - by


def _name(phrase: Phrase, i: int) -> str:
    return phrase.words[i] + ("*" if phrase.prefix and i == len(phrase.words) - 1 else "")


def search(spark: SparkSession, folder: str, query: str, limit: int | None = 20, among: DataFrame | None = None) -> DataFrame:
    """(path, score) as operators.search gives them, from the stored index; among (path) narrows before the limit."""
    tree = parse(query)
    ranked, every = phrases(tree), _all(tree)
    names = sorted({_name(p, i) for p in every for i in range(len(p.words))})
    words, prefixes = [n for n in names if not n.endswith("*")], [n[:-1] for n in names if n.endswith("*")]
    found, at = postings(spark, folder, words, prefixes), {n: f"_p{i}" for i, n in enumerate(names)}
    # Postings of one term and of all terms with a prefix are merged; a document has one row.
    wanted = [F.array_sort(F.flatten(F.collect_list(F.when(F.col("term").startswith(n[:-1]) if n.endswith("*") else F.col("term") == n, F.col("positions"))))).alias(c) for n, c in at.items()]
    rows = found.groupBy("path").agg(*wanted)
    count = {p: f"_f{i}" for i, p in enumerate(every)}
    rows = rows.select("path", *[_hits(p, at).alias(c) for p, c in count.items()])
    stats = rows.agg(F.lit(0).alias("_"), *[F.count_if(F.col(count[p]) > 0).alias(count[p]) for p in ranked]).first()
    known = lengths(spark, folder)
    total = known.agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
    met = rows.where(_holds(tree, count)).join(known.select("path", "n"), "path")
    score = F.lit(0.0)
    for p in ranked:
        f = F.col(count[p]).cast("double")
        score = score - F.lit(idf(total["n"], stats[count[p]])) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n") / F.lit(total["mean"] or 1.0)))
    if among is not None:
        met = met.join(among.select("path").distinct(), "path", "left_semi")
    out = met.select("path", score.alias("score")).orderBy("score", "path")
    return out if limit is None else out.limit(limit)


def top(spark: SparkSession, folder: str, query: str, limit: int = 20, heard: list | None = None) -> DataFrame:
    """(path, score): the limit best of search's rows, for queries whose phrases are all single words.

    Where another phrase occurs, search reads all postings, as the number of documents that
    hold a phrase stands in no block. heard takes (windows, postings) of each round, for tests.
    """
    tree = parse(query)
    ranked, every = phrases(tree), _all(tree)
    if any(len(p.words) > 1 or p.prefix for p in every):
        return search(spark, folder, query, limit)
    words = [p.words[0] for p in every]
    mine = _of(spark, words)
    blocks, found = _read(spark, folder, "blocks").where(mine), _read(spark, folder, "postings").where(mine)
    if len(_generations(spark, folder)) == 1:
        counts = blocks.groupBy("term").agg(F.sum("df").alias("df")).collect()
    else:  # blocks count replaced documents too; their bounds hold all the same
        counts = _current(spark, folder, found.select("path", "generation", "term")).groupBy("term").agg(F.count("*").alias("df")).collect()
    df = {r["term"]: r["df"] for r in counts}
    total = lengths(spark, folder).agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
    weight = {p: idf(total["n"], df.get(p.words[0], 0)) for p in ranked}

    mean = total["mean"] or 1.0

    def part(p: Phrase, f: Column, n: Column) -> Column:
        f = f.cast("double")
        return F.lit(weight[p]) * f * (K1 + 1) / (f + K1 * (1 - B + B * n / F.lit(mean)))

    def at_most(p: Phrase, f: Column, dense: Column) -> Column:
        """part with f above and below divided by f."""
        return F.lit(weight[p]) * (K1 + 1) / (1 + K1 * (1 - B) / f + K1 * B / (dense * mean))

    at = {p: i for i, p in enumerate(every)}
    of = lambda p, c: F.max(F.when(F.col("term") == p.words[0], F.col(c)))
    windows = blocks.groupBy("generation", "window").agg(*[of(p, "most").alias(f"_f{i}") for p, i in at.items()], *[of(p, "dense").alias(f"_d{i}") for p, i in at.items()])
    windows = windows.fillna(0, [f"_f{i}" for i in at.values()])
    bound = F.lit(0.0)
    for p in ranked:
        bound = bound + F.when(F.col(f"_f{at[p]}") > 0, at_most(p, F.col(f"_f{at[p]}"), F.col(f"_d{at[p]}"))).otherwise(0.0)
    # A document may lack what its window has: only what must be there narrows.
    windows = keep(windows.where(_may_hold(tree, {p: f"_f{i}" for p, i in at.items()})).select("generation", "window", (bound * (1 + 1e-9)).alias("bound")))
    best, beat, size, last = None, None, ROUND, None
    while True:
        left = windows
        if last is not None:
            left = left.where((F.col("bound") < last[0]) | ((F.col("bound") == last[0]) & ((F.col("generation") > last[1]) | ((F.col("generation") == last[1]) & (F.col("window") > last[2])))))
        if beat is not None:
            left = left.where(F.col("bound") >= beat)
        if size > LISTED:
            chosen, wide = left, True
        else:
            rows = left.orderBy(F.desc("bound"), "generation", "window").limit(size).collect()
            if not rows:
                break
            last, wide = tuple(rows[-1][c] for c in ("bound", "generation", "window")), False
        if wide:
            if left.isEmpty():
                break
            these = found.join(chosen.select("generation", "window"), ["generation", "window"], "left_semi")
        else:
            sets = {}
            for r in rows:
                sets.setdefault(r["generation"], []).append(r["window"])
            these = found.where(reduce(lambda a, b: a | b, [(F.col("generation") == g) & F.col("window").isin(*ws) for g, ws in sets.items()]))
        if heard is not None:
            heard.append((len(rows) if not wide else left.count(), these.count()))
        met = _current(spark, folder, these.select("path", "generation", "term", "tf", "n")).groupBy("path").agg(F.max("n").alias("n"), *[F.coalesce(of(p, "tf"), F.lit(0)).alias(f"_f{i}") for p, i in at.items()])
        score = F.lit(0.0)
        for p in ranked:
            score = score - part(p, F.col(f"_f{at[p]}"), F.col("n"))
        scored = met.where(_holds(tree, {p: f"_f{i}" for p, i in at.items()})).select("path", score.alias("score"))
        best = keep((scored if best is None else best.unionByName(scored)).orderBy("score", "path").limit(limit))
        state = best.agg(F.count("*").alias("n"), F.max("score").alias("worst")).first()
        if state["n"] >= limit:
            beat = -state["worst"]
        if wide:
            break
        size *= 4
    if best is None:
        return spark.createDataFrame([], "path string, score double")
    return best.orderBy("score", "path")


def _may_hold(tree, most: dict[Phrase, str]) -> Column:
    """Whether a window may have a document that the query finds."""
    if isinstance(tree, Phrase):
        return F.col(most[tree]) > 0
    if tree[0] == "not":
        return _may_hold(tree[1], most)
    a, b = _may_hold(tree[1], most), _may_hold(tree[2], most)
    return a & b if tree[0] == "and" else a | b


def compact(spark: SparkSession, folder: str, into: str) -> None:
    """One generation of all, in another folder."""
    known = lengths(spark, folder).select("path", "n")
    _store(_windowed(postings(spark, folder).select("term", "path", "positions", "tf", "n"), known), into, 0)
    known.write.parquet(f"{into}/lengths/generation=0")


def marked(spark: SparkSession, folder: str, query: str, found: DataFrame, docs: DataFrame, width: int = 12, key: str = "path", text: str = "content") -> DataFrame:
    """found with a snippet of each hit: the run of width terms with most of the query's phrases, the first of such.

    The run is chosen from stored positions; texts are read for the hits alone. Terms show as
    in the text with single blanks between, those of a phrase in brackets, and … where the
    text goes on. Phrases of NOT's right side don't count; a prefix and a phrase's words do.
    """
    ranked = phrases(parse(query))
    names = sorted({_name(p, i) for p in ranked for i in range(len(p.words))})
    words, prefixes = [n for n in names if not n.endswith("*")], [n[:-1] for n in names if n.endswith("*")]
    at = {n: f"_p{i}" for i, n in enumerate(names)}
    posted = postings(spark, folder, words, prefixes).join(F.broadcast(found.select(F.col("path"))), "path")  # at most the hits asked for
    wanted = [F.array_sort(F.flatten(F.collect_list(F.when(F.col("term").startswith(n[:-1]) if n.endswith("*") else F.col("term") == n, F.col("positions"))))).alias(c) for n, c in at.items()]
    rows = posted.groupBy("path").agg(*wanted)
    starts = [_starts(p, at).alias(f"_s{i}") for i, p in enumerate(ranked)]
    rows = rows.select("path", *starts)
    ends = F.array_sort(F.array_distinct(F.concat(*[F.transform(f"_s{i}", _moved(1 - len(p.words))) for i, p in enumerate(ranked)])))

    def count(end: Column) -> Column:
        first = F.greatest(end - (width - 1), F.lit(0))
        inside = [F.exists(f"_s{i}", _within(first, width - len(p.words))).cast("int") for i, p in enumerate(ranked)]
        return F.struct(reduce(lambda a, b: a + b, inside).alias("n"), (-first).alias("first"))

    rows = rows.withColumn("_first", -F.array_max(F.transform(ends, count))["first"])
    hit = reduce(lambda a, b: F.concat(a, b), [F.flatten(F.transform(f"_s{i}", _span(len(p.words)))) for i, p in enumerate(ranked)])
    texts = docs.select(F.col(key).alias("path"), F.regexp_extract_all(F.col(text), F.lit(TERM), F.lit(0)).alias("_ts"))
    shown = rows.select("path", "_first", hit.alias("_hit")).join(texts, "path")
    word = lambda t, i: F.when(F.array_contains("_hit", i + F.col("_first")), F.concat(F.lit("["), t, F.lit("]"))).otherwise(t)
    body = F.array_join(F.transform(F.slice("_ts", F.col("_first") + 1, width), word), " ")
    snippet = F.concat(F.when(F.col("_first") > 0, "… ").otherwise(""), body, F.when(F.col("_first") + width < F.size("_ts"), " …").otherwise(""))
    return found.join(shown.select("path", snippet.alias("snippet")), "path")


def _starts(phrase: Phrase, at: dict[str, str]) -> Column:
    """The positions where a phrase begins."""
    none = F.array().cast("array<int>")
    return reduce(F.array_intersect, [F.transform(F.coalesce(F.col(at[_name(phrase, i)]), none), _moved(i)) for i in range(len(phrase.words))])


def _within(first: Column, more: int):
    return lambda s: (s >= first) & (s <= first + more)


def _span(n: int):
    return lambda s: F.sequence(s, s + (n - 1))


def snippets(found: DataFrame, docs: DataFrame, words: list[str], key: str = "path", text: str = "content") -> DataFrame:
    """found with a snippet of each hit; only the texts of the hits are read."""
    from paperloom.operators.search import snippet

    return found.join(docs.select(key, text), key).withColumn("snippet", snippet(F.col(text), words)).drop(text)

