"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of postings (term, document, position) of training tokens, written once
to the shared folder as Parquet, each file sorted by term, so that a term's list is a short
run of a file and other terms' row groups are skipped. It may hold all terms or those of a
vocabulary; decontamination indexes the terms that test items have, as no other term can
take part in a match.

A test window is looked up from its rarest term: each posting of that term is a place where
the window could stand. These places are intersected with the list of the second rarest
term, at its offset from the first or anywhere within slop words, and what is left with the
lists of all other terms. A place at which every term has a posting at its own offset is an
exact match; one at which every term has a posting within slop words is a proximity match.
Windows that several items share are looked up once.

All is DataFrame functions, and no row holds more than one posting or one window: lists meet
in equi-joins on document, term and a bucket of positions, so neither a long text nor a
frequent term or passage gathers in one task. Tables made of the test items are broadcast
only below a checked number of words. Before the last intersection, postings of documents
without a place left are passed over by a broadcast set of at most SIEVE hash values.

Words: A-Z in lower case, runs of characters other than ASCII non-alphanumerics, compared by
64-bit hashes. Positions count the pieces between separators, so in a text that begins with
a separator the first word has position 1.

Defined cases: null and empty texts have no words; items without words, and null items, match
nothing; items of null id count as one item without a name; items shorter than the window are
one window; repeated rows are judged alike; equal ids with different texts are judged apart;
empty tables give empty or clean results; extra columns pass through decontaminate whatever
their names, those named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.store import keep, quoted, scratch

WINDOW, SLOP = 10, 20
#: Up to so many test words, what is made of them (about 200 bytes a word) is broadcast.
BROADCAST_WORDS = 200_000
#: Values of the sieve of documents.
SIEVE = 1 << 18

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(word: Column) -> Column:
    """A-Z in lower case and nothing else changed; the fast lower() serves where all is ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _pieces(text: Column) -> Column:
    """Words as they stand between separators; the first or last may be empty."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATORS)


def item_words(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, w) of the items that have words, folded."""
    words = F.transform(F.array_remove(_pieces(F.col(text)), ""), fold)
    return items.select(F.col(key).alias("item_id"), words.alias("w")).where(F.size("w") > 0).distinct()


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", terms: DataFrame | None = None, small: bool = True, path: str | None = None) -> DataFrame:
    """The stored index (term, k, t, pos) of docs, written below path (default: the shared folder) and read from there.

    t is a hash of the text, so that equal keys with other texts are told apart. terms: a
    vocabulary (term) of hashes outside of which no posting is stored.
    """
    each = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("t"), F.posexplode(_pieces(F.col(text))).alias("pos", "word")).where("word <> ''")
    found = each.select(F.xxhash64(fold(F.col("word"))).alias("term"), "k", "t", "pos")
    if terms is not None:
        found = found.join(F.broadcast(terms) if small else terms, "term", "left_semi")
    path = path or scratch(docs.sparkSession, "postings")
    found.sortWithinPartitions("term").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def windows_of(words: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """((item_id, wid) of the items' windows, (wid, w) of the distinct windows)."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = words.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, window))).alias("w"))
    named = cut.withColumn("wid", F.xxhash64("w", F.size("w")))
    return named.select("item_id", "wid").distinct(), named.select("wid", "w").dropDuplicates(["wid"])


def plans(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(wid, n, term, offset, rest): a window's rarest term, its place, and the others (at, term, away) from rare to frequent.

    Ties go to the smaller word, then the smaller place; away is the way from the rarest
    term's place. Windows with a term that the corpus lacks are left out.
    """
    placed = windows.select("wid", F.posexplode("w").alias("offset", "word")).withColumn("term", F.xxhash64("word"))
    known = placed.join(counts, "term").groupBy("wid").agg(F.array_sort(F.collect_list(F.struct("n", "word", "offset", "term"))).alias("o"))
    full = known.join(windows.select("wid", F.size("w").alias("n")), "wid").where(F.size("o") == F.col("n"))
    first = F.get("o", F.lit(0))
    rest = F.transform(F.slice("o", 2, 1 << 20), lambda x, i: F.struct(i.alias("at"), x["term"].alias("term"), (x["offset"] - F.get("o", F.lit(0))["offset"]).alias("away")))
    return full.select("wid", "n", first["term"].alias("term"), first["offset"].alias("offset"), rest.alias("rest"))


def _meet(places: DataFrame, lists: DataFrame, reach: int) -> DataFrame:
    """places (..., k, t, p, other: (at, term, away)) joined with the postings of the other term within reach words: adds q."""
    width = 2 * reach + 1
    low, high = F.floor(F.greatest(F.col("p") - reach, F.lit(0)) / width), F.floor((F.col("p") + reach) / width)
    asked = places.withColumn("b", F.explode(F.sequence(low, high)))
    held = lists.select(F.col("term").alias("_term"), F.col("k").alias("_k"), F.col("t").alias("_t"), F.col("pos").alias("q"), F.floor(F.col("pos") / width).alias("_b"))
    on = F.col("k").eqNullSafe(F.col("_k")) & (F.col("t") == F.col("_t")) & (F.col("other.term") == F.col("_term")) & (F.col("b") == F.col("_b"))
    return asked.join(held, on).where(F.abs(F.col("q") - F.col("p")) <= reach).drop("_term", "_k", "_t", "_b", "b")


def matches(index: DataFrame, windows: DataFrame, window: int = WINDOW, slop: int = SLOP, small: bool = True) -> DataFrame:
    """(wid, k, t, p, offset, n, exact, near) of the places of the windows' rarest terms at which they match, exactly or nearly."""
    if window > 62:
        raise ValueError("windows of up to 62 words")
    reach = max(slop, window - 1)
    few = F.broadcast if small else lambda df: df
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    wanted = keep(plans(windows, counts))
    firsts = wanted.select("term", "wid", "offset", "n", "rest")
    places = index.join(few(firsts), "term").select("wid", "k", "t", F.col("pos").alias("p"), "offset", "n", "rest")
    # The second rarest term: its list is the shortest that can rule places out.
    second = index.join(few(wanted.where(F.size("rest") > 0).select(F.get("rest", F.lit(0))["term"].alias("term")).distinct()), "term", "left_semi")
    asked = places.where(F.size("rest") > 0).select("wid", "k", "t", "p", F.get("rest", F.lit(0)).alias("other"))
    left = keep(_meet(asked, second, reach).select("wid", "k", "t", "p").distinct())
    # All other terms, in the documents that have places left.
    sieve = F.pmod(F.xxhash64("k", "t"), F.lit(SIEVE)).alias("sieve")
    docs = left.select(sieve).distinct()  # at most SIEVE rows
    lists = index.withColumn("sieve", sieve).join(F.broadcast(docs), "sieve", "left_semi")
    others = left.join(few(wanted.select("wid", "offset", "n", "rest")), "wid").select("wid", "k", "t", "p", "offset", "n", F.explode("rest").alias("other"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("other.at"))
    at_place = F.col("q") - F.col("p") == F.col("other.away")
    met = _meet(others, lists, reach).groupBy("wid", "k", "t", "p", "offset", "n").agg(
        F.bit_or(F.when(at_place, bit).otherwise(0)).alias("exact"), F.bit_or(F.when(F.abs(F.col("q") - F.col("p")) <= slop, bit).otherwise(0)).alias("near")
    )
    every = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("n") - 1) - 1
    met = met.select("wid", "k", "t", "p", "offset", "n", (F.col("exact") == every).alias("exact"), (F.col("near") == every).alias("near")).where("exact OR near")
    single = places.where(F.size("rest") == 0).select("wid", "k", "t", "p", "offset", "n", F.lit(True).alias("exact"), F.lit(True).alias("near"))
    return met.unionByName(single)


def is_small(words: DataFrame, bound: int | None = None) -> bool:
    """Whether the test items have so few words that what is made of them may be broadcast."""
    return (words.agg(F.sum(F.size("w"))).first()[0] or 0) <= (BROADCAST_WORDS if bound is None else bound)


def lookup(docs: DataFrame, items: DataFrame, window: int, slop: int, key: str, text: str, item_key: str, item_text: str) -> tuple[DataFrame, DataFrame, bool]:
    """(matches, (item_id, wid), whether the items are small) with an index of the items' terms."""
    words = keep(item_words(items, item_key, item_text))
    small = is_small(words)
    of_items, windows = windows_of(words, window)
    of_items, windows = keep(of_items), keep(windows)
    terms = words.select(F.explode("w").alias("word")).select(F.xxhash64("word").alias("term")).distinct()
    return keep(matches(build_index(docs, key, text, terms, small), windows, window, slop, small)), of_items, small


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, _t, item_id, start, end): words start to end - 1 of the document are a window of the item. _t is a hash of the text."""
    found, of_items, small = lookup(docs, items, window, window - 1, key, text, item_key, item_text)
    start = F.col("p") - F.col("offset")
    hits = found.where("exact").select("wid", F.col("k").alias(key), F.col("t").alias("_t"), start.alias("start"), (start + F.col("n")).alias("end"))
    return hits.join(F.broadcast(of_items) if small else of_items, "wid").select(key, "_t", "item_id", "start", "end").distinct()


def proximity(docs: DataFrame, items: DataFrame, slop: int = SLOP, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, _t, item_id, pos): postings of the rarest term of an item, within slop words of which all its other terms stand.

    Order and repetition are free. Of a longer item each window of slop words is searched for
    as an item of its own.
    """
    found, of_items, small = lookup(docs, items, slop, slop, key, text, item_key, item_text)
    hits = found.where("near").select("wid", F.col("k").alias(key), F.col("t").alias("_t"), F.col("p").alias("pos"))
    return hits.join(F.broadcast(of_items) if small else of_items, "wid").select(key, "_t", "item_id", "pos").distinct()


def union_length(intervals: str) -> Column:
    """Length of the union of [start, end) pairs in an array of structs."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("int").alias("to"))
    fold_ = F.aggregate(
        F.array_sort(intervals),
        zero,
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["end"] - F.greatest(x["start"], acc["to"]), F.lit(0))).cast("bigint").alias("n"),
            F.greatest(acc["to"], x["end"]).cast("int").alias("to"),
        ),
    )
    return fold_["n"]


def decontaminate(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, slop: int = SLOP, carry: list[str] | None = None, item_key: str = "item_id", item_text: str = "text", with_near: bool = False
) -> DataFrame:
    """docs' columns (or those of carry) with n_words, n_hit, n_items, items_sha256 and contaminated; with_near adds n_near.

    n_near counts the items of which some window has all its words within slop words of its rarest one.
    """
    made = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", *(["n_near"] if with_near else [])]
    cols = [c for c in (docs.columns if carry is None else carry) if c not in made]
    found, of_items, small = lookup(docs, items, window, slop if with_near else window - 1, key, text, item_key, item_text)
    start = F.col("p") - F.col("offset")
    covered = found.where("exact").groupBy("k", "t").agg(F.collect_set(F.struct(start.alias("start"), (start + F.col("n")).alias("end"))).alias("_iv"))
    of_window = found.groupBy("k", "t", "wid").agg(F.max("exact").alias("exact"), F.max("near").alias("near"))
    named = of_window.join(F.broadcast(of_items) if small else of_items, "wid")
    per_item = named.groupBy("k", "t", "item_id").agg(F.max("exact").alias("exact"), F.max("near").alias("near"))
    per_doc = per_item.groupBy("k", "t").agg(
        F.array_sort(F.collect_list(F.when(F.col("exact"), F.coalesce(F.col("item_id").cast("string"), F.lit(""))))).alias("_items"), F.count_if("near").alias("_near")
    )
    both = per_doc.join(covered.withColumnsRenamed({"k": "_k", "t": "_h"}), F.col("k").eqNullSafe(F.col("_k")) & (F.col("t") == F.col("_h")), "left").select(
        F.col("k").alias("_k"), F.col("t").alias("_h"), "_items", "_near", "_iv"
    )
    kept = {c: f"_doc_{i}" for i, c in enumerate(cols)}
    pieces = F.filter(_pieces(F.col(text)), lambda x: x != "")
    n_words = F.size(pieces).cast("bigint")
    base = docs.select(*(F.col(quoted(c)).alias(n) for c, n in kept.items()), F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_t"), n_words.alias("n_words"))
    joined = base.join(both, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_t") == F.col("_h")), "left")
    items_ = F.coalesce("_items", F.array().cast("array<string>"))
    return joined.select(
        *(F.col(n).alias(c) for c, n in kept.items()),
        "n_words",
        F.coalesce(union_length("_iv"), F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(items_).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"),
        F.col("_iv").isNotNull().alias("contaminated"),
        *([F.coalesce("_near", F.lit(0)).cast("bigint").alias("n_near")] if with_near else []),
    )
