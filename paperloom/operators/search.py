"""Full-text search: query language, bm25 ranking, snippets.

A query is terms, "phrases" and prefix*, with AND, OR, NOT and parentheses. Terms side by side
must all occur and bind tightest, then NOT, AND and OR: `a NOT b c` is a without (b and c). A term
with marks inside, as foo-bar, is the phrase of its parts. It is compiled to expressions over a document's term array. Ranking takes two scans and no
shuffle: one global aggregation gives the number of documents, their mean length and each
phrase's document frequency (one row, whatever the corpus), the second scan scores and
keeps the top. Filters apply before the limit; statistics are those of the whole corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.udf import arrow_udf
from paperloom.functions.text import MARKED, PLAIN, terms
from paperloom.session import spread

K1, B, FLOOR = 1.2, 0.75, 1e-6


class QueryError(ValueError):
    """The query can't be read."""


@dataclass(frozen=True)
class Phrase:
    """Adjacent terms; the last one may be a prefix."""

    words: tuple[str, ...]
    prefix: bool = False


_TOKEN = re.compile(r'\s*(?:"([^"]*)"(\*?)|([()])|([^\s()"]+))')


def _fold(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower().translate(str.maketrans(MARKED, PLAIN))) if w]


def parse(query: str):
    """A tree of Phrase, ('and', a, b), ('or', a, b) and ('not', a, b)."""
    tokens, at = [], 0
    text = query.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise QueryError(f"can't read the query at {text[at:]!r}")
        at = m.end()
        if m[1] is not None:
            tokens.append(Phrase(tuple(_fold(m[1])), bool(m[2])))
        elif m[3]:
            tokens.append(m[3])
        elif m[4] in ("AND", "OR", "NOT"):
            tokens.append(m[4])
        elif m[4].startswith("^") or ":" in m[4] or m[4] == "NEAR" and text[at : at + 1] == "(":
            raise QueryError(f"{m[4]!r} is not supported")
        else:
            words = _fold(m[4])
            if not words:
                raise QueryError(f"no term in {m[4]!r}")
            tokens.append(Phrase(tuple(words), m[4].endswith("*")))
    if not tokens:
        raise QueryError("the query is empty")

    def any_of():
        left = all_of()
        while tokens and tokens[0] == "OR":
            tokens.pop(0)
            left = ("or", left, all_of())
        return left

    def all_of():
        left = minus()
        while tokens and tokens[0] == "AND":
            tokens.pop(0)
            left = ("and", left, minus())
        return left

    def minus():
        left = side_by_side()
        while tokens and tokens[0] == "NOT":
            tokens.pop(0)
            left = ("not", left, side_by_side())
        return left

    def side_by_side():
        left = one()
        while tokens and tokens[0] not in ("AND", "OR", "NOT", ")"):
            left = ("and", left, one())
        return left

    def one():
        if not tokens:
            raise QueryError("the query ends too early")
        t = tokens.pop(0)
        if t == "(":
            inner = any_of()
            if not tokens or tokens.pop(0) != ")":
                raise QueryError("a parenthesis is not closed")
            return inner
        if not isinstance(t, Phrase) or not t.words:
            raise QueryError(f"unexpected {t!r}")
        return t

    tree = any_of()
    if tokens:
        raise QueryError(f"unexpected {tokens[0]!r}")
    return tree


def phrases(tree) -> list[Phrase]:
    """All phrases, in order; those under NOT's right side take no part in the ranking."""
    if isinstance(tree, Phrase):
        return [tree]
    found = phrases(tree[1]) + ([] if tree[0] == "not" else phrases(tree[2]))
    return list(dict.fromkeys(found))


def _all(tree) -> list[Phrase]:
    return [tree] if isinstance(tree, Phrase) else list(dict.fromkeys(_all(tree[1]) + _all(tree[2])))


def hits(ts: str, phrase: Phrase) -> Column:
    """How often the phrase stands in a column of terms."""

    def same(t, k):
        w = phrase.words[k]
        return t.startswith(w) if phrase.prefix and k == len(phrase.words) - 1 else t == w

    # No lambda looks outside itself: were the array's expression drawn into one, it would be worked out for each element.
    if len(phrase.words) == 1:
        return F.size(F.filter(ts, lambda t: same(t, 0)))
    found = F.transform(ts, lambda t: same(t, 0))

    def also(k: int):
        return lambda a, t: a & F.coalesce(same(t, k), F.lit(False))

    for k in range(1, len(phrase.words)):
        found = F.zip_with(found, F.slice(ts, k + 1, F.greatest(F.size(ts) - k, F.lit(0))), also(k))
    return F.size(F.filter(found, lambda a: a))


def _holds(tree, count: dict[Phrase, str]) -> Column:
    if isinstance(tree, Phrase):
        return F.col(count[tree]) > 0
    a, b = _holds(tree[1], count), _holds(tree[2], count)
    return {"and": a & b, "or": a | b, "not": a & ~b}[tree[0]]


def idf(documents: int, holding: int) -> float:
    """The weight of a phrase that so many documents hold; frequent ones keep a little."""
    weight = math.log((documents - holding + 0.5) / (holding + 0.5)) if documents else 0.0
    return weight if weight > 0 else FLOOR


def search(docs: DataFrame, query: str, limit: int | None = 20, where: Column | None = None, key: str = "path", text: str = "content") -> DataFrame:
    """(key, score) of the matching documents, best (least) first, ties by key; where narrows before the limit."""
    tree = parse(query)
    ranked, every = phrases(tree), _all(tree)
    count = {p: f"_f{i}" for i, p in enumerate(every)}
    with_terms = docs.withColumn("_terms", terms(F.col(text)))
    counted = with_terms.select("*", F.size("_terms").alias("_n"), *[hits("_terms", p).alias(c) for p, c in count.items()])
    row = counted.agg(F.count("*").alias("n"), F.avg("_n").alias("mean"), *[F.count_if(F.col(count[p]) > 0).alias(count[p]) for p in ranked]).first()
    score = F.lit(0.0)
    for p in ranked:
        f = F.col(count[p]).cast("double")
        score = score - F.lit(idf(row["n"], row[count[p]])) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / F.lit(row["mean"] or 1.0)))
    found = counted.where(_holds(tree, count))
    if where is not None:
        found = found.where(where)
    found = found.select(key, score.alias("score")).orderBy("score", key)
    return found if limit is None else found.limit(limit)


#: Terms that a task's worker takes at once (a document of more is one step), a few dozen bytes each.
STEP = 1 << 18


def posted(names: list[str]):
    """A mapInArrow function from documents (names, ts: terms) to a row for each term of each: term, names, tf, positions."""

    def run(batches):
        for batch in batches:
            at = batch.column("ts")
            first, ends = 0, np.cumsum(np.nan_to_num(pc.list_value_length(at).to_numpy(zero_copy_only=False))).astype(np.int64)
            while first < len(ends):
                done = ends[first - 1] if first else 0
                stop = max(int(np.searchsorted(ends, done + STEP, "right")), first + 1)
                yield from _post(batch.slice(first, stop - first), names)
                first = stop

    return run


def _post(batch, names: list[str]):
    lists = batch.column("ts")
    words = lists.flatten().dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False)
    if not len(code):
        return
    size = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    doc = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    order = np.lexsort((place, code, doc))
    d, c = doc[order], code[order]
    start = np.nonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (c[1:] != c[:-1])]))[0]
    ends = np.append(start, len(d)).astype(np.int32)
    rows = pa.array(d[start])
    yield pa.RecordBatch.from_arrays(
        [words.dictionary.take(pa.array(c[start])), *[batch.column(x).take(rows) for x in names], pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order].astype(np.int32)))],
        names=["term", *names, "tf", "positions"],
    )


def postings(docs: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """(term, key, positions, tf): the stored form of the index, one row per term and key.

    A document's terms meet within its row, so only texts are dealt out. Where rows share a key (or null), terms meet in a shuffle.
    """
    if not docs.groupBy(key).count().where("count > 1").isEmpty():
        each = docs.select(key, F.posexplode(terms(F.col(text))).alias("pos", "term"))
        return each.groupBy("term", key).agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.count("*").alias("tf"))
    each = spread(docs.select(key, F.col(text).alias("_t"))).select(key, terms(F.col("_t")).alias("ts"))
    kind = f"term string, `{key}` {docs.schema[key].dataType.simpleString()}, tf bigint, positions array<int>"
    return each.mapInArrow(posted([key]), kind).select("term", key, "positions", "tf")


def document_frequency(docs: DataFrame, text: str = "content") -> DataFrame:
    """(term, df, tf) over the corpus."""
    inner = docs.select(F.explode(F.transform(F.array_distinct(terms(F.col(text))), lambda t: t)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
    return inner.join(total, "term")


def snippet(text: Column, words: list[str], width: int = 12) -> Column:
    """The window of words with most distinct hits, the first of such, hits in brackets."""
    wanted = frozenset(words)

    @arrow_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            parts = (t or "").split()
            plain = ["".join(_fold(p)) for p in parts]
            inside: Counter = Counter()
            best, at = -1, 0
            for i, p in enumerate(plain):
                inside[p] += 1
                if i >= width:
                    inside[plain[i - width]] -= 1
                start = max(0, i - width + 1)
                if i >= width - 1 or i == len(plain) - 1:
                    n = sum(1 for w in wanted if inside[w] > 0)
                    if n > best:
                        best, at = n, start
            shown = " ".join(f"[{w}]" if p in wanted else w for w, p in zip(parts[at : at + width], plain[at : at + width]))
            return (" … " if at else "") + shown + (" … " if at + width < len(parts) else "")

        return texts.map(one)

    return cut(text)
