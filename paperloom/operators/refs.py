"""Reference numbers in documents: finding, linking, tagging, redacting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.patterns import REGISTRY, VALIDATORS, Kind, resolve
from paperloom.functions.single import let


def find(docs: DataFrame, kinds: list[str] | None = None, extra: list[str] = (), path: str = "path", text: str = "content") -> DataFrame:
    """(path, kind, value, count, first): distinct values of each kind with how often they occur; first orders them."""
    chosen = resolve(kinds, extra=extra)

    def labelled(n: int, name: str):
        return lambda v, i: F.struct(F.lit(n).alias("ord"), F.lit(name).alias("kind"), v.alias("value"), i.alias("at"))

    arrays = [F.transform(k.values(F.col(text)), labelled(n, k.name)) for n, k in enumerate(chosen)]
    rows = docs.select(path, F.explode(F.concat(*arrays)).alias("r")).select(path, "r.*")
    return rows.groupBy(path, "ord", "kind", "value").agg(F.count("*").alias("count"), F.min("at").alias("first")).select(path, "kind", "value", "count", "first")


def _matches(k: Kind, body: Column) -> Column:
    """array<struct<gap,raw,value>>: each match with the text before it and its value; the last one has no raw."""
    raws, values = F.regexp_extract_all(body, F.lit(k.regex), F.lit(0)), k.raw(body)
    return F.transform(F.split(body, k.regex), lambda gap, i: F.struct(gap.alias("gap"), F.get(raws, i).alias("raw"), F.get(values, i).alias("value")))


def places(docs: DataFrame, kind: str, path: str = "path", text: str = "content", most: int = 20) -> DataFrame:
    """(path, value, count, n_lines, lines, pages): where a match starts; at most `most` distinct lines and pages each, n_lines counts all lines.

    Lines and pages are running sums of newlines and form feeds over a text's matches in order.
    """
    k: Kind = REGISTRY[kind]
    count = lambda c, mark: F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))
    each = docs.select(path, F.posexplode(_matches(k, F.coalesce(F.col(text), F.lit("")))).alias("i", "m")).where("m.raw IS NOT NULL")
    value = k.normalise(F.col("m.value"))
    marks = [(count(F.col("m.gap"), mark).alias(f"{name}_gap"), count(F.col("m.raw"), mark).alias(f"{name}_raw")) for name, mark in (("line", "\n"), ("page", "\f"))]
    thin = each.select(path, "i", value.alias("value"), k.accepts(value).alias("good"), *(c for pair in marks for c in pair))
    before = Window.partitionBy(path).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda n: (F.coalesce(F.sum(F.col(f"{n}_gap") + F.col(f"{n}_raw")).over(before), F.lit(0)) + F.col(f"{n}_gap") + 1).cast("bigint").alias(n)
    found = thin.select(path, "value", "good", at("line"), at("page")).where("good")
    short = lambda c: F.slice(F.array_sort(F.collect_set(c)), 1, most)
    return found.groupBy(path, "value").agg(F.count("*").alias("count"), F.count_distinct("line").alias("n_lines"), short("line").alias("lines"), short("page").alias("pages"))


def link(refs: DataFrame, path: str = "path") -> DataFrame:
    """(kind, value, files, count): values that several files hold."""
    return refs.groupBy("kind", "value").agg(F.count_distinct(path).alias("files"), F.sum("count").alias("count")).where("files > 1")


def tag(kind: Column, value: Column) -> Column:
    return F.lower(F.regexp_replace(F.concat(F.lit("ref:"), kind, F.lit(":"), value), r"\s", ""))


def redact(text: Column, kinds: list[str], replacement: str | None = None, extra: list[str] = ()) -> Column:
    """The text with values replaced, kind after kind, each on what the one before has left.

    Only the value of a labelled match goes, and only if it passes its kind's check. Each
    kind reads the text that is left once more, so time is linear in the kinds.
    """
    out = F.coalesce(text, F.lit(""))
    for k in resolve(kinds, extra=extra):
        out = let(out, _redacted(k, replacement))
    return out


def _redacted(k: Kind, replacement: str | None):
    """A text's redaction by one kind; where whole matches go unchecked, that is one replacement."""
    new = replacement if replacement is not None else f"[{k.name.upper()}]"

    def make(body: Column) -> Column:
        if not k.picks and k.name not in VALIDATORS:
            return F.regexp_replace(body, F.lit(k.regex), F.lit(new.replace("\\", "\\\\").replace("$", "\\$")))
        return F.array_join(F.transform(_matches(k, body), _swap(k, new)), "")

    return make


def _swap(k: Kind, new: str):
    def swap(m: Column) -> Column:
        at = F.position(m["value"], m["raw"])
        cut = F.concat(F.left(m["raw"], at - 1), F.lit(new), F.substr(m["raw"], at + F.char_length(m["value"])))
        return F.concat(m["gap"], F.when(m["raw"].isNull(), "").when(k.accepts(k.normalise(m["value"])), cut).otherwise(m["raw"]))

    return swap


def still_parses(before: Column, after: Column, kind: str) -> Column:
    """Whether a redacted json or xml text parses if it did before; other kinds always pass."""
    if kind == "json":
        fine = lambda c: F.try_parse_json(c).isNotNull()
    elif kind == "xml":
        from paperloom.operators.convert import xml_parses as fine
    else:
        return F.lit(True)
    return ~fine(before) | fine(after)


def counts(text: Column, kinds: list[str]) -> list[Column]:
    """One count per kind, each on the text as the kinds before have left it."""

    def from_kind(i: int, body: Column, so_far: list[Column]) -> Column:
        size = F.size(REGISTRY[kinds[i]].values(body)).cast("bigint")
        if i + 1 == len(kinds):
            return F.array(*so_far, size)
        return let(size, lambda n: let(_redacted(REGISTRY[kinds[i]], None)(body), lambda left: from_kind(i + 1, left, [*so_far, n])))

    every = let(F.coalesce(text, F.lit("")), lambda body: from_kind(0, body, []))
    return [F.get(every, F.lit(i)).alias(name) for i, name in enumerate(kinds)]
