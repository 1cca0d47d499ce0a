"""Dates in text, as Column expressions.

Five families of forms are looked up one after the other. What a family has found and what
is a real date is blotted out, digit for character, before the next family looks, so of
overlapping forms the first family's stays. Parts of a date are its numbers in order and,
where it has one, its month's name; the order of numbers is the family's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.single import behind, let, match_of, of_text, pieces

#: Names of the months; the first three letters serve as short forms, for September also four.
MONTHS = "january february march april may june july august september october november december".split()

_NAME = "(?:" + "|".join(sorted({*MONTHS, *(m[:3] for m in MONTHS), "sept"}, key=lambda m: (-len(m), m))) + ")"
_DAY, _YEAR = "[0-9]{1,2}(?:st|nd|rd|th)?", "[0-9]{4}"

#: family -> (form, order of its numbers), in order of precedence.
FORMS = {
    "iso": (f"(?<![0-9-]){_YEAR}-[0-9]{{2}}-[0-9]{{2}}(?![0-9-])", "ymd"),
    "year first": (f"(?<![0-9/.]){_YEAR}[/.][0-9]{{1,2}}[/.][0-9]{{1,2}}(?![0-9/.])", "ymd"),
    "month first": (f"(?i)\\b{_NAME}\\.?\\s+{_DAY},?\\s+{_YEAR}\\b", "dy"),
    "day first": (f"(?i)\\b{_DAY}\\s+{_NAME}\\.?,?\\s+{_YEAR}\\b", "dy"),
    "slashed": ("(?<![0-9/.-])[0-9]{1,2}(?:" + "|".join(f"[{s}][0-9]{{1,2}}[{s}]" for s in ("/", ".", "-")) + ")(?:[0-9]{4}|[0-9]{2})(?![0-9/.-])", "slash"),
}


def _made(year: Column, month: Column, day: Column) -> Column:
    """The date, null if there is none such."""
    first = F.when((year > 0) & month.between(1, 12), F.make_date(year, month, F.lit(1)))
    return let(first, lambda f: F.when(day.between(1, F.dayofmonth(F.last_day(f))), F.date_add(f, day - 1)))


def _value(raw: Column, kind: str, order: str) -> Column:
    """struct<value,ambiguous> of one form."""

    def read(n):
        at = lambda i: F.get(n, F.lit(i))
        if kind == "ymd":
            return F.struct(_made(at(0), at(1), at(2)).alias("value"), F.lit(False).alias("ambiguous"))
        if kind == "dy":
            short = F.lower(F.substring(F.regexp_extract(raw, f"(?i){_NAME}", 0), 1, 3))
            month = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), short).cast("int")
            return F.struct(_made(at(1), month, at(0)).alias("value"), F.lit(False).alias("ambiguous"))
        a, b = at(0), at(1)
        year = F.when(raw.rlike("[0-9]{4}$"), at(2)).otherwise(at(2) + 2000)
        # A number above 12 is the day, wherever it stands; else the order decides.
        month_first = F.when((a > 12) & (b <= 12), False).when((b > 12) & (a <= 12), True).otherwise(F.lit(order == "mdy"))
        value = _made(year, F.when(month_first, a).otherwise(b), F.when(month_first, b).otherwise(a))
        return F.struct(value.alias("value"), ((a <= 12) & (b <= 12) & (a != b)).alias("ambiguous"))

    return let(F.transform(F.regexp_extract_all(raw, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int")), read)


def _found(body: Column, form: str, kind: str, order: str) -> Column:
    """array<struct<gap,raw,value,ambiguous>>: the forms of a family, each with the text before it; the last one has no raw."""
    read = lambda raw: F.when(raw.isNotNull(), _value(raw, kind, order))
    one = lambda gap, raw: let(read(raw), lambda v: F.struct(gap.alias("gap"), raw.alias("raw"), v["value"].alias("value"), v["ambiguous"].alias("ambiguous")))
    raw = lambda cut, i: F.when(i + 1 < F.size(cut), match_of(F.get(cut, i + 1)))
    found = let(pieces(body, form), lambda cut: F.transform(cut, lambda p, i: let(raw(cut, i), lambda r: one(behind(p), r))))
    # Most texts lack most forms: one look tells.
    return F.when(body.rlike(form), found).otherwise(F.array(F.struct(body.alias("gap"), F.lit(None).cast("string").alias("raw"), F.lit(None).cast("date").alias("value"), F.lit(None).cast("boolean").alias("ambiguous"))))


def _blot(found: Column) -> Column:
    """The text again, real dates as zeros."""
    shown = lambda x: F.when(x["raw"].isNull(), "").when(x["value"].isNull(), x["raw"]).otherwise(F.repeat(F.lit("0"), F.length(x["raw"])))
    return F.array_join(F.transform(found, lambda x: F.concat(x["gap"], shown(x))), "")


def _dated(found: Column) -> Column:
    """array<struct<start,value,raw,ambiguous>> of the real dates."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:date,raw:string,ambiguous:boolean>>").alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        new = F.array(F.struct(start.alias("start"), x["value"].alias("value"), x["raw"].alias("raw"), x["ambiguous"].alias("ambiguous")))
        return F.struct((start + F.coalesce(F.length(x["raw"]), F.lit(0))).alias("at"), F.when(x["value"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], new)).alias("out"))

    return F.aggregate(found, zero, step)["out"]


def dates(text: Column, order: str = "mdy") -> Column:
    """array<struct<start,value,raw,ambiguous,end>>: the dates of a text in order of place, counted from 0.

    order (mdy or dmy) reads slashed forms whose numbers could be either; those are ambiguous.
    """
    if order not in ("mdy", "dmy"):
        raise ValueError("order is mdy or dmy")
    kinds = list(FORMS.values())

    def look(k: int, body: Column, before: list[Column]) -> Column:
        """The dates of family k and those behind it, with what the families before it have found."""
        none_left = F.array_sort(F.concat(*before)) if before else None
        if k == len(kinds):
            return none_left
        found = _found(body, *kinds[k], order)
        more = let(found, lambda f: let(_blot(f), lambda rest: look(k + 1, rest, [*before, _dated(f)])))
        return F.when(a_date(body), more).otherwise(none_left) if before else more

    with_end = lambda x: F.struct(x["start"].alias("start"), x["value"].alias("value"), x["raw"].alias("raw"), x["ambiguous"].alias("ambiguous"), (x["start"] + F.length(x["raw"])).alias("end"))
    body = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<start:int,value:date,raw:string,ambiguous:boolean,end:int>>")
    return F.when(a_date(body), F.transform(look(0, body, []), with_end)).otherwise(none)


def a_date(text: Column) -> Column:
    """Whether a text holds what could be a date, by one look."""
    return text.rlike(f"[0-9][/.-][0-9]{{1,2}}[/.-][0-9]|(?i:{_NAME})\\.?,?\\s+[0-9]")


def find_dates(text: str, order: str = "mdy") -> list[dict]:
    """dates() of one text."""
    return [r.asDict() for r in of_text(lambda c: dates(c, order), text)]
