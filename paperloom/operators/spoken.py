"""Texts for reading aloud: markdown as narration, chapters, pieces of bounded length.

All of it is built-in expressions on one text a row: no shuffle and no Python. Lines end as
Python's splitlines ends them; code fences are runs from a line of ``` or ~~~ to the next
line that begins with the same three marks, or to the end.

Defined cases: a null text gives null; an empty one is narrated as one line end, has no
pieces, and is one chapter. Repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.single import let

# What ends a line besides \n, and the shapes of markdown lines and marks.
LINE_ENDS = r"\r\n|[\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
BLANK = r"[\s\x1C-\x1F&&[^\n]]"
FENCE = rf"{BLANK}*+(```|~~~)[^\n]*+(?:\n(?!{BLANK}*+\1)[^\n]*+)*+(?:\n[^\n]*+)?+"
HEADING = rf"^ {{0,3}}(#{{1,6}}){BLANK}+(.*?){BLANK}*#*{BLANK}*\z"
RULE = rf"^ {{0,3}}([-*_])( *\1){{2,}}{BLANK}*\z"
BULLET = rf"^{BLANK}{{0,8}}(?:[-*+]|\d{{1,3}}[.)]){BLANK}+"
QUOTE = rf"^{BLANK}{{0,3}}>{BLANK}?"
INLINE = [
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"<(?:https?|mailto):[^>]*>", ""), (r"`+([^`]*)`+", "$1"), (r"(\*{1,3}|_{1,3})(?=\S)(.+?)(?<=\S)\1", "$2"), (r"(\*{1,3}|_{1,3})(?=\S)(.+?)(?<=\S)\1", "$2"), (r"  +", " "), (rf"{BLANK}+\z", ""),
]
MOST = 4000

_U = "(?U)"
_TITLE = f"{_U}{HEADING}"
#: A fence, a heading line, or a run of other lines; each with its line end.
_SEGMENT = rf"(?Um)(?:^{FENCE}\n?|^ {{0,3}}#{{1,6}}{BLANK}[^\n]*\n?|(?:^(?!{BLANK}*+(?:```|~~~)| {{0,3}}#{{1,6}}{BLANK})(?:[^\n]++\n?|\n))++)"


def _lines(text: Column) -> Column:
    """Text with all line ends as \\n, without the last one."""
    return F.regexp_replace(F.regexp_replace(text, LINE_ENDS, "\n"), r"\n\z", "")


def inline(line: Column) -> Column:
    """A line without its marks: alternative texts, link texts, code as text, no emphasis, no bare addresses."""
    for pattern, to in INLINE:
        line = F.regexp_replace(line, _U + pattern, to)
    return line


def _title(line: Column) -> Column:
    return F.regexp_replace(inline(F.regexp_extract(line, _TITLE, 2)), rf"{_U}^{BLANK}+", "")


def narration(text: Column) -> Column:
    """Markdown as one would read it out; blank lines are pauses, headings are announced, code is left out."""
    bare = F.regexp_replace(_lines(text), rf"(?Um)^{FENCE}", "\n[code omitted]\n")

    def line(x: Column) -> Column:
        heading = F.concat(F.lit("\nChapter: "), F.regexp_replace(_title(x), r"([^.!?])\z", "$1."), F.lit("\n"))
        body = inline(F.regexp_replace(F.regexp_replace(x, _U + QUOTE, ""), _U + BULLET, ""))
        return F.when(x.rlike(_TITLE), heading).when(x.rlike(_U + RULE), "").otherwise(body)

    joined = F.array_join(F.transform(F.split(bare, "\n"), line), "\n")
    return F.concat(F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"\A\n+|\n+\z", ""), F.lit("\n"))


def chapters(text: Column, name: Column) -> Column:
    """[(title, body)]: markdown cut at first-level headings, if there are two, or else at second-level ones, or else whole.

    What stands before the first heading is a chapter called name, unless it is blank; a heading without a text
    is called name too. Headings within fences are text.
    """

    def cut(parts: Column, level: int) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: (F.size(parts) > 0) & (F.length(F.regexp_extract(F.rtrim(F.get(parts, i), F.lit("\n")), _TITLE, 1)) == level))
        return let(places, lambda at: F.when(F.size(at) >= 2, pieces(parts, at)))

    def body(parts: Column, first: Column, after: Column) -> Column:
        return F.regexp_replace(F.array_join(F.slice(parts, first + 1, after - first), ""), r"\n\z", "")

    def pieces(parts: Column, at: Column) -> Column:
        before = F.array(F.struct(name.alias("title"), body(parts, F.lit(0), F.get(at, F.lit(0))).alias("body")))
        headed = F.transform(
            F.sequence(F.lit(0), F.size(at) - 1),
            lambda k: F.struct(
                F.coalesce(F.nullif(_title(F.rtrim(F.get(parts, F.get(at, k)), F.lit("\n"))), F.lit("")), name).alias("title"),
                body(parts, F.get(at, k), F.coalesce(F.get(at, k + 1), F.size(parts))).alias("body"),
            ),
        )
        return F.concat(F.filter(before, lambda c: c["body"].rlike(rf"{_U}[^\s\x1C-\x1F]")), headed)

    whole = F.array(F.struct(name.alias("title"), text.alias("body")))
    return F.when(text.isNotNull(), let(F.regexp_extract_all(_lines(text), F.lit(_SEGMENT), F.lit(0)), lambda parts: F.coalesce(cut(parts, 1), cut(parts, 2), whole)))


def chunks(text: Column, most: int = MOST) -> Column:
    """Pieces of at most `most` characters, as many whole sentences as go in; a longer sentence is cut at the limit.

    Blanks within paragraphs become one space and paragraphs stand two line ends apart, so that pieces are stretches
    of one text: each is the longest that ends where a sentence or paragraph does.
    """
    paragraphs = F.transform(F.split(text, r"\n{2,}"), lambda p: F.regexp_replace(F.regexp_replace(p, rf"{_U}[\s\x1C-\x1F]+", " "), r"\A | \z", ""))
    joined = F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n")
    piece = rf"(?s)\G(?:\n\n|(?<=[.!?]) )?+(.{{1,{most}}}(?:\z|(?=\n\n)|(?<=[.!?])(?= ))|.{{{most}}})"
    return F.regexp_extract_all(joined, F.lit(piece), F.lit(1))


def slug(title: Column, most: int = 48) -> Column:
    """A chapter's file name: runs of other characters than a-z and 0-9 as one hyphen."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), r"\A-+|-+\z", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(bare, 1, most), r"-+\z", ""), F.lit("")), F.when(title.isNotNull(), "chapter"))
