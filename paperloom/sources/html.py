"""Text, outline and counts of HTML."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.udf import arrow_udf

#: Tags that start a new line, and tags whose content is no text.
BLOCKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article table".split())
SILENT = frozenset("script style head".split())


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.quiet, self.heads, self.level, self.title, self.in_title = [], 0, [], None, [], False

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.quiet += 1
        if tag in BLOCKS:
            self.parts.append("\n")
        if tag == "title":
            self.in_title = True
        if re.fullmatch("h[1-6]", tag):
            self.level = int(tag[1])
            self.heads.append([self.level, ""])

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.quiet = max(0, self.quiet - 1)
        if tag in BLOCKS:
            self.parts.append("\n")
        if tag == "title":
            self.in_title = False
        if re.fullmatch("h[1-6]", tag):
            self.level = None

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        if self.quiet:
            return
        self.parts.append(data)
        if self.level:
            self.heads[-1][1] += data


def _read(text: str) -> _Reader:
    r = _Reader()
    r.feed(text or "")
    r.close()
    return r


def to_text(html: str) -> str:
    """Lines without outer blanks, one empty line for any number of them, none at the ends."""
    lines = (x.strip() for x in "".join(_read(html).parts).splitlines())
    runs = ("\n".join(run) if full else "" for full, run in groupby(lines, bool))
    return "\n".join(runs).strip()


@arrow_udf("string")
def html_text(html: pd.Series) -> pd.Series:
    """Text without tags, scripts and styles; block tags break lines; the last line ends. Null stays null."""
    return html.map(lambda t: None if t is None else to_text(t) + "\n")


@arrow_udf("array<struct<level:int,text:string>>")
def headings(html: pd.Series) -> pd.Series:
    return html.map(lambda t: [{"level": n, "text": " ".join(x.split())} for n, x in _read(t).heads])


@arrow_udf("string")
def title(html: pd.Series) -> pd.Series:
    return html.map(lambda t: " ".join("".join(_read(t).title).split()) or None)


def tag_count(html: Column, tag: str) -> Column:
    """Opening tags of a name, natively."""
    return F.coalesce(F.regexp_count(html, F.lit(rf"(?i)<{tag}[\s>]")), F.lit(0)).cast("bigint")
