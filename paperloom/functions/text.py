"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with diacritics and what they fold to.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

#: Fixed value: characters of an estimated token.
CHARS_PER_TOKEN = 3.6

NOT_TERM = r"[^\p{L}\p{N}]+"


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN)


def terms(text: Column) -> Column:
    """Search terms in order: runs of letters and digits, folded."""
    return F.filter(F.split(fold(text), NOT_TERM), lambda t: t != "")


def token_estimate(text: Column) -> Column:
    """Estimated model tokens: characters over 3.6, rounded up."""
    return F.ceil(F.char_length(F.coalesce(text, F.lit(""))) / F.lit(CHARS_PER_TOKEN)).cast("bigint")


def line_count(text: Column) -> Column:
    """Lines; a closing newline opens no further one."""
    body = F.coalesce(text, F.lit(""))
    return F.when(body == "", 0).otherwise(F.size(F.split(F.regexp_replace(body, r"\n\z", ""), "\n"))).cast("bigint")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def human_size(n: Column) -> Column:
    """Bytes as B to TB, with one decimal from KB on."""
    one = lambda x: F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))
    out = F.concat(one(n / F.lit(1024.0**4)), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(n < 1024.0 ** (power + 1), F.concat(one(n / F.lit(1024.0**power)), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def slug(text: Column, joiner: str = "_") -> Column:
    """A safe file-name part: unsafe runs become the joiner, none doubled or at the ends."""
    safe = F.regexp_replace(text, r"[^A-Za-z0-9._-]+", joiner)
    once = F.regexp_replace(safe, "_{2,}", "_")
    return F.regexp_replace(once, r"^[._]+|[._]+$", "")


def mail_slug(text: Column) -> Column:
    cut = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), "^-+|-+$", "")
    short = F.regexp_replace(F.substring(cut, 1, 60), "-+$", "")
    return F.when(short == "", F.lit("message")).otherwise(short)


def html_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fence(text: Column) -> Column:
    """A backtick fence longer than any in the text, three at least."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda s: F.length(s)))
    return F.repeat(F.lit("`"), F.greatest(F.coalesce(longest, F.lit(0)) + 1, F.lit(3)))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last extension with its dot, in lower case; none for dot files."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    name = base_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def fiscal_year(day: Column, start: int = 1) -> Column:
    """The year in which the fiscal year ends."""
    return (F.year(day) + F.when((F.lit(start) > 1) & (F.month(day) >= start), 1).otherwise(0)).cast("bigint")


def fiscal_quarter(day: Column, start: int = 1) -> Column:
    return (F.floor(F.pmod(F.month(day) - start, F.lit(12)) / 3) + 1).cast("bigint")


def luminance(colour: Column) -> Column:
    """WCAG relative luminance of #rrggbb."""

    def channel(at: int) -> Column:
        c = F.conv(F.substring(colour, at, 2), 16, 10).cast("double") / 255.0
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(2) + 0.7152 * channel(4) + 0.0722 * channel(6)


def contrast(a: Column, b: Column) -> Column:
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def glob_pattern(glob: str) -> str:
    """A shell pattern as an anchored regular expression; * also crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += "\\" + c if not c.isalnum() else c
        i += 1
    return f"(?s)^{out}$"


#: Names that some platforms reserve, and the longest name.
RESERVED, NAME_CHARS = ("con", "prn", "aux", "nul", *(f"{d}{n}" for d in ("com", "lpt") for n in range(1, 10))), 120


def safe_filename(name: Column, fallback: str = "attachment") -> Column:
    """A file name without folders, control or reserved characters, leading dots or reserved names, of bounded length."""
    base = F.trim(F.element_at(F.split(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), "/"), -1))
    base = F.regexp_replace(F.regexp_replace(base, r"[\x00-\x1F\x7F<>:\"|?*/]+", "_"), r"^[._]+|[._]+$", "")
    ext = F.regexp_extract(base, r"(\.[^.]{1,16})$", 1)
    root = F.left(F.left(base, F.length(base) - F.length(ext)), F.lit(NAME_CHARS) - F.length(ext))
    safe = F.when(F.lower(root).isin(*RESERVED), F.concat(F.lit("_"), root)).otherwise(root)
    return F.when(base == "", F.lit(fallback)).otherwise(F.concat(safe, ext))


def short_hash(content: Column) -> Column:
    """The first eight digits of the SHA-256."""
    return F.left(F.sha2(content.cast("binary"), 256), F.lit(8))
