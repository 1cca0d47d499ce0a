"""Messages and mailboxes: text, summaries, threads."""

from __future__ import annotations

import io
import re
from datetime import UTC, datetime
from email import policy
from email.headerregistry import HeaderRegistry
from email.parser import BytesParser, Parser
from email.utils import getaddresses, parsedate_to_datetime
from html import escape

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.udf import arrow_udf


_ID = r"<[^<>\s]+>"


_registry = HeaderRegistry()
_recent: dict = {}


def _made(name: str, value: str):
    """A header as the parser makes it; each is read several times and many recur, so short ones of late are kept."""
    if len(value) > 1000:
        return _registry(name, value)
    made = _recent.get((name, value))
    if made is None:
        if len(_recent) >= 4096:
            _recent.clear()
        made = _recent[name, value] = _registry(name, value)
    return made


_POLICY = policy.default.clone(header_factory=_made)
#: Lines that the parser takes as headers.
_HEAD = re.compile(r"(?:(?:From |[!-9;-~]*:|[\t ])[^\n]*\n)*")


def _message(data):
    """A message as the parser reads it from a file, all line ends \\n. The body of one that has no parts is not read line by line."""
    data = bytes(data or b"")
    text = data.decode("ascii", "surrogateescape").replace("\r\n", "\n").replace("\r", "\n")
    end = _HEAD.match(text).end()
    if 0 < end < len(text) and not text.startswith("From ", text.rfind("\n", 0, end - 1) + 1) and (text[end] == "\n" or "\n" in text[end:]):
        m = Parser(policy=_POLICY).parsestr(f"{text[:end]}\n")
        if m.get_content_maintype() not in ("multipart", "message"):
            m.set_payload(text[end + (text[end] == "\n") :])
            return m
    return BytesParser(policy=_POLICY).parse(io.BytesIO(data))


def _header(m, name: str) -> str:
    """A header as text; one that the parser can't render is none."""
    try:
        return str(m[name] or "")
    except Exception:  # noqa: BLE001  (headers are parsed when read, and fail in many ways)
        return ""


def _sent(m) -> datetime | None:
    """When a message was sent; a time without a zone is UTC."""
    try:
        when = parsedate_to_datetime(_header(m, "Date"))
    except Exception:  # noqa: BLE001
        return None
    return when if when.tzinfo else when.replace(tzinfo=UTC)


def _iso(m) -> str:
    when = _sent(m)
    return when.isoformat(timespec="seconds") if when else ""


def _people(m, name: str) -> list[tuple[str, str]]:
    try:
        return [(n, a) for n, a in getaddresses([str(v) for v in m.get_all(name) or []]) if n or a]
    except Exception:  # noqa: BLE001
        return []


def _named(m, name: str) -> list[str]:
    return [f"{n} <{a}>" if n else a for n, a in _people(m, name)]


def _decoded(part) -> str:
    """A part's text by its charset or, where that is unknown or wrong, by UTF-8, Windows-1252, or UTF-8 with replacements."""
    try:
        text = part.get_content()
        if isinstance(text, str):
            return text
    except Exception:  # noqa: BLE001, S110
        pass
    data = part.get_payload(decode=True)
    if not isinstance(data, bytes):
        return ""
    for name in (part.get_content_charset(), "utf-8", "cp1252"):
        try:
            return data.decode(name or "utf-8")
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("utf-8", "replace")


def _part(m, *kinds: str):
    try:
        return m.get_body(kinds)
    except Exception:  # noqa: BLE001
        return None


def _body(m) -> str:
    """The plain part, or else the HTML part as text."""
    part = _part(m, "plain", "html")
    if part is None:
        return ""
    text = _decoded(part)
    if part.get_content_type() == "text/html":
        from paperloom.sources.html import to_text

        text = to_text(text)
    return text


def _leaves(m):
    """Attached parts in order; messages and multiparts that are attached give those within them instead."""
    open_ = [iter(_attached(m))]
    while open_:
        part = next(open_[-1], None)
        if part is None:
            open_.pop()
        elif part.get_content_type() == "message/rfc822" or part.get_content_maintype() == "multipart":
            inner = part.get_payload()
            inner = [x for x in (inner if isinstance(inner, list) else [inner]) if hasattr(x, "iter_attachments")]
            open_.extend(iter(_attached(x)) for x in reversed(inner))
        else:
            yield part


def _attached(m) -> list:
    try:
        return list(m.iter_attachments())
    except Exception:  # noqa: BLE001
        return []


def _attachments(m) -> list[dict]:
    out = []
    for i, part in enumerate(_leaves(m), 1):
        try:
            name = part.get_filename()
        except Exception:  # noqa: BLE001
            name = None
        data = part.get_payload(decode=True)
        out.append({"name": name or f"attachment-{i}", "type": part.get_content_type(), "size": len(data) if isinstance(data, bytes) else 0})
    return out


def _text(m) -> str:
    """Headers that name a message, its body, its attachments."""
    shown = [(h, _iso(m) if h == "Date" else _header(m, h)) for h in ("From", "To", "Cc", "Date", "Subject", "Message-ID")]
    body, files = _body(m).strip(), _attachments(m)
    parts = ["\n".join(f"{h}: {v}" for h, v in shown if v), "\n\n", body, "\n" if body else ""]
    if files:
        parts += ["\n", *(f"attachment: {f['name']} ({f['type']}, {f['size']} bytes)\n" for f in files)]
    return "".join(parts)


def message_text(data) -> str:
    return _text(_message(data))


def _markdown(m) -> str:
    """A message as markdown: subject, a table of headers, body, a list of attachments."""
    ids = re.findall(_ID, _header(m, "Message-ID"))
    table = [(h, ", ".join(_named(m, h))) for h in ("From", "To", "Cc")] + [("Date", _iso(m)), ("Message-ID", ids[0] if ids else "")]
    rows = [f"| {h} | {v.replace('|', chr(92) + '|')} |" for h, v in table if v]
    out = [f"# {_header(m, 'Subject') or '(no subject)'}", "", "| header | value |", "|---|---|", *rows, "", _body(m).rstrip("\n"), ""]
    files = _attachments(m)
    if files:
        out += ["", "## Attachments", "", *(f"- `{f['name']}` ({f['type']}, {f['size']} bytes)" for f in files)]
    return "\n".join(out).rstrip("\n") + "\n"


def _page(m, name: str) -> str:
    """A message as an HTML page in UTF-8: its own HTML, or else its text."""
    title, own = escape(_header(m, "Subject") or name), _part(m, "html")
    shell = '<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>{}</title>\n</head>\n<body>\n{}\n</body>\n</html>\n'
    if own is None:
        return shell.format(escape(title), f"<pre>{escape(_text(m))}</pre>")
    page = _decoded(own)
    if "<html" not in page.lower():
        page = shell.format(escape(title), page)
    page, charset = re.sub(r"(?i)<meta[^>]+charset[^>]*>", "", page), '<meta charset="utf-8">'
    for opening, added in ((r"(?i)<head\b[^>]*>", f"\n{charset}"), (r"(?i)<html\b[^>]*>", f"\n<head>{charset}</head>")):
        at = re.search(opening, page)
        if at:
            return page[: at.end()] + added + page[at.end() :]
    return f"{charset}\n{page}"


def split_mbox(data) -> list[bytes]:
    """Messages between lines that start with `From `; quoted such lines lose one >."""
    parts = re.split(rb"(?m)^From [^\n]*\n", bytes(data or b""))[1:]
    return [re.sub(rb"(?m)^>(>*From )", rb"\1", p) for p in parts]


@arrow_udf("string")
def eml_text(content: pd.Series) -> pd.Series:
    """Messages as text for search; null is read as an empty message."""
    return content.map(message_text)


@arrow_udf("string")
def eml_markdown(content: pd.Series) -> pd.Series:
    return content.map(lambda d: _markdown(_message(d)))


@arrow_udf("string")
def eml_html(content: pd.Series, name: pd.Series) -> pd.Series:
    """Messages as pages; name is the title of those without a subject."""
    return pd.Series([_page(_message(d), n or "") for d, n in zip(content, name)])


def _block(m) -> str:
    return f"# {_header(m, 'Subject') or '(no subject)'}\n{_text(m)}"


@arrow_udf("string")
def mbox_text(content: pd.Series) -> pd.Series:
    """Mailboxes as text: each message below its subject, in order; no message, no text."""
    return content.map(lambda d: "\n".join(_block(_message(p)) for p in split_mbox(d)))


@arrow_udf("string")
def mbox_markdown(content: pd.Series, name: pd.Series) -> pd.Series:
    """Mailboxes as markdown below their name: subject, sender and date, body of each message."""

    def section(m) -> str:
        head = " · ".join(x for x in (", ".join(_named(m, "From")), _iso(m)) if x)
        return f"## {_header(m, 'Subject') or '(no subject)'}\n\n{head}\n\n{_body(m).rstrip(chr(10))}\n"

    return pd.Series([f"# {n or ''}\n\n" + "\n".join(section(_message(p)) for p in split_mbox(d)) for d, n in zip(content, name)])


@arrow_udf("array<binary>")
def messages(content: pd.Series) -> pd.Series:
    return content.map(split_mbox)


_SUMMARY = (
    "struct<sender:array<string>,recipients:array<string>,date:timestamp,subject:string,message_id:string,in_reply_to:string,references:array<string>,"
    "attachments:array<struct<name:string,type:string,size:bigint>>,from:array<string>,to:array<string>,cc:array<string>,sent:string,parts:int,has_html:boolean>"
)


@arrow_udf(_SUMMARY)
def summary(content: pd.Series) -> pd.DataFrame:
    rows = []
    for data in content:
        m = _message(data)
        ids = lambda h: re.findall(_ID, _header(m, h))  # noqa: E731, B023
        bare = lambda *hs: [a for h in hs for _, a in _people(m, h) if a]  # noqa: E731, B023
        when = _sent(m)
        rows.append(
            {
                "sender": bare("From"), "recipients": bare("To", "Cc"), "date": when and when.astimezone(UTC).replace(tzinfo=None),
                "subject": _header(m, "Subject") or None, "message_id": next(iter(ids("Message-ID")), None), "in_reply_to": next(iter(ids("In-Reply-To")), None), "references": ids("References"),
                "attachments": _attachments(m), "from": _named(m, "From"), "to": _named(m, "To"), "cc": _named(m, "Cc"), "sent": _iso(m) or None, "parts": sum(1 for _ in m.walk()), "has_html": _part(m, "html") is not None,
            }
        )
    out = pd.DataFrame(rows)
    out["date"] = pd.to_datetime(out["date"], errors="coerce")
    return out


def sender_counts(messages: DataFrame, most: int, by: list[str] = (), place: str = "place") -> DataFrame:
    """(by, sender, messages, rank): the senders of most messages, at most `most` of them; of equal ones the one that wrote first.

    messages has from (array<string>) and its place in the mailbox. Messages without a sender count for none.
    """
    by = list(by)
    counted = messages.select(*by, F.col(place).alias("_place"), F.explode("from").alias("sender")).groupBy(*by, "sender").agg(F.count("*").alias("messages"), F.min("_place").alias("_first"))
    order = [F.desc("messages"), F.asc("_first"), F.asc("sender")]
    if not by:
        counted = counted.orderBy(*order).limit(most)
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*by or [F.lit(0)]).orderBy(*order)))
    return ranked.where(F.col("rank") <= most).drop("_first")


def mailbox_details(messages: DataFrame, box: str, place: str = "place", most: int = 5) -> DataFrame:
    """(box, messages, first_date, last_date, senders): what mailboxes hold, a row each.

    messages (box, place, from, sent) are read mails. Dates are the least and the greatest of sent, null where no message
    has one; senders are the five of most messages. Null boxes are one box; an empty table gives no rows.
    """
    counts = messages.groupBy(box).agg(F.count("*").alias("messages"), F.min("sent").alias("first_date"), F.max("sent").alias("last_date"))
    top = sender_counts(messages, most, [box], place).groupBy(F.col(box).alias("_box")).agg(F.array_sort(F.collect_list(F.struct("rank", "sender", "messages"))).alias("_top"))  # five at most
    senders = F.transform(F.coalesce("_top", F.array().cast("array<struct<rank:int,sender:string,messages:bigint>>")), lambda t: F.struct(t["sender"].alias("sender"), t["messages"].alias("messages")))
    return counts.join(top, F.col(box).eqNullSafe(F.col("_box")), "left").select(box, "messages", "first_date", "last_date", senders.alias("senders"))


def threads(mail: DataFrame, where: str = "where") -> DataFrame:
    """mail (where, message_id, in_reply_to, references, date, ...) with thread and depth.

    Only messages that are there link: a message is linked to the holder of each id that it
    names, and copies of one message are linked with each other, as their id is held by the
    one of least where. A message without an id is a thread of its own unless it names
    others. thread is the where of a thread's earliest message (undated ones last, then by
    where); depth counts the messages of the reply chain up to one whose parent is absent,
    in a loop those passed before one comes again.

    where must be unique and not null. Empty ids are none; null references are none; an
    empty table gives an empty result; columns named thread and depth are replaced.
    """
    from paperloom.operators.graph import chain_lengths, components

    own = mail.select(
        F.col(where).alias("_w"), F.nullif("message_id", F.lit("")).alias("_id"), F.nullif("in_reply_to", F.lit("")).alias("_up"), F.coalesce("references", F.array().cast("array<string>")).alias("_refs"), F.col("date").alias("_date")
    )
    holders = own.where("_id IS NOT NULL").groupBy("_id").agg(F.min("_w").alias("_holder"))
    # One list of names: a message's own id meets the first of its copies like any other.
    named = own.select("_w", F.explode(F.array_distinct(F.array_compact(F.concat(F.array("_id", "_up"), "_refs")))).alias("_id"))
    links = named.join(holders, "_id").where("_w <> _holder").select("_w", "_holder")
    found = components(links, "_w", "_holder").select(F.col("node").alias("_w"), "component")
    grouped = own.select("_w", "_date").join(found, "_w", "left").withColumn("component", F.coalesce("component", "_w"))
    first = grouped.groupBy("component").agg(F.min(F.struct(F.col("_date").isNull().alias("undated"), "_date", "_w"))["_w"].alias("thread"))
    parents = own.select("_w", F.col("_up").alias("_id")).join(holders, "_id", "left").select("_w", F.col("_holder").alias("_p"))
    deep = chain_lengths(parents, "_w", "_p")
    return mail.drop("thread", "depth").join(grouped.select("_w", "component").join(first, "component").join(deep, "_w").select("_w", "thread", "depth"), F.col(where) == F.col("_w")).drop("_w")
