"""Texts of pages, mails and markdown as queries: what is read, how it is cut, how it is read out."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import spoken
from paperloom.plans import views as V
from paperloom.plans.registry import DOCS, query
from paperloom.session import spread, table
from paperloom.sources import html, mail

# --- pages --------------------------------------------------------------------------------

ENTITIES = "replace(replace(replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_SILENT = "regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<head[\\s>].*?</head>', '', 'g')"
_BROKEN = f"regexp_replace(regexp_replace({_SILENT}, '(?i)</?(p|div|br|li|tr|h[1-6]|section|article|table)([\\s/][^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g')"
_STRIPPED = f"list_transform(string_split({ENTITIES.format(x=_BROKEN)}, chr(10)), lambda x: trim(x))"


@query("html_text", f"SELECT page_id, regexp_replace(regexp_replace(array_to_string({_STRIPPED}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') || chr(10) AS text FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", html.html_text("html").alias("text"))


_BARE = "trim(regexp_replace(" + ENTITIES.format(x="regexp_replace({x}, '<[^>]*>', '', 'g')") + ", '\\s+', ' ', 'g'))"


@query("html_headings", f"""
SELECT page_id, {_BARE.format(x="regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, i AS place, CAST(regexp_extract(h, '[1-6]') AS INTEGER) AS level, {_BARE.format(x='h')} AS heading
FROM (SELECT page_id, html, unnest(regexp_extract_all(html, '(?s)<h[1-6][\\s>].*?</h[1-6]>')) AS h, generate_subscripts(regexp_extract_all(html, '(?s)<h[1-6][\\s>].*?</h[1-6]>'), 1) - 1 AS i FROM pages)""")
def _(spark, d):
    """The outline of each page, a row a heading."""
    read = table(spark, d, "pages").select("page_id", html.title("html").alias("title"), F.posexplode(html.headings("html")).alias("place", "h"))
    return read.select("page_id", "title", F.col("place").cast("bigint").alias("place"), "h.level", F.col("h.text").alias("heading"))


# --- mails --------------------------------------------------------------------------------

#: Mails made of turns: plain ones, ones with an attached note, ones that are HTML.

def _head(kind: str):
    return F.concat(
        F.lit('From: "Ann, A." <'), F.col("role"), F.lit("@desk.example>\r\nTo: b@desk.example, Cy <c@desk.example>\r\nDate: Tue, 03 Mar 2026 09:30:0"), (F.col("turn") % 10).cast("string"),
        F.lit(" +0200\r\nSubject: Turn "), F.col("turn").cast("string"), F.lit("\r\nMessage-ID: <"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit(f"@desk>\r\nMIME-Version: 1.0\r\nContent-Type: {kind}\r\n"),
    )


def _raw():
    """Mails made of turns: plain ones, ones with an attached note, ones that are HTML."""
    body, plain, rich = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), "text/plain; charset=utf-8", "text/html; charset=utf-8"
    whole = lambda kind, text: F.concat(_head(kind), F.lit("Content-Transfer-Encoding: 8bit\r\n\r\n"), text, F.lit("\r\n"))
    part = lambda kind, text, more="": F.concat(F.lit(f"--==cut\r\nContent-Type: {kind}\r\n{more}Content-Transfer-Encoding: 8bit\r\n\r\n"), text, F.lit("\r\n"))
    note = F.base64(F.encode(F.concat(F.lit("note "), F.col("turn").cast("string")), "utf-8"))
    attached = F.concat(_head('multipart/mixed; boundary="==cut"'), F.lit("\r\n"), part(plain, body), F.lit('--==cut\r\nContent-Type: text/csv\r\nContent-Disposition: attachment; filename="n.csv"\r\nContent-Transfer-Encoding: base64\r\n\r\n'), note, F.lit("\r\n--==cut--\r\n"))
    marked = F.concat(F.lit("<html><head><title>t</title></head><body><p>"), F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p><p>bye</p></body></html>"))
    return F.when(F.col("turn") % 3 == 0, whole(plain, body)).when(F.col("turn") % 3 == 1, attached).otherwise(whole(rich, marked)).cast("binary")


_FLAT = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"
_BODY = f"CASE WHEN turn % 3 = 2 THEN CASE WHEN {_FLAT} = '' THEN 'bye' ELSE {_FLAT} || chr(10) || chr(10) || 'bye' END ELSE {_FLAT} END"
_SENT = "'2026-03-03T09:30:0' || (turn % 10) || '+02:00'"
_ATTACHED = "turn % 3 = 1"
_NOTE = "'n.csv (text/csv, ' || (5 + length(CAST(turn AS VARCHAR))) || ' bytes)'"


@query("mail_text", f"""
SELECT conv_id, turn, 'From: "Ann, A." <' || role || '@desk.example>' || chr(10) || 'To: b@desk.example, Cy <c@desk.example>' || chr(10) || 'Date: ' || {_SENT} || chr(10) || 'Subject: Turn ' || turn || chr(10) || 'Message-ID: <' || conv_id || '.' || turn || '@desk>'
  || chr(10) || chr(10) || body || CASE WHEN body = '' THEN '' ELSE chr(10) END || CASE WHEN {_ATTACHED} THEN chr(10) || 'attachment: ' || {_NOTE} || chr(10) ELSE '' END AS text
FROM (SELECT conv_id, turn, role, {_BODY} AS body FROM conversations)""")
def _(spark, d):
    """Turns written as mails (plain, with an attachment, HTML) and read as text for search."""
    return spread(table(spark, d, "conversations")).select("conv_id", "turn", mail.eml_text(_raw()).alias("text"))


@query("mail_summaries", f"""
SELECT conv_id, turn, 'Ann, A. <' || role || '@desk.example>' AS sender, 'b@desk.example;Cy <c@desk.example>' AS recipients, {_SENT} AS sent, CASE WHEN {_ATTACHED} THEN 3 ELSE 1 END AS parts, turn % 3 = 2 AS has_html,
  CASE WHEN {_ATTACHED} THEN CAST(5 + length(CAST(turn AS VARCHAR)) AS BIGINT) END AS attached FROM conversations""")
def _(spark, d):
    read = spread(table(spark, d, "conversations")).select("conv_id", "turn", mail.summary(_raw()).alias("m"))
    return read.select("conv_id", "turn", F.array_join("m.from", ";").alias("sender"), F.array_join("m.to", ";").alias("recipients"), "m.sent", "m.parts", "m.has_html", F.get("m.attachments", F.lit(0))["size"].alias("attached"))


@query("mail_markdown", f"""
SELECT conv_id, turn, rtrim('# Turn ' || turn || chr(10) || chr(10) || '| header | value |' || chr(10) || '|---|---|' || chr(10) || '| From | Ann, A. <' || role || '@desk.example> |' || chr(10) || '| To | b@desk.example, Cy <c@desk.example> |' || chr(10) || '| Date | ' || {_SENT} || ' |' || chr(10)
  || '| Message-ID | <' || conv_id || '.' || turn || '@desk> |' || chr(10) || chr(10) || body || chr(10) || CASE WHEN {_ATTACHED} THEN chr(10) || chr(10) || '## Attachments' || chr(10) || chr(10) || '- `n.csv` (text/csv, ' || (5 + length(CAST(turn AS VARCHAR))) || ' bytes)' ELSE '' END, chr(10)) || chr(10) AS text
FROM (SELECT conv_id, turn, role, {_BODY} AS body FROM conversations)""")
def _(spark, d):
    flat = spread(table(spark, d, "conversations")).withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    return flat.select("conv_id", "turn", mail.eml_markdown(_raw()).alias("text"))


@query("mailbox_details", f"""
WITH m AS (SELECT conv_id, turn, role, {_SENT} AS sent FROM conversations),
s AS (SELECT conv_id, role, count(*) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, min(turn), role) AS r FROM m GROUP BY conv_id, role)
SELECT conv_id, CAST(count(*) AS BIGINT) AS messages, min(sent) AS first_date, max(sent) AS last_date, (SELECT string_agg('Ann, A. <' || role || '@desk.example>: ' || n, ';' ORDER BY r) FROM s WHERE s.conv_id = m.conv_id AND r <= 5) AS senders FROM m GROUP BY conv_id""")
def _(spark, d):
    """Conversations as mailboxes: how many messages, when, and from whom."""
    read = spread(table(spark, d, "conversations")).select("conv_id", F.col("turn").alias("place"), mail.summary(_raw()).alias("m")).select("conv_id", "place", "m.from", "m.sent")
    shown = F.array_join(F.transform("senders", lambda t: F.concat(t["sender"], F.lit(": "), t["messages"].cast("string"))), ";")
    return mail.mailbox_details(read, "conv_id").select("conv_id", "messages", "first_date", "last_date", shown.alias("senders"))


@query("mailbox_text", r"""
SELECT doc_id, '# One' || chr(10) || 'Subject: One' || chr(10) || chr(10) || body || CASE WHEN body = '' THEN '' ELSE chr(10) END || chr(10) || '# (no subject)' || chr(10) || 'From: x@desk.example' || chr(10) || chr(10) || 'From ' || lang || chr(10) AS text
FROM (SELECT doc_id, lang, regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '') AS body FROM documents)""")
def _(spark, d):
    """Each document as a mailbox of two messages, lines that begin with From quoted, read back."""
    quoted = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?m)^(>*From )", ">$1")
    utf8 = "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"
    box = F.concat(F.lit(f"From a Tue Mar  3 2026\nSubject: One\n{utf8}"), quoted, F.lit(f"\n\nFrom b Tue Mar  3 2026\nFrom: x@desk.example\n{utf8}>From "), F.col("lang"), F.lit("\n"))
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang")).select("doc_id", mail.mbox_text(box.cast("binary")).alias("text"))


# --- reading out --------------------------------------------------------------------------

_ONE = "list_filter(list_transform(string_split_regex(content, '\\n{2,}'), lambda p: regexp_replace(regexp_replace(p, '[\\s\\p{Z}\\x0B\\x1C-\\x1F\\x{85}]+', ' ', 'g'), '^ | $', '', 'g')), lambda p: p <> '')"


@query("text_chunks", f"""
WITH RECURSIVE joined AS (SELECT path, array_to_string({_ONE}, chr(10) || chr(10)) AS t FROM ({DOCS})),
pieces AS (SELECT path, unnest(string_split(m, chr(1))) AS s, generate_subscripts(string_split(m, chr(1)), 1) AS i FROM (SELECT path, replace(regexp_replace(t, '([.!?]) ', '\\1 ' || chr(1), 'g'), chr(10) || chr(10), chr(10) || chr(10) || chr(1)) AS m FROM joined)),
ends AS (SELECT path, list(e - CASE WHEN s LIKE '%' || chr(10) || chr(10) THEN 2 WHEN n > i THEN 1 ELSE 0 END) AS es, list(e) AS ns FROM (SELECT *, sum(length(s)) OVER (PARTITION BY path ORDER BY i) AS e, max(i) OVER (PARTITION BY path) AS n FROM pieces) GROUP BY path),
cuts AS (SELECT path, 0::HUGEINT AS part, 0::HUGEINT AS p, NULL::HUGEINT AS stop FROM joined WHERE t <> ''
  UNION ALL SELECT path, part + 1, coalesce(list_max(list_filter(ns, lambda e, i: es[i] = f)), f), f FROM (SELECT c.path, c.part, c.p, es, ns, coalesce(list_max(list_filter(es, lambda e: e > c.p AND e <= c.p + 4000)), c.p + 4000) AS f FROM cuts c JOIN ends USING (path) WHERE c.p < list_max(es)))
SELECT path, CAST(part - 1 AS INTEGER) AS part, substr(t, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)) AS piece
FROM (SELECT path, part, stop, lag(p) OVER (PARTITION BY path ORDER BY part) AS start FROM cuts) JOIN joined USING (path) WHERE part > 0""")
def _(spark, d):
    """Documents in pieces of at most 4,000 characters that end with sentences."""
    return V.docs(spark, d).select("path", F.posexplode(spoken.chunks(F.col("content"))).alias("part", "piece"))


def _book(level: str):
    """Markdown made of a document: its text without marks between two headings, one of them marked up, and code."""
    body = F.translate(F.regexp_replace(F.coalesce("content", F.lit("")), r"[\s\x1C-\x1F\x85]+", " "), "#*_`~[]<>!-+.)", "")
    made = [f"> intro\n\n{level} One *bold* `x` ##\n", body, f"\n```\n{level} code\n~~~\n```\n1. [link](http://a.b) and **more**\n***\n{level} ", F.upper("lang"), f"?\n{level}# deeper\n~~~ py\n```\n", body, "\n~~~\nend"]
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in made])


_PLAIN = "translate(regexp_replace(coalesce(content, ''), '[\\s\\x0B\\x1C-\\x1F\\x{85}]+', ' ', 'g'), '#*_`~[]<>!-+.)', '')"
_N = "chr(10)"


@query("narration", f"""
SELECT path, 'intro' || {_N} || {_N} || 'Chapter: One bold x.' || {_N} || {_N} || CASE WHEN trim(body) = '' THEN '' ELSE rtrim(regexp_replace(body, '  +', ' ', 'g')) || {_N} || {_N} END || '[code omitted]' || {_N} || {_N} || 'link and more' || {_N} || {_N} || 'Chapter: ' || upper(lang) || '?'
  || {_N} || {_N} || 'Chapter: deeper.' || {_N} || {_N} || '[code omitted]' || {_N} || {_N} || 'end' || {_N} AS spoken FROM (SELECT path, lang, {_PLAIN} AS body FROM ({DOCS}))""")
def _(spark, d):
    return V.docs(spark, d).select("path", spoken.narration(_book("#")).alias("spoken"))


def _chapter_sql(level: str) -> str:
    code = f"'```' || {_N} || '{level} code' || {_N} || '~~~' || {_N} || '```' || {_N}"
    return f"""
SELECT path, 0 AS chapter, path AS title, 'book' AS slug, '> intro' || {_N} AS body FROM ({DOCS})
UNION ALL SELECT path, 1, 'One bold x', 'one-bold-x', '{level} One *bold* `x` ##' || {_N} || body || {_N} || {code} || '1. [link](http://a.b) and **more**' || {_N} || '***' FROM (SELECT path, {_PLAIN} AS body FROM ({DOCS}))
UNION ALL SELECT path, 2, upper(lang) || '?', lower(lang), '{level} ' || upper(lang) || '?' || {_N} || '{level}# deeper' || {_N} || '~~~ py' || {_N} || '```' || {_N} || body || {_N} || '~~~' || {_N} || 'end' FROM (SELECT path, lang, {_PLAIN} AS body FROM ({DOCS}))"""


def _chapters(level: str):
    def run(spark, d):
        cut = V.docs(spark, d).select("path", F.posexplode(spoken.chapters(_book(level), F.col("path"))).alias("chapter", "c"))
        return cut.select("path", "chapter", "c.title", F.when(F.col("chapter") == 0, "book").otherwise(spoken.slug(F.col("c.title"))).alias("slug"), "c.body")

    return run


query("chapters_first_level", _chapter_sql("#"))(_chapters("#"))
query("chapters_second_level", _chapter_sql("##"))(_chapters("##"))
