"""Texts read from pages and mails, and texts for reading aloud."""

import io
import random
import re
from email import policy
from email.message import EmailMessage
from email.parser import BytesParser

import pytest
from pyspark.sql import functions as F

from paperloom.operators import spoken
from paperloom.sources import files, html, mail


def of(spark, make, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in rows.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def pieces(text, most):
    """Greedy pieces, sentence by sentence."""
    out, cur = [], ""
    for paragraph in re.split(r"\n{2,}", text):
        gap = "\n\n"
        for sentence in re.split(r"(?<=[.!?])\s+", " ".join(paragraph.split())):
            while sentence:
                head, sentence = sentence[:most], sentence[most:]
                if cur and len(cur + gap + head) <= most:
                    cur += gap + head
                else:
                    out, cur = out + [cur] * bool(cur), head
                gap = " "
    return out + [cur] * bool(cur)


def test_chunks(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "é", "😀", "b" * 7, ". ", "! ", ".", " ", "\n", "\n\n", "\t"]) for _ in range(r.randrange(400))) for _ in range(300)]
    texts += ["", "   \n\n ", "x" * 95, "A b. " * 40, "y" * 20 + ". " + "z" * 45 + ". k.", "퟿" * 41]
    for most in (20, 37):
        assert of(spark, lambda t: spoken.chunks(t, most), *texts) == [pieces(t, most) for t in texts]
    assert of(spark, spoken.chunks, None) == [None]


def test_long_text_in_chunks(spark):
    text = "Word one. " * 300_000 + "w" * 100_000
    (got,) = of(spark, spoken.chunks, text)
    assert "".join(got).replace(" ", "") == text.replace(" ", "")
    assert {len(x) for x in got[:749]} == {3999} and max(map(len, got)) == 4000


def test_narration(spark):
    text = "> A *quoted* thought.\r\n\r\n\r\n![a lamp](l.png) and ![](d.png) here <https://x.y>\n- - -\n  2) item __two *and* three__\n~~~py\n```\n# no\n~~~ end\n### Why? ###\n#tight\n# \n```\nopen"
    assert of(spark, spoken.narration, text, "", None, "\n\n") == [
        "A quoted thought.\n\na lamp and here\n\nitem two and three\n\n[code omitted]\n\nChapter: Why?\n\n#tight\n\nChapter: \n\n[code omitted]\n", "\n", None, "\n",
    ]


def test_chapters(spark):
    cut = lambda *ts: [c and [tuple(x) for x in c] for c in of(spark, lambda t: spoken.chapters(t, F.lit("name")), *ts)]
    flat = "just a paragraph\n\nanother\n"
    assert cut(flat, "", None, "# Only\nx") == [[("name", flat)], [("name", "")], None, [("name", "# Only\nx")]]
    assert cut("## First\n\nalpha\n\n## Second\n\nbeta\n") == [[("First", "## First\n\nalpha\n"), ("Second", "## Second\n\nbeta")]]
    assert cut("pre\n# Real *one*\n\n```\n# not\n```\n\n# \n## sub\nmore") == [[("name", "pre"), ("Real one", "# Real *one*\n\n```\n# not\n```\n"), ("name", "# \n## sub\nmore")]]
    assert cut("\n \n# A\n~~~\n# B\n```\n# C") == [[("name", "\n \n# A\n~~~\n# B\n```\n# C")]]
    assert cut("# A\n" + "line\n\n" * 50_000 + "# B\n```\n" + "# x\n" * 50_000)[0][1][0] == "B"
    assert of(spark, spoken.slug, "Été: One & Two!", "***", None, "a" * 47 + "-b") == ["t-one-two", "chapter", None, "a" * 47]


def test_html_text(spark):
    page = "<head><title>t</title></head><p>a  b</p><p></p><div></div><ul><li> c<li>d&amp;&nbsp;</ul><hr>e<td>f</td><script>x</script>"
    assert of(spark, html.html_text, page, "", None, "<p>a</p><p></p><div></div><p>b</p>") == ["a  b\n\nc\nd&\xa0ef\n", "\n", None, "a\n\nb\n"]


@pytest.fixture
def message():
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Date"], m["Message-ID"] = "Ann | A <a@x.y>", "b@x.y", "Über", "Tue, 03 Mar 2026 09:00:00 -0000", "<1@x>"
    m.set_content("Hello\n\nthere\n")
    inner = EmailMessage()
    inner["Subject"] = "inner"
    inner.set_content("forwarded")
    inner.add_attachment(b"123", maintype="application", subtype="pdf", filename="in.pdf")
    m.add_attachment(inner)
    m.add_attachment(b"12345", maintype="application", subtype="octet-stream")
    return m


def test_message_text(message):
    assert mail.message_text(message.as_bytes()) == (
        "From: Ann | A <a@x.y>\nTo: b@x.y\nDate: 2026-03-03T09:00:00+00:00\nSubject: Über\nMessage-ID: <1@x>\n\nHello\n\nthere\n\nattachment: in.pdf (application/pdf, 3 bytes)\nattachment: attachment-2 (application/octet-stream, 5 bytes)\n"
    )
    assert mail.message_text(None) == "\n\n"
    wrong = b"Date: Tue, 03 Mar 99999999 00:00:00 +0000\nTo: =?utf-8?q?a=0Ab?= <x@y>\nContent-Type: text/plain; charset=nonsense\nContent-Transfer-Encoding: 8bit\n\ncaf\xe9\n"
    assert mail.message_text(wrong).endswith("\n\ncafé\n") and "Date" not in mail.message_text(wrong)


def test_mail_forms(spark, message):
    page = EmailMessage()
    page["Subject"] = "A <b>"
    page.set_content('<html><head><meta charset="latin1"></head><body><p>x</p></body></html>', subtype="html")
    box = b"From a b\n" + message.as_bytes() + b"\n\nFrom a b\n" + page.as_bytes()
    rows = spark.createDataFrame([(message.as_bytes(), page.as_bytes(), box)], "m binary, h binary, b binary")
    r = rows.select(
        mail.eml_markdown("m").alias("md"), mail.eml_html("m", F.lit("n")).alias("shown"), mail.eml_html("h", F.lit("n")).alias("own"), mail.mbox_text("b").alias("text"), mail.mbox_markdown("b", F.lit("all.mbox")).alias("all"), mail.summary("m").alias("s"), mail.mbox_text("m").alias("none")
    ).first()
    assert r["md"].startswith("# Über\n\n| header | value |\n|---|---|\n| From | Ann \\| A <a@x.y> |") and r["md"].endswith("there\n\n\n## Attachments\n\n- `in.pdf` (application/pdf, 3 bytes)\n- `attachment-2` (application/octet-stream, 5 bytes)\n")
    assert "<title>Über</title>" in r["shown"] and "<pre>From: Ann | A &lt;a@x.y&gt;" in r["shown"]
    assert r["own"].startswith('<html><head>\n<meta charset="utf-8"></head>') and "latin1" not in r["own"]
    assert r["text"].startswith("# Über\nFrom:") and "\n\n# A <b>\nSubject: A <b>\n\nx\n" in r["text"] and r["none"] == ""
    assert r["all"].startswith("# all.mbox\n\n## Über\n\nAnn | A <a@x.y> · 2026-03-03T09:00:00+00:00\n\nHello")
    assert r["s"]["from"] == ["Ann | A <a@x.y>"] and r["s"]["parts"] == 7 and not r["s"]["has_html"] and [a["size"] for a in r["s"]["attachments"]] == [3, 5]


def test_rows_of_csv_and_leaves_of_json_as_text(spark):
    rows = [("a.csv", "csv", b'\xef\xbb\xbfn,v\r\n"x, y","1\n2"\n'), ("a.json", "json", b'{"a": {"b": [1]}}'), ("a.xml", "xml", b"<r><p>x</p>y</r>"), ("a.png", "png", b"\x89")]
    got = {r["path"]: r["text"] for r in files.extract_text(spark.createDataFrame(rows, "path string, type string, content binary"), final_newline=True).collect()}
    assert got == {"a.csv": "n, v\nx, y, 1\n2\n", "a.json": "a.b.0: 1\n", "a.xml": "x\ny\n", "a.png": None}


def test_bodies_are_not_read_line_by_line(monkeypatch):
    """Messages without parts are as the whole parser reads them, but the parser sees their headers alone."""
    r = random.Random(8)
    pieces = [b"Subject: a\r\n", b"To: x@y.z, B <b@y.z>\n", b"Content-Type: text/html; charset=utf-8\n", b"Content-Type: multipart/mixed; boundary=b\n", b"Content-Type: message/rfc822\n", b"Content-Transfer-Encoding: base64\n", b" folded\n", b"From me\n", b"no header\n", b"\n", b"\r", b"bGluZQ==\n", b"--b\n", b"--b--\n", b"\xc3\xa9\x85\x0b:\n", b": x\n", b"end"]
    for _ in range(3000):
        data = b"".join(r.choices(pieces, k=r.randint(0, 8)))
        whole, m = BytesParser(policy=policy.default).parse(io.BytesIO(data)), mail._message(data)
        assert [(k, str(v)) for k, v in m.raw_items()] == [(k, str(v)) for k, v in whole.raw_items()], data
        assert [(x.get_content_type(), str(x._payload) if not x.is_multipart() else len(x._payload)) for x in m.walk()] == [(x.get_content_type(), str(x._payload) if not x.is_multipart() else len(x._payload)) for x in whole.walk()], data
        assert mail._text(m) == mail._text(whole) and mail._markdown(m) == mail._markdown(whole), data
    monkeypatch.setattr(mail, "BytesParser", None)
    assert mail.message_text(b"Subject: s\n\n" + b"line\n" * 3).endswith("line\nline\nline\n")


def test_mailbox_details(spark):
    rows = [("a", 1, ["x"], "2026-01-02"), ("a", 2, ["y", "x"], None), ("a", 3, ["y"], "2026-01-01"), ("b", 1, [], None), (None, 1, None, None), ("c", 9, list("zyxwvu"), "2026-01-01")]
    mails = spark.createDataFrame(rows, "box string, place int, `from` array<string>, sent string")
    got = {r["box"]: (r["messages"], r["first_date"], r["last_date"], [tuple(s) for s in r["senders"]]) for r in mail.mailbox_details(mails, "box").collect()}
    assert got == {"a": (3, "2026-01-01", "2026-01-02", [("x", 2), ("y", 2)]), "b": (1, None, None, []), None: (1, None, None, []), "c": (1, "2026-01-01", "2026-01-01", [(x, 1) for x in "uvwxy"])}
    assert mail.mailbox_details(mails.limit(0), "box").isEmpty()
    assert [tuple(r) for r in mail.sender_counts(mails, 2).collect()] == [("x", 3, 1), ("y", 3, 2)]
