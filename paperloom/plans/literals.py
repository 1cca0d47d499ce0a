"""Rule tables as queries: literal inputs through the library, against what they must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import dates, meta, money, patterns
from paperloom.operators import catalog, fields, index, refs, search
from paperloom.plans import views as V
from paperloom.plans.registry import DOCS, TERMS, _bm25_sql, query


def _quoted(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows) + f") AS t({names})"


def _table(spark, rows: list[tuple], schema: str):
    width = len(schema.split(","))
    return spark.createDataFrame([r[:width] for r in rows], schema)


MONEY = [
    ("$1,234.56", "1234.56", "USD"), ("1.234,56 €", "1234.56", "EUR"), ("(123.45)", "-123.45", None), ("123.45-", "-123.45", None), ("EUR 12", "12", "EUR"), ("1 234,56", "1234.56", None),
    ("USD 1,000", "1000", "USD"), ("12.5 CR", "-12.5", None), ("12.5 DR", "12.5", None), ("1'234.50", "1234.50", None), ("-5.00", "-5.00", None), ("£0.99", "0.99", "GBP"), ("-$1,234.56", "-1234.56", "USD"), ("EUR -5", "-5", "EUR"),
    ("MXN 7", "7", "MXN"), ("5 %, 2026.03.04, 2026-0042, 12 of 40", None, None), ("1,2345", None, None), ("x$5.00", None, None), ("rate 5.5% a year", "5.5", None), ("Total $1,234.56 and 84.56 on 09/10/2026, 1.000,00 EUR, qty 10", "1234.56;84.56;1000.00", "USD;EUR"),
]


@query("money_literals", _values(MONEY, "txt, value, currency"))
def _(spark, d):
    found = _table(spark, MONEY, "txt string").withColumn("a", money.amounts(F.col("txt")))
    joined = lambda f: F.nullif(F.array_join(F.transform("a", lambda x: x[f]), ";"), F.lit(""))
    return found.select("txt", joined("value").alias("value"), joined("currency").alias("currency"))


DATES = [
    ("2026-03-04, March 5, 2026; 6 Apr 2026 and 2026/7/8", "mdy", "2026-03-04;2026-03-05;2026-04-06;2026-07-08", 0), ("09/10/2026", "mdy", "2026-09-10", 1), ("09/10/2026", "dmy", "2026-10-09", 1), ("31/12/26", "mdy", "2026-12-31", 0),
    ("30 February 2026", "mdy", "", 0), ("v1.2.3.4", "mdy", "", 0), ("10.09.2026", "dmy", "2026-09-10", 1), ("1st Sept. 2026 or Sep 3rd, 2026", "mdy", "2026-09-01;2026-09-03", 0), ("2026-13-01 12/12/2026", "mdy", "2026-12-12", 0), ("2026-02-30", "mdy", "", 0),
]


@query("dates_literals", _values(DATES, "txt, ord, found, unsure"))
def _(spark, d):
    rows = _table(spark, DATES, "txt string, ord string")
    both = rows.withColumn("f", F.when(F.col("ord") == "mdy", dates.dates(F.col("txt"), "mdy")).otherwise(dates.dates(F.col("txt"), "dmy")))
    return both.select("txt", "ord", F.array_join(F.transform("f", lambda x: x["value"].cast("string")), ";").alias("found"), F.size(F.filter("f", lambda x: x["ambiguous"])).alias("unsure"))


META = [
    (" true ", "bool", "true"), ("1,234.50", "num", "1234.5"), ("-0", "num", "0"), ("+5", "num", "5"), ("0,123", "num", "123"), ("100", "num", "100"), ("2026-10-01", "date", "2026-10-01"), ("2026-13-01", "str", "2026-13-01"),
    ("1e5", "str", "1e5"), ("02134", "str", "02134"), ("Acme", "str", "Acme"), ("yes", "str", "yes"),
]


@query("meta_literals", _values(META, "given, kind, value"))
def _(spark, d):
    kind = meta.infer_kind(F.col("given"))
    return _table(spark, META, "given string").select("given", kind.alias("kind"), meta.canonical(F.col("given"), kind).alias("value"))


COERCED = [("yes", "bool", "true"), ("0", "bool", "false"), ("1", "bool", "true"), ("maybe", "bool", None), ("99", "str", "99"), ("abc", "num", None), ("+1,000.50", "num", "1000.5"), ("2026-01-05", "date", "2026-01-05"), ("2026-1-5", "date", None)]


@query("meta_coerce_literals", _values(COERCED, "given, kind, value"))
def _(spark, d):
    rows, out = _table(spark, COERCED, "given string, kind string"), F.lit(None).cast("string")
    for kind in meta.KINDS:
        out = F.when(F.col("kind") == kind, meta.coerced(F.col("given"), kind)).otherwise(out)
    return rows.select("given", "kind", out.alias("value"))


STORED = [("f1", "paid", "true"), ("f2", "paid", "1"), ("f3", "zip", "02134"), ("f4", "share", "50%"), ("f5", "n", "10"), ("f6", "n", "9"), ("f7", "due", "2026-10-01"), ("f8", "vendor", "Acme")]
ASKED = [("paid=1", "f2"), ("paid=yes", "f1"), ("paid!=1", "f1"), ("zip=02134", "f3"), ("share~0%", "f4"), ("n>9.5", "f5"), ("n<=9", "f6"), ("n=10.0", "f5"), ("due<2027", "f7"), ("vendor=ACME", "f8"), ("absent!=x", None), ("paid?", "f1;f2")]


@query("meta_condition_literals", _values(ASKED, "asked, paths"))
def _(spark, d):
    stored = catalog.meta_rows(spark.createDataFrame(STORED, "path string, key string, value string"))
    out = None
    for asked, _ in ASKED:
        one = catalog.meta_find(stored, [asked]).agg(F.lit(asked).alias("asked"), F.nullif(F.array_join(F.array_sort(F.collect_list("path")), ";"), F.lit("")).alias("paths"))
        out = one if out is None else out.unionByName(one)
    return out


KINDS = [
    ("email", "write to a.b+c@d-e.org, or x@y", "a.b+c@d-e.org"), ("phone", "+1 (555) 123-4567 and 555.123.4567", "+1 (555) 123-4567;555.123.4567"), ("ssn", "078-05-1120 and 1078-05-1120", "078-05-1120"), ("ipv4", "10.0.0.255 10.0.0.256", "10.0.0.255"),
    ("cc", "4111 1111 1111 1111, 4111 1111 1111 1112", "4111 1111 1111 1111"), ("invoice", "Invoice 4711, invoices are late, INV-77", "4711;INV-77"), ("po", "PO Box 12, P.O. 55a, PO-9", "55A;PO-9"), ("order", "order to 12, Order No. 55x", "55X"),
    ("check", "check 1234, Check # 1234", "1234"), ("account", "Acct. No: XXXX-1234", "XXXX-1234"), ("tracking", "Tracking: ab12345678", "AB12345678"), ("ticket", "ABC-1234 INV-1234 ABC-12-3", "ABC-1234"),
    ("iban", "GB82 WEST 1234 5698 7654 32 and DE89370400440532013001", "GB82WEST12345698765432"), ("iban", "QQ55000000000000000000", None), ("routing", "at 021000021. or 1-021000021-2", "021000021"), ("ein", "12-3456789", "12-3456789"), ("vat", "DE123456789, VAT No: DE123456789", "DE123456789"),
    ("isbn", "ISBN 978-0-306-40615-7, ISBN: 0 306 40615 3", "978-0-306-40615-7"), ("gtin", "EAN 4006381333931 UPC 96385075", "4006381333931"), ("doi", "see 10.1000/xyz123. or 10.1000/what!", "10.1000/xyz123;10.1000/what!"), ("ups", "1z999aa10123456784", "1Z999AA10123456784"),
    ("usps", "9400111899223197428490", "9400111899223197428490"), (r"tick=(foo|bar)-\d+", "foo-12 bar-3", "foo-12;bar-3"), (r"case=CASE-(?P<v1>\d+)|C(?P<v2>x)", "CASE-7 Cx", "7;x"),
]


@query("kind_literals", _values(KINDS, "kind, txt, found"))
def _(spark, d):
    rows, out = _table(spark, KINDS, "kind string, txt string"), F.lit(None).cast("string")
    for name in dict.fromkeys(k for k, _, _ in KINDS):
        kind = patterns.custom(name) if "=" in name else patterns.REGISTRY[name]
        out = F.when(F.col("kind") == name, F.array_join(kind.values(F.col("txt")), ";")).otherwise(out)
    return rows.select("kind", "txt", F.nullif(out, F.lit("")).alias("found"))


FIELDS = [
    ("a", "Acme Ltd\nTotal units  3.00\nTotal  -$1,234.56\nTax ID: 12-3456789\nTax  $84.56\nDate:\n\n2026-03-04\nNet 30\n", "vendor=Acme Ltd:medium;date=2026-03-04:high;due=2026-04-03:medium;currency=USD:high;tax=84.56:high;total=-1234.56:high"),
    ("inv/b-7.txt", "Dear customer,\nInvoice 4711\nDate: 2026-03-04\nNet  500.00\nPay by 5 May 2026", "vendor=b-7:low;invoice_no=4711:high;date=2026-03-04:high;due=2026-05-05:high;subtotal=500.00:high;total=500.00:medium"),
    ("c", "From: \"Ann Lee\" <ann@lee.org>\n$1.50 and 1.50 € and 2.00 €\nIBAN GB82 WEST 1234 5698 7654 32\nAccount No: 12345678", "vendor=Ann Lee:high;iban=GB82WEST12345698765432:high;account_last4=5678:high;currency=EUR:high;total=2.00:medium"),
    ("d", "From: bill@host.example\nhttp://x.y\nReceipt\nGrand total: 7.00\nTotal (incl.): USD 9", "vendor=host.example:high;currency=USD:high;total=9:high"),
    ("e.txt", "", "vendor=e:low"),
]


@query("fields_literals", _values(FIELDS, "path, content, found"))
def _(spark, d):
    rows = _table(spark, FIELDS, "path string, content string")
    shown = [F.concat(F.lit(f + "="), F.col(f"fields.{f}.value"), F.lit(":"), F.col(f"fields.{f}.confidence")) for f in fields.FIELDS if f != "profile"]
    return rows.join(fields.extract(rows), "path").select("path", "content", F.concat_ws(";", *shown).alias("found"))


query("bm25_not_implicit", _bm25_sql([(["anin"], False), (["ertion"], False), (["of"], False)], "f0 > 0 AND NOT (f1 > 0 AND f2 > 0)", [0]))(
    lambda spark, d: search.search(V.docs(spark, d), "anin NOT ertion of").withColumn("score", F.round("score", 6))
)


_FOLDERS: dict = {}


def _folder(spark, d, made: str, write) -> str:
    """The index of this name over d's documents, written once in an application."""
    import uuid

    from paperloom.session import shared_dir

    key = (spark.sparkContext.applicationId, d, made)
    if key not in _FOLDERS:
        folder = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
        write(V.docs(spark, d).select("path", "content", "doc_id"), folder)
        _FOLDERS[key] = folder
    return _FOLDERS[key]


def _in_steps(docs, folder: str) -> None:
    """Three generations: first texts that change later, some that go, then the rest."""
    third = F.col("doc_id") % 3
    gone = docs.where(third == 2).limit(3).withColumn("path", F.concat(F.lit("gone/"), "path"))
    index.write(docs.where(third < 2).withColumn("content", F.when(third == 1, F.lit("anin old text")).otherwise(F.col("content"))).unionByName(gone), folder)
    index.update(docs.where(third == 1), folder, removed=gone)
    index.update(docs.where(third == 2), folder)


def _indexed(spark, d, q: str):
    return index.search(spark, _folder(spark, d, "steps", _in_steps), q).withColumn("score", F.round("score", 6))


def _topped(q: str, made: str = "whole", write=index.write):
    return lambda spark, d: index.top(spark, _folder(spark, d, made, write), q).withColumn("score", F.round("score", 6))


query("index_top_and", _bm25_sql([(["anin"], False), (["ertion"], False)], "f0 > 0 AND f1 > 0", [0, 1]))(_topped("anin ertion"))
query("index_top_or", _bm25_sql([(["the"], False), (["of"], False), (["anin"], False)], "f0 > 0 OR f1 > 0 OR f2 > 0", [0, 1, 2]))(_topped("the OR of OR anin"))
query("index_top_not", _bm25_sql([(["the"], False), (["of"], False)], "f0 > 0 AND f1 = 0", [0]))(_topped("the NOT of"))
query("index_top_updated", _bm25_sql([(["anin"], False), (["of"], False)], "f0 > 0 OR f1 > 0", [0, 1]))(_topped("anin OR of", "steps", _in_steps))

MARKED_RUN = f"""
WITH top AS ({_bm25_sql([(["of", "the"], False), (["anin"], False), (["schung"], True)], "f0 > 0 OR f1 > 0 OR f2 > 0", [0, 1, 2])}),
t AS (SELECT path, regexp_extract_all(content, '[\\p{{L}}\\p{{N}}]+') AS w, {TERMS} AS ts FROM ({DOCS}) WHERE path IN (SELECT path FROM top)),
h AS (SELECT *, list_filter(range(len(ts)), lambda i: ts[i + 1] = 'of' AND ts[i + 2] = 'the') AS s0, list_filter(range(len(ts)), lambda i: ts[i + 1] = 'anin') AS s1, list_filter(range(len(ts)), lambda i: starts_with(ts[i + 1], 'schung')) AS s2 FROM t),
c AS (SELECT path, i, CAST(len(list_filter(s0, lambda s: s >= i AND s <= i + 10)) > 0 AS INT) + CAST(len(list_filter(s1, lambda s: s >= i AND s <= i + 11)) > 0 AS INT) + CAST(len(list_filter(s2, lambda s: s >= i AND s <= i + 11)) > 0 AS INT) AS n
  FROM (SELECT *, unnest(range(len(ts))) AS i FROM h)),
b AS (SELECT path, arg_min(i, (-n, i)) AS i FROM c GROUP BY path)
SELECT path, score, CASE WHEN i > 0 THEN '… ' ELSE '' END || array_to_string(list_transform(range(i, least(i + 12, len(w))), lambda k: CASE WHEN list_contains(s0, k) OR list_contains(s0, k - 1) OR list_contains(s1, k) OR list_contains(s2, k) THEN '[' || w[k + 1] || ']' ELSE w[k + 1] END), ' ')
  || CASE WHEN i + 12 < len(w) THEN ' …' ELSE '' END AS snippet FROM top JOIN h USING (path) JOIN b USING (path)"""


@query("snippet_positions", MARKED_RUN)
def _(spark, d):
    folder, q = _folder(spark, d, "whole", index.write), '"of the" OR anin OR schung*'
    found = index.search(spark, folder, q).withColumn("score", F.round("score", 6))
    return index.marked(spark, folder, q, found, V.docs(spark, d))


query("index_and", _bm25_sql([(["anin"], False), (["ertion"], False)], "f0 > 0 AND f1 > 0", [0, 1]))(lambda spark, d: _indexed(spark, d, "anin ertion"))
query("index_phrase_or_prefix", _bm25_sql([(["of", "the"], False), (["schung"], True)], "f0 > 0 OR f1 > 0", [0, 1]))(lambda spark, d: _indexed(spark, d, '"of the" OR schung*'))


@query("refs_custom_redact", "SELECT 'foo-12 <KEEP> a@b.co' AS txt, '[TICK] <KEEP> [EMAIL]' AS redacted")
def _(spark, d):
    rows = spark.createDataFrame([("foo-12 <KEEP> a@b.co",)], "txt string")
    return rows.select("txt", refs.redact(F.col("txt"), ["email"], extra=[r"tick=(foo|bar)-\d+"]).alias("redacted"))
