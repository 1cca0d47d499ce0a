"""Desk operators as queries: inspection, structural differences, edits, catalogs, bundles, plans of moves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import bundle, catalog, convert, diff, inspect
from paperloom.operators.binning import numbered
from paperloom.plans import intake
from paperloom.plans import views as V
from paperloom.plans.literals import _table, _values
from paperloom.plans.registry import DOCS, query
from paperloom.session import table
from paperloom.sources import csvrows, files, listing, mail

MARKDOWN = [
    ("# One\ntext\n## Two  \n```\n# no\n```\n####### seven\n#tight\n~~~\n## no\n~~~\n### Three", "1:One;2:Two;1:tight;3:Three", 18, "L1 # One;L3 ## Two;L8 # tight;L12 ### Three"),
    ("no heading here", "", 3, ""), ("#\n# \n  ## in", "2:in", 4, "L3 ## in"),
]


@query("inspect_md_literals", _values(MARKDOWN, "txt, headings, words, outline"))
def _(spark, d):
    rows = _table(spark, MARKDOWN, "txt string").withColumn("m", inspect.markdown(F.col("txt")))
    shown = F.array_join(F.transform("m.headings", lambda h: F.concat(h["level"].cast("string"), F.lit(":"), h["text"])), ";")
    return rows.select("txt", shown.alias("headings"), F.col("m.words").alias("words"), F.array_join(inspect.outline_md(F.col("txt")), ";").alias("outline"))


DETAILS = [
    ("json", '{"a": {"b": [1, {}]}, "c": 2}', "object;2;4"), ("json", "[]", "array;0;1"), ("json", "7", "scalar;0;0"), ("json", "{", "error"), ("csv", "a;b\n1;2\n3;4\n", ";|a,b|2|2"), ("csv", "a,b,c\n1,2,3\n", ",|a,b,c|3|1"),
    ("xml", "<r><a/><b><c x='1'/></b></r>", "r;4;3"), ("xml", "<r>", "error"), ("py", "import x\n\nclass A:\n    def no(self): ...\nasync def f(): ...\n", "L3 class A;L5 async def f"), ("py", "def (", "[unparsable]"),
]


@query("inspect_literals", _values(DETAILS, "kind, txt, detail"))
def _(spark, d):
    rows = _table(spark, DETAILS, "kind string, txt string")
    of = lambda k: rows.where(F.col("kind") == k)
    dots = lambda *cs: F.concat_ws(";", *[F.col(c).cast("string") for c in cs])
    j = of("json").withColumn("x", inspect.json_detail("txt")).select("kind", "txt", F.when(F.col("x.error"), "error").otherwise(dots("x.shape", "x.keys", "x.depth")).alias("detail"))
    c = of("csv").withColumn("x", inspect.csv_detail("txt")).select("kind", "txt", F.concat_ws("|", "x.delimiter", F.array_join("x.columns", ","), F.col("x.column_count").cast("string"), F.col("x.rows").cast("string")).alias("detail"))
    x = of("xml").withColumn("x", inspect.xml_detail("txt")).select("kind", "txt", F.when(F.col("x.error"), "error").otherwise(dots("x.root", "x.elements", "x.depth")).alias("detail"))
    p = of("py").select("kind", "txt", F.array_join(inspect.outline_py("txt"), ";").alias("detail"))
    return j.unionByName(c).unionByName(x).unionByName(p)


@query("inspect_common", f"SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, '.txt' AS suffix, size, CASE WHEN size < 1024 THEN size || ' B' ELSE printf('%.1f KB', size / 1024e0) END AS human, sha256(content) AS sha256 FROM ({DOCS})")
def _(spark, d):
    docs = V.docs(spark, d).withColumn("mtime", F.lit(0.0))
    return inspect.common(docs).drop("mtime")


XML_OLD, XML_NEW = "<s id='1'><b y='2'>x</b><b>y</b><t>z</t></s>", "<s id='2'><b y='2'>x</b><t>w</t><u/></s>"
XML_DIFF = [("s.@id", "changed", "1", "2"), ("s.b.0.@y", "removed", "2", None), ("s.b.0", "removed", "x", None), ("s.b.1", "removed", "y", None), ("s.b.@y", "added", None, "2"), ("s.b", "added", None, "x"), ("s.t", "changed", "z", "w"), ("s.u", "added", None, "")]


@query("xml_diff_literals", _values(XML_DIFF, "path, change, old, new"))
def _(spark, d):
    rows = spark.createDataFrame([(1, XML_OLD, XML_NEW)], "k int, o string, n string")
    return diff.text_diff(rows.select("k", F.col("o").alias("t")), rows.select("k", F.col("n").alias("t")), "k", "t", diff.xml_leaves).drop("k")


@query("json_diff", """
SELECT event_id, 'k' AS path, 'changed' AS change, json_extract(props, '$.k')::VARCHAR AS old, CAST(event_id AS VARCHAR) AS new FROM events
UNION ALL SELECT event_id, 'n.0', 'added', NULL, 'true' FROM events""")  # fmt: skip
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("props").alias("t"))
    new = e.select("event_id", F.concat(F.lit('{"k": '), F.col("event_id").cast("string"), F.lit(', "n": [true]}')).alias("t"))
    return diff.text_diff(e, new, "event_id", "t", diff.json_leaves("diff"))


@query("text_edit", f"SELECT path, md5(replace(content, 'the', 'THE')) AS literal, CAST((length(content) - length(replace(content, 'the', ''))) // 3 AS BIGINT) AS n_literal, md5(regexp_replace(content, '([a-z])ing', '\\1ING', 'g')) AS pattern, CAST(len(regexp_extract_all(content, '[a-z]ing')) AS BIGINT) AS n_pattern FROM ({DOCS})")
def _(spark, d):
    docs = V.docs(spark, d).select("path", convert.edit_text(F.col("content"), "the", "THE").alias("a"), convert.edit_text(F.col("content"), "([a-z])ing", "$1ING", True).alias("b"))
    return docs.select("path", F.md5("a.text").alias("literal"), F.col("a.count").alias("n_literal"), F.md5("b.text").alias("pattern"), F.col("b.count").alias("n_pattern"))


CATALOGS = [
    ('{"schema":2,"files":[{"path":"a","tags":[" X ","x","Y"],"meta":[{"key":"k","value":"1","kind":"num"}]},{"path":" "},{"path":"b","meta":[{"key":"bad key","value":"1"}]},{"path":"c","meta":[{"key":"k","value":"1","kind":"hue"}]}]}',
     [("a", "x;y", None), (" ", "", "no path"), ("b", "", "bad key"), ("c", "", "bad kind")]),
    ('{"schema":9,"files":[]}', [(None, "", "later schema")]), ("no json", [(None, "", "not a catalog")]), ('{"schema":2}', [(None, "", "no files")]),
]


@query("catalog_import_literals", _values([r for _, rows in CATALOGS for r in rows], "path, tags, problem"))
def _(spark, d):
    given = spark.createDataFrame([(c,) for c, _ in CATALOGS], "catalog string")
    return catalog.imported(given).select("path", F.array_join("tags", ";").alias("tags"), "problem")


@query("catalog_round_trip", f"SELECT path, lang AS tags, CAST(NULL AS VARCHAR) AS problem FROM ({DOCS}) WHERE doc_id < 100")
def _(spark, d):
    docs = V.docs(spark, d).where("doc_id < 100")
    none = docs.limit(0)
    exported = catalog.export(docs, docs.select("path", F.col("lang").alias("tag")), none.select("path", F.lit(0.0).alias("created"), F.lit("").alias("body")), none.select("path", F.lit("").alias("key"), F.lit("").alias("value"), F.lit("").alias("kind")))
    return catalog.imported(catalog.envelope(exported)).select("path", F.array_join("tags", ";").alias("tags"), "problem")


@query("manifest_verify", f"SELECT path, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'ok' END AS state FROM ({DOCS})")
def _(spark, d):
    docs = V.docs(spark, d)
    lines = docs.select(F.concat(F.sha2("content", 256), F.lit("  "), F.col("path")).alias("line"))
    now = docs.where("doc_id % 10 <> 0").select("path", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"))
    return catalog.verify_manifest(lines, now)


NAMES = [("a/b\\c.txt", "c.txt"), ("..hidden", "hidden"), ("con.txt", "_con.txt"), ("x<y>:z?.pdf", "x_y_z_.pdf"), ("", "attachment"), ("///", "attachment"), ("n" * 300 + ".csv", "n" * 116 + ".csv")]


@query("safe_name_literals", _values(NAMES, "given, name"))
def _(spark, d):
    return _table(spark, NAMES, "given string").select("given", T.safe_filename(F.col("given")).alias("name"))


MOVES = [("p1", "x/a.txt", "x/a.txt"), ("p2", "x/a.txt", "x/a-2.txt"), ("p3", "x/a-1.txt", "x/a-1.txt"), ("p4", "x/a.txt", "x/a-4.txt"), ("p5", "y/b", "y/b-1"), ("p6", "y/b", "y/b-2"), ("p7", "x/a-1.txt", "x/a-1-1.txt")]


@query("unique_target_literals", _values(MOVES, "path, wish, target"))
def _(spark, d):
    wish = spark.createDataFrame([m[:2] for m in MOVES], "path string, wish string")
    taken = spark.createDataFrame([("y/b",), ("x/a-3.txt",)], "`to` string")
    plan = files.unique_targets(wish.withColumnRenamed("wish", "to"), taken)
    return plan.withColumnRenamed("to", "target").join(wish, "path")


@query("organise_plan", f"""
WITH f AS (SELECT path, 'docs/' || regexp_extract(path, '([^/]*)$', 1) AS wish FROM ({DOCS})), r AS (SELECT path, wish, row_number() OVER (PARTITION BY wish ORDER BY path) AS r FROM f)
SELECT path, CASE WHEN r = 1 THEN wish ELSE regexp_replace(wish, '\\.txt$', '') || '-' || (r - 1) || '.txt' END AS target FROM r""")  # fmt: skip
def _(spark, d):
    docs = V.docs(spark, d).select("path", F.lit("txt").alias("type"), F.lit(0.0).alias("mtime"))
    return files.organise_plan(docs).withColumnRenamed("to", "target")


@query("intake_destinations", """
SELECT o_orderkey, strftime(o_orderdate, '%Y/%m') AS ym, 'FY' || (year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END) || '/Q' || (((month(o_orderdate) + 8) % 12) // 3 + 1) AS period, '' AS flat FROM orders""")  # fmt: skip
def _(spark, d):
    day = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", intake.destination(day).alias("ym"), intake.destination(day, "period", 4).alias("period"), intake.destination(day, "flat").alias("flat"))


@query("rename_template", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') || '_' || replace(o_orderpriority, ' ', '_') || '.txt' AS name FROM orders")
def _(spark, d):
    values = {"date": F.col("o_orderdate").cast("string"), "vendor": F.regexp_replace("o_orderpriority", " ", "_")}
    return table(spark, d, "orders").select("o_orderkey", F.concat(intake.name_column("{date:yyyy-MM}_{vendor}", values), F.lit(".txt")).alias("name"))


@query("mail_threads", """
SELECT '<' || conv_id || '.' || turn || '@x>' AS message_id, '<' || conv_id || '.0@x>' AS thread, CAST(turn + 1 AS BIGINT) AS depth FROM conversations""")  # fmt: skip
def _(spark, d):
    """Messages written as mail, read back, and linked by their own headers."""
    c = table(spark, d, "conversations")
    id_ = lambda t: F.concat(F.lit("<"), F.col("conv_id"), F.lit("."), t, F.lit("@x>"))
    reply = F.when(F.col("turn") > 0, F.concat(F.lit("In-Reply-To: "), id_(F.col("turn") - 1), F.lit("\n"))).otherwise("")
    raw = F.concat(F.lit("From: a@x\nMessage-ID: "), id_(F.col("turn")), F.lit("\n"), reply, F.lit("Subject: s\n\nbody\n"))
    read = c.select(mail.summary(raw.cast("binary")).alias("m")).select("m.*")
    return mail.threads(read, "message_id").select("message_id", "thread", "depth")


@query("pack_bundle_sizes", f"SELECT CAST(count(*) AS BIGINT) AS files FROM ({DOCS}) WHERE size <= 20000")
def _(spark, d):
    """How many sections all documents of the bundle hold together."""
    docs = V.docs(spark, d).withColumn("kind", F.lit("text"))
    rows = bundle.sections(docs, bundle.entries(docs, most=20_000), 200_000)
    return rows.where("kind = 'file'").agg(F.count("*").alias("files"))


SECTION = """length('### `' || path || '`' || chr(10) || chr(10)) + 2 * (greatest(3, coalesce(list_max(list_transform(regexp_extract_all(body, '`+'), lambda x: length(x))), 0) + 1)) + 3 + length(body)"""
PARTS = f"""
WITH RECURSIVE f AS (SELECT path, size, CAST(ceil(length(content) / 3.6e0) AS BIGINT) AS tokens, regexp_replace(content, '\n+$', '') AS body, size > 30000 AS big, content FROM ({DOCS})),
g AS (SELECT *, NOT big AND row_number() OVER (PARTITION BY md5(content), big ORDER BY path) > 1 AS copy, min(path) OVER (PARTITION BY md5(content), big) AS leader FROM f),
s AS (SELECT count(*) FILTER (NOT big AND NOT copy) AS i, count(*) FILTER (big OR copy) AS k, coalesce(sum(tokens) FILTER (NOT big AND NOT copy), 0) AS t, count(*) FILTER (copy) AS c FROM g),
nodes AS (SELECT DISTINCT split_part(path, '/', 1) || '/' AS line, 4 AS n FROM f UNION ALL
  SELECT split_part(path, '/', 2) || CASE WHEN copy THEN '  [same as ' || leader || ']' WHEN big THEN '  [skipped: too-large] (' || (CASE WHEN size < 1048576 THEN format('{{:.1f}} KB', size / 1024) ELSE format('{{:.1f}} MB', size / 1048576) END) || ')' ELSE '' END, 8 FROM g),
m AS (SELECT length('# paperloom pack' || repeat(chr(10), 2) || '- generated-by: paperloom' || chr(10) || '- root: .' || chr(10) || '- files: ' || i || ' included, ' || k || ' skipped' || chr(10) || '- tokens_est: ' || t || chr(10)
    || CASE WHEN c > 0 THEN '- deduped: ' || c || ' identical file(s) not inlined' || chr(10) ELSE '' END || '- part: 1/1' || chr(10)) AS head, (SELECT sum(length(line) + n + 1) FROM nodes) + 2 + length(chr(10) || '## Tree' || repeat(chr(10), 2) || '```' || chr(10) || chr(10) || '```' || chr(10)) AS tree FROM s),
p AS (SELECT 0 AS place, CAST(NULL AS VARCHAR) AS path, tree AS n FROM m UNION ALL SELECT row_number() OVER (ORDER BY path), path, {SECTION} + 1 FROM g WHERE NOT big AND NOT copy),
r AS (SELECT place, path, n, CAST(1 AS BIGINT) AS part, n AS used FROM p WHERE place = 0
  UNION ALL SELECT p.place, p.path, p.n, CASE WHEN used + p.n <= 180000 - head - 11 + 1 THEN part ELSE part + 1 END, CASE WHEN used + p.n <= 180000 - head - 11 + 1 THEN used + p.n ELSE p.n END FROM r JOIN p ON p.place = r.place + 1, m)
SELECT path, part, CAST(n - 1 AS BIGINT) AS chars FROM r WHERE path IS NOT NULL"""


@query("pack_parts", PARTS)
def _(spark, d):
    """Which document each file's section stands in, and its size; copies are not inlined, the tree is in the first document."""
    docs = V.docs(spark, d).withColumn("kind", F.lit("text"))
    rows = bundle.sections(docs, bundle.entries(docs, most=30_000, dedupe=True), 50_000)
    return rows.where("kind = 'file'").select("path", "part", F.char_length(F.regexp_replace("text", r"^\n", "")).cast("bigint").alias("chars"))


@query("pack_pieces", f"SELECT path, md5(content) AS rejoined, true AS within FROM ({DOCS})")
def _(spark, d):
    """Files cut at line ends into documents of 1,000 tokens: their pieces, put together again, and whether each fits."""
    docs = V.docs(spark, d).withColumn("kind", F.lit("text"))
    rows = bundle.sections(docs, bundle.entries(docs), 1_000, fmt="xml").where("kind = 'file'")
    body = F.replace(F.regexp_extract("text", r"(?s)<!\[CDATA\[(.*)\]\]></file>\n\z", 1), F.lit("]]]]><![CDATA[>"), F.lit("]]>"))
    pieces = rows.select("path", F.struct("part", "key").alias("at"), body.alias("body"), F.char_length("text").alias("n"))
    # A file's pieces are its text again: bounded by the row that it came from.
    return pieces.groupBy("path").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), "")).alias("rejoined"), (F.max("n") <= 3_600).alias("within"))


@query("pack_tree", f"""
WITH f AS (SELECT DISTINCT split_part(path, '/', 1) AS dir, split_part(path, '/', 2) AS name FROM ({DOCS})),
t AS (SELECT '' AS k, './' AS line UNION ALL
  SELECT '0' || dir, CASE WHEN dir = max(dir) OVER () THEN '└── ' ELSE '├── ' END || dir || '/' FROM (SELECT DISTINCT dir FROM f) UNION ALL
  SELECT '0' || dir || chr(1) || name, CASE WHEN dir = max(dir) OVER () THEN '    ' ELSE '│   ' END || CASE WHEN name = max(name) OVER (PARTITION BY dir) THEN '└── ' ELSE '├── ' END || name FROM f)
SELECT line, CAST(row_number() OVER (ORDER BY k) AS BIGINT) AS place FROM t""")  # fmt: skip
def _(spark, d):
    lines = bundle.tree_lines(V.docs(spark, d).select("path", F.lit("").alias("note")))
    return numbered(lines, ["place"], "n").select("line", F.col("n").alias("place"))


RULES = [("", "*7.txt\n!17.txt\nfr/\n"), ("de", "*1.txt\n# none\n!*1.txt\n/src*/*3.txt\n"), ("es", "!*7.txt\n"), ("fr", "!*\n")]


@query("scan_inherited_rules", f"""
WITH f AS (SELECT lang || '/' || path AS path, lang, regexp_extract(path, '([^/]*)$', 1) AS name FROM ({DOCS}) WHERE lang IS NOT NULL)
SELECT path FROM f WHERE lang <> 'fr' AND NOT CASE WHEN lang = 'de' AND ends_with(name, '3.txt') THEN true WHEN lang = 'de' AND ends_with(name, '1.txt') THEN false WHEN lang = 'es' AND ends_with(name, '7.txt') THEN false
  WHEN name = '17.txt' THEN false ELSE ends_with(name, '7.txt') END""")  # fmt: skip
def _(spark, d):
    """A walk over the documents' paths below folders by language, with rule files in four of them."""
    paths = V.docs(spark, d).where("lang IS NOT NULL").select(F.concat("lang", F.lit("/"), "path").alias("path"))
    return listing.walk(paths, spark.createDataFrame(RULES, "folder string, text string"))


PART_CSV = "SELECT *, row_number() OVER (ORDER BY p_partkey) AS row FROM part"


@query("csv_file_diff", f"""
WITH o AS ({PART_CSV}), n AS (SELECT p_name || CASE WHEN p_partkey % 50 = 0 THEN ', "new"' || chr(10) || 'kind' ELSE '' END AS p_name, CASE WHEN p_partkey % 70 = 0 THEN p_size + 1 ELSE p_size END AS p_size, row FROM o WHERE row <= (SELECT count(*) - 7 FROM part)),
c AS (SELECT o.row, unnest(['p_name', 'p_size']) AS "column", unnest([o.p_name, CAST(o.p_size AS VARCHAR)]) AS old, unnest([n.p_name, CAST(n.p_size AS VARCHAR)]) AS new FROM o JOIN n USING (row))
SELECT 'changed' AS change, "column", row, row AS to_row, old, new FROM c WHERE old <> new
UNION ALL SELECT 'rows removed', NULL, count(*) - 6, count(*), NULL, NULL FROM part UNION ALL SELECT 'column removed', 'p_brand', NULL, NULL, NULL, NULL UNION ALL SELECT 'column added', 'p_note', NULL, NULL, NULL, NULL""")
def _(spark, d):
    """Two CSV folders written from the parts, with cells that hold delimiters, quotes and line ends, read back and compared by position."""
    from paperloom.session import drop_path, keep, shared_dir

    folder = f"{shared_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    p = numbered(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.col("p_size").cast("bigint").alias("p_size")), ["p_partkey"], "row")
    new = p.where(F.col("row") <= p.count() - 7).select(
        "row", F.when(F.col("p_partkey") % 70 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"), F.concat("p_name", F.when(F.col("p_partkey") % 50 == 0, ', "new"\nkind').otherwise("")).alias("p_name"), F.lit("x").alias("p_note")
    )
    for name, rows in (("old", p.drop("p_partkey")), ("new", new)):
        rows.repartitionByRange("row").sortWithinPartitions("row").drop("row").write.csv(f"{folder}/{name}", header=True, escape='"')
    found = keep(csvrows.file_diff(spark, f"{folder}/old", f"{folder}/new"))
    drop_path(spark, folder)
    return found
