"""Queries over listings, links, line differences and mail that names what is not there."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import changes, linediff, search
from paperloom.plans import views as V
from paperloom.plans.registry import DOCS, _bm25_sql, query
from paperloom.session import table
from paperloom.sources import links, mail

PLACE = "format('{:06d}.{:06d}', conv_id, turn)"


@query("mail_threads_absent", f"""
WITH c AS (SELECT conv_id, turn, {PLACE} AS "where", greatest((turn + 1) // 5 * 5 - 1, 0) AS start FROM conversations),
t AS (SELECT "where", format('{{:06d}}.{{:06d}}', conv_id, start) AS thread, CAST(turn - start + 1 AS BIGINT) AS depth, conv_id, turn FROM c)
SELECT "where", thread, depth FROM t UNION ALL SELECT "where" || 'b', thread, depth FROM t WHERE conv_id % 3 = 0 AND turn <> 3 AND turn % 5 <> 3""")  # fmt: skip
def _(spark, d):
    """Mails of which every fifth has no id, so that replies to it start anew; of a third of the conversations all others stand there twice."""
    c = table(spark, d, "conversations")
    place = F.format_string("%06d.%06d", "conv_id", "turn")
    id_ = lambda t: F.format_string("<%d.%d@x>", F.col("conv_id"), t)
    rows = c.select("conv_id", "turn", place.alias("where"), F.when(F.col("turn") % 5 != 3, id_(F.col("turn"))).alias("message_id"), F.when(F.col("turn") > 0, id_(F.col("turn") - 1)).alias("in_reply_to"))
    twice = rows.where("conv_id % 3 = 0 AND message_id IS NOT NULL").withColumn("where", F.concat("where", F.lit("b")))
    all_ = rows.unionByName(twice).withColumns({"references": F.array("in_reply_to"), "date": F.lit(None).cast("timestamp")})
    return mail.threads(all_).select("where", "thread", "depth")


@query("links_confined", f"""
WITH f AS (SELECT doc_id, coalesce(lang, 'xx') AS lang FROM ({DOCS})),
p AS (SELECT *, 'desk/' || lang || '/' || doc_id AS path, CASE WHEN lang = 'de' THEN 'store/de/' WHEN lang = 'es' THEN 'desk/en/' ELSE 'desk/' || lang || '/' END AS folder FROM f)
SELECT path, CASE WHEN doc_id % 7 <> 0 OR lang IN ('de', 'es') THEN folder || doc_id WHEN doc_id % 3 = 0 THEN 'vault/' || doc_id WHEN doc_id % 3 = 1 THEN folder || doc_id || '.real' END AS resolved,
  doc_id % 7 = 0 AND doc_id % 3 = 2 AND lang NOT IN ('de', 'es') AS looped, lang <> 'de' AND (lang = 'es' OR doc_id % 7 <> 0 OR doc_id % 3 = 1) AS inside FROM p""")  # fmt: skip
def _(spark, d):
    """A desk of the documents in which two folders and every seventh file are links, some out of it, some to themselves."""
    f = V.docs(spark, d).select("doc_id", F.coalesce("lang", F.lit("xx")).alias("lang"))
    files = f.select(F.concat_ws("/", F.lit("desk"), "lang", F.col("doc_id").cast("string")).alias("path"), "doc_id", "lang")
    name = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 3
    target = F.when(kind == 0, F.concat(F.lit("../../vault/"), name)).when(kind == 1, F.concat(F.lit("./"), name, F.lit(".real"))).otherwise(name)
    of_files = files.where("doc_id % 7 = 0 AND lang NOT IN ('de', 'es')").select("path", target.alias("target"))
    of_folders = spark.range(1).select(F.inline(F.expr("array(struct('desk/de' AS path, '../store//de' AS target), struct('desk/es' AS path, '../desk/./en/' AS target))")))
    # The folder that es leads to has no such files of its own names: links there are of documents in en.
    found = links.resolved(files, of_files.unionByName(of_folders))
    return found.join(links.confined(files, of_files.unionByName(of_folders), "desk").select("path", F.lit(True).alias("inside")), "path", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


LISTED = f"SELECT regexp_replace(path, '/', '/' || (doc_id // 100) || '/') AS path, content, doc_id FROM ({DOCS})"
CHANGED = f"""
SELECT path, CASE WHEN doc_id % 97 = 0 THEN 'removed' ELSE 'changed' END AS change FROM ({LISTED}) WHERE doc_id % 97 = 0 OR doc_id % 89 = 0
UNION ALL SELECT path || '.new', 'added' FROM ({LISTED}) WHERE doc_id % 101 = 0"""


def _listings(spark, d):
    docs = V.docs(spark, d).select(F.regexp_replace("path", "/", F.concat(F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string"), F.lit("/"))).alias("path"), "content", "doc_id")
    old = docs.select("path", F.sha2("content", 256).alias("hash"), "doc_id")
    now = old.where("doc_id % 97 <> 0").withColumn("hash", F.when(F.col("doc_id") % 89 == 0, F.concat("hash", F.lit("!"))).otherwise(F.col("hash")))
    new = now.unionByName(old.where("doc_id % 101 = 0").withColumn("path", F.concat("path", F.lit(".new"))))
    return docs, old, new


@query("folder_changes", CHANGED)
def _(spark, d):
    _, old, new = _listings(spark, d)
    return changes.changed_paths(old, new)


@query("folder_trees", f"""
WITH l AS (SELECT path, doc_id FROM ({LISTED})), a AS (SELECT split_part(path, '/', 1) AS f1, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS f2, doc_id FROM l),
e AS (SELECT '' AS folder, doc_id FROM a UNION ALL SELECT f1, doc_id FROM a UNION ALL SELECT f2, doc_id FROM a)
SELECT folder, CAST(count(*) AS BIGINT) AS files, CAST(count(*) FILTER (doc_id % 97 <> 0) + count(*) FILTER (doc_id % 101 = 0) AS BIGINT) AS now, NOT bool_or(doc_id % 97 = 0 OR doc_id % 89 = 0 OR doc_id % 101 = 0) AS same
FROM e GROUP BY folder HAVING count(*) FILTER (doc_id % 97 <> 0) > 0""")  # fmt: skip
def _(spark, d):
    """All folders of two listings with their files, and whether all below them is the same."""
    _, old, new = _listings(spark, d)
    a = changes.tree_sums(old).withColumnRenamed("sum", "s")
    b = changes.tree_sums(new).select("folder", F.col("files").alias("now"), F.col("sum").alias("t"))
    return a.join(b, "folder").select("folder", "files", "now", F.expr("s = t").alias("same"))


NARROW = _bm25_sql([(["anin"], False), (["the"], False)], "f0 > 0 OR f1 > 0", [0, 1], limit=400)


@query("pack_narrowed", f"SELECT path, score FROM ({NARROW}) WHERE path IN (SELECT path FROM ({DOCS}) WHERE doc_id % 5 = 0) AND NOT path LIKE '%7_.txt' AND (path LIKE 'src1%' OR path LIKE '%5.txt')")
def _(spark, d):
    """Files for a bundle: of the 400 best hits those that changed, within patterns."""
    docs = V.docs(spark, d)
    listed = docs.select("path", F.md5("content").alias("hash"), "doc_id")
    found = changes.changed_paths(listed, listed.withColumn("hash", F.when(F.col("doc_id") % 5 == 0, F.concat("hash", F.lit("!"))).otherwise(F.col("hash"))))
    hits = search.search(docs, "anin OR the", limit=400).select("path", "score")
    return changes.narrowed(docs.select("path"), found, hits, ["src1*", "*5.txt"], ["*7?.txt"]).withColumn("score", F.round("score", 6))


SPLIT = "CASE WHEN coalesce(content, '') = '' THEN [] ELSE string_split_regex(regexp_replace(content, '\\r?\\n$', ''), '\\r?\\n') END"


@query("line_edits", f"""
WITH l AS (SELECT path, {SPLIT} AS ls FROM ({DOCS})), c AS (SELECT path, ls, list_transform(ls, lambda x: replace(x, 'the', 'thy')) AS changed FROM l WHERE len(ls) > 0)
SELECT path, md5(array_to_string(ls, chr(10))) AS old, md5(array_to_string(list_concat(['<first>'], changed), chr(10))) AS new,
  CAST(len(list_filter(ls, lambda x: contains(x, 'the'))) AS BIGINT) AS removed, CAST(1 + len(list_filter(ls, lambda x: contains(x, 'the'))) AS BIGINT) AS added FROM c""")  # fmt: skip
def _(spark, d):
    """Both texts of each difference put together again from its lines, and how many lines it takes and gives."""
    docs = V.docs(spark, d).select("path", "content").where("content <> ''")
    rows = linediff.edits(docs, docs.withColumn("content", F.concat(F.lit("<first>\n"), F.replace("content", F.lit("the"), F.lit("thy")))), "path", "content")
    # A text's lines are its text again: bounded by the row that it came from.
    side = lambda other: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("sign") != other, F.struct("place", "line")))), lambda x: x["line"]), "\n"))
    return rows.groupBy(F.col("key").alias("path")).agg(side("+").alias("old"), side("-").alias("new"), F.count_if(F.col("sign") == "-").alias("removed"), F.count_if(F.col("sign") == "+").alias("added"))
