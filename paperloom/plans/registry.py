"""All registered queries of the document desk, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.meta import canonical, infer_kind
from paperloom.functions.patterns import VALIDATORS
from paperloom.operators import catalog, dedupe, diff, linediff, pack, refs, search
from paperloom.plans import views as V
from paperloom.session import spread, table
from paperloom.sources import html

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Rule tables on literals: tests run them as they run queries, but they read no table, so no one registers them.
CASES: dict = {}
LITERAL = {
    "validators_literals", "money_literals", "dates_literals", "meta_literals", "meta_coerce_literals", "meta_condition_literals", "kind_literals", "fields_literals", "inspect_md_literals", "inspect_literals", "xml_diff_literals",
    "catalog_import_literals", "safe_name_literals", "unique_target_literals", "refs_custom_redact", "contrast_check",
}

#: Shared pieces of the SQL side.
DOCS = "SELECT source || '/' || doc_id || '.txt' AS path, text AS content, doc_id, lang, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents"
TERMS = f"list_filter(string_split_regex(translate(lower(content), '{T.MARKED}', '{T.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
ORDER_FACTS = """
SELECT 'order-' || o_orderkey AS path, unnest(['total', 'due', 'status', 'priority']) AS key,
  unnest([CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d'), o_orderstatus, o_orderpriority]) AS value FROM orders"""
CUSTOMER_FACTS = """
SELECT 'customer-' || c_custkey AS path, unnest(['vendor', 'segment', 'balance']) AS key,
  unnest([c_name, c_mktsegment, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)]) AS value FROM customer"""
NUM_RE = r"^-?(?:0|[1-9][0-9]*|[1-9][0-9]{0,2}(?:,[0-9]{3})+)(?:\.[0-9]+)?$"
KIND = f"""CASE WHEN lower(trim(value)) IN ('true', 'false') THEN 'bool' WHEN regexp_matches(trim(value), '{NUM_RE}') THEN 'num'
  WHEN regexp_matches(trim(value), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND TRY_CAST(trim(value) AS DATE) IS NOT NULL THEN 'date' ELSE 'str' END"""
CANON = """CASE WHEN {k} = 'num' THEN regexp_replace(regexp_replace(replace(trim(value), ',', ''), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') ELSE trim(value) END"""
META = f"SELECT path, key, {CANON.format(k=KIND)} AS value, {KIND} AS kind FROM ({{facts}})"


def query(name: str, sql: str | None = None):
    def put(f):
        (CASES if name in LITERAL else QUERIES)[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def queries() -> dict:
    from paperloom.plans import desk, forms, literals, texts, trees  # noqa: F401  (they register theirs)

    return QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in queries()}


# --- text ---------------------------------------------------------------------------------


def of_known(text, measure):
    """A measure of a text, null without a text."""
    return F.when(text.isNotNull(), measure(text))


@query("token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 3.6e0) AS BIGINT) AS tokens FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", of_known(F.col("text"), T.token_estimate).alias("tokens"))


@query("text_stats", """
SELECT doc_id, CAST(len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS BIGINT) AS lines,
  CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS chars FROM documents""")  # fmt: skip
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", of_known(t, T.line_count).alias("lines"), of_known(t, T.word_count).alias("words"), F.char_length(t).cast("bigint").alias("chars"))


@query("word_freq", f"SELECT term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT unnest({TERMS}) AS term FROM ({DOCS})) GROUP BY term")
def _(spark, d):
    return V.docs(spark, d).select(F.explode(T.terms(F.col("content"))).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))


@query("postings_df", f"SELECT term, CAST(count(DISTINCT path) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS tf FROM (SELECT path, unnest({TERMS}) AS term FROM ({DOCS})) GROUP BY term")
def _(spark, d):
    return search.document_frequency(V.docs(spark, d))


@query("postings", f"""
WITH t AS (SELECT path, {TERMS} AS ts FROM ({DOCS})), p AS (SELECT path, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM t)
SELECT term, path, CAST(count(*) AS BIGINT) AS tf, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos FROM p GROUP BY term, path""")  # fmt: skip
def _(spark, d):
    p = search.postings(V.docs(spark, d))
    return p.select("term", "path", "tf", F.element_at("positions", 1).cast("bigint").alias("first_pos"), F.element_at("positions", -1).cast("bigint").alias("last_pos"))


# --- search -------------------------------------------------------------------------------


def _bm25_sql(phrases: list[tuple[list[str], bool]], holds: str, ranked: list[int], extra: str = "", limit: int = 20) -> str:
    """Score SQL: f0, f1, ... are the hit counts of the phrases; holds and extra are conditions on a row."""
    cols = []
    for i, (ws, prefix) in enumerate(phrases):
        same = [f"starts_with({{t}}, '{w}')" if prefix and k == len(ws) - 1 else f"{{t}} = '{w}'" for k, w in enumerate(ws)]
        if len(ws) == 1:
            cols.append(f"len(list_filter(ts, lambda t: {same[0].format(t='t')})) AS f{i}")
        else:
            shifted = ", ".join("ts" if not k else f"ts[{k + 1}:]" for k in range(len(ws)))
            both = " AND ".join(x.format(t=f"z[{k + 1}]") for k, x in enumerate(same))
            cols.append(f"len(list_filter(list_zip({shifted}), lambda z: coalesce({both}, false))) AS f{i}")
    dfs = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in ranked)
    idf = lambda i: f"(CASE WHEN d{i} * 2 < n THEN ln((n - d{i} + 0.5e0) / (d{i} + 0.5e0)) ELSE 1e-6 END)"
    score = " + ".join(f"{idf(i)} * f{i} * 2.2e0 / (f{i} + 1.2e0 * (0.25e0 + 0.75e0 * len(ts) / mean))" for i in ranked)
    return f"""
WITH t AS (SELECT *, {TERMS} AS ts FROM ({DOCS})), c AS (SELECT *, {', '.join(cols)} FROM t),
s AS (SELECT count(*) AS n, avg(len(ts)) AS mean, {dfs} FROM c)
SELECT path, round(-({score}), 6) AS score FROM c, s WHERE ({holds}) {extra} ORDER BY -({score}), path LIMIT {limit}"""


def _ranked(q: str, **how):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return search.search(V.docs(spark, d), q, **how).withColumn("score", F.round("score", 6))

    return run


query("bm25_and", _bm25_sql([(["anin"], False), (["ertion"], False)], "f0 > 0 AND f1 > 0", [0, 1]))(_ranked("anin ertion"))
query("bm25_or", _bm25_sql([(["anin"], False), (["ertion"], False)], "f0 > 0 OR f1 > 0", [0, 1]))(_ranked("anin OR ertion"))
query("bm25_not", _bm25_sql([(["anin"], False), (["ertion"], False)], "f0 > 0 AND f1 = 0", [0]))(_ranked("anin NOT ertion"))
query("bm25_phrase", _bm25_sql([(["of", "the"], False)], "f0 > 0", [0]))(_ranked('"of the"'))
query("bm25_prefix", _bm25_sql([(["thri"], True)], "f0 > 0", [0]))(_ranked("thri*"))
query("bm25_nested", _bm25_sql([(["anin"], False), (["ertion"], False), (["schung"], True)], "(f0 > 0 AND f1 > 0) OR f2 > 0", [0, 1, 2]))(_ranked("(anin ertion) OR schung*"))


@query("search_type_tag_meta", _bm25_sql([(["anin"], False)], "f0 > 0", [0], "AND lang = 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def _(spark, d):
    docs = V.docs(spark, d).join(table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("good")).distinct(), "doc_id", "left")
    return search.search(docs, "anin", where=(F.col("lang") == "en") & F.col("good").isNotNull()).withColumn("score", F.round("score", 6))


@query("snippet_window")
def _(spark, d):
    docs = V.docs(spark, d)
    top = search.search(docs, "anin ertion")
    return top.join(docs, "path").select("path", search.snippet(F.col("content"), ["anin", "ertion"]).alias("snippet"))


# --- duplicates ---------------------------------------------------------------------------


def _hashed(spark, d):
    return V.docs(spark, d).select("path", F.sha2("content", 256).alias("hash"), "size", F.col("doc_id").cast("double").alias("mtime"))


@query("exact_dup_groups", f"SELECT sha256(content) AS hash, CAST(count(*) AS BIGINT) AS n_files, min(path) AS first, max(path) AS last FROM ({DOCS}) GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return dedupe.exact_groups(_hashed(spark, d))


@query("dup_kept_reclaimable", f"""
SELECT sha256(content) AS hash, arg_min(path, doc_id) AS kept, CAST(count(*) - 1 AS BIGINT) AS n_deleted, CAST(sum(size) - arg_min(size, doc_id) AS BIGINT) AS reclaimable
FROM ({DOCS}) GROUP BY 1 HAVING count(*) > 1""")  # fmt: skip
def _(spark, d):
    return dedupe.kept_and_reclaimable(_hashed(spark, d))


@query("pack_same_as", f"""
SELECT path, CASE WHEN row_number() OVER w > 1 THEN first_value(path) OVER w END AS same_as FROM ({DOCS}) WINDOW w AS (PARTITION BY sha256(content) ORDER BY doc_id, path)""")  # fmt: skip
def _(spark, d):
    return dedupe.same_as(V.docs(spark, d), ["doc_id", "path"])


BITS = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, 64), lambda i: CAST(embedding[i] < embedding[i + 1] AS BIGINT))), lambda a, x: a * 2 + x)"
PAIRS = f"""WITH s AS (SELECT vec_id, {BITS} AS h FROM embeddings)
SELECT x.vec_id AS a, y.vec_id AS b, CAST(bit_count(xor(x.h, y.h)) AS BIGINT) AS distance FROM s x JOIN s y ON x.vec_id < y.vec_id AND bit_count(xor(x.h, y.h)) <= 16"""


def _signatures(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("path"), dedupe.gradient_bits(F.col("embedding")).alias("dhash"))


@query("near_pairs", PAIRS)
def _(spark, d):
    return dedupe.near_pairs(_signatures(spark, d), 16)


@query("near_clusters", f"""
WITH RECURSIVE p AS ({PAIRS}), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
SELECT node, min(other) AS component FROM r GROUP BY node""")  # fmt: skip
def _(spark, d):
    return dedupe.near_clusters(dedupe.near_pairs(_signatures(spark, d), 16))


# --- references ---------------------------------------------------------------------------

EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
# Lookaround is not at hand: every non-digit is doubled, so neighbours can be consumed and still serve the next match.
DOUBLED = "regexp_replace(content, '([^0-9])', '\\1\\1', 'g')"
PHONE = "(?:^|[^0-9])((?:\\+?\\+?1(?:--|\\.\\.|  ))?(?:\\(\\([0-9]{3}\\)\\)(?:--|\\.\\.|  )?|[0-9]{3}(?:--|\\.\\.|  ))[0-9]{3}(?:--|\\.\\.|  )[0-9]{4})(?:[^0-9]|$)"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IPV4 = f"(?:^|[^0-9])((?:{OCTET}\\.\\.){{3}}{OCTET})(?:[^0-9]|$)"
CC = "(?:^|[^0-9])([0-9](?:(?:  |--)?[0-9]){12,18})(?:[^0-9]|$)"


def _ref_sql(rx: str, boundary: bool, check: str = "true") -> str:
    found = f"unnest(regexp_extract_all({DOUBLED}, '{rx}', 1))" if boundary else f"unnest(regexp_extract_all(content, '{rx}'))"
    undo = "regexp_replace(v, '([^0-9])[^0-9]', '\\1', 'g')" if boundary else "v"
    return f"SELECT path, value, CAST(count(*) AS BIGINT) AS count FROM (SELECT path, {undo} AS value FROM (SELECT path, {found} AS v FROM ({DOCS}))) WHERE {check} GROUP BY path, value"


PLAIN_DIGITS = "reverse(regexp_replace(value, '[ -]', '', 'g'))"
LUHN = f"""list_sum(list_transform(range(1, length({PLAIN_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({PLAIN_DIGITS}[i] AS INTEGER)
  WHEN CAST({PLAIN_DIGITS}[i] AS INTEGER) > 4 THEN CAST({PLAIN_DIGITS}[i] AS INTEGER) * 2 - 9 ELSE CAST({PLAIN_DIGITS}[i] AS INTEGER) * 2 END)) % 10 = 0"""


def _refs(kind):
    return lambda spark, d: refs.find(V.docs(spark, d), [kind]).select("path", "value", "count")


query("refs_email", _ref_sql(EMAIL, False))(_refs("email"))
query("refs_phone", _ref_sql(PHONE, True))(_refs("phone"))
query("refs_ipv4", _ref_sql(IPV4, True))(_refs("ipv4"))
query("refs_cc", _ref_sql(CC, True, LUHN))(_refs("cc"))


@query("refs_lines", f"""
WITH l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n FROM ({DOCS}))
SELECT path, value, CAST(count(*) AS BIGINT) AS count, CAST(min(n) AS BIGINT) AS first_line, CAST(count(DISTINCT n) AS BIGINT) AS n_lines
FROM (SELECT path, n, unnest(regexp_extract_all(line, '{EMAIL}')) AS value FROM l) GROUP BY path, value""")  # fmt: skip
def _(spark, d):
    found = refs.places(V.docs(spark, d), "email")
    return found.select("path", "value", "count", F.get("lines", F.lit(0)).alias("first_line"), "n_lines")


_LINKED = "(" + " UNION ALL ".join(f"SELECT '{k}' AS kind, * FROM ({_ref_sql(rx, b, c)})" for k, rx, b, c in (("email", EMAIL, False, "true"), ("ipv4", IPV4, True, "true"), ("cc", CC, True, LUHN))) + ")"


@query("refs_link", f"SELECT kind, value, CAST(count(DISTINCT path) AS BIGINT) AS files, CAST(sum(count) AS BIGINT) AS count FROM {_LINKED} GROUP BY kind, value HAVING count(DISTINCT path) > 1")
def _(spark, d):
    return refs.link(refs.find(V.docs(spark, d), ["email", "ipv4", "cc"]))


@query("refs_tags", f"SELECT path, lower(regexp_replace('ref:' || kind || ':' || value, '\\s', '', 'g')) AS tag FROM {_LINKED}")
def _(spark, d):
    found = refs.find(V.docs(spark, d), ["email", "ipv4", "cc"])
    return found.select("path", refs.tag(F.col("kind"), F.col("value")).alias("tag"))


LITERALS = [
    ("cc", "4111 1111 1111 1111", True), ("cc", "4111 1111 1111 1112", False), ("iban", "GB82WEST12345698765432", True), ("iban", "DE89370400440532013000", True),
    ("iban", "DE89370400440532013001", False), ("iban", "GB82WEST1234569876543", False), ("routing", "021000021", True), ("routing", "021000022", False),
    ("routing", "991000021", False), ("isbn", "0306406152", True), ("isbn", "0306406153", False), ("isbn", "9780306406157", True), ("isbn", "9780306406158", False),
    ("isbn", "080442957X", True), ("gtin", "4006381333931", True), ("gtin", "96385074", True), ("gtin", "96385075", False),
]


@query("validators_literals", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}', {str(ok).lower()})" for k, v, ok in LITERALS) + ") AS t(kind, value, valid)")
def _(spark, d):
    rows = spark.createDataFrame([(k, v) for k, v, _ in LITERALS], "kind string, value string")
    valid = F.lit(False)
    for k, check in VALIDATORS.items():
        valid = F.when(F.col("kind") == k, check(F.col("value"))).otherwise(valid)
    return rows.select("kind", "value", valid.alias("valid"))


@query("redact_email", f"SELECT path, md5(regexp_replace(content, '{EMAIL}', '[EMAIL]', 'g')) AS digest FROM ({DOCS})")
def _(spark, d):
    return V.docs(spark, d).select("path", F.md5(refs.redact(F.col("content"), ["email"])).alias("digest"))


@query("redact_ipv4", f"""SELECT path, md5(regexp_replace(regexp_replace({DOUBLED}, '(^|[^0-9])(?:{OCTET}\\.\\.){{3}}{OCTET}([^0-9]|$)', '\\1\x02\\2', 'g'), '([^0-9\x02])[^0-9\x02]', '\\1', 'g')) AS digest FROM ({DOCS})""")
def _(spark, d):
    return V.docs(spark, d).select("path", F.md5(refs.redact(F.col("content"), ["ipv4"], "\x02")).alias("digest"))


@query("redact_counts", f"""
SELECT path, CAST(len(regexp_extract_all(content, '{EMAIL}')) AS BIGINT) AS email,
  CAST(len(regexp_extract_all({DOUBLED}, '{IPV4}')) AS BIGINT) AS ipv4 FROM ({DOCS})""")  # fmt: skip
def _(spark, d):
    return V.docs(spark, d).select("path", *refs.counts(F.col("content"), ["email", "ipv4"]))


@query("redact_all_pii")
def _(spark, d):
    return V.docs(spark, d).select("path", F.md5(refs.redact(F.col("content"), ["email", "phone", "ssn", "ipv4", "cc"])).alias("digest"))


# --- metadata -----------------------------------------------------------------------------


def _meta(spark, d, facts=V.order_facts):
    return catalog.meta_rows(facts(spark, d))


FACTS = f"{ORDER_FACTS} UNION ALL {CUSTOMER_FACTS}"


@query("meta_infer_kinds", META.replace("{facts}", FACTS))
def _(spark, d):
    return catalog.meta_rows(V.order_facts(spark, d).unionByName(V.customer_facts(spark, d)))


def _exists(*conds: str) -> str:
    return f"WITH m AS ({META.replace('{facts}', FACTS)}) SELECT DISTINCT path FROM m AS x WHERE " + " AND ".join(f"EXISTS (SELECT 1 FROM m WHERE m.path = x.path AND {c})" for c in conds)


def _found(*conds: str):
    return lambda spark, d: catalog.meta_find(catalog.meta_rows(V.order_facts(spark, d).unionByName(V.customer_facts(spark, d))), list(conds))


query("meta_find_num", _exists("key = 'total' AND kind = 'num' AND CAST(value AS DOUBLE) > 150000", "key = 'status' AND lower(value) = 'f'"))(_found("total>150000", "status=f"))
query("meta_find_text", _exists("key = 'segment' AND lower(value) = 'building'", "key = 'vendor' AND contains(lower(value), '#00000000')"))(_found("segment = Building", "vendor~#00000000"))
query("meta_find_date_prefix", _exists("key = 'due' AND value < '1998-06'"))(_found("due<1998-06"))
query("meta_find_not", _exists("key = 'status' AND lower(value) <> 'o'"))(_found("status!=o"))
query("meta_has_key", _exists("key = 'balance'"))(_found("balance?"))


@query("meta_keys", f"SELECT key, CAST(count(*) AS BIGINT) AS files FROM ({FACTS}) GROUP BY key")
def _(spark, d):
    return catalog.meta_keys(catalog.meta_rows(V.order_facts(spark, d).unionByName(V.customer_facts(spark, d))))


@query("meta_pivot", f"""
SELECT path, coalesce(max(value) FILTER (key = 'total'), '') AS total, coalesce(max(value) FILTER (key = 'due'), '') AS due,
  coalesce(max(value) FILTER (key = 'segment'), '') AS segment FROM ({META.replace('{facts}', FACTS)}) GROUP BY path""")  # fmt: skip
def _(spark, d):
    return catalog.meta_export(catalog.meta_rows(V.order_facts(spark, d).unionByName(V.customer_facts(spark, d))), ["total", "due", "segment"])


def _tags(spark, d):
    docs, labels = V.docs(spark, d), table(spark, d, "labels")
    lab = docs.join(labels, "doc_id").select("path", F.explode(F.array(F.concat(F.lit("Quality-"), F.col("quality")), F.concat(F.lit(" toxic-"), F.col("toxic")))).alias("tag"))
    empty = docs.select("path", F.col("lang").alias("tag")).limit(0)
    return catalog.tags_add(empty, docs.select("path", F.col("lang").alias("tag")).unionByName(lab))


TAGS = f"""SELECT path, lang AS tag FROM ({DOCS}) UNION SELECT path, unnest(['quality-' || quality, 'toxic-' || toxic]) FROM ({DOCS}) JOIN labels USING (doc_id)"""


@query("tags_all", f"SELECT path FROM ({TAGS}) WHERE tag IN ('en', 'quality-1', 'toxic-1') GROUP BY path HAVING count(DISTINCT tag) = 3")
def _(spark, d):
    return catalog.tags_find(_tags(spark, d), ["EN", "quality-1", "toxic-1"])


@query("tag_counts", f"SELECT tag, CAST(count(*) AS BIGINT) AS files FROM ({TAGS}) GROUP BY tag")
def _(spark, d):
    return catalog.tag_counts(_tags(spark, d))


@query("notes_newest", "SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS place FROM conversations")
def _(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(w).cast("bigint").alias("place"))


MERGE = ("SELECT 'd' || doc_id AS path, 'quality' AS key, CAST(quality AS VARCHAR) AS value FROM labels WHERE doc_id % 3 <> 0",
         "SELECT 'd' || doc_id AS path, 'quality' AS key, CAST(CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS VARCHAR) AS value FROM labels WHERE doc_id % 4 <> 0")


@query("catalog_union_merge", f"""
SELECT path, key, coalesce(n.value, o.value) AS value, CASE WHEN o.value IS NULL THEN 'added' WHEN n.value IS NOT NULL AND n.value <> o.value THEN 'changed' ELSE 'kept' END AS change
FROM ({MERGE[0]}) o FULL JOIN ({MERGE[1]}) n USING (path, key)""")  # fmt: skip
def _(spark, d):
    rows = table(spark, d, "labels").select(F.concat(F.lit("d"), F.col("doc_id")).alias("path"), F.lit("quality").alias("key"), "doc_id", "quality")
    old = rows.where("doc_id % 3 <> 0").select("path", "key", F.col("quality").cast("string").alias("value"))
    new = rows.where("doc_id % 4 <> 0").select("path", "key", F.expr("CAST(IF(doc_id % 5 = 0, 1 - quality, quality) AS STRING)").alias("value"))
    return catalog.merge_meta(old, new)


@query("catalog_status", f"""
WITH a AS (SELECT path, size, CAST(doc_id AS DOUBLE) AS m FROM ({DOCS}) WHERE doc_id % 7 <> 0),
b AS (SELECT path, size + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS size, CAST(doc_id AS DOUBLE) AS m FROM ({DOCS}) WHERE doc_id % 5 <> 0)
SELECT path, state FROM (SELECT path, CASE WHEN a.size IS NULL THEN 'missing' WHEN b.size IS NULL THEN 'unindexed' WHEN a.size <> b.size THEN 'changed' END AS state
FROM a FULL JOIN b USING (path)) WHERE state IS NOT NULL""")  # fmt: skip
def _(spark, d):
    rows = V.docs(spark, d).select("path", "size", "doc_id", F.col("doc_id").cast("double").alias("mtime"))
    files = rows.where("doc_id % 5 <> 0").withColumn("size", F.expr("size + IF(doc_id % 11 = 0, 1, 0)"))
    return catalog.status(rows.where("doc_id % 7 <> 0"), files)


@query("upsert_latest", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def _(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return catalog.upsert_latest(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("catalog_export")
def _(spark, d):
    docs, t = V.docs(spark, d), _tags(spark, d)
    notes = table(spark, d, "conversations").select(F.concat(F.lit("src0/"), F.col("conv_id"), F.lit(".txt")).alias("path"), F.col("turn").alias("created"), F.col("text").alias("body"))
    return catalog.export(docs, t, notes, _meta(spark, d).withColumn("path", F.concat(F.lit("src0/"), F.regexp_extract("path", r"\d+", 0), F.lit(".txt"))))


# --- packing ------------------------------------------------------------------------------


def _pack(spark, d, budget=500_000):
    kind = F.when(F.col("lang") == "es", "image").when(F.col("lang") == "de", "binary").otherwise("text")
    files = V.docs(spark, d).select("path", "size", T.token_estimate(F.col("content")).alias("tokens"), pack.skip_reason(F.col("size"), kind, 20_000).alias("skipped"))
    return pack.within_budget(files, budget, ["path"])


SKIP = f"""SELECT path, size, CAST(ceil(length(content) / 3.6e0) AS BIGINT) AS tokens, CASE WHEN size > 20000 THEN 'too-large' WHEN lang = 'es' THEN 'image' WHEN lang = 'de' THEN 'binary' END AS skipped FROM ({DOCS})"""
BUDGET = f"""SELECT path, size, tokens, CASE WHEN skipped IS NOT NULL THEN skipped
  WHEN sum(CASE WHEN skipped IS NULL THEN size ELSE 0 END) OVER (ORDER BY path ROWS UNBOUNDED PRECEDING) > 500000 THEN 'over-budget' END AS skipped FROM ({SKIP})"""


@query("pack_skip_ladder", f"SELECT path, skipped FROM ({SKIP})")
def _(spark, d):
    kind = F.when(F.col("lang") == "es", "image").when(F.col("lang") == "de", "binary").otherwise("text")
    return V.docs(spark, d).select("path", pack.skip_reason(F.col("size"), kind, 20_000).alias("skipped"))


@query("pack_budget", BUDGET)
def _(spark, d):
    return _pack(spark, d)


@query("pack_stats", f"""SELECT CAST(count(*) FILTER (skipped IS NULL) AS BIGINT) AS included, CAST(count(*) FILTER (skipped IS NOT NULL) AS BIGINT) AS skipped,
  CAST(coalesce(sum(size) FILTER (skipped IS NULL), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(tokens) FILTER (skipped IS NULL), 0) AS BIGINT) AS tokens FROM ({BUDGET})""")  # fmt: skip
def _(spark, d):
    return pack.stats(_pack(spark, d))


@query("pack_chunks", """
WITH RECURSIVE t AS (SELECT source, doc_id, CAST(ceil(length(text) / 3.6e0) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
r AS (SELECT source, doc_id, tokens, n, CAST(1 AS BIGINT) AS chunk, tokens AS used FROM t WHERE n = 1
UNION ALL SELECT t.source, t.doc_id, t.tokens, t.n, CASE WHEN r.used = 0 OR r.used + t.tokens <= 8000 THEN r.chunk ELSE r.chunk + 1 END,
  CASE WHEN r.used = 0 OR r.used + t.tokens <= 8000 THEN r.used + t.tokens ELSE t.tokens END FROM r JOIN t ON t.source = r.source AND t.n = r.n + 1)
SELECT source, doc_id, tokens, chunk FROM r""")  # fmt: skip
def _(spark, d):
    files = table(spark, d, "documents").select("source", "doc_id", T.token_estimate(F.col("text")).alias("tokens"))
    return pack.chunks(files, 8000, "source", ["doc_id"])


@query("pack_query_order", f"SELECT path, score, CAST(row_number() OVER (ORDER BY score, path) AS BIGINT) AS place FROM ({_bm25_sql([(['anin'], False)], 'f0 > 0', [0], limit=10)})")
def _(spark, d):
    top = search.search(V.docs(spark, d), "anin", limit=10).withColumn("score", F.round("score", 6))
    return top.withColumn("place", F.row_number().over(Window.orderBy("score", "path")).cast("bigint"))  # ten rows


@query("pack_markdown", f"""
SELECT path, '## ' || path || chr(10) || chr(10) || f || chr(10) || content || chr(10) || f || chr(10) AS section
FROM (SELECT path, content, repeat('`', CAST(greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(content, '`+'), lambda x: length(x))), 0)) AS INTEGER)) AS f FROM ({DOCS}))""")
def _(spark, d):
    return V.docs(spark, d).select("path", pack.markdown_section(F.col("path"), F.col("content")).alias("section"))


# --- mail, html, json ---------------------------------------------------------------------


def _message(turn):
    """What names a message."""
    return F.struct("conv_id", turn.cast("bigint").alias("turn"))


@query("thread_groups", """
SELECT conv_id, CAST(count(*) AS BIGINT) AS messages, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS from_user, CAST(max(turn) + 1 AS BIGINT) AS depth FROM conversations GROUP BY conv_id""")  # fmt: skip
def _(spark, d):
    from paperloom.operators.graph import components

    c = table(spark, d, "conversations").select("conv_id", "turn", "role", _message(F.col("turn")).alias("id"))
    replies = c.where("turn > 0").select(F.col("id").alias("a"), _message(F.col("turn") - 1).alias("b"))
    found = components(replies)
    joined = c.join(found, c["id"] == found["node"], "left").withColumn("root", F.coalesce("component", "id"))
    return joined.groupBy("root").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("messages"), F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).cast("bigint").alias("from_user"), (F.max("turn") + 1).alias("depth")
    ).drop("root")


@query("thread_depth", "SELECT conv_id, turn, CAST(turn + 1 AS BIGINT) AS depth FROM conversations")
def _(spark, d):
    from paperloom.operators.graph import depths

    c = table(spark, d, "conversations").select("conv_id", "turn", _message(F.col("turn")).alias("id"))
    c = c.withColumn("parent", F.when(F.col("turn") > 0, _message(F.col("turn") - 1)))
    return depths(c, "id", "parent").select("conv_id", "turn", "depth")


@query("top_senders", "SELECT role AS sender, CAST(count(*) AS BIGINT) AS messages FROM conversations GROUP BY role ORDER BY messages DESC, sender LIMIT 5")
def _(spark, d):
    from paperloom.sources import mail

    raw = F.concat(F.lit("From: "), F.col("role"), F.lit("\nSubject: s\n\n")).cast("binary")
    read = spread(table(spark, d, "conversations").select("role")).select(F.col("role").alias("place"), mail.summary(raw)["from"].alias("from"))
    return mail.sender_counts(read, 5).select("sender", "messages")


@query("html_counts", """
SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<a[\\s>]')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '(?i)<img[\\s>]')) AS BIGINT) AS images,
  CAST(len(regexp_extract_all(html, '(?i)<h[1-6][\\s>]')) AS BIGINT) AS headings FROM pages""")  # fmt: skip
def _(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", html.tag_count(h, "a").alias("links"), html.tag_count(h, "img").alias("images"), html.tag_count(h, "h[1-6]").alias("headings"))


@query("json_leaves", "SELECT event_id, unnest(json_keys(props)) AS path, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events")
def _(spark, d):
    leaves = table(spark, d, "events").select("event_id", F.explode(diff.json_leaves("convert")("props")).alias("l"))
    return leaves.select("event_id", "l.path", "l.value")


@query("csv_infer_types", """
SELECT p_partkey, col, value, CASE WHEN value IN ('true', 'false') THEN 'bool' WHEN regexp_matches(value, '^[+-]?[0-9]+$') THEN 'int'
  WHEN regexp_matches(value, '^[+-]?([0-9]+\\.[0-9]*|\\.?[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'float' ELSE 'str' END AS kind
FROM (SELECT p_partkey, unnest(['name', 'size', 'price']) AS col, unnest([p_name, CAST(p_size AS VARCHAR), CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR)]) AS value FROM part)""")  # fmt: skip
def _(spark, d):
    from paperloom.operators.convert import cell_kind

    p = table(spark, d, "part")
    cells = F.array(*[F.struct(F.lit(n).alias("col"), c.alias("value")) for n, c in (("name", F.col("p_name")), ("size", F.col("p_size").cast("string")), ("price", F.col("p_retailprice").cast("decimal(18,2)").cast("string")))])
    rows = p.select("p_partkey", F.explode(cells).alias("c")).select("p_partkey", "c.*")
    return rows.withColumn("kind", cell_kind(F.col("value")))


# --- differences --------------------------------------------------------------------------

OLD = "SELECT o_orderkey, unnest(['status', 'priority']) AS leaf, unnest([o_orderstatus, o_orderpriority]) AS value FROM orders WHERE o_orderkey % 10 <> 0"
NEW = "SELECT o_orderkey, unnest(['status', 'priority']) AS leaf, unnest([CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END, o_orderpriority]) AS value FROM orders WHERE o_orderkey % 9 <> 0"


@query("struct_diff", f"""
SELECT * FROM (SELECT o_orderkey, leaf, CASE WHEN o.value IS NULL THEN 'added' WHEN n.value IS NULL THEN 'removed' WHEN o.value <> n.value THEN 'changed' END AS change, o.value AS old, n.value AS new
FROM ({OLD}) o FULL JOIN ({NEW}) n USING (o_orderkey, leaf)) WHERE change IS NOT NULL""")  # fmt: skip
def _(spark, d):
    o = table(spark, d, "orders")

    def leaves(df, status):
        pairs = F.array(F.struct(F.lit("status").alias("leaf"), status.alias("value")), F.struct(F.lit("priority").alias("leaf"), F.col("o_orderpriority").alias("value")))
        return df.select("o_orderkey", F.explode(pairs).alias("p")).select("o_orderkey", "p.*")

    changed = F.when(F.col("o_orderkey") % 4 == 0, "X").otherwise(F.col("o_orderstatus"))
    return diff.leaf_diff(leaves(o.where("o_orderkey % 10 <> 0"), F.col("o_orderstatus")), leaves(o.where("o_orderkey % 9 <> 0"), changed), ["o_orderkey", "leaf"])


@query("csv_positional_diff", """
WITH o AS (SELECT n_nationkey AS row_no, unnest(['n_name', 'n_regionkey']) AS "column", unnest([n_name, CAST(n_regionkey AS VARCHAR)]) AS value FROM nation WHERE n_nationkey < 23),
n AS (SELECT n_nationkey AS row_no, unnest(['n_name', 'n_regionkey']) AS "column", unnest([CASE WHEN n_nationkey % 6 = 0 THEN lower(n_name) ELSE n_name END, CAST(n_regionkey AS VARCHAR)]) AS value FROM nation WHERE n_nationkey >= 0)
SELECT * FROM (SELECT row_no, "column", CASE WHEN o.value IS NULL THEN 'added' WHEN n.value IS NULL THEN 'removed' WHEN o.value <> n.value THEN 'changed' END AS change, o.value AS old, n.value AS new
FROM o FULL JOIN n USING (row_no, "column")) WHERE change IS NOT NULL""")  # fmt: skip
def _(spark, d):
    n = table(spark, d, "nation").withColumnRenamed("n_nationkey", "row_no")
    new = n.withColumn("n_name", F.expr("IF(row_no % 6 = 0, lower(n_name), n_name)"))
    return diff.row_diff(n.where("row_no < 23"), new, "row_no", ["n_name", "n_regionkey"])


@query("unified_diff")
def _(spark, d):
    docs = V.docs(spark, d).select("path", "content")
    found = linediff.unified(docs, docs.withColumn("content", F.replace("content", F.lit("the"), F.lit("thy"))), "path", "content")
    return docs.select("path").join(found.withColumnRenamed("key", "path"), "path", "left").withColumn("diff", F.coalesce("diff", F.lit("")))


# --- fields, naming, intake ---------------------------------------------------------------

INVOICE_TOTAL = "CAST(o_totalprice AS DECIMAL(18,2))"


@query("fields_total_date", f"""
SELECT 'inv/' || o_orderkey || '.txt' AS path, CAST({INVOICE_TOTAL} AS VARCHAR) AS total, 'USD' AS currency, strftime(o_orderdate, '%Y-%m-%d') AS date,
  strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS due, 'INV-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS invoice, CAST(o_orderkey AS VARCHAR) AS vendor
FROM orders JOIN customer ON o_custkey = c_custkey""")  # fmt: skip
def _(spark, d):
    from paperloom.operators.fields import extract

    f = extract(V.invoices(spark, d).select("path", "content"))
    one = lambda n: F.col(f"fields.{n}.value").alias(n)
    return f.select("path", *[one(n) for n in ("total", "currency", "date", "due")], F.col("fields.invoice_no.value").alias("invoice"), one("vendor"))


@query("fields_currency_mode", "SELECT 'USD' AS currency, CAST(count(*) AS BIGINT) AS files FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    from paperloom.operators.fields import extract

    f = extract(V.invoices(spark, d).select("path", "content"))
    return f.groupBy(F.col("fields.currency.value").alias("currency")).agg(F.count("*").alias("files"))


@query("fiscal_quarter", """
SELECT o_orderkey, CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 7 THEN 1 ELSE 0 END AS BIGINT) AS fy, CAST(((month(o_orderdate) - 7 + 12) % 12) // 3 + 1 AS BIGINT) AS quarter FROM orders""")  # fmt: skip
def _(spark, d):
    day = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", T.fiscal_year(day, 7).alias("fy"), T.fiscal_quarter(day, 7).alias("quarter"))


@query("dest_dir", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m') AS dir FROM orders")
def _(spark, d):
    from paperloom.plans.intake import destination

    return table(spark, d, "orders").select("o_orderkey", destination(F.col("o_orderdate")).alias("dir"))


@query("rename_names", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '_' || regexp_replace(regexp_replace(regexp_replace(c_name || ' ' || o_orderpriority, '[^A-Za-z0-9._-]+', '_', 'g'), '_{2,}', '_', 'g'), '^[._]+|[._]+$', '', 'g') || '.txt' AS name
FROM orders JOIN customer ON o_custkey = c_custkey""")  # fmt: skip
def _(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    name = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_"), T.slug(F.concat_ws(" ", "c_name", "o_orderpriority")), F.lit(".txt"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", name.alias("name"))


@query("uncollide_names", """
SELECT c_custkey, lower(c_mktsegment) || CASE WHEN n = 0 THEN '' ELSE '-' || n END || '.txt' AS name
FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS n FROM customer)""")  # fmt: skip
def _(spark, d):
    from paperloom.sources.files import unique_targets

    wished = table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 19, "0").alias("path"), F.concat(F.lower("c_mktsegment"), F.lit(".txt")).alias("to"))
    return unique_targets(wished).select(F.col("path").cast("bigint").alias("c_custkey"), F.col("to").alias("name"))


@query("organize_buckets", f"""
SELECT bucket, CAST(count(*) AS BIGINT) AS files FROM (SELECT CASE WHEN ext = '.html' THEN 'web' WHEN ext = '.txt' THEN 'text' ELSE 'other' END AS bucket
FROM (SELECT regexp_extract(path, '(\\.[^./]*)$', 1) AS ext FROM ({DOCS}) UNION ALL SELECT '.html' FROM pages)) GROUP BY bucket""")  # fmt: skip
def _(spark, d):
    paths = V.docs(spark, d).select("path").unionByName(table(spark, d, "pages").select(F.concat(F.lit("pages/"), F.col("page_id"), F.lit(".html")).alias("path")))
    ext = T.suffix(F.col("path"))
    bucket = F.when(ext == ".html", "web").when(ext == ".txt", "text").otherwise("other")
    return paths.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("files"))


# --- events -------------------------------------------------------------------------------


@query("debounce_sessions", """
WITH g AS (SELECT user_id, ts, event_id, event_type, CASE WHEN ts > lag(ts) OVER w + INTERVAL 10 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT CAST(user_id AS VARCHAR) AS path, min(ts) AS start, max(ts) AS "end", CAST(count(*) AS BIGINT) AS n_events, arg_max(event_type, (ts, event_id)) AS last_type FROM s GROUP BY user_id, k""")  # fmt: skip
def _(spark, d):
    from paperloom.streaming.events import debounce

    found = debounce(V.events(spark, d), "10 minutes")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("settle_state", """
WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS path, epoch_us(ts) AS us, round(value) AS sig, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT path, n, sig, us AS since, us AS first, event_type = 'deleted' AS gone, CAST(NULL AS BIGINT) AS due, CAST(NULL AS VARCHAR) AS reason FROM e WHERE n = 1
  UNION ALL SELECT path, n, sig, CASE WHEN fires OR sig <> old THEN us ELSE since END, CASE WHEN fires THEN us ELSE first END, event_type = 'deleted', CASE WHEN fires AND NOT gone THEN ends END, CASE WHEN since + 600000000 <= first + 7200000000 THEN 'stable' ELSE 'timeout' END
  FROM (SELECT e.path, e.n, e.us, e.sig, e.event_type, r.sig AS old, r.since, r.first, r.gone, least(r.since + 600000000, r.first + 7200000000) AS ends, r.gone OR e.us >= least(r.since + 600000000, r.first + 7200000000) AS fires FROM r JOIN e ON e.path = r.path AND e.n = r.n + 1)),
f AS (SELECT path, due, reason FROM r WHERE due IS NOT NULL UNION ALL SELECT path, since, 'deleted' FROM r WHERE gone
  UNION ALL SELECT path, least(since + 600000000, first + 7200000000), CASE WHEN since + 600000000 <= first + 7200000000 THEN 'stable' ELSE 'timeout' END FROM r WHERE NOT gone QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC) = 1)
SELECT path, make_timestamp(due) AS fired_at, reason FROM f""")
def _(spark, d):
    from paperloom.streaming.events import settled

    return settled(V.events(spark, d), 600.0, 7200.0).withColumn("fired_at", F.col("fired_at").cast("timestamp_ntz"))


@query("suppress_own_moves", """
SELECT event_id FROM events e WHERE event_type <> 'purchase' AND NOT EXISTS (SELECT 1 FROM events m WHERE m.user_id = e.user_id AND m.event_type = 'purchase' AND e.ts >= m.ts AND e.ts <= m.ts + INTERVAL 30 MINUTE)""")
def _(spark, d):
    from paperloom.streaming.events import suppress_own

    e = V.events(spark, d)
    return suppress_own(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'").select("path", "ts"), 1800.0).select("event_id")


@query("inflight_dropped", """
WITH e AS (SELECT event_id, ts, event_type, CASE event_id % 3 WHEN 0 THEN 'in/f' || user_id || '.pdf' WHEN 1 THEN 'out/f' || user_id || '.txt' ELSE 'f' || user_id || '-2.pdf' END AS path, user_id FROM events)
SELECT event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'error' AND r.user_id = e.user_id AND e.event_id % 3 < 2 AND e.ts >= r.ts AND e.ts < r.ts + INTERVAL 20 MINUTE)""")
def _(spark, d):
    from paperloom.streaming.events import without_inflight

    name = F.expr("CASE event_id % 3 WHEN 0 THEN concat('in/f', path, '.pdf') WHEN 1 THEN concat('out/f', path, '.txt') ELSE concat('f', path, '-2.pdf') END")
    e = V.events(spark, d)
    runs = e.where("event_type = 'error'").select(F.concat(F.lit("in/f"), "path", F.lit(".pdf")).alias("path"), F.col("ts").alias("started"), (F.col("ts") + F.expr("INTERVAL 20 MINUTES")).alias("finished"))
    return without_inflight(e.withColumn("path", name), runs).select("event_id")


@query("manifest_resume", "SELECT path FROM (SELECT CAST(user_id AS VARCHAR) AS path, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND ok")
def _(spark, d):
    rows = V.events(spark, d).select("path", F.col("ts").alias("time"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))
    return catalog.resume(rows)


@query("batch_summary", """
SELECT event_type, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (value >= 10) AS BIGINT) AS ok, CAST(count(*) FILTER (value < 10) AS BIGINT) AS failed, round(sum(CAST(value AS DECIMAL(18,4))), 2)::DOUBLE AS seconds FROM events GROUP BY event_type""")  # fmt: skip
def _(spark, d):
    e = table(spark, d, "events").groupBy("event_type")
    return e.agg(F.count("*").alias("total"), F.count_if(F.col("value") >= 10).alias("ok"), F.count_if(F.col("value") < 10).alias("failed"), F.round(F.sum(F.col("value").cast("decimal(18,4)")), 2).cast("double").alias("seconds"))


@query("contrast_check", """
SELECT fg, bg, round((greatest(a, b) + 0.05e0) / (least(a, b) + 0.05e0), 4) AS ratio FROM (SELECT fg, bg, """ + ", ".join(
    " + ".join(f"{w} * (CASE WHEN {c} <= 0.04045e0 THEN {c} / 12.92e0 ELSE pow(({c} + 0.055e0) / 1.055e0, 2.4e0) END)" for w, c in
               ((w, f"(CAST('0x' || substr({x}, {at}, 2) AS INTEGER) / 255e0)") for w, at in (("0.2126e0", 2), ("0.7152e0", 4), ("0.0722e0", 6)))) + f" AS {n}"
    for x, n in (("fg", "a"), ("bg", "b"))) + """ FROM (VALUES ('#000000', '#ffffff'), ('#777777', '#ffffff'), ('#123456', '#fedcba')) AS t(fg, bg))""")
def _(spark, d):
    rows = spark.createDataFrame([("#000000", "#ffffff"), ("#777777", "#ffffff"), ("#123456", "#fedcba")], "fg string, bg string")
    return rows.select("fg", "bg", F.round(T.contrast(F.col("fg"), F.col("bg")), 4).alias("ratio"))


@query("sha256_manifest", f"SELECT sha256(content) || '  ' || path AS line FROM ({DOCS})")
def _(spark, d):
    return catalog.manifest_lines(V.docs(spark, d))


@query("inspect_kinds", f"SELECT path, {KIND.replace('value', 'content')} AS kind, regexp_extract(path, '(\\.[^./]*)$', 1) AS suffix FROM ({DOCS})")
def _(spark, d):
    return V.docs(spark, d).select("path", infer_kind(F.col("content")).alias("kind"), T.suffix(F.col("path")).alias("suffix"))


@query("meta_canonical", f"SELECT path, key, {CANON.format(k=KIND)} AS value FROM ({CUSTOMER_FACTS})")
def _(spark, d):
    f = V.customer_facts(spark, d)
    return f.select("path", "key", canonical(F.col("value"), infer_kind(F.col("value"))).alias("value"))
