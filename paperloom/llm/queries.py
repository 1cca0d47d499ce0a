"""The queries op1 to op13 and their SQL, where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import table


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.hnsw import build_index, clean, search

    rows = clean(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(build_index(rows), rows.where("pmod(id, 20) = 0"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.source_mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.warc import round_trip

    read = round_trip(table(spark, sf_dir, "pages"))
    return read.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.hyperminhash import duplicate_components

    found = duplicate_components(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.compression_quality import fit, held_out, score_quality

    docs, out = table(spark, sf_dir, "documents"), held_out("doc_id", 5, 0)
    model = fit(docs, table(spark, sf_dir, "labels"), may_learn=~out)
    scored = score_quality(docs, model, carry=["doc_id"])
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


def op8_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.ring_sharding import ring_shard

    return ring_shard(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.compression_quality import held_out
    from paperloom.llm.ppm import score_documents

    return score_documents(table(spark, sf_dir, "documents"), held_out("doc_id", 7, 2), carry=["doc_id"])


def op10_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.positional_index import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"], with_near=True)


def op11_residue_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.residue_whitening import whiten

    found = whiten(table(spark, sf_dir, "embeddings"), carry=["vec_id"])
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.conversation_repair import damage, repair

    found = repair(damage(table(spark, sf_dir, "conversations")), with_turns=False)
    return found.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.cross_polytope import linked_rows

    found = linked_rows(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return found.select("vec_id", "n_links", "component_id", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3, "op4_warc_salvage": OP4, "op6_hyperminhash": OP6, "op10_positional_index": OP10, "op12_conversation_repair": OP12, "op13_cross_polytope": OP13}


OP3 = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM x) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM hit),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP6 = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT doc_id AS node, doc_id AS other FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT node, min(other) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c ON c.node = d.doc_id LEFT JOIN n USING (doc_id)
"""

OP10 = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
sizes AS (SELECT DISTINCT n FROM bn),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, n, i FROM dw JOIN bw USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
tok AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
freq AS (SELECT word, count(*) AS c FROM tok GROUP BY word),
win AS (SELECT row_number() OVER () AS wid, ws FROM (SELECT DISTINCT w[i:i + n - 1] AS ws FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bn))),
term AS (SELECT DISTINCT wid, unnest(ws) AS word FROM win),
rare AS (SELECT wid, arg_min(word, (coalesce(c, 0), word)) AS word, count(*) AS k FROM term LEFT JOIN freq USING (word) GROUP BY wid HAVING min(coalesce(c, 0)) > 0),
close AS (SELECT r.wid, t.doc_id FROM rare r JOIN tok t USING (word) JOIN tok o ON o.doc_id = t.doc_id AND o.pos BETWEEN t.pos - 20 AND t.pos + 20
  JOIN term x ON x.wid = r.wid AND x.word = o.word GROUP BY r.wid, r.k, t.doc_id, t.pos HAVING count(DISTINCT x.word) = r.k),
own AS (SELECT DISTINCT item_id, wid FROM (SELECT item_id, w[i:i + n - 1] AS ws FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bn)) JOIN win USING (ws)),
nears AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM close JOIN own USING (wid) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nears USING (doc_id)
"""


OP4 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), g AS (
  SELECT d, max(page_id) AS holder FROM p WHERE n >= 1000 GROUP BY d
)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN g.holder IS NULL OR g.holder = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.holder <> p.page_id THEN g.holder END AS refers_to
FROM p LEFT JOIN g ON p.n >= 1000 AND p.d = g.d
"""


OP12 = """
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), coded AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS how FROM raw, tab
), after AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN how = 1 THEN '' WHEN how = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE how <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
    CASE left(role, 1) WHEN 's' THEN 's' WHEN 'u' THEN 'u' WHEN 'a' THEN 'a' ELSE 'x' END AS ini FROM after
), faults AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN seen THEN 'duplicate' WHEN regexp_matches(text, '[^.!?\\x20\\x09-\\x0D][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY conv_id
), best AS (
  SELECT conv_id, n AS i, [struct_pack(c := 0, a := '', o := CAST([] AS VARCHAR[])), struct_pack(c := 6, a := 'II', o := ['user:', 'assistant:']), struct_pack(c := 3, a := 'I', o := ['assistant:']), struct_pack(c := 0, a := '', o := CAST([] AS VARCHAR[]))] AS b FROM counts
  UNION ALL
  SELECT conv_id, i, [least(v[1], {'c': 3 + v[3].c, 'a': 'I' || v[3].a, 'o': list_prepend('user:', v[3].o)}, {'c': 6 + v[4].c, 'a': 'II' || v[4].a, 'o': list_concat(['user:', 'assistant:'], v[4].o)}),
    least(v[2], {'c': 3 + v[3].c, 'a': 'I' || v[3].a, 'o': list_prepend('user:', v[3].o)}, {'c': 6 + v[4].c, 'a': 'II' || v[4].a, 'o': list_concat(['user:', 'assistant:'], v[4].o)}),
    least(v[3], {'c': 3 + v[4].c, 'a': 'I' || v[4].a, 'o': list_prepend('assistant:', v[4].o)}),
    least(v[4], {'c': 3 + v[3].c, 'a': 'I' || v[3].a, 'o': list_prepend('user:', v[3].o)})] AS b
  FROM (
    SELECT best.conv_id, best.i - 1 AS i, list_transform(range(1, 5), lambda q: least(
      {'c': 4 + b[q].c, 'a': 'D' || b[q].a, 'o': b[q].o},
      CASE WHEN fault IN ('blank', 'duplicate') THEN NULL WHEN (ini = 's' AND q = 1) OR (ini = 'u' AND q <> 3) OR (ini = 'a' AND q = 3)
        THEN {'c': b[CASE ini WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'a': 'K' || b[CASE ini WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].a,
          'o': list_prepend(role || ':' || text, b[CASE ini WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].o)} END,
      CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {'c': b[CASE WHEN q = 3 THEN 4 ELSE 3 END].c + CASE WHEN fault = 'truncated' THEN 6 ELSE 3 END, 'a': 'R' || b[CASE WHEN q = 3 THEN 4 ELSE 3 END].a,
          'o': list_prepend(CASE WHEN q = 3 THEN 'assistant:' ELSE 'user:' END || text, b[CASE WHEN q = 3 THEN 4 ELSE 3 END].o)} END)) AS v
    FROM best JOIN faults f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.i = best.i WHERE best.i > 0
  )
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b[1].c, 0) AS BIGINT) AS cost, coalesce(b[1].a, '') AS audit, sha256(coalesce(array_to_string(b[1].o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id AND best.i = 0
"""


OP13 = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), e AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.98
), r AS (SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT node, min(other) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
"""
