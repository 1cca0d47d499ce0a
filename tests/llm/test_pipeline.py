import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_pipeline(spark):
    import corpus_pipeline as c
    from paperloom.llm.hyperminhash import duplicate_components
    from paperloom.session import table

    docs = table(spark, DATA, "documents")
    names = docs.columns
    counts = []
    for i, (_, stage) in enumerate(c.STAGES):
        docs = stage(spark, docs, DATA).checkpoint()
        counts.append(docs.count())
        if i < len(c.STAGES) - 1:
            assert docs.columns == names
        if i == 1:
            assert duplicate_components(docs).where("id <> component").count() == 0
    assert counts[0] >= counts[1] >= counts[2] and counts[3] == counts[4]
    assert c.run(spark, DATA).count() == counts[-1]


def test_near_dedup_links_from_four_fifths(spark):
    """Against brute force at 0.8, with pairs between 0.80 and 0.85."""
    import random

    import corpus_pipeline as c

    rng, rows = random.Random(5), []
    for i in range(150):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 58, 90, 200, 600]))]
        rows.append((2 * i, " ".join(w)))
        cut = int(len(w) * rng.uniform(0.06, 0.14))
        rows.append((2 * i + 1, " ".join(w[cut:] + [f"n{rng.randrange(5000)}" for _ in range(rng.randrange(cut + 1))])))
    rows.append((1000, None))
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows if (w := (t or "").split())}
    linked, between = set(), 0
    for i in range(150):
        s, t = sets[2 * i], sets[2 * i + 1]
        share = len(s & t) / len(s | t)
        between += 0.8 <= share < 0.85
        if 100 * len(s & t) >= 80 * len(s | t):
            linked.add(2 * i + 1)
    assert between >= 10 and len(linked) < 140
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in c.near_dedup(spark, docs, DATA).collect()} == {i for i, _ in rows} - linked


def test_pipeline_on_odd_tables(spark):
    """Nulls, repeated rows, extra columns with clashing names, and an empty table through every stage."""
    import corpus_pipeline as c

    long = "the river runs over the stones and the sand " * 4
    rows = [(1, long, "en", "a", 5), (1, long, "en", "a", 5), (2, None, None, None, 0), (3, "", "en", "b", 0), (None, "some words here that stay", "en", "b", 9), (4, long + "x", "en", None, 6), (1, "another text under the same number", "en", "a", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "doc_id AS id", "n_chars AS size", "lang AS shard", "source AS label", "1 AS _t", "lang AS `a.b`", "source AS `c``d`")
    for table in (docs, docs.limit(0)):
        now = table
        for i, (name, stage) in enumerate(c.STAGES):
            out = stage(spark, now, DATA).checkpoint()
            if i < len(c.STAGES) - 1:
                assert out.columns == docs.columns, name
            if table is not docs:
                assert out.count() == 0, name
            if name == "near-dedup":
                texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect())
                assert len(texts) == len(set(texts)) and (0, rows[4][1]) in texts if table is docs else not texts
            now = out
        assert {"shard", "slot"} <= set(now.columns)


def test_entry_has_the_llm_queries():
    import __spark_entry__ as e

    found = e.queries()
    assert all(any(k.startswith(f"op{n}_") for k in found) for n in range(1, 11)) and "pipeline" in found


def test_clean_operators_need_no_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None\nimport paperloom.plans.registry, sys\nassert not [m for m in sys.modules if m.startswith('paperloom.llm')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))).returncode == 0
