import math
import os

import duckdb
import pytest

from paperloom.plans import registry
from paperloom.session import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted({*registry.queries(), *registry.CASES}))
def test_against_sql(spark, duck, name):
    df = (registry.QUERIES | registry.CASES)[name](spark, DATA)
    names = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    if name not in registry.SQL:
        return
    found = duck.execute(registry.SQL[name])
    heads = [c[0] for c in found.description]
    assert sorted(heads) == names
    expected = [tuple(plain(dict(zip(heads, r))[c]) for c in names) for r in found.fetchall()]
    order = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(rows, key=order) == sorted(expected, key=order)


@pytest.mark.parametrize("name", ["convert_csv_json", "mailbox_text", "mail_summaries", "postings"])
def test_costly_rows_are_not_one_task(spark, name):
    """The tables' files hold one row group each, which was one task."""
    assert registry.queries()[name](spark, DATA).rdd.getNumPartitions() >= 8


@pytest.mark.parametrize("name", ["text_stats", "token_estimate"])
def test_measures_of_no_text_are_null(spark, tmp_path, name):
    texts = [None, "a", "a b\n\nc\n", " \n", "\n"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).collect())) == sorted(c.execute(registry.SQL[name]).fetchall())


@pytest.mark.parametrize("name", ["fields_total_date", "fields_currency_mode"])
def test_invoices_are_dealt_out(spark, name):
    """They were as many tasks as cores are known when the query is made, which on a cluster may be few."""
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {8 * spark.sparkContext.defaultParallelism}, true" in plan
