def test_depths_of_any_length(spark):
    from paperloom.operators.graph import depths

    chain = [(i, i - 1) for i in range(2500)]
    rows = [*chain, (3000, 2499), (3001, 7), (4000, 4001), (4001, 4000), (4002, 4001), (5000, None)]
    got = {r["n"]: r["depth"] for r in depths(spark.createDataFrame(rows, "n bigint, p bigint"), "n", "p").collect()}
    assert got == {i: i + 1 for i in range(2500)} | {3000: 2501, 3001: 9, 4000: None, 4001: None, 4002: None, 5000: 1}


def test_long_threads(spark, tmp_path):
    from paperloom.plans import registry

    spark.sql("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, '' AS text FROM (SELECT 1L AS conv_id, CAST(id AS INT) AS turn FROM range(1200) UNION ALL SELECT 1L, CAST(id AS INT) FROM range(99990, 100010) UNION ALL SELECT 2L, CAST(id AS INT) FROM range(5))").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r["conv_id"], r["turn"]): r["depth"] for r in registry.QUERIES["thread_depth"](spark, str(tmp_path)).where("turn < 1200").collect()}
    assert got == {(1, i): i + 1 for i in range(1200)} | {(2, i): i + 1 for i in range(5)}
    groups = registry.QUERIES["thread_groups"](spark, str(tmp_path)).select("conv_id", "messages", "depth").collect()
    assert (2, 5, 5) in {tuple(r) for r in groups} and (1, 1200, 1200) in {tuple(r) for r in groups}


def test_components_in_one_task_and_in_several(spark, monkeypatch):
    import random

    from paperloom.operators import graph

    draw = random.Random(5)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (3000, 3000)]
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    table = spark.createDataFrame(edges, "a bigint, b bigint").repartition(9)
    for size in (7, graph.TASK_EDGES):
        monkeypatch.setattr(graph, "TASK_EDGES", size)
        assert {r["node"]: r["component"] for r in graph.components(table).collect()} == least
    assert graph.components(table.where("a = b")).count() == 0


def test_kept_tables_leave_no_shuffle_files(spark):
    import time

    from paperloom.session import keep

    def files():
        return str(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()).count("/shuffle_")

    before = files()
    kept = keep(spark.range(5000).selectExpr("id % 700 AS k").groupBy("k").count())
    until = time.time() + 10
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before and kept.count() == 700
