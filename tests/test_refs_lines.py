def test_all_lines_are_counted(spark):
    from paperloom.operators.refs import places

    docs = spark.createDataFrame([("p", "to a@b.org and a@b.org\n" * 25)], "path string, content string")
    (row,) = places(docs, "email").collect()
    assert (row["count"], row["n_lines"], row["lines"]) == (50, 25, list(range(1, 21)))
