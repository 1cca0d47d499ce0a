"""The document desk's views over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import spread, table


def path():
    return F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def docs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select(path().alias("path"), F.col("text").alias("content"), "doc_id", "lang", F.octet_length("text").cast("bigint").alias("size"))


def order_facts(spark: SparkSession, d: str) -> DataFrame:
    """(path, key, value) texts of orders: total, due, status, priority."""
    o = table(spark, d, "orders")
    pairs = F.array(
        F.struct(F.lit("total").alias("key"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("value")),
        F.struct(F.lit("due").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value")),
        F.struct(F.lit("status").alias("key"), F.col("o_orderstatus").alias("value")),
        F.struct(F.lit("priority").alias("key"), F.col("o_orderpriority").alias("value")),
    )
    return o.select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("path"), F.explode(pairs).alias("p")).select("path", "p.*")


def customer_facts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    pairs = F.array(
        F.struct(F.lit("vendor").alias("key"), F.col("c_name").alias("value")),
        F.struct(F.lit("segment").alias("key"), F.col("c_mktsegment").alias("value")),
        F.struct(F.lit("balance").alias("key"), F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("value")),
    )
    return c.select(F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("path"), F.explode(pairs).alias("p")).select("path", "p.*")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("path"), "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.round("value").cast("string").alias("signature")
    )


def invoices(spark: SparkSession, d: str) -> DataFrame:
    """(path, content) of invoice texts made of orders and customers, dealt out evenly before they are written."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    joined = spread(o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "o_orderdate", "o_totalprice", "c_name"))
    money = F.format_string("%s", F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    number = F.concat(F.lit("INV-"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0"))
    text = F.concat_ws(
        "\n", F.regexp_replace("c_name", "#", " "), F.concat(F.lit("Invoice # "), number), F.concat(F.lit("Invoice date: "), day),
        F.concat(F.lit("Subtotal: $"), F.lit("1.00")), F.concat(F.lit("Total due: $"), money), F.lit("Net 30"),
    )
    return joined.select(F.concat(F.lit("inv/"), F.col("o_orderkey").cast("string"), F.lit(".txt")).alias("path"), text.alias("content"), "o_orderkey")
