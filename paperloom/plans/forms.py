"""Rules on texts that are made of the given tables: amounts, dates, numbers of every kind, conversions, inspection."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import dates, meta, money, patterns
from paperloom.operators import convert
from paperloom.plans.registry import query
from paperloom.session import spread, table

PLAIN = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)"


@query("money_forms", f"""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN '-' || {PLAIN} WHEN 3 THEN '-' || {PLAIN} ELSE {PLAIN} END AS value, CASE o_orderkey % 5 WHEN 0 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 4 THEN 'GBP' END AS currency FROM orders""")
def _(spark, d):
    """Totals in five forms, read back: $1,234.56, (1234.56), 1.234,56 €, 1,234.56-, £1234.56."""
    exact = F.col("o_totalprice").cast("decimal(18,2)")
    grouped, plain = F.format_number(exact, 2), exact.cast("string")
    swapped = F.translate(grouped, ",.", ".,")
    form = F.col("o_orderkey") % 5
    text = F.when(form == 0, F.concat(F.lit("Total $"), grouped)).when(form == 1, F.concat(F.lit("("), plain, F.lit(")"))).when(form == 2, F.concat(swapped, F.lit(" €"))).when(form == 3, F.concat(grouped, F.lit("-"))).otherwise(F.concat(F.lit("£"), plain))
    found = table(spark, d, "orders").select("o_orderkey", money.amounts(text).alias("a"))
    return found.select("o_orderkey", F.get("a", F.lit(0))["value"].alias("value"), F.get("a", F.lit(0))["currency"].alias("currency"))


@query("date_forms", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS found, o_orderkey % 5 = 4 AND day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) AS unsure FROM orders""")
def _(spark, d):
    """Order dates in five forms, read back; slashed ones are month first and unsure where the day could be a month."""
    day, form = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = F.when(form == 0, F.date_format(day, "yyyy-MM-dd")).when(form == 1, F.date_format(day, "MMMM d, yyyy")).when(form == 2, F.date_format(day, "d MMM yyyy")).when(form == 3, F.date_format(day, "yyyy/M/d")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    found = table(spark, d, "orders").select("o_orderkey", F.get(dates.dates(F.concat(F.lit("on "), text), "mdy"), F.lit(0)).alias("f"))
    return found.select("o_orderkey", F.col("f.value").cast("string").alias("found"), F.col("f.ambiguous").alias("unsure"))


NUMBERS = [
    ("invoice", "concat('Invoice # A-', o_orderkey)", "'A-' || o_orderkey"), ("po", "concat('P.O. number: 7', o_orderkey)", "'7' || o_orderkey"), ("order", "concat('Order no. X', o_orderkey)", "'X' || o_orderkey"),
    ("check", "concat('cheque #', 1000 + o_orderkey)", "CAST(1000 + o_orderkey AS VARCHAR)"), ("account", "concat('acct. nr ', 100000 + o_orderkey)", "CAST(100000 + o_orderkey AS VARCHAR)"),
    ("tracking", "concat('Tracking: ab', 1000000 + o_orderkey)", "'AB' || (1000000 + o_orderkey)"), ("ticket", "concat('see OPS-', 10 + o_orderkey % 90000)", "'OPS-' || (10 + o_orderkey % 90000)"),
    ("ein", "concat('12-', 1000000 + o_orderkey)", "'12-' || (1000000 + o_orderkey)"), ("vat", "concat('VAT id: de', 10000000 + o_orderkey)", "'DE' || (10000000 + o_orderkey)"),
    ("doi", "concat('10.1234/x.', o_orderkey, '.')", "'10.1234/x.' || o_orderkey"), ("ups", "concat('1z', 1000000000000000 + o_orderkey)", "'1Z' || (1000000000000000 + o_orderkey)"),
    ("usps", "concat(90000000000000000000 + o_orderkey, '')", "CAST(CAST(90000000000000000000 AS HUGEINT) + o_orderkey AS VARCHAR)"), ("ssn", "concat('123-45-', 1000 + o_orderkey % 9000)", "'123-45-' || (1000 + o_orderkey % 9000)"),
]


@query("kind_forms", "SELECT o_orderkey, unnest([" + ", ".join(f"'{k}'" for k, _, _ in NUMBERS) + "]) AS kind, unnest([" + ", ".join(v for _, _, v in NUMBERS) + "]) AS found FROM orders")
def _(spark, d):
    """Thirteen kinds of numbers that orders are made to carry, each found by its own kind."""
    pairs = [F.struct(F.lit(k).alias("kind"), F.array_join(patterns.REGISTRY[k].values(F.expr(text)), ";").alias("found")) for k, text, _ in NUMBERS]
    return table(spark, d, "orders").select("o_orderkey", F.explode(F.array(*pairs)).alias("p")).select("o_orderkey", "p.*")


DIGIT = "CAST(substr({s}, {i}, 1) AS INTEGER)"


def _sum(s: str, weights: list[int]) -> str:
    return " + ".join(f"{w} * " + DIGIT.format(s=s, i=i + 1) for i, w in enumerate(weights))


ABA = "('0' || CAST(10000000 + o_orderkey AS VARCHAR))"
EAN = "CAST(4006381000000 + o_orderkey AS VARCHAR)"
ISBN = "CAST(9780000000000 + o_orderkey AS VARCHAR)"


@query("check_digits", f"""
SELECT o_orderkey, ({_sum(ABA, [3, 7, 1] * 3)}) % 10 = 0 AS routing, ({_sum(EAN, [1, 3] * 6 + [1])}) % 10 = 0 AS gtin, ({_sum(ISBN, [1, 3] * 6 + [1])}) % 10 = 0 AS isbn FROM orders""")
def _(spark, d):
    """Check digits of numbers counted up by order: bank routing, article and book numbers."""
    v = patterns.VALIDATORS
    number = lambda base: (F.lit(base).cast("bigint") + F.col("o_orderkey")).cast("string")
    return table(spark, d, "orders").select("o_orderkey", v["routing"](F.concat(F.lit("0"), number(10_000_000))).alias("routing"), v["gtin"](number(4_006_381_000_000)).alias("gtin"), v["isbn"](number(9_780_000_000_000)).alias("isbn"))


@query("convert_csv_json", """SELECT p_partkey, '[{"name": "' || p_name || '", "size": ' || p_size || ', "brand": "' || p_brand || '"}]' AS made FROM part""")
def _(spark, d):
    text = F.concat(F.lit("name,size,brand\n"), F.col("p_name"), F.lit(","), F.col("p_size").cast("string"), F.lit(","), F.col("p_brand"), F.lit("\n"))
    return spread(table(spark, d, "part")).select("p_partkey", convert.convert(text, "csv", "json").alias("made"))


@query("convert_json_csv", "SELECT event_id, 'k' || chr(10) || json_extract_string(props, '$.k') || chr(10) AS made FROM events")
def _(spark, d):
    return spread(table(spark, d, "events").select("event_id", "props")).select("event_id", convert.convert(F.concat(F.lit("["), F.col("props"), F.lit("]")), "json", "csv").alias("made"))


@query("meta_number_forms", "SELECT o_orderkey, 'num' AS kind, CAST(CAST(floor(CAST(o_totalprice AS DECIMAL(18,2))) AS BIGINT) AS VARCHAR) AS whole FROM orders")
def _(spark, d):
    """Totals in groups of three, as metadata: their kind and canonical form."""
    given = F.concat(F.lit(" "), F.format_number(F.floor(F.col("o_totalprice").cast("decimal(18,2)")), 0), F.lit(".00 "))
    kind = meta.infer_kind(given)
    return table(spark, d, "orders").select("o_orderkey", kind.alias("kind"), meta.canonical(given, kind).alias("whole"))
