from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paperloom.functions import meta, text
from paperloom.functions.dates import find_dates
from paperloom.functions.money import find_amounts, parse_number
from paperloom.functions.patterns import REGISTRY, custom
from paperloom.plans.registry import LITERALS
from paperloom.operators import convert, pack, refs, search


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("kind,value,good", LITERALS)
def test_check_digits(spark, kind, value, good):
    assert one(spark, REGISTRY[kind].accepts(F.col("v")), v=value) is good


@pytest.mark.parametrize(
    "kind,content,found",
    [
        ("invoice", "Invoice # A-12 and INV-77", ["A-12", "INV-77"]), ("invoice", "invoices are late", []), ("po", "PO Box 12", []), ("order", "order to 12", []),
        ("order", "Order No. 55x", ["55X"]), ("ticket", "ABC-1234 INV-1234", ["ABC-1234"]), ("routing", "1-021000021-2", []), ("routing", "at 021000021.", ["021000021"]),
        ("doi", "see 10.1000/xyz123.", ["10.1000/xyz123"]), ("ups", "1z999aa10123456784", ["1Z999AA10123456784"]), ("ssn", "078-05-1120", ["078-05-1120"]),
        ("iban", "GB82 WEST 1234 5698 7654 32", ["GB82WEST12345698765432"]), ("vat", "DE123456789", []), ("vat", "VAT No: DE123456789", ["DE123456789"]),
    ],
)
def test_kinds(spark, kind, content, found):
    assert one(spark, REGISTRY[kind].values(F.col("v")), v=content) == found


def test_custom_kind(spark):
    assert one(spark, custom(r"case=CASE-(?P<v1>\d+)").values(F.col("v")), v="CASE-7, CASE-8") == ["7", "8"]
    with pytest.raises(ValueError):
        custom("email=x")


def test_redaction_is_sequential_and_checked(spark):
    t = "a@b.co 4111 1111 1111 1111 4111 1111 1111 1112 Invoice # A-12"
    assert one(spark, refs.redact(F.col("v"), ["email", "cc", "invoice"]), v=t) == "[EMAIL] [CC] 4111 1111 1111 1112 Invoice # [INVOICE]"


def test_numbers():
    for s, v in [("1,234.56", "1234.56"), ("1.234,56", "1234.56"), ("1 234,56", "1234.56"), ("1'234.50", "1234.50"), ("1,234", "1234"), ("12,5", "12.5")]:
        assert parse_number(s) == Decimal(v)
    assert parse_number("1,2345") is None


@pytest.mark.parametrize(
    "content,value,currency",
    [("$1,234.56", "1234.56", "USD"), ("1.234,56 €", "1234.56", "EUR"), ("(123.45)", "-123.45", None), ("123.45-", "-123.45", None), ("12.5 CR", "-12.5", None), ("-$1,234.56", "-1234.56", "USD"), ("EUR -5", "-5", "EUR")],
)
def test_amounts(content, value, currency):
    got = find_amounts(content)
    assert [(a["value"], a["currency"]) for a in got] == [(value, currency)]


@pytest.mark.parametrize("content", ["2026.03.04", "2026-0042", "12", "40"])
def test_no_amounts(content):
    assert find_amounts(content) == []


def test_dates():
    day = lambda s, o="mdy": [(str(f["value"]), f["ambiguous"]) for f in find_dates(s, o)]
    assert day("2026-03-04, March 5, 2026; 6 Apr 2026 and 2026/7/8") == [("2026-03-04", False), ("2026-03-05", False), ("2026-04-06", False), ("2026-07-08", False)]
    assert day("09/10/2026") == [("2026-09-10", True)] and day("09/10/2026", "dmy") == [("2026-10-09", True)]
    assert day("31/12/26") == [("2026-12-31", False)] and day("30 February 2026") == [] and day("v1.2.3.4") == []


@pytest.mark.parametrize("value,kind,canonical", [(" true ", "bool", "true"), ("1,234.50", "num", "1234.5"), ("-0", "num", "0"), ("100", "num", "100"), ("2026-10-01", "date", "2026-10-01"), ("2026-13-01", "str", "2026-13-01"), ("1e5", "str", "1e5"), ("02134", "str", "02134")])
def test_meta_kinds(spark, value, kind, canonical):
    k = meta.infer_kind(F.col("v"))
    assert one(spark, F.struct(k, meta.canonical(F.col("v"), k)), v=value) == (kind, canonical)


def test_conditions(spark):
    assert meta.parse_condition("Total >= 1,000") == ("total", ">=", "1,000") and meta.parse_condition("a?") == ("a", "?", "")
    for bad in ("a", "a>>b", "a=", "a?x", ">1"):
        with pytest.raises(ValueError):
            meta.parse_condition(bad)
    rows = spark.createDataFrame([("10", "num"), ("9", "num"), ("02134", "str"), ("true", "bool"), ("50%", "str")], "value string, kind string")
    hit = lambda op, v: sorted(r[0] for r in rows.where(meta.condition(op, v)).collect())
    assert hit(">", "9.5") == ["10"] or hit(">", "9.5") == ["10", "true"]
    assert hit("=", "02134") == ["02134"] and hit("=", "yes") == ["true"] and hit("~", "0%") == ["50%"] and hit("=", "10.0") == ["10"]


def test_query_language():
    assert search.parse("a b") == ("and", search.Phrase(("a",)), search.Phrase(("b",)))
    assert search.parse('"a b" OR c*') == ("or", search.Phrase(("a", "b")), search.Phrase(("c",), True))
    assert search.parse("Café") == search.Phrase(("cafe",))
    for bad in ("", "(a", "a OR", "NEAR(a b)", "^a", "col:a", ")"):
        with pytest.raises(search.QueryError):
            search.parse(bad)


def test_search_and_snippet(spark):
    docs = spark.createDataFrame([("a", "the red fox and the dog"), ("b", "a red dog"), ("c", ""), ("d", None)], "path string, content string")
    got = lambda q: [r[0] for r in search.search(docs, q).collect()]
    assert set(got("red")) == {"a", "b"} and got("red NOT fox") == ["b"] and got('"red fox"') == ["a"] and got("f* OR zzz") == ["a"] and got("zzz") == []
    assert one(spark, search.snippet(F.col("v"), ["fox"], 3), v="one two three red fox four five") == " … three red [fox] … "


def test_text(spark):
    assert one(spark, text.token_estimate(F.col("v")), v="x" * 10) == 3
    assert one(spark, text.slug(F.col("v")), v="..A  b//c__d.") == "A_b_c_d"
    assert one(spark, text.fence(F.col("v")), v="a ```` b") == "`````"
    assert one(spark, text.line_count(F.col("v")), v="a\nb\n") == 2
    assert one(spark, F.col("v").rlike(text.glob_pattern("*.t?t")), v="dir/a.txt") is True


def test_conversion(spark):
    assert one(spark, convert.convert(F.col("v"), "csv", "json"), v="a,b\n1,x\n2.5,true\n") == '[{"a": 1, "b": "x"}, {"a": 2.5, "b": true}]'
    assert one(spark, convert.convert(F.col("v"), "json", "csv"), v='[{"a":{"b":1}},{"c":null}]') == "a.b,c\n1,\n,\n"
    assert one(spark, convert.convert(F.col("v"), "xml", "json"), v='<r id="1"><x>a</x><x>b</x></r>') == '{"r": {"@id": "1", "x": ["a", "b"]}}'
    assert one(spark, convert.convert(F.col("v"), "json", "csv"), v="not json") is None
    assert one(spark, convert.edit_json("v", "p", "n"), v='{"a": [1]}', p="a.1", n="2") == '{"a": [1, 2]}'


def test_budget_and_chunks(spark):
    files = spark.createDataFrame([("a", 5, None), ("b", 50, "image"), ("c", 6, None), ("d", 1, None)], "path string, size bigint, skipped string")
    got = {r["path"]: r["skipped"] for r in pack.within_budget(files, 10, ["path"]).collect()}
    assert got == {"a": None, "b": "image", "c": "over-budget", "d": "over-budget"}
    rows = spark.createDataFrame([("g", i, t) for i, t in enumerate([4, 4, 4, 20, 1])], "g string, i int, tokens bigint")
    assert [r["chunk"] for r in pack.chunks(rows, 8, "g", ["i"]).orderBy("i").collect()] == [1, 1, 2, 3, 4]


def test_fields():
    from paperloom.operators.fields import fields_of

    got = fields_of("Acme Ltd\nTotal units  3.00\nTotal  -$1,234.56\nTax ID: 12-3456789\nTax  $84.56\nDate:\n2026-03-04\nNet 30\n")
    assert (got["total"]["value"], got["tax"]["value"], got["date"]["value"], got["due"]["value"], got["vendor"]["value"]) == ("-1234.56", "84.56", "2026-03-04", "2026-04-03", "Acme Ltd")
    assert "due" not in fields_of("Date: 2026-03-04\nNet  500.00\n") and fields_of("")["profile"]["value"] == "invoice"
    assert fields_of("$1.50 and 1.50 € and 2.00 €")["currency"]["value"] == "EUR"


def test_amounts_around_the_mark_that_parts_them():
    from paperloom.functions.money import find_amounts

    plain = "Total: $1,234.56 paid, -5.00 EUR left; 7.25"
    want = [(a["value"], a["currency"], a["start"]) for a in find_amounts(plain)]
    assert [v for v, _, _ in want] == ["1234.56", "-5.00", "7.25"]
    assert [(a["value"], a["currency"], a["start"] - 2) for a in find_amounts("\x01 " + plain)] == want


def test_bound_values_do_not_ask_for_types_by_row(spark):
    from pyspark.sql import functions as F

    from paperloom.functions.single import let

    plan = spark.range(3).select(let(F.col("id") + 1, lambda x: x * x).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at" in plan and ")[0]" not in plan


def test_dates_over_a_line_end():
    """The look for what could be a date missed a year in the next line."""
    assert [str(d["value"]) for d in find_dates("paid 24 December,\n2023")] == ["2023-12-24"]


def test_amounts_keep_their_places_beside_control_characters():
    got = [(a["value"], a["currency"], a["raw"], a["start"], a["end"]) for a in find_amounts("\x02 $007.50\x01USD 1 234,5\x02(€2.00)")]
    assert got == [("7.50", "USD", "$007.50", 2, 9), ("1234.5", "USD", "USD 1 234,5", 10, 21), ("-2.00", "EUR", "(€2.00)", 22, 29)]


def test_vendor_is_worked_out_once(spark):
    """Each part of it repeated the whole expression in the plan."""
    from paperloom.operators.fields import extract

    docs = spark.createDataFrame([("a.txt", " \t From: \"Ann\" <a@b.c>\nTotal $1.00"), ("b.txt", "12\nAcme Ltd\nDate: 2024-01-02")], "path string, content string")
    found = extract(docs).select("path", "fields.vendor.value", "fields.vendor.confidence")
    assert sorted(map(tuple, found.collect())) == [("a.txt", "Ann", "high"), ("b.txt", "Acme Ltd", "medium")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("good evening") == 2  # the first line and the others
