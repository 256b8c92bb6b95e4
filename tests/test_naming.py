import pytest
from pyspark.sql import functions as F

from tablelore.functions import naming, signals


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("word", "expected"),
    [("users", "user"), ("companies", "company"), ("addresses", "address"), ("ies", "ie"), ("ses", "se"),
     ("glass", "glass"), ("s", "s"), ("Boxes", "boxe"), ("order_items", "order_item"), ("", "")],
)
def test_singular(spark, word, expected):
    assert value(spark, naming.singular(F.lit(word))) == expected


@pytest.mark.parametrize(
    ("name", "expected"),
    [("user_id", ["user", "id"]), ("customerId", ["customer", "id"]), ("a--B  c9D", ["a", "b", "c9", "d"]),
     ("日本", []), ("HTTPServer", ["httpserver"])],
)
def test_tokens(spark, name, expected):
    assert value(spark, naming.tokens(F.lit(name))) == expected


@pytest.mark.parametrize(
    ("foreign", "key", "table", "expected"),
    [
        ("user_id", "id", "users", 1.0),
        ("customer_id", "customer_id", "subscriptions", 1.0),
        ("user", "id", "users", 0.9),
        ("id", "id", "payments", 0.5),
        ("user_id", "id", "events", 1 / 3),
        ("billing_region_id", "id", "regions", 0.7),
        ("cust_id", "id", "cust_master", 2 / 3),
        ("USER_ID", "Id", "Users", 1.0),
        ("sku", "sku", "prod", 1.0),
        ("amount", "price", "list", 0.0),
    ],
)
def test_name_similarity(spark, foreign, key, table, expected):
    got = value(spark, naming.name_similarity(F.lit(foreign), F.lit(key), F.lit(table)))
    assert got == pytest.approx(expected)


def test_similar_names_always_share_a_block(spark):
    names = ["id", "user_id", "userId", "user", "users", "User_Key", "sku", "日本", "region_cd", "Regions_id", "x"]
    df = spark.createDataFrame([(f, k, t) for f in names for k in names for t in names], "f string, k string, t string")
    similarity = naming.name_similarity(F.col("f"), F.col("k"), F.col("t"))
    meet = F.arrays_overlap(naming.name_blocks(F.col("f")), naming.target_blocks(F.col("k"), F.col("t")))
    assert df.where((similarity > 0) & ~meet).count() == 0


@pytest.mark.parametrize(("column", "expected"), [("id", True), ("A_ID", True), ("paid", False), ("_id", True), ("ids", False)])
def test_id_named(spark, column, expected):
    assert value(spark, naming.is_id_named(F.lit(column))) is expected


def test_confidence_rounds_half_up(spark):
    def score(*parts):
        return value(spark, signals.confidence(*[F.lit(float(p)) for p in parts]))

    assert score(1, 1, 1, 1) == 100
    assert score(1, 1, 1, 0.8) == 98
    assert score(1, 0.7, 1, 1) == 93
    assert score(1, 0.25, 1, 1) == 81
    assert 50 < score(1, 0.33, 1, 1) < 90


def test_type_match(spark):
    def score(a, b, ka, kb):
        return value(spark, signals.type_match(*[F.lit(x) for x in (a, b, ka, kb)]))

    assert score("bigint", "bigint", "numeric", "numeric") == 1.0
    assert score("int", "bigint", "numeric", "numeric") == 0.85
    assert score("string", "bigint", "text", "numeric") == 0.4
    assert score("date", "bigint", "date", "numeric") == 0.0
