import collections
import datetime as dt
import random
from decimal import Decimal

import pytest

from tablelore.operators import sketches
from tablelore.operators.profile import profile_dataset, table_profiles
from tablelore.plans import upkeep


def by_column(profile):
    return {(r.table, r.column): r for r in profile.collect()}


def expected_top(values):
    counts = collections.Counter(v for v in values if v is not None)
    return sorted(counts.items(), key=lambda item: (-item[1], item[0].encode()))[:5]


def test_every_type(spark):
    rows = [
        (1, Decimal("1.50"), Decimal("12345678901234567890.5"), 1.5, 0.1, dt.date(2024, 2, 29),
         dt.datetime(2024, 1, 1, 12, 0, 0, 5), True, b"\x00\xff", [1, 2], "a"),
        (2, Decimal("1.50"), None, -0.0, 0.1, dt.date(1969, 12, 31), dt.datetime(1969, 12, 31, 23, 59, 59), False, b"\x00\xff", [1, 2], "b"),
        (2, Decimal("-0.25"), Decimal("-7"), 0.0, None, None, None, None, None, None, None),
        (None, None, Decimal("-7"), float("nan"), 0.25, dt.date(2024, 2, 29), dt.datetime(2024, 1, 1, 12, 0, 0, 5), True, b"", [], "a"),
    ]
    schema = (
        "i smallint, dec decimal(10,2), big decimal(30,1), d double, f float, day date, "
        "ts timestamp, flag boolean, raw binary, list array<int>, `odd ``name` string"
    )
    table = spark.createDataFrame(rows, schema)
    empty = spark.createDataFrame([], "x int, y string")
    found = by_column(profile_dataset(spark, {"t": table, "nothing": empty}))

    def facts(column):
        r = found["t", column]
        return r.row_count, r.null_count, r.distinct_count, r.min, r.max

    assert facts("i") == (4, 1, 2, "1", "2")
    assert found["t", "i"].avg == pytest.approx(5 / 3)
    assert found["t", "i"].null_percent == 25.0
    assert facts("dec") == (4, 1, 2, "-0.25", "1.50")
    assert found["t", "dec"].avg == pytest.approx(2.75 / 3)
    assert facts("big") == (4, 1, 2, "-7.0", "12345678901234567890.5")
    assert facts("d")[:3] == (4, 0, 3)
    assert facts("f") == (4, 1, 2, "0.1", "0.25")
    assert facts("day") == (4, 1, 2, "1969-12-31", "2024-02-29")
    assert facts("ts") == (4, 1, 2, "1969-12-31 23:59:59", "2024-01-01 12:00:00.000005")
    assert facts("flag") == (4, 1, 2, None, None)
    assert [tuple(v) for v in found["t", "flag"].top_values] == [("true", 2), ("false", 1)]
    assert facts("raw")[:3] == (4, 1, 2)
    assert [v.value for v in found["t", "raw"].top_values] == ["00FF", ""]
    assert facts("list")[:3] == (4, 1, 2)
    assert [tuple(v) for v in found["t", "odd `name"].top_values] == [("a", 2), ("b", 1)]
    assert (found["nothing", "x"].row_count, found["nothing", "x"].null_percent) == (0, 0.0)
    assert found["nothing", "y"].top_values == []
    assert {r.table: r.column_count for r in table_profiles(profile_dataset(spark, {"t": table})).collect()} == {"t": 11}


LONG = "<!DOCTYPE html><html><head><meta charset='utf-8'><title>a title that is long"


LONG_TEXTS = {
    "unique_same_start": [f"{LONG}{i:03}" for i in range(40)],
    "all_repeated": [f"{LONG}{i % 9}" for i in range(200)],
    "fewer_than_listed": [f"{LONG}{i}" for i in range(3)] + [None],
    "short_leader": [f"{LONG}{i}" for i in range(30)] + ["zz", "zz", "b"],
    "unique_short_first": ["zz"] * 4 + ["b", "c", "d", "e", "f"] + [f"{LONG}{i}" for i in range(9)],
    "long_too_rare": ["b", "c", "d", "e", "f", "g"] * 2 + [LONG + "x", LONG + "y"],
    "hot_value": [LONG + "hot"] * 300 + [f"{LONG}{i % 50}" for i in range(150)],
    "around_the_limit": ["é" * 32, "é" * 33, "é" * 33, "z" * 64, "z" * 65],
    "only_nulls": [None, None],
}


def test_top_values_of_long_text(spark):
    tables = {}
    for name, values in LONG_TEXTS.items():
        random.Random(7).shuffle(values)
        tables[name] = spark.createDataFrame([(v,) for v in values], "text string").repartition(3)
    for row in profile_dataset(spark, tables).collect():
        values = LONG_TEXTS[row.table]
        assert [tuple(v) for v in row.top_values] == expected_top(values), row.table
        assert row.distinct_count == len({v for v in values if v is not None}), row.table
        assert row.row_count == len(values)


def test_job_count_does_not_grow_with_columns(spark):
    def jobs(columns):
        table = spark.range(50).selectExpr(*[f"id % {i + 2} as c{i}" for i in range(columns)])
        group = f"profile-{columns}"
        spark.sparkContext.setJobGroup(group, group)
        profile_dataset(spark, {"t": table})
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(3) == jobs(40)


def test_text_is_shuffled_once_for_counts_and_leaders(spark):
    from tablelore.operators import profile
    from tablelore.tables import column_rows

    tables = {"t": spark.createDataFrame([("a", 1, 2.0), (None, 2, None)], "x string, n int, d double")}
    meta = [dict(r, cid=i, data_type=tables["t"].schema[i].dataType) for i, r in enumerate(column_rows(tables))]
    plan = profile._stats_and_top(tables, meta)._jdf.queryExecution()
    plan.executedPlan().execute().count()
    text = plan.executedPlan().toString()
    assert "ReusedExchange" in text and "Expand" not in text


def test_sketches_leave_no_key_out(spark, shop, billing, tmp_path):
    """The same keys as exact counts; estimates within their error; parts add up; what is stored is not read again."""
    many = spark.range(60_000).selectExpr("id as every", "id % 30000 as half", "id div 2 * 2 as pairs", "cast(id as string) as text", "if(id = 7, null, id) as gap", "array(id) as list", "if(id = 3, 4, id) as one_twice")
    for tables in (shop.tables, billing.tables, {"many": many, "none": many.limit(0)}):
        exact = {(r["table"], r["column"]): r for r in profile_dataset(spark, tables).collect()}
        found = {(r["table"], r["column"]): r for r in sketches.unique_columns(spark, tables).collect()}
        assert set(found) == set(exact)
        for key, r in found.items():
            e = exact[key]
            assert r["is_unique"] == (e["row_count"] > 0 and e["distinct_count"] == e["row_count"])
            assert (r["row_count"], r["null_count"]) == (e["row_count"], e["null_count"])
            assert abs(r["estimate"] - e["distinct_count"]) <= 5 * sketches.ERROR * e["distinct_count"] + 1
            assert r["distinct_count"] in (None, e["distinct_count"])
    assert {c for (t, c), r in found.items() if r["distinct_count"] is not None} == {"every", "text", "list", "one_twice"}
    parts = [sketches.column_sketches({"many": many.where(f"every % 3 = {k}")}) for k in range(3)]
    together = {r["column"]: r["estimate"] for r in sketches.estimated(sketches.merged(*parts)).collect()}
    assert together == {c: r["estimate"] for (t, c), r in found.items() if t == "many"}
    version, folder = {"many": "1", "none": "1n"}, str(tmp_path)
    first = upkeep.kept_sketches(spark, folder, {"many": many, "none": many.limit(0)}, version).collect()
    gone = spark.range(1).selectExpr(*(f"cast(raise_error('read again') as {t}) as {c}" for c, t in many.dtypes))
    again = upkeep.kept_sketches(spark, folder, {"many": gone, "none": gone}, version).collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == 14
