import pytest
from datasets import frame
from pyspark.sql import Row
from pyspark.sql import functions as F

from tablelore.operators import curation, metrics, relationships as rel, semantic
from tablelore.operators.metrics import Filter, MetricCatalog, MetricRefused, MetricRequest, plan_metric
from tablelore.plans.dataset import prepare, prepare_folder
from tablelore.sources.artifacts import write_curation
from tablelore.tables import list_columns
from tablelore.types import RELATIONSHIPS, VERDICTS


def edge(ordinal, key, confidence=90, cardinality="many-to-one", overlap=1.0, name=1.0):
    left, right = key.split("->")
    return (ordinal, *left.split("."), *right.split("."), confidence, cardinality, overlap, name, 1.0, 1.0)


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), RELATIONSHIPS)


def keys(df):
    return [r.key for r in rel.with_key(df).orderBy("ordinal").collect()]


# --- curation ----------------------------------------------------------------------


def test_verdicts_and_overrides(spark):
    base = edges(spark, edge(0, "p.u->u.id"), edge(1, "e.u->u.id"), edge(2, "t.u->u.id"))
    verdicts = spark.createDataFrame([("e.u->u.id", "rejected"), ("t.u->u.id", "accepted"), ("x.u->u.id", "rejected")], VERDICTS)
    overrides = edges(spark, edge(0, "o.u->u.id"), edge(1, "p.u->u.id", 100), edge(2, "x.u->u.id"), edge(3, "o.u->u.id", 70))
    once = curation.apply_verdicts(base, verdicts, overrides)
    assert keys(once) == ["p.u->u.id", "t.u->u.id", "o.u->u.id"]
    assert [r.confidence for r in once.orderBy("ordinal").collect()] == [100, 90, 70]
    twice = curation.apply_verdicts(once, verdicts, overrides)
    assert twice.orderBy("ordinal").collect() == once.orderBy("ordinal").collect()
    summary = curation.curation_summary(base, verdicts, overrides).first()
    assert tuple(summary) == (1, 2, 1)
    nothing = spark.createDataFrame([], VERDICTS)
    assert keys(curation.apply_verdicts(base, nothing, base.limit(0))) == keys(base)


def test_reasons_and_caveats(spark):
    base = edges(spark, edge(0, "p.u->u.id", 100), edge(1, "q.u->e.id", 60, "one-to-one", 0.955, 0.3))
    told = {r.key: r.reasons for r in curation.reasons(base).collect()}
    assert told["p.u->u.id"] == [
        "100% of distinct p.u values are present in u.id", "column name strongly matches the target",
        "exact type match", "many-to-one (target key is unique)",
    ]
    assert told["q.u->e.id"][0].startswith("96% of") and told["q.u->e.id"][1] == "weak name match"
    profile = spark.createDataFrame([(t,) for t in ("p", "u", "q", "e", "logs")], "table string")
    found = {(r.subject, r.caveat) for r in curation.caveats(base, profile).collect()}
    assert ("logs", "no inferred relationships") in found and len(found) == 3
    assert any("low-confidence (60%)" in text for _, text in found)
    assert any("possibly coincidental" in text for _, text in found)


# --- semantic model ----------------------------------------------------------------


def test_entity_names_and_synonyms(spark):
    names = ["users", "user", "order_items", "companies", "Users", "orderNotes"]
    rows = {r.table: r for r in semantic.name_entities(spark, names).collect()}
    assert rows["order_items"].entity == "OrderItem"
    assert rows["order_items"].synonyms == ["order_items", "order_item", "order items"]
    assert rows["companies"].entity == "Company"
    # "Users" comes first by name, then "user" and "users" fall back to longer names
    assert [rows[t].entity for t in ("Users", "user", "users")] == ["User", "User2", "Users"]
    assert len({r.entity for r in rows.values()}) == len(names)


def test_one_to_one_gives_has_one(spark):
    base = edges(spark, edge(0, "profiles.user_id->users.id", cardinality="one-to-one"), edge(1, "visits.user_id->users.id"))
    model = semantic.build_model(spark, ["users", "profiles", "visits"], base)
    user = model.entities.where("entity = 'User'").first()
    assert (user.has_one, user.has_many) == (["Profile"], ["Visit"])
    assert model.dimensions.count() == 0 and model.measures.count() == 0


def test_colliding_measures_are_qualified_on_every_side(spark):
    tables = {t: frame(spark, "id long, amount double", [(1, 10.0 * n), (2, 25.0 * n)]) for t, n in (("sales", 1), ("refunds", 3))}
    names = [r.name for r in prepare(spark, tables).model.measures.collect()]
    assert sorted(names) == ["refunds_count", "refunds_sum_amount", "sales_count", "sales_sum_amount"]


def test_dimension_rules(billing):
    dims = {(r.table, r.name): r for r in billing.model.dimensions.collect()}
    assert dims["cust_master", "is_active"]["values"] == ["true", "false"]
    assert (dims["inv", "issued_on"].kind, dims["inv", "issued_on"].grain) == ("time", "day")
    assert dims["inv", "status"]["values"] == ["open", "void", "paid"]
    assert ("cust_master", "nm") not in dims  # every value differs
    assert ("acct", "region_cd") not in dims  # a key


def test_fan_out_warning(shop):
    rows = {(r.table, r.measure, r.child) for r in semantic.fan_out_warnings(shop.model).collect()}
    assert ("orders", "orders_count", "OrderItem") in rows
    assert not any(table == "order_items" for table, _, _ in rows)


# --- metrics -----------------------------------------------------------------------


def test_refusals_start_no_job(spark, shop):
    catalog = MetricCatalog.of(shop.model)
    asked = {
        "unknown_metric": MetricRequest("total_revenue"),
        "unknown_dimension": MetricRequest("orders_count", ("colour",)),
        "unknown_filter_column": MetricRequest("orders_count", (), (Filter("colour", "=", 1),)),
        "unsupported_operator": MetricRequest("orders_count", (), (Filter("ordered_on", "~", 1),)),
        "fan_out": MetricRequest("customers_count", ("severity",)),
        "not_joinable": MetricRequest("sum_quantity", ("plan",)),
    }
    spark.sparkContext.setJobGroup("refusals", "refusals")
    for code, request in asked.items():
        with pytest.raises(MetricRefused) as refused:
            metrics.query_metric(shop.tables, catalog, request)
        assert refused.value.code == code
    spark.sparkContext.setJobGroup("", "")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("refusals")


def test_two_keys_into_one_table_are_ambiguous(spark):
    tables = {
        "regions": frame(spark, "id long, name string, tier string", [(i, f"R{i}", "ab"[i % 2]) for i in range(1, 7)]),
        "orders": frame(
            spark, "id long, billing_region_id long, shipping_region_id long, amount double",
            [(i, i % 5 + 1, (i * 2) % 6 + 1, 2.5 * i) for i in range(1, 9)],
        ),
    }
    dataset = prepare(spark, tables)
    assert {"orders.billing_region_id->regions.id", "orders.shipping_region_id->regions.id"} == set(keys(dataset.relationships))
    with pytest.raises(MetricRefused, match="more than one key .*billing_region_id.*shipping_region_id") as refused:
        dataset.metric("orders_count", ("tier",))
    assert refused.value.code == "ambiguous_join"


def test_names_on_several_tables(billing):
    # own table first; a name on two other tables has to be qualified
    plan = plan_metric(MetricCatalog.of(billing.model), MetricRequest("acct_count", ("is_active",)))
    assert plan.groups == [("acct", "is_active", "is_active")]
    with pytest.raises(MetricRefused) as refused:
        billing.metric("tkt_count", ("issued_on",))
    assert refused.value.code == "ambiguous_name"
    rows = billing.metric("tkt_count", ("cust_master.is_active",)).collect()
    assert sum(r.tkt_count for r in rows) == 12


def test_metric_values(spark, shop):
    items = [(i % 13 + 1, i % 4 + 1, i % 5 + 1) for i in range(1, 27)]
    assert shop.metric("sum_quantity").first()[0] == sum(q for _, _, q in items)
    assert shop.metric("order_items_count", (), (Filter("quantity", ">=", 4),)).first()[0] == sum(q >= 4 for _, _, q in items)
    by_plan = {r.plan: r.customers_count for r in shop.metric("customers_count", ("plan",)).collect()}
    assert by_plan == {"basic": 4, "max": 4, "plus": 4}
    shown = [tuple(r) for r in shop.metric("orders_count", ("plan",), (Filter("plan", "!=", "max"),)).collect()]
    want = {}
    for i in range(1, 15):
        customer = (i * 5) % 12 + 1 if i % 4 else 1
        plan = ("basic", "plus", "max")[customer % 3]
        want[plan] = want.get(plan, 0) + 1
    want.pop("max", None)
    assert shown == sorted(want.items())
    nothing = shop.metric("orders_count", (), (Filter("plan", "=", "o'brien"),)).first()[0]
    assert nothing == 0
    assert shop.metric("sum_quantity", (), (Filter("quantity", ">", 99),)).first()[0] is None


def test_hot_key_reaches_the_join_combined(spark):
    """A key that holds most rows is one row per task when it is shuffled."""
    orders = spark.range(30000).selectExpr("id", "case when id % 3 < 2 then 7 else id % 500 end as customer_id", "id % 10 as amount")
    customers = spark.range(500).selectExpr("id", "concat('s', id % 4) as segment")
    dataset = prepare(spark, {"orders": orders, "customers": customers})
    result = dataset.metric("sum_amount", ("segment",))
    want = {
        r.segment: r.n for r in orders.join(customers.withColumnRenamed("id", "c"), F.col("customer_id") == F.col("c"))
        .groupBy("segment").agg(F.sum("amount").alias("n")).collect()
    }
    assert {r.segment: r.sum_amount for r in result.collect()} == want
    plan = result._jdf.queryExecution().executedPlan().toString()
    below_join = plan[plan.index("Join"):]
    assert "partial_sum" in below_join


def test_join_loss(spark):
    tables = {
        "f": frame(spark, "k long", [(1,), (1,), (2,), (9,), (9,), (None,)]),
        "t": frame(spark, "id long", [(1,), (2,)]),
    }
    row = metrics.join_loss(tables, edges(spark, edge(0, "f.k->t.id")).collect()).first()
    assert row.rows_lost == 3


def agree(spark, dataset, metrics_, names, filters, max_hops):
    """Statuses of all requests, the same from the batch as one by one."""
    asked, want = [], {}
    for metric in metrics_:
        for name in names:
            for column, op, value in filters:
                request_id = f"{metric}/{name}/{column}{op}{value}"
                asked.append((request_id, metric, [name], [(column, op, value)]))
                try:
                    plan = plan_metric(dataset.catalog, MetricRequest(metric, (name,), (Filter(column, op, value),)), max_hops)
                    metrics.check_operands(dataset.tables, plan)
                    want[request_id] = ("ok", None)
                except MetricRefused as refused:
                    want[request_id] = (refused.code, refused.reason)
    frame_ = spark.createDataFrame(
        asked, "request_id string, metric string, dimensions array<string>, filters array<struct<column:string,op:string,value:string>>"
    )
    checked = metrics.validate_requests(spark, dataset.model, frame_, max_hops, list_columns(spark, dataset.tables))
    got = {r.request_id: (r.status, r.reason) for r in checked.collect()}
    assert got == want
    return {code for code, _ in want.values()}


@pytest.mark.parametrize("max_hops", [1, 2, 3])
def test_batch_validation_agrees_with_exceptions(spark, shop, max_hops):
    names = ["plan", "severity", "country", "signup_date", "customers.plan", "colour"]
    filters = [("plan", "=", "max"), ("quantity", "<", "many"), ("quantity", "<", "3"), ("ordered_on", "?", "x"), ("ordered_on", "<", "2024-02-30"), ("shade", "=", "x")]
    codes = agree(spark, shop, ("orders_count", "customers_count", "sum_quantity", "nope"), names, filters, max_hops)
    assert len(codes) >= 7


def test_batch_takes_requests_without_values(spark, shop):
    frame_ = spark.createDataFrame(
        [("a", "orders_count", ["plan"], [("quantity", "<")])], "request_id string, metric string, dimensions array<string>, filters array<struct<column:string,op:string>>"
    )
    assert metrics.validate_requests(spark, shop.model, frame_).first().status == "fan_out"


def chain(spark):
    """A measure whose table leads over two keys to one table, over two ways to another, and half-way down to a third."""
    n = lambda rows: [(i, *r) for i, r in enumerate(rows, 1)]
    return prepare(spark, {
        "areas": frame(spark, "id long, area_kind string", n([("land" if i % 3 else "sea",) for i in range(8)])),
        "towns": frame(spark, "id long, area_id long, town_size string", n([(i % 8 + 1, ("s", "m", None)[i % 3]) for i in range(12)])),
        "shops": frame(spark, "id long, town_id long, shop_style string", n([(i % 11 + 1 if i else None, ("old", "new", "odd")[i % 3]) for i in range(20)])),
        "makers": frame(spark, "id long, town_id long, maker_rank string", n([(i % 12 + 1, "xyz"[i % 3]) for i in range(16)])),
        "visits": frame(spark, "id long, shop_id long, visit_day string", n([(i % 17 + 1, f"d{i % 3}") for i in range(40)])),
        "sales": frame(spark, "id long, shop_id long, maker_id long, paid double", n([(i % 20 + 1 if i % 9 else None, i % 16 + 1, 1.5 * i) for i in range(1, 80)])),
    })


def test_joins_over_several_keys(spark):
    dataset = chain(spark)
    edges_ = set(keys(dataset.relationships))
    wanted = {"sales.shop_id->shops.id", "sales.maker_id->makers.id", "shops.town_id->towns.id", "makers.town_id->towns.id", "towns.area_id->areas.id", "visits.shop_id->shops.id"}
    assert edges_ == wanted
    for max_hops in (1, 2, 3):
        codes = agree(
            spark, dataset, ("sales_count", "sum_paid", "visits_count", "shops_count"), ("shop_style", "maker_rank", "town_size", "area_kind", "visit_day"),
            [("paid", ">", "1"), ("shop_style", "=", "old"), ("town_size", "=", "s")], max_hops,
        )
        assert {"ok", "fan_out"} <= codes and ("ambiguous_join" in codes) == (max_hops > 1)
    with pytest.raises(MetricRefused) as refused:  # by default one join
        dataset.metric("visits_count", ("town_size",))
    assert refused.value.code == "not_joinable"
    with pytest.raises(MetricRefused, match=r"sales.shop_id -> shops.town_id or sales.maker_id -> makers.town_id|sales.maker_id -> makers.town_id or sales.shop_id -> shops.town_id") as refused:
        dataset.metric("sum_paid", ("town_size",), max_hops=2)
    assert refused.value.code == "ambiguous_join"
    with pytest.raises(MetricRefused, match="one shops row can match many visits rows") as refused:
        dataset.metric("sum_paid", ("visit_day",), max_hops=2)
    assert refused.value.code == "fan_out"


def test_results_over_several_keys(spark):
    dataset = chain(spark)
    for name, df in dataset.tables.items():
        df.createOrReplaceTempView(f"chain_{name}")
    got = dataset.metric("visits_count", ("area_kind", "town_size", "visit_day"), (Filter("shop_style", "!=", "odd"),), max_hops=3)
    want = spark.sql("""
        SELECT area_kind, town_size, visit_day, count(*) AS visits_count FROM chain_visits v JOIN chain_shops s ON v.shop_id = s.id
        JOIN chain_towns t ON s.town_id = t.id JOIN chain_areas a ON t.area_id = a.id WHERE shop_style <> 'odd' GROUP BY ALL""")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 4
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()


def test_measures_of_several_grains(spark):
    dataset = chain(spark)
    for name, df in dataset.tables.items():
        df.createOrReplaceTempView(f"chain_{name}")
    got = dataset.metrics("sum_paid", "visits_count", "sales_count", "shops_count", dimensions=("shop_style",))
    assert got.columns == ["shop_style", "sum_paid", "visits_count", "sales_count", "shops_count"]
    want = spark.sql("""
        WITH f AS (SELECT shop_style, sum(paid) AS sum_paid, count(*) AS sales_count FROM chain_sales x JOIN chain_shops s ON x.shop_id = s.id GROUP BY 1),
        v AS (SELECT shop_style, count(*) AS visits_count FROM chain_visits x JOIN chain_shops s ON x.shop_id = s.id GROUP BY 1),
        n AS (SELECT shop_style, count(*) AS shops_count FROM chain_shops GROUP BY 1)
        SELECT shop_style, sum_paid, coalesce(visits_count, 0) visits_count, coalesce(sales_count, 0) sales_count, coalesce(shops_count, 0) shops_count
        FROM n FULL JOIN f USING (shop_style) FULL JOIN v USING (shop_style) ORDER BY 1""")
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    # a dimension that is null is one group, and a town without sales has none
    far = dataset.metrics("visits_count", "shops_count", dimensions=("town_size",), max_hops=2)
    counted = spark.sql("""
        SELECT town_size, count(v.id) AS visits_count, count(DISTINCT s.id) AS shops_count FROM chain_shops s JOIN chain_towns t ON s.town_id = t.id
        LEFT JOIN chain_visits v ON v.shop_id = s.id GROUP BY 1 ORDER BY 1 NULLS LAST""")
    assert [tuple(r) for r in far.collect()] == [tuple(r) for r in counted.collect()]
    assert [tuple(r) for r in dataset.metrics("sales_count", "visits_count").collect()] == [(79, 40)]


def test_several_measures_refused(spark):
    dataset = chain(spark)
    for names, dimensions, code in (
        (("sum_paid", "nope"), (), "unknown_metric"), (("visits_count", "shops_count"), ("visit_day",), "fan_out"), (("visits_count", "sales_count"), ("maker_rank",), "not_joinable"),
    ):
        with pytest.raises(MetricRefused) as refused:
            dataset.metrics(*names, dimensions=dimensions)
        assert refused.value.code == code
    with pytest.raises(ValueError):
        dataset.metrics("sum_paid", "sum_paid")
    catalog = MetricCatalog(
        [Row(table="a", name="a_count", agg="count", column=None), Row(table="b", name="b_count", agg="count", column=None)],
        [Row(table="a", name="x", column="x"), Row(table="b", name="x", column="x")], [],
    )
    with pytest.raises(MetricRefused, match="a.x.*b.x") as refused:
        metrics.plan_metrics(catalog, ["a_count", "b_count"], ["x"])
    assert refused.value.code == "not_conformed"


@pytest.mark.parametrize(
    "column, value, allowed",
    [
        ("country", 5, False), ("country", "NO", True), ("country", True, False), ("amount", "12.5", True), ("amount", "a lot", False),
        ("amount", 3, True), ("amount", True, False), ("day", "2024-02-30", False), ("day", "2024-02-29", True), ("day", 20240229, False),
        ("flag", "true", False), ("flag", True, True), ("tags", "x", False),
    ],
)
def test_operands_are_checked_before_any_job(spark, column, value, allowed):
    table = spark.createDataFrame([], "country string, amount double, day date, flag boolean, tags array<string>")
    plan = metrics.MetricPlan("t", "count", None, "t_count", filters=[("t", column, metrics.Filter(column, "=", value))])
    if allowed:
        metrics.check_operands({"t": table}, plan)
    else:
        with pytest.raises(metrics.MetricRefused) as refused:
            metrics.check_operands({"t": table}, plan)
        assert refused.value.code == "wrong_operand"


def test_overrides_must_lead_to_keys(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,b_id\n1,1\n2,1\n3,2\n")
    (tmp_path / "b.csv").write_text("id,code\n1,x\n2,x\n")
    made = prepare_folder(spark, str(tmp_path), str(tmp_path / "cache"))
    good = made.relationships.where("from_table = 'a'").selectExpr("*")
    bad = good.withColumn("to_column", F.lit("code"))
    with pytest.raises(ValueError, match="a.b_id->b.code"):
        prepare_folder(spark, str(tmp_path), str(tmp_path / "cache"), overrides=bad)
    write_curation(str(tmp_path / "cache"), verdicts=spark.createDataFrame([("a.b_id->b.id", "rejected")], "key string, verdict string"))
    assert prepare_folder(spark, str(tmp_path), str(tmp_path / "cache")).relationships.count() == good.count() - 1
    assert made.resolve("code").first()["word"] == "code"
