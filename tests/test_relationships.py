import random

from datasets import frame, shop_tables
from pyspark.sql import functions as F

from tablelore.operators import relationships as rel
from tablelore.operators.profile import profile_dataset
from tablelore.operators.semantic import build_model


def keys(edges):
    return {r.key: r.confidence for r in rel.with_key(edges).collect()}


def discover(spark, tables):
    profile = profile_dataset(spark, tables)
    return rel.discover_relationships(spark, tables, profile), profile


def test_smoke_set_has_exactly_two_edges(spark):
    tables = {
        "users": frame(spark, "id long, name string", [(i, f"n{i}") for i in range(1, 6)]),
        "events": frame(spark, "id long, user_id long, kind string", [(i, i % 5 + 1, "ab"[i % 2]) for i in range(1, 11)]),
        "payments": frame(spark, "id long, user_id long, amount double", [(i, (1, 3, 5)[i % 3], 9.5 * i) for i in range(1, 9)]),
    }
    edges, _ = discover(spark, tables)
    assert keys(edges) == {"payments.user_id->users.id": 100, "events.user_id->users.id": 100}
    assert {r.cardinality for r in edges.collect()} == {"many-to-one"}


def test_shop_edges(shop):
    assert keys(shop.relationships) == {
        "order_items.order_id->orders.id": 100,
        "order_items.product_id->products.id": 100,
        "orders.customer_id->customers.id": 100,
        "products.category_id->categories.id": 100,
        "support_tickets.customer_id->customers.id": 100,
        "orders.billing_region_id->regions.id": 93,
        "orders.shipping_region_id->regions.id": 93,
    }


def test_billing_edges(billing):
    assert keys(billing.relationships) == {
        "inv_line.sku->prod.sku": 100,
        "inv_line.inv_id->inv.id": 100,
        "inv.acct_id->acct.id": 100,
        "cust_master.plan_cd->plan_ref.plan_cd": 100,
        "acct.region_cd->region.region_cd": 100,
        "pay.inv_id->inv.id": 98,
        "inv_staging.acct_id->acct.id": 98,
        "tkt.cust_id->cust_master.id": 92,
        "acct.cust_id->cust_master.id": 92,
        "prod.cat_id->prod_cat.id": 92,
    }


def test_table_order_does_not_matter(spark, shop):
    names = list(shop.tables)
    random.Random(3).shuffle(names)
    turned, _ = discover(spark, {name: shop.tables[name] for name in names})
    assert turned.orderBy("ordinal").collect() == shop.relationships.orderBy("ordinal").collect()


def test_a_price_is_not_a_join_target(spark):
    tables = {
        "price_list": frame(spark, "id long, sku string, list_amt double", [(i, "ABCD"[i - 1], 5.0 * i) for i in range(1, 5)]),
        "sales": frame(spark, "id long, sku string, line_amt double", [(i, "ABCD"[i % 4], 5.0 * (i % 4 + 1)) for i in range(1, 7)]),
    }
    edges, profile = discover(spark, tables)
    assert set(keys(edges)) == {"sales.sku->price_list.sku"}
    model = build_model(spark, tables, edges, profile)
    assert {"sum_line_amt", "sum_list_amt"} <= {r.name for r in model.measures.collect()}


def test_overlap_against_brute_force(spark):
    rng = random.Random(11)

    def some(n, top):
        return [rng.choice([None, *range(top)]) for _ in range(n)]

    data = {
        "a": {"whole": some(80, 30), "text": [None if v is None else str(v) for v in some(80, 40)]},
        "b": {"whole": some(60, 50), "text": [None if v is None else str(v) for v in some(60, 20)]},
        "c": {"long": [f"{'x' * 70}{v}" for v in some(40, 9)], "none": [None] * 40},
    }
    tables = {
        "a": spark.createDataFrame(list(zip(*data["a"].values())), "whole long, text string"),
        "b": spark.createDataFrame(list(zip(*data["b"].values())), "whole int, text string"),
        "c": spark.createDataFrame(list(zip(*data["c"].values())), "long string, none long"),
    }
    columns = [(t, c) for t in data for c in data[t]]
    # more columns than one bit set word holds
    many = {f"m{i}": [rng.randrange(12) + i for _ in range(20)] for i in range(70)}
    data["wide"] = many
    tables["wide"] = spark.createDataFrame(list(zip(*many.values())), ", ".join(f"{m} long" for m in many))
    pairs = [(*f, *k) for f in columns for k in columns if f != k]
    pairs += [("wide", f"m{i}", "wide", f"m{(i * 7) % 70}") for i in range(1, 70)]

    def texts(end):
        return {str(v) for v in data[end[0]][end[1]] if v is not None}

    got = {r.seq: (r.distinct_from, r.matched) for r in rel.measure_overlap(spark, tables, pairs).collect()}
    for seq, pair in enumerate(pairs):
        f, k = texts(pair[:2]), texts(pair[2:])
        assert got.get(seq, (0, 0)) == (len(f), len(f & k)), pair


def test_pruning_changes_no_edge(spark, billing):
    pairs = rel.candidate_pairs(billing.profile)
    rows = rel.pair_rows(pairs)
    assert len(rel.pair_rows(rel.can_reach_floor(pairs))) < len(rows)
    overlap = rel.measure_overlap(spark, billing.tables, [tuple(r[c] for c in rel.EDGE) for r in rows])
    whole = rel.collapse_mirrored(rel.best_targets(rel.accepted(rel.score_pairs(spark, rows, overlap))))
    assert keys(whole) == keys(billing.relationships)


def test_no_pair_of_rows_is_formed(spark):
    tables = shop_tables(spark)
    plan = rel.measure_overlap(spark, tables, [("orders", "customer_id", "customers", "id")])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "SortMergeJoin" not in text


def test_nothing_to_discover(spark):
    table = spark.createDataFrame([("x",), ("x",)], "word string")
    edges, _ = discover(spark, {"only": table})
    assert edges.count() == 0


def test_mirrored_edges_collapse_to_the_stronger(spark):
    edges = spark.createDataFrame(
        [(0, 0, "a", "x", "b", "y", 80, "one-to-one", 1.0, 1.0, 1.0, 0.8),
         (1, 1, "b", "y", "a", "x", 90, "one-to-one", 1.0, 1.0, 1.0, 0.8),
         (2, 2, "c", "z", "a", "x", 90, "many-to-one", 1.0, 1.0, 1.0, 1.0)],
        "seq int, seen int, from_table string, from_column string, to_table string, to_column string, confidence int, "
        "cardinality string, value_overlap double, name_similarity double, type_match double, cardinality_shape double",
    )
    got = rel.with_key(rel.collapse_mirrored(edges)).orderBy("ordinal").select("key", "ordinal").collect()
    assert [tuple(r) for r in got] == [("b.y->a.x", 0), ("c.z->a.x", 1)]


def test_best_target_prefers_confidence_then_name(spark):
    edges = spark.createDataFrame(
        [(0, "f", "c", "k1", "id", 80, 0.5), (1, "f", "c", "k2", "id", 80, 0.9), (2, "f", "c", "k3", "id", 80, 0.9)],
        "seq int, from_table string, from_column string, to_table string, to_column string, confidence int, name_similarity double",
    )
    assert [r.to_table for r in rel.best_targets(edges).select(F.col("to_table")).collect()] == ["k2"]


def test_row_width_does_not_grow_with_the_schema():
    """Columns that are never compared share no group, so the numbers in a group stay small."""
    links = [((f"t{i}", "a", "whole"), (f"u{i}", "id", "whole")) for i in range(500)]
    links += [(("v", f"c{i}", "whole"), ("w", "id", "whole")) for i in range(3)]
    found = rel._numbered(links)
    assert len(found) == 1004 and max(number for _, number in found.values()) == 3
    assert all(found[a][0] == found[b][0] for a, b in links) and len({g for g, _ in found.values()}) == 501
