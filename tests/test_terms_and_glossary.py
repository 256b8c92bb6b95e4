import json
import re

import numpy as np
import pytest
from datasets import BILLING_CASES, SHOP_CASES, billing_glossary

from tablelore.plans.dataset import prepare_folder
from tablelore.operators import glossary, scoring, terms
from tablelore.types import GLOSSARY


def catalog_of(spark, words):
    rows = [(i, w, "dimension", "E", "t", w, None, w) for i, w in enumerate(words)]
    return spark.createDataFrame(
        rows, "term_id long, term string, kind string, entity string, table string, column string, metric string, text string"
    )


def words(text):
    spaced = re.sub("([a-z0-9])([A-Z])", r"\1 \2", text)
    out = set()
    for w in re.split("[^a-zA-Z0-9]+", spaced):
        w = w.lower()
        if not w:
            continue
        if w.endswith("ies") and len(w) > 3:
            w = w[:-3] + "y"
        elif w.endswith("ses") and len(w) > 3:
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss") and len(w) > 1:
            w = w[:-1]
        out.add(w)
    return out


def lexical(query, term):
    if query.strip().lower() == term.strip().lower():
        return 1.0
    q, t = words(query), words(term)
    return len(q & t) / len(q | t) if q and t else 0.0


TERMS = ["User", "users", "customer", "plan", "sum_amount", "users_count", "order items", "Order", "net revenue", "日本"]
ASKED = ["customers", " PLAN ", "sum amount", "zzz", "order item count", "日本", "", "users orders plans"]


def test_lexical_scores(spark):
    queries = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, query string")
    got = {(r.query_id, r.term_id): r.score for r in terms.lexical_scores(queries, catalog_of(spark, TERMS)).collect()}
    want = {(i, j): lexical(q, t) for i, q in enumerate(ASKED) for j, t in enumerate(TERMS)}
    assert got == pytest.approx({pair: score for pair, score in want.items() if score > 0})


def fused(ranks_of, k, rrf_k=60):
    scores = {}
    for scored in ranks_of:
        hits = sorted((j for j, s in enumerate(scored) if s > 0), key=lambda j: (-scored[j], j))
        for place, j in enumerate(hits, 1):
            scores[j] = scores.get(j, 0.0) + 1 / (rrf_k + place)
    return sorted(scores.items(), key=lambda item: (-item[1], item[0]))[:k]


@pytest.mark.parametrize("block", [10**9, 24])
def test_fusion_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(terms, "GRID_VALUES", block)  # the small block splits the catalog and the queries
    rng = np.random.default_rng(5)
    names = [f"term {i % 7} of {i % 5}" for i in range(60)]
    vectors = rng.normal(size=(60, 6))
    vectors[3] = 0
    asked = [f"term {i % 9}" if i % 3 else "nothing here" for i in range(12)]
    wanted = rng.normal(size=(12, 6))
    base = catalog_of(spark, names)
    held = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "term_id long, vector array<double>")
    queries = spark.createDataFrame(
        [(i, q, v.tolist()) for i, (q, v) in enumerate(zip(asked, wanted))], "query_id long, query string, vector array<double>"
    )
    found = terms.resolve_terms(queries, base.join(held, "term_id"), k=5, vectors=True).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.position)):
        got.setdefault(r.query_id, []).append((r.term_id, round(r.score, 12)))
    for i, query in enumerate(asked):
        cosines = []
        for v in vectors:
            norm = np.sqrt((v * v).sum()) * np.sqrt((wanted[i] * wanted[i]).sum())
            cosines.append(0.0 if norm == 0 else float(v @ wanted[i]) / norm)
        want = fused([[lexical(query, n) for n in names], np.round(cosines, 12)], 5)
        assert [s for _, s in got.get(i, [])] == pytest.approx([s for _, s in want])


def test_fusion_of_hashing_vectors_against_brute_force(spark):
    names = [f"{a} {b} {i}" for i, (a, b) in enumerate((a, b) for a in ("net", "gross", "open") for b in ("revenue", "orders", "plan", "users"))]
    asked = ["net revenue", "open order 11", "users of the plan", "nothing here", ""]
    catalog = terms.hashing_vectors(catalog_of(spark, names), "text")
    queries = terms.hashing_vectors(spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"), "query")
    vectors = {r.term_id: np.array(r.vector) for r in catalog.collect()}
    wanted = {r.query_id: np.array(r.vector) for r in queries.collect()}
    got = {}
    for r in sorted(terms.resolve_terms(queries, catalog, k=5, vectors=True).collect(), key=lambda r: (r.query_id, r.position)):
        got.setdefault(r.query_id, []).append((r.term_id, r.score))
    assert got
    for i, query in enumerate(asked):
        norms = [np.linalg.norm(vectors[j]) * np.linalg.norm(wanted[i]) for j in range(len(names))]
        cosines = [float(vectors[j] @ wanted[i]) / n if n else 0.0 for j, n in enumerate(norms)]
        want = fused([[lexical(query, n) for n in names], np.round(cosines, 12)], 5)
        assert [j for j, _ in got.get(i, [])] == [j for j, _ in want]
        assert [s for _, s in got.get(i, [])] == pytest.approx([s for _, s in want])


def letters_of(counter):
    def embed(texts):
        counter.add(len(texts))
        return np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], dtype="float32").reshape(len(texts), 26)

    return embed


def test_vectors_are_kept_by_content(spark, tmp_path):
    counter = spark.sparkContext.accumulator(0)
    embed, folder = letters_of(counter), str(tmp_path / "cache")
    texts = lambda *t: spark.createDataFrame([(i, x, "v") for i, x in enumerate(t)], "id long, text string, key string")
    first = terms.kept_vectors(texts("net revenue", "plan", "plan", None, ""), "text", embed, folder).collect()
    assert counter.value == 3 and {r["text"]: r["vector"] is None for r in first} == {"net revenue": False, "plan": False, None: True, "": False}
    again = terms.kept_vectors(texts("plan", "users", "net revenue"), "text", embed, folder).collect()
    assert counter.value == 4 and len(again) == 3 and all(r["vector"] == [float(r["text"].count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for r in again)
    terms.kept_vectors(texts("plan"), "text", embed, folder, "another model").collect()
    assert counter.value == 5
    assert terms.kept_vectors(texts().limit(0), "text", embed, str(tmp_path / "none")).collect() == []


def test_datasets_resolve_by_kept_vectors(spark, tmp_path):
    data, cache = tmp_path / "data", str(tmp_path / "cache")
    data.mkdir()
    (data / "users.csv").write_text("id,plan\n1,a\n2,b\n3,a\n4,b\n")
    (data / "pays.csv").write_text("id,user_id,amount\n1,1,2.5\n2,1,3.5\n3,4,1.0\n")
    counter = spark.sparkContext.accumulator(0)
    plain = prepare_folder(spark, str(data), cache)
    assert plain.resolve("naplps").count() == 0  # no word of it is known
    dataset = prepare_folder(spark, str(data), cache, embedder=letters_of(counter))
    assert dataset.resolve("naplps").count() == 5  # by its letters
    once = counter.value
    assert once > 3
    prepare_folder(spark, str(data), cache, embedder=letters_of(counter)).resolve("naplps", "new words").collect()
    assert counter.value == once + 1


def test_semantic_hit_through_vectors(spark):
    base = catalog_of(spark, ["users", "sum_amount", "plan"])
    held = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "term_id long, vector array<double>")
    queries = spark.createDataFrame([(0, "revenue", [1.0, 0.0])], "query_id long, query string, vector array<double>")
    assert terms.resolve_terms(queries, base.join(held, "term_id"), vectors=True).first().term == "sum_amount"
    assert terms.resolve_terms(queries, base).count() == 0


def test_nearest_vectors(spark):
    rng = np.random.default_rng(1)
    items, asked = rng.normal(size=(200, 4)), rng.normal(size=(9, 4))
    found = terms.nearest_vectors(
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, vector array<double>"),
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "item_id long, vector array<double>").repartition(4),
        3,
        block_values=12,
    ).collect()
    norm = (items @ asked.T) / np.outer(np.linalg.norm(items, axis=1), np.linalg.norm(asked, axis=1))
    for i in range(9):
        got = [r.item_id for r in sorted((r for r in found if r.query_id == i), key=lambda r: r.rank)]
        assert got == np.argsort(-norm[:, i])[:3].tolist()


def test_any_embedder(spark):
    frame = terms.embed(spark.createDataFrame([("ab",), ("c",)], "text string"), "text", lambda batch: np.array([[len(t), 1] for t in batch]))
    assert sorted(r.vector for r in frame.collect()) == [[1.0, 1.0], [2.0, 1.0]]


# --- glossary ----------------------------------------------------------------------


def parsed(spark, *payloads):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "payload_id long, payload string")
    return glossary.parse_glossary(spark, rows).orderBy("payload_id", "position").collect()


def test_parse(spark):
    body = [
        {"term": " MRR ", "definition": " d ", "mapsTo": {"table": "users", "column": "plan"}},
        {"nope": 1}, "bad", 7, None, {"term": 5}, {"term": "  "},
        {"term": "t", "definition": 3, "synonyms": ["a", 1, "b", None], "mapsTo": {"table": 4, "column": "x"}, "confidence": "0.9", "source": 1},
        {"term": "u", "synonyms": "x", "mapsTo": {"table": "t", "column": 2}, "confidence": 1, "source": "s.md"},
        {"term": "v", "mapsTo": "users", "confidence": 0.25},
    ]
    text = json.dumps(body)
    for payload in (text, f"```json\n{text}\n```", f"  ```\n{text}```  "):
        rows = parsed(spark, payload)
        assert [tuple(r)[2:] for r in rows] == [
            ("MRR", "d", [], "users", "plan", 0.5, None),
            ("t", "", ["a", "b"], None, None, 0.5, None),
            ("u", "", [], "t", None, 1.0, "s.md"),
            ("v", "", [], None, None, 0.25, None),
        ]
    assert parsed(spark, "sorry, no JSON here", '{"term": "x"}', "null", "", "[]", None) == []


def entry(i, term, definition, synonyms, table, column=None, confidence=0.9, accepted=True):
    return (i, term, definition, synonyms, table, column, confidence, "test", accepted)


def test_merge(spark, shop):
    offered = spark.createDataFrame(
        [
            entry(0, "tier", "", ["tier", "plan", " ", "level"], "customers", "plan"),
            entry(1, "tier again", "The plan.", ["level", "grade"], "customers", "plan"),
            entry(2, "third", "Never used.", [], "customers", "plan"),
            entry(3, "account", "A buyer.", ["member", "customers", "Customer"], "customers"),
            entry(4, "size", "Units.", ["units"], "order_items", "quantity"),
            entry(5, "ghost", "x", ["x"], "nope"),
            entry(6, "ghost column", "x", ["x"], "customers", "nope"),
            entry(7, "weak", "x", ["x"], "customers", None, 0.2),
            entry(8, "proposal", "x", ["x"], "orders", None, 0.9, False),
        ],
        GLOSSARY,
    )
    merged = glossary.merge_glossary(shop.model, offered)
    plan = merged.dimensions.where("table = 'customers' and name = 'plan'").first()
    assert (plan.description, plan.synonyms) == ("The plan.", ["tier", "level", "grade"])
    customer = merged.entities.where("entity = 'Customer'").first()
    assert (customer.description, customer.synonyms) == ("A buyer.", ["customers", "customer", "member"])
    units = merged.measures.where("column = 'quantity'").first()
    assert (units.description, units.synonyms) == ("Units.", ["units"])
    assert merged.entities.where("entity = 'Order'").first().description is None
    log = {(r.ordinal, r.target, r.field): r.value for r in glossary.applied_changes(shop.model, offered).collect()}
    assert log == {
        (1, "customers.plan", "description"): "The plan.",
        (0, "customers.plan", "synonyms"): "tier, level",
        (1, "customers.plan", "synonyms"): "grade",
        (3, "Customer", "description"): "A buyer.",
        (3, "Customer", "synonyms"): "member",
        (4, "order_items.quantity", "description"): "Units.",
        (4, "order_items.quantity", "synonyms"): "units",
    }
    again = glossary.merge_glossary(merged, offered)
    assert again.dimensions.orderBy("table", "ordinal").collect() == merged.dimensions.orderBy("table", "ordinal").collect()
    assert glossary.applied_changes(merged, offered).count() == 0


# --- suites ------------------------------------------------------------------------


def test_shop_suite_passes_whole(spark, shop):
    results = scoring.run_suite(spark, shop.model, SHOP_CASES)
    assert [(r.id, r.detail) for r in results.where("outcome <> 'pass'").collect()] == []
    assert tuple(scoring.tally(results).first()) == (18, 18, 0, 0, 1.0)


def test_billing_suite_needs_the_glossary_for_its_terms(spark, billing):
    bare = scoring.run_suite(spark, billing.model, BILLING_CASES)
    failed = {r.id for r in bare.where("outcome <> 'pass'").collect()}
    assert failed == {c["id"] for c in BILLING_CASES if c["kind"] == "term"}
    model = glossary.merge_glossary(billing.model, billing_glossary(spark))
    full = scoring.run_suite(spark, model, BILLING_CASES)
    assert [(r.id, r.detail) for r in full.where("outcome <> 'pass'").collect()] == []
    assert full.count() == 25


def test_unknown_case_kind_fails(spark, shop):
    row = scoring.run_suite(spark, shop.model, [{"id": "x", "kind": "riddle"}]).first()
    assert (row.outcome, row.detail) == ("fail", 'unknown case kind "riddle"')
