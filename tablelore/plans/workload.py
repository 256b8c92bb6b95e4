"""The registered queries: every operator over the whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import naming
from ..functions.redact import redact
from ..functions.vectors import cosine
from ..operators import compare, curation, glossary as gloss, metrics, relationships as rel
from ..operators import scoring, semantic, sketches, terms
from ..operators.profile import profile_dataset, table_profiles, top_value_rows
from ..session import shared_dir, write_once
from ..sources.artifacts import (
    export_csv, export_json, fingerprint, read_artifacts, read_curation, write_artifacts, write_curation,
)
from ..sources.files import load_documents, load_folder, read_file, register
from ..tables import count_rows, list_columns, sample_rows, small_table
from ..types import GLOSSARY, RELATIONSHIPS, VERDICTS
from .dataset import Dataset, keep, prepare
from . import upkeep
from .readonly import run_sql
from .star import raw_table, raw_tables, star_tables, transfers

_KEPT: dict[tuple, object] = {}


def _kept(spark: SparkSession, sf_dir: str, what: str, build: Callable[[], object]):
    """Derived once per session: many operators below start from the same catalog."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key]


def forget() -> None:
    _KEPT.clear()


def star(spark: SparkSession, sf_dir: str) -> Dataset:
    return _kept(spark, sf_dir, "star", lambda: prepare(spark, star_tables(spark, sf_dir)))


def profiled_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The raw tables and a copy of orders with nulls and a boolean."""
    tables = raw_tables(spark, sf_dir)
    tables["orders_nulls"] = tables["orders"].select(
        "o_orderkey",
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("o_orderpriority"),
        (F.col("o_orderstatus") == "O").alias("is_open"),
    )
    return tables


def raw_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(
        spark, sf_dir, "raw profile", lambda: profile_dataset(spark, profiled_tables(spark, sf_dir))
    )


def _raw_only(profile: DataFrame) -> DataFrame:
    return profile.where(F.col("table") != "orders_nulls")


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        profile = _raw_only(raw_profile(spark, sf_dir))
        return rel.discover_relationships(spark, raw_tables(spark, sf_dir), profile)

    return _kept(spark, sf_dir, "raw edges", build)


def _named(df: DataFrame, *more) -> DataFrame:
    return df.select(F.col("table").alias("table_name"), F.col("column").alias("column_name"), *more)


# --- sources ---------------------------------------------------------------------


def s1_folder(spark, sf_dir):
    loaded = load_folder(spark, sf_dir)
    return count_rows(loaded.tables).withColumnRenamed("table", "table_name")


def _round_trip(kind: str, mixed: bool = False):
    def query(spark, sf_dir):
        def build():
            path = f"{shared_dir(spark)}/formats-{spark.sparkContext.applicationId}/{abs(hash(sf_dir))}/{'mixed_' * mixed}orders.{kind}"
            orders = raw_table(spark, sf_dir, "orders").select(
                "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
            )
            writer = orders.write.mode("overwrite")
            if kind in ("csv", "tsv"):
                writer.option("header", True).option("sep", {"tsv": "\t", "csv": ";"}[kind]).csv(path)
            elif mixed:
                # a record a line at first, then records over several lines
                row = F.struct(*orders.columns)
                text = F.when(F.col("o_orderkey") < 200, F.to_json(row)).otherwise(F.to_json(row, {"pretty": "true"}))
                orders.sortWithinPartitions("o_orderkey").select(text).write.mode("overwrite").text(path)
            else:
                writer.json(path)
            return path

        path = _kept(spark, sf_dir, f"format {kind} {mixed}", build)
        return read_file(spark, path).groupBy("o_orderstatus").agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("o_custkey").cast("bigint").alias("keys"),
            F.round(F.sum("o_totalprice"), 2).alias("total"),
            F.sum("o_orderkey").cast("bigint").alias("order_keys"),
            F.date_format(F.min(F.to_timestamp("o_orderdate")), "yyyy-MM-dd HH:mm:ss").alias("first"),
            F.date_format(F.max(F.to_timestamp("o_orderdate")), "yyyy-MM-dd HH:mm:ss").alias("last"),
            F.concat_ws("|", F.sort_array(F.collect_set("o_orderpriority"))).alias("priorities"),
        )

    return query


def s2_parquet(spark, sf_dir):
    return load_folder(spark, sf_dir).tables["lineitem"].groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_orderkey").alias("keys")
    )


def s5_listing(spark, sf_dir):
    tables = raw_tables(spark, sf_dir)
    columns = list_columns(spark, tables)
    return columns.join(count_rows(tables), "table").select(
        F.col("table").alias("table_name"), F.col("column").alias("column_name"),
        "ordinal", "kind", "row_count",
    )


def s6_sample(spark, sf_dir):
    orders = raw_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return sample_rows(orders, 50, ["o_orderkey"])


def s7_upkeep(spark, sf_dir):
    """Edges after every second event is gone, from what was stored of the other tables before."""

    def build():
        folder = f"{shared_dir(spark)}/upkeep-{uuid.uuid4().hex}"
        tables = zoned_tables(spark, sf_dir)
        upkeep.kept_relationships(spark, folder, tables, {t: t for t in tables}, upkeep.kept_profile(spark, folder, tables, {t: t for t in tables})[0])
        tables = tables | {"events": tables["events"].where("id % 2 = 0")}
        version = {t: t for t in tables} | {"events": "half of the events"}
        profile, changed = upkeep.kept_profile(spark, folder, tables, version)
        return changed, profile, upkeep.kept_relationships(spark, folder, tables, version, profile)

    changed, profile, edges = _kept(spark, sf_dir, "upkeep", build)
    rows = profile.groupBy("table").agg(F.max("row_count").alias("from_rows")).withColumnRenamed("table", "from_table")
    read_again = F.col("from_table").isin(*changed)
    return edges.join(rows, "from_table").select(*rel.EDGE, "confidence", "cardinality", "ordinal", "from_rows", read_again.alias("read_again"))


def p2_prefilter(spark, sf_dir):
    """Which columns are unique, counted exactly only where a sketch leaves it open."""
    found = sketches.unique_columns(spark, profiled_tables(spark, sf_dir))
    return found.select(F.col("table").alias("table_name"), F.col("column").alias("column_name"), "row_count", "null_count", "is_unique")


def s7_artifacts(spark, sf_dir):
    def build():
        dataset = star(spark, sf_dir)
        folder = f"{shared_dir(spark)}/artifacts-{spark.sparkContext.applicationId}"
        source = f"star{abs(hash(sf_dir))}"
        write_artifacts(folder, source, dataset.profile, dataset.model)
        return folder, source

    folder, source = _kept(spark, sf_dir, "artifacts", build)
    _, model = read_artifacts(spark, folder, source)
    return model.measures.select(F.col("table").alias("table_name"), "name", "agg")


def s7_curated(spark, sf_dir):
    """Verdicts and overrides stored beside the inferred edges, and applied when both are read."""

    def build():
        folder = f"{shared_dir(spark)}/curated-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
        raw_edges(spark, sf_dir).write.mode("overwrite").parquet(f"{folder}/inferred")
        write_curation(folder, verdicts=raw_verdicts(spark), overrides=raw_overrides(spark))
        return folder

    folder = _kept(spark, sf_dir, "curation", build)
    said = read_curation(spark, folder)
    edges = curation.apply_verdicts(spark.read.parquet(f"{folder}/inferred"), said["verdicts"], said["overrides"])
    return _edges(edges, "confidence", "cardinality", "ordinal")


def s7_stale(spark, sf_dir):
    """A file added below a table's folder makes what was stored for it stale."""
    folder = f"{shared_dir(spark)}/stale-{uuid.uuid4().hex}"
    orders = raw_table(spark, sf_dir, "orders")
    marks = []
    for _ in range(2):
        orders.write.mode("append").partitionBy("o_orderstatus").parquet(f"{folder}/orders.parquet")
        loaded = load_folder(spark, folder)
        marks.append(fingerprint(loaded.files, loaded.fingerprints))
    return loaded.tables["orders"].agg(F.count(F.lit(1)).alias("n")).select(F.lit(marks[0] != marks[1]).alias("changed"), "n")


def _export_frame(spark, sf_dir):
    return raw_table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit(' "'), "c_name", F.lit('", '), "c_mktsegment", F.lit("  ")).alias("quoted"),
        F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment"),
        "c_acctbal",
    )


def s8_csv(spark, sf_dir):
    def build():
        path = f"{shared_dir(spark)}/export-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}-csv"
        export_csv(_export_frame(spark, sf_dir), path)
        return path

    path = _kept(spark, sf_dir, "csv export", build)
    lines = spark.read.option("lineSep", "\r\n").text(path)
    # a header leads every file; it is checked once
    return lines.where(~F.col("value").startswith("c_custkey,")).unionByName(
        lines.where(F.col("value").startswith("c_custkey,")).distinct()
    ).withColumnRenamed("value", "line")


def s8_json(spark, sf_dir):
    def build():
        path = f"{shared_dir(spark)}/export-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}-json"
        export_json(_export_frame(spark, sf_dir), path)
        return path

    path = _kept(spark, sf_dir, "json export", build)
    return spark.read.schema("c_custkey bigint, quoted string, segment string, c_acctbal double").json(path)


def s9_documents(spark, sf_dir):
    """Whole documents of two extensions: how many items and characters came in, and whose."""

    def build():
        path = f"{shared_dir(spark)}/intake-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
        items = raw_table(spark, sf_dir, "benchmark").select("text")
        items.write.mode("overwrite").text(f"{path}/plain")
        items.write.mode("overwrite").json(f"{path}/records")
        files = spark.read.text([f"{path}/plain", f"{path}/records"]).select(F.input_file_name().alias("path")).distinct()
        return [row.path for row in files.collect()]

    paths = _kept(spark, sf_dir, "intake", build)
    lines = load_documents(spark, paths).select(
        F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("extension"), "text", F.explode(F.split("text", "\n")).alias("line")
    )
    return lines.where("line <> ''").groupBy("extension").agg(
        F.count(F.lit(1)).alias("items"), F.sum(F.length("line")).alias("characters"), F.max(F.md5("line")).alias("largest_digest")
    )


def s11_redact(spark, sf_dir):
    documents = raw_table(spark, sf_dir, "documents")
    text = F.concat(
        "text", F.lit(" see postgres://app:"), "source", F.lit("@db/"), "lang",
        F.lit(" and PWD = 'a "), "source", F.lit("' password="), "lang",
    )
    clean = redact(text)
    return documents.select(
        "doc_id", F.md5(clean).alias("digest"), F.length(clean).alias("characters")
    )


# --- profiling -------------------------------------------------------------------


def p1_nulls(spark, sf_dir):
    return _named(raw_profile(spark, sf_dir), "row_count", "null_count", F.round("null_percent", 6).alias("null_percent"))


def p2_distinct(spark, sf_dir):
    return _named(raw_profile(spark, sf_dir), "distinct_count")


def p3_numeric(spark, sf_dir):
    return _named(
        raw_profile(spark, sf_dir).where("kind = 'numeric'"),
        F.col("min").cast("double").alias("min_value"),
        F.col("max").cast("double").alias("max_value"),
        F.col("avg").cast("float").cast("double").alias("avg_value"),
    )


def p4_temporal(spark, sf_dir):
    return _named(
        raw_profile(spark, sf_dir).where("kind = 'date'"),
        F.col("min").alias("min_value"), F.col("max").alias("max_value"),
    )


def p5_top(spark, sf_dir):
    profile = raw_profile(spark, sf_dir).where("kind in ('text', 'boolean')")
    rows = top_value_rows(profile)
    return _named(rows, "rank", "value", F.col("count").alias("value_count"))


def p6_kinds(spark, sf_dir):
    return _named(raw_profile(spark, sf_dir), "kind")


def p7_dataset(spark, sf_dir):
    profile = profile_dataset(spark, raw_tables(spark, sf_dir))
    return _named(
        profile, "kind", "row_count", "null_count", "distinct_count",
        F.col("avg").cast("float").cast("double").alias("avg_value"),
        F.when(F.col("kind") == "text", F.element_at("top_values.count", 1)).otherwise(0).alias("top_count"),
    )


def p7_tables(spark, sf_dir):
    return table_profiles(raw_profile(spark, sf_dir)).withColumnRenamed("table", "table_name")


# --- relationships ---------------------------------------------------------------


def r1_keys(spark, sf_dir):
    return _named(rel.key_flags(raw_profile(spark, sf_dir)), "is_unique", "is_key")


def _edges(df: DataFrame, *more) -> DataFrame:
    return df.select(*rel.EDGE, *more)


def star_pairs(spark, sf_dir):
    return rel.candidate_pairs(star(spark, sf_dir).profile)


def star_scored(spark, sf_dir):
    """Every candidate of the star views with its signals, nothing pruned."""

    def build():
        dataset = star(spark, sf_dir)
        rows = rel.pair_rows(star_pairs(spark, sf_dir))
        overlap = rel.measure_overlap(
            spark, dataset.tables, [tuple(row[c] for c in rel.EDGE) for row in rows]
        )
        return write_once(rel.score_pairs(spark, rows, overlap), "scored")

    return _kept(spark, sf_dir, "scored", build)


def raw_scored(spark, sf_dir):
    def build():
        rows = rel.pair_rows(rel.candidate_pairs(_raw_only(raw_profile(spark, sf_dir))))
        overlap = rel.measure_overlap(
            spark, raw_tables(spark, sf_dir), [tuple(row[c] for c in rel.EDGE) for row in rows]
        )
        return write_once(rel.score_pairs(spark, rows, overlap), "scored")

    return _kept(spark, sf_dir, "raw scored", build)


def r2_candidates(spark, sf_dir):
    return _edges(star_pairs(spark, sf_dir))


def r3_names(spark, sf_dir):
    return _edges(star_pairs(spark, sf_dir), F.round("name_similarity", 6).alias("name_similarity"))


def r4_singular(spark, sf_dir):
    words = raw_table(spark, sf_dir, "documents").select(
        F.explode(naming.tokens(F.col("text"))).alias("word")
    )
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    return counts.groupBy(naming.singular(F.col("word")).alias("singular")).agg(
        F.count(F.lit(1)).alias("words"), F.sum("uses").alias("uses")
    )


def r5_id_names(spark, sf_dir):
    profile = star(spark, sf_dir).profile
    return _named(profile, naming.is_id_named(F.col("column")).alias("id_named"), "distinct_count")


def r6_types(spark, sf_dir):
    return _edges(rel.candidate_pairs(_raw_only(raw_profile(spark, sf_dir))), "type_match")


def r7_overlap(spark, sf_dir):
    return _edges(
        star_scored(spark, sf_dir), "distinct_from", "matched",
        F.round("value_overlap", 6).alias("value_overlap"),
    )


def r7_text_numbers(spark, sf_dir):
    """Overlap where keys are numbers on one side and text on the other."""
    tables = {
        "orders": raw_table(spark, sf_dir, "orders"),
        "customer": raw_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("code")),
        "documents": raw_table(spark, sf_dir, "documents"),
        "events": raw_table(spark, sf_dir, "events"),
    }
    pairs = [
        ("orders", "o_custkey", "customer", "code"),
        ("customer", "code", "orders", "o_orderkey"),
        ("events", "value", "events", "user_id"),
        ("documents", "n_chars", "orders", "o_orderkey"),
        ("documents", "text", "documents", "text"),
        ("events", "ts", "orders", "o_orderdate"),
    ]
    asked = small_table(
        spark,
        [{"seq": i, "pair": f"{a}.{b}->{c}.{d}"} for i, (a, b, c, d) in enumerate(pairs)],
        "seq int, pair string",
    )
    return asked.join(rel.measure_overlap(spark, tables, pairs), "seq").select(
        "pair", "distinct_from", "matched"
    )


def r8_shape(spark, sf_dir):
    return _edges(raw_scored(spark, sf_dir), "cardinality", "cardinality_shape")


def r9_confidence(spark, sf_dir):
    return _edges(star_scored(spark, sf_dir), "confidence")


def r10_best(spark, sf_dir):
    return _edges(rel.best_targets(rel.accepted(star_scored(spark, sf_dir))), "confidence")


def r11_mirrored(spark, sf_dir):
    both = rel.best_targets(rel.accepted(raw_scored(spark, sf_dir)))
    flipped = both.select(
        (F.col("seq") + 1000).alias("seq"), (F.col("seen") + 1000).alias("seen"),
        F.col("to_table").alias("from_table"), F.col("to_column").alias("from_column"),
        F.col("from_table").alias("to_table"), F.col("from_column").alias("to_column"),
        (F.col("confidence") + F.when(F.col("name_similarity") < 0.5, 5).otherwise(-5)).cast("int").alias("confidence"),
        "cardinality", "value_overlap", "name_similarity", "type_match", "cardinality_shape",
    )
    names = flipped.columns
    return _edges(rel.collapse_mirrored(both.select(*names).unionByName(flipped)), "confidence", "ordinal")


def _edge_rows(edges: DataFrame) -> DataFrame:
    return _edges(
        edges, "ordinal", "confidence", "cardinality",
        F.round("value_overlap", 6).alias("value_overlap"),
        F.round("name_similarity", 6).alias("name_similarity"), "type_match", "cardinality_shape",
    )


def r12_star(spark, sf_dir):
    tables = star_tables(spark, sf_dir)
    return _edge_rows(rel.discover_relationships(spark, tables, profile_dataset(spark, tables)))


def r12_raw(spark, sf_dir):
    return _edge_rows(raw_edges(spark, sf_dir))


def r13_identity(spark, sf_dir):
    return rel.with_key(star(spark, sf_dir).relationships).select("key", "confidence")


# --- curation --------------------------------------------------------------------

# What a person knows about the raw tables: three inferred edges are chance matches,
# and the order schema's keys have names that inference cannot read.
PHANTOMS = (
    "events.user_id->documents.doc_id",
    "conversations.conv_id->documents.doc_id",
    "embeddings.label->labels.doc_id",
)
KNOWN_KEYS = (
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
)


def raw_verdicts(spark: SparkSession) -> DataFrame:
    return small_table(spark, [{"key": k, "verdict": "rejected"} for k in PHANTOMS], VERDICTS)


def raw_overrides(spark: SparkSession) -> DataFrame:
    rows = [
        {"ordinal": i, "confidence": 100, "cardinality": "many-to-one", "value_overlap": 1.0,
         "name_similarity": 1.0, "type_match": 1.0, "cardinality_shape": 1.0}
        | dict(zip(rel.EDGE, edge))
        for i, edge in enumerate(KNOWN_KEYS)
    ]
    return small_table(spark, rows, RELATIONSHIPS)


def v1_reject(spark, sf_dir):
    return _edges(curation.reject_edges(raw_edges(spark, sf_dir), raw_verdicts(spark)), "confidence")


def _curated(spark, sf_dir):
    return curation.apply_verdicts(raw_edges(spark, sf_dir), raw_verdicts(spark), raw_overrides(spark))


def v2_upsert(spark, sf_dir):
    return _edges(_curated(spark, sf_dir), "confidence", "cardinality", "ordinal")


def v3_summary(spark, sf_dir):
    return curation.curation_summary(raw_edges(spark, sf_dir), raw_verdicts(spark), raw_overrides(spark))


def x1_reasons(spark, sf_dir):
    return curation.reasons(raw_edges(spark, sf_dir)).select("key", F.array_join("reasons", " | ").alias("reasons"))


def x2_caveats(spark, sf_dir):
    return curation.caveats(raw_edges(spark, sf_dir), _raw_only(raw_profile(spark, sf_dir)))


# --- semantic model --------------------------------------------------------------


def _joined(name: str):
    return F.array_join(name, ", ").alias(name)


def m1_entities(spark, sf_dir):
    return star(spark, sf_dir).model.entities.select(F.col("table").alias("table_name"), "entity", "ordinal")


def m2_synonyms(spark, sf_dir):
    return star(spark, sf_dir).model.entities.select("entity", _joined("synonyms"))


def m3_keys(spark, sf_dir):
    dataset = star(spark, sf_dir)
    return _named(semantic.key_columns(dataset.profile, dataset.relationships))


def _raw_model(spark, sf_dir) -> semantic.SemanticModel:
    def build():
        profile = raw_profile(spark, sf_dir)
        edges = write_once(_curated(spark, sf_dir), "curated")
        return keep(semantic.build_model(spark, list(profiled_tables(spark, sf_dir)), edges, profile))

    return _kept(spark, sf_dir, "raw model", build)


def m4_dimensions(spark, sf_dir):
    dimensions = _raw_model(spark, sf_dir).dimensions
    return _named(dimensions, "kind", "grain", F.array_join("values", "|").alias("listed"))


def m5_measures(spark, sf_dir):
    model = _raw_model(spark, sf_dir)
    return model.measures.select(
        F.col("table").alias("table_name"), "agg", F.col("column").alias("column_name"), "grain"
    )


def m6_names(spark, sf_dir):
    return star(spark, sf_dir).model.measures.select(F.col("table").alias("table_name"), "name")


def m7_associations(spark, sf_dir):
    entities = star(spark, sf_dir).model.entities
    return entities.select("entity", _joined("belongs_to"), _joined("has_many"), _joined("has_one"))


def m8_model(spark, sf_dir):
    model = star(spark, sf_dir).model
    dims = model.dimensions.groupBy("entity").agg(
        F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("dimensions")
    )
    sums = model.measures.groupBy("entity").agg(
        F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("measures")
    )
    return (
        model.entities.select("entity", F.col("table").alias("table_name"), _joined("belongs_to"))
        .join(dims, "entity", "left").join(sums, "entity", "left")
    )


def m9_fan_out(spark, sf_dir):
    rows = semantic.fan_out_warnings(star(spark, sf_dir).model)
    return rows.select(F.col("table").alias("table_name"), "measure", "child")


# --- metrics ---------------------------------------------------------------------


def _metric(name: str, dimensions: tuple[str, ...] = (), filters: tuple = (), total: bool = True):
    """A metric query; totals of doubles are shown to the cent."""

    def query(spark, sf_dir):
        out = star(spark, sf_dir).metric(name, dimensions, filters)
        return out.withColumn(name, F.round(name, 2)) if total else out

    return query


def requests(spark: SparkSession) -> DataFrame:
    asked = [
        ("ok-own", "orders_count", ["orderstatus"], []),
        ("ok-parent", "sum_totalprice", ["mktsegment"], []),
        ("ok-filter", "sum_quantity", ["returnflag"], [("orderstatus", "=")]),
        ("unknown-metric", "total_revenue", ["orderstatus"], []),
        ("unknown-dimension", "orders_count", ["colour"], []),
        ("unknown-filter", "orders_count", [], [("colour", "=")]),
        ("operator", "orders_count", ["orderstatus"], [("orderpriority", "~")]),
        ("fan-out", "customers_count", ["orderstatus"], []),
        ("fan-out-filter", "orders_count", ["orderstatus"], [("returnflag", "=")]),
        ("two-hops", "sum_quantity", ["mktsegment"], []),
        ("siblings", "events_count", ["orderstatus"], []),
        ("first-problem", "customers_count", ["colour", "orderstatus"], [("shade", "=")]),
    ]
    rows = [
        {"request_id": i, "metric": m, "dimensions": d, "filters": [{"column": c, "op": o} for c, o in f]}
        for i, m, d, f in asked
    ]
    return small_table(
        spark, rows,
        "request_id string, metric string, dimensions array<string>, "
        "filters array<struct<column:string,op:string>>",
    )


def q7_to_q10(*ids: str):
    def query(spark, sf_dir):
        wanted = requests(spark).where(F.col("request_id").isin(*ids))
        return metrics.validate_requests(spark, star(spark, sf_dir).model, wanted)

    return query


def q9_ambiguous(spark, sf_dir):
    def build():
        tables = {
            "customers": star_tables(spark, sf_dir)["customers"],
            "transfers": transfers(spark, sf_dir),
        }
        return prepare(spark, tables)

    dataset = _kept(spark, sf_dir, "transfers", build)
    asked = small_table(
        spark,
        [{"request_id": "two-keys", "metric": "transfers_count", "dimensions": ["mktsegment"], "filters": []},
         {"request_id": "own", "metric": "sum_amount", "dimensions": [], "filters": []}],
        "request_id string, metric string, dimensions array<string>, "
        "filters array<struct<column:string,op:string>>",
    )
    return metrics.validate_requests(spark, dataset.model, asked)


#: Tables two keys apart, nations being reached over customers and over suppliers: view -> (source, {column: view column}).
ZONED = {
    "customers": ("customer", {"c_custkey": "id", "c_nationkey": "nation_id", "c_mktsegment": "mktsegment"}),
    "events": ("events", {"event_id": "id", "user_id": "customer_id"}),
    "lineitems": ("lineitem", {"l_orderkey": "order_id", "l_suppkey": "supplier_id", "l_quantity": "quantity"}),
    "nations": ("nation", {"n_nationkey": "id", "zone": "zone"}),
    "orders": ("orders", {"o_orderkey": "id", "o_custkey": "customer_id", "o_orderstatus": "orderstatus"}),
    "suppliers": ("supplier", {"s_suppkey": "id", "s_nationkey": "nation_id"}),
}


def zoned_tables(spark, sf_dir):
    tables = {}
    for view, (source, names) in ZONED.items():
        raw = raw_table(spark, sf_dir, source)
        raw = raw.withColumn("zone", F.concat(F.lit("Z"), "n_regionkey")) if view == "nations" else raw
        tables[view] = raw.select(*(F.col(old).alias(new) for old, new in names.items()))
    return tables


def zoned(spark, sf_dir):
    return _kept(spark, sf_dir, "zoned", lambda: prepare(spark, zoned_tables(spark, sf_dir)))


def hop_requests(spark: SparkSession) -> DataFrame:
    """Tables one and two keys away, two ways to one table, and a way down half-way."""
    asked = [
        ("one-hop", "orders_count", "mktsegment"), ("two-hops", "sum_quantity", "mktsegment"), ("zone", "events_count", "zone"),
        ("two-ways", "sum_quantity", "zone"), ("half-way-down", "events_count", "orderstatus"), ("down", "customers_count", "orderstatus"),
    ]
    rows = [{"request_id": i, "metric": m, "dimensions": [d], "filters": []} for i, m, d in asked]
    return small_table(
        spark, rows, "request_id string, metric string, dimensions array<string>, filters array<struct<column:string,op:string>>"
    )


def q10_hops(max_hops: int):
    def query(spark, sf_dir):
        return metrics.validate_requests(spark, zoned(spark, sf_dir).model, hop_requests(spark), max_hops)

    return query


def q10_two_hops(spark, sf_dir):
    """Line items by a column of the customers that their orders belong to."""
    out = star(spark, sf_dir).metric("sum_quantity", ("mktsegment", "returnflag"), (metrics.Filter("orderstatus", "=", "F"),), max_hops=2)
    return out.withColumn("sum_quantity", F.round("sum_quantity", 2))


OPERANDS = (
    ("number", "orders_count", "totalprice", " 12.5 "), ("no-number", "orders_count", "totalprice", "a lot"), ("exponent", "sum_quantity", "quantity", "1e3"),
    ("day", "orders_count", "orderdate", "1996-02-29"), ("no-day", "orders_count", "orderdate", "1997-02-29"), ("no-time", "orders_count", "orderdate", "yesterday"),
    ("text", "orders_count", "orderstatus", "5"), ("parent", "orders_count", "customers.acctbal", "rich"), ("none", "orders_count", "orderstatus", None),
)


def q7_operand(spark, sf_dir):
    """Filters whose operand is not of the column's kind."""
    dataset = star(spark, sf_dir)
    rows = [{"request_id": i, "metric": m, "dimensions": [], "filters": [{"column": c, "op": ">=", "value": v}]} for i, m, c, v in OPERANDS]
    asked = small_table(
        spark, rows, "request_id string, metric string, dimensions array<string>, filters array<struct<column:string,op:string,value:string>>"
    )
    return metrics.validate_requests(spark, dataset.model, asked, columns=list_columns(spark, dataset.tables))


def l12_drill_across(spark, sf_dir):
    """Three facts of each market segment, each added up at its own grain."""
    out = star(spark, sf_dir).metrics("sum_totalprice", "orders_count", "events_count", "sum_quantity", dimensions=("mktsegment",), max_hops=2)
    return out.withColumns({name: F.round(name, 2) for name in ("sum_totalprice", "sum_quantity")})


LOSS_EDGES = (
    ("embeddings", "label", "labels", "doc_id"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("orders", "o_orderkey", "lineitem", "l_orderkey"),
    ("customer", "c_custkey", "events", "user_id"),
    ("documents", "doc_id", "labels", "doc_id"),
)


def q11_loss(spark, sf_dir):
    edges = [Row(**dict(zip(rel.EDGE, edge))) for edge in LOSS_EDGES]
    return metrics.join_loss(raw_tables(spark, sf_dir), edges)


# --- terms -----------------------------------------------------------------------


def star_terms(spark, sf_dir) -> DataFrame:
    return _kept(
        spark, sf_dir, "terms",
        lambda: write_once(terms.term_catalog(star(spark, sf_dir).model), "terms"),
    )


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def phrases(spark, sf_dir) -> DataFrame:
    """Search phrases found in the data: one per distinct label-like value."""
    sources = (
        ("part", "p_type"), ("customer", "c_mktsegment"), ("events", "event_type"),
        ("orders", "o_orderpriority"), ("conversations", "role"), ("region", "r_name"),
        ("part", "p_name"),
    )
    found = None
    for table, column in sources:
        one = raw_table(spark, sf_dir, table).select(
            F.concat_ws(" ", F.lit(f"{table} {column[2:] if column[1] == '_' else column}"), column).alias("query")
        ).distinct()
        found = one if found is None else found.unionByName(one)
    return found.withColumn("query_id", F.xxhash64("query"))


def t1_catalog(spark, sf_dir):
    return star_terms(spark, sf_dir).select("term_id", "term", "kind", "entity", "text")


def t2_targets(spark, sf_dir):
    return star_terms(spark, sf_dir).select("term_id", terms.target_label().alias("target"))


def _scored_phrases(spark, sf_dir):
    asked = phrases(spark, sf_dir)
    return terms.lexical_scores(asked, star_terms(spark, sf_dir)).join(asked, "query_id")


def t3_lexical(spark, sf_dir):
    return _scored_phrases(spark, sf_dir).select("query", "term_id", F.round("score", 6).alias("score"))


def centroids(spark, sf_dir) -> DataFrame:
    """The mean vector of every label."""
    vectors = raw_table(spark, sf_dir, "embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    return means.groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("vector")
    )


def t4_cosine(spark, sf_dir):
    vectors = raw_table(spark, sf_dir, "embeddings")
    return vectors.join(centroids(spark, sf_dir), "label").select(
        "vec_id", F.round(cosine(F.col("embedding"), F.col("vector")), 6).alias("score")
    )


def t5_ranks(spark, sf_dir):
    ranked = terms.rank_hits(terms.lexical_scores(phrases(spark, sf_dir), star_terms(spark, sf_dir)))
    return ranked.join(phrases(spark, sf_dir), "query_id").select("query", "term_id", "rank")


def _letters(text: str) -> Column:
    """How often each letter occurs: vectors that any engine can make."""
    low = F.lower(F.col(text))
    return F.array(*((F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("float") for c in LETTERS))


def t6_fusion(spark, sf_dir):
    asked = phrases(spark, sf_dir).withColumn("vector", _letters("query"))
    catalog = star_terms(spark, sf_dir).withColumn("vector", _letters("term"))
    found = terms.resolve_terms(asked, catalog, vectors=True)
    return found.join(asked.select("query_id", "query"), "query_id").select("query", "position", "term_id", F.round("score", 9).alias("score"))


def t7_nearest(spark, sf_dir):
    items = raw_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")
    )
    asked = centroids(spark, sf_dir).select(F.col("label").cast("bigint").alias("query_id"), "vector")
    found = terms.nearest_vectors(asked, items, 5)
    return found.select("query_id", "item_id", "rank", F.round("score", 6).alias("score"))


def t8_pages(spark, sf_dir):
    """Which schema terms each whole web page mentions, best five."""
    asked = raw_table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("query_id"), F.concat_ws(" ", "url", "html").alias("query")
    )
    catalog = _kept(
        spark, sf_dir, "raw terms",
        lambda: write_once(terms.term_catalog(_raw_model(spark, sf_dir)), "terms"),
    )
    found = terms.resolve_terms(asked, catalog)
    return found.select("query_id", "position", "term_id", F.round("score", 9).alias("score"))


def t8_phrases(spark, sf_dir):
    found = terms.resolve_terms(phrases(spark, sf_dir), star_terms(spark, sf_dir))
    return found.join(phrases(spark, sf_dir), "query_id").select(
        "query", "position", "target", F.round("score", 9).alias("score")
    )


def t9_vectors(spark, sf_dir):
    catalog = terms.hashing_vectors(star_terms(spark, sf_dir), "text")
    # every word is counted in one of the vector's places
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return catalog.select("term_id", "term", F.size("vector").alias("width"), total.cast("int").alias("words"))


# --- glossary --------------------------------------------------------------------

# A business glossary over the star views; the last entries must change nothing.
ENTRIES = (
    ("revenue", "Order value billed.", ["revenue", "billings", "order value"], "orders", "totalprice", 0.95, True),
    ("client", "A company that orders.", ["client", "customer", "account"], "customers", None, 0.9, True),
    ("segment", "The market a customer is in.", ["segment", "mktsegment", " ", "industry"], "customers", "mktsegment", 0.9, True),
    ("industry", "A second definition.", ["industry", "sector"], "customers", "mktsegment", 0.8, True),
    ("shipment line", "One part on one order.", ["line item", "shipment line"], "lineitems", None, 0.9, True),
    ("balance", "Money on account.", ["balance"], "customers", "acctbal", 0.5, True),
    ("weak", "Too uncertain.", ["weak"], "orders", None, 0.2, True),
    ("ghost", "No such table.", ["ghost"], "invoices", None, 0.9, True),
    ("missing", "No such column.", ["missing"], "orders", "colour", 0.9, True),
    ("unmapped", "Maps to nothing.", ["unmapped"], None, None, 0.9, True),
    ("proposal", "Not accepted yet.", ["proposal"], "parts", "brand", 0.9, False),
)


def entries(spark: SparkSession) -> DataFrame:
    names = ("term", "definition", "synonyms", "map_table", "map_column", "confidence", "accepted")
    rows = [{"ordinal": i, "source": "terms.md"} | dict(zip(names, e)) for i, e in enumerate(ENTRIES)]
    return small_table(spark, rows, GLOSSARY)


def g1_parse(spark, sf_dir):
    """One JSON payload per part: fenced or not, with members left out."""
    parts = raw_table(spark, sf_dir, "part")
    body = F.to_json(
        F.array(
            F.struct(
                F.concat(F.lit(" "), "p_name").alias("term"),
                F.col("p_type").alias("definition"),
                F.array("p_brand", "p_type").alias("synonyms"),
                F.struct(
                    F.expr("nullif(p_type, 'PROMO')").alias("table"), F.col("p_brand").alias("column")
                ).alias("mapsTo"),
                F.expr("nullif(p_size, 7) / 100.0d").alias("confidence"),
            ),
            F.struct(
                F.expr("nullif('x', 'x')").alias("term"), F.lit("no term").alias("definition"),
                F.array(F.lit("a"), F.lit("b")).alias("synonyms"),
                F.struct(F.lit("t").alias("table"), F.lit("c").alias("column")).alias("mapsTo"),
                F.lit(0.5).alias("confidence"),
            ),
        )
    )
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    payload = (
        F.when(F.col("p_size") % 2 == 0, fenced)
        .when(F.col("p_type") == "SMALL", F.concat(F.lit("no json here: "), body))
        .otherwise(body)
    )
    found = gloss.parse_glossary(
        spark, parts.select(F.col("p_partkey").alias("payload_id"), payload.alias("payload"))
    )
    return found.select(
        "payload_id", "term", "definition", F.array_join("synonyms", ",").alias("synonyms"),
        "map_table", "map_column", "confidence",
    )


def g2_grounded(spark, sf_dir):
    found = gloss.ground(star(spark, sf_dir).model, entries(spark))
    return found.select("term", "kind", "target")


def _glossed(spark, sf_dir) -> semantic.SemanticModel:
    return _kept(
        spark, sf_dir, "glossed",
        lambda: keep(gloss.merge_glossary(star(spark, sf_dir).model, entries(spark))),
    )


def _annotations(spark, sf_dir, *columns):
    model = _glossed(spark, sf_dir)
    out = model.entities.select(F.col("entity").alias("name"), *columns)
    for frame in (model.dimensions, model.measures):
        out = out.unionByName(frame.select(F.concat_ws(".", "table", "name").alias("name"), *columns))
    return out


def g3_descriptions(spark, sf_dir):
    return _annotations(spark, sf_dir, "description")


def g4_synonyms(spark, sf_dir):
    return _annotations(spark, sf_dir, _joined("synonyms"))


def g5_applied(spark, sf_dir):
    found = gloss.applied_changes(star(spark, sf_dir).model, entries(spark))
    return found.select("ordinal", "target", "field", "value")


def g_resolve(spark, sf_dir):
    """Business words reach opaque names only through the glossary."""
    asked = small_table(
        spark,
        [{"query_id": i, "query": q} for i, q in enumerate(("billings", "industry", "client", "balance"))],
        "query_id bigint, query string",
    )
    found = terms.resolve_terms(asked, terms.term_catalog(_glossed(spark, sf_dir)), 1)
    return found.join(asked, "query_id").select("query", "target")


# --- the relational shapes of the corpus ------------------------------------------


def _money(price: str = "l_extendedprice", discount: str = "l_discount"):
    """Exact cents: sums do not depend on the order rows are added in."""
    return F.col(price).cast("decimal(12,2)") * (1 - F.col(discount).cast("decimal(4,2)"))


RUN_SQL = """
select o_orderpriority, count(*) as orders, count(distinct o_custkey) as customers
from orders where o_orderstatus <> 'P' group by o_orderpriority
"""


def l0_run_sql(spark, sf_dir):
    register(raw_tables(spark, sf_dir))
    return run_sql(spark, RUN_SQL)


def l1_count(spark, sf_dir):
    return raw_table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"))


def l2_group_count(spark, sf_dir):
    return raw_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def l3_sum_product(spark, sf_dir):
    lines = raw_table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("quantity")
    )
    parts = raw_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    value = F.col("quantity") * F.col("p_retailprice").cast("decimal(12,2)")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).agg(
        F.round(F.sum(value).cast("double"), 2).alias("revenue")
    )


def l4_chain(spark, sf_dir):
    """Revenue by nation: lines are summed per order before any join."""
    lines = raw_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(_money()).alias("revenue"))
    orders = raw_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = raw_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = raw_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    by_customer = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .groupBy("o_custkey").agg(F.sum("revenue").alias("revenue"))
    )
    by_nation = (
        by_customer.join(customers, by_customer.o_custkey == customers.c_custkey)
        .groupBy("c_nationkey").agg(F.sum("revenue").alias("revenue"))
    )
    return by_nation.join(nations, by_nation.c_nationkey == nations.n_nationkey).groupBy("n_name").agg(
        F.round(F.sum("revenue").cast("double"), 2).alias("revenue")
    )


def l5_distinct(spark, sf_dir):
    orders = raw_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = raw_table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct()
    return (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_semi")
        .agg(F.countDistinct("o_custkey").alias("n"))
        .withColumn("what", F.lit("with returns"))
        .unionByName(orders.agg(F.countDistinct("o_custkey").alias("n")).withColumn("what", F.lit("all")))
    )


def l6_not_exists(spark, sf_dir):
    orders = raw_table(spark, sf_dir, "orders")
    lines = raw_table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_anti").agg(
        F.count(F.lit(1)).alias("n")
    )


def l7_exists(spark, sf_dir):
    customers = raw_table(spark, sf_dir, "customer")
    events = raw_table(spark, sf_dir, "events").select("user_id").distinct()
    return (
        customers.join(events, customers.c_custkey == events.user_id, "left_semi")
        .groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    )


def _by_role(key: str):
    def query(spark, sf_dir):
        moves = transfers(spark, sf_dir).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        customers = raw_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
        return moves.join(customers, moves.key == customers.c_custkey).groupBy("c_mktsegment").agg(
            F.sum("n").alias("n")
        )

    return query


def l9_natural_key(spark, sf_dir):
    """Parts reach a price list by brand, a text key that is not an id; both are combined per brand first."""
    parts = raw_table(spark, sf_dir, "part")
    prices = parts.groupBy("p_brand").agg(F.max("p_retailprice").alias("top_price"))
    return parts.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).join(prices, "p_brand")


def l10_top(spark, sf_dir):
    lines = raw_table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(_money()).alias("revenue"))
    parts = raw_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    by_name = lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy("p_name").agg(
        F.sum("revenue").alias("revenue")
    )
    return (
        by_name.orderBy(F.col("revenue").desc(), "p_name").limit(1)
        .select("p_name", F.round(F.col("revenue").cast("double"), 2).alias("revenue"))
    )


def l10_top_plain(spark, sf_dir):
    events = raw_table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return events.orderBy(F.col("n").desc()).limit(1).select("n")


def l11_filtered(spark, sf_dir):
    orders = raw_table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return orders.groupBy("o_orderpriority").agg(
        F.round(F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double"), 2).alias("total")
    )


def _two_children(spark, sf_dir):
    orders = raw_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.sum(F.col("o_totalprice").cast("decimal(14,2)")).alias("revenue"),
        F.count(F.lit(1)).alias("orders"),
    )
    events = raw_table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
    return orders, events


def l12_two_grains(spark, sf_dir):
    """Orders and events of each customer, each at its own grain."""
    orders, events = _two_children(spark, sf_dir)
    customers = raw_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return (
        customers.join(events, customers.c_custkey == events.user_id)
        .join(orders, customers.c_custkey == orders.o_custkey, "left")
        .select(
            "c_name",
            F.coalesce(F.round(F.col("revenue").cast("double"), 2), F.lit(0.0)).alias("revenue"),
            "events",
        )
    )


def l13_inflation(spark, sf_dir):
    """How much a naive double join overstates revenue, without running that join.

    Joining both children repeats each order once per event, so the naive sum is the
    sum of revenue times events per customer.
    """
    orders, events = _two_children(spark, sf_dir)
    both = orders.join(events, orders.o_custkey == events.user_id)
    naive = F.sum(F.col("revenue") * F.col("events")).cast("double")
    right = F.sum("revenue").cast("double")
    return both.agg(
        F.round(naive, 2).alias("naive"), F.round(right, 2).alias("correct"),
        F.round(naive / right, 6).alias("ratio"),
    )


def l14_left_distinct(spark, sf_dir):
    orders = raw_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("f")).distinct()
    keys = raw_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("k")).distinct()
    return orders.join(keys, F.col("f") == F.col("k"), "left").agg(
        F.count(F.lit(1)).alias("distinct_from"), F.count("k").alias("matched")
    )


# --- comparison and scoring --------------------------------------------------------


def _changed_orders(spark, sf_dir):
    """Orders under other column names and order, some values different."""
    orders = raw_table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderstatus").alias("a"),
        (F.col("o_totalprice") * (1 + F.lit(1e-13))
         + F.when(F.col("o_orderpriority") == "1-URGENT", 0.5).otherwise(0)).alias("b"),
        F.col("o_orderkey").cast("string").alias("c"),
    )


def e1_equal(spark, sf_dir):
    """Results that are equal but for names and types, and results that differ in just one way."""
    raw = raw_table(spark, sf_dir, "orders")
    orders = raw.select("o_orderkey", "o_orderstatus", "o_totalprice")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    key = F.col("o_orderkey") * 1_000_000_000
    power = F.pow(F.lit(10.0), F.pmod("o_orderkey", F.lit(8)))
    tests = {
        "renamed": (orders, raw.select(F.col("o_totalprice").alias("x"), F.col("o_orderstatus").alias("y"), F.col("o_orderkey").cast("string").alias("z"))),
        "changed": (orders, _changed_orders(spark, sf_dir)),
        "long keys": (raw.select(key.alias("k")), raw.select((key + urgent.cast("int")).alias("k"))),
        "below powers of ten": (raw.select("o_orderkey", power.alias("v")), raw.select("o_orderkey", (power * (1 - 2e-16)).alias("v"))),
        "swapped in a row": (
            raw.select("o_orderkey", "o_custkey"),
            raw.select(
                F.when(urgent, F.col("o_custkey")).otherwise(F.col("o_orderkey")).alias("a"),
                F.when(urgent, F.col("o_orderkey")).otherwise(F.col("o_custkey")).alias("b"),
            ),
        ),
    }
    found = [compare.compare_rows(*pair).select(F.lit(test).alias("test"), "equal") for test, pair in tests.items()]
    return reduce(DataFrame.unionByName, found)


def e1_differences(spark, sf_dir):
    orders = raw_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    found = compare.differences(orders, _changed_orders(spark, sf_dir))
    return found.agg(
        F.count(F.when(F.col("expected") > F.col("actual"), 1)).alias("missing"),
        F.count(F.when(F.col("actual") > F.col("expected"), 1)).alias("extra"),
    )


def e1_matching(spark, sf_dir):
    """Two close values an order against two others: pairs that no naming after the nearest would find."""
    orders = raw_table(spark, sf_dir, "orders").where("o_totalprice > 0").select(F.lit(0.0).alias("c"), "o_orderkey", F.col("o_totalprice").alias("v"))
    near = lambda *shifts: orders.withColumn("v", F.explode(F.array(*(F.col("v") * (1 + F.lit(s)) for s in shifts))))
    tests = {
        "paired crosswise": (near(0.0, 1.5e-9), near(0.8e-9, 0.8e-9)),
        "paired in a chain": (near(0.0, 0.9e-9, 1.8e-9), near(0.0, 2.7e-9, 0.9e-9)),
        "one too far": (near(0.0, 1.5e-9), near(0.8e-9, 3e-9)),
    }
    found = [compare.compare_rows(*pair).select(F.lit(test).alias("test"), "equal") for test, pair in tests.items()]
    return reduce(DataFrame.unionByName, found)


def e2_ordered(spark, sf_dir):
    orders = raw_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    turned = orders.select("o_totalprice", "o_orderkey")
    return (
        compare.compare_rows(orders, turned, ["o_orderkey"]).select(F.lit("same order").alias("test"), "equal")
        .unionByName(
            compare.compare_rows(
                orders.withColumn("n", F.lit(1)), turned.withColumn("n", F.lit(1)).withColumn("o_orderkey", -F.col("o_orderkey")), ["o_orderkey"]
            ).select(F.lit("other order").alias("test"), "equal")
        )
    )


SUITE = [
    {"id": "edge", "kind": "relationship", "edge": "orders.customer_id->customers.id", "minConfidence": 90},
    {"id": "edge-absent", "kind": "relationship", "edge": "parts.id->orders.id", "absent": True},
    {"id": "edge-missing", "kind": "relationship", "edge": "parts.size->orders.id"},
    {"id": "entity", "kind": "entity", "entity": "Order", "table": "orders",
     "measures": ["orders_count", "sum_totalprice"], "dimensions": ["orderstatus"]},
    {"id": "entity-gap", "kind": "entity", "entity": "Order", "measures": ["sum_colour"]},
    {"id": "metric", "kind": "metric", "metric": {"metric": "sum_totalprice", "dimensions": ["mktsegment"]}},
    {"id": "metric-fan-out", "kind": "metric", "expectRefusal": True,
     "metric": {"metric": "customers_count", "dimensions": ["orderstatus"]}},
    {"id": "metric-unknown", "kind": "metric", "expectRefusal": True, "metric": {"metric": "gross_margin"}},
    {"id": "term", "kind": "term", "term": "order priority", "resolvesTo": "orders_count"},
    {"id": "term-unknown", "kind": "term", "term": "billings", "resolvesTo": "sum_totalprice"},
]


def e3_suite(spark, sf_dir):
    return scoring.run_suite(spark, star(spark, sf_dir).model, SUITE).select("id", "kind", "outcome")


def runs(spark, sf_dir) -> DataFrame:
    """Events read as runs: the type is the case, the user's parity the arm."""
    events = raw_table(spark, sf_dir, "events")
    return events.select(
        F.when(F.col("user_id") % 2 == 0, "grounded").otherwise("plain").alias("arm"),
        F.concat_ws("-", "event_type", F.expr("user_id div 2").cast("string")).alias("case"),
        F.when(F.col("event_type") == "view", "baseline").otherwise("probe").alias("trap"),
        F.col("event_id").alias("run"),
        (F.col("value") > 2).alias("pass"),
        (F.col("value") > 400).alias("error"),
        (F.col("value") % 13).cast("int").alias("steps"),
        (F.col("value") % 3).cast("int").alias("corrections"),
        (F.col("value") > 300).alias("budget_exhausted"),
    )


def e4_tally(spark, sf_dir):
    cases = scoring.strict_cases(runs(spark, sf_dir))
    out = scoring.tally(cases, "arm")
    return out.withColumn("score", F.round("score", 6))


def e5_arms(spark, sf_dir):
    arms = scoring.compare_arms(scoring.strict_cases(runs(spark, sf_dir)))
    rounded = ("run_rate", "mean_steps", "mean_corrections")
    return arms.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in arms.columns])


def e5_delta(spark, sf_dir):
    arms = scoring.compare_arms(scoring.strict_cases(runs(spark, sf_dir)))
    out = scoring.arm_delta(arms, "grounded", "plain")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def e5_cases(spark, sf_dir):
    return scoring.case_tallies(scoring.strict_cases(runs(spark, sf_dir)), "grounded", "plain")


def e6_behavior(spark, sf_dir):
    """Conversations read as runs: roles are the tools used, turns the steps."""
    talks = raw_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.collect_set("role").alias("used"), F.count(F.lit(1)).cast("int").alias("steps")
    )
    checked = talks.select(
        F.col("conv_id").alias("run_id"), "used", "steps",
        F.array(F.lit("system"), F.lit("user")).alias("required"),
        F.array(F.lit("tool"), F.lit("system")).alias("forbidden"),
        F.lit(5).alias("max_steps"),
    )
    return scoring.behavior_violations(checked)


def flagship(spark, sf_dir):
    """Tables to answer: profile, discover, model, then one guarded metric."""
    dataset = prepare(spark, star_tables(spark, sf_dir))
    return dataset.metric("sum_totalprice", ("mktsegment",)).select(
        "mktsegment", F.round("sum_totalprice", 2).alias("sum_totalprice")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "S1_folder_scan": s1_folder,
    "S2_parquet": s2_parquet,
    "S2_csv": _round_trip("csv"),
    "S2_tsv": _round_trip("tsv"),
    "S2_jsonl": _round_trip("jsonl"),
    "S5_listing": s5_listing,
    "S6_sample": s6_sample,
    "S2_json": _round_trip("json"),
    "S2_json_mixed": _round_trip("json", mixed=True),
    "S2_ndjson": _round_trip("ndjson"),
    "S7_artifacts": s7_artifacts,
    "S7_upkeep": s7_upkeep,
    "S7_curated": s7_curated,
    "S7_stale": s7_stale,
    "S8_export_csv": s8_csv,
    "S8_export_json": s8_json,
    "S9_documents": s9_documents,
    "S11_redact": s11_redact,
    "P1_nulls": p1_nulls,
    "P2_distinct": p2_distinct,
    "P2_prefilter": p2_prefilter,
    "P3_numeric": p3_numeric,
    "P4_temporal": p4_temporal,
    "P5_top_values": p5_top,
    "P6_kinds": p6_kinds,
    "P7_dataset_profile": p7_dataset,
    "P7_table_profiles": p7_tables,
    "R1_keys": r1_keys,
    "R2_candidates": r2_candidates,
    "R3_name_similarity": r3_names,
    "R4_singular": r4_singular,
    "R5_id_named": r5_id_names,
    "R6_type_match": r6_types,
    "R7_overlap": r7_overlap,
    "R7_overlap_mixed_types": r7_text_numbers,
    "R8_cardinality": r8_shape,
    "R9_confidence": r9_confidence,
    "R10_best_target": r10_best,
    "R11_mirrored": r11_mirrored,
    "R12_discovery_star": r12_star,
    "R12_discovery_raw": r12_raw,
    "R13_identity": r13_identity,
    "V1_reject": v1_reject,
    "V2_upsert": v2_upsert,
    "V3_summary": v3_summary,
    "X1_reasons": x1_reasons,
    "X2_caveats": x2_caveats,
    "M1_entities": m1_entities,
    "M2_synonyms": m2_synonyms,
    "M3_key_columns": m3_keys,
    "M4_dimensions": m4_dimensions,
    "M5_measures": m5_measures,
    "M6_measure_names": m6_names,
    "M7_associations": m7_associations,
    "M8_model": m8_model,
    "M9_fan_out": m9_fan_out,
    "Q1_count": _metric("lineitems_count", total=False),
    "Q2_sum": _metric("sum_extendedprice"),
    "Q3_own_dimension": _metric("orders_count", ("orderstatus", "orderpriority"), total=False),
    "Q4_parent_dimension": _metric("sum_totalprice", ("mktsegment",)),
    "Q4_two_parents": _metric("sum_quantity", ("brand", "orderstatus", "returnflag")),
    "Q5_filters": _metric(
        "sum_totalprice", ("orderpriority",),
        (
            metrics.Filter("mktsegment", "!=", "BUILDING"),
            metrics.Filter("totalprice", ">", 1000),
            metrics.Filter("totalprice", "<=", 400000.5),
            metrics.Filter("orderstatus", "=", "F"),
            metrics.Filter("orderdate", ">=", "1996-01-01 00:00:00"),
            metrics.Filter("orderpriority", "<", "5"),
        ),
    ),
    "Q7_unknown": q7_to_q10("unknown-metric", "unknown-dimension", "unknown-filter", "operator", "first-problem", "ok-own"),
    "Q8_fan_out": q7_to_q10("fan-out", "fan-out-filter", "ok-parent"),
    "Q9_ambiguous": q9_ambiguous,
    "Q10_not_joinable": q7_to_q10("two-hops", "siblings", "ok-filter"),
    "Q10_two_hops": q10_two_hops,
    "Q10_one_hop_by_default": q10_hops(1),
    "Q10_paths_of_two": q10_hops(2),
    "Q10_paths_of_three": q10_hops(3),
    "Q7_operand": q7_operand,
    "Q11_join_loss": q11_loss,
    "T1_catalog": t1_catalog,
    "T2_targets": t2_targets,
    "T3_lexical": t3_lexical,
    "T4_cosine": t4_cosine,
    "T5_ranks": t5_ranks,
    "T6_fusion": t6_fusion,
    "T7_nearest": t7_nearest,
    "T8_resolve_pages": t8_pages,
    "T8_resolve_phrases": t8_phrases,
    "T9_vectors": t9_vectors,
    "G1_parse": g1_parse,
    "G2_grounded": g2_grounded,
    "G3_descriptions": g3_descriptions,
    "G4_synonyms": g4_synonyms,
    "G5_applied": g5_applied,
    "G5_resolve": g_resolve,
    "L0_run_sql": l0_run_sql,
    "L1_count": l1_count,
    "L2_group_count": l2_group_count,
    "L3_sum_product": l3_sum_product,
    "L4_chain": l4_chain,
    "L5_distinct": l5_distinct,
    "L6_not_exists": l6_not_exists,
    "L7_exists": l7_exists,
    "L8_from_role": _by_role("from_customer_id"),
    "L8_to_role": _by_role("to_customer_id"),
    "L9_natural_key": l9_natural_key,
    "L10_top_one": l10_top,
    "L10_top_count": l10_top_plain,
    "L11_filtered": l11_filtered,
    "L12_two_grains": l12_two_grains,
    "L12_drill_across": l12_drill_across,
    "L13_inflation": l13_inflation,
    "L14_left_distinct": l14_left_distinct,
    "E1_compare": e1_equal,
    "E1_differences": e1_differences,
    "E1_matching": e1_matching,
    "E2_ordered": e2_ordered,
    "E3_suite": e3_suite,
    "E4_tally": e4_tally,
    "E5_arms": e5_arms,
    "E5_delta": e5_delta,
    "E5_cases": e5_cases,
    "E6_behavior": e6_behavior,
    "flagship_metric": flagship,
}
