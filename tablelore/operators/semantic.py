"""Entities, dimensions and measures derived from profiles and relationships."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import naming
from ..tables import small_table

# What counts as categorical, and when its values are listed.
CATEGORICAL_DISTINCT = 50
LISTED_DISTINCT = 25
CATEGORICAL_SHARE = 0.5


@dataclass(frozen=True)
class SemanticModel:
    """The catalog tables of one dataset. All of them are schema-sized."""

    entities: DataFrame
    dimensions: DataFrame
    measures: DataFrame
    relationships: DataFrame

    def with_parts(self, **parts: DataFrame) -> SemanticModel:
        return replace(self, **parts)


def name_entities(spark: SparkSession, table_names: Iterable[str]) -> DataFrame:
    """One entity per table: ``(ordinal, entity, table, synonyms)``.

    Two tables may singularize to the same name. The first keeps it, later ones take
    the capitalised full table name and then a number; that walk over the table names
    is the only step done on the driver.
    """
    names = [{"ordinal": i, "table": name} for i, name in enumerate(sorted(table_names))]
    listed = small_table(spark, names, "ordinal int, table string").select(
        "ordinal",
        "table",
        naming.pascal(naming.singular(F.col("table"))).alias("short"),
        naming.pascal(F.col("table")).alias("full"),
    )
    used: set[str] = set()
    rows = []
    for row in sorted(listed.collect(), key=lambda r: r.ordinal):
        entity, number = row.short, 2
        if entity in used:
            entity = row.full
        while entity in used:
            entity = f"{row.full}{number}"
            number += 1
        used.add(entity)
        rows.append({"ordinal": row.ordinal, "entity": entity, "table": row.table})
    entities = small_table(spark, rows, "ordinal int, entity string, table string")
    return entities.withColumn("synonyms", entity_synonyms())


def entity_synonyms():
    spaced = F.array_join(naming.tokens(F.col("table")), " ")
    terms = F.array(F.col("table"), naming.singular(F.col("table")), spaced)
    return F.array_distinct(
        F.filter(terms, lambda term: (term != "") & (term != F.col("entity")))
    )


def key_columns(profile: DataFrame, relationships: DataFrame) -> DataFrame:
    """Columns that serve as keys: ends of a relationship, or named like an id."""
    ends = relationships.select(F.col("from_table").alias("table"), F.col("from_column").alias("column"))
    ends = ends.union(relationships.select("to_table", "to_column"))
    named = profile.where(naming.is_id_named(F.col("column"))).select("table", "column")
    return ends.union(named).distinct()


def derive_dimensions(profile: DataFrame, keys: DataFrame, entities: DataFrame) -> DataFrame:
    distinct, rows = F.col("distinct_count"), F.col("row_count")
    few = (distinct <= CATEGORICAL_DISTINCT) & (
        (rows == 0) | (distinct <= rows * CATEGORICAL_SHARE)
    )
    date, boolean = F.col("kind") == "date", F.col("kind") == "boolean"
    word = F.col("kind").isin("text", "other") & few
    listed = boolean | ((distinct <= LISTED_DISTINCT) & (F.size("all_values") > 0))
    return (
        profile.join(keys, ["table", "column"], "left_anti")
        .where(date | boolean | word)
        .join(entities.select("table", "entity"), "table")
        .select(
            F.col("table_ordinal").alias("entity_ordinal"),
            "ordinal",
            "entity",
            "table",
            F.col("column").alias("name"),
            "column",
            F.when(date, "time").otherwise("categorical").alias("kind"),
            F.when(date, "day").alias("grain"),
            F.when(~date & listed, F.col("all_values")).alias("values"),
            F.lit(None).cast("string").alias("description"),
            F.array().cast("array<string>").alias("synonyms"),
        )
    )


def raw_measures(profile: DataFrame, keys: DataFrame, entities: DataFrame) -> DataFrame:
    """A row count per table and a sum per numeric column that is not a key."""
    named = entities.select("table", "entity")
    counts = profile.select("table", "table_ordinal").distinct().select(
        F.col("table_ordinal").alias("entity_ordinal"),
        F.lit(-1).alias("ordinal"),
        "table",
        F.concat("table", F.lit("_count")).alias("name"),
        F.lit("count").alias("agg"),
        F.lit(None).cast("string").alias("column"),
    )
    sums = (
        profile.join(keys, ["table", "column"], "left_anti")
        .where(F.col("kind") == "numeric")
        .select(
            F.col("table_ordinal").alias("entity_ordinal"),
            "ordinal",
            "table",
            F.concat(F.lit("sum_"), "column").alias("name"),
            F.lit("sum").alias("agg"),
            "column",
        )
    )
    return counts.unionByName(sums).join(named, "table").select(
        "entity_ordinal", "ordinal", "entity", "table", "name", "agg", "column",
        F.col("table").alias("grain"),
        F.lit(None).cast("string").alias("description"),
        F.array().cast("array<string>").alias("synonyms"),
    )


def disambiguate(measures: DataFrame) -> DataFrame:
    """Prefix every measure whose name is used more than once with its table."""
    shared = F.count(F.lit(1)).over(Window.partitionBy("name")) > 1
    return measures.withColumn("shared", shared).withColumn(
        "name", F.when(F.col("shared"), F.concat_ws("_", "table", "name")).otherwise(F.col("name"))
    ).drop("shared")


def associate(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Adds ``belongs_to``, ``has_many`` and ``has_one``, strongest edge first."""
    names = entities.select("table", "entity")
    ends = (
        relationships.join(names.select(F.col("table").alias("from_table"), F.col("entity").alias("child")), "from_table")
        .join(names.select(F.col("table").alias("to_table"), F.col("entity").alias("parent")), "to_table")
    )

    def listing(rows: DataFrame, owner: str, other: str, name: str) -> DataFrame:
        return (
            rows.groupBy(F.col(owner).alias("table"), F.col(other).alias("other"))
            .agg(F.min("ordinal").alias("ordinal"))
            .groupBy("table")
            .agg(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("ordinal", "other"))), lambda e: e["other"]
                ).alias(name)
            )
        )

    single = F.col("cardinality") == "one-to-one"
    out = entities
    for rows, owner, other, name in (
        (ends, "from_table", "parent", "belongs_to"),
        (ends.where(~single), "to_table", "child", "has_many"),
        (ends.where(single), "to_table", "child", "has_one"),
    ):
        out = out.join(listing(rows, owner, other, name), "table", "left").withColumn(
            name, F.coalesce(name, F.array().cast("array<string>"))
        )
    return out


def build_model(
    spark: SparkSession,
    table_names: Iterable[str],
    relationships: DataFrame,
    profile: DataFrame | None = None,
) -> SemanticModel:
    """The whole model. Without profiles it has entities only."""
    entities = associate(name_entities(spark, table_names), relationships)
    entities = entities.select(
        "ordinal", "entity", "table", F.lit(None).cast("string").alias("description"), "synonyms",
        "belongs_to", "has_many", "has_one",
    )
    if profile is None:
        empty = spark.createDataFrame([], _PROFILE_SHAPE)
        keys = key_columns(empty, relationships)
        return SemanticModel(
            entities,
            derive_dimensions(empty, keys, entities),
            disambiguate(raw_measures(empty, keys, entities)),
            relationships,
        )
    keys = key_columns(profile, relationships)
    return SemanticModel(
        entities,
        derive_dimensions(profile, keys, entities),
        disambiguate(raw_measures(profile, keys, entities)),
        relationships,
    )


_PROFILE_SHAPE = (
    "table string, table_ordinal int, ordinal int, column string, kind string, row_count bigint, "
    "distinct_count bigint, all_values array<string>"
)


def fan_out_warnings(model: SemanticModel) -> DataFrame:
    """Which joins repeat the rows a measure is defined on: ``(table, measure, child)``."""
    children = model.entities.select("table", F.explode("has_many").alias("child"))
    return model.measures.select("table", F.col("name").alias("measure"), "grain").join(
        children, "table"
    )
