"""People's verdicts and overrides on inferred relationships, and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relationships import EDGE, with_key

# Fixed value: an edge below this confidence is listed for manual review.
LOW_CONFIDENCE = 75

_EDGE_ROW = (
    "ordinal", *EDGE, "confidence", "cardinality", "value_overlap", "name_similarity",
    "type_match", "cardinality_shape",
)


def reject_edges(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Edges whose key nobody rejected."""
    rejected = verdicts.where("verdict = 'rejected'").select("key")
    return with_key(edges).join(rejected, "key", "left_anti").select(*_EDGE_ROW)


def apply_verdicts(edges: DataFrame, verdicts: DataFrame, overrides: DataFrame) -> DataFrame:
    """Drop rejected edges, then replace or append overrides by key.

    A replaced edge keeps its place and an added one goes last, so applying the same
    curation again changes nothing. For one key the last override counts.
    """
    kept = with_key(reject_edges(edges, verdicts))
    extra = with_key(reject_edges(overrides, verdicts))
    last = Window.partitionBy("key").orderBy(F.col("ordinal").desc())
    extra = (
        extra.withColumn("first", F.min("ordinal").over(Window.partitionBy("key")))
        .withColumn("place", F.row_number().over(last))
        .where("place = 1")
    )
    places = kept.select("key", F.col("ordinal").alias("kept_at"))
    extra = extra.join(places, "key", "left").withColumn("added", F.col("kept_at").isNull())
    merged = (
        kept.join(extra.select("key"), "key", "left_anti")
        .select("key", *_EDGE_ROW, F.lit(False).alias("added"), F.col("ordinal").alias("at"))
        .unionByName(
            extra.select("key", *_EDGE_ROW, "added", F.coalesce("kept_at", "first").alias("at"))
        )
    )
    order = Window.orderBy("added", "at", "key")
    return merged.withColumn("ordinal", F.row_number().over(order) - 1).select(*_EDGE_ROW)


def curation_summary(edges: DataFrame, verdicts: DataFrame, overrides: DataFrame) -> DataFrame:
    """One row: how many edges were rejected, overridden and added."""
    rejected = verdicts.where("verdict = 'rejected'").select("key", F.lit(True).alias("rejected"))
    sides = (
        with_key(edges).select("key", F.lit(1).alias("inferred"), F.lit(0).alias("override"))
        .unionByName(with_key(overrides).select("key", F.lit(0).alias("inferred"), F.lit(1).alias("override")))
        .groupBy("key")
        .agg(F.sum("inferred").alias("inferred"), F.sum("override").alias("override"))
        .join(rejected, "key", "left")
        .withColumn("rejected", F.coalesce("rejected", F.lit(False)))
    )
    known, offered = F.col("inferred") > 0, F.col("override")
    open_key = ~F.col("rejected")
    return sides.agg(
        F.coalesce(F.sum(F.when(F.col("rejected"), F.col("inferred"))), F.lit(0)).alias("rejected"),
        # the first override of an unknown key adds it, later ones replace that
        F.coalesce(
            F.sum(F.when(open_key & known, offered).when(open_key & (offered > 0), offered - 1)), F.lit(0)
        ).alias("overridden"),
        F.coalesce(F.sum(F.when(open_key & ~known & (offered > 0), 1)), F.lit(0)).cast("bigint").alias("added"),
    )


def _percent(share: Column) -> Column:
    return F.floor(share * 100 + 0.5).cast("bigint").cast("string")


def reasons(edges: DataFrame) -> DataFrame:
    """Each edge with the sentences that justify it, in a fixed order."""
    # The sentences below, and those of the caveats, are part of the result.
    source = F.concat_ws(".", "from_table", "from_column")
    target = F.concat_ws(".", "to_table", "to_column")
    name, kind = F.col("name_similarity"), F.col("type_match")
    overlap = F.concat(
        _percent(F.col("value_overlap")), F.lit("% of distinct "), source,
        F.lit(" values are present in "), target,
    )
    by_name = (
        F.when(name >= 0.9, "column name strongly matches the target")
        .when(name >= 0.5, "column name partially matches the target")
        .otherwise("weak name match")
    )
    by_type = (
        F.when(kind >= 1, "exact type match")
        .when(kind >= 0.85, "same type family")
        .when(kind > 0, "compatible types")
        .otherwise("type mismatch")
    )
    by_shape = F.when(
        F.col("cardinality") == "one-to-one", "one-to-one (both sides unique)"
    ).otherwise("many-to-one (target key is unique)")
    return with_key(edges).select(
        "ordinal", "key", F.array(overlap, by_name, by_type, by_shape).alias("reasons")
    )


def caveats(edges: DataFrame, profile: DataFrame) -> DataFrame:
    """Edges and tables a person should look at: ``(subject, caveat)``."""
    arrow = F.concat(
        F.concat_ws(".", "from_table", "from_column"), F.lit(" ↳ "),
        F.concat_ws(".", "to_table", "to_column"),
    )
    keyed = with_key(edges)
    weak = keyed.where(F.col("confidence") < LOW_CONFIDENCE).select(
        F.col("key").alias("subject"),
        F.concat(
            arrow, F.lit(" is low-confidence ("), F.col("confidence").cast("string"),
            F.lit("%) — verify manually"),
        ).alias("caveat"),
    )
    chance = keyed.where((F.col("name_similarity") < 0.5) & (F.col("value_overlap") >= 0.9)).select(
        F.col("key").alias("subject"),
        F.concat(
            arrow,
            F.lit(" matched mainly on data overlap with weak name evidence — possibly coincidental"),
        ).alias("caveat"),
    )
    linked = edges.select(F.explode(F.array("from_table", "to_table")).alias("table"))
    orphans = (
        profile.select("table").distinct().join(linked, "table", "left_anti").select(
            F.col("table").alias("subject"), F.lit("no inferred relationships").alias("caveat")
        )
    )
    return weak.unionByName(chance).unionByName(orphans)
