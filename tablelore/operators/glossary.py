"""Business glossary entries: parsed, grounded on the schema, merged into the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .semantic import SemanticModel

# Fixed value: entries below it are dropped; also the default where none is given.
CONFIDENCE_FLOOR = 0.5

APPLIED = ("target", "field", "value")


def unfence(text: Column) -> Column:
    """The text without a surrounding Markdown code fence."""
    bare = _trim(text)
    opened = F.regexp_replace(bare, "^```[a-zA-Z]*\\n?", "")
    return _trim(F.when(bare.startswith("```"), F.regexp_replace(opened, "```$", "")).otherwise(bare))


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _get(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _string(value: Column, path: str) -> Column:
    """The member as text, or null when it is missing or not a string."""
    member = _get(value, path)
    return F.when(_kind(member) == "STRING", F.try_variant_get(value, path, "string"))


def parse_glossary(spark: SparkSession, payloads: DataFrame) -> DataFrame:
    """Entries found in JSON payloads, one row per entry that has a term.

    ``payloads`` is ``(payload_id, payload)``. A payload that is not a JSON array holds
    no entries; members of the wrong type are treated as missing.
    """
    array = F.try_parse_json(unfence(F.col("payload")))
    items = (
        payloads.select("payload_id", array.alias("body"))
        .where(_kind(F.col("body")).startswith("ARRAY"))
        .select(
            "payload_id",
            F.posexplode(F.try_variant_get("body", "$", "array<variant>")).alias("position", "item"),
        )
        .where(_kind(F.col("item")).startswith("OBJECT"))
    )
    item = F.col("item")
    table = _string(item, "$.mapsTo.table")
    number = _kind(_get(item, "$.confidence")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    synonyms = F.transform(
        F.filter(
            F.coalesce(
                F.try_variant_get(item, "$.synonyms", "array<variant>"),
                F.array().cast("array<variant>"),
            ),
            lambda s: _kind(s) == "STRING",
        ),
        lambda s: s.cast("string"),
    )
    return items.select(
        "payload_id",
        "position",
        _trim(_string(item, "$.term")).alias("term"),
        F.coalesce(_trim(_string(item, "$.definition")), F.lit("")).alias("definition"),
        synonyms.alias("synonyms"),
        table.alias("map_table"),
        F.when(table.isNotNull(), _string(item, "$.mapsTo.column")).alias("map_column"),
        F.coalesce(
            F.when(number, F.try_variant_get(item, "$.confidence", "double")),
            F.lit(CONFIDENCE_FLOOR),
        ).alias("confidence"),
        _string(item, "$.source").alias("source"),
    ).where(F.col("term") != "")


def ground(model: SemanticModel, glossary: DataFrame) -> DataFrame:
    """Accepted entries that name an existing table and column, with their target.

    A column is looked up among the dimensions first and then among the measures over
    it. ``glossary`` follows ``types.GLOSSARY``; rows with ``accepted = false`` are
    proposals and change nothing.
    """
    offered = glossary.where(
        F.col("accepted") & (F.col("confidence") >= CONFIDENCE_FLOOR) & F.col("map_table").isNotNull()
    ).withColumn("map_column", F.when(F.col("map_column") != "", F.col("map_column")))

    def targets(frame: DataFrame, kind: str) -> DataFrame:
        return frame.where("column is not null").select(
            F.col("table").alias("map_table"), F.col("column").alias("map_column"),
            F.lit(kind).alias("kind"),
        )

    dimensions = targets(model.dimensions, "dimension")
    measures = targets(model.measures, "measure").join(
        dimensions, ["map_table", "map_column"], "left_anti"
    )
    columns = dimensions.unionByName(measures).distinct()
    tables = model.entities.select(F.col("table").alias("map_table"), "entity")
    return (
        offered.join(tables, "map_table")
        .join(columns, ["map_table", "map_column"], "left")
        .where(F.col("map_column").isNull() | F.col("kind").isNotNull())
        .select(
            "ordinal", "term", "definition", "synonyms", "entity",
            F.coalesce("kind", F.lit("entity")).alias("kind"),
            F.col("map_table").alias("table"), F.col("map_column").alias("column"),
            F.coalesce(F.concat(F.col("map_table"), F.lit("."), F.col("map_column")), F.col("entity")).alias("target"),
            F.coalesce("map_column", F.col("entity")).alias("own"),
        )
    )


def _existing(model: SemanticModel) -> DataFrame:
    """Descriptions and synonyms already on the model, by target."""
    entity = model.entities.select(
        F.lit("entity").alias("kind"), "table", F.lit(None).cast("string").alias("column"),
        "description", "synonyms",
    )
    rest = [
        frame.where("column is not null").select(
            F.lit(kind).alias("kind"), "table", "column", "description", "synonyms"
        )
        for frame, kind in ((model.dimensions, "dimension"), (model.measures, "measure"))
    ]
    return entity.unionByName(rest[0]).unionByName(rest[1])


def new_descriptions(model: SemanticModel, grounded: DataFrame) -> DataFrame:
    """The first definition of each target that has no description yet."""
    described = _existing(model).where(F.coalesce(F.col("description"), F.lit("")) != "")
    fresh = _without(grounded, described)
    return fresh.where("definition != ''").groupBy("kind", "table", "column", "target").agg(
        F.min("ordinal").alias("ordinal"), F.min_by("definition", "ordinal").alias("value")
    )


def new_synonyms(model: SemanticModel, grounded: DataFrame) -> DataFrame:
    """Each added synonym once, at the entry and position that first brings it."""
    known = _existing(model).select("kind", "table", "column", F.explode("synonyms").alias("synonym"))
    offered = grounded.select(
        "kind", "table", "column", "target", "own", "ordinal",
        F.posexplode("synonyms").alias("position", "raw"),
    ).withColumn("synonym", _trim(F.col("raw")))
    offered = offered.where((F.col("synonym") != "") & (F.col("synonym") != F.col("own")))
    fresh = _without(offered, known, "synonym")
    return fresh.groupBy("kind", "table", "column", "target", "synonym").agg(
        F.min(F.struct("ordinal", "position")).alias("at")
    ).select("kind", "table", "column", "target", "synonym", "at.*")


def _without(rows: DataFrame, taken: DataFrame, *more: str) -> DataFrame:
    keys = ["kind", "table", "column", *more]
    renamed = taken.select(*[F.col(key).alias(f"__{key}") for key in keys])
    same = None
    for key in keys:
        equal = F.col(key).eqNullSafe(F.col(f"__{key}"))
        same = equal if same is None else same & equal
    return rows.join(renamed, same, "left_anti")


def applied_changes(model: SemanticModel, glossary: DataFrame) -> DataFrame:
    """What merging would change: ``(ordinal, target, field, value)``."""
    grounded = ground(model, glossary)
    descriptions = new_descriptions(model, grounded).select(
        "ordinal", "target", F.lit("description").alias("field"), "value"
    )
    synonyms = (
        new_synonyms(model, grounded)
        .groupBy("ordinal", "target")
        .agg(F.sort_array(F.collect_list(F.struct("position", "synonym"))).alias("added"))
        .select("ordinal", "target", F.lit("synonyms").alias("field"), F.array_join("added.synonym", ", ").alias("value"))
    )
    return descriptions.unionByName(synonyms)


def merge_glossary(model: SemanticModel, glossary: DataFrame) -> SemanticModel:
    """The model with accepted descriptions and synonyms added; nothing is replaced."""
    grounded = ground(model, glossary)
    descriptions = new_descriptions(model, grounded)
    synonyms = (
        new_synonyms(model, grounded)
        .groupBy("kind", "table", "column")
        .agg(F.sort_array(F.collect_list(F.struct("ordinal", "position", "synonym"))).alias("added"))
    )

    def annotate(frame: DataFrame, kind: str, by_column: bool) -> DataFrame:
        keys = ["table", "column"] if by_column else ["table"]
        text = descriptions.where(F.col("kind") == kind).select(*keys, F.col("value").alias("__text"))
        more = synonyms.where(F.col("kind") == kind).select(*keys, F.col("added.synonym").alias("__more"))
        order = frame.columns
        out = frame
        if "column" in frame.columns and by_column:
            # a measure or dimension is annotated once per column: the first one
            first = Window.partitionBy(*keys).orderBy("ordinal")
            out = out.withColumn("__first", F.row_number().over(first) == 1)
        else:
            out = out.withColumn("__first", F.lit(True))
        out = out.join(text, keys, "left").join(more, keys, "left")
        out = out.withColumn(
            "description",
            F.when(F.col("__first") & (F.coalesce("description", F.lit("")) == ""), F.coalesce("__text", "description"))
            .otherwise(F.col("description")),
        ).withColumn(
            "synonyms",
            F.when(F.col("__first") & F.col("__more").isNotNull(), F.concat("synonyms", "__more")).otherwise(F.col("synonyms")),
        )
        return out.select(*order)

    return model.with_parts(
        entities=annotate(model.entities, "entity", False),
        dimensions=annotate(model.dimensions, "dimension", True),
        measures=annotate(model.measures, "measure", True),
    )
