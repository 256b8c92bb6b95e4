"""Discovery output kept between runs, and result export."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.semantic import SemanticModel
from ..session import written
from ..tables import ref

PARTS = ("profile", "relationships", "entities", "dimensions", "measures")


def fingerprint(files: dict[str, str], states: dict[str, str]) -> str:
    """Changes whenever a source file is added, removed, renamed or rewritten."""
    facts = [[table, files[table], states[table]] for table in sorted(files)]
    return hashlib.sha256(json.dumps(facts).encode()).hexdigest()[:32]


def write_artifacts(folder: str, source: str, profile: DataFrame, model: SemanticModel) -> None:
    """Store profiles, relationships and the model under the source's fingerprint."""
    parts = {
        "profile": profile,
        "relationships": model.relationships,
        "entities": model.entities,
        "dimensions": model.dimensions,
        "measures": model.measures,
    }
    for name in PARTS:
        parts[name].write.mode("overwrite").parquet(f"{folder}/{source}/{name}")


def read_artifacts(
    spark: SparkSession, folder: str, source: str
) -> tuple[DataFrame, SemanticModel] | None:
    """What was stored for this exact source, or None if it must be derived again."""
    if not written(spark, f"{folder}/{source}/{PARTS[-1]}"):
        return None
    read = {name: spark.read.parquet(f"{folder}/{source}/{name}") for name in PARTS}
    model = SemanticModel(read["entities"], read["dimensions"], read["measures"], read["relationships"])
    return read["profile"], model


def write_terms(folder: str, source: str, terms: DataFrame) -> None:
    """Store the search terms, with their vectors if they have been computed."""
    terms.write.mode("overwrite").parquet(f"{folder}/{source}/terms")


def read_terms(spark: SparkSession, folder: str, source: str) -> DataFrame | None:
    return spark.read.parquet(f"{folder}/{source}/terms") if written(spark, f"{folder}/{source}/terms") else None


CURATION = ("verdicts", "overrides", "glossary")


def write_curation(folder: str, **parts: DataFrame) -> None:
    """Store people's ``verdicts``, ``overrides`` or ``glossary``; they do not depend on the source files."""
    for name, df in parts.items():
        if name not in CURATION:
            raise ValueError(f"no curation is called {name}")
        df.write.mode("overwrite").parquet(f"{folder}/curation/{name}")


def read_curation(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """What people have stored, by name."""
    places = {name: f"{folder}/curation/{name}" for name in CURATION}
    return {name: spark.read.parquet(place) for name, place in places.items() if written(spark, place)}


def shown(df: DataFrame) -> DataFrame:
    """Every column as export text: floats to 15 significant digits, nested as JSON."""
    columns = []
    for f in df.schema.fields:
        value = ref(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            value = _float_text(value.cast("double"))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(value)
        else:
            value = value.cast("string")
        columns.append(value.alias(f.name))
    return df.select(*columns)


def _float_text(value):
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    text = F.format_string("%.14e", value).cast("double").cast("string")
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(text)


def export_csv(df: DataFrame, folder: str) -> None:
    """Comma-separated with header, quotes doubled, CRLF lines and nulls as NULL."""
    (
        shown(df)
        .write.mode("overwrite")
        .option("header", True)
        .option("nullValue", "NULL")
        .option("emptyValue", "")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("lineSep", "\r\n")
        .csv(folder)
    )


def export_json(df: DataFrame, folder: str) -> None:
    """One JSON object per row, in the frame's column order; nulls are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(folder)
