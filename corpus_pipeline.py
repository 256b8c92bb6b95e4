"""From raw documents to packed training sequences, in five stages.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns
a DataFrame. All but the last return the columns of ``documents``; further columns of ``docs``
are dropped. Every stage takes null, empty and very long texts, rows without a doc_id,
repeated rows and ids, and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelore.llm import crf_quality, line_chunks, packing, pii, simhash_tiles
from tablelore.session import write_once

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(found: DataFrame, text: str) -> DataFrame:
    """The documents in ``row`` with another text and its length."""
    n_chars = F.coalesce(F.length(text).cast("long"), F.col("row.n_chars"))
    new = {"text": F.col(text), "n_chars": n_chars}
    return found.select(*(new.get(c, F.col(f"row.{c}")).alias(c) for c in COLUMNS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; a null or empty text has no words and goes."""
    field = crf_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return crf_quality.judge(docs, field).where("kept").select(*(f"row.{c}" for c in COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks of lines that an earlier place already has; a text may become empty, a null one stays null."""
    return _with_text(line_chunks.remove_repeated_chunks(docs), "kept")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates, texts without words being one group; the smallest doc_id stays, none comes last."""
    return simhash_tiles.one_of_each(docs, radius=2, shingle=3).select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that disclose it, masked; a null text stays null."""
    return _with_text(pii.find_private(docs), "sanitised")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("pii", private),
    ("best_fit_packing", pack),
]

#: The stages' models and fingerprints cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
