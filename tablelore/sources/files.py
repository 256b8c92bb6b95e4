"""A folder of data files as tables."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import layout
from .naming import safe_name, unique_name

FORMATS = ("parquet", "csv", "tsv", "json", "jsonl", "ndjson")


@dataclass
class LoadedFolder:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    files: dict[str, str] = field(default_factory=dict)  # table: path
    fingerprints: dict[str, str] = field(default_factory=dict)  # table: state of its files
    skipped: list[str] = field(default_factory=list)


def extension(name: str) -> str:
    return name.rsplit(".", 1)[-1].lower()


def read_file(
    spark: SparkSession,
    path: str,
    schema: str | None = None,
    one_line_records: bool | None = None,
    header: bool | None = None,
    sep: str | None = None,
) -> DataFrame | None:
    """One data file as a lazy DataFrame, or None for an unknown extension.

    Of a delimited file, ``sep`` and whether its first line is a ``header`` are told from all
    of its lines unless they are given; columns without a header are ``column0`` and so on.
    Without a schema, text formats are read once more to infer one. Files whose records
    hold line breaks cannot be split between tasks; unless ``one_line_records`` says so,
    whether there are any is found out by the tasks, see ``layout``.
    """
    kind = extension(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind not in FORMATS:
        return None
    reader = spark.read.schema(schema) if schema else spark.read
    if kind not in ("csv", "tsv"):
        return layout.read_json(spark, reader, path, True if kind != "json" and one_line_records is None else one_line_records)
    lines = layout.lines_of(spark, path)
    one_line = layout.one_line_cells(lines) if one_line_records is None else one_line_records
    delimiter = sep or ("\t" if kind == "tsv" else layout.delimiter_of(lines))
    named = layout.header_of(spark, path, delimiter, one_line) if header is None else header
    table = (
        reader.option("header", named)
        .option("inferSchema", schema is None)
        .option("sep", delimiter)
        .option("multiLine", not one_line)
        .option("escape", '"')
        .csv(path)
    )
    return table if named or schema else table.toDF(*(f"column{i}" for i in range(len(table.columns))))


def _listing(spark: SparkSession, folder: str) -> list[tuple[str, str, bool]]:
    """(name, path, is a directory) of a folder's entries, by name.

    Goes through Hadoop's file system API, so any path the cluster can read works.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    statuses = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted((s.getPath().getName(), s.getPath().toString(), s.isDirectory()) for s in statuses)


def state(spark: SparkSession, path: str) -> str:
    """Changes when any file at or below ``path`` is added, removed, renamed or rewritten.

    Files are gone through one at a time and only their hashes are added up, so neither
    their number nor their order matters.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    total, n = 0, 0
    while files.hasNext():
        f = files.next()
        fact = f"{f.getPath().toString()}\0{f.getLen()}\0{f.getModificationTime()}"
        total, n = (total + int.from_bytes(hashlib.sha256(fact.encode()).digest())) % (1 << 256), n + 1
    return f"{n}-{total:064x}"


def load_folder(
    spark: SparkSession, folder: str, schemas: dict[str, str] | None = None, one_line_records: bool | None = None
) -> LoadedFolder:
    """Every supported file at the top level of ``folder`` as one lazy table.

    ``schemas`` gives known schemas by table name, see ``read_file``.
    A directory named like a data file (what Spark writes) counts as one file; other
    directories are left alone and other files are reported as skipped. Files are taken
    in name order, so suffixes for equal names do not depend on the file system.
    """
    out = LoadedFolder()
    taken: set[str] = set()
    for name, path, is_directory in _listing(spark, folder):
        known = "." in name and extension(name) in FORMATS
        if not known:
            if not is_directory:
                out.skipped.append(name)
            continue
        table = unique_name(safe_name(name), taken)
        out.tables[table] = read_file(spark, path, (schemas or {}).get(table), one_line_records)
        out.files[table] = path
        out.fingerprints[table] = state(spark, path)
    return out


def register(tables: dict[str, DataFrame]) -> None:
    """Expose tables to SQL as temporary views."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


# Glossary documents are text; a file without extension counts as text.
DOCUMENT_EXTENSIONS = ("md", "markdown", "txt", "csv", "tsv", "json", "jsonl", "ndjson", "")
SPREADSHEETS = ("xlsx", "xls", "ods")


class UnsupportedDocument(ValueError):
    pass


def document_extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    return ext.lower() if dot and stem else ""


def check_document(path: str) -> None:
    kind = document_extension(path)
    if kind in SPREADSHEETS:
        raise UnsupportedDocument(
            f"{path} is a spreadsheet. Export the sheet as CSV and give that file."
        )
    if kind not in DOCUMENT_EXTENSIONS:
        raise UnsupportedDocument(f"Unsupported document type {kind!r}: {path}")


def load_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole glossary documents as ``(path, text)``; refuses anything but text files."""
    for path in paths:
        check_document(path)
    return spark.read.text(paths, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("text")
    )
