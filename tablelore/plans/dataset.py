"""From tables to a curated semantic model in one call."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.curation import apply_verdicts
from ..operators.glossary import merge_glossary
from ..operators.metrics import Filter, MetricCatalog, MetricRequest, query_metric, query_metrics
from ..operators.profile import profile_dataset
from ..operators.relationships import discover_relationships
from ..operators.semantic import SemanticModel, build_model
from ..session import shared_dir, write_once
from ..operators.terms import TOP_K, kept_vectors, resolve_terms, term_catalog
from ..sources.artifacts import fingerprint, read_artifacts, read_curation, read_terms, write_artifacts, write_terms
from ..sources.files import load_folder
from ..tables import Tables
from .upkeep import kept_profile, kept_relationships, versions


@dataclass(frozen=True)
class Embedding:
    """Makes vectors of texts, which are kept in a folder under the model's name."""

    embedder: Callable[[list[str]], np.ndarray]
    folder: str
    model: str = "default"

    def add(self, df: DataFrame, text: str) -> DataFrame:
        return kept_vectors(df, text, self.embedder, self.folder, self.model)


@dataclass
class Dataset:
    """Lazy tables with everything derived from them."""

    tables: Tables
    profile: DataFrame
    model: SemanticModel
    _catalog: MetricCatalog | None = None
    _terms: DataFrame | None = None
    _embedding: Embedding | None = None

    @property
    def relationships(self) -> DataFrame:
        return self.model.relationships

    @property
    def catalog(self) -> MetricCatalog:
        if self._catalog is None:
            self._catalog = MetricCatalog.of(self.model)
        return self._catalog

    def metric(self, name: str, dimensions: tuple[str, ...] = (), filters: tuple[Filter, ...] = (), max_hops: int = 1) -> DataFrame:
        return query_metric(self.tables, self.catalog, MetricRequest(name, tuple(dimensions), tuple(filters)), max_hops)

    def metrics(self, *names: str, dimensions: tuple[str, ...] = (), filters: tuple[Filter, ...] = (), max_hops: int = 1) -> DataFrame:
        """Several measures side by side, each at its own grain."""
        return query_metrics(self.tables, self.catalog, names, dimensions, filters, max_hops)

    def resolve(self, *words: str, k: int = TOP_K) -> DataFrame:
        """The schema objects that business words mean best, with a position for each word.

        With an embedding, vectors of words and terms count as well as their letters.
        """
        if self._terms is None:
            self._terms = term_catalog(self.model)
        spark = self.profile.sparkSession
        asked = spark.createDataFrame(list(enumerate(words)), "query_id long, query string")
        if self._embedding is None:
            found = resolve_terms(asked, self._terms, k)
        else:
            found = resolve_terms(self._embedding.add(asked, "query"), self._embedding.add(self._terms, "text"), k, vectors=True)
        return asked.withColumnRenamed("query", "word").join(found, "query_id").drop("query_id")


def keep(model: SemanticModel) -> SemanticModel:
    """The model with its catalog tables written once, so later steps do not redo it."""
    parts = ("entities", "dimensions", "measures")
    with ThreadPoolExecutor(len(parts)) as pool:  # small independent jobs, side by side
        written = pool.map(lambda part: write_once(getattr(model, part), part), parts)
    return SemanticModel(*written, model.relationships)


def prepare(
    spark: SparkSession,
    tables: Tables,
    verdicts: DataFrame | None = None,
    overrides: DataFrame | None = None,
    glossary: DataFrame | None = None,
) -> Dataset:
    """Profile, discover, curate, model and annotate a set of tables."""
    profile = profile_dataset(spark, tables)
    edges = discover_relationships(spark, tables, profile)
    return curate(spark, tables, profile, edges, verdicts, overrides, glossary)


def curate(
    spark: SparkSession,
    tables: Tables,
    profile: DataFrame,
    edges: DataFrame,
    verdicts: DataFrame | None = None,
    overrides: DataFrame | None = None,
    glossary: DataFrame | None = None,
) -> Dataset:
    """Apply what people have said to inferred edges, then model and annotate."""
    if overrides is not None:
        keys = profile.where("distinct_count < row_count - null_count").select(F.col("table").alias("to_table"), F.col("column").alias("to_column"))
        loose = overrides.join(keys, ["to_table", "to_column"]).collect()
        if loose:
            named = ", ".join(sorted(f"{e.from_table}.{e.from_column}->{e.to_table}.{e.to_column}" for e in loose))
            raise ValueError(f"these overrides lead to columns with repeated values, which would count rows twice: {named}")
    if verdicts is not None or overrides is not None:
        verdicts = verdicts if verdicts is not None else spark.createDataFrame([], "key string, verdict string")
        overrides = overrides if overrides is not None else edges.limit(0)
        edges = write_once(apply_verdicts(edges, verdicts, overrides), "relationships")
    model = build_model(spark, list(tables), edges, profile)
    if glossary is not None:
        model = merge_glossary(model, glossary)
    return Dataset(tables, profile, keep(model))


def prepare_folder(
    spark: SparkSession,
    folder: str,
    cache: str | None = None,
    verdicts: DataFrame | None = None,
    overrides: DataFrame | None = None,
    glossary: DataFrame | None = None,
    embedder: Callable[[list[str]], np.ndarray] | None = None,
    model: str = "default",
) -> Dataset:
    """Prepare a folder of files, reusing stored output while the files are unchanged.

    After a change only the tables whose files changed are read, see ``upkeep``. What is stored is what was inferred. Verdicts, overrides and the glossary, given here
    or stored beside it, are applied anew each time. With an ``embedder``, words are resolved
    by vectors too; those of texts seen before are kept in ``cache`` under the ``model``'s name.
    """
    dataset = _prepare_folder(spark, folder, cache, verdicts, overrides, glossary)
    if embedder is not None:
        dataset._embedding = Embedding(embedder, cache or shared_dir(spark), model)
    return dataset


def _prepare_folder(
    spark: SparkSession, folder: str, cache: str | None, verdicts: DataFrame | None, overrides: DataFrame | None, glossary: DataFrame | None
) -> Dataset:
    loaded = load_folder(spark, folder)
    if not loaded.tables:
        raise ValueError(f"no supported data files in {folder}")
    said = {"verdicts": verdicts, "overrides": overrides, "glossary": glossary}
    if cache is None:
        return prepare(spark, loaded.tables, **said)
    source = fingerprint(loaded.files, loaded.fingerprints)
    stored = read_artifacts(spark, cache, source)
    if stored is None:
        version = versions(loaded)
        profile, _ = kept_profile(spark, cache, loaded.tables, version)
        edges = kept_relationships(spark, cache, loaded.tables, version, profile)
        fresh = curate(spark, loaded.tables, profile, edges)
        write_artifacts(cache, source, fresh.profile, fresh.model)
        write_terms(cache, source, term_catalog(fresh.model))
        stored = read_artifacts(spark, cache, source)
    profile, model = stored
    said = read_curation(spark, cache) | {name: df for name, df in said.items() if df is not None}
    if said:
        return curate(spark, loaded.tables, profile, model.relationships, **said)
    return Dataset(loaded.tables, profile, model, _terms=read_terms(spark, cache, source))
