"""A searchable catalog of schema terms and hybrid (lexical + vector) resolution."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import naming
from ..functions.vectors import cosine_block, matrix
from ..session import write_once, written
from .lanes import union_all
from .semantic import SemanticModel

# Results per query and the damping constant of rank fusion.
TOP_K = 5
RRF_K = 60

# Numbers in a block of the grid, blocks of queries in a cell, and tasks at most.
GRID_VALUES = 1 << 17
CELL_BLOCKS = 4
MOST_TASKS = 20_000


def term_catalog(model: SemanticModel) -> DataFrame:
    """One row per entity, dimension and measure name and per synonym of each."""
    base = model.entities.select("ordinal", "entity", "table", "description", "synonyms")
    none = F.lit(None).cast("string")

    def rows(source: DataFrame, section: int, item, term, kind: str, text, column=none, metric=none):
        return source.select(
            F.col("entity_ordinal"),
            F.lit(section).alias("section"),
            item.alias("item"),
            F.col("position"),
            term.alias("term"),
            F.lit(kind).alias("kind"),
            "entity",
            "table",
            column.alias("column"),
            metric.alias("metric"),
            text.alias("text"),
        )

    entities = base.withColumnRenamed("ordinal", "entity_ordinal").withColumn("position", F.lit(-1))
    context = F.when(F.col("description").isNotNull(), F.concat(F.lit(" "), "description")).otherwise("")
    parts = [
        rows(
            entities, 0, F.lit(-1), F.col("entity"), "entity",
            F.trim(F.concat(F.concat_ws(" ", "entity", "table"), context)),
        )
    ]
    said = entities.drop("position").select("*", F.posexplode("synonyms").alias("position", "synonym"))
    parts.append(
        rows(said, 0, F.lit(-1), F.col("synonym"), "synonym", F.concat_ws(" ", "synonym", "entity"))
    )
    for frame, section, kind, word, column, metric in (
        (model.dimensions, 1, "dimension", "kind", F.col("column"), none),
        (model.measures, 2, "measure", "agg", none, F.col("name")),
    ):
        phrase = F.concat_ws(" ", "name", word, F.lit(f"{kind} of"), "entity")
        parts.append(
            rows(frame.withColumn("position", F.lit(-1)), section, F.col("ordinal"), F.col("name"), kind, phrase, column, metric)
        )
        said = frame.select("*", F.posexplode("synonyms").alias("position", "synonym"))
        phrase = F.concat_ws(" ", "synonym", "name", F.lit(f"{kind} of"), "entity")
        parts.append(rows(said, section, F.col("ordinal"), F.col("synonym"), "synonym", phrase, column, metric))
    order = Window.orderBy("entity_ordinal", "section", "item", "position")
    return union_all(parts).select(
        (F.row_number().over(order) - 1).cast("bigint").alias("term_id"),
        "term", "kind", "entity", "table", "column", "metric", "text",
    )


def target_label():
    """What a term points at: a metric, a table.column, or a table."""
    return F.coalesce("metric", F.concat(F.col("table"), F.lit("."), F.col("column")), F.col("table"))


def _plain(text):
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def _words(text):
    return F.array_distinct(F.transform(F.array_distinct(naming.tokens(text)), naming.singular))


def lexical_scores(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(query_id, term_id, score)`` for every pair that scores above zero.

    An equal text scores 1, otherwise the Jaccard overlap of singular words. Both are
    found by one equi-join on words, so pairs without a common word never meet.
    """

    def exploded(df: DataFrame, key: str, text: str, size: str) -> DataFrame:
        words = _words(F.col(text))
        whole = F.concat(F.lit("="), _plain(F.col(text)))
        return df.select(key, words.alias("words"), whole.alias("whole")).select(
            key,
            F.size("words").alias(size),
            F.explode(F.concat("words", F.array("whole"))).alias("word"),
        )

    left = exploded(queries.select("query_id", "query"), "query_id", "query", "left_size")
    right = exploded(catalog.select("term_id", "term"), "term_id", "term", "right_size")
    same = F.col("word").startswith("=")
    return (
        left.join(right, "word")
        .groupBy("query_id", "term_id", "left_size", "right_size")
        .agg(
            F.count(F.when(~same, 1)).alias("shared"),
            F.max(F.when(same, 1).otherwise(0)).alias("equal"),
        )
        .select(
            "query_id",
            "term_id",
            F.when(F.col("equal") == 1, F.lit(1.0))
            .otherwise(F.col("shared") / (F.col("left_size") + F.col("right_size") - F.col("shared")))
            .alias("score"),
        )
    )


def rank_hits(scores: DataFrame) -> DataFrame:
    """Rank per query among positive scores; equal scores in catalog order."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "term_id")
    return scores.where("score > 0").withColumn("rank", F.row_number().over(order))


def nearest_vectors(queries: DataFrame, items: DataFrame, k: int = TOP_K, block_values: int = GRID_VALUES) -> DataFrame:
    """The ``k`` most similar items of every query: ``(query_id, item_id, score, rank)``.

    ``queries`` is ``(query_id, vector)``, ``items`` is ``(item_id, vector)``. Tasks pack both
    into blocks of a bounded size, which meet in the cells of a grid: one block of items
    with a few of queries. A cell returns at most ``k`` items per query, and the final
    ranking sees only those. Nothing passes through the driver.
    """
    asked, stock = _packed(queries, "query_id", block_values), _packed(items, "item_id", block_values)
    rows, columns = max(1, stock.count()), max(1, -(-asked.count() // CELL_BLOCKS))
    own = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = min(rows * columns, MOST_TASKS)
    left = stock.withColumn("row", own(rows)).withColumn("column", each(columns)).repartition(tasks, "row", "column")
    right = asked.withColumn("column", own(columns)).withColumn("row", each(rows)).repartition(tasks, "row", "column")

    def best(items_: pd.DataFrame, queries_: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "item_id": [], "score": []}).astype({"query_id": "int64", "item_id": "int64"})]
        for q in queries_.itertuples():
            query_ids, rows_ = _unpacked(q)
            for i in items_.itertuples():
                item_ids, others = _unpacked(i)
                scores = cosine_block(rows_, others)
                top = [np.lexsort((item_ids, -row))[:k] for row in scores]
                at = np.repeat(np.arange(len(top)), [len(t) for t in top])
                which = np.concatenate(top)
                out.append(pd.DataFrame({"query_id": query_ids[at], "item_id": item_ids[which], "score": scores[at, which]}))
        return pd.concat(out)

    found = left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInPandas(
        best, "query_id bigint, item_id bigint, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return found.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _packed(vectors: DataFrame, key: str, values: int) -> DataFrame:
    """Rows of at most about ``values`` numbers: ids and a matrix, packed, and a block number."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            whole, ids = matrix(frame["vector"]), frame[key].to_numpy(dtype="int64")
            step = max(1, values // max(1, whole.shape[1]))
            for at in range(0, len(ids), step):
                part = whole[at : at + step]
                yield pd.DataFrame({"width": [part.shape[1]], "ids": [ids[at : at + step].tobytes()], "vectors": [part.tobytes()]})

    packed = vectors.where(F.col(key).isNotNull()).select(key, "vector").mapInPandas(pack, "width int, ids binary, vectors binary")
    return write_once(packed.withColumn("block", F.monotonically_increasing_id()), "vectors")


def _unpacked(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, dtype="int64")
    return ids, np.frombuffer(row.vectors, dtype="float64").reshape(len(ids), row.width)


def resolve_terms(
    queries: DataFrame,
    catalog: DataFrame,
    k: int = TOP_K,
    rrf_k: int = RRF_K,
    vectors: bool = False,
) -> DataFrame:
    """The best catalog terms of every query by reciprocal rank fusion.

    ``queries`` is ``(query_id, query[, vector])``. With ``vectors`` both sides must
    carry one. Returns ``(query_id, position, term_id, score, ...term columns)``.
    """
    ranks = rank_hits(lexical_scores(queries, catalog))
    if vectors:
        fused = _fuse(queries, catalog, ranks, k, rrf_k)
    else:
        fused = ranks.select("query_id", "term_id", (1.0 / (rrf_k + F.col("rank"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "term_id")
    best = fused.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
    named = catalog.select("term_id", "term", "kind", "entity", "table", "column", "metric")
    return best.join(named, "term_id").withColumn("target", target_label())


def _fuse(queries: DataFrame, catalog: DataFrame, ranks: DataFrame, k: int, rrf_k: int) -> DataFrame:
    """Adds vector ranks to lexical ranks, exactly, for any number of queries.

    A term without a lexical hit can only reach the top ``k`` through one of the first
    ``k`` vector ranks, so those and the lexical hits are the only pairs that leave a
    cell of the grid. The vector rank of such a pair is the number of terms ahead of it,
    counted in a second pass over the cells and added up.
    """
    hits = ranks.groupBy("query_id").agg(F.collect_list("term_id").alias("hits"))
    asked = write_once(queries.select("query_id", "vector").join(hits, "query_id", "left"), "fusion-queries")
    stock = write_once(catalog.select("term_id", "vector"), "fusion-terms")
    pair = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "term_id")
    found = _in_cells(stock, asked, _cell_scores(k), "query_id bigint, term_id bigint, score double, lexical boolean")
    found = found.where("score > 0").withColumn("leader", F.row_number().over(pair)).where(F.col("lexical") | (F.col("leader") <= k))
    found = write_once(found.groupBy("query_id").agg(F.collect_list(F.struct("term_id", "score")).alias("found")), "fusion-found")
    wanted = asked.select("query_id", "vector").join(found, "query_id")
    places = _in_cells(stock, wanted, _cell_ahead, "query_id bigint, term_id bigint, ahead bigint")
    places = places.groupBy("query_id", "term_id").agg((F.sum("ahead") + 1).alias("vector_rank"))
    return (
        ranks.select("query_id", "term_id", "rank")
        .join(places, ["query_id", "term_id"], "full_outer")
        .select(
            "query_id",
            "term_id",
            (
                F.coalesce(1.0 / (rrf_k + F.col("rank")), F.lit(0.0))
                + F.coalesce(1.0 / (rrf_k + F.col("vector_rank")), F.lit(0.0))
            ).alias("score"),
        )
    )


def _in_cells(stock: DataFrame, asked: DataFrame, cell: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``cell(terms, queries)`` for every block of terms with every block of queries, blocks being of a bounded size."""
    size = F.coalesce(F.sum(F.size("vector")), F.lit(0))
    rows = max(1, -(-(stock.agg(size).first()[0]) // GRID_VALUES))
    columns = max(1, -(-(asked.agg(size).first()[0]) // (GRID_VALUES * CELL_BLOCKS)))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = min(rows * columns, MOST_TASKS)
    left = stock.withColumn("row", own("term_id", rows)).withColumn("column", each(columns)).repartition(tasks, "row", "column")
    right = asked.withColumn("column", own("query_id", columns)).withColumn("row", each(rows)).repartition(tasks, "row", "column")
    return left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInPandas(cell, schema)


def _cell_scores(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def scores(terms: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """Cosines of lexical hits and of the cell's best ``k``, per query."""
        out = []
        if len(terms) and len(queries):
            term_ids = terms["term_id"].to_numpy(dtype="int64")
            found = cosine_block(matrix(queries["vector"]), matrix(terms["vector"]), repeatable=True)
            for query_id, row, hits in zip(queries["query_id"], found, queries["hits"]):
                lexical = np.isin(term_ids, np.asarray([] if hits is None else hits, dtype="int64"))
                kept = lexical.copy()
                kept[np.lexsort((term_ids, -row))[:k]] = True
                out += [(query_id, int(term_ids[i]), row[i], bool(lexical[i])) for i in np.flatnonzero(kept)]
        return pd.DataFrame(out, columns=["query_id", "term_id", "score", "lexical"])

    return scores


def _cell_ahead(terms: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """How many terms of the cell rank ahead of each wanted (query, term) pair."""
    out = []
    if len(terms) and len(queries):
        term_ids = terms["term_id"].to_numpy(dtype="int64")
        scores = cosine_block(matrix(queries["vector"]), matrix(terms["vector"]), repeatable=True)
        for query_id, row, found in zip(queries["query_id"], scores, queries["found"]):
            for item in found:
                better = (row > item["score"]) & (term_ids != item["term_id"])
                equal = (row == item["score"]) & (term_ids < item["term_id"])
                out.append((query_id, item["term_id"], int(better.sum() + equal.sum())))
    return pd.DataFrame(out, columns=["query_id", "term_id", "ahead"])


def embed(df: DataFrame, text: str, embedder: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """Adds ``vector`` from any batch embedder, one Arrow batch at a time."""

    @F.pandas_udf("array<float>")
    def encode(batch: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(embedder(batch.tolist()), dtype="float32")))

    return df.withColumn("vector", encode(F.col(text)))


def kept_vectors(
    texts: DataFrame, text: str, embedder: Callable[[list[str]], np.ndarray], folder: str, model: str = "default"
) -> DataFrame:
    """Adds ``vector``, embedding only texts that ``folder`` has no vector of ``model`` for.

    Vectors are stored under a hash of the whole text, so the same text is never embedded
    twice, wherever it turns up. Null texts have null vectors.
    """
    spark, path = texts.sparkSession, f"{folder}/vectors/{model}"
    key = F.sha2(F.col(text), 256)
    new = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), key.alias("key")).dropDuplicates(["key"])
    if written(spark, path):
        new = new.join(spark.read.parquet(path).select("key"), "key", "left_anti")
    new = write_once(new, "new-texts")
    if not new.isEmpty() or not written(spark, path):
        embed(new, "text", embedder).select("key", "vector").write.mode("append").parquet(path)
    stored = spark.read.parquet(path).dropDuplicates(["key"]).withColumnRenamed("key", "__key")
    return texts.join(stored, key == F.col("__key"), "left").drop("__key")


def hashing_vectors(df: DataFrame, text: str, width: int = 256) -> DataFrame:
    """Adds ``vector`` by hashing words; a model-free stand-in for an embedder."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    worded = df.withColumn("__words", _words(F.col(text)))
    hashed = HashingTF(inputCol="__words", outputCol="__hashed", numFeatures=width).transform(worded)
    return hashed.withColumn("vector", vector_to_array("__hashed", "float32")).drop("__words", "__hashed")
