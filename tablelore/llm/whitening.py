"""Whitening of embeddings with distributed block matrices.

Vectors are held as whole numbers, so that sums, means and distances are exact. The
distinct ones, numbered and centred, become the blocks of a matrix; its transpose times
itself is the scatter, whose eigenvectors are worked out on the driver, as it has as many
rows as a vector has components. All rows, again as blocks, times the whitening matrix are
the result. Long tables go through in panels of a bounded number of blocks, since a block
multiplication keeps a list of its blocks on the driver and deals them to only about the
square root of its partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pandas as pd
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelore.session import write_once

#: Bytes of a block; blocks of a panel, and those that a task makes at once; blocks a task multiplies before its sum is handed on.
BLOCK_BYTES, PANEL, BLOCKS_A_TASK, SUMMED = 1 << 19, 1 << 14, 16, 64
#: Components are held to this size, which keeps them exact as floating-point numbers.
LARGEST = 1 << 52
#: Components with less than this part of the largest variance have none: their eigenvalue is round-off.
ROUND_OFF = 1e-12


def whole_vectors(items: DataFrame, scale: int, shift: int, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, x)``: rows whose vectors are finite, in whole numbers."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    held = lambda c: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), scale * c))
    return items.where(finite).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(vector, lambda c: F.floor(held(c)).cast("long") + shift).alias("x")
    )


def _numbered(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with a dense ``index``; written once, partitions shifted by the sizes of those before."""
    kept = write_once(rows.withColumn("id", F.monotonically_increasing_id()), label)
    part = F.shiftright("id", 33)
    sizes = kept.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # one row a partition
    local = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    joined = kept.withColumn("part", part).join(F.broadcast(starts), "part")
    return write_once(joined.select((F.col("start") + local).alias("index"), *rows.columns), f"{label}-numbered")


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension."""
    found = fit.select(F.posexplode("x").alias("d", "value")).groupBy("d").agg(
        F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,0)")).cast("string").alias("s")
    ).collect()  # a row a dimension
    sums = {r["d"]: (r["n"], int(r["s"])) for r in found}
    return sums[0][0], [sums[d][1] for d in range(width)]


class Centre:
    """The exact mean S / n of each dimension, as whole part and rest."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = F.lit([s // n for s in sums])
        self.rest = F.lit([s % n for s in sums])
        self.part = F.lit([float(Fraction(s % n, n)) for s in sums])

    def centred(self, x: Column) -> Column:
        """x - S / n: whole parts leave first, so only the small difference is rounded."""
        return F.zip_with(F.zip_with(x, self.whole, lambda a, q: (a - q).cast("double")), self.part, lambda a, r: a - r)

    def deviation(self, x: Column) -> Column:
        """The sum of (n * x - S) ** 2, exact; null where it is beyond a long."""
        kind = "decimal(38,0)"
        off = F.zip_with(x, self.whole, lambda a, q: F.try_multiply((a - q).cast("decimal(19,0)"), F.lit(self.n).cast("decimal(19,0)")).cast(kind))
        off = F.zip_with(off, self.rest, lambda a, r: F.try_subtract(a, r.cast(kind)).cast("decimal(38,0)"))
        # beyond this the square is no long any more
        off = F.transform(off, lambda a: F.when(F.abs(a) < F.lit(1 << 32).cast(kind), a.cast("decimal(19,0)")))
        total = F.aggregate(off, F.lit(0).cast(kind), lambda t, a: (t + (a * a).cast(kind)).cast(kind))
        return total.try_cast("long")


def _times(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a * b, with the middle dimension cut into ``splits`` parts that tasks multiply and then add up."""
    product = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.rowsPerBlock, b.colsPerBlock)


_BLOCKS = T.StructType([
    T.StructField("at", T.StructType([T.StructField("row", T.LongType()), T.StructField("column", T.LongType())])),
    T.StructField("matrix", MatrixUDT()),
])

_MATRIX = MatrixUDT.sqlType().names


def _height(width: int) -> int:
    """Rows of a block."""
    return max(1, BLOCK_BYTES // (8 * width))


def _panels(rows: DataFrame, n: int, width: int, centre: Centre) -> Iterator[tuple[int, BlockMatrix]]:
    """Blocks of centred rows, a bounded number at a time, and the index of their first row."""
    height = _height(width)

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = np.stack(rows.sort_values("index")["x"].to_list())
        dense = DenseMatrix(len(values), width, values.ravel(), isTransposed=True)
        return pd.DataFrame({"at": [{"row": key[0], "column": 0}], "matrix": [dict(zip(_MATRIX, MatrixUDT().serialize(dense)))]})

    for start in range(0, n, height * PANEL):
        count = min(n - start, height * PANEL)
        tasks = ceil(count / height / BLOCKS_A_TASK)
        panel = rows.where(F.col("index").between(start, start + count - 1))
        number = F.floor((F.col("index") - start) / height).alias("number")
        dealt_rows = panel.select(number, "index", centre.centred(F.col("x")).alias("x")).repartition(tasks, "number")
        # written, as every product reads its blocks several times
        blocks = write_once(dealt_rows.groupBy("number").applyInPandas(block, _BLOCKS), "blocks")
        # a product deals blocks to the square root of so many partitions
        blocks = blocks.repartition(min(64, tasks) ** 2, "at")
        yield start, BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, height, width, count, width), height, width)


def _rows(blocks: BlockMatrix, start: int, height: int) -> DataFrame:
    """``(index, whitened)``: the rows of a block matrix."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, matrix in zip(batch["at"], batch["matrix"]):
                values = MatrixUDT().deserialize([matrix[name] for name in _MATRIX]).toArray()
                yield pd.DataFrame({"index": start + height * at["row"] + np.arange(len(values)), "whitened": list(values)})

    found = callMLlibFunc("getMatrixBlocks", blocks._java_matrix_wrapper._java_model).toDF("at", "matrix")
    at = F.struct(F.col("at._1").cast("long").alias("row"), F.col("at._2").cast("long").alias("column")).alias("at")
    return found.select(at, "matrix").mapInPandas(rows, "index long, whitened array<double>")


def _scatter(blocks: BlockMatrix) -> np.ndarray:
    count = blocks.numRowBlocks
    splits = min(count, max(256, ceil(count / SUMMED)))
    product = _times(blocks.transpose(), blocks, splits).toLocalMatrix().toArray()
    return (product + product.T) / 2


def components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """``(whitening matrix, eigenvalues, trace)`` of the first ``k`` components with any variance."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = int((values > ROUND_OFF * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    k = min(k, real)
    return vectors[:, :k] / np.sqrt(values[:k]), values[:k], float(np.trace(covariance))


def whiten(
    items: DataFrame, k: int = 16, scale: int = 64, shift: int = 0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    A component c of a vector is held as floor(``scale`` * c) + ``shift``. Mean and covariance are
    those of the ``n`` distinct vectors, components are eigenvectors numbered by falling
    eigenvalue from 1. ``deviation`` is the exact sum of (n * x - S) ** 2 over the dimensions,
    null if it is beyond a long; ``explained`` the share of an eigenvalue in the trace;
    ``identity_error`` the largest absolute entry of the covariance of the distinct whitened
    vectors minus the identity.

    Vectors that are null or hold null or non-finite components are left out, as are
    vectors of another length than the commonest. Components are held to
    2 ** 52. Components without variance cannot be whitened and give no rows; so a table
    with fewer than two distinct vectors, and an empty one, gives none. A null id stays null,
    repeated rows each give rows, and other columns play no part.
    """
    spark = items.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = write_once(whole_vectors(items, scale, shift, id_col, vector_col), "vectors")
    lengths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if lengths is None or not lengths["width"]:
        return spark.createDataFrame([], schema)
    width = lengths["width"]
    rows = _numbered(rows.where(F.size("x") == width), "rows")
    fit = _numbered(rows.select("x").distinct(), "fit")
    n, sums = _sums(fit, width)
    centre = Centre(n, sums)
    panels = list(_panels(fit, n, width, centre))
    covariance = sum(_scatter(blocks) for _, blocks in panels) / n
    matrix, values, trace = components(covariance, k)
    found = len(values)
    if not found:
        return spark.createDataFrame([], schema)
    block = ((0, 0), Matrices.dense(width, found, matrix.flatten(order="F").tolist()))
    whitening = BlockMatrix(spark.sparkContext.parallelize([block], 1), width, found, width, found)
    projected = sum(_scatter(_times(blocks, whitening, 1)) for _, blocks in panels) / n
    error = float(np.abs(projected - np.eye(found)).max())

    results = None
    for start, blocks in _panels(rows, rows.count(), width, centre):
        part = _rows(_times(blocks, whitening, 1), start, _height(width))
        results = part if results is None else results.union(part)
    shares = F.lit([float(v / trace) for v in values])
    named = rows.select("index", "vec_id", centre.deviation(F.col("x")).alias("deviation"))
    each = named.join(results, "index").select(
        "vec_id", "deviation", F.posexplode(F.arrays_zip("whitened", shares.alias("explained"))).alias("d", "c")
    )
    return each.select(
        "vec_id", (F.col("d") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), F.lit(error).alias("identity_error"),
    )
