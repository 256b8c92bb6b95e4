"""Exact top-k inner-product search by a three-phase uniform threshold.

The dimensions are split into ``LISTS`` parts; a part's inner products with a query are one
score list, and a vector's score is the sum of its entries. Vectors and queries are packed
into tiles and meet in the cells of a grid, so no task holds more than a bounded block of
either, and all lists of a block are local to its cell.

1. Every cell takes the k best entries of each list, adds up what their vectors score in
   all lists, and sends its k best sums. The k-th best of all sums is a safe cutoff: at
   least k vectors score as much.
2. The cutoff goes back to all cells. A vector can only reach it if it has an entry of at
   least the cutoff divided by the number of lists, so each list gives just those entries.
3. The vectors so collected are scored exactly and those below the cutoff dropped. At most
   k of a cell's vectors are sent for a query, and the best k of all are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablelore.session import write_once

LISTS = 2
#: Bytes of vectors in a tile, and tiles of vectors and of queries in a cell of the grid.
TILE_BYTES = 1 << 19
CELL = (4, 8)
MOST_TASKS = 20_000
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1
_TILE = "n long, dims long, ids binary, matrix binary"


def scaled(vector, scale: float) -> np.ndarray | None:
    """``floor(scale * x)`` of every component; None if the vector is null or not finite throughout."""
    if vector is None:
        return None
    try:
        with np.errstate(over="ignore", invalid="ignore"):
            out = np.floor(scale * np.asarray(vector, dtype=np.float64))
    except TypeError:  # a null among the components
        return None
    return out if out.ndim == 1 and np.isfinite(out).all() else None


def _tiles(vectors: DataFrame, id_col: str, vec_col: str, scale: float, tile_bytes: int) -> DataFrame:
    """``tile`` and the packed ids and scaled vectors of a bounded number of rows."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [(i, v) for i, x in zip(batch["id"].tolist(), batch["vec"]) if (v := scaled(x, scale)) is not None]
            dims = max((len(v) for _, v in good), default=0)
            step = max(1, tile_bytes // (8 * max(1, dims)))
            for k in range(0, len(good), step):
                part = good[k : k + step]
                matrix = np.zeros((len(part), dims))
                for row, (_, v) in zip(matrix, part):
                    row[: len(v)] = v
                ids = np.asarray([i for i, _ in part], dtype=np.int64)
                yield pd.DataFrame({"n": [len(part)], "dims": [dims], "ids": [ids.tobytes()], "matrix": [matrix.tobytes()]})

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null")
    packed = rows.mapInPandas(pack, _TILE).withColumn("tile", F.monotonically_increasing_id())
    return write_once(packed, "vector-tiles")


def _unpack(row, dims: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, dtype=np.int64)
    matrix = np.zeros((row.n, dims))
    matrix[:, : row.dims] = np.frombuffer(row.matrix, dtype=np.float64).reshape(row.n, row.dims)
    return ids, matrix


def _lists(queries: np.ndarray, vectors: np.ndarray) -> list[np.ndarray]:
    """One matrix of entries for each list; exact integers, Python's where doubles would round."""
    size = max(1, np.abs(queries).max(initial=0)) * max(1, np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if size * LISTS >= _EXACT:
        whole = np.frompyfunc(int, 1, 1)
        queries, vectors = whole(queries), whole(vectors)
    cuts = np.array_split(np.arange(queries.shape[1]), LISTS)
    return [queries[:, c] @ vectors[:, c].T if len(c) else np.zeros((len(queries), len(vectors))) for c in cuts]


def _meetings(vectors: pd.DataFrame, queries: pd.DataFrame):
    """Every tile of queries against every tile of vectors, the query's own vector set to minus infinity."""
    if vectors.empty or queries.empty:
        return
    dims = int(max(vectors["dims"].max(), queries["dims"].max()))
    for q in queries.itertuples():
        q_ids, q_matrix = _unpack(q, dims)
        yield q, q_ids, (_meeting(q_ids, q_matrix, *_unpack(v, dims)) for v in vectors.itertuples())


def _meeting(q_ids, q_matrix, v_ids, v_matrix):
    parts = _lists(q_matrix, v_matrix)
    own = q_ids[:, None] == v_ids[None, :]
    if own.any():
        parts = [np.where(own, -np.inf, p) for p in parts]
    return v_ids, parts


def _largest(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    if scores.dtype == object:
        return np.argsort(scores, axis=1)[:, -k:]
    return np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:]


def _as_long(values) -> np.ndarray:
    return np.asarray([max(-_LONG - 1, min(_LONG, int(v))) for v in values], dtype=np.int64)


def _gather(k: int):
    """First phase in one cell: the k best sums among the leaders of the lists."""

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q, q_ids, tiles in _meetings(vectors, queries):
            best = np.empty((len(q_ids), 0))
            for _, parts in tiles:
                at = np.sort(np.concatenate([_largest(p, k) for p in parts], axis=1), axis=1)
                sums = sum(np.take_along_axis(p, at, axis=1) for p in parts)
                sums[:, 1:][at[:, 1:] == at[:, :-1]] = -np.inf
                best = np.concatenate((best, sums), axis=1)
                best = np.take_along_axis(best, _largest(best, k), axis=1)
            row, col = np.nonzero(best > -np.inf)
            out.append(pd.DataFrame({"tile": q.tile, "place": row, "total": _as_long(best[row, col])}))
        return pd.concat(out) if out else pd.DataFrame({"tile": [], "place": [], "total": []}, dtype="int64")

    return run


def _resolve(k: int):
    """Second and third phase in one cell: entries above the cutoff's share, then exact scores."""

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["tile", "place", "query_id", "vec_id", "score"]
        out = [pd.DataFrame({n: [] for n in names}, dtype="int64")]
        for q, q_ids, tiles in _meetings(vectors, queries):
            cutoff = np.full(len(q_ids), -np.inf, dtype=object)
            for place, value in zip(q.places, q.cutoffs):
                cutoff[place] = int(value)
            found = []
            for v_ids, parts in tiles:
                exact = parts[0].dtype == object
                least = cutoff if exact else cutoff.astype(np.float64)
                enough = np.zeros(parts[0].shape, dtype=bool)
                for p in parts:
                    enough |= (p * LISTS >= least[:, None]).astype(bool) & (p > -np.inf).astype(bool)
                row, col = np.nonzero(enough)
                totals = sum(p[row, col] for p in parts)
                keep = np.flatnonzero((totals >= least[row]).astype(bool))
                found.append(pd.DataFrame({"place": row[keep], "vec_id": v_ids[col[keep]], "score": _as_long(totals[keep])}))
            table = pd.concat(found).sort_values(["place", "score", "vec_id"], ascending=[True, False, True])
            table = table[table.groupby("place").cumcount() < k]
            out.append(table.assign(tile=q.tile, query_id=q_ids[table["place"].to_numpy()])[names])
        return pd.concat(out)

    return run


def top_k(
    items: DataFrame,
    queries: DataFrame,
    k: int,
    scale: float = 64.0,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    tile_bytes: int = TILE_BYTES,
    cell: tuple[int, int] = CELL,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k items of highest score for every row of ``queries``.

    Components become ``floor(scale * x)``; the score is their integer inner product, held
    at the limits of a long. Ties go to the smaller id. Items with the query's own id are
    no candidates. All are returned where there are fewer than k.

    Vectors that are null, or hold a null or a component that is not finite, take no part
    on either side, nor do rows without an id. A shorter vector counts as filled up with
    zeros. Repeated rows of ``items`` are candidates each; each repeated row of ``queries``
    gets its own list. Empty tables give an empty result. Other columns play no part,
    whatever their names.
    """
    vectors = _tiles(items, id_col, vec_col, scale, tile_bytes)
    asked = _tiles(queries, id_col, vec_col, scale, tile_bytes)
    rows, columns = (max(1, -(-tiles.count() // most)) for tiles, most in zip((vectors, asked), cell))

    def numbered(tiles: DataFrame, groups: int) -> DataFrame:
        """Tiles dealt evenly to the groups: partitions count from zero, and so do tiles in them."""
        return tiles.withColumn("group", F.pmod(F.col("tile") + F.shiftright("tile", 33), F.lit(groups)))

    def spread(tiles: DataFrame, own: int, other: int, flat) -> DataFrame:
        return numbered(tiles, own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(other - 1)))).withColumn("cell", flat)

    left = spread(vectors, rows, columns, F.col("group") * columns + F.col("other"))
    cells = min(rows * columns, MOST_TASKS)
    left = left.repartition(cells, "cell").groupBy("cell")

    def meet(tiles: DataFrame, work, schema: str) -> DataFrame:
        right = spread(tiles, columns, rows, F.col("other") * columns + F.col("group"))
        return left.cogroup(right.repartition(cells, "cell").groupBy("cell")).applyInPandas(work, schema)

    sums = meet(asked, _gather(k), "tile long, place long, total long")
    leaders = Window.partitionBy("tile", "place").orderBy(F.desc("total"))
    kth = sums.withColumn("rank", F.row_number().over(leaders)).where(F.col("rank") <= k).where(F.col("rank") == k)
    cutoffs = kth.groupBy("tile").agg(F.collect_list(F.struct("place", "total")).alias("cut"))
    told = asked.join(cutoffs, "tile", "left").select(
        "tile", "n", "dims", "ids", "matrix",
        F.coalesce(F.col("cut.place"), F.array().cast("array<long>")).alias("places"),
        F.coalesce(F.col("cut.total"), F.array().cast("array<long>")).alias("cutoffs"),
    )
    told = write_once(told, "query-tiles")
    found = meet(told, _resolve(k), "tile long, place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("tile", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
