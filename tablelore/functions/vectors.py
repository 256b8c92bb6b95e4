"""Vector similarity: a column expression and a block kernel used inside tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(left: Column, right: Column) -> Column:
    """Cosine over the shared prefix of two float arrays; 0 for a zero vector."""
    size = F.least(F.size(left), F.size(right))
    a, b = F.slice(left, F.lit(1), size), F.slice(right, F.lit(1), size)

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def matrix(vectors, width: int | None = None) -> np.ndarray:
    """Arrays of floats as one matrix of doubles, short ones padded with zeros."""
    rows = [np.asarray(v if v is not None else [], dtype="float64") for v in vectors]
    width = max([len(r) for r in rows] or [0]) if width is None else width
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        n = min(len(row), width)
        out[i, :n] = row[:n]
    return out


def cosine_block(rows: np.ndarray, others: np.ndarray, repeatable: bool = False) -> np.ndarray:
    """All cosines between two blocks; 0 where either vector is zero.

    ``repeatable`` gives a pair the same last bit whatever else is in its blocks, which
    a matrix product does not promise.
    """
    width = min(rows.shape[1], others.shape[1])
    a, b = rows[:, :width], others[:, :width]
    dots = np.einsum("ik,jk->ij", a, b) if repeatable else a @ b.T
    norms = np.outer(np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1)))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms == 0, 0.0, dots / norms)
