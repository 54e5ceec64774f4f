"""Bounded top-k: as a window over rows, and as a kernel over a distance matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, by: str, k: int, *order, name: str = "rank") -> DataFrame:
    """The k first rows of each group, ranked from 1. Spark limits each task's groups before the shuffle."""
    window = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def smallest(distances: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k smallest (distance, id) of each row of a matrix, in that order; ``inf`` doesn't count."""
    if distances.shape[1] > k:
        limit = np.partition(distances, k - 1, axis=1)[:, k - 1 : k]
        row, column = np.nonzero((distances <= limit) & (distances < np.inf))
    else:
        row, column = np.nonzero(distances < np.inf)
    keep = first_of(row, distances[row, column], ids[column], k)
    return row[keep], column[keep]


def first_of(row: np.ndarray, distances: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest (distance, id) of each row, in the order of rows, distances and ids."""
    order = np.lexsort((ids, distances, row))
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row) < k]
