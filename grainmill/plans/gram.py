"""Sums of products of all pairs of columns in one pass."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram_matrix(df: DataFrame, columns: list[Column]) -> np.ndarray:
    """``sum(a * b)`` for each two of the columns, none of which may be missing.

    Each task adds its rows' products to one triangle of the matrix, and the
    triangles are added up as a tree, all on the JVM: the rows are read once,
    whatever the number of columns. The matrix reaches the driver.
    """
    rows = df.select(array_to_vector(F.array(*columns)).alias("row"))
    rows = MLUtils.convertVectorColumnsFromML(rows, "row")
    return RowMatrix(rows, numCols=len(columns)).computeGramianMatrix().toArray()


def standardized(values: Column, mean: float | None, deviation: float | None) -> Column:
    """Distances from the mean in deviations, 0 for missing ones and for constant columns."""
    if not deviation:
        return F.lit(0.0)
    return F.coalesce((values - F.lit(mean)) / F.lit(deviation), F.lit(0.0))
