"""Cosine similarity of float vectors.

``cosine`` is a column expression (interpreted lambdas, exact in doubles);
``cosine_to`` scores a column against one query vector in numpy over Arrow
batches, which is what large scans use.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Dot product over norms; 0 if either norm is 0."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(_dot(a, b) / F.nullif(norms, F.lit(0.0)))


def cosine_to(query: Sequence[float]):
    """A vectorised function: similarity of each vector of a column to ``query``."""
    q = np.asarray(query, np.float64)
    q_norm = float(np.sqrt((q * q).sum()))

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype="float64")
        same = all(v is not None and len(v) == len(q) for v in column)
        rows = np.stack(column.to_numpy()).astype(np.float64) if same else None
        if rows is None:  # ragged or null vectors: what both have counts
            rows = np.zeros((len(column), len(q)))
            for i, v in enumerate(column):
                if v is not None:
                    n = min(len(v), len(q))
                    rows[i, :n] = v[:n]
        norms = np.sqrt((rows * rows).sum(axis=1)) * q_norm
        return pd.Series(np.where(norms == 0, 0.0, rows @ q / np.where(norms == 0, 1, norms)))

    return score
