"""Integer vectors from columns of numbers, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integers(df: DataFrame, key: str, vector: str, *more: str, scale: int = 256) -> DataFrame:
    """id, x and the other named columns of the rows whose vector has finite entries alone; x: floor(scale * entry) of each entry, as a double."""
    whole = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c.cast("double")))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale))
    return df.where(F.col(vector).isNotNull() & whole).select(F.col(key).cast("long").alias("id"), x.alias("x"), *more)


def stacked(x: pd.Series, d: int) -> np.ndarray:
    """Vectors as rows of length d; a shorter vector goes on with zeros."""
    out = np.zeros((len(x), d), np.int64)
    for i, v in enumerate(x):
        out[i, : len(v)] = v
    return out
