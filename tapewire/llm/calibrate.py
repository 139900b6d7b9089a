"""Probabilities from scores by isotonic regression over counted bins."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of the raw score; the counts of these, not the rows, reach the driver.
BINS = 2000


def folds(id_: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out. A null id is in fold 1."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(5)), F.lit(1)).cast("int")


def labels_of(labels: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """One label for each id (label_id, label): the mean where there are several; null ids and labels are left out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(column).isNotNull())
    return known.groupBy(F.col(id_col).cast("long").alias("label_id")).agg(F.avg(F.col(column).cast("double")).alias("label"))


def pool(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The non-decreasing means closest to ``y`` with weights ``n``: adjacent violators are pooled."""
    means, weights, sizes = [], [], []
    for value, weight in zip(y.tolist(), n.tolist(), strict=True):
        means.append(value)
        weights.append(weight)
        sizes.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            w = weights[-2] + weights[-1]
            means[-2:] = [(means[-2] * weights[-2] + means[-1] * weights[-1]) / w]
            weights[-2:] = [w]
            sizes[-2:] = [sizes[-2] + sizes[-1]]
    return np.repeat(means, sizes)


def isotonic(rows: DataFrame, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots (raw, probability) of a rising curve through rows with columns raw and label.

    Each bin counts half a row of either label besides its own, so that no score is certain on few rows.
    Between knots the curve is straight. Without rows it is 0.5 everywhere.
    """
    place = F.least(F.greatest(F.floor((F.col("raw") - low) / (high - low) * BINS), F.lit(0)), F.lit(BINS - 1))
    counted = rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"), F.avg("raw").alias("raw")).orderBy("bin").collect()
    if not counted:
        return np.array([low, high]), np.array([0.5, 0.5])
    n, y, raw = (np.array([float(r[c]) for r in counted]) for c in ("n", "y", "raw"))
    fitted = pool(y / n, n)
    blocks = np.flatnonzero(np.concatenate([[True], fitted[1:] != fitted[:-1]]))
    total = np.add.reduceat(n, blocks)
    p = (np.add.reduceat(y, blocks) + 0.5) / (total + 1)
    first, last = raw[blocks], raw[np.append(blocks[1:], len(raw)) - 1]
    x = np.stack([first, last], axis=1).ravel()
    return x, np.maximum.accumulate(np.repeat(p, 2))
