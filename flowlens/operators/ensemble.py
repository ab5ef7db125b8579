"""Voting and weighted ensembles over per-model probability arrays (EN1, EN2, EN4).

Each model's scores arrive as a column (``prob_<model>``: array of class probabilities in
class order).  Combining them is pure array arithmetic inside one projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def argmax(arr: Column) -> Column:
    """Index of the first largest element (ties -> lowest index)."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def soft_vote(df: DataFrame, prob_cols: list[str], out: str = "soft_vote") -> DataFrame:
    """EN1: mean probability per class, then argmax."""
    n = float(len(prob_cols))
    summed = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [F.col(c) for c in prob_cols])
    mean = F.transform(summed, lambda x: x / n)
    return df.withColumn(f"{out}_probs", mean).withColumn(out, argmax(F.col(f"{out}_probs")))


def hard_vote(df: DataFrame, pred_cols: list[str], n_classes: int, out: str = "hard_vote") -> DataFrame:
    """EN2: majority of the models' predicted classes; ties -> lowest class."""
    votes = F.array(*[sum((F.col(p) == F.lit(k)).cast("int") for p in pred_cols) for k in range(n_classes)])
    return df.withColumn(out, argmax(votes))


def weighted_vote(df: DataFrame, prob_cols: list[str], weights: list[float] | None = None,
                  classes: list | None = None, out: str = "weighted_vote") -> DataFrame:
    """EN4: sum_i w_i * p_i / n_models, argmax, mapped back to the class value.

    Equal weights by default.  For a model without probabilities pass its one-hot
    prediction array (``one_hot_prediction``).
    """
    n = len(prob_cols)
    weights = weights or [1.0 / n] * n
    def times(w: float):
        return lambda x: x * F.lit(w)

    scaled = [F.transform(F.col(c), times(w)) for c, w in zip(prob_cols, weights)]
    summed = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), scaled)
    mean = F.transform(summed, lambda x: x / F.lit(float(n)))
    idx = argmax(mean)
    if classes is not None:
        cls = F.array(*[F.lit(c) for c in classes])
        return df.withColumn(out, F.element_at(cls, idx + 1))
    return df.withColumn(out, idx)


def one_hot_prediction(pred: Column, n_classes: int) -> Column:
    """EN4: a hard prediction as a probability-like one-hot array."""
    return F.array(*[(pred == F.lit(k)).cast("double") for k in range(n_classes)])
