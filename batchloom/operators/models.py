"""Scores of linear heads and their loss, for batches that a trainer has scored; training by MLlib."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def softmax(logits: str) -> Column:
    """Probabilities of an array of logits, stable for large ones."""
    shifted = lambda xs: F.transform(xs, lambda x: F.exp(x - F.array_max(logits)))
    return F.element_at(F.transform(F.array(shifted(F.col(logits))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))), 1)


def predict(logits: str) -> Column:
    """The index of the greatest logit, the first of equal ones."""
    return (F.array_position(F.col(logits), F.array_max(logits)) - 1).cast("bigint")


def linear_logits(xs: str, weights: list[list[float]], bias: list[float]) -> Column:
    """One logit a class; a few hundred weights stand in the plan, more belong into MLlib."""
    dot = lambda w: F.aggregate(F.zip_with(xs, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return F.array(*[dot(w) + F.lit(float(b)) for w, b in zip(weights, bias, strict=True)])


def multitask_loss(df: DataFrame, tasks: dict[str, tuple[str, str, float]]) -> DataFrame:
    """One row: the mean cross-entropy of each task (target, probabilities, weight) and their weighted sum."""
    losses = {name: F.avg(-F.log(F.element_at(F.col(p), (F.col(t) + 1).cast("int")))) for name, (t, p, _) in tasks.items()}
    total = None
    for name, (_, _, w) in tasks.items():
        total = w * losses[name] if total is None else total + w * losses[name]
    return df.agg(*[loss.alias(f"loss_{name}") for name, loss in losses.items()], total.alias("loss"))


def fit_heads(df: DataFrame, xs: str, targets: list[str], **kwargs) -> dict:
    """One MLlib logistic regression a task on the same features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("_features", array_to_vector(F.transform(xs, lambda x: x.cast("double"))))
    return {t: LogisticRegression(featuresCol="_features", labelCol=t, predictionCol=f"{t}_predicted", probabilityCol=f"{t}_p", rawPredictionCol=f"{t}_raw", **kwargs).fit(rows) for t in targets}
