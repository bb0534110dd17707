"""Balancing weights by class and by combination of two labels, and value counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegralType, StringType

#: Combinations of labels up to which their weights are a table in the plan.
FEW = 10_000


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Each distinct value with its count and its place among the sorted values."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("count"))
    return counts.withColumn("code", F.row_number().over(Window.orderBy(*columns)).cast("bigint") - 1)  # one row a value


def class_inverse_frequency(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``weight`` = 1 / count of the row's class; null labels have no weight.

    Counts are aggregated and joined back, which a hot class cannot skew as a window would.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("_label")).agg((1.0 / F.count("*")).alias("weight"))
    return df.join(counts, F.col(label) == F.col("_label"), "left").drop("_label")


def combination_weights(df: DataFrame, *labels: str, baseline: float = 1000.0) -> DataFrame:
    """``df`` with ``weight`` = n / (K * (count + baseline)), scaled so that all weights sum to n.

    K is the number of combinations that occur. A null is a label of its own; an empty table stays
    empty.
    """
    if baseline < 0:
        raise ValueError("baseline must not be negative")
    counts = df.groupBy(*[F.col(c).alias(f"_{c}") for c in labels]).agg(F.count("*").alias("_n"))
    raw = counts.withColumn("_raw", 1.0 / (F.col("_n") + F.lit(float(baseline))))
    # n / K falls out of the scaling: weight = raw * n / sum(count * raw)
    sums = raw.agg(F.sum("_n").alias("_all"), F.sum(F.col("_n") * F.col("_raw")).alias("_mass"))
    scaled = raw.crossJoin(F.broadcast(sums)).select(*[f"_{c}" for c in labels], (F.col("_raw") * F.col("_all") / F.col("_mass")).alias("weight"))  # one row
    if all(isinstance(df.schema[c].dataType, (StringType, IntegralType, BooleanType)) for c in labels):
        # a table of few combinations is made once: it neither moves the rows nor counts them anew with each use
        few = scaled.limit(FEW + 1).collect()
        if len(few) <= FEW:
            scaled = F.broadcast(df.sparkSession.createDataFrame(few, scaled.schema))
    on = None
    for c in labels:
        same = df[c].eqNullSafe(scaled[f"_{c}"])
        on = same if on is None else on & same
    return df.join(scaled, on).drop(*[f"_{c}" for c in labels])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``combination_weights`` of one label without a baseline."""
    return combination_weights(df, label, baseline=0.0)


def weight_stats(df: DataFrame, weight: str = "weight") -> DataFrame:
    return df.agg(F.min(weight).alias("min_weight"), F.max(weight).alias("max_weight"), F.avg(weight).alias("mean_weight"))
