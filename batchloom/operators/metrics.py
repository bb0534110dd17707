"""Minibatch entropy, classification scores, throughput and summaries of runs."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batch_entropy(df: DataFrame, label: str, batch: str = "_batch") -> DataFrame:
    """(batch, n, entropy): base-2 entropy of the label in each minibatch of more than one row."""
    counts = df.groupBy(batch, label).agg(F.count("*").alias("_c"))
    sums = counts.groupBy(batch).agg(F.sum("_c").alias("n"), F.sum(F.col("_c") * F.log2("_c")).alias("_s"))
    return sums.where("n > 1").select(batch, "n", F.abs(F.log2("n") - F.col("_s") / F.col("n")).alias("entropy"))


def entropy_summary(df: DataFrame, label: str, batch: str = "_batch") -> DataFrame:
    """Mean and population std over the minibatches, 0 without any."""
    per = batch_entropy(df, label, batch)
    return per.agg(F.coalesce(F.avg("entropy"), F.lit(0.0)).alias("avg_batch_entropy"), F.coalesce(F.stddev_pop("entropy"), F.lit(0.0)).alias("std_batch_entropy"), F.count("*").alias("n_batches"))


def accuracy(df: DataFrame, target: str, predicted: str) -> Column:
    return F.avg((F.col(target) == F.col(predicted)).cast("double"))


def f1_scores(df: DataFrame, target: str, predicted: str) -> DataFrame:
    """One row: accuracy, macro and support-weighted F1 over the classes of either column; 0 / 0 is 0."""
    cells = df.groupBy(F.col(target).alias("_t"), F.col(predicted).alias("_p")).agg(F.count("*").alias("_n"))
    hit = F.when(F.col("_t") == F.col("_p"), F.col("_n")).otherwise(0)
    ends = cells.select(F.explode(F.array(F.struct(F.col("_t").alias("c"), hit.alias("tp"), F.lit(0).cast("bigint").alias("pp"), F.col("_n").alias("sup")), F.struct(F.col("_p").alias("c"), F.lit(0).cast("bigint").alias("tp"), F.col("_n").alias("pp"), F.lit(0).cast("bigint").alias("sup")))).alias("e")).select("e.*")
    by = ends.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("tp", "pp", "sup")])
    f1 = F.when(F.col("pp") + F.col("sup") > 0, 2.0 * F.col("tp") / (F.col("pp") + F.col("sup"))).otherwise(0.0)
    return by.withColumn("f1", f1).agg((F.sum("tp") / F.sum("sup")).alias("accuracy"), F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("sup")) / F.sum("sup")).alias("f1_weighted"))


def run_summary(results: DataFrame, *by: str, value: str = "value", status: str | None = None) -> DataFrame:
    """Mean, sample std (0 for a single run) and count over runs; with ``status`` failed runs are left out."""
    rows = results.where(F.col(status) != "failed") if status else results
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count("*").alias("n_runs"))


def pivot_results(summary: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """``row`` by ``column``; naming the columns spares a pass for their distinct values."""
    return summary.groupBy(row).pivot(column, columns).agg(F.first(value))


def best_per_task(summary: DataFrame, task: str, method: str, value: str) -> DataFrame:
    """The method of greatest value of each task; of equal ones the first by name."""
    best = F.min_by(F.struct(F.col(method).alias("m"), F.col(value).alias("v")), F.struct((-F.col(value)).alias("o"), F.col(method).alias("m")))
    return summary.groupBy(task).agg(best.alias("b")).select(task, F.col("b.m").alias(method), F.col("b.v").alias(value))


def melt(wide: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """Wide to long; a missing score counts 0."""
    return wide.unpivot(ids, columns, name, value).withColumn(value, F.coalesce(value, F.lit(0.0)))


def axis_limits(df: DataFrame, value: str, pad: float = 0.05, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Minimum and maximum with a share of their range around, held within bounds."""
    span = F.col("_b") - F.col("_a")
    return df.agg(F.min(value).alias("_a"), F.max(value).alias("_b")).select(F.greatest(F.col("_a") - span * pad, F.lit(low)).alias("axis_low"), F.least(F.col("_b") + span * pad, F.lit(high)).alias("axis_high"))


def throughput(df: DataFrame, warm_up: float = 0.0, duration: float = 120.0) -> dict[str, float]:
    """Rows a second that reach the driver batch by batch, after ``warm_up`` seconds, for ``duration`` at most."""
    began, rows, start = time.monotonic(), 0, None
    for _ in df.toLocalIterator(prefetchPartitions=True):
        now = time.monotonic()
        if start is None and now - began >= warm_up:
            start = now
        if start is not None:
            rows += 1
            if now - start >= duration:
                break
    elapsed = time.monotonic() - (start or began)
    return {"samples_tested": rows, "elapsed": elapsed, "samples_per_second": rows / elapsed if elapsed else 0.0, "seconds_per_sample": elapsed / rows if rows else 0.0}
