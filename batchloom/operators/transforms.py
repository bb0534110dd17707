"""Column transforms of rows and minibatches, and hooks for user functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.functions.rng import hash_unit

EPS = 1e-8


def sparse_to_dense(ids: str, values: str, size: int) -> Column:
    """An ARRAY<FLOAT> of ``size`` with values at ids and 0 elsewhere; of a repeated id the last value counts.

    The map look-up is linear in the row's entries, which suits short rows; ``densify`` scatters.
    """
    at = lambda i: F.array_position(F.reverse(ids), i)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.when(at(i) > 0, F.element_at(F.reverse(values), at(i).cast("int"))), F.lit(0.0)).cast("float"))


def densify(df: DataFrame, ids: str, values: str, size: int, name: str = "x") -> DataFrame:
    """The same by one scatter an Arrow batch, for rows of tens of thousands of features."""
    at, to = df.columns.index(ids), df.columns.index(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                genes, xs = batch.column(at), batch.column(to)
                n = genes.value_lengths().fill_null(0).to_numpy()
                out = np.zeros((batch.num_rows, size), np.float32)
                out[np.repeat(np.arange(batch.num_rows), n), genes.flatten().to_numpy()] = xs.flatten().to_numpy()
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * size)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))]))


def log1p(xs: str) -> Column:
    return F.transform(xs, lambda x: F.log1p(x))


def _moments(xs: Column, sample: bool) -> tuple[Column, Column]:
    n = F.size(xs)
    mean = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / n
    square = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x * x)
    return mean, F.sqrt(F.greatest((square - n * mean * mean) / (n - 1 if sample else n), F.lit(0.0)))


def normalise_sample(xs: str, sample: bool = True, eps: float = EPS) -> Column:
    """Each row's z-scores over its own features; ``sample`` divides by n - 1."""
    wide = F.transform(xs, lambda x: x.cast("double"))

    def scale(s: Column) -> Column:
        mean, std = _moments(s, sample)
        stats = F.struct(mean.alias("mean"), std.alias("std"))
        return F.element_at(F.transform(F.array(stats), lambda m: F.transform(s, lambda x: (x - m["mean"]) / (m["std"] + eps))), 1)

    return F.element_at(F.transform(F.array(wide), scale), 1)


def normalise_batch(value: str, batch: str = "_batch") -> Column:
    """(x - mean) / population std over the minibatch; batches are small, so the window is."""
    window = Window.partitionBy(batch)
    return (F.col(value) - F.avg(value).over(window)) / F.stddev_pop(value).over(window)


def standardise_features(df: DataFrame, xs: str, batch: str = "_batch", sample: bool = False, eps: float = EPS) -> DataFrame:
    """``df`` with ``xs`` as z-scores by feature within the minibatch (population or sample std)."""
    flat = df.select(batch, F.posexplode(xs).alias("_i", "_x"))
    std = F.stddev_samp("_x") if sample else F.stddev_pop("_x")
    stats = flat.groupBy(batch, "_i").agg(F.avg("_x").alias("_m"), F.coalesce(std, F.lit(0.0)).alias("_s"))
    packed = stats.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("_i", "_m", "_s"))).alias("_stats"))
    return df.join(packed, batch).withColumn(xs, F.zip_with(xs, "_stats", lambda x, s: (x - s["_m"]) / (s["_s"] + eps))).drop("_stats")


def noise(xs: str, scale: float, seed: int, *key: str) -> Column:
    """Gaussian noise by Box-Muller over keyed hashes, so a retry adds the same."""

    def one(x: Column, i: Column) -> Column:
        u, v = hash_unit(seed, 0, "n1", *key, i), hash_unit(seed, 0, "n2", *key, i)
        return x + scale * F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * v)

    return F.transform(xs, one)


def dropout(xs: str, rate: float, seed: int, *key: str) -> Column:
    """Features set to 0 with probability ``rate``, by keyed hashes."""
    return F.transform(xs, lambda x, i: F.when(hash_unit(seed, 0, "p", *key, i) > rate, x).otherwise(F.lit(0.0)))


def collate(df: DataFrame, *columns: str, batch: str = "_batch", slot: str = "_slot") -> DataFrame:
    """One row a minibatch: each column as a list in the order of the slots. A batch is bounded by its size."""
    rows = F.array_sort(F.collect_list(F.struct(slot, *columns)))
    return df.groupBy(batch).agg(rows.alias("_rows")).select(batch, *[F.col(f"_rows.{c}").alias(c) for c in columns])


def per_group(df: DataFrame, key: str, function: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """A user function once for each fetch or batch (``key``), rows in the order of their slots."""
    order = [c for c in ("_lpos", "_slot", "_idx") if c in df.columns][:1]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return function(pdf.sort_values(order, ignore_index=True) if order else pdf)

    return df.groupBy(key).applyInPandas(run, schema)


def hooks(df: DataFrame, *, fetch_callback=None, fetch_transform=None, batch_callback=None, batch_transform=None) -> DataFrame:
    """User hooks in the order fetch callback, fetch transform, batch callback, batch transform.

    Each is a pair (function of a pandas frame, schema of what it returns). Fetch hooks see one
    _fetch, batch hooks one _batch; what a fetch hook returns needs _batch where one follows.
    """
    for key, hook in (("_fetch", fetch_callback), ("_fetch", fetch_transform), ("_batch", batch_callback), ("_batch", batch_transform)):
        if hook is not None:
            df = per_group(df, key, *hook)
    return df
