"""Subsets and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.functions.rng import hash_hex
from batchloom.plans.ordinal import rank_by_hash, with_ordinal


def split_random(df: DataFrame, key: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """``df`` with ``is_test``: ceil(share * n) rows exactly, by the rank of a keyed hash."""
    n = df.count()
    ranked = rank_by_hash(df.select(key), hash_hex(seed, 0, "split", key), key, "_r").select(F.col(key).alias("_k"), (F.col("_r") < F.ceil(F.lit(share * n))).alias("is_test"))
    return df.join(ranked, df[key] == ranked["_k"]).drop("_k")


def split_stratified(df: DataFrame, key: str, stratum: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """The same in each stratum, nulls being one; ranks inside a stratum are differences of global ranks."""
    rows = df.select(F.col(key).alias("_k"), F.col(stratum).alias("_g"), hash_hex(seed, 0, "split", key).alias("_h"))
    ranked = with_ordinal(rows, "_g", "_h", "_k", name="_r")
    sizes = ranked.groupBy("_g").agg(F.min("_r").alias("_first"), F.count("*").alias("_n")).withColumnRenamed("_g", "_g2")
    marked = ranked.join(sizes, F.col("_g").eqNullSafe(F.col("_g2"))).select("_k", (F.col("_r") - F.col("_first") < F.ceil(F.col("_n") * F.lit(share))).alias("is_test"))
    return df.join(marked, df[key] == F.col("_k")).drop("_k")


def first_n(df: DataFrame, n: int, *order_by: str) -> DataFrame:
    """The first n rows in order (all, if there are no more)."""
    return with_ordinal(df, *order_by, name="_first").where(F.col("_first") < n).drop("_first")


def split_by_group(df: DataFrame, group: Column, train: list, test: list) -> DataFrame:
    """``df`` with ``split``: 'train' or 'test' by the value of ``group``; other rows go."""
    return df.withColumn("split", F.when(group.isin(train), "train").when(group.isin(test), "test")).where(F.col("split").isNotNull())
