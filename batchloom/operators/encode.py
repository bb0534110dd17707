"""Label encoding by look-up, and fitted encoders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def encode_labels(df: DataFrame, maps: list[tuple[str, DataFrame, str, str, str]], check: bool = True) -> DataFrame:
    """``df`` with one new column for each (column, map, key, value, new) in turn.

    A later look-up may use a column that an earlier one made (name to id to class of the id). With
    ``check`` a value without an entry raises KeyError; else its rows go, as in an inner join.
    Maps are joined without a hint: small ones are broadcast by their size, large ones shuffled.
    """
    for column, table, key, value, new in maps:
        side = table.select(F.col(key).alias("_key"), F.col(value).alias(new))
        if check:
            lost = df.join(side, F.col(column) == F.col("_key"), "left_anti").select(column).limit(1).collect()
            if lost:
                raise KeyError(f"{column}: no entry for {lost[0][0]!r}")
        df = df.join(side, F.col(column) == F.col("_key")).drop("_key")
    return df


def fit_encoder(df: DataFrame, label: str) -> DataFrame:
    """(label, code): sorted distinct values to 0, 1, ..."""
    values = df.select(label).where(F.col(label).isNotNull()).distinct()
    return values.withColumn("code", F.row_number().over(Window.orderBy(label)).cast("bigint") - 1)  # one row a value


def task_dimensions(**columns: tuple[DataFrame, str]) -> DataFrame:
    """One row with the number of distinct values of each named (table, column)."""
    out = None
    for name, (table, column) in columns.items():
        one = table.agg(F.count_distinct(column).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out
