"""Global ranks and running sums without a single-task window over the data.

A rank is an offset a range plus a rank inside the range. Ranges of a hash are its leading digits;
ranges of a key are bounded by keys of a hash-chosen sample; either way one narrow shuffle moves
the rows and the offsets, one a range and ``RANGES`` at most, are broadcast or stand in the plan.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Rows up to which one window task is the cheaper plan.
SMALL = 200_000
#: Ranges at most: beyond that the ranges grow with the data, not their number.
RANGES = 1 << 16


def place(value: Column, cuts: list, literal=F.lit) -> Column:
    """How many of the ascending ``cuts`` are at or below ``value``, by bisection: a row is compared with log2(n) of them."""
    if not cuts:
        return F.lit(0)
    listed = F.array(*map(literal, cuts))
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    beyond = lambda at, step: (at + step <= len(cuts)) & (F.get(listed, at + step - 1) <= value)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(beyond(at, step), at + step).otherwise(at))


def looked_up(numbers: list[int], at: Column) -> Column:
    """``numbers[at]`` as a BIGINT, from one literal."""
    return F.get(F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>"), at)


def _offsets(ranged: DataFrame, value: Column, sum_: str) -> DataFrame:
    """(_range, _before): ``value`` summed over all earlier ranges. One row a range."""
    sums = ranged.groupBy("_range").agg(F.sum(value).alias(sum_))
    window = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_range", F.coalesce(F.sum(sum_).over(window), F.lit(0)).cast("bigint").alias("_before"))


def _ranked(ranged: DataFrame, order: list[Column], name: str) -> DataFrame:
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("bigint") - 1
    offsets = _offsets(ranged.select("_range"), F.lit(1), "_n")
    return ranged.withColumn(name, inside).join(F.broadcast(offsets), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def rank_by_hash(df: DataFrame, hash_: Column, tie: str, name: str, n: int = 1 << 24) -> DataFrame:
    """``df`` (about ``n`` rows) with ``name``: the 0-based rank by (hash_, tie). Ranges are by one to four hex digits."""
    digits = min(4, max(1, (max(1, n // 50_000).bit_length() + 3) // 4))
    ranged = df.withColumn("_hash", hash_).withColumn("_range", F.substr("_hash", F.lit(1), F.lit(digits)))
    return _ranked(ranged, [F.col("_hash"), F.col(tie)], name).drop("_hash")


def _cuts(df: DataFrame, order_by: list[str], n: int, ranges: int) -> list:
    keep = F.pmod(F.xxhash64(*order_by), F.lit(max(1, n // (ranges * 16)))) == 0
    rows = df.select(*order_by).where(keep).dropDuplicates(order_by).orderBy(*order_by).limit(64 * ranges).collect()
    step = max(1, len(rows) // ranges)
    return rows[step::step]


def _dense(df: DataFrame, key: str, n: int, least: int, most: int, mark: int) -> bool:
    """Whether the whole numbers ``key`` are all of least..most, once each: told by their number, and by a fingerprint should one repeat."""
    if most - least + 1 != n:
        return False
    return df.sparkSession.range(least, most + 1).agg(F.bit_xor(F.xxhash64("id"))).first()[0] == mark


def with_ordinal(df: DataFrame, *order_by: str, name: str = "_idx", method: str = "auto", n: int | None = None) -> DataFrame:
    """``df`` (``n`` rows, counted if not given) with its 0-based position in the order of the columns ``order_by``, which must be unique.

    ``method``: "window" (one task), "range" (bounded ranges), or "auto" by the number of rows.
    Whole numbers without a gap give their position by subtraction. The ranges are counted here,
    once: what is made of the result reads ``df`` once and moves it once.
    """
    if not order_by:
        raise ValueError("rows have no order of their own: name the columns that give it")
    keys = list(order_by)
    fields = {f.name: f.dataType for f in df.schema.fields}
    small = lambda rows: method == "auto" and rows <= SMALL
    if method == "auto" and len(keys) == 1 and isinstance(fields[keys[0]], IntegralType) and not (n is not None and small(n)):
        key = F.col(keys[0]).cast("bigint")
        found = df.agg(F.count("*").alias("n"), F.count(key).alias("held"), F.min(key).alias("least"), F.max(key).alias("most"), F.bit_xor(F.xxhash64(key)).alias("mark")).first()
        n = found["n"]
        if not small(n) and found["held"] == n and _dense(df, keys[0], n, found["least"], found["most"], found["mark"]):
            return df.withColumn(name, key - F.lit(found["least"]).cast("bigint"))
    if method != "window" and n is None:
        n = df.count()
    if method == "window" or small(n):
        return df.withColumn(name, F.row_number().over(Window.orderBy(*keys)).cast("bigint") - 1)
    ranges = min(RANGES, max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = _cuts(df, keys, n, ranges)
    if not cuts:
        return with_ordinal(df, *keys, name=name, method="window")
    bound = lambda r: F.struct(*[F.lit(r[k]).cast(fields[k]).alias(k) for k in keys])
    ranged = df.withColumn("_range", place(F.struct(*[F.col(k) for k in keys]), cuts, bound))
    held = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}  # one row a range
    before = list(accumulate((held.get(i, 0) for i in range(len(cuts))), initial=0))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)).cast("bigint") - 1
    return ranged.withColumn(name, inside).withColumn(name, F.col(name) + looked_up(before, F.col("_range"))).drop("_range")


def running_sum(df: DataFrame, ordinal: str, value: str, name: str, n: int, width: int = 1 << 16) -> DataFrame:
    """``df`` (``n`` ordinals) with ``name``: the sum of the BIGINT ``value`` over all rows of a smaller ``ordinal``."""
    width = max(width, -(-n // RANGES))
    ranged = df.withColumn("_range", F.floor(F.col(ordinal) / width))
    window = Window.partitionBy("_range").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranged.withColumn(name, F.sum(value).over(window) - F.col(value))
    offsets = _offsets(ranged.select("_range", value), F.col(value), "_sum")
    return inside.join(F.broadcast(offsets), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
