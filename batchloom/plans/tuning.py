"""Row sizes and suggested loader parameters."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def bytes_of(column: Column, kind: T.DataType) -> Column:
    """Payload bytes of a value; null is 0."""
    name = kind.simpleString()
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(column)
    elif isinstance(kind, T.ArrayType):
        fixed = _WIDTHS.get(kind.elementType.simpleString())
        size = F.size(column) * fixed if fixed else F.aggregate(column, F.lit(0).cast("bigint"), lambda a, x: a + bytes_of(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        size = bytes_of(F.map_keys(column), T.ArrayType(kind.keyType)) + bytes_of(F.map_values(column), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        size = F.lit(0)
        for f in kind.fields:
            size = size + bytes_of(column.getField(f.name), f.dataType)
    else:
        size = F.lit(16 if isinstance(kind, T.DecimalType) else _WIDTHS.get(name, 8))
    return F.when(column.isNull(), 0).otherwise(size).cast("bigint")


def row_bytes(df: DataFrame, *columns: str) -> Column:
    out = F.lit(0).cast("bigint")
    for c in columns or df.columns:
        out = out + bytes_of(F.col(c), df.schema[c].dataType)
    return out


def sample_size(df: DataFrame, ordinal: str, *columns: str, rows: int = 16) -> DataFrame:
    """One row with ``sample_bytes``: the mean of the first rows, rounded down; 0 for none."""
    return df.where(F.col(ordinal) < rows).agg(F.coalesce(F.floor(F.avg(row_bytes(df, *columns))), F.lit(0)).cast("bigint").alias("sample_bytes"))


def suggest_parameters(sample_bytes: int, batch_size: int, *, memory: int | None = None, cpus: int | None = None, memory_share: float = 0.1, min_workers: int = 1, max_workers: int = 16) -> dict[str, int | float]:
    """Workers, fetch factor, block sizes and prefetch that keep the fetches in memory."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    if memory is None:
        try:
            memory = os.sysconf("SC_AVPHYS_PAGES") * os.sysconf("SC_PAGE_SIZE")
        except (ValueError, OSError):
            warnings.warn("free memory is not known; 8 GB are assumed", UserWarning, stacklevel=2)
            memory = 8 << 30
    cpus = cpus or os.cpu_count() or 4
    workers = min(max(cpus // 2, min_workers), max_workers)
    if sample_bytes > 0:
        factor = min(max(int(memory_share * memory / (2 * batch_size * workers * sample_bytes)), 1), 256)
    else:
        factor = 8
    fetch = batch_size * factor * sample_bytes
    return {
        "num_workers": workers,
        "fetch_factor": factor,
        "block_size_conservative": max(1, factor // 2),
        "block_size_balanced": max(1, factor),
        "block_size_aggressive": max(1, 2 * factor),
        "prefetch_factor": factor + 1,
        "memory_per_worker_mb": 2 * fetch / (1 << 20),
        "total_memory_mb": 2 * fetch * workers / (1 << 20),
    }
