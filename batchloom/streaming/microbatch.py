"""The layout over a stream: each micro-batch of new rows is a collection of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame

from batchloom.operators.strategy import BlockShuffle, Strategy
from batchloom.plans.layout import layout
from batchloom.plans.ordinal import with_ordinal


def laid_out(rows: DataFrame, order_by: list[str], batch_size: int, fetch_factor: int = 16, strategy: Strategy | None = None, seed: int = 0, epoch: int = 0, **kwargs) -> DataFrame:
    """``rows`` with the layout columns, their payload beside them."""
    strategy = strategy or BlockShuffle()
    base = with_ordinal(rows, *order_by)
    plan = strategy.plan(base, seed, epoch)
    n = strategy.length(base)
    return layout(plan, n, batch_size, fetch_factor, shuffle=strategy.shuffles_fetch, seed=seed, epoch=epoch, **kwargs).join(base, "_idx")


def write_stream(stream: DataFrame, path: str, checkpoint: str, order_by: list[str], batch_size: int, fetch_factor: int = 16, seed: int = 0, **kwargs):
    """Start a query that writes each micro-batch laid out, its id being the epoch.

    A micro-batch that is run again after a failure overwrites its own folder with the same rows.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        laid_out(rows, order_by, batch_size, fetch_factor, seed=seed, epoch=batch_id, **kwargs).write.mode("overwrite").parquet(f"{path}/epoch={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).start()
