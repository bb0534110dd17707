"""Fetch groups, minibatches, slots, ranks and workers as column arithmetic on the position."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.functions.rng import hash_hex


def fetch_of(pos: Column, batch_size: int, fetch_factor: int) -> Column:
    return F.floor(pos / F.lit(batch_size * fetch_factor)).cast("bigint")


def worker_of(fetch: Column, n_fetches: int, world_size: int, num_workers: int) -> Column:
    """Contiguous split of each rank's fetches over its workers; the first get one more."""
    rank, k = fetch % world_size, F.floor(fetch / F.lit(world_size)).cast("bigint")
    mine = F.floor((F.lit(n_fetches) - rank + world_size - 1) / F.lit(world_size)).cast("bigint")
    q, m = F.floor(mine / F.lit(num_workers)).cast("bigint"), mine % num_workers
    early = F.floor(k / (q + 1)).cast("bigint")
    late = m + F.floor((k - m * (q + 1)) / F.greatest(q, F.lit(1).cast("bigint"))).cast("bigint")
    return F.when(k < m * (q + 1), early).otherwise(late).cast("bigint")


def layout(plan: DataFrame, n: int, batch_size: int, fetch_factor: int = 16, *, shuffle: bool = False, sort: bool = True, drop_last: bool = False, world_size: int = 1, num_workers: int = 1, seed: int = 0, epoch: int = 0) -> DataFrame:
    """``plan`` (_idx, _pos) with _fetch, _lpos, _batch, _slot, _rank and _worker.

    ``n`` is the number of rows of the plan (``strategy.length``). Inside a fetch rows are in the
    order of _idx (or of _pos without ``sort``), or permuted with ``shuffle``. Batches are numbered
    over the whole plan; with ``drop_last`` the rows of a short batch are left out. All fetches
    have one size, so the window on them has no hot partition.
    """
    if batch_size <= 0 or fetch_factor <= 0 or world_size <= 0 or num_workers <= 0:
        raise ValueError("batch_size, fetch_factor, world_size and num_workers must be positive")
    size = batch_size * fetch_factor
    rows = plan.withColumn("_fetch", fetch_of(F.col("_pos"), batch_size, fetch_factor))
    order = [hash_hex(seed, epoch, "f", "_pos"), F.col("_pos")] if shuffle else [F.col("_idx"), F.col("_pos")] if sort else [F.col("_pos")]
    rows = rows.withColumn("_lpos", F.row_number().over(Window.partitionBy("_fetch").orderBy(*order)).cast("bigint") - 1)
    batch = F.floor(F.col("_lpos") / F.lit(batch_size)).cast("bigint")
    rows = rows.withColumn("_batch", F.col("_fetch") * fetch_factor + batch).withColumn("_slot", F.col("_lpos") % batch_size)
    n_fetches = -(-n // size)
    rows = rows.withColumn("_rank", F.col("_fetch") % world_size).withColumn("_worker", worker_of(F.col("_fetch"), n_fetches, world_size, num_workers))
    if drop_last:
        held = F.least(F.lit(size).cast("bigint"), F.lit(n).cast("bigint") - F.col("_fetch") * size)
        rows = rows.where(F.col("_lpos") < held - held % batch_size)
    return rows


def length(n: int, batch_size: int, fetch_factor: int = 16, *, drop_last: bool = False, rank: int = 0, world_size: int = 1) -> int:
    """Batches that ``rank`` gets."""
    size = batch_size * fetch_factor
    fetches = -(-n // size)
    mine = max(0, -(-(fetches - rank) // world_size))
    if not mine:
        return 0
    # all fetches but the last of all are full
    last = n - (fetches - 1) * size if (fetches - 1 - rank) % world_size == 0 else size
    return (mine - 1) * fetch_factor + (last // batch_size if drop_last else -(-last // batch_size))


def seed_of(seed: int | None = None) -> int:
    """The given seed, or a random one in [0, 2^31), chosen once on the driver: the plan carries it to every rank and task."""
    return secrets.randbelow(1 << 31) if seed is None else seed


def rank_and_world(rank: int | None = None, world_size: int | None = None) -> tuple[int, int]:
    """Rank and world size: as given, else of an initialised torch.distributed group, else 0 and 1."""
    found = (0, 1)
    try:
        import torch.distributed as dist

        if dist.is_available() and dist.is_initialized():
            found = dist.get_rank(), dist.get_world_size()
    except ImportError:
        pass
    return found[0] if rank is None else rank, found[1] if world_size is None else world_size
