"""Invariants of strategies and layouts."""

import warnings
from collections import Counter

import pytest
from pyspark.sql import functions as F

from batchloom.operators.strategy import BlockShuffle, ClassBalanced, Sequential, Weighted
from batchloom.plans.layout import layout, length
from batchloom.plans.ordinal import rank_by_hash, running_sum, with_ordinal


def base(spark, n):
    return spark.range(n).select(F.col("id").alias("_idx"))


def order(plan):
    return [r["_idx"] for r in plan.orderBy("_pos").collect()]


def test_sequential_identity_and_sorted_subset(spark):
    b = base(spark, 30)
    assert order(Sequential().plan(b)) == list(range(30))
    with pytest.warns(UserWarning):
        assert order(Sequential([20, 10, 15]).plan(b)) == [10, 15, 20]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert order(Sequential([3, 3, 4]).plan(b)) == [3, 3, 4]


@pytest.mark.parametrize("n,b", [(100, 8), (103, 8), (5, 100), (1, 1), (17, 17), (0, 4)])
def test_blocks_are_a_permutation_that_keeps_blocks(spark, n, b):
    got = order(BlockShuffle(b).plan(base(spark, n), seed=3))
    assert sorted(got) == list(range(n))
    runs, at = [], 0
    while at < n:
        size = min(b, n - got[at])
        runs.append(got[at : at + size])
        assert runs[-1] == list(range(got[at], got[at] + size)) and got[at] % b == 0
        at += size


def test_block_order_depends_on_seed_and_epoch_only(spark):
    b = base(spark, 200)
    one = order(BlockShuffle(4).plan(b, 1, 0))
    assert one == order(BlockShuffle(4).plan(b.repartition(7), 1, 0))
    assert one != order(BlockShuffle(4).plan(b, 2, 0)) and one != order(BlockShuffle(4).plan(b, 1, 1))
    assert order(BlockShuffle(4).plan(b, 1000, 0)) != order(BlockShuffle(4).plan(b, 0, 1))


def test_first_block_is_uniform(spark):
    firsts = Counter(order(BlockShuffle(10).plan(base(spark, 45), seed))[0] // 10 for seed in range(60))
    assert set(firsts) == set(range(5)) and max(firsts.values()) < 30  # the short block takes part


def test_drop_last_drops_random_rows(spark):
    b = base(spark, 103)
    s = BlockShuffle(10, drop_last=True)
    got = order(s.plan(b, 5))
    assert len(got) == s.length(b) == 100 and len(set(got)) == 100
    assert set(range(103)) - set(got) != {100, 101, 102}
    assert len(order(BlockShuffle(4, [1, 1, 1, 2, 2], drop_last=True).plan(b))) == 4


def test_weighted_draws_follow_weights(spark):
    b = base(spark, 100).withColumn("w", F.when(F.col("_idx") < 50, 0.99).otherwise(0.01))
    got = order(Weighted(4, weights="w", total_size=1000).plan(b, 1))
    assert len(got) == 1000 and sum(i < 50 for i in got) > 950
    even = Counter(order(Weighted(1, total_size=5000).plan(base(spark, 10), 2)))
    assert sum((c - 500) ** 2 / 500 for c in even.values()) < 27.9  # chi-square, 9 degrees, 0.1 %
    zero = base(spark, 10).withColumn("w", F.when(F.col("_idx") == 3, 1.0).otherwise(0.0))
    assert set(order(Weighted(2, weights="w", total_size=20).plan(zero))) == {3}


def test_rounds_are_without_replacement_inside(spark):
    b = base(spark, 100).withColumn("w", F.lit(1.0))
    s = Weighted(1, weights="w", total_size=50, replace=False, sampling_size=10)
    rows = s.rounds(b, 50, 1, 0).collect()
    rounds = Counter(r["_draw"] for r in rows)
    assert set(rounds.values()) == {10} and len({(r["_idx"], r["_draw"]) for r in rows}) == 50


def test_class_balance_global_and_local(spark):
    b = base(spark, 1000).withColumn("g", F.when(F.col("_idx") < 900, "a").when(F.col("_idx") < 990, "b").otherwise("c"))
    local = Counter("abc"[(i >= 900) + (i >= 990)] for i in order(ClassBalanced("g", 8, total_size=3000).plan(b, 4)))
    assert all(850 < c < 1150 for c in local.values())
    some = b.where("_idx < 50 OR _idx >= 990").select("_idx")
    seen = Counter(i >= 990 for i in order(ClassBalanced("g", 8, some, 3000, scope="global").plan(b, 4)))
    assert seen[True] > 12 * seen[False]  # 10 of 10 rows against 50 of 900
    with pytest.raises(ValueError):
        ClassBalanced("g").plan(b.withColumn("g", F.lit(None).cast("string")))


@pytest.mark.parametrize("make", [lambda: BlockShuffle(0), lambda: Weighted(0), lambda: Weighted(replace=False), lambda: ClassBalanced("g", scope="x")])
def test_bad_arguments(make):
    with pytest.raises(ValueError):
        make()


def test_bad_weights(spark):
    for w in (-1.0, 0.0):
        with pytest.raises(ValueError):
            Weighted(weights="w").plan(base(spark, 5).withColumn("w", F.lit(w)))
    with pytest.raises(ValueError):
        Weighted(replace=False, sampling_size=9, total_size=9).plan(base(spark, 5))
    with pytest.warns(UserWarning):
        Weighted(sampling_size=3)


@pytest.mark.parametrize("n,bs,ff,world,drop", [(100, 7, 1, 1, True), (107, 10, 5, 2, True), (107, 10, 5, 2, False), (100, 64, 1, 8, False), (200, 16, 4, 3, False), (0, 4, 2, 2, False)])
def test_length_equals_iteration_and_ranks_cover(spark, n, bs, ff, world, drop):
    b = base(spark, n)
    rows = layout(Sequential().plan(b), n, bs, ff, world_size=world, drop_last=drop).collect()
    for rank in range(world):
        assert len({r["_batch"] for r in rows if r["_rank"] == rank}) == length(n, bs, ff, drop_last=drop, rank=rank, world_size=world)
    ids = [r["_idx"] for r in rows]
    assert len(ids) == len(set(ids)) and (len(ids) == n if not drop else all(c == bs for c in Counter(r["_batch"] for r in rows).values()))


@pytest.mark.parametrize("n_fetches,world,workers", [(4, 1, 3), (11, 2, 4), (5, 3, 4), (1, 1, 8)])
def test_workers_split_contiguously(spark, n_fetches, world, workers):
    n = n_fetches * 4
    rows = layout(Sequential().plan(base(spark, n)), n, 2, 2, world_size=world, num_workers=workers).select("_rank", "_worker", "_fetch").distinct().collect()
    for rank in range(world):
        mine = sorted(r["_fetch"] for r in rows if r["_rank"] == rank)
        q, m = divmod(len(mine), workers)
        want, at = {}, 0
        for w in range(workers):
            for f in mine[at : at + q + (w < m)]:
                want[f] = w
            at += q + (w < m)
        assert want == {r["_fetch"]: r["_worker"] for r in rows if r["_rank"] == rank}


def test_fetch_shuffle_permutes_inside_only(spark):
    n = 256
    rows = layout(Sequential(shuffle=True).plan(base(spark, n)), n, 8, 4, shuffle=True, seed=1).collect()
    assert all(r["_idx"] // 32 == r["_fetch"] for r in rows) and any(r["_lpos"] != r["_idx"] % 32 for r in rows)


def test_range_ordinal_equals_window(spark):
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("a"), F.col("id").cast("string").alias("b"))
    one = {(r["a"], r["b"]): r["_idx"] for r in with_ordinal(df, "a", "b", method="window").collect()}
    two = {(r["a"], r["b"]): r["_idx"] for r in with_ordinal(df, "a", "b", method="range").collect()}
    assert one == two
    with pytest.raises(ValueError):
        with_ordinal(df)


def test_rank_and_running_sum(spark):
    df = spark.range(3000).withColumn("h", F.md5(F.col("id").cast("string"))).withColumn("v", F.col("id") % 7)
    got = rank_by_hash(df, F.col("h"), "id", "r").orderBy("r").collect()
    assert [r["r"] for r in got] == list(range(3000)) and [r["h"] for r in got] == sorted(r["h"] for r in got)
    sums = running_sum(df, "id", "v", "lo", 1000, width=64).orderBy("id").collect()
    total = 0
    for r in sums:
        assert r["lo"] == total
        total += r["v"]


def test_plans_have_no_nested_loop(spark):
    b = base(spark, 100_000).withColumn("w", (F.col("_idx") % 5).cast("double"))
    plan = Weighted(8, weights="w").draws(b, 1000, 1, 0)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), -1.0, None])
def test_odd_weights_are_refused(spark, odd):
    b = spark.createDataFrame([(0, 1.0), (1, odd), (2, 2.0)], "_idx bigint, w double")
    with pytest.raises(ValueError):
        Weighted(1, weights="w", total_size=5).plan(b)


def test_draws_do_not_depend_on_partitions_and_a_heavy_row_takes_its_share(spark):
    b = base(spark, 3000).withColumn("w", F.when(F.col("_idx") == 7, 1000.0).otherwise(0.1 + F.col("_idx") % 3))
    one = sorted(map(tuple, Weighted(4, weights="w", total_size=2000).draws(b, 2000, 1, 0).collect()))
    two = sorted(map(tuple, Weighted(4, weights="w", total_size=2000).draws(b.repartition(13), 2000, 1, 0).collect()))
    assert one == two and len({d for _, d in one}) == 2000
    assert abs(sum(i == 7 for i, _ in one) - 2000 * 1000 / (1000 + 3000 * 1.1)) < 120


def test_many_classes_draw_as_few_do(spark, monkeypatch):
    b = base(spark, 400).withColumn("g", F.col("_idx") % 7)
    few = sorted(map(tuple, ClassBalanced("g", 4, total_size=300).draws(b, 300, 1, 0).collect()))
    monkeypatch.setattr("batchloom.operators.strategy.LITERAL_GROUPS", 3)
    assert sorted(map(tuple, ClassBalanced("g", 4, total_size=300).draws(b, 300, 1, 0).collect())) == few


def test_rounds_equal_the_least_keys_of_each_round(spark):
    from batchloom.functions.rng import hash_unit

    b = base(spark, 500).withColumn("w", 0.5 + F.col("_idx") % 4)
    got = sorted(map(tuple, Weighted(1, weights="w", total_size=130, replace=False, sampling_size=50).rounds(b, 130, 3, 1).collect()))
    want = []
    for r, size in enumerate((50, 50, 30)):
        keyed = b.select("_idx", (-F.log(hash_unit(3, 1, f"r{r}", "_idx")) / F.col("w")).alias("k")).orderBy("k", "_idx").limit(size)
        want += [(x["_idx"], r) for x in keyed.collect()]
    assert got == sorted(want)


@pytest.mark.parametrize("n,size,factor,world", [(0, 4, 2, 1), (1, 4, 2, 3), (100, 64, 1, 8), (107, 10, 5, 2), (1000, 16, 4, 3), (64, 8, 2, 4), (129, 8, 2, 4)])
def test_length_in_closed_form(n, size, factor, world):
    for drop in (False, True):
        for rank in range(world):
            held = [min(size * factor, n - f * size * factor) for f in range(rank, -(-n // (size * factor)), world)]
            assert length(n, size, factor, drop_last=drop, rank=rank, world_size=world) == sum(h // size if drop else -(-h // size) for h in held)


def test_seed_and_rank(monkeypatch):
    from batchloom.plans.layout import rank_and_world, seed_of

    assert seed_of(5) == 5 and 0 <= seed_of() < 1 << 31 and len({seed_of() for _ in range(8)}) > 1
    assert rank_and_world() == (0, 1) and rank_and_world(2, 4) == (2, 4)


def test_place_counts_cuts_at_or_below(spark):
    from batchloom.plans.ordinal import place

    for cuts in ([], [3], list(range(0, 200, 7)), [5, 6, 100]):
        rows = spark.range(-3, 210).select("id", place(F.col("id"), cuts, lambda x: F.lit(x).cast("bigint")).alias("n")).collect()
        assert all(r["n"] == sum(c <= r["id"] for c in cuts) for r in rows)
