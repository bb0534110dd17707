"""How often a plan reads its rows: what is read again for each use of a use does not fit large tables."""

import pytest
from pyspark.sql import functions as F

from batchloom.operators.strategy import BlockShuffle, ClassBalanced, Weighted
from batchloom.operators.weights import combination_weights
from batchloom.plans.ordinal import with_ordinal

N = 3000


def rows(spark, n=N):
    """Ids 0..n-1 from a source that a plan's text tells: Range (7, ..."""
    return spark.range(7, n + 7).select((F.col("id") - 7).alias("_idx"))


def reads(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Range (7,")


def test_combination_weights_read_their_rows_once(spark):
    df = rows(spark).select("_idx", F.when(F.col("_idx") % 3 > 0, F.col("_idx") % 3).alias("a"), (F.col("_idx") % 2 > 0).alias("b"))
    got = combination_weights(df, "a", "b", baseline=10.0)
    assert reads(got) == 1
    n = {(r["a"], r["b"]): r["count"] for r in df.groupBy("a", "b").count().collect()}
    mass = sum(c / (c + 10) for c in n.values())
    assert len(n) == 6 and got.count() == N
    for r in got.select("a", "b", "weight").distinct().collect():
        assert r["weight"] == pytest.approx(N / mass / (n[r["a"], r["b"]] + 10))


def test_ranged_ordinal_reads_its_rows_once(spark):
    got = with_ordinal(rows(spark).select(F.col("_idx").cast("string").alias("k")), "k", method="range")
    assert reads(got) == 1 and [r["_idx"] for r in got.orderBy("k").collect()] == list(range(N))


@pytest.mark.parametrize("odd", ["no gap", "gap", "repeated", "null"])
def test_whole_numbers_without_a_gap_are_not_moved(spark, monkeypatch, odd):
    monkeypatch.setattr("batchloom.plans.ordinal.SMALL", 100)
    k = F.col("_idx") - 40
    k = {"no gap": k, "gap": k + F.col("_idx") % 2, "repeated": F.when(k == 5, 4).otherwise(k), "null": F.when(k == 5, None).otherwise(k)}[odd]
    df = rows(spark).select(k.alias("k")).orderBy(F.desc("k"))
    if odd == "gap":
        df = df.distinct()
    got = with_ordinal(df, "k")
    assert ("Window" not in got._jdf.queryExecution().toString()) == (odd == "no gap")
    found = got.orderBy("_idx").collect()
    keys = [r["k"] for r in found]
    assert [r["_idx"] for r in found] == list(range(len(found))) and keys == sorted(keys, key=lambda x: -1e9 if x is None else x)


@pytest.mark.parametrize("kind", ["all", "repeated ids", "weights aside"])
def test_weighted_plan_reads_its_rows_once(spark, kind):
    b = rows(spark).withColumn("w", 1.0 + F.col("_idx") % 5)
    some = spark.range(0, N, 3).select(F.col("id").alias("_idx"))
    s = {
        "all": lambda: Weighted(8, weights="w"),
        "repeated ids": lambda: Weighted(8, some.union(some.where("_idx < 900")), weights="w"),
        "weights aside": lambda: Weighted(8, some, weights=some.withColumn("w", 1.0 + F.col("_idx") % 5)),
    }[kind]()
    got = s.plan(b, 3)
    assert reads(got) == 1
    found = got.orderBy("_pos").collect()
    assert [r["_pos"] for r in found] == list(range(s.length(b)))
    drawn = sorted(r["_idx"] for r in s.draws(b, s.length(b), 3, 0).collect())
    assert sorted(r["_idx"] for r in found) == drawn and (kind == "all" or all(i % 3 == 0 for i in drawn))
    ranks = sorted((r["_s"], r["_idx"]) for r in s._drawn(b, s.length(b), 3, 0).collect())
    assert [i for _, i in ranks] == drawn and [k for k, _ in ranks] == list(range(len(drawn)))


def jobs(spark, plan):
    """Spark jobs that ``plan`` runs before it is executed."""
    spark.sparkContext.setJobGroup(str(id(plan)), "counted")
    try:
        plan()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(id(plan))))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_few_draws_are_planned_in_few_passes(spark, monkeypatch):
    monkeypatch.setattr("batchloom.plans.ordinal.SMALL", 100)
    monkeypatch.setattr("batchloom.operators.strategy.SMALL", 100, raising=False)
    b = rows(spark).withColumn("w", 1.0 + F.col("_idx") % 5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else a job a stage
    try:
        assert jobs(spark, lambda: Weighted(8, weights="w", total_size=77).plan(b, 3)) <= 3
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_weights_that_miss_a_row_are_refused(spark):
    b = rows(spark)
    with pytest.raises(ValueError, match="cover"):
        Weighted(8, [1, 2, 3], weights=b.where("_idx < 3").withColumn("w", F.lit(1.0))).plan(b)


@pytest.mark.parametrize("kind", ["local", "global", "many classes", "a row drawn very often"])
def test_class_balanced_plan_counts_draws_by_row(spark, monkeypatch, kind):
    monkeypatch.setattr("batchloom.plans.ordinal.SMALL", 100)
    monkeypatch.setattr("batchloom.operators.strategy.PIECE", 64, raising=False)
    if kind == "many classes":
        monkeypatch.setattr("batchloom.operators.strategy.LITERAL_GROUPS", 3)
    one = F.col("_idx") == 5
    g = F.when(one, 9).otherwise(0) if kind == "a row drawn very often" else F.when(F.col("_idx") % 10 > 0, F.col("_idx") % 4)
    b = rows(spark).withColumn("g", g)
    some = spark.range(0, N, 3).union(spark.range(0, 90)).select(F.col("id").alias("_idx"))
    s = ClassBalanced("g", 8, some if kind == "global" else None, 2000, scope="global" if kind == "global" else "local")
    got = s.plan(b, 3)
    assert kind == "many classes" or reads(got) <= 2  # the second is the same exchange
    drawn = sorted(r["_idx"] for r in s.draws(b, 2000, 3, 0).collect())
    assert [k for k, _ in sorted((r["_pos"], r["_idx"]) for r in got.collect())] == list(range(2000))
    assert [tuple(r) for r in s._drawn(b, 2000, 3, 0).select("_s", "_idx").orderBy("_s").collect()] == list(enumerate(drawn))
    assert kind != "a row drawn very often" or 900 < drawn.count(5) < 1100


def test_few_rounds_find_their_rows_once(spark, monkeypatch):
    b = rows(spark).withColumn("w", 0.01 + F.col("_idx") % 7)
    s = Weighted(8, weights="w", total_size=130, replace=False, sampling_size=50)
    found = s.rounds(b, 130, 3, 0)
    assert reads(found) == 0
    monkeypatch.setattr("batchloom.operators.strategy.FEW_PICKED", 0)
    wide = s.rounds(b, 130, 3, 0)
    assert reads(wide) == 1 and sorted(map(tuple, found.collect())) == sorted(map(tuple, wide.collect()))


@pytest.mark.parametrize("block", [1, 24])
def test_blocks_of_rows_ordered_by_two_keys(spark, monkeypatch, block):
    monkeypatch.setattr("batchloom.plans.ordinal.SMALL", 100)
    df = rows(spark).select(F.concat(F.lit("type"), (F.col("_idx") % 5).cast("string")).alias("t"), F.col("_idx").alias("e"))
    b = with_ordinal(df, "t", "e")
    got = BlockShuffle(block).plan(b, 3).join(b, "_idx")
    assert reads(got) == 2  # the plan's ids and the payload
    found = got.orderBy("_pos").collect()
    assert [r["_pos"] for r in found] == list(range(N))
    assert [(r["t"], r["e"]) for r in sorted(found, key=lambda r: r["_idx"])] == sorted((f"type{i % 5}", i) for i in range(N))
