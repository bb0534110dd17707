"""Transforms, weights, metrics, containers, sources and the stream."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from batchloom.operators import metrics as M
from batchloom.operators import transforms as X
from batchloom.operators.aligned import AlignedTable
from batchloom.operators.encode import encode_labels
from batchloom.operators.models import fit_heads
from batchloom.operators.strategy import BlockShuffle, Sequential
from batchloom.operators.weights import class_weights, combination_weights
from batchloom.plans.layout import layout
from batchloom.plans.tuning import row_bytes, sample_size, suggest_parameters
from batchloom.sources.files import batches, load_config, merge_config, run_grid, scan_files, scan_ids
from batchloom.streaming.microbatch import laid_out, write_stream


def test_densify(spark):
    df = spark.createDataFrame([(0, [0, 5, 10], [1.0, 2.0, 3.0]), (1, [1, 3], [4.0, 5.0]), (2, [], [])], "id int, g array<int>, v array<float>")
    for out in (X.densify(df, "g", "v", 20), df.withColumn("x", X.sparse_to_dense("g", "v", 20))):
        got = {r["id"]: r["x"] for r in out.collect()}
        assert np.flatnonzero(got[0]).tolist() == [0, 5, 10] and got[1][1] == 4 and got[1][3] == 5 and got[2] == [0.0] * 20
    again = spark.createDataFrame([([2, 2], [1.0, 7.0])], "g array<int>, v array<float>")
    assert again.select(X.sparse_to_dense("g", "v", 4)).first()[0] == X.densify(again, "g", "v", 4).first()["x"] == [0, 0, 7, 0]


def test_class_and_combination_weights(spark):
    df = spark.createDataFrame([(c,) for c in "AAAAAABBCC"], "label string")
    got = class_weights(df, "label").collect()
    assert math.isclose(sum(r["weight"] for r in got), 10) and {r["label"]: round(r["weight"], 6) for r in got} == {"A": round(10 / 18, 6), "B": round(10 / 6, 6), "C": round(10 / 6, 6)}
    two = spark.createDataFrame([("a", "x")] * 2000 + [("b", "y")] * 3, "p string, q string")
    w = {r["p"]: r["weight"] for r in combination_weights(two, "p", "q").distinct().collect()}
    assert math.isclose(w["b"] / w["a"], 3000 / 1003)
    assert combination_weights(two.limit(0), "p", "q").count() == 0


def test_encode_checks_keys(spark):
    df = spark.createDataFrame([("a",), ("z",)], "k string")
    side = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(KeyError):
        encode_labels(df, [("k", side, "k", "v", "code")])
    assert encode_labels(df, [("k", side, "k", "v", "code")], check=False).collect()[0]["code"] == 1


def test_entropy_bounds(spark):
    df = spark.createDataFrame([(0, "a"), (0, "b"), (0, "a"), (0, "b"), (1, "a"), (1, "a"), (2, "a")], "_batch int, y string")
    got = {r["_batch"]: r["entropy"] for r in M.batch_entropy(df, "y").collect()}
    assert got == {0: 1.0, 1: 0.0}
    assert M.entropy_summary(df.limit(0), "y").first()["avg_batch_entropy"] == 0.0


def test_f1_of_a_class_that_is_never_right(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (2, 2)], "t int, p int")
    r = M.f1_scores(df, "t", "p").first()
    assert math.isclose(r["f1_macro"], (0.5 + 0 + 1) / 3) and math.isclose(r["accuracy"], 0.5) and math.isclose(r["f1_weighted"], (0.5 * 2 + 0 + 1) / 4)


def test_summary_of_a_single_run_and_failures(spark):
    df = spark.createDataFrame([("m", 0.5, "ok"), ("m", 0.7, "failed")], "method string, value double, status string")
    r = M.run_summary(df, "method", status="status").first()
    assert (r["mean"], r["std"], r["n_runs"]) == (0.5, 0.0, 1)
    assert M.throughput(spark.range(100))["samples_tested"] == 100


def test_aligned_table(spark):
    x = spark.range(5).select(F.col("id").alias("_idx"), (F.col("id") * 2).alias("x"))
    y = spark.range(5).select(F.col("id").alias("_idx"), F.col("id").cast("string").alias("y"))
    t = AlignedTable(a=x, b=y, metadata={"k": [1]})
    assert len(t) == 5 and t.count == 2 and list(t.keys()) == ["a", "b"] and t.modality(-1) is y and t.modality("a") is x
    some = t.rows([1, 1, 4])
    assert sorted(r["b"]["y"] for r in some.rows(F.col("_idx") == 4).wide().collect()) == ["4"] and len(some) == 3 and some.metadata == {"k": [1]}
    for bad, error in ((lambda: AlignedTable(), TypeError), (lambda: AlignedTable({}), ValueError), (lambda: AlignedTable(a=x, b=y.limit(2)), ValueError), (lambda: AlignedTable({"a": x}, b=y), TypeError), (lambda: AlignedTable(a=[1]), TypeError), (lambda: AlignedTable(a=x, metadata=3), TypeError), (lambda: AlignedTable.of(x, names=["a", "b"]), ValueError)):
        with pytest.raises(error):
            bad()


def test_hook_order_and_batches(spark):
    base = spark.range(100).select(F.col("id").alias("_idx"), F.col("id").alias("x"))
    plan = layout(Sequential().plan(base), 100, 10, 2, world_size=2).join(base, "_idx")
    got = list(batches(plan, "x"))
    assert len(got) == 10 and all(len(b) == 10 for b in got) and got[0]["x"].tolist() == list(range(10)) and got[2]["x"].iloc[0] == 40
    one = X.hooks(plan.select("_fetch", "_lpos", "_batch", "_slot", "x"), fetch_callback=(lambda p: p.assign(x=p["x"] + 1), "_fetch bigint, _lpos bigint, _batch bigint, _slot bigint, x bigint"), fetch_transform=(lambda p: p.assign(x=p["x"] * 2), "_fetch bigint, _lpos bigint, _batch bigint, _slot bigint, x bigint"), batch_callback=(lambda p: p.assign(x=p["x"] + 100), "_fetch bigint, _lpos bigint, _batch bigint, _slot bigint, x bigint"), batch_transform=(lambda p: pd.DataFrame({"total": [int(p["x"].sum())]}), "total bigint"))
    assert sorted(r["total"] for r in one.collect()) == sorted(sum(2 * (i + 1) + 100 for i in range(k, k + 10)) for k in range(0, 100, 10))


def test_normalise_sample_ddof(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0],)], "x array<double>")
    for sample in (True, False):
        a = np.array([1.0, 2.0, 4.0])
        assert np.allclose(df.select(X.normalise_sample("x", sample)).first()[0], (a - a.mean()) / (a.std(ddof=int(sample)) + 1e-8))


def test_sources(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    with pytest.warns(UserWarning):
        assert scan_files(spark, [str(tmp_path / "a"), str(tmp_path / "none")]).count() == 3
    with pytest.raises(FileNotFoundError), pytest.warns(UserWarning):
        scan_files(spark, [str(tmp_path / "none")])
    base = spark.range(10).select(F.col("id").alias("_idx"))
    ids = lambda w: sorted(r["_idx"] for r in scan_ids(base, w).collect())
    assert ids(3) == [3] and ids(slice(2, 9, 3)) == [2, 5, 8] and ids([1, 1, 7]) == [1, 1, 7]
    with pytest.raises(TypeError):
        scan_ids(base, "x")
    assert load_config(str(tmp_path / "none.json"), {"a": 1}) == {"a": 1}
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none.json"))
    assert merge_config({"b": 5, "c": None}, {"b": 2, "c": 3}, {"a": 1, "b": 1, "c": 1}) == {"a": 1, "b": 5, "c": 3}
    assert [r["status"] for r in run_grid(lambda n: {"v": 1 / n}, [{"n": 1}, {"n": 0}])] == ["ok", "failed"]


def test_sizes_and_suggestions(spark):
    df = spark.createDataFrame([(1, [1.0] * 500, "é", None)], "id bigint, x array<float>, s string, t string")
    assert df.select(row_bytes(df)).first()[0] == 8 + 2000 + 2
    assert sample_size(df.withColumn("_idx", F.lit(0)).limit(0), "_idx", "x").first()[0] == 0
    p = suggest_parameters(2008, 64, memory=8 << 30, cpus=8)
    assert p["num_workers"] == 4 and p["fetch_factor"] == min(256, int(0.1 * (8 << 30) / (2 * 64 * 4 * 2008))) and p["prefetch_factor"] == p["fetch_factor"] + 1
    assert suggest_parameters(0, 64, memory=1, cpus=2)["fetch_factor"] == 8
    with pytest.raises(ValueError):
        suggest_parameters(1, 0)


def test_stream_lays_out_each_micro_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(50).withColumnRenamed("id", "k").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k bigint").parquet(src)
    q = write_stream(stream, out, str(tmp_path / "cp"), ["k"], 8, 2)
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(out)
    assert got.count() == 50 and got.select("k").distinct().count() == 50
    want = laid_out(spark.read.parquet(src), ["k"], 8, 2, BlockShuffle())
    assert sorted((r["k"], r["_batch"]) for r in want.collect()) == sorted((r["k"], r["_batch"]) for r in got.select("k", "_batch").collect())


def test_heads_learn(spark):
    df = spark.range(200).select(F.array((F.col("id") % 2) * 2.0 - 1, F.lit(0.5)).alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    model = fit_heads(df, "x", ["y"], maxIter=10)["y"]
    assert model.summary.accuracy == 1.0


def test_grid_leaves_its_records(tmp_path):
    from batchloom.sources.files import load_runs, strategy_config

    def run(name, x):
        return {"y": 1 // x}

    rows = run_grid(run, [{"name": "block_a", "x": 1}, {"name": "seq", "x": 0}], str(tmp_path))
    assert [r["status"] for r in rows] == ["ok", "failed"] and (tmp_path / "seq" / "error.json").exists() and (tmp_path / "summary.json").exists()
    (tmp_path / "summary.json").unlink()
    assert list(load_runs(str(tmp_path))) == ["block_a"] and load_runs(str(tmp_path), "seq") == {}
    assert strategy_config({}, {}, {"block_size": 4}, {"block_size": 8})["block_size"] == 8 and strategy_config({}, {}, {"block_size": 4})["block_size"] is None
