"""Collections from files, batches out to files, and results of runs."""

from __future__ import annotations

import atexit
import json
import os
import pickle
import shutil
import tempfile
import uuid
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in whatever store Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def scan_files(spark: SparkSession, paths: list[str], columns: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Parquet files one after the other with ``source_file`` (their place in ``paths``).

    Missing files are skipped with a warning; FileNotFoundError if none is there. ``columns`` are
    pruned in the scan. ``order`` names a key, unique within a file, for a later ordinal.
    """
    out = None
    for i, path in enumerate(paths):
        if not exists(spark, path):
            warnings.warn(f"{path} is missing and left out", UserWarning, stacklevel=2)
            continue
        one = spark.read.parquet(path)
        one = one.select(*(columns or one.columns), F.lit(i).cast("bigint").alias("source_file"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"none of {len(paths)} files is there")
    return out


def scan_ids(base: DataFrame, which: int | slice | list[int] | DataFrame, ordinal: str = "_idx") -> DataFrame:
    """Rows by position: one, a slice (with a step), a list (repeats stay repeated) or a frame of ids."""
    idx = F.col(ordinal)
    if isinstance(which, bool) or not isinstance(which, (int, slice, list, tuple, range, DataFrame)):
        raise TypeError(f"positions cannot be a {type(which).__name__}")
    if isinstance(which, int):
        return base.where(idx == which)
    if isinstance(which, slice):
        start, stop, step = which.start or 0, which.stop, which.step or 1
        if start < 0 or (stop is not None and stop < 0) or step < 1:
            raise ValueError("slices count from the start")
        out = base.where((idx >= start) & ((idx - start) % step == 0))
        return out if stop is None else out.where(idx < stop)
    ids = which if isinstance(which, DataFrame) else base.sparkSession.createDataFrame([(int(i),) for i in which], f"{ordinal} bigint")
    return ids.select(ordinal).join(base, ordinal)


def load_config(path: str, defaults: dict | None = None) -> dict:
    """A YAML (where PyYAML is installed) or JSON file; with ``defaults`` what cannot be read gives those."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(text) or {}
        return json.loads(text)
    except Exception:
        if defaults is None:
            raise
        return dict(defaults)


def merge_config(command_line: dict, file: dict, defaults: dict) -> dict:
    """Command line over file over defaults; None does not count as given."""
    given = lambda d: {k: v for k, v in d.items() if v is not None}
    return {**defaults, **given(file), **given(command_line)}


def strategy_config(command_line: dict, file: dict, defaults: dict, strategy: dict | None = None) -> dict:
    """``merge_config``; block_size is that of the command line, else the strategy's, else None, and never a default."""
    out = merge_config(command_line, file, defaults)
    out["block_size"] = command_line.get("block_size") if command_line.get("block_size") is not None else (strategy or {}).get("block_size")
    return out


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that executors share, spark.checkpoint.dir (a temporary one in local runs, where it is unset)."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not base:
        if not conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="batchloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def batches(df: DataFrame, *columns: str) -> Iterator[pd.DataFrame]:
    """Minibatches of a laid-out frame in order, one at a time on the driver."""
    names = list(columns) or [c for c in df.columns if not c.startswith("_")]
    ordered = df.orderBy("_rank", "_worker", "_batch", "_slot").select("_batch", *names)
    held, at = [], None
    for row in ordered.toLocalIterator(prefetchPartitions=True):
        if at is not None and row["_batch"] != at:
            yield pd.DataFrame(held, columns=names)
            held = []
        at = row["_batch"]
        held.append(tuple(row)[1:])
    if held:
        yield pd.DataFrame(held, columns=names)


def write_shards(df: DataFrame, path: str) -> None:
    """Laid-out rows as Parquet by rank and worker, each file in the order of its batches."""
    df.repartition("_rank", "_worker", F.floor(F.col("_fetch") / 64)).sortWithinPartitions("_batch", "_slot").write.partitionBy("_rank", "_worker").parquet(path)


def write_results(rows: DataFrame, path: str, kind: str = "csv") -> None:
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def read_results(spark: SparkSession, path: str, schema: str, kind: str = "csv") -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path) if kind == "csv" else spark.read.schema(schema).json(path)


def run_grid(function, configs: list[dict], folder: str | None = None) -> list[dict]:
    """``function`` of each config; a failure becomes a row with status and message.

    With ``folder`` each run leaves <name>/results.json (or error.json) there and all a summary.json.
    """
    out = []
    for i, config in enumerate(configs):
        try:
            out.append({**config, **function(**config), "status": "ok", "error": None})
        except Exception as e:
            out.append({**config, "status": "failed", "error": str(e)[:500]})
        if folder:
            name = str(config.get("name", i))
            save_json(out[-1], os.path.join(folder, name, "results.json" if out[-1]["status"] == "ok" else "error.json"))
    if folder:
        save_json({"runs": len(out), "ok": sum(r["status"] == "ok" for r in out), "failed": [r.get("name", i) for i, r in enumerate(out) if r["status"] == "failed"]}, os.path.join(folder, "summary.json"))
    return out


def load_runs(folder: str, part: str = "") -> dict[str, dict]:
    """The results of the runs whose folder's name holds ``part``: results.json, else results.pkl of a trusted run; runs with neither are left out."""
    found = {}
    for name in sorted(os.listdir(folder)):
        if part not in name:
            continue
        text, pickled = (os.path.join(folder, name, f"results.{kind}") for kind in ("json", "pkl"))
        if os.path.exists(text):
            with open(text, encoding="utf-8") as f:
                found[name] = json.load(f)
        elif os.path.exists(pickled):
            with open(pickled, "rb") as f:
                found[name] = pickle.load(f)
    return found


def save_json(record: dict, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(record, f, indent=1)
