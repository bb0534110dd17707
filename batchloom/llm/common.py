"""What the operators of this subpackage share: table access, shared scratch tables, hashing helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times in ``body`` (a lambda of one column).

    A column that is named inside a lambda of a higher-order function would be computed
    again for every element; bound as a lambda variable it is computed once a row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def numbered(df: DataFrame, *text: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ..., which meet no name that an operator uses inside, and their names by the old ones.

    The columns ``text`` are made strings.
    """
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.select(*[(F.col(f"`{c}`").cast("string") if c in text else F.col(f"`{c}`")).alias(n) for c, n in names.items()]), names


def given_back(names: dict[str, str], own: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``numbered`` under their old names; one that is called like a result of the operator (``own``) becomes input_<name>."""
    return [F.col(n).alias(f"input_{c}" if c in own else c) for c, n in names.items()]


def tidied(run):
    """``run`` for mapInArrow; what a task freed goes back to the system at its end, since the worker lives on beside those of later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # glibc only
                ctypes.CDLL(None).malloc_trim(0)

    return whole


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session for what runs inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """Written tables in the shared folder named by ``spark.checkpoint.dir``.

    They cut the lineage and survive a lost executor. Where the setting is absent (tests on one
    machine) a temporary folder is used; on a cluster its absence is an error.
    The folder goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        conf = spark.sparkContext.getConf()
        base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
        if not base:
            if not conf.get("spark.master", "").startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="batchloom-")
        self.spark, self.tables = spark, []
        self.root = f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def path(self, label: str) -> str:
        return f"{self.root}/{label}-{uuid.uuid4().hex[:8]}"

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Write ``df`` as Parquet now and return a frame that reads it back."""
        path = self.path(label)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_by(self, df: DataFrame, key: str, parts: int, label: str = "t") -> DataFrame:
        """As ``save``, dealt into ``parts`` buckets by ``key``: what groups by it later doesn't move the rows again."""
        name = f"batchloom_{label}_{uuid.uuid4().hex}"
        df.write.bucketBy(parts, key).option("compression", "zstd").option("path", self.path(label)).format("parquet").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def let_go(self) -> None:
        """Have the shuffle files of finished jobs removed: Spark does so when the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that ``save`` gave and nothing reads any more."""
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            self._delete(folder)

    def clear(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone already
            for name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self._delete(self.root)
