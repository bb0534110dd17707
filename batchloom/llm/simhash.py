"""SimHash near-duplicates found over pigeonhole blocks.

Fingerprints of 64 bits are cut into six blocks. Two that differ in at most four bits agree in
at least two blocks, so every close pair meets under one of the fifteen pairs of blocks (21 bits
or so each). Only distinct fingerprints are compared; equal ones are one node already. Inside a
block group a sweep links each fingerprint to the first that reaches it, which leaves at most
one edge a member and never a list of all pairs. Groups over ``GROUP`` members are cut by the bits
they do not share; what is large even then is split into cells that cover each pair of parts, so
none has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.llm.common import Scratch
from batchloom.llm.components import connected_components

SHINGLE, SEED, BITS, GROUP = 4, 42, 4, 1024
#: Ids of dropped rows that are broadcast at most; more are joined by a shuffle of the rows.
GONE = 2_000_000
#: (first bit, width) of the blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: The blocks of the bits that a pair of blocks leaves (44 at most).
FURTHER = ((0, 6), (6, 6), (12, 6), (18, 6), (24, 5), (29, 5), (34, 5), (39, 5))


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each ``width`` words in a row; none for a null text or one without words.

    Words are cut at space and 0x09-0x0D, A-Z is lowered and nothing else; a text of fewer than
    ``width`` words is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII rules for both
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends, digest = ends[-n:].tolist(), xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)), np.uint64, n)


def majority(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """The fingerprint over ``hashes``, 64 bits a word: a bit is 1 if set in over half of them; zeros if there are none.

    The first word is that of the hashes themselves, each further one that of a further hash of them (splitmix64).
    """
    counts, steps = np.zeros(64 * words, np.int64), np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255):  # a byte holds the count, and the memory is bounded for very long texts
        mixed = hashes[at : at + 255, None] + steps
        if words > 1:
            more = mixed[:, 1:]
            more = (more ^ (more >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            more = (more ^ (more >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed[:, 1:] = more ^ (more >> np.uint64(31))
        counts += np.add.reduce(np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def simhash(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint over ``shingle_hashes``; 0 if there are none."""
    return int(majority(shingle_hashes(text, width))[0])


def _hashed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(x.as_py(), width) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp bigint) of every row's whole text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_hashed(width), "doc_id bigint, fp bigint")


def sweep(prints: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Edges that connect exactly what links of at most ``bits`` differing bits connect."""
    edges, rest = [], prints
    while rest.size > 1:
        ahead, rest = [rest[0]], rest[1:]
        while ahead and rest.size:
            at = ahead.pop()
            close = np.bitwise_count(rest ^ at) <= bits
            if close.any():
                found = rest[close]
                edges += [(int(at), int(x)) for x in found]
                ahead += list(found)
                rest = rest[~close]
    return edges


def _swept(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _ended(batches):
            if batch is not None:
                rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
                held = rows if held is None else np.concatenate((held, rows), axis=1)
            if held is None or not held.shape[1]:
                continue
            new = np.flatnonzero((held[:3, 1:] != held[:3, :-1]).any(axis=0)) + 1
            cuts = [0, *new.tolist(), *([held.shape[1]] if batch is None else [])]
            out = []
            for s, e in zip(cuts, cuts[1:]):
                if e - s > 1:
                    out += sweep(held[3, s:e].view(np.uint64), bits)
            held = None if batch is None else held[:, cuts[-1] :].copy()
            if out:
                pairs = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(prints: DataFrame, scratch: Scratch, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough to connect all that differ in ``bits`` or less.

    ``prints`` has one row for each distinct ``fp``. ``bits`` may be 0 to 4.
    """
    if not 0 <= bits <= 4:
        raise ValueError("six blocks find up to four differing bits")
    pairs = list(combinations(BLOCKS, 2))
    block = lambda x, at, width: F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << width) - 1))
    both = lambda x, one, two: F.shiftleft(block(x, *one), two[1]).bitwiseOR(block(x, *two))
    key = lambda i, v: F.struct(F.lit(i).cast("bigint").alias("k"), v.alias("v"))
    rows = prints.select("fp", F.explode(F.array(*[key(i, both("fp", *p)) for i, p in enumerate(pairs)])).alias("key")).select("key.k", "key.v", "fp")
    large = _large(rows, scratch, group)
    if not large.isEmpty():
        # the bits that a large group does not share are cut again: of eight blocks at least four agree, and so some two do
        rest = F.lit(0).cast("bigint")
        for i, p in enumerate(pairs):
            left = F.lit(0).cast("bigint")
            for at, width in (x for x in BLOCKS if x not in p):
                left = F.shiftleft(left, width).bitwiseOR(block("fp", at, width))
            rest = F.when(F.col("k") == i, left).otherwise(rest)
        further = list(combinations(FURTHER, 2))
        deep = rows.join(large.select("k", "v"), ["k", "v"], "left_semi").withColumn("rest", rest)
        deep = deep.select("k", "v", "fp", F.explode(F.array(*[key(i, both("rest", *p)) for i, p in enumerate(further)])).alias("key"))
        deep = deep.select((F.col("k") * 100 + F.col("key.k") + 1).alias("k"), F.shiftleft("v", 12).bitwiseOR(F.col("key.v")).alias("v"), "fp")
        shallow = rows.join(large.select("k", "v"), ["k", "v"], "left_anti")
        rows = shallow.select((F.col("k") * 100).alias("k"), F.shiftleft("v", 12).alias("v"), "fp").unionByName(deep)
        large = _large(rows, scratch, group)
    if large.isEmpty():
        rows = rows.withColumn("cell", F.lit(0).cast("bigint"))
    else:
        # what is still large is near-equal throughout: every pair of parts is a cell; each member goes to the cells of its part
        part = F.pmod(F.xxhash64("fp"), F.col("parts"))
        cells = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda j: F.least(part, j) * F.col("parts") + F.greatest(part, j))
        rows = rows.join(large, ["k", "v"], "left").withColumn("cell", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.array_distinct(cells)))).select("k", "v", "fp", "cell")
    return rows.repartition("k", "v", "cell").sortWithinPartitions("k", "v", "cell").select("k", "v", "cell", "fp").mapInArrow(_swept(bits), "a bigint, b bigint")


def _large(rows: DataFrame, scratch: Scratch, group: int) -> DataFrame:
    """(k, v, parts) of the groups over ``group`` members."""
    return scratch.save(rows.groupBy("k", "v").count().where(F.col("count") > group).select("k", "v", F.ceil(F.col("count") / group).alias("parts")), "large")


def grouped(docs: DataFrame, scratch: Scratch, width: int = SHINGLE, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, root, component_id) of every distinct fingerprint."""
    prints = scratch.save(fingerprints(docs, width), "prints")
    least = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(links(least.select("fp"), scratch, bits), scratch)
    placed = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints, scratch.save(placed.join(named, "root").select("fp", "root", "component_id"), "names")


def near_duplicates(docs: DataFrame, scratch: Scratch, width: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    component_id is the smallest non-null doc_id whose fingerprint is reachable over links of at
    most ``bits`` differing bits (null if there is none). Rows with equal ids stay separate rows;
    an empty table gives no rows; other columns are not read.
    """
    prints, names = grouped(docs, scratch, width, bits)
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, scratch: Scratch, width: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id.

    Of several rows with that id (or of a group in which all ids are null) any one stays.
    """
    prints, names = grouped(docs, scratch, width, bits)
    return first_rows(docs, scratch, prints, names, lambda text: simhash(text, width))


def first_rows(docs: DataFrame, scratch: Scratch, prints: DataFrame, names: DataFrame, key: Callable[[str | None], int]) -> DataFrame:
    """One row of each group: ``prints`` and ``names`` as from ``grouped``, ``key`` gives a text's fp."""
    rows = prints.join(names, "fp").withColumn("first", F.col("doc_id").eqNullSafe(F.col("component_id")))
    counted = scratch.save(rows.where("first").groupBy("root").agg(F.count("*").alias("n"), F.first("doc_id").alias("doc_id")), "kept")
    gone = scratch.save(rows.where("NOT first").select("doc_id").distinct(), "gone")
    alone = counted.where("n > 1 OR doc_id IS NULL").isEmpty() and gone.where("doc_id IS NULL").isEmpty()
    if alone and gone.join(counted, "doc_id", "left_semi").isEmpty():
        # mostly few are gone, and so the texts stay where they are
        return docs.join(F.broadcast(gone) if gone.count() <= GONE else gone, "doc_id", "left_anti").select(*docs.columns)
    # ids repeat: the fingerprint, and no longer the id, tells a group's rows apart
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text, doc_id = (f"c{docs.columns.index(c)}" for c in ("text", "doc_id"))
    schema = T.StructType([*plain.schema.fields, T.StructField("_fp", T.LongType())])
    rows = plain.mapInArrow(_beside(plain.columns.index(text), key), schema).join(names.withColumnRenamed("fp", "_fp"), "_fp")
    one = rows.where(F.col(doc_id).eqNullSafe(F.col("component_id"))).dropDuplicates(["root"])
    return one.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _beside(text: int, key: Callable[[str | None], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([key(x.as_py()) for x in batch.column(text)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], [*batch.schema.names, "_fp"])

    return run
