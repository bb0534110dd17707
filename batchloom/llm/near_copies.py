"""Near-duplicates by SimHash over blocks, each link decided by the exact Jaccard similarity of word shingles.

Two texts of Jaccard ``LIKE`` or more differ in some 15% of the bits of their SimHash (at most
0.152 of them on average for large sets), which no cut of 64 bits into blocks finds. So the fingerprint has
``64 * WORDS`` bits, cut into ``BLOCKS`` blocks of ``WIDE`` bits each. A pair at ``LIKE`` agrees in a
block with a chance of (1 - 0.152)^WIDE, and in none with one of 1.4 in a million. Sets of four
and five shingles, whose bits differ more often, meet under each four of their shingles too, which
loses none. Of those that meet, what differs in over ``FAR`` of the first 192 bits is let go (six
deviations above the mean of a pair at ``LIKE``, and five below that of unrelated texts). That still
lets pairs of some 0.4 pass, so what a heap of blocks unites is told apart on all bits, at seven
deviations. Every link is then decided on the whole sets of shingles.

Only distinct sets are compared. The shingles are moved once all bits are read, when each set is in
one group alone, however many blocks it shares; a sweep links a member to the first that reaches it
and never lists all pairs. Groups over their bound are split into cells that cover each pair of
parts, so none has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import Scratch, setting, tidied
from batchloom.llm.components import connected_components
from batchloom.llm.simhash import first_rows, majority, shingle_hashes

WIDTH, LIKE, GROUP, BUCKET = 5, 0.8, 1024, 4096
WORDS, BLOCKS, WIDE = 28, 128, 14
#: Differing bits of the first word, and of the first three, beyond which a pair is let go.
FAR_ONE, FAR = 27, 60
#: Differing bits of all words beyond which it is let go: seven deviations above the mean of a pair at ``LIKE``, which is
#: 0.1875 of the bits for four shingles in five and at most 0.1611 (12 in 15) where both sets are larger.
FAR_FEW, FAR_ALL = 452, 400
_EDGE, _SMALL, _TILE = 1e-9, 64, 1 << 18


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The set of a text's shingles: sorted distinct hashes."""
    return np.unique(shingle_hashes(text, width))


def name(some: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(some.tobytes())


def fours(some: np.ndarray) -> list[int]:
    """Keys that sets of four or five shingles share if four of them are equal: the only way for a set of four to reach 0.8 with another."""
    return [xxhash.xxh64_intdigest(np.array(x).tobytes()) >> 1 | 1 << 62 for x in combinations(some, 4)] if len(some) in (4, 5) else []


def _sketched(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = [shingles(x.as_py(), width) for x in batch.column(1).slice(at, 256)]
                prints = [majority(x, WORDS).tobytes() if len(x) else b"" for x in some]
                out = [batch.column(0).slice(at, 256), pa.array(np.array([name(x) for x in some], np.uint64).view(np.int64)), pa.array(prints, pa.binary()), pa.array([fours(x) for x in some], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "fp", "print", "fours"])

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cut(batch: pa.RecordBatch) -> np.ndarray:
    """(fp, print, fours) to rows (k, fp, three first words): k is a block's number and bits; keys of fours come with zeros, so what shares them is near."""
    fp = batch.column(0).to_numpy().view(np.uint64)
    words = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, WORDS)
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").reshape(len(fp), BLOCKS, WIDE)
    keys = bits @ (1 << np.arange(WIDE, dtype=np.uint64)) + (np.arange(BLOCKS, dtype=np.uint64) << np.uint64(WIDE))
    further = batch.column(2).to_pylist()
    more = np.array([(k, f, 0, 0, 0) for f, x in zip(fp.tolist(), further, strict=True) for k in x], np.uint64).reshape(-1, 5)
    return np.concatenate((np.column_stack((keys.ravel(), np.repeat(fp, BLOCKS), np.repeat(words[:, :3], BLOCKS, axis=0))), more))


def celled(rows: np.ndarray, large: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """``rows`` with k of bucket and cell: the members of a ``large`` bucket (sorted) once for each cell, a pair of parts, that theirs is in."""
    at = np.minimum(np.searchsorted(large, rows[:, 0]), max(0, len(large) - 1))
    many = np.where(large[at] == rows[:, 0], parts[at], 1).astype(np.int64) if len(large) else np.ones(len(rows), np.int64)
    row = np.repeat(np.arange(len(rows)), many)
    many = many[row].astype(np.uint64)
    other = np.arange(len(row), dtype=np.uint64) - np.searchsorted(row, row).astype(np.uint64)
    rows = rows[row]
    own = _mixed(rows[:, 1]) % many
    rows[:, 0] = _mixed(_mixed(rows[:, 0]) + np.minimum(own, other) * many + np.maximum(own, other))
    return rows


def _dealt(heaps: int, large: np.ndarray, parts: np.ndarray):
    """(heap, rows): the rows of many sets packed by the heap of their k, so that Spark moves a few long rows."""

    step = max(1, 1024 // int(parts.max(initial=1)))  # bounded memory where a set is in many cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = celled(cut(batch.slice(at, step)), large, parts)
                heap = rows[:, 0] % np.uint64(heaps)
                order = np.argsort(heap, kind="stable")
                names, firsts = np.unique(heap[order], return_index=True)
                ends = np.append(firsts, len(rows)).astype(np.int32) * 40
                blobs = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(ends), pa.py_buffer(rows[order])])
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), blobs], ["heap", "rows"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield pa.RecordBatch.from_arrays([pa.array(cut(batch.slice(at, 1024))[:, 0].view(np.int64))], ["k"])


def meeting(starts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of columns of ``words`` (three rows) in one bucket that differ in few enough bits; ``starts``: the buckets' first columns and the end."""
    sizes = np.diff(starts)
    ones, twos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def take(a: np.ndarray, b: np.ndarray) -> None:
        near = np.bitwise_count(words[0, a] ^ words[0, b]) <= FAR_ONE
        a, b = a[near], b[near]
        near = sum(np.bitwise_count(words[i, a] ^ words[i, b]).astype(np.int64) for i in range(3)) <= FAR
        ones.append(a[near])
        twos.append(b[near])

    end = np.repeat(starts[1:], np.where(sizes <= _SMALL, sizes, 0))
    at = np.flatnonzero(np.repeat(sizes <= _SMALL, sizes))
    for step in range(1, _SMALL):  # small buckets, all at once
        left = at + step < end
        at, end = at[left], end[left]
        if not len(at):
            break
        take(at, at + step)
    for i in np.flatnonzero(sizes > _SMALL):
        s, e = int(starts[i]), int(starts[i + 1])
        high = max(1, _TILE // (e - s))
        for a in range(s, e, high):  # bounded memory
            one = np.bitwise_count(words[0, a : a + high, None] ^ words[0, None, a:e]) <= FAR_ONE
            x, y = np.nonzero(np.triu(one, 1))
            take(a + x, a + y)
    return np.concatenate(ones), np.concatenate(twos)


def labelled(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of ``n`` reaches over the pairs."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, fp) of what is near inside the buckets of ``rows``, united over the buckets: k is the least fp that fp reaches."""
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    new = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
    a, b = meeting(np.array([0, *new.tolist(), len(rows)], np.int64), np.ascontiguousarray(rows[:, 2:].T))
    names, at = np.unique(rows[:, 1], return_inverse=True)
    label, among = labelled(len(names), at[a], at[b]), np.unique(np.concatenate((at[a], at[b])))
    return names[label[among]], names[among]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (heap, rows) sorted by heap to (k, fp)."""
    name_, held = None, []

    def ended():
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in groups(np.frombuffer(b"".join(held), np.uint64).reshape(-1, 5))], ["k", "fp"])

    for batch in batches:
        for heap, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if heap != name_:
                if held:
                    yield ended()
                name_, held = heap, []
            held.append(rows.as_py())
    if held:
        yield ended()


def met(least: DataFrame, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """(k, fp): groups of sets whose fingerprints share a block and are near, each named by its least, ``least`` being (fp, print, fours) of the distinct sets.

    Two sets that meet are together in a group; a set is in one a heap at most, and heaps find the
    same groups again, which are one by their name. Buckets over ``bucket`` members are told by a share of the sets; the cells they are cut into
    cover each pair of parts, so that what is told wrongly is uneven, and not lost.
    """
    some = least.where("length(print) > 0").select("fp", "print", "fours")
    share = max(1, bucket // 64)
    seen = some.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0).mapInArrow(tidied(_keys), "k bigint").groupBy("k").count().where(F.col("count") * share > bucket)
    found = seen.orderBy("k").toArrow()  # of at most 2^21 keys of blocks, and those fours that are frequent
    large, parts = found["k"].to_numpy().view(np.uint64), -(-found["count"].to_numpy() * share // bucket)
    heaps = max(1, least.count() * BLOCKS * 40 >> 22)  # of 4 MB or so
    dealt = some.mapInArrow(tidied(_dealt(heaps, large, parts)), "heap bigint, rows binary").repartition("heap").sortWithinPartitions("heap")
    return scratch.save(dealt.mapInArrow(tidied(_met), "k bigint, fp bigint").distinct(), "met")


def near(prints: np.ndarray, few: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``prints`` (``WORDS`` columns) that differ in few enough of all bits; ``few``: sets of four or five shingles."""
    ones, twos, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.ascontiguousarray(prints.T)
    high = max(1, _TILE // max(1, len(prints)))
    for a in range(0, len(prints), high):  # bounded memory
        differ = sum(np.bitwise_count(x[a : a + high, None] ^ x[None, a:]).astype(np.uint16) for x in columns)
        close = differ <= np.where(few[a : a + high, None] | few[None, a:], FAR_FEW, FAR_ALL)
        x, y = np.nonzero(np.triu(close, 1))
        ones.append(a + x)
        twos.append(a + y)
    return np.concatenate(ones), np.concatenate(twos)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, cell, fp, print, few) sorted by k and cell to edges (a, b) that connect what is near on all bits."""
    for names, prints, few in _grouped(batches):
        names, few = np.array(names, np.int64), np.array(few, bool)
        label = labelled(len(names), *near(np.frombuffer(b"".join(prints), np.uint64).reshape(-1, WORDS), few))
        moved = np.flatnonzero(label != np.arange(len(names)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(names[label[moved]]), pa.array(names[moved])], ["a", "b"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, ...]]:
    """The further columns of rows (k, cell, ...) sorted by both, for each (k, cell) of several rows."""
    key, held = None, None
    for batch in batches:
        # long values one by one, not a second copy of the batch
        for k, cell, *row in zip(*[(v.as_py() for v in x) if pa.types.is_binary(x.type) else x.to_pylist() for x in batch.columns], strict=True):
            if (k, cell) != key:
                if held and len(held[0]) > 1:
                    yield held
                key, held = (k, cell), tuple([] for _ in row)
            for x, value in zip(held, row, strict=True):
                x.append(value)
    if held and len(held[0]) > 1:
        yield held


def in_cells(members: DataFrame, group: int) -> DataFrame:
    """(k, cell, fp) of ``members`` (k, fp): those of a group over ``group`` members once for each cell, a pair of parts, that theirs is in."""
    parts = members.groupBy("k").agg(F.ceil(F.count("*") / group).alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    cells = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda j: F.least(part, j) * F.col("parts") + F.greatest(part, j))
    return members.join(parts, "k").withColumn("cell", F.explode(F.array_distinct(cells))).select("k", "cell", "fp")


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = [shingles(x.as_py(), width) for x in batch.column(0).slice(at, 256)]
                prints = np.array([name(x) for x in some], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(prints), pa.array([x.tobytes() for x in some], pa.binary())], ["fp", "items"])

    return run


def sweep(prints: list[int], sets: list[np.ndarray], like: float = LIKE) -> list[tuple[int, int]]:
    """Edges that connect exactly what links of Jaccard similarity ``like`` or more connect."""
    edges, prints = [], np.array(prints, np.int64)
    sizes = np.array([len(x) for x in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    rest, first = np.ones(len(sets), bool), 0
    while rest.any():
        first = int(np.argmax(rest))
        rest[first], ahead = False, [first]
        while ahead:
            at = ahead.pop()
            left = rest[owner]
            flat, owner = flat[left], owner[left]
            if not len(flat):
                break
            mine = sets[at]
            spot = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            both = np.bincount(owner[mine[spot] == flat], minlength=len(sets))
            close = np.flatnonzero(rest & (both >= like * (sizes + len(mine) - both) - _EDGE))
            edges += [(int(prints[at]), int(prints[x])) for x in close]
            rest[close] = False
            ahead += close.tolist()
    return edges


def _swept(like: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for prints, items in _grouped(batches):
            pairs = np.array(sweep(prints, [np.frombuffer(x, np.uint64) for x in items], like), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def grouped(docs: DataFrame, scratch: Scratch, width: int = WIDTH, like: float = LIKE, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, fp naming its set, and (fp, root, component_id) of every distinct set."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = scratch.save(plain.mapInArrow(tidied(_sketched(width)), "doc_id bigint, fp bigint, print binary, fours array<bigint>"), "sketches")
    least = scratch.save(seen.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.first("print").alias("print"), F.first("fours").alias("fours")), "distinct")
    rows = met(least, scratch, group * BUCKET // GROUP)
    told = in_cells(rows, group).join(least.select("fp", "print", (F.size("fours") > 0).alias("few")), "fp").select("k", "cell", "fp", "print", "few")
    close = told.repartition("k", "cell").sortWithinPartitions("k", "cell").mapInArrow(tidied(_told), "a bigint, b bigint")
    members = connected_components(close, scratch).select(F.col("root").alias("k"), F.col("node").alias("fp"))
    wanted = members.select("fp")
    ids = scratch.save(least.join(wanted, "fp", "left_semi").select(F.col("first_id").alias("_id")).distinct(), "wanted")
    texts = plain.join(ids, plain["doc_id"].eqNullSafe(ids["_id"]), "left_semi").select("text")
    sets = scratch.save(texts.mapInArrow(tidied(_sets(width)), "fp bigint, items binary").join(wanted, "fp", "left_semi").groupBy("fp").agg(F.first("items").alias("items")), "sets")
    dealt = in_cells(members, group).join(sets, "fp").select("k", "cell", "fp", "items")
    edges = dealt.repartition("k", "cell").sortWithinPartitions("k", "cell").mapInArrow(tidied(_swept(like)), "a bigint, b bigint")
    roots = connected_components(edges, scratch)
    placed = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return seen.select("doc_id", "fp"), scratch.save(placed.join(named, "root").select("fp", "root", "component_id"), "names")


def keep_one(docs: DataFrame, scratch: Scratch, width: int = WIDTH, like: float = LIKE) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id.

    A group is what links of Jaccard similarity ``like`` or more connect; texts without words are
    one group. Of several rows with the smallest id (or of a group in which all ids are null) any
    one stays.
    """
    # shuffle files go with the table they are for: those of the blocks are the most that this stage has on disk
    with setting(scratch.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        prints, names = grouped(docs, scratch, width, like)
        return first_rows(docs, scratch, prints, names, lambda text: name(shingles(text, width)))
