"""Embedding near-duplicates by a robust-pruned flat graph over overlapping cluster shards.

1. Bitwise equal vectors become one class with a count. 2. Centroids fitted on a bounded sample
put every class into its nearest cells (two or more: the shards overlap); a cell over ``PART``
members is cut into parts, and each pair of parts is a shard. 3. In each shard a graph is built
with robust pruning; the adjacency lists of a vector from all its shards are united. 4. In each
shard every member runs a greedy search from the shard's medoids, those of the graph's connected
parts and its own node, and expands over all nodes near the range. What is found is verified by its cosine in double precision.

A pair that meets in several shards is counted in the first of them, so no pair ever becomes a
row: a shard returns link counts, and as edges no more than a spanning forest. Recall is audited
against brute force on a fixed number of queries; if it is below ``RECALL`` the overlap is raised, and
at last an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import Scratch
from batchloom.llm.components import connected_components

COSINE = 0.9
#: Vectors the centroids are fitted on, members a cell aims at, members of a part, cells at most.
FIT_VECTORS, CELL, PART, CELLS = 20_000, 1500, 4096, 4096
#: Least number of cells a vector is put into, and how much worse than the best further ones may be.
OVERLAP, MARGIN = 2, 0.06
DEGREE, CANDIDATES, ALPHA, BEAM = 24, 48, 1.2, 8
#: How far below the range nodes are still expanded.
REACH = 0.1
AUDIT, RECALL = 256, 0.9


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x in batch.column(1):
            v = x.as_py()
            ok = v is not None and len(v) > 0 and None not in v
            if ok:
                a = np.array(v, np.float64)
                with np.errstate(all="ignore"):
                    a = a / np.abs(a).max() if np.isfinite(a).all() and a.any() else a  # no overflow in the norm
                    a = a / np.sqrt((a * a).sum())
                ok = bool(np.isfinite(a).all())
            out.append(a.tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "unit"])


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, unit): the unit vector's doubles as bytes, null where a vector links with nothing."""
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_valid, "vec_id bigint, unit binary")


def _matrix(column) -> np.ndarray:
    blobs = list(column)
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means; the first centroids are spread over the sample."""
    rng = np.random.default_rng(7)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        at = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def _placed(shared, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, first = shared.value
        for batch in batches:
            cells = []
            for blob in batch.column(1):
                v = np.frombuffer(blob.as_py(), np.float64)
                near = centres[len(v)] @ v
                order = np.argsort(-near, kind="stable")
                n = max(min(overlap, len(order)), int((near >= near[order[0]] - MARGIN).sum()))
                cells.append((order[:n] + first[len(v)]).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], [*batch.schema.names, "cells"])

    return run


def _pruned(x: np.ndarray, near: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """Robust pruning of candidate lists (rows sorted by similarity, -1 padded) to ``DEGREE``."""
    n, c = near.shape
    out = np.full((n, DEGREE), -1, np.int64)
    for at in range(0, n, 512):
        ids, far = near[at : at + 512], 2 - 2 * sims[at : at + 512]
        v = x[np.maximum(ids, 0)]
        between = 2 - 2 * np.einsum("bcd,bed->bce", v, v, optimize=True)
        alive = ids >= 0
        rows = np.arange(len(ids))
        for k in range(DEGREE):
            has = alive.any(axis=1)
            if not has.any():
                break
            pick = np.where(has, alive.argmax(axis=1), 0)
            out[at : at + 512, k] = np.where(has, ids[rows, pick], -1)
            alive &= (ALPHA**2 * between[rows, pick] > far) & has[:, None]
            alive[rows, pick] = False
    return out


def build(x: np.ndarray, candidates: int = CANDIDATES) -> np.ndarray:
    """Adjacency (-1 padded) of one shard: robust pruning of the nearest members, then of the
    lists with the reverse edges added."""
    n = len(x)
    if n < 2:
        return np.full((n, DEGREE), -1, np.int64)
    c = min(candidates, n - 1)
    near, sims = np.zeros((n, c), np.int64), np.zeros((n, c))
    small = x.astype(np.float32)
    for at in range(0, n, 512):
        s = small[at : at + 512] @ small.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        top = np.argpartition(-s, c - 1, axis=1)[:, :c]
        got = np.take_along_axis(s, top, axis=1)
        order = np.argsort(-got, axis=1, kind="stable")
        near[at : at + 512], sims[at : at + 512] = np.take_along_axis(top, order, axis=1), np.take_along_axis(got, order, axis=1)
    forward = _pruned(x, near, sims)
    a = np.repeat(np.arange(n), DEGREE)
    b = forward.ravel()
    a, b = a[b >= 0], b[b >= 0]
    pairs = np.unique(np.concatenate((a * n + b, b * n + a)))
    a, b = pairs // n, pairs % n
    s = np.einsum("ij,ij->i", x[a], x[b])
    order = np.lexsort((-s, a))
    a, b, s = a[order], b[order], s[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    kept = rank < candidates
    near, sims = np.full((n, candidates), -1, np.int64), np.full((n, candidates), -2.0)
    near[a[kept], rank[kept]], sims[a[kept], rank[kept]] = b[kept], s[kept]
    return _pruned(x, near, sims)


def medoids(x: np.ndarray, k: int = 16) -> np.ndarray:
    """Members next to the shard's mean and to the means of a few groups."""
    groups = centroids(x, min(k, len(x)), 3)
    mean = x.mean(axis=0, keepdims=True)
    return np.unique((np.concatenate((mean, groups)) @ x.T).argmax(axis=1))


def parts(adjacency: np.ndarray) -> np.ndarray:
    """The least node of each node's connected part, edges taken both ways."""
    n = len(adjacency)
    a, at = np.nonzero(adjacency >= 0)
    b = adjacency[a, at]
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def starts(x: np.ndarray, adjacency: np.ndarray) -> np.ndarray:
    """The shard's medoids, and the medoid of each connected part: no part is out of reach."""
    label = parts(adjacency)
    _, part = np.unique(label, return_inverse=True)
    means = np.zeros((part.max() + 1, x.shape[1]))
    np.add.at(means, part, x)
    near = np.einsum("ij,ij->i", x, means[part])
    order = np.lexsort((-near, part))
    firsts = order[np.concatenate(([True], part[order][1:] != part[order][:-1]))]
    return np.unique(np.concatenate((medoids(x), firsts)))


def search(x: np.ndarray, adjacency: np.ndarray, queries: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) index pairs with cosine >= ``cosine`` that greedy range search finds, itself left out."""
    begin, found_q, found_n = starts(x, adjacency), [], []
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        rows = np.arange(len(q))
        seen = np.zeros((len(q), len(x)), bool)
        sims = np.full((len(q), len(x)), -2.0)

        def visit(r, nodes):
            new = (nodes >= 0) & ~seen[r, np.maximum(nodes, 0)]
            r, nodes = r[new], nodes[new]
            pairs = np.unique(r * len(x) + nodes)
            r, nodes = pairs // len(x), pairs % len(x)
            seen[r, nodes] = True
            sims[r, nodes] = np.einsum("ij,ij->i", x[q[r]], x[nodes])
            return r, nodes

        visit(np.repeat(rows, len(begin)), np.tile(begin, len(q)))
        visit(rows, q)
        expanded = np.zeros_like(seen)
        # greedy: the best BEAM nodes seen so far are expanded until they all have been
        while True:
            rank = np.where(seen, sims, -3.0)
            beam = np.argpartition(-rank, min(BEAM, len(x)) - 1, axis=1)[:, :BEAM]
            r, b = np.repeat(rows, beam.shape[1]), beam.ravel()
            todo = seen[r, b] & ~expanded[r, b]
            if not todo.any():
                break
            r, b = r[todo], b[todo]
            expanded[r, b] = True
            visit(np.repeat(r, adjacency.shape[1]), adjacency[b].ravel())
        # range expansion: everything near the range is expanded, and what that reaches in turn
        while True:
            r, b = np.nonzero(seen & ~expanded & (sims >= cosine - REACH))
            if not len(r):
                break
            for i in range(0, len(r), 20_000):
                expanded[r[i : i + 20_000], b[i : i + 20_000]] = True
                visit(np.repeat(r[i : i + 20_000], adjacency.shape[1]), adjacency[b[i : i + 20_000]].ravel())
        r, b = np.nonzero(sims >= cosine)
        other = q[r] != b
        found_q.append(q[r[other]])
        found_n.append(b[other])
    return np.concatenate(found_q), np.concatenate(found_n)


def _build_shard(candidates: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["vec_id"].to_numpy()
        adjacency = build(_matrix(pdf["unit"]), candidates)
        return pd.DataFrame({"vec_id": ids, "near": [ids[row[row >= 0]].tolist() for row in adjacency]})

    return run


def _search_shard(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", ignore_index=True)
        ids, x, shard = pdf["vec_id"].to_numpy(), _matrix(pdf["unit"]), int(pdf["shard"].iloc[0])
        weight, n = pdf["n"].to_numpy(), len(pdf)
        lists = [np.searchsorted(ids, a[np.isin(a, ids)]) if a is not None else np.zeros(0, np.int64) for a in (np.asarray(v, np.int64) if v is not None else None for v in pdf["near"])]
        adjacency = np.full((n, max([1, *map(len, lists)])), -1, np.int64)
        for i, row in enumerate(lists):
            adjacency[i, : len(row)] = row
        a, b = search(x, adjacency, np.arange(n), cosine)
        pairs = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
        a, b = pairs // n, pairs % n
        # a pair belongs to the first shard that both members share
        own = [np.asarray(s) for s in pdf["shards"]]
        width = max(map(len, own))
        table = np.full((n, width), -1, np.int64)
        for i, s in enumerate(own):
            table[i, : len(s)] = s
        mine = np.ones(len(a), bool)
        for k in range(width):
            s = table[a, k]
            early = (s >= 0) & (s < shard)
            if early.any():
                mine[early] &= ~(table[b[early]] == s[early, None]).any(axis=1)
        a, b = a[mine], b[mine]
        links = np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
        parent = np.arange(n)
        forest = []

        def top(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            p, r = top(i), top(j)
            if p != r:
                parent[max(p, r)] = min(p, r)
                forest.append((i, j))
        rows = pd.DataFrame({"vec_id": ids, "other": ids, "links": links.astype(np.int64)})
        if forest:
            f = np.array(forest)
            rows = pd.concat([rows, pd.DataFrame({"vec_id": ids[f[:, 0]], "other": ids[f[:, 1]], "links": 0})])
        return rows

    return run


def _exact(shared, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        counts = np.zeros(len(ids), np.int64)
        for batch in batches:
            blobs, weight = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for dim in {len(b) for b in blobs}:
                at = [i for i, b in enumerate(blobs) if len(b) == dim]
                same = [i for i, q in enumerate(queries) if 8 * len(q) == dim]
                if same:
                    hit = np.stack([queries[i] for i in same]) @ _matrix([blobs[i] for i in at]).T >= cosine
                    counts[same] += hit @ weight[at]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts)], ["vec_id", "n"])

    return run


def link(classes: DataFrame, scratch: Scratch, cosine: float, overlap: int, candidates: int = CANDIDATES) -> DataFrame:
    """(vec_id, other, links) of classes (vec_id, unit, n): counts where other is vec_id, else edges."""
    spark = classes.sparkSession
    total = classes.count()
    sample = classes.orderBy(F.xxhash64("vec_id")).limit(FIT_VECTORS).select("unit").collect()
    by_dim: dict[int, list[np.ndarray]] = {}
    for r in sample:
        v = np.frombuffer(bytes(r["unit"]), np.float64)
        by_dim.setdefault(len(v), []).append(v)
    k = min(CELLS, max(1, round(total * overlap / CELL)))
    centres = {d: centroids(np.stack(vs), max(1, round(k * len(vs) / len(sample)))) for d, vs in by_dim.items()}
    dims = [r["d"] for r in classes.select((F.length("unit") / 8).cast("int").alias("d")).distinct().collect()]
    for d in dims:  # a length that the sample missed is rare: one cell
        centres.setdefault(d, np.full((1, d), d**-0.5))
    first, n = {}, 0
    for d, c in sorted(centres.items()):
        first[d], n = n, n + len(c)
    shared = spark.sparkContext.broadcast((centres, first))
    placed = scratch.save(classes.mapInArrow(_placed(shared, overlap), "vec_id bigint, unit binary, n bigint, cells array<bigint>"), "placed")
    # one row a cell, CELLS at most and one more a vector length
    sizes = {r["cell"]: r["count"] for r in placed.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()}
    rows, base = [], 0
    for cell, size in sorted(sizes.items()):
        parts = -(-size // PART)
        rows.append((cell, parts, base))
        base += parts * parts
    table = F.broadcast(spark.createDataFrame(rows, "cell bigint, parts bigint, base bigint"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    of_cell = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda j: F.col("base") + F.least(part, j) * F.col("parts") + F.greatest(part, j))
    spots = placed.select("vec_id", F.explode("cells").alias("cell")).join(table, "cell").groupBy("vec_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(of_cell)))).alias("shards"))
    members = scratch.save(placed.drop("cells").join(spots, "vec_id"), "members")
    each = members.withColumn("shard", F.explode("shards"))
    built = each.select("shard", "vec_id", "unit").groupBy("shard").applyInPandas(_build_shard(candidates), "vec_id bigint, near array<bigint>")
    united = built.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    ready = scratch.save(members.join(united, "vec_id", "left"), "graph").withColumn("shard", F.explode("shards"))
    return scratch.save(ready.groupBy("shard").applyInPandas(_search_shard(cosine), "vec_id bigint, other bigint, links bigint"), "links")


def near_vectors(vectors: DataFrame, scratch: Scratch, cosine: float = COSINE, audit: int = AUDIT) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) of every row of ``vectors``.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing,
    and vectors of different lengths do not link. Rows are told apart by their vectors, not their
    ids: a repeated row counts as a copy, and rows of one id with different vectors each have their
    own links. A null id is a row of its own that links with nothing. An empty table gives no
    rows; other columns are not read.

    Recall is measured against brute force for ``audit`` vectors chosen by hash and as many of those
    that have links; ``audit_recall`` is null if none of them has a link. Below ``RECALL`` the shards
    overlap more and the lists grow; if that does not help, an error is raised.
    """
    units = scratch.save(unit_vectors(vectors), "units")
    named = units.where("unit IS NOT NULL AND vec_id IS NOT NULL").groupBy("unit").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    # a class is named by a number of its own: ids may repeat
    known = scratch.save(named.select(F.monotonically_increasing_id().alias("vec_id"), "unit", "n", "first_id"), "classes")
    classes = known.select("vec_id", "unit", "n")
    pick = lambda df, salt: df.orderBy(F.xxhash64("vec_id", F.lit(salt))).limit(audit).select("vec_id", "unit").collect()
    overlap, candidates = OVERLAP, CANDIDATES
    while True:
        found = link(classes, scratch, cosine, overlap, candidates)
        counts = scratch.save(found.where("vec_id = other").groupBy("vec_id").agg(F.sum("links").alias("links")), "sums")
        queries = {r["vec_id"]: r["unit"] for r in [*pick(classes, 5), *pick(classes.join(counts.where("links > 0"), "vec_id", "left_semi"), 6)]}
        recall = None
        if queries:
            ids = np.array(list(queries), np.int64)
            shared = classes.sparkSession.sparkContext.broadcast((ids, [np.frombuffer(bytes(u), np.float64) for u in queries.values()]))
            exact = classes.select("unit", "n").mapInArrow(_exact(shared, cosine), "vec_id bigint, n bigint").groupBy("vec_id").agg(F.sum("n").alias("exact"))
            got = exact.join(classes, "vec_id").join(counts, "vec_id", "left").agg(F.sum(F.coalesce("links", F.lit(0))).alias("links"), F.sum(F.col("exact") - F.col("n")).alias("exact")).first()
            recall = got["links"] / got["exact"] if got["exact"] else None
        if recall is None or recall >= RECALL:
            break
        if overlap >= 16:
            raise RuntimeError(f"recall {recall:.3f} stays under {RECALL}")
        overlap, candidates = 2 * overlap, 2 * candidates
    roots = connected_components(found.where("vec_id != other").select(F.col("vec_id").alias("a"), F.col("other").alias("b")), scratch)
    placed = known.join(counts, "vec_id", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left").withColumn("root", F.coalesce("root", "vec_id"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    placed = placed.join(least, "root").select(F.col("unit").alias("_unit"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id")
    out = units.join(placed, (units["unit"] == placed["_unit"]) & units["vec_id"].isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(recall).cast("double").alias("audit_recall"))
