"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into segments wherever no piece of the vocabulary holds the two characters on either
side: no segmentation can cross such a place, so each distinct segment is worked out once. The
lattice is relational: the substrings of a segment up to the longest piece are exploded and
equi-joined to the piece table, the edges are grouped by segment, and Spark's ``aggregate`` folds
over them. The fold follows the kind of the model file. Scores that are log-likelihoods are folded
by Viterbi: the path of greatest total. Scores of a BPE file are merge ranks, and their sum means
nothing (Viterbi over them gives other ids than the library for two words of three); there the
fold takes the edges in the order of rank and joins two neighbours where an edge says so, which
gives the library's ids.

Texts are dealt into chunks, and a chunk is written as its distinct segments and their numbers in
the order of the texts. Segments that most chunks hold (at most ``HOT_SEGMENTS``, so their table can
be broadcast) are known to every worker; the ids of the others are sent back to the chunks.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.llm.common import Scratch, let, setting
from batchloom.llm.segments import chunks, gathered, segments

MARK = "▁"
#: Distinct segments that most chunks hold and whose ids are broadcast.
HOT_SEGMENTS = 200_000
#: Bytes of a chunk's texts (a longer text is a chunk alone), and distinct segments of a lattice task.
CHUNK_BYTES, LATTICE_SEGMENTS = 8_000_000, 20_000
#: Buckets of chunks at most (Spark's own bound).
BUCKETS = 100_000
#: Longer segments (runs of one letter, of spaces) are folded where they stand, by the same rule: the
#: lattice keeps the boundaries of a segment in the bits of one number.
LONG = 61
UNKNOWN_PENALTY = 10.0
#: Characters by which the longest piece with the same beginning is found.
_HEAD = 4
_NO_PIECE = (1 << 24) - 1


class Model:
    """Pieces, scores and byte pieces, from a SentencePiece model file or a table of scores.

    ``merges``: the scores are merge ranks of a BPE model (whole numbers), not log-likelihoods.
    """

    def __init__(self, names: list[str], scores: dict[str, tuple[int, float]], unknown: int, bytes_: int | None, merges: bool | None = None):
        self.names, self.scores, self.unknown, self.bytes = names, scores, unknown, bytes_
        self.merges = all(s == int(s) for _, s in scores.values()) if merges is None else merges
        self.longest = max(map(len, scores), default=1)
        self.lowest = min((s for _, s in scores.values()), default=0.0) - UNKNOWN_PENALTY
        order = {s: i for i, s in enumerate(sorted({s for _, s in scores.values()}, reverse=True))}
        self.ranks = {p: order[s] for p, (_, s) in scores.items()}
        self.pairs = {p[k : k + 2] for p in scores for k in range(len(p) - 1)}
        self._raw = self._kinds = None
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("a piece spans words: texts cannot be cut at spaces")

    @classmethod
    def read(cls, path: str) -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(names)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        first = sp.piece_to_id("<0x00>")
        bytes_ = first if first + 256 <= len(names) and all(names[first + b] == f"<0x{b:02X}>" for b in range(256)) else None
        return cls(names, {names[i]: (i, float(sp.get_score(i))) for i in plain}, sp.unk_id(), bytes_)

    def table(self, spark: SparkSession) -> DataFrame:
        """The piece table: a fixed vocabulary, whatever the texts."""
        return spark.createDataFrame([(p, i, s, self.ranks[p]) for p, (i, s) in self.scores.items()], "piece string, id int, score double, rank int")

    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """A small number for each code point, and which two of these stand side by side in a piece."""
        if self._kinds is None:
            number = {c: i + 1 for i, c in enumerate(sorted({c for p in self.pairs for c in p}))}
            kinds, joined = np.zeros(0x110000, np.uint16), np.zeros((len(number) + 1,) * 2, bool)
            for c, i in number.items():
                kinds[ord(c)] = i
            for a, b in self.pairs:
                joined[number[a], number[b]] = True
            self._kinds = kinds, joined
        return self._kinds

    def fallback(self, char: str) -> list[int]:
        return [self.unknown] if self.bytes is None else [self.bytes + b for b in char.encode("utf-8", "replace")]

    def segment(self, segment: str) -> list[int]:
        """The ids of one segment, as the lattice gives them."""
        spans = self._merged(segment) if self.merges else self._best(segment)
        return list(chain.from_iterable([self.scores[p][0]] if p in self.scores else self.fallback(p) for p in (segment[s:e] for s, e in spans)))

    def _merged(self, word: str) -> list[tuple[int, int]]:
        """Neighbours are joined while a piece says so: best rank first, of equal ranks the leftmost."""
        n, ranks = len(word), self.ranks
        ends, before = list(range(1, n + 1)), list(range(-1, n))
        ways = [(ranks[p], s, s + 1, s + 2) for s in range(n - 1) if (p := word[s : s + 2]) in ranks]
        heapq.heapify(ways)
        while ways:
            _, s, m, e = heapq.heappop(ways)
            if ends[s] != m or m >= n or ends[m] != e:
                continue
            ends[s], ends[m] = e, 0
            if e < n:
                before[e] = s
                if (p := word[s : ends[e]]) in ranks:
                    heapq.heappush(ways, (ranks[p], s, e, ends[e]))
            b = before[s]
            if b >= 0 and (p := word[b:e]) in ranks:
                heapq.heappush(ways, (ranks[p], b, s, e))
        spans, at = [], 0
        while at < n:
            spans.append((at, ends[at]))
            at = ends[at]
        return spans

    def _best(self, word: str) -> list[tuple[int, int]]:
        """Viterbi; of equal totals the one whose last pieces are longer."""
        best, back = [0.0], [0]
        for end in range(1, len(word) + 1):
            top, way = None, 0
            for start in range(max(0, end - self.longest), end):
                got = self.scores.get(word[start:end])
                if got is None and end - start > 1:
                    continue
                total = best[start] + (got[1] if got else self.lowest)
                if top is None or total > top:
                    top, way = total, start
            best.append(top)
            back.append(way)
        spans, end = [], len(word)
        while end:
            spans.append((back[end], end))
            end = back[end]
        return spans[::-1]

    def raw(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all pieces end to end, marks as spaces, with each piece's start and length."""
        if self._raw is None:
            raw = [n.replace(MARK, " ").encode("utf-8", "surrogatepass") for n in self.names]
            if self.bytes is not None:
                raw[self.bytes : self.bytes + 256] = [bytes([b]) for b in range(256)]
            sizes = np.array([len(r) for r in raw], np.int64)
            self._raw = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes
        return self._raw

    def short(self) -> bool:
        """Whether an id fits into two bytes."""
        return len(self.names) <= 1 << 16

    def texts(self, lists: pa.ListArray) -> Iterator[str]:
        """The texts of lists of ids. The space that the first piece begins with is left out; bytes
        that are no UTF-8 become replacement characters."""
        for at in range(0, len(lists), 200):
            some = lists.slice(at, 200)
            cuts = np.concatenate(([0], np.cumsum(some.value_lengths().fill_null(0).to_numpy())))
            raw, begins = gathered(*self.raw(), some.flatten().to_numpy())
            text, ends = raw.tobytes(), begins[cuts].tolist()
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                yield text[s + (s < e and text[s] == 32) : e].decode("utf-8", "replace")


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), k.cast("int"))


def _merge_fold(edges: Column, n: Column) -> Column:
    """Spans that are left when the edges, by rank, have joined what they can: (start, id), in order.

    The state is one number: bit k is set while there is a boundary before character k. An edge
    joins if both its ends are boundaries and exactly one lies between them.
    """

    def step(m: Column, e: Column) -> Column:
        inner = m.bitwiseAND(e.inside)
        return F.when((F.bit_count(inner) == 1) & (m.bitwiseAND(e.ends) == e.ends), m - inner).otherwise(m)

    def spans(m: Column) -> Column:
        joined = F.filter(edges, lambda e: (e.inside > 0) & (m.bitwiseAND(e.ends.bitwiseOR(e.inside)) == e.ends))
        alone = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.call_function("shiftright", m, k).bitwiseAND(F.lit(3)) == 3)
        spot = lambda e: F.struct(F.shiftright(e.key, 24).bitwiseAND(F.lit(63)).cast("int").alias("start"), e.key.bitwiseAND(F.lit(_NO_PIECE)).cast("int").alias("id"))
        return F.array_sort(F.concat(F.transform(joined, spot), F.transform(alone, lambda k: F.struct(k.alias("start"), F.lit(_NO_PIECE).alias("id")))))

    return let(F.aggregate(edges, (_bit(n + 1) - 1).cast("bigint"), step), spans)


def _viterbi_fold(edges: Column, n: Column) -> Column:
    """The path of greatest total over edges sorted by end and start: (start, id), in order."""
    ints = lambda x: x.cast("array<int>")
    # positions before the one at hand in arrays, the one at hand (end, its best total and edge) in fields
    state = lambda best, starts, ids, end, top, start, id_: F.struct(best.alias("best"), starts.alias("starts"), ids.alias("ids"), end.alias("end"), top.alias("top"), start.alias("start"), id_.alias("id"))
    zero = state(F.array().cast("array<double>"), ints(F.array()), ints(F.array()), F.lit(0), F.lit(0.0), F.lit(0), F.lit(_NO_PIECE))

    def step(s: Column, e: Column) -> Column:
        total = F.when(e.start == s.end, s.top).otherwise(F.element_at(s.best, e.start + 1)) + e.score
        pushed = [F.concat(s.best, F.array(s.top)), F.concat(s.starts, F.array(s.start)), F.concat(s.ids, F.array(s.id))]
        better = state(s.best, s.starts, s.ids, s.end, total, e.start, e.id)
        return F.when(e.end != s.end, state(*pushed, e.end, total, e.start, e.id)).when(total > s.top, better).otherwise(s)

    folded = F.aggregate(edges, zero, step, lambda s: F.struct(F.concat(s.starts, F.array(s.start)).alias("starts"), F.concat(s.ids, F.array(s.id)).alias("ids")))

    def walk(back: Column) -> Column:
        first = F.struct(n.alias("at"), F.array().cast("array<struct<start:int,id:int>>").alias("out"))
        start = lambda s: F.element_at(back.starts, s.at + 1)
        go = lambda s: F.struct(start(s).alias("at"), F.concat(F.array(F.struct(start(s).alias("start"), F.element_at(back.ids, s.at + 1).alias("id"))), s.out).alias("out"))
        return F.aggregate(F.sequence(F.lit(1), n), first, lambda s, _: F.when(s.at > 0, go(s)).otherwise(s), lambda s: s.out)

    return let(folded, walk)


def lattice(segments: DataFrame, model: Model) -> DataFrame:
    """``segments`` (word, n; one row a word of at most ``LONG`` characters, dealt by word) with ``ids``."""
    pieces, n = model.table(segments.sparkSession), F.char_length("word")
    # a substring can be no longer than the longest piece that begins like it
    heads = F.broadcast(pieces.where(F.char_length("piece") >= _HEAD).groupBy(F.substr("piece", F.lit(1), F.lit(_HEAD)).alias("head")).agg(F.max(F.char_length("piece")).alias("most")))
    starts = segments.select("word", "n", F.explode(F.sequence(F.lit(0), n - 1)).alias("start")).withColumn("head", F.substr("word", F.col("start") + 1, F.lit(_HEAD))).join(heads, "head", "left")
    bound = F.least(F.coalesce("most", F.lit(_HEAD - 1)), n - F.col("start"))
    spans = starts.select("word", "n", "start", F.explode(F.sequence(F.lit(1), bound)).alias("len"))
    if model.merges:  # characters that stay alone are looked up at the end; one span keeps a segment without edges
        spans = spans.where("len > 1 OR start = 0")
    subs = spans.withColumn("piece", F.substr("word", F.col("start") + 1, F.col("len")))
    edges = subs.join(F.broadcast(pieces), "piece", "left").where(F.col("id").isNotNull() | (F.col("len") == 1))
    end, id_ = F.col("start") + F.col("len"), F.coalesce("id", F.lit(_NO_PIECE))
    if model.merges:  # key: rank, start and id
        place = lambda x, bits: F.shiftleft(x.cast("bigint"), bits)
        key = place(F.coalesce("rank", F.lit(0)), 30).bitwiseOR(place(F.col("start"), 24)).bitwiseOR(id_.cast("bigint"))
        edge = F.struct(key.alias("key"), _bit(F.col("start")).bitwiseOR(_bit(end)).alias("ends"), (_bit(end) - _bit(F.col("start") + 1)).alias("inside"))
    else:
        edge = F.struct(end.alias("end"), "start", id_.alias("id"), F.coalesce("score", F.lit(model.lowest)).alias("score"))
    grouped = edges.groupBy("word", "n").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    found = let(F.col("edges"), lambda edges: (_merge_fold if model.merges else _viterbi_fold)(edges, n))

    # the pieces of one character, the best first: a character's place among them gives its id
    letters = sorted((p for p in model.scores if len(p) == 1), key=lambda p: -model.scores[p][1])
    numbers = F.split(F.lit(",".join(str(model.scores[p][0]) for p in letters)), ",").cast("array<int>")

    def spelt(x: Column) -> Column:
        def raw(char: Column) -> Column:
            if model.bytes is None:
                return F.array(F.lit(model.unknown))
            code = F.hex(F.encode(char, "UTF-8"))
            return F.transform(F.sequence(F.lit(1), (F.char_length(code) / 2).cast("int")), lambda i: F.conv(F.substr(code, 2 * i - 1, F.lit(2)), 16, 10).cast("int") + model.bytes)

        char = F.substr("word", x.start + 1, F.lit(1))
        place = lambda at: F.when(at > 0, F.array(F.element_at(numbers, F.greatest(at, F.lit(1))))).otherwise(raw(char))
        return F.when(x.id == _NO_PIECE, let(F.call_function("locate", char, F.lit("".join(letters))), place)).otherwise(F.array(x.id))

    ids = lambda xs: F.when(F.exists(xs, lambda x: x.id == _NO_PIECE), F.flatten(F.transform(xs, spelt))).otherwise(F.transform(xs, lambda x: x.id))
    return grouped.select("word", "n", let(found, ids).alias("ids"))


def _spaced(text: str) -> str:
    """``text`` so that a cut at each space gives its words: further spaces of a run as marks, which mean the same."""
    return re.sub("^ +| ( +)", lambda m: MARK * len(m[0]) if m[1] is None else " " + MARK * len(m[1]), text.replace(MARK, " "))


def segmented(texts: pa.Array, model: Model) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct segments, the texts as numbers of these end to end, the number of segments of each text)."""
    texts = pc.if_else(pc.equal(texts, ""), None, texts)
    odd = pc.fill_null(pc.match_substring_regex(texts, f"^ |  |{MARK}"), False)
    if pc.any(odd).as_py():
        texts = pa.array([_spaced(t) if o else t for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)], pa.large_string())
    return segments(texts, *model.kinds(), MARK)


def _packed(text_at: int, shared) -> Callable:
    """A row a chunk: its distinct segments, its texts as their numbers, its other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, seen = TaskContext.get().partitionId(), 0
        for table in chunks(batches, text_at, CHUNK_BYTES):
            texts = table.column(text_at).combine_chunks()
            words, flat, sizes = segmented(texts, shared.value)
            # the frequent ones get numbers of one byte, the next of two: equal high bytes stand together and compress
            rank = np.empty(len(words), np.int64)
            rank[np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")] = np.arange(len(words))
            classes = pa.array((rank > 0xFF).astype(np.int8) + (rank > 0xFFFF))
            order = pc.sort_indices(pa.table({"class": classes, "word": words}), sort_keys=[("class", "ascending"), ("word", "ascending")])
            number = np.empty(len(order), np.uint32)
            number[order.to_numpy()] = np.arange(len(order))
            planes = number[flat].view(np.uint8).reshape(-1, 4).T.tobytes()
            digests = [hashlib.sha256((t.as_buffer() if t.is_valid else None) or b"").digest() for t in texts.cast(pa.binary())]
            rest = table.drop_columns([table.column_names[text_at]]).append_column("_segments", pa.array(sizes, pa.int64())).append_column("_sha256", pa.array(digests, pa.binary()))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(rest.combine_chunks())
            listed = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.take(order).cast(pa.string()))
            one = lambda value, kind: pa.array([value], kind)
            values = [one((place << 32) + seen, pa.int64()), listed, one(sink.getvalue().to_pybytes(), pa.binary()), one(len(planes), pa.int64()), one(pa.Codec("zstd", 6).compress(planes, asbytes=True), pa.binary())]
            seen += 1
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays(values, ["chunk", "words", "rest", "n_planes", "planes"])

    return run


def _encoded(shared, hot) -> Callable:
    """The ids of a chunk's rows from the broadcast segments and the answers to the chunk.

    Segments over ``LONG`` characters are folded here, by the same rule.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model, (words, lists), parts = shared.value, hot.value, []
        blobs, kind = right.column(2), np.dtype(">u2" if model.short() else ">u4")
        sent = np.frombuffer(b"".join(blobs.to_pylist()), kind).astype(np.int32)
        flat = np.concatenate((lists.flatten().to_numpy().astype(np.int32), sent))
        sizes = np.concatenate((lists.value_lengths().to_numpy().astype(np.int64), pc.binary_length(blobs).to_numpy().astype(np.int64) // kind.itemsize))
        answered = right.column(1).to_numpy()
        for row in left.to_batches():
            for at in range(row.num_rows):
                asked = row.column("words")[at].values
                spot = pc.index_in(asked, words).fill_null(-1).to_numpy().copy()
                spot[answered] = len(words) + np.arange(len(answered))
                rest = np.flatnonzero(spot < 0)
                long = [model.segment(w) for w in asked.take(rest).to_pylist()]
                spot[rest] = len(words) + len(answered) + np.arange(len(rest))
                n = np.concatenate((sizes, np.array([len(x) for x in long], np.int64)))
                every = np.concatenate((flat, np.array(list(chain.from_iterable(long)), np.int32)))
                table = pa.ipc.open_stream(row.column("rest")[at].as_py()).read_all()
                planes = pa.Codec("zstd").decompress(row.column("planes")[at].as_py(), row.column("n_planes")[at].as_py(), asbytes=True)
                numbers = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
                ids, begins = gathered(every, np.cumsum(n) - n, n, spot[numbers])
                offsets = begins[np.concatenate(([0], np.cumsum(table["_segments"].to_numpy())))]
                encoded = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                digests = zip(table["_sha256"].to_pylist(), model.texts(encoded), strict=True)
                same = pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() == d for d, t in digests], pa.bool_())
                parts.append(table.drop_columns(["_segments", "_sha256"]).append_column("_ids", encoded).append_column("_round_trip", same))
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(parts)

    return run


def encode(docs: DataFrame, scratch: Scratch, model: Model) -> DataFrame:
    """The columns of ``docs`` but text, with ``_ids``, the pieces of each row's whole text, and
    ``_round_trip``: whether they were decoded to that text again (by its digest).

    A null or empty text has no pieces. Characters without a piece become byte pieces (or the
    unknown piece, where the model has none). Rows with equal ids stay separate rows; an empty
    table gives none; other columns pass through. ``decoded`` gives the texts back.
    """
    spark, text_at = docs.sparkSession, docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[(F.col(c).cast("string") if c == "text" else F.col(c)).alias(n) for c, n in zip(docs.columns, names, strict=True)])
    shared = spark.sparkContext.broadcast(model)
    # written once: a chunk that is read again, after a lost executor too, holds the same rows;
    # in buckets by chunk, so that the answers come to the chunks and these stay where they are
    rows = plain.mapInArrow(_packed(text_at, shared), "chunk bigint, words array<string>, rest binary, n_planes bigint, planes binary")
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), BUCKETS)
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"):
        packed = scratch.save_by(rows, "chunk", buckets, "packed")
    wanted = packed.select("chunk", F.posexplode("words").alias("pos", "word")).where(F.char_length("word") <= LONG)
    counted = scratch.save(wanted.groupBy("word").agg(F.count("*").alias("n")), "counts")
    scratch.let_go()
    total = counted.count()
    tasks = max(-(-total // LATTICE_SEGMENTS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 2000)), 1)
    # a task's segments are bounded, so their edges are grouped in memory, without a sort
    with setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(4 * LATTICE_SEGMENTS)):
        known = scratch.save(lattice(counted.repartition(tasks, "word"), model), "known")
    scratch.drop(counted)
    scratch.let_go()
    # the least count that lets at most HOT_SEGMENTS through, by classes of an eighth of a doubling
    level = F.floor(F.log2("n") * 8).cast("int")
    least, held = 1 << 30, 0
    for r in sorted(known.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        held += r["count"]
        if held > HOT_SEGMENTS:
            break
        least = r["level"]
    often = known.where(level >= least)
    got = often.select("word", "ids").toArrow()
    whole = lambda name, kind: pa.concat_arrays([pa.array([], kind), *(c.cast(kind) for c in got[name].chunks)])
    hot = spark.sparkContext.broadcast((whole("word", pa.string()), whole("ids", pa.list_(pa.int32()))))
    seldom = wanted.join(F.broadcast(often.select("word")), "word", "left_anti")
    # ids travel as bytes, two each where they fit
    blob = F.unhex(F.array_join(F.transform("ids", lambda x: F.lpad(F.hex(x), 4 if model.short() else 8, "0")), ""))
    answers = seldom.join(known.where(level < least).select("word", blob.alias("ids")), "word").select(F.col("chunk").alias("to"), "pos", "ids")
    schema = T.StructType([*[f for i, f in enumerate(plain.schema.fields) if i != text_at], T.StructField("_ids", T.ArrayType(T.IntegerType())), T.StructField("_round_trip", T.BooleanType())])
    out = packed.groupBy("chunk").cogroup(answers.groupBy("to")).applyInArrow(_encoded(shared, hot), schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True) if c != "text"], "_ids", "_round_trip")


def decoded(encoded: DataFrame, model: Model) -> DataFrame:
    """``encoded`` with ``_decoded``, the text of ``_ids`` (null ids: empty)."""
    shared, at = encoded.sparkSession.sparkContext.broadcast(model), encoded.columns.index("_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array(shared.value.texts(batch.column(at)), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "_decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("_decoded", T.StringType())]))
