"""Token ids as ORC files: ascending doc_id, run-length coded integers, row indexes, Bloom filters on doc_id.

A file holds doc_id, part (its place in the order of files), start (ids of the rows before it in
its file) and ids. Any stripe can be read alone, and a look-up by doc_id skips files, stripes and
row groups by their statistics and filters.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchloom.llm.segments import chunks, gathered, segments

END_ID = 2
OPTIONS = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(32 << 20)}
#: Bytes of texts that are encoded at once, and pieces that a worker remembers over all its tasks; both bound memory only.
CHUNK_BYTES, MEMO = 4_000_000, 300_000
# Letters that neither lower-casing nor normalisation changes, digits, and marks that
# never join with what stands beside them (the apostrophe does).
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_DIGITS = "0123456789"
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_MADE: dict[str, Encoder] = {}


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    kinds, joined = np.zeros(0x110000, np.uint8), np.ones((4, 4), bool)
    for kind, chars in enumerate((_LETTERS, _DIGITS, _MARKS), 1):
        kinds[[ord(c) for c in chars]] = kind
    joined[1:, 1:] = [[True, False, False], [False, False, False], [False, False, True]]
    return kinds, joined


class Encoder:
    """Ids of whole texts by a tokenizer that lowers letters, drops white space and makes one word
    of letters in a row, of each digit, and of marks in a row.

    A text is cut at spaces and line feeds and between letters, digits and marks of the fixed lists
    above, and each distinct piece is encoded once: its ids do not depend on what stands beyond the
    cut (tests hold this against whole texts). Other characters are never cut from their neighbours.
    A text with an opening "<|", which may be a special token, is encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.kinds = Tokenizer.from_file(path), _kinds()
        #: What was learned: pieces, their ids end to end, and the number of ids of each.
        self.known = pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(0, np.int64)
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True

    @staticmethod
    def of(path: str) -> Encoder:
        """The worker's own encoder: what one task has learned serves the next."""
        return _MADE.get(path) or _MADE.setdefault(path, Encoder(path))

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [got.ids for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(ids)), np.int32), np.array([len(x) for x in ids], np.int64)

    def _learn(self, pieces: pa.LargeStringArray) -> None:
        """Learn the ids of pieces. Those of letters alone are one word each, so many are encoded in
        one text and parted behind the ids that end a word."""
        plain = pc.match_substring_regex(pieces, f"^[{_LETTERS}]+$")
        words, rest = pieces.filter(plain), pieces.filter(pc.invert(plain))
        flats, sizes = [self.known[1]], [self.known[2]]
        for at in range(0, len(words), 5000):
            ids, _ = self._whole([" ".join(words.slice(at, 5000).to_pylist())])
            ends = np.flatnonzero(self.ends[ids])
            flats.append(ids)
            sizes.append(np.diff(ends, prepend=-1))
        for at in range(0, len(rest), 5000):
            ids, n = self._whole(rest.slice(at, 5000).to_pylist())
            flats.append(ids)
            sizes.append(n)
        self.known = pa.concat_arrays([self.known[0], words, rest]), np.concatenate(flats), np.concatenate(sizes)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; offsets of the texts)."""
        odd = pc.fill_null(pc.match_substring(texts, "<|"), False)
        # A-Z is lowered first, which makes fewer pieces
        plain = pc.replace_substring(pc.ascii_lower(pc.if_else(odd, None, texts).cast(pa.large_string())), "\n", " ")
        pieces, numbers, sizes = segments(plain, *self.kinds)
        self._learn(pieces.filter(pc.is_null(pc.index_in(pieces, self.known[0]))))
        words, flat, lengths = self.known
        spot = pc.index_in(pieces, words).to_numpy().astype(np.int64)
        # the texts that are encoded whole are one number each, and so is the end id
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        ids, n = self._whole([texts[i].as_py() for i in whole.tolist()])
        numbers = np.insert(spot[numbers], np.cumsum(sizes)[whole], len(words) + np.arange(len(whole)))
        sizes[whole] += 1
        numbers = np.insert(numbers, np.cumsum(sizes), len(words) + len(whole))
        flat, lengths = np.concatenate((flat, ids, np.array([END_ID], np.int32))), np.concatenate((lengths, n, [1]))
        out, begins = gathered(flat, np.cumsum(lengths) - lengths, lengths, numbers)
        if len(words) > MEMO or words.nbytes > 64 * MEMO:
            self.known = pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(0, np.int64)
        return out, begins[np.concatenate(([0], np.cumsum(sizes + 1)))]


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = Encoder.of(path), 0, TaskContext.get().partitionId()
        for table in chunks(batches, 1, CHUNK_BYTES):
            ids, offsets = encode(table.column(1).combine_chunks())
            lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(ids)).cast(pa.list_(pa.int32()))
            starts = pa.array(seen + offsets[:-1])
            seen += int(offsets[-1])
            yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks(), pa.array(np.full(table.num_rows, part, np.int32)), starts, lists], ["doc_id", "part", "start", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode every row's whole text and write the files to ``path`` in ascending doc_id.

    Null texts are empty (the end id alone). Null ids come first and equal ids stand in the order
    of their texts. An empty table writes an empty folder of files. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))
    ordered.mapInArrow(_encoded(tokenizer), "doc_id bigint, part int, start bigint, ids array<int>").write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, start, ids) with ``start`` counted over all files."""
    rows = spark.read.schema("doc_id bigint, part int, start bigint, ids array<int>").orc(path)
    sizes = rows.groupBy("part").agg(F.max(F.col("start") + F.size("ids")).alias("n"))
    # one row a file
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", "part", (F.col("start") + F.col("before")).alias("start"), "ids")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        first = int(lists.offsets[0].as_py()) if len(lists) else 0
        ids, at = lists.values.to_numpy().astype("<u4"), np.concatenate(([0], np.cumsum(sizes))) + first
        crcs = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes.astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def summary(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what ``read_tokens`` gives."""
    return tokens.select("doc_id", "start", "ids").mapInArrow(_checked, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
