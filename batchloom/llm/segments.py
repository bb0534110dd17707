"""Whole columns of texts as numbers of their distinct segments, by array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def chunks(batches: Iterator[pa.RecordBatch], text_at: int, most: int) -> Iterator[pa.Table]:
    """Runs of rows whose texts have about ``most`` bytes (a longer text is a run alone)."""
    held, size = [], 0
    for whole in batches:
        at = 0
        for i, n in enumerate(pc.binary_length(whole.column(text_at)).fill_null(0).to_pylist()):
            if size and size + n > most:
                held.append(whole.slice(at, i - at))
                yield pa.Table.from_batches(held)
                held, size, at = [], 0, i
            size += n
        held.append(whole.slice(at))
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``wanted`` of ``flat`` end to end, and where each begins (and the last ends)."""
    n = sizes[wanted]
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[wanted] - (ends - n), n)
    return flat[at], np.concatenate((np.zeros(1, np.int64), ends))


def spelt(words: pa.LargeStringArray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words end to end as UTF-8 and as code points, and the characters of each (no nulls)."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    raw = bytes(memoryview(data)[ends[0] : ends[-1]]) if data is not None else b""
    return raw, np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32), pc.utf8_length(words).to_numpy()


def parted(raw: bytes, codes: np.ndarray, at: np.ndarray) -> pa.LargeStringArray:
    """What lies between the characters ``at`` (the first and the end among them) of ``raw``, numbered by distinct strings."""
    width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(width, dtype=np.int64)))[at]
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()


def segments(texts: pa.Array, kinds: np.ndarray, joined: np.ndarray, mark: str = "") -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """(distinct segments, the texts as numbers of these end to end, the number of segments of each text).

    Texts are cut at spaces and ``mark`` is put before each word; words are cut wherever ``joined``
    denies that the kinds of two characters stand together. A null text has no segments.
    ``kinds`` has a small number for each code point.
    """
    split = pc.split_pattern(texts.cast(pa.large_string()), " ")
    sizes = split.value_lengths().fill_null(0).to_numpy()
    words = split.flatten().dictionary_encode()
    distinct = pc.binary_join_element_wise(pa.scalar(mark, pa.large_string()), words.dictionary, pa.scalar("", pa.large_string())) if mark else words.dictionary
    raw, codes, lengths = spelt(distinct)
    if not len(codes):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    begins = np.cumsum(lengths) - lengths
    cuts = np.ones(len(codes) + 1, bool)
    here = kinds[codes]
    cuts[1:-1] = ~joined[here[:-1], here[1:]]
    cuts[begins] = True
    at = np.flatnonzero(cuts)
    parts = parted(raw, codes, at)
    first = np.searchsorted(at, np.append(begins, len(codes)))
    numbers, ends = gathered(parts.indices.to_numpy().astype(np.int64), first[:-1], np.diff(first), words.indices.to_numpy().astype(np.int64))
    return parts.dictionary, numbers, np.diff(ends[np.concatenate(([0], np.cumsum(sizes)))])
