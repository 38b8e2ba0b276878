"""Whole texts of an Arrow batch as bytes, words and hashes, without a loop over rows.

Texts are taken in pieces of some megabytes, cut between rows only, so that
memory follows the piece (or the longest text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20
#: Texts worked on at once.
PIECE_ROWS = 1024

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: All bytes but space and tab to carriage return.
NOT_SPACE = np.ones(256, dtype=np.uint8)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = 0

MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ODD = np.uint64(0x9E3779B97F4A7C15)
#: TAIL[n]: the low n bytes.
TAIL = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


class Texts:
    """Bytes of some rows' texts (null: none), one after another, and where each begins."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.data, self.starts, self.n = data, starts, len(starts) - 1

    def lowered(self) -> Texts:
        return Texts(LOWER[self.data], self.starts)

    def row(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i + 1]].tobytes()


def texts_of(array: pa.Array) -> Texts:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    _, offsets, data = array.buffers()
    if not len(array):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    starts = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(held[starts[0] : starts[-1]], starts - starts[0])


def pieces(array: pa.Array, most_bytes: int = PIECE_BYTES, most_rows: int = PIECE_ROWS) -> Iterator[tuple[int, int, Texts]]:
    """(first row, row after the last, their texts), in order."""
    whole = texts_of(array)
    first = 0
    while first < whole.n:
        after = int(np.searchsorted(whole.starts, whole.starts[first] + most_bytes, side="right")) - 1
        after = max(first + 1, min(after, first + most_rows, whole.n))
        base = whole.starts[first : after + 1]
        yield first, after, Texts(whole.data[base[0] : base[-1]], base - base[0])
        first = after


class Words:
    """Runs of the bytes in a table, none over the end of a text: starts, ends, and each text's first word."""

    def __init__(self, texts: Texts, inside: np.ndarray = NOT_SPACE):
        data, bounds = texts.data, texts.starts
        held = inside[data]
        step = np.empty(len(held) + 1, np.int8)
        step[:-1] = held
        step[-1] = 0
        before = np.empty(len(held), np.int8)
        before[1:] = held[:-1]
        opens = held.astype(bool)
        cut = bounds[:-1][bounds[:-1] < len(held)]
        if len(held):
            before[0] = 0
            before[cut] = 0
        self.starts = np.flatnonzero(opens & (before == 0))
        after = step[1:]
        last = bounds[1:][(bounds[1:] > 0)] - 1
        if len(held):
            after = after.copy()
            after[last] = 0
        self.ends = np.flatnonzero(opens & (after == 0)) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.texts = texts

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(self.texts.n), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hashes; eight bytes a step."""
        lengths = self.ends - self.starts
        padded = np.concatenate([self.texts.data, np.zeros(8, np.uint8)])
        eights = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        out = lengths.astype(np.uint64) * ODD
        with np.errstate(over="ignore"):
            if not len(out):
                return out
            out = scramble((out ^ (eights[self.starts] & TAIL[np.minimum(lengths, 8)])) * MIX_2)
            done, left = 8, np.flatnonzero(lengths > 8)
            while len(left):
                chunk = eights[self.starts[left] + done] & TAIL[np.minimum(lengths[left] - done, 8)]
                out[left] = scramble((out[left] ^ chunk) * MIX_2 + ODD)
                done += 8
                left = left[lengths[left] > done]
        return out


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_1
        x = (x ^ (x >> np.uint64(27))) * MIX_2
        return x ^ (x >> np.uint64(31))


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbouring values, over row ends too; len - n + 1 of them."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(hashes) - n + 1, np.uint64)
        for j in range(n):
            out *= ODD
            out += hashes[j : len(hashes) - n + 1 + j]
    return scramble(out)


def split_batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Each batch cut to pieces, with the texts of ``column``."""
    for batch in batches:
        for first, after, texts in pieces(batch.column(column)):
            yield batch.slice(first, after - first), texts
