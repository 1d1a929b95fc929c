"""Numpy views of Arrow text columns, shared by the operators of this folder.

A text column is read in slices of bounded size, so that the arrays made from one slice stay small whatever the
number of rows in a batch. One text that is larger than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
SLICE_BYTES = 2 << 20

#: Fixed value: the separators of words, as bytes.
SPACES = b"\t\n\x0b\x0c\r "

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + mix(b + _ODD))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text or binary column and the offset of each row; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with at most ``limit`` bytes of text (or one row), their bytes and offsets."""
    for batch in batches:
        data, offsets = utf8(batch.column(text))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def char_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each row."""
    return run_sums((data & 0xC0) != 0x80, offsets)


def run_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each [offsets[i], offsets[i + 1])."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows and the offset of each row among them."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum(char_counts(data, offsets))])


class Rolling:
    """Hashes of any substring in constant time: sums of symbol times power, modulo 2**64, then mixed.

    ``table`` maps a symbol to a random 64-bit number; symbols outside it are mapped by ``mix``.
    """

    def __init__(self, table: np.ndarray | None = None):
        self.table = table
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            base = 0x9E3779B97F4A7C15 | 1
            size = 1 << (n - 1).bit_length()
            self.powers = _powers(base, size)
            self.inverse = _powers(pow(base, -1, 1 << 64), size)

    def sums(self, symbols: np.ndarray) -> np.ndarray:
        """Prefix sums; entry i covers the first i symbols."""
        self._grow(len(symbols) + 1)
        values = self.table[symbols] if self.table is not None else mix(symbols.astype(np.uint64) + _ODD)
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(values * self.powers[: len(symbols)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the symbols [start, end); the length is part of it."""
        return mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def windows(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Unmixed hash of every window of ``length`` symbols."""
        return (sums[length:] - sums[: len(sums) - length]) * self.inverse[: len(sums) - length]


def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    done, step = 1, base
    while done < size:
        out[done : 2 * done] = out[:done] * np.uint64(step)
        done, step = 2 * done, step * step % (1 << 64)
    return out


def byte_table(seed: int, lower: bool = False) -> np.ndarray:
    """A random 64-bit number for each byte; with ``lower``, A-Z get those of a-z."""
    table = np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        table[65:91] = table[97:123]
    return table


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true values that don't cross a row: starts, ends, and the first run of each row."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 rows: starts, ends, and the first word of each row."""
    return runs(~_SPACE[data], offsets)


def shingles(word_hash: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of each row, and the offset of each row among them.

    A row with fewer words, but at least one, has its whole sequence as its one shingle.
    """
    n_words = np.diff(first)
    count = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    offsets = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(count)), count)
    at = first[:-1][row] + (np.arange(offsets[-1]) - offsets[:-1][row])
    length = np.minimum(n_words[row], size)
    out = np.full(len(at), size, np.uint64)
    for k in range(size):
        there = length > k
        if there.all():
            out = pair(out, word_hash[at + k])
        else:
            out[there] = pair(out[there], word_hash[at[there] + k])
    return out, offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, ascending, and the offset of each row among them."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[new], row[new]
    return values, np.searchsorted(row, np.arange(len(offsets)))
