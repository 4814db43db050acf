"""Words, lines and 64-bit hashes of whole Arrow batches of texts, by numpy and without a loop over words.

A word is a longest run of bytes outside 0x20 and 0x09 to 0x0D of the UTF-8 text, that is, a match
of ``[^\\x20\\x09-\\x0D]+``. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from srcatlas.functions.shipping import ship

U = np.uint64
#: A block of texts that is worked on at once has about so many bytes, or one text if that is longer.
BLOCK_BYTES = 1 << 20

_GAPS = np.zeros(256, bool)
_GAPS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd numbers."""
    return mixed(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first powers of ``base`` modulo 2 to the 64, at least ``n`` of them."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 12) * 2, U(base))
        known[0] = 1
        known = np.multiply.accumulate(known)
        _POWERS[base] = known
    return known


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U, copy=False).view(np.int64)


class Texts:
    """A block of texts: their bytes, and where each begins; ``rows`` are their places in the batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: slice):
        self.data, self.offsets, self.rows, self.n = data, offsets, rows, len(offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, lower: bool = False, seed: int = 0, gaps: np.ndarray | None = None) -> Words:
        return Words(self, LOWER[self.data] if lower else self.data, seed, _GAPS if gaps is None else gaps)


class Words:
    """The words of a block: ``start`` and ``end`` in its bytes, ``hash``, and ``first``: where each
    text's words begin, and the end of the last one's."""

    def __init__(self, block: Texts, data: np.ndarray, seed: int, gaps: np.ndarray):
        size, n = len(data), block.n
        inside = ~gaps[data]
        edge = np.zeros(size + 1, bool)
        edge[block.offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, block.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)
        if len(self.start):
            code = stream(256, 0xA5 + 977 * seed)
            code[gaps] = 0
            lead = np.zeros(self.start[0], np.int64)
            place = np.arange(self.start[0], size) - np.repeat(self.start, np.diff(np.append(self.start, size)))
            place = np.concatenate([lead, place])
            longest = int((self.end - self.start).max())
            place[~inside] = 0
            self.hash = mixed(
                np.add.reduceat(code[data] * powers(0x9DDFEA08EB382D69, longest)[place], self.start)
                + (self.end - self.start).astype(U)
            )
        else:
            self.hash = np.zeros(0, U)

    def windows(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows of ``k`` words of one text begin, and their hashes."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.arange(n - k + 1)
        at = at[self.first[self.doc[at] + 1] >= at + k]
        if k <= 8:
            made = np.zeros(n - k + 1, U)
            for i, factor in enumerate(stream(k, 0x51 + 7919 * seed)):
                made += self.hash[i : n - k + 1 + i] * factor
            return at, mixed(made[at] + U(k))
        base = int(stream(1, 0x77 + 104729 * seed)[0]) | 5
        up = powers(base, n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(self.hash * up[:n], out=total[1:])
        back = powers(pow(base, -1, 1 << 64), n + 1)
        return at, mixed((total[at + k] - total[at]) * back[at] + U(k))


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Texts]:
    """The texts of a batch's column, block by block; together they are all rows."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, places, raw = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), len(column))
        own = offsets[at : to + 1]
        yield Texts(data[own[0] : own[-1]], own - own[0], slice(at, to))
        at = to


def per_text(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by text."""
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64)


def listed(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from the values of all lists, one after another."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def distinct(doc: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, ascending, one text after another, and how many each has."""
    ends = np.searchsorted(doc, np.arange(n + 1))
    kept = [np.unique(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return np.concatenate(kept) if kept else np.zeros(0, values.dtype), np.array([len(x) for x in kept], np.int64)


def mapped(df: DataFrame, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``made`` of the batches of each partition, where the executors know this library; columns may have any names."""
    ship(df.sparkSession)
    names = df.columns
    if not any("." in n or "`" in n for n in names):
        return df.mapInArrow(made, schema)

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return made(batch.rename_columns(names) for batch in batches)

    return df.toDF(*(f"_{i}" for i in range(len(names)))).mapInArrow(renamed, schema)
