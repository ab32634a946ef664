"""Whole texts as numpy arrays inside a task: words as byte ranges, and hashes of words and of word windows.

A task's Arrow batches are cut into blocks of at most ``BLOCK_BYTES`` of text (one text at least), so the arrays
of a task stay small whatever a partition holds; no text is shortened. All word classes here are sets of ASCII
bytes, and UTF-8 never uses those bytes inside another character, so scanning bytes gives the same words as
scanning code points.

Hashes are polynomials over random 64-bit byte values modulo 2**64, finished with a mixing step. Two spans get
the same hash with probability about 2**-64; where a whole corpus is compared, two of them make 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1_000_000

_M64 = (1 << 64) - 1
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_random = np.random.default_rng(20240607)
_BYTE_VALUES = _random.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

BLANK = frozenset([0x20, *range(0x09, 0x0E)])
#: Words of the contracts: anything but ASCII white space, or ASCII letters and digits and all that is not ASCII.
NON_BLANK = np.array([b not in BLANK for b in range(256)])
ALNUM = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


class Block:
    """Some texts of a batch: ``rows`` (the batch's rows), their bytes and where each text starts."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> Block:
        """A-Z lower-cased, nothing else."""
        return Block(self.rows, _LOWER[self.data], self.offsets)


def text_block(rows: pa.RecordBatch, column: str = "text") -> Block:
    texts = rows.column(rows.schema.get_field_index(column))
    texts = texts.cast(pa.large_string()).fill_null("")
    size = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=size + 1, offset=texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return Block(rows, data[offsets[0]:offsets[-1]], offsets - offsets[0])


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The batches' rows in order, in blocks of at most ``limit`` bytes of text (or one text)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = text_block(batch, column)
        first = 0
        while first < len(whole):
            last = int(np.searchsorted(whole.offsets, whole.offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), len(whole))
            yield Block(batch.slice(first, last - first), whole.data[whole.offsets[first]:whole.offsets[last]],
                        whole.offsets[first:last + 1] - whole.offsets[first])
            first = last


def powers(count: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of a base and of its inverse modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < count:
        size = max(count, 1 << 16)
        pair = []
        for base in (BASES[which], pow(BASES[which], -1, 1 << 64)):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            pair.append(np.cumprod(factors, dtype=np.uint64))
        have = (pair[0], pair[1])
        if size <= 1 << 22:  # longer tables, for very long texts, are not kept
            _powers[which] = have
    return have


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits of the result."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    power, inverse = powers(len(values) + 1, which)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[:len(values)], out=sums[1:])
    length = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + length * np.uint64(0xC2B2AE3D27D4EB4F))


def hash_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """One 64-bit hash for each byte range."""
    return _ranges(_BYTE_VALUES[data], starts, ends, which)


def hash_runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """One 64-bit hash for each range of a sequence of 64-bit values."""
    return _ranges(values, starts, ends, which)


class Words:
    """Words of a block: byte ranges ``starts``/``ends``; text ``i`` has the words ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, block: Block, kind: np.ndarray = NON_BLANK):
        self.block = block
        inside = kind[block.data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = block.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(inside))]
        begin[edges] = inside[edges]
        end[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, block.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.block)), self.counts())

    def hashes(self, which: int = 0) -> np.ndarray:
        return hash_bytes(self.block.data, self.starts, self.ends, which)

    def joined(self, doc: int, keep: np.ndarray | None = None) -> bytes:
        """The words of one text (those kept) joined by one space."""
        low, high = self.first[doc], self.first[doc + 1]
        picked = range(low, high) if keep is None else (np.flatnonzero(keep[low:high]) + low)
        raw = self.block.data
        return b" ".join([raw[self.starts[i]:self.ends[i]].tobytes() for i in picked])


def window_starts(words: Words, size: int) -> np.ndarray:
    """Indices of the words at which a window of ``size`` words of one text starts."""
    ok = np.ones(len(words), dtype=bool)
    last = words.first[1:]
    for back in range(1, size):  # the last size - 1 words of each text start no window
        at = last - back
        ok[at[at >= words.first[:-1]]] = False
    return np.flatnonzero(ok)


def covered(starts: np.ndarray, length: int | np.ndarray, total: int) -> np.ndarray:
    """Which of ``total`` positions lie in a range that begins at one of ``starts``."""
    marks = np.zeros(total + 1, dtype=np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + length, -1)
    return np.cumsum(marks[:-1]) > 0


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over the positions of each text."""
    if values.dtype == bool:
        return np.diff(np.searchsorted(np.flatnonzero(values), first))
    sums = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.kind in "ui" else np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
