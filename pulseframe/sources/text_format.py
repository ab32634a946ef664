"""Lines of a text file, for use on one byte range inside a task.

A line belongs to the range in which it starts, wherever it ends. Whether an offset starts a line can be told from
the bytes around it alone, so ranges are read independently of each other. Lines end with a line feed, a carriage
return, or both. Which ranges exist, and which number their first line has, is decided by Spark jobs in ``lines``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

READ_CHUNK = 4 << 20
LOOK_AHEAD = 64 << 10
LF, CR = 10, 13


class LineBlock:
    """Lines that follow each other in a file: ``data`` and the range of each line in it, without its ending."""

    def __init__(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, offset: int):
        self.data, self.begins, self.ends, self.offset = data, begins, ends, offset

    def __len__(self) -> int:
        return len(self.begins)

    def texts(self, keep: np.ndarray | None = None) -> pa.Array:
        """The lines as an Arrow string array (bytes as they stand); of ``keep`` only, when given."""
        begins, ends = (self.begins, self.ends) if keep is None else (self.begins[keep], self.ends[keep])
        sizes = ends - begins
        offsets = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=offsets[1:])
        marks = np.zeros(len(self.data) + 1, np.int8)
        some = sizes > 0
        marks[begins[some]] += 1  # lines are apart by their endings, so no place counts twice
        marks[ends[some]] -= 1
        inside = np.cumsum(marks[:-1], dtype=np.int8).astype(bool)
        return pa.Array.from_buffers(
            pa.string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[inside].tobytes())])


def _starts(data: np.ndarray, first: int, last: int) -> np.ndarray:
    """Indices in ``[first, last)`` at which a line starts; ``data`` holds the byte before ``first`` and each one's own."""
    before, own = data[first - 1:last - 1], data[first:last]
    return np.flatnonzero((before == LF) | ((before == CR) & (own != LF))) + first


def line_blocks(handle, size: int, start: int, stop: int, chunk: int = READ_CHUNK) -> Iterator[LineBlock]:
    """The lines that start in ``[start, stop)``, block by block; memory is a chunk and the longest line."""
    at = start
    while at < min(stop, size):
        end = min(at + chunk, stop, size)
        base = max(at - 1, 0)
        data = np.frombuffer(handle.read_at(end - base, base), np.uint8)
        starts = _starts(data, at - base, end - base) if at else np.concatenate([[0], _starts(data, 1, end)])
        if len(starts):
            following, more = None, LOOK_AHEAD
            while following is None:
                held = len(data)
                if base + held >= size:
                    following = held
                    break
                extra = np.frombuffer(handle.read_at(min(more, size - base - held), base + held), np.uint8)
                data = np.concatenate([data, extra])
                found = _starts(data, held, len(data))
                if len(found):
                    following = int(found[0])
                more *= 2
            nexts = np.append(starts[1:], following)
            ends = nexts.copy()
            feed = data[nexts - 1] == LF
            ends -= feed | (data[nexts - 1] == CR)
            carriage = feed & (ends > starts) & (data[np.maximum(ends - 1, 0)] == CR)
            yield LineBlock(data[:following], starts, ends - carriage, base)
        at = end


def count_lines(handle, size: int, start: int, stop: int) -> int:
    """How many lines start in ``[start, stop)``."""
    total, at = 0, start
    while at < min(stop, size):
        end = min(at + READ_CHUNK, stop, size)
        base = max(at - 1, 0)
        data = np.frombuffer(handle.read_at(end - base, base), np.uint8)
        total += len(_starts(data, at - base, end - base)) if at else 1 + len(_starts(data, 1, end))
        at = end
    return total


def first_lines(handle, size: int, count: int) -> list[bytes]:
    out: list[bytes] = []
    for block in line_blocks(handle, size, 0, size, chunk=LOOK_AHEAD):
        for begin, end in zip(block.begins[:count - len(out)], block.ends):
            out.append(block.data[begin:end].tobytes())
        if len(out) >= count:
            break
    return out


def completed_lines(handle, start: int, stop: int, chunk: int = READ_CHUNK) -> Iterator[tuple[int, bytes]]:
    """``(offset, text)`` of the lines whose line feed lies in ``[start, stop)``; a line may begin before ``start``."""
    begin = _after_last_feed(handle, start)
    held = [handle.read_at(start - begin, begin)] if begin < start else []
    at = start
    while at < stop:
        data = handle.read_at(min(chunk, stop - at), at)
        pieces = data.split(b"\n")
        for piece in pieces[:-1]:
            line = b"".join([*held, piece])
            yield begin, line.removesuffix(b"\r")
            begin += len(line) + 1
            held = []
        if pieces[-1]:
            held.append(pieces[-1])
        at += len(data)
        if not data:
            break


def _after_last_feed(handle, stop: int) -> int:
    """Offset behind the last line feed before ``stop``; 0 when there is none."""
    width = 4 << 10
    while stop > 0:
        low = max(0, stop - width)
        found = handle.read_at(stop - low, low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        stop, width = low, min(2 * width, READ_CHUNK)
    return 0
