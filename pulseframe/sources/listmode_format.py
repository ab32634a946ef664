"""Byte layout of a list-mode binary file, for use on one byte range inside a task.

A file is a 2-byte header and then records. The low four header bits say which fields a record has.
Every function here works on one bounded range; which ranges exist, and in what order they count, is
decided by Spark jobs in ``listmode_bin``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Fixed values of the format.
HEADER_MASK = 0xFFF0
HEADER_VALUE = 0xCAE0
HEADER_SIZE = 2
ENERGY, CALIB_ENERGY, ENERGY_SHORT, WAVEFORM = 1, 2, 4, 8

# Reasons reported in ``file_status``.
OK = "OK"
BAD_HEADER = "Header is not a list-mode header"
NO_FIRST_RECORD = "Insufficient bytes found for first record"
CUT_RECORD = "Insufficient bytes found for last record"
NO_SAMPLES = "File ended early"

READ_CHUNK = 8 << 20
SYNC_RECORDS = 12
SYNC_WINDOW = 768 << 10
SYNC_CANDIDATES = 256

# Names of the raw-data folders of an experiment.
RAW_DATA_FOLDERS = ("FILTERED", "OFFLINE", "RAW", "SCREENSHOTS", "UNFILTERED")

ARROW_SCHEMA = pa.schema([
    ("experiment_id", pa.string()), ("source_file", pa.string()), ("record_idx", pa.int64()), ("BOARD", pa.int16()),
    ("CHANNEL", pa.int16()), ("TIMESTAMP", pa.decimal128(20, 0)), ("ENERGY", pa.int16()),
    ("CALIB_ENERGY", pa.float64()), ("ENERGYSHORT", pa.int16()), ("FLAGS", pa.int64()),
    ("WAVEFORM_CODE", pa.int16()), ("samples", pa.list_(pa.int16())),
    ("extra", pa.map_(pa.string(), pa.string())),
])


def experiment_of(path: str) -> str | None:
    """Folder of a data file, looking through a raw-data folder."""
    parts = path.split("/")[:-1]
    if len(parts) > 1 and parts[-1] in RAW_DATA_FOLDERS:
        parts = parts[:-1]
    return parts[-1] if parts else None


def header_is_valid(header: int) -> bool:
    return header & HEADER_MASK == HEADER_VALUE


def record_dtype(header: int, n_samples: int | None = None) -> np.dtype:
    """Packed little-endian layout; without ``n_samples`` only the part before the samples."""
    fields = [("BOARD", "<u2"), ("CHANNEL", "<u2"), ("TIMESTAMP", "<u8")]
    if header & ENERGY:
        fields.append(("ENERGY", "<i2"))
    if header & CALIB_ENERGY:
        fields.append(("CALIB_ENERGY", "<f8"))
    if header & ENERGY_SHORT:
        fields.append(("ENERGYSHORT", "<i2"))
    fields.append(("FLAGS", "<u4"))
    if header & WAVEFORM:
        fields += [("WAVEFORM_CODE", "u1"), ("n", "<u4")]
        if n_samples:
            fields.append(("samples", "<i2", (n_samples,)))
    return np.dtype(fields)


def read_header(handle, size: int) -> dict:
    """Header word, and the sample count of the first record when the file has waveforms."""
    head = handle.read_at(min(size, HEADER_SIZE + 64), 0) if size else b""
    header = int.from_bytes(head[:HEADER_SIZE], "little") if len(head) >= HEADER_SIZE else 0
    valid = len(head) >= HEADER_SIZE and header_is_valid(header)
    fixed = record_dtype(header).itemsize if valid else None
    first_n = None
    if valid and header & WAVEFORM and len(head) >= HEADER_SIZE + fixed:
        first_n = int.from_bytes(head[HEADER_SIZE + fixed - 4:HEADER_SIZE + fixed], "little")
    return {"header": header, "valid": valid, "fixed": fixed, "n": first_n}


class ReadAhead:
    """Serves small reads from the last large one, so that walking and decoding share their I/O."""

    def __init__(self, handle):
        self._handle, self._start, self._held = handle, 0, memoryview(b"")

    def read_at(self, size: int, offset: int):
        inside = offset - self._start
        if inside >= 0 and inside + size <= len(self._held):
            return self._held[inside:inside + size]
        data = memoryview(self._handle.read_at(size, offset))
        if size >= len(self._held) or size >= READ_CHUNK:
            self._start, self._held = offset, data
        return data


def _counts(buffer, first: int, stride: int, how_many: int) -> np.ndarray:
    return np.ndarray((how_many,), "<u4", buffer, first, (stride,))


def _count_at(handle, position: int, fixed: int) -> int:
    """Sample count of the record at ``position``; four bytes are read."""
    return int.from_bytes(handle.read_at(4, position + fixed - 4), "little")


def _chained(handle, size: int, start: int, fixed: int, n: int, first: int = 0, links: int = SYNC_RECORDS) -> bool:
    """Whether records of ``n`` samples follow each other from ``start``, as far as the file goes; 4 bytes a link."""
    stride = fixed + 2 * n
    for link in range(first, links):
        position = start + link * stride
        if position + fixed > size:
            return True
        if _count_at(handle, position, fixed) != n:
            return False
    return True


def predicted_start(boundary: int, stride: int) -> int:
    """Start of the first record at or after ``boundary`` if all records are ``stride`` bytes long."""
    return HEADER_SIZE + -(-max(boundary - HEADER_SIZE, 0) // stride) * stride


def find_sync(handle, size: int, boundary: int, fixed: int, n: int, window: int) -> int | None:
    """A likely record start at or after ``boundary``; a guess that the caller proves or discards.

    The offset every record of length ``fixed + 2n`` would predict is tried first; then any offset
    of the window that is followed by a chain of records with ``n`` samples. Chains are probed link by link,
    so what is read is bounded by the window whatever ``n`` claims.
    """
    if boundary <= HEADER_SIZE:
        return HEADER_SIZE
    stride = fixed + 2 * n
    if boundary + fixed > size:
        return None
    predicted = predicted_start(boundary, stride)
    if predicted + fixed <= size and _chained(handle, size, predicted, fixed, n):
        return predicted
    window = min(window, SYNC_WINDOW)
    buffer = handle.read_at(min(size - boundary, window + fixed), boundary)
    starts = len(buffer) - fixed + 1
    good = _counts(buffer, fixed - 4, 1, starts) == n
    whole = max(0, min(starts, size - boundary - fixed - stride * (SYNC_RECORDS - 1) + 1))
    good = good[:min(whole, window)].copy()
    inside = 1  # links that lie in the window are looked at together
    while inside < SYNC_RECORDS and inside * stride < starts:
        reach = min(len(good), starts - inside * stride)
        good[:reach] &= _counts(buffer, inside * stride + fixed - 4, 1, reach) == n
        inside += 1
    for at in np.flatnonzero(good)[:SYNC_CANDIDATES]:
        if _chained(handle, size, boundary + int(at), fixed, n, 1):
            return boundary + int(at)
    return None


def scan_runs(handle, size: int, start: int, stop: int, fixed: int, n: int):
    """Walk records from ``start`` until one begins at or after ``stop``.

    Yields ``(offset, records, kept, next_offset)`` for runs of records with ``n`` samples (kept) and
    for single records with another count (not kept). Only the count fields are looked at. The walk
    ends early at a record the file cuts off; ``end_reason`` names that state.
    """
    stride = fixed + 2 * n
    position = start
    width = 64
    while position < stop and position + fixed <= size:
        buffer = handle.read_at(min(READ_CHUNK + fixed, size - position), position)
        at = 0
        while position + at < stop and at + fixed <= len(buffer):
            here = position + at
            fits = max(1, (len(buffer) - at) // stride)
            wanted = -(-(stop - here) // stride)
            look = min(fits, wanted, width)
            same = _counts(buffer, at + fixed - 4, stride, look) == n
            run = look if same.all() else int(same.argmin())
            whole = min(run, (size - here) // stride)
            if whole:
                yield here, whole, True, here + whole * stride
            if whole < run:
                return
            at += run * stride
            if run < look:
                here = position + at
                other = int(_counts(buffer, at + fixed - 4, stride, 1)[0])
                at += fixed + 2 * other
                yield here, 1, False, min(position + at, size)
                width = 64
            else:
                width = min(width * 4, 1 << 20)
        position += at


def end_reason(size: int, position: int, fixed: int, n: int) -> str:
    """State of a file whose last whole record ends at ``position``."""
    if position >= size:
        return OK
    if size - position < fixed:
        return CUT_RECORD
    return NO_SAMPLES if size - position == fixed and n else CUT_RECORD


def probe_split(handle, size: int, index: int, split_bytes: int, fixed: int, n: int, piece: int):
    """Walk from the sync point of split ``index`` until exactly hitting a later split's sync point.

    Returns rows ``(start, stop, kept, skipped, lands_on, reason)``; every piece but the last of a
    walk repeats the same ``lands_on`` (-1 = end of file). A split without sync point gives no row.
    """
    window = min(split_bytes, max(1 << 20, 64 * (fixed + 2 * n)))
    last = max(0, -(-(size - HEADER_SIZE) // split_bytes) - 1)

    def sync_of(number):
        return find_sync(handle, size, HEADER_SIZE + number * split_bytes, fixed, n, window)

    position = sync_of(index)
    if position is None:
        return []
    pieces = []
    piece_start, kept, skipped = position, 0, 0
    lands_on, target = -1, index + 1
    while True:
        goal = sync_of(target) if target <= last else size
        if goal is None or goal < position:
            target += 1
            continue
        if target <= last and goal == position:
            lands_on = target
            break
        stuck = True
        for offset, records, is_kept, following in scan_runs(handle, size, position, goal, fixed, n):
            stuck = False
            position = following
            if is_kept:
                kept += records
            else:
                skipped += 1
            if position - piece_start >= piece:
                pieces.append([piece_start, position, kept, skipped])
                piece_start, kept, skipped = position, 0, 0
        if target <= last and position == goal:
            lands_on = target
            break
        if target > last or stuck:
            break
        if position < goal:
            break
        target += 1
    if position > piece_start or not pieces:
        pieces.append([piece_start, position, kept, skipped])
    reason = end_reason(size, position, fixed, n) if lands_on < 0 else OK
    return [(*p, lands_on, reason) for p in pieces]


def decode_range(handle, path: str, size: int, header: int, n: int | None, start: int, stop: int,
                 first_idx: int, with_samples: bool):
    """Arrow batches of the kept records that begin in ``[start, stop)``; ``start`` is a record start."""
    handle = ReadAhead(handle)
    fixed = record_dtype(header).itemsize
    n = n or 0
    dtype = record_dtype(header, n)
    per_batch = max(1, min(65536, READ_CHUNK // dtype.itemsize))
    if header & WAVEFORM:
        runs = ((o, c) for o, c, kept, _ in scan_runs(handle, size, start, stop, fixed, n) if kept)
    else:
        whole = max(0, -(-(stop - start) // dtype.itemsize))
        runs = iter([(start, min(whole, (size - start) // dtype.itemsize))])
    pending, held, index = [], 0, first_idx
    for offset, count in runs:
        done = 0
        while done < count:
            take = min(count - done, per_batch - held)
            raw = handle.read_at(take * dtype.itemsize, offset + done * dtype.itemsize)
            pending.append(np.frombuffer(raw, dtype))
            done += take
            held += take
            if held >= per_batch:
                yield to_arrow(pending, path, index, with_samples)
                index += held
                pending, held = [], 0
    if held:
        yield to_arrow(pending, path, index, with_samples)


def to_arrow(parts: list[np.ndarray], path: str, first_idx: int, with_samples: bool) -> pa.RecordBatch:
    records = parts[0] if len(parts) == 1 else np.concatenate(parts)
    count = len(records)
    names = records.dtype.names

    def field(name, kind, stored):
        if name not in names:
            return pa.nulls(count, kind)
        return pa.array(records[name].astype(stored), type=kind)

    columns = {
        "experiment_id": pa.repeat(pa.scalar(experiment_of(path), pa.string()), count),
        "source_file": pa.repeat(pa.scalar(path), count),
        "record_idx": pa.array(np.arange(first_idx, first_idx + count, dtype="i8")),
        "BOARD": pa.array((records["BOARD"] & 255).astype("i2")),
        "CHANNEL": pa.array((records["CHANNEL"] & 255).astype("i2")),
        "TIMESTAMP": pa.array(records["TIMESTAMP"].astype("u8")).cast(pa.decimal128(20, 0)),
        "FLAGS": pa.array(records["FLAGS"].astype("i8")),
    }
    for name, kind, stored in (("ENERGY", pa.int16(), "i2"), ("CALIB_ENERGY", pa.float64(), "f8"),
                               ("ENERGYSHORT", pa.int16(), "i2"), ("WAVEFORM_CODE", pa.int16(), "i2")):
        columns[name] = field(name, kind, stored)
    columns["extra"] = pa.nulls(count, ARROW_SCHEMA.field("extra").type)
    list_type = pa.list_(pa.int16())
    if "n" not in names or not with_samples:
        columns["samples"] = pa.nulls(count, list_type)
    elif "samples" not in names:
        columns["samples"] = pa.array([[]] * count, type=list_type)
    else:
        flat = np.ascontiguousarray(records["samples"]).reshape(-1)
        width = records.dtype["samples"].shape[0]
        offsets = np.arange(0, (count + 1) * width, width, dtype="i4")
        columns["samples"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
    return pa.RecordBatch.from_arrays([columns[f.name] for f in ARROW_SCHEMA], schema=ARROW_SCHEMA)
