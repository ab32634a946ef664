"""Random binary files, random splits: the proven spans always decode to what a plain walk finds."""

import random

import pandas as pd
import pytest

from binfile import header, record
from pulseframe.sources.lines import cut
from pulseframe.sources import listmode_format as fmt
from pulseframe.sources.listmode_bin import _reachable


class Memory:
    def __init__(self, data):
        self.data = data

    def read_at(self, size, offset):
        return self.data[offset:offset + size]


def plain_walk(data, flags):
    """(time stamps of kept records, skipped, whether the file ends on a record)."""
    fixed = len(record(flags))
    at, first, kept, skipped = 2, None, [], 0
    while at + fixed <= len(data):
        n = int.from_bytes(data[at + fixed - 4:at + fixed], "little")
        first = n if first is None else first
        end = at + fixed + 2 * n
        if n != first:
            skipped += 1
        elif end > len(data):
            return kept, skipped, False
        else:
            kept.append(int.from_bytes(data[at + 4:at + 12], "little"))
        at = end
    return kept, skipped, at >= len(data)


def by_splits(data, split_bytes):
    handle, size = Memory(data), len(data)
    head = fmt.read_header(handle, size)
    splits = max(1, -(-(size - 2) // split_bytes))
    rows = []
    for split in range(splits):
        for piece in fmt.probe_split(handle, size, split, split_bytes, head["fixed"], head["n"], split_bytes):
            rows.append((split, *piece))
    columns = ["split", "start", "stop", "kept", "skipped", "lands_on", "reason"]
    spans = _reachable(pd.DataFrame(rows, columns=columns)).sort_values(["start", "split"])
    stamps, index = [], 0
    for span in spans.itertuples():
        for batch in fmt.decode_range(handle, "/a/b.bin", size, head["header"], head["n"], span.start, span.stop,
                                      index, True):
            got = batch.to_pydict()
            assert got["record_idx"] == list(range(index, index + batch.num_rows))
            assert all(len(s) == head["n"] for s in got["samples"])
            stamps += [int(t) for t in got["TIMESTAMP"]]
            index += batch.num_rows
    assert len(stamps) == spans.kept.sum()
    return stamps, int(spans.skipped.sum()), spans.iloc[-1].reason == fmt.OK


@pytest.mark.parametrize("seed", range(150))
def test_random_files(seed):
    rng = random.Random(seed)
    flags = 8 | rng.randrange(8)
    n = rng.choice([0, 1, 2, 5, 20, 64])
    odd = rng.choice([0.0, 0.0, 0.02, 0.3, 1.0])
    quiet = rng.random() < 0.4
    out = []
    for i in range(rng.randrange(1, 250)):
        count = n if i == 0 or rng.random() >= odd else rng.choice([0, n + 1, 3, 130])
        # Quiet samples repeat the expected count, which makes false record starts likely.
        samples = [n, 0] * (count // 2) + [n] * (count % 2) if quiet else [
            rng.randrange(-2000, 2000) for _ in range(count)]
        out.append(record(flags, timestamp=i, samples=samples, word=n if quiet else 0))
    data = header(flags) + b"".join(out)
    data = data[:len(data) - rng.choice([0, 0, 1, 3, 17, 40])]
    if len(data) < 2 + len(record(flags)):
        return
    want = plain_walk(data, flags)
    for split_bytes in (1 << 30, rng.randrange(30, 200), rng.randrange(200, 4000)):
        assert by_splits(data, split_bytes) == want, split_bytes


def test_spans_smaller_than_usual_share_tasks():
    assert cut(19_000_000, 1200, 8, 4096) == (4096, 24)  # 4,658 tasks of a span each before
    assert cut(19_000_000, 1200, 8) == (4 << 20, 24)
    assert cut(1 << 30, 1, 8, 512 << 20) == (512 << 20, 3)
