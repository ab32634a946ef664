"""Encoder of small list-mode binary files for tests, written with ``struct`` to be independent."""

import struct


def record(flags, board=0, channel=0, timestamp=0, energy=0, calib=0.0, short=0, word=0, code=0, samples=()):
    out = struct.pack("<HHQ", board, channel, timestamp)
    if flags & 1:
        out += struct.pack("<h", energy)
    if flags & 2:
        out += struct.pack("<d", calib)
    if flags & 4:
        out += struct.pack("<h", short)
    out += struct.pack("<L", word)
    if flags & 8:
        out += struct.pack("<BL", code, len(samples)) + struct.pack(f"<{len(samples)}h", *samples)
    return out


def header(flags):
    return struct.pack("<H", 0xCAE0 | flags)


def write(path, flags, records, tail=b""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(header(flags) + b"".join(records) + tail)
