"""Text files that are still being written, as a stream of their completed lines.

The offset of the stream is the number of bytes of each file that have been looked at. A line belongs to the batch in
which its line feed arrives: the reading task looks back for the line's beginning, so a half line is left for the batch
that completes it and nothing is kept between batches. New bytes are cut into byte ranges, so a file that has grown by
much is read by many tasks. A file that has become shorter is a new one under the old name and is read from its start.
"""

from __future__ import annotations

import fnmatch

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from pulseframe.session import ship_package
from pulseframe.sources.files import open_ranged, resolve
from pulseframe.sources.text_format import completed_lines

FORMAT = "growing_text"
SPLIT_BYTES = 64 << 20
_BATCH_LINES = 10_000


class _Grown(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class _GrowingReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.glob = options.get("pathGlobFilter", "*")
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.from_end = str(options.get("startingOffsets", "earliest")).lower() == "latest"

    def _sizes(self) -> dict[str, int]:
        from pyarrow import fs

        system, inner = resolve(self.path)
        found = system.get_file_info(inner)
        if found.type == fs.FileType.NotFound:
            return {}
        infos = system.get_file_info(fs.FileSelector(inner)) if found.type == fs.FileType.Directory else [found]
        return {i.path: i.size for i in infos if i.type == fs.FileType.File
                and not i.base_name.startswith((".", "_")) and fnmatch.fnmatchcase(i.base_name, self.glob)}

    def initialOffset(self) -> dict:
        return self._sizes() if self.from_end else {}

    def latestOffset(self) -> dict:
        return self._sizes()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        _, inner = resolve(self.path)
        prefix = self.path[:len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        out = []
        for path, stop in sorted(end.items()):
            at = start.get(path, 0)
            at = 0 if stop < at else at
            out += [_Grown(prefix + path, low, min(low + self.split_bytes, stop))
                    for low in range(at, stop, self.split_bytes)]
        return out

    def read(self, partition):
        with open_ranged(partition.path) as handle:
            held: list[tuple[int, bytes]] = []
            for line in completed_lines(handle, partition.start, partition.stop):
                held.append(line)
                if len(held) == _BATCH_LINES:
                    yield _batch(partition.path, held)
                    held = []
            if held:
                yield _batch(partition.path, held)

    def commit(self, end: dict) -> None:
        pass


def _batch(path: str, lines: list[tuple[int, bytes]]) -> pa.RecordBatch:
    texts = pa.array([text.decode("utf-8", "replace") for _, text in lines], pa.string())
    return pa.RecordBatch.from_arrays(
        [texts, pa.repeat(pa.scalar(path), len(lines)), pa.array(np.array([at for at, _ in lines], np.int64))],
        names=["value", "source_file", "offset"])


class GrowingTextSource(DataSource):
    """``spark.readStream.format("growing_text").load(folder)``: ``value``, ``source_file``, ``offset`` of each line.

    Options: ``pathGlobFilter``, ``splitBytes``, and ``startingOffsets`` (``earliest``, or ``latest`` to skip what is there).
    """

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "value STRING, source_file STRING, offset BIGINT"

    def streamReader(self, schema):
        return _GrowingReader(self.options)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(GrowingTextSource)
