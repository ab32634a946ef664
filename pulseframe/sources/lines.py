"""Text files as ``lines(source_file, line_no, value)``, numbered by spans: no line is shuffled or joined.

A planning pass counts the lines of each byte range of each file that is cut; running sums over that small table say which
number the first line of each range has. Reading tasks then number the lines of their ranges as they go.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseframe import schemas
from pulseframe.functions import scalars as fx
from pulseframe.session import materialize, ship_package
from pulseframe.sources import text_format as fmt
from pulseframe.sources.files import joined, list_files, open_ranged

DECODERS = {
    "utf-8": lambda value: value,
    "latin-1": fx.decode_latin1,
    "cp1252": fx.decode_cp1252,
}
SPLIT_BYTES = 64 << 20
MIN_SPLIT_BYTES = 4 << 20
#: More than two tasks only if each opens so many files at least, however many cores there are: starting one costs as much.
FEW_FILES = 16
#: Empty files that count as much as a full span.
FILES_PER_TASK = 64
#: The same for files of which only lines are read: a task costs as much as reading some hundred of them.
LINE_FILES_PER_TASK = 1024


def cut(total: int, files: int, parallelism: int, split_bytes: int | None = None,
        files_per_task: int = FILES_PER_TASK) -> tuple[int, int]:
    """Bytes of a span and number of tasks: large spans for large data, all cores for small data.

    Opening a file counts as a small share of a span, so that many small files share a task. So do many spans that a caller
    wants smaller: their number is not that of the tasks, each of which costs its worker time and memory.
    """
    usual = max(MIN_SPLIT_BYTES, min(SPLIT_BYTES, total // max(3 * parallelism, 1)))
    size = split_bytes or usual
    share = max(size, usual)
    few = max(-(-files // FEW_FILES), min(files, 2))
    return size, max(1, -(-(total + files * (share // files_per_task)) // share), min(few, parallelism))


def sized(files: DataFrame, split_bytes: int | None, *more: Column, files_per_task: int = FILES_PER_TASK):
    """Bytes of a span, number of tasks that should read ``files(path, length, ...)``, and a row of what ``more`` counts."""
    totals = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files"), *more).first()
    parallelism = files.sparkSession.sparkContext.defaultParallelism
    return *cut(totals["bytes"], totals["files"], parallelism, split_bytes, files_per_task), totals


def spans_of(files: DataFrame, split_bytes: int | None = None,
             files_per_task: int = FILES_PER_TASK) -> tuple[DataFrame, int]:
    """``(files' columns, split, start, stop)`` of ``files(path, length, ...)``, and how many tasks should read them."""
    size, tasks, _ = sized(files, split_bytes, files_per_task=files_per_task)
    return cut_spans(files, size), tasks


def cut_spans(files: DataFrame, size: int) -> DataFrame:
    """``files(path, length, ...)`` with the spans of ``size`` bytes of each: ``split, start, stop``."""
    last = F.greatest(F.lit(0).cast("bigint"), F.ceil(F.col("length") / F.lit(size)) - 1)
    return (
        files.withColumn("split", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .withColumn("start", F.col("split") * F.lit(size))
        .withColumn("stop", F.least(F.col("start") + F.lit(size), F.col("length")))
    )


def place_spans(counted: DataFrame, size: str = "n", out: str = "first") -> DataFrame:
    """Add to each span how many lines the earlier spans of its file hold. One row a span, not a line."""
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn(out, F.coalesce(F.sum(size).over(earlier), F.lit(0).cast("bigint")))


def over_spans(read: Callable) -> Callable:
    """A ``mapInArrow`` function from ``read(handle, row)``, which yields the batches of one span."""
    def each(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open_ranged(row["path"]) as handle:
                    yield from read(handle, row)

    def run(batches):
        return joined(each(batches))
    return run


def _count(handle, row):
    n = fmt.count_lines(handle, row["length"], row["start"], row["stop"])
    yield pa.RecordBatch.from_pylist([{**row, "n": n}])


def _read(handle, row):
    number = row["first"]
    for block in fmt.line_blocks(handle, row["length"], row["start"], row["stop"]):
        count = len(block)
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(row["path"]), count), pa.array(np.arange(number, number + count)), block.texts()],
            names=["source_file", "line_no", "value"])
        number += count


def _read_values(handle, row):
    for block in fmt.line_blocks(handle, row["length"], row["start"], row["stop"]):
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(row["path"]), len(block)), block.texts()], names=["source_file", "value"])


_SPAN = "path STRING, length BIGINT, split BIGINT, start BIGINT, stop BIGINT"


def lines_of(files: DataFrame, encoding: str = "utf-8", split_bytes: int | None = None) -> DataFrame:
    """Lines of the files that a table ``files(path, length)`` names.

    Only files of several spans are counted: the lines of a whole file begin at 0. Without files the plan says that there are
    no lines.
    """
    if encoding not in DECODERS:
        raise ValueError(f"unknown encoding {encoding!r}: use one of {sorted(DECODERS)}")
    ship_package(files.sparkSession)
    files = materialize(files.select("path", "length"), "text-files")
    size, tasks, totals = sized(files, split_bytes, F.max("length").alias("longest"), F.count_distinct("path").alias("paths"),
                                files_per_task=LINE_FILES_PER_TASK)
    if not totals["files"]:
        return files.sparkSession.createDataFrame([], schemas.LINES).limit(0)
    spans = cut_spans(files, size)
    placed = []
    to_count = spans
    if totals["paths"] == totals["files"]:  # else a path is named twice, and its second copy is numbered on
        placed.append(spans.where(F.col("length") <= size).withColumn("first", F.lit(0).cast("bigint")))
        to_count = spans.where(F.col("length") > size)
    if not placed or (totals["longest"] or 0) > size:
        counted = to_count.repartition(tasks).mapInArrow(over_spans(_count), f"{_SPAN}, n BIGINT")
        placed.append(materialize(place_spans(counted), "line-counts").where(F.col("n") > 0).drop("n"))
    placed = reduce(DataFrame.unionByName, placed)
    rows = placed.repartition(tasks).mapInArrow(over_spans(_read), schemas.LINES)
    return rows.withColumn("value", DECODERS[encoding](F.col("value")))


def read_lines(spark: SparkSession, path, glob: str | None = None, encoding: str = "utf-8",
               files: Column | None = None, split_bytes: int | None = None) -> DataFrame:
    """Lines of every text file below ``path``; ``line_no`` counts from 0 over the whole file.

    Large files stay split. ``files`` is a condition on the files' ``path``; files that fail it are not opened. The
    counting pass runs when this is called.
    """
    found = list_files(spark, path, glob)
    return lines_of(found if files is None else found.where(files), encoding, split_bytes)


def read_values(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """Plain lines with their file, for operators that do not need line numbers: no counting pass."""
    ship_package(spark)
    spans, tasks = spans_of(materialize(list_files(spark, path, glob).select("path", "length"), "text-files"))
    return spans.repartition(tasks).mapInArrow(over_spans(_read_values), "source_file STRING, value STRING")
