"""Running array functions over the texts of a DataFrame, and streaming over sorted partitions."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulseframe.llm.text import BLOCK_BYTES, Block, blocks, mix
from pulseframe.session import prepare

_ROWS = 200_000
#: A batch from the JVM ends with the row that reaches so many bytes.
BATCH_BYTES = 4_000_000


def fields(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    arrays = []
    for field, values in zip(schema, columns, strict=True):
        if isinstance(values, pa.ChunkedArray):
            values = values.combine_chunks()
        elif not isinstance(values, pa.Array):
            values = pa.array(values)
        arrays.append(values if values.type == field.type else values.cast(field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``function``, with what its task has freed given back to the system: a Python worker outlives its tasks."""
    def run(batches):
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
            if trim is not None:
                trim(0)
    return run


def map_texts(df: DataFrame, function: Callable[[Block], dict], ddl: str, keep: Iterable[str] = ("doc_id",),
              text: str = "text", limit: int = BLOCK_BYTES,
              only: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """One result row for each row of ``df``: its ``keep`` columns, then what ``function`` computes from its text.

    ``function`` gets a block of whole texts and returns one array a result column. Only ``keep`` and the text are
    read. A null text is an empty one. ``only`` filters the batches first.
    """
    keep = list(keep)
    added = fields(ddl)
    spark_schema = T.StructType([*(df.schema[k] for k in keep), *added])
    arrow_schema = to_arrow_schema(spark_schema)
    column = text if text in keep else "__text"

    def run(batches):
        for block in blocks(only(batches) if only else batches, column, limit):
            found = function(block)
            kept = [block.rows.column(i) for i in range(len(keep))]
            yield batch_of(arrow_schema, kept + [found[f.name] for f in added])

    picked = df.select(*[quoted(k) for k in keep])
    if text not in keep:
        picked = df.select(*[quoted(k) for k in keep], F.col(quoted(text)).cast("string").alias(column))
    return picked.mapInArrow(tidy(run), spark_schema)


def emit_rows(df: DataFrame, function: Callable[[Block, pa.Array], dict], ddl: str, key: str = "doc_id",
              text: str = "text") -> DataFrame:
    """Any number of result rows from each block: ``function`` gets the block and the key of each of its texts."""
    spark_schema = fields(ddl)
    arrow_schema = to_arrow_schema(spark_schema)

    def run(batches):
        for block in blocks(batches, "__text"):
            found = function(block, block.rows.column(0))
            whole = batch_of(arrow_schema, [found[f.name] for f in spark_schema])
            for low in range(0, whole.num_rows, _ROWS):
                yield whole.slice(low, _ROWS)

    picked = df.select(F.col(quoted(key)).alias("__key"), F.col(quoted(text)).cast("string").alias("__text"))
    return picked.mapInArrow(tidy(run), spark_schema)


def stream(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], ddl: str) -> DataFrame:
    """``function`` turns the batches of a partition into dicts of result columns."""
    spark_schema = fields(ddl)
    arrow_schema = to_arrow_schema(spark_schema)

    def run(batches):
        for found in function(batches):
            whole = batch_of(arrow_schema, [found[f.name] for f in spark_schema])
            if whole.num_rows:
                yield whole

    return df.mapInArrow(tidy(run), spark_schema)


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold only whole groups of equal ``keys``, from batches sorted by them.

    Memory follows the largest group, so this serves groups that are bounded by one document or one block.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for name in keys:
            values = column(batch, name)
            change[1:] |= values[1:] != values[:-1]
            if waiting:
                change[0] |= column(waiting[-1], name)[-1] != values[0]
        cuts = np.flatnonzero(change)
        if not len(cuts):
            waiting.append(batch)
            continue
        if waiting or cuts[-1]:
            yield pa.Table.from_batches([*waiting, batch.slice(0, cuts[-1])])
        waiting = [batch.slice(cuts[-1])]
    if waiting:
        yield pa.Table.from_batches(waiting)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ready(df: DataFrame) -> SparkSession:
    """The session of ``df``, with this package on its Python workers and Arrow batches bounded by bytes.

    Batches bounded by rows alone would grow with the texts, in the executor's JVM and in its Python workers.
    """
    spark = df.sparkSession
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_bitmap(df: DataFrame, name: str, bits: int = 24) -> np.ndarray:
    """A bitmap of ``2**bits`` flags over the hashed values of a long column, to thin out rows before a join.

    Its size is fixed; a crowded bitmap lets more rows through, never fewer. The join that follows is exact.
    """

    def mark(batches):
        held = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            place = _bit_places(column(batch, name), bits)
            np.bitwise_or.at(held, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        some = np.flatnonzero(held)
        yield {"word": some, "flags": held[some].view(np.int64)}

    found = stream(df.select(name), mark, "word int, flags long").groupBy("word").agg(F.bit_or("flags").alias("flags"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    for batch in found.toArrow().to_batches():  # at most 2**bits / 8 bytes of flags
        out[column(batch, "word")] = column(batch, "flags").view(np.uint64)
    return out


def _bit_places(values: np.ndarray, bits: int) -> np.ndarray:
    mixed = mix(values.astype(np.int64).view(np.uint64))
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = _bit_places(values, int(len(bitmap)).bit_length() - 1 + 6)
    return (bitmap[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


def thin(df: DataFrame, bitmap: np.ndarray, name: str) -> DataFrame:
    """The rows of ``df`` whose long column ``name`` may be in the bitmap (nulls are not)."""
    held = df.sparkSession.sparkContext.broadcast(bitmap)
    names = df.columns
    place = names.index(name)

    def pick(batches):
        for batch in batches:
            values = batch.column(place).cast(pa.int64())
            keep = in_bitmap(held.value, values.fill_null(0).to_numpy(zero_copy_only=False))
            keep &= values.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns], names=names)

    return df.mapInArrow(tidy(pick), df.schema)


def with_ids(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` whose ``name`` is among ``ids`` (one long column). Only rows that pass a bitmap are shuffled."""
    return thin(df, fresh_bitmap(ids, name), name).join(ids.hint("merge"), name, "left_semi")
