"""A uniform shuffle of documents into shards of exact sizes, by a hypergeometric communication matrix.

1. The documents are written once with a row number, so that every later read, and every repeated task, sees the same
   rows in the same blocks (a block is a partition of that write).
2. The communication matrix says how many rows each block sends to each shard. Its row sums are the block sizes, its
   column sums the shard sizes, and it has the law of a uniform permutation (multivariate hypergeometric). It is drawn
   by halving: the capacities of a range of blocks are split between its halves by one draw, seeded by the range. A
   task descends to its own block's row with one draw a level; nobody holds the matrix.
3. In each block a random permutation deals the rows out as its matrix row says, and gives each a random key.
4. Rows are exchanged by shard and range of keys and sorted by key within it. The ranges' sizes follow from the block
   sizes alone, so a row's slot is the count of the rows in the ranges before, plus its place in its own range; no
   task holds a shard.

Sizes: shards differ by one row at most, whatever texts repeat: equal texts are rows of their own. Only block sizes are
broadcast: at most ``MAX_BLOCKS`` numbers, as the input is coalesced to that many partitions.

Cases: null and empty texts are dealt out like any other; repeated rows and ids too; an empty table gives no rows; fewer
rows than shards leave the last shards empty; a column of the documents named ``shard`` or ``slot`` is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.run import partitions, quoted, ready, stream
from pulseframe.session import materialize

#: Blocks at most; their sizes take 8 bytes each.
MAX_BLOCKS = 1 << 20
#: numpy draws from populations below 10**9; above, and in ranges of blocks above this, the driver draws.
LARGE = 500_000_000
#: A row number is its block's number and its place in the block, as ``monotonically_increasing_id`` packs them.
_PLACE_BITS = 33


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """The exact sizes: as equal as they can be."""
    return np.full(shards, rows // shards, np.int64) + (np.arange(shards) < rows % shards)


def hypergeometric(random: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` rows drawn without replacement are good."""
    if good + bad < 1_000_000_000:
        return int(random.hypergeometric(good, bad, sample)) if sample else 0
    total = good + bad
    deviation = math.sqrt(sample * (good / total) * (bad / total) * ((total - sample) / (total - 1)))
    mode = (sample + 1) * (good + 1) // (total + 2)
    reach = int(10 * deviation) + 10  # beyond lies less than 1e-20 of the law
    low, high = max(0, sample - bad, mode - reach), min(sample, good, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) * (sample - k)) - np.log((k + 1) * (bad - sample + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chances = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(chances, random.random() * chances[-1], "right"))


def split_counts(random: np.random.Generator, counts: np.ndarray, sample: int) -> np.ndarray:
    """How many of ``sample`` rows fall to each kind, of which there are ``counts``."""
    out = np.zeros(len(counts), np.int64)
    rest = int(counts.sum())
    for i, count in enumerate(counts.tolist()):
        if not sample:
            break
        rest -= count
        out[i] = hypergeometric(random, count, rest, sample)
        sample -= int(out[i])
    return out


class Matrix:
    """The communication matrix of blocks and shards, one row at a time."""

    def __init__(self, blocks: np.ndarray, shards: np.ndarray, seed: int):
        self.before = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)
        self.shards, self.seed = shards, seed
        self.drawn: dict[tuple[int, int], np.ndarray] = {}
        waiting = [(0, len(blocks), shards)]
        while waiting:  # ranges with so many rows that their draws are slow, once for all tasks
            low, high, counts = waiting.pop()
            if high - low > 1 and self.before[high] - self.before[low] >= LARGE:
                left = self._left(low, high, counts)
                self.drawn[low, high] = left
                middle = (low + high) // 2
                waiting += [(low, middle, left), (middle, high, counts - left)]

    def _left(self, low: int, high: int, counts: np.ndarray) -> np.ndarray:
        if (low, high) in self.drawn:
            return self.drawn[low, high]
        middle = (low + high) // 2
        random = np.random.default_rng([self.seed, 0, low, high])
        return split_counts(random, counts, int(self.before[middle] - self.before[low]))

    def row(self, block: int) -> np.ndarray:
        low, high, counts = 0, len(self.before) - 1, self.shards
        while high - low > 1:
            middle = (low + high) // 2
            left = self._left(low, high, counts)
            low, high, counts = (low, middle, left) if block < middle else (middle, high, counts - left)
        return counts

    def deal(self, block: int, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard, range of keys and key of each row of a block, by its place in the block."""
        random = np.random.default_rng([self.seed, 1, block])
        counts = self.row(block)
        shard = np.empty(int(counts.sum()), np.int32)
        shard[random.permutation(len(shard))] = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        key = random.integers(0, 1 << 63, len(shard), dtype=np.int64)
        return shard, ((key >> 32) * ranges >> 31).astype(np.int32), key


def shard_documents(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """The documents in random order: their columns, ``shard`` (from 0) and ``slot`` (from 0 in each shard)."""
    spark = ready(docs)
    kept = [quoted(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    pinned = materialize(
        docs.coalesce(MAX_BLOCKS).select(F.struct(*kept).alias("doc"), F.monotonically_increasing_id().alias("row")),
        "shard-rows")
    sizes = pinned.groupBy(F.shiftright("row", _PLACE_BITS).alias("block")).count()
    held = sizes.toArrow()  # one number a block
    number = held.column("block").to_numpy()
    blocks = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
    blocks[number] = held.column("count").to_numpy()
    if not len(blocks):
        return pinned.select("doc.*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = -(-max(2 * len(blocks), 4 * partitions(spark)) // shards)
    matrix = spark.sparkContext.broadcast(Matrix(blocks, shard_sizes(int(blocks.sum()), shards), seed))

    @F.pandas_udf("shard int, part int, key long")
    def place(rows: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        block, dealt = -1, None
        for batch in rows:
            row = batch.to_numpy()
            home = row >> _PLACE_BITS
            out = [np.zeros(len(row), np.int64) for _ in range(3)]
            for b in np.unique(home):
                if b != block:
                    block, dealt = b, matrix.value.deal(int(b), ranges)
                mine = np.flatnonzero(home == b)
                for column, values in zip(out, dealt, strict=True):
                    column[mine] = values[row[mine] & ((1 << _PLACE_BITS) - 1)]
            yield pd.DataFrame({"shard": out[0].astype(np.int32), "part": out[1].astype(np.int32), "key": out[2]})

    def tally(batches):
        found = np.zeros(shards * ranges, np.int64)
        for batch in batches:
            for block in batch.column(0).to_pylist():
                shard, part, _ = matrix.value.deal(block, ranges)
                found += np.bincount(shard.astype(np.int64) * ranges + part, minlength=len(found))
        some = np.flatnonzero(found)
        yield {"shard": some // ranges, "part": some % ranges, "n": found[some]}

    counts = stream(spark.range(len(blocks)), tally, "shard int, part int, n long")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(
        counts.groupBy("shard", "part").agg(F.sum("n").alias("n"))
        .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "shard-ranges")
    inside = Window.partitionBy("shard", "part").orderBy("key", "row")
    return (pinned.select("doc", "row", place("row").alias("at")).select("doc", "row", "at.*")
            .join(starts, ["shard", "part"])
            .select("doc.*", "shard", (F.col("start") + F.row_number().over(inside) - 1).alias("slot")))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; the rows of each file are in the order of their slots, which do not overlap between files."""
    sharded.write.partitionBy("shard").parquet(path)
