"""Token ids in seekable files: independent zstandard frames, a seek table at the end, a checksum for each frame.

File layout (all numbers little-endian):

* zstandard frames, each holding ``FRAME_IDS`` token ids as unsigned 32-bit integers (the last one fewer). The ids of
  the documents follow each other without gaps; a long document spans several frames.
* a skippable frame (magic 0x184D2A50) with the document index: for each document its id (signed 64-bit; 0 with
  flag 1 when it was null), its count of ids (unsigned 64-bit) and the flag (one byte), as three columns.
* a skippable frame (magic 0x184D2A5E) with the seek table: for each frame its compressed size, its size and the
  low 32 bits of the XXH64 of its content, then the count of frames, a flag byte 0x80 and 0x8F92EAB1.

Any zstandard reader can decompress the file; ``read_documents`` decompresses the frames of the wanted documents
alone. Documents are range-sorted by id into shards, one file a task. A file is written under a name of the task
attempt and then renamed, so a lost or repeated task leaves whole files only.

Cases: null texts are empty; an empty text has the end id alone; null ids come first; rows with equal ids are kept,
ordered by text hash; an empty table writes no file; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.run import quoted, ready, stream
from pulseframe.llm.text import Block, blocks, hash_bytes
from pulseframe.session import materialize, scratch_path

FRAME_IDS = 1 << 18
SHARD_BYTES = 32_000_000
CACHE_PIECES = 1_500_000
#: Pieces handed to the tokenizer at once; its results take far more memory than the ids kept of them.
ENCODE_PIECES = 8_192
_INDEX_MAGIC, _SEEK_MAGIC, _SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


class PieceEncoder:
    """Encodes texts piece by piece and remembers the pieces.

    A piece is white space and what follows it up to the next white space. Byte-level splitting never reaches over
    the place where white space begins, so the ids of a text are those of its pieces one after the other; words of
    a corpus repeat, and each is encoded once (a worker keeps ``CACHE_PIECES`` of them, then starts anew). Two
    64-bit hashes and the length identify a piece.
    """

    def __init__(self, tokenizer_json: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    @staticmethod
    def cuts(block: Block) -> np.ndarray:
        """Where the block's pieces start."""
        data = block.data
        white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
        solid = (data > 0x20) & (data < 0x7F)
        # a two-byte letter with a lead byte from 0xC3 on is not white space either
        solid[1:] |= ((data[1:] & 0xC0) == 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
        cut = np.zeros(len(data), dtype=bool)
        cut[1:] = white[1:] & solid[:-1]
        cut[block.offsets[:-1][np.diff(block.offsets) > 0]] = True
        return np.flatnonzero(cut)

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's texts, and where each text starts among them."""
        starts = self.cuts(block)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(block) + 1, np.int64)
        ends = np.append(starts[1:], len(block.data))
        keys = hash_bytes(block.data, starts, ends) ^ (hash_bytes(block.data, starts, ends, 1) << np.uint64(1))
        distinct, sample, which = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if not known.all():
            if len(self.keys) > CACHE_PIECES:
                self._clear()
                known[:] = False
            raw = block.data.tobytes()
            new = np.flatnonzero(~known)
            texts = [raw[starts[i]:ends[i]].decode("utf-8", "replace") for i in sample[new]]
            encoded = [e.ids for low in range(0, len(texts), ENCODE_PIECES)
                       for e in self.tokenizer.encode_batch_fast(texts[low:low + ENCODE_PIECES],
                                                                 add_special_tokens=False)]
            count = np.fromiter(map(len, encoded), np.int32, len(encoded))
            flat = np.fromiter((i for e in encoded for i in e), np.uint32, int(count.sum()))
            first = np.cumsum(count) - count + len(self.ids)
            place = np.searchsorted(self.keys, distinct[new])
            self.keys = np.insert(self.keys, place, distinct[new])
            self.first = np.insert(self.first, place, first)
            self.count = np.insert(self.count, place, count)
            self.ids = np.concatenate([self.ids, flat])
            at = np.searchsorted(self.keys, distinct)
        many = self.count[at][which].astype(np.int64)
        total = np.cumsum(many)
        source = np.arange(total[-1]) + np.repeat(self.first[at][which] - (total - many), many)
        edges = np.append(0, total)[np.searchsorted(starts, block.offsets)]
        return self.ids[source], edges


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[a-z0-9]+:/(?!/)", path):  # file:/x
        path = path.replace(":/", ":///", 1)
    return pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)


class SeekableWriter:
    def __init__(self, sink, level: int = 3):
        self.sink, self.frames = sink, []
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.ids, self.held = [], 0
        self.doc_ids, self.counts, self.absent = [], [], []

    def add(self, doc_ids: list, ids: np.ndarray, counts: np.ndarray) -> None:
        self.doc_ids.append(np.array([0 if i is None else i for i in doc_ids], np.int64))
        self.absent.append(np.array([i is None for i in doc_ids], np.uint8))
        self.counts.append(counts.astype(np.uint64))
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= FRAME_IDS:
            self._flush(False)

    def _flush(self, rest: bool) -> None:
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        stop = len(ids) if rest else len(ids) - len(ids) % FRAME_IDS
        for low in range(0, stop, FRAME_IDS):
            raw = ids[low:min(low + FRAME_IDS, stop)].astype("<u4").tobytes()
            packed = self.compressor.compress(raw)
            self.sink.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids, self.held = [ids[stop:]], len(ids) - stop

    def close(self) -> tuple[int, int]:
        """Writes the rest, the index and the seek table; gives the counts of documents and ids."""
        self._flush(True)
        columns = [np.concatenate(c) if c else np.zeros(0) for c in (self.doc_ids, self.counts, self.absent)]
        index = columns[0].astype("<i8").tobytes() + columns[1].astype("<u8").tobytes() + columns[2].astype("u1").tobytes()
        self.sink.write(struct.pack("<II", _INDEX_MAGIC, len(index)) + index)
        seek = b"".join(struct.pack("<III", *f) for f in self.frames)
        seek += struct.pack("<IBI", len(self.frames), 0x80, _SEEK_END)
        self.sink.write(struct.pack("<II", _SEEK_MAGIC, len(seek)) + seek)
        return len(columns[0]), int(columns[1].sum())


class SeekableReader:
    """Random access to one file; only the frames asked for are read and decompressed, and each is checked."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != _SEEK_END or flags != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        seek_at = size - 9 - 12 * frames
        source.seek(seek_at - 8)
        if struct.unpack("<II", source.read(8)) != (_SEEK_MAGIC, 12 * frames + 9):
            raise ValueError("damaged seek table")
        self.table = np.frombuffer(source.read(12 * frames), dtype="<u4").reshape(frames, 3).astype(np.int64)
        self.begins = np.append(0, np.cumsum(self.table[:, 0]))
        source.seek(int(self.begins[-1]))
        magic, length = struct.unpack("<II", source.read(8))
        if magic != _INDEX_MAGIC or length % 17:
            raise ValueError("damaged document index")
        index = source.read(length)
        documents = length // 17
        absent = np.frombuffer(index, "u1", documents, 16 * documents).astype(bool)
        self.doc_ids = pa.array(np.frombuffer(index, "<i8", documents), mask=absent)
        self.first = np.append(0, np.cumsum(np.frombuffer(index, "<u8", documents, 8 * documents).astype(np.int64)))
        self.decompressor = zstandard.ZstdDecompressor()
        self.frames_read = 0

    def frame(self, number: int) -> np.ndarray:
        packed, size, check = self.table[number]
        self.source.seek(int(self.begins[number]))
        raw = self.decompressor.decompress(self.source.read(int(packed)), max_output_size=int(size))
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {number} does not match its checksum")
        self.frames_read += 1
        return np.frombuffer(raw, dtype="<u4")

    def document(self, place: int) -> np.ndarray:
        """The ids of the document at ``place`` in the file's order."""
        low, high = self.first[place], self.first[place + 1]
        if low == high:
            return np.zeros(0, np.uint32)
        parts = [self.frame(n) for n in range(low // FRAME_IDS, (high - 1) // FRAME_IDS + 1)]
        offset = low // FRAME_IDS * FRAME_IDS
        return np.concatenate(parts)[low - offset:high - offset]

    def checksums(self) -> np.ndarray:
        """crc32 of the ids of each document, frame by frame."""
        sums = np.zeros(len(self.doc_ids), dtype=np.int64)
        for number in range(len(self.table)):
            raw = self.frame(number).tobytes()
            low, high = number * FRAME_IDS, number * FRAME_IDS + len(raw) // 4
            place = int(np.searchsorted(self.first, low, "right")) - 1
            while place < len(sums) and self.first[place] < high:
                start, stop = max(self.first[place], low), min(self.first[place + 1], high)
                sums[place] = zlib.crc32(raw[4 * (start - low):4 * (stop - low)], int(sums[place]))
                place += 1
        return sums


def write_token_files(docs: DataFrame, target: str, tokenizer_path: str, end_id: int, doc_id: str = "doc_id",
                      text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the files below ``target``; one row a file: ``shard``, ``path``, ``n_docs``, ``n_ids``."""
    spark = ready(docs)
    with open(tokenizer_path, encoding="utf-8") as file:
        held = spark.sparkContext.broadcast(file.read())
    picked = docs.select(F.col(quoted(doc_id)).cast("long").alias("id"),
                         F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"))
    size = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["id", F.xxhash64("text")]  # the hash spreads a hot id over shards
    shards = max(1, -(-size // shard_bytes))
    sorted_docs = picked.repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]):
        task = TaskContext.get()
        shard = task.partitionId()
        encoder = None  # one a task: kept longer, it would take memory from later stages
        fs, folder = _open_fs(target)
        name, draft = f"{folder}/ids-{shard:06d}.zst", f"{folder}/.ids-{shard:06d}-{task.taskAttemptId()}"
        sink = writer = None
        for block in blocks(batches):
            if writer is None:
                fs.create_dir(folder)
                sink = fs.open_output_stream(draft)
                writer, encoder = SeekableWriter(sink), PieceEncoder(held.value)
            ids, edges = encoder.encode(block)
            ids = np.insert(ids, edges[1:], np.uint32(end_id))
            writer.add(block.rows.column(0).to_pylist(), ids, np.diff(edges) + 1)
        if writer is not None:
            documents, total = writer.close()
            sink.close()
            fs.move(draft, name)
            yield {"shard": [shard], "path": [name], "n_docs": [documents], "n_ids": [total]}

    return materialize(stream(sorted_docs, write, "shard long, path string, n_docs long, n_ids long"), "token-files")


def read_token_files(files: DataFrame, target: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32`` of each document."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.withColumn("before", before)  # one row a file
    count = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = _open_fs(target)
                with fs.open_input_file(row["path"]) as source:
                    reader = SeekableReader(source)
                    yield {"doc_id": reader.doc_ids, "start": reader.first[:-1] + row["before"],
                           "n_tokens": np.diff(reader.first), "ids_crc32": reader.checksums()}

    return stream(placed.repartition(count, "shard"), read,
                  "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(path: str, places: list[int]) -> list[np.ndarray]:
    """The ids of some documents of one file, by their places in it."""
    fs, inner = _open_fs(path)
    with fs.open_input_file(inner) as source:
        reader = SeekableReader(source)
        return [reader.document(p) for p in places]


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, target: str | None = None, **columns) -> DataFrame:
    """Writes ``docs`` and reads the files back."""
    target = target or scratch_path(docs.sparkSession, "token-ids")
    return read_token_files(write_token_files(docs, target, tokenizer_path, end_id, **columns), target)
