"""Benchmark decontamination with suffix arrays of the training words.

Every task sorts the suffixes of its training words (one array a block, so documents are sharded over blocks and
tasks) and looks the suffixes of the benchmark up in it by binary search. Only training suffixes that begin with a
word triple of the benchmark can match ``WINDOW`` words, so the others are left out of the array before it is
sorted. Consecutive places along the same benchmark item make one longest verbatim match.

The documents are read once and never shuffled. The benchmark goes to the tasks in pieces of at most
``piece_words`` words (whole items, except that one longer item is a piece of its own), one pass over the
documents a piece, so what is broadcast has a fixed bound.

Cases: null or empty texts have no words and are never contaminated; an item without words is ignored; an item with
fewer words than a window is one window; items with a null id hit words but have no id to report; equal ids count
once; rows repeat in the result as in the input; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.run import map_texts, quoted, ready
from pulseframe.llm.text import ALNUM, Block, Words, covered, hash_runs, text_block, window_starts

WINDOW = 13
MIN_SHARE = 20  # contaminated: MIN_SHARE * hit words >= words
PIECE_WORDS = 2_000_000
_BITS = 20


@dataclass
class Piece:
    """Part of the benchmark as the tasks use it."""

    vocabulary: np.ndarray   # sorted hashes of its words
    filters: list[np.ndarray]  # by 1, 2, 3 leading words: bitmap of their hashes
    lengths: list[int]       # window lengths that occur
    rows: list[np.ndarray]   # by length: sorted distinct windows, as byte strings of word numbers
    owners: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: first owner of each window, items, places
    ids: list[str | None]


def _as_rows(numbers: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Windows of word numbers as byte strings that sort like the number sequences."""
    grid = numbers[starts[:, None] + np.arange(length)].astype(">u4")
    return np.ascontiguousarray(grid).view(f"S{4 * length}").ravel()


def _lead(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    return (hash_runs(hashes, starts, starts + size) & np.uint64((1 << _BITS) - 1)).astype(np.int64)


def build_piece(ids: list, texts: list, window: int = WINDOW) -> Piece:
    rows = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    words = Words(text_block(rows).lowered(), ALNUM)
    hashes = words.hashes()
    vocabulary = np.unique(hashes)
    numbers = np.searchsorted(vocabulary, hashes) + 1  # 0 is for words that no item has
    counts = words.counts()
    found: dict[int, list[np.ndarray]] = {}
    for length in sorted({min(int(n), window) for n in counts if n}):
        if length == window:
            starts = window_starts(words, window)
        else:
            starts = words.first[:-1][counts == length]
        found[length] = starts
    doc = words.doc()
    filters = [np.zeros(1 << _BITS, dtype=bool) for _ in range(3)]
    out_rows, owners = [], []
    for length, starts in found.items():
        lead = min(3, length)
        filters[lead - 1][_lead(hashes, starts, lead)] = True
        distinct, which = np.unique(_as_rows(numbers, starts, length), return_inverse=True)
        order = np.argsort(which, kind="stable")
        first = np.searchsorted(which[order], np.arange(len(distinct) + 1))
        out_rows.append(distinct)
        owners.append((first, doc[starts[order]], starts[order] - words.first[doc[starts[order]]]))
    names = [None if i is None else str(i) for i in ids]
    return Piece(vocabulary, filters, list(found), out_rows, owners, names)


def find(words: Words, piece: Piece) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
    """By window length: training positions (sorted by suffix) with the number of the window that starts there."""
    total = len(words)
    out: list = []
    if not total or not len(piece.vocabulary):
        return [(np.zeros(0, int), np.zeros(0, int), length, k) for k, length in enumerate(piece.lengths)]
    hashes = words.hashes()
    place = np.searchsorted(piece.vocabulary, hashes)
    place[place == len(piece.vocabulary)] = 0
    numbers = np.where(piece.vocabulary[place] == hashes, place + 1, 0)
    left = np.repeat(words.first[1:], words.counts()) - np.arange(total)  # words to the end of the text
    for k, length in enumerate(piece.lengths):
        lead = min(3, length)
        starts = np.flatnonzero((numbers > 0) & (left >= length))
        if lead > 1 and len(starts):
            starts = starts[numbers[starts + lead - 1] > 0]
        if len(starts):
            starts = starts[piece.filters[lead - 1][_lead(hashes, starts, lead)]]
        if not len(starts):
            out.append((starts, starts, length, k))
            continue
        suffixes = _as_rows(numbers, starts, length)
        order = np.argsort(suffixes, kind="stable")  # the suffix array of this shard, to the depth of a window
        array, places = suffixes[order], starts[order]
        low = np.searchsorted(array, piece.rows[k], "left")
        high = np.searchsorted(array, piece.rows[k], "right")
        many = high - low
        which = np.repeat(np.arange(len(low)), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        out.append((places[at], which, length, k))
    return out


def _owned(piece: Piece, k: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window number: (index into ``which``, item, place in the item) of all its owners."""
    first, items, places = piece.owners[k]
    many = first[which + 1] - first[which]
    source = np.repeat(np.arange(len(which)), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[which], many)
    return source, items[at], places[at]


def matches(words: Words, piece: Piece) -> dict[str, np.ndarray]:
    """Longest verbatim matches of at least a window: text, item, start word in both, length in words."""
    parts = []
    text_of = words.doc()
    for places, which, length, k in find(words, piece):
        source, item, inside = _owned(piece, k, which)
        start = places[source]
        parts.append((text_of[start], item, start - words.first[text_of[start]], inside, np.full(len(start), length)))
    text, item, start, inside, length = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, int)
                                         for i in range(5))
    order = np.lexsort((start, start - inside, length, item, text))
    text, item, start, inside, length = text[order], item[order], start[order], inside[order], length[order]
    if not len(text):
        return {"doc": text, "item": item, "start": start, "item_start": inside, "length": length}
    begins = np.ones(len(text), dtype=bool)
    begins[1:] = ~((text[1:] == text[:-1]) & (item[1:] == item[:-1]) & (length[1:] == length[:-1])
                   & (start[1:] - inside[1:] == start[:-1] - inside[:-1]) & (start[1:] == start[:-1] + 1))
    head = np.flatnonzero(begins)
    run = np.diff(np.append(head, len(text)))
    return {"doc": text[head], "item": item[head], "start": start[head], "item_start": inside[head],
            "length": length[head] + run - 1}


def _scan(block: Block, piece: Piece) -> dict[str, pa.Array]:
    words = Words(block.lowered(), ALNUM)
    found = matches(words, piece)
    order = np.argsort(found["doc"], kind="stable")
    offsets = np.searchsorted(found["doc"][order], np.arange(len(block) + 1))
    ids = pa.array(piece.ids, pa.string())
    item = ids.take(pa.array(found["item"][order]))
    struct = pa.StructArray.from_arrays(
        [pa.array(found["start"][order]), pa.array(found["length"][order]), item, pa.array(found["item_start"][order])],
        names=["start", "length", "item_id", "item_start"])
    return {"__words": words.counts(),
            "__now": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)}


_FOUND = "array<struct<start:long,length:long,item_id:string,item_start:long>>"


def pieces(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW,
           piece_words: int = PIECE_WORDS):
    """The benchmark's items in bounded pieces, fetched one after the other."""
    counted = map_texts(benchmark, lambda b: {"n": np.diff(b.offsets)}, "n long", [item_id], text)
    total = counted.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-total // (4 * piece_words)))  # a word has more than four bytes with its gap
    items = benchmark.select(F.col(quoted(item_id)).cast("string").alias("i"), F.col(quoted(text)).alias("t"))
    empty = True
    for number in range(count):
        mine = items if count == 1 else items.filter(
            F.pmod(F.xxhash64("i", "t"), F.lit(count)) == number)
        ids, texts, held = [], [], 0
        for row in mine.toLocalIterator():
            if held and held + len(row.t or "") > 16 * piece_words:  # uneven hashing: cut here
                empty = False
                yield build_piece(ids, texts, window)
                ids, texts, held = [], [], 0
            ids.append(row.i)
            texts.append(row.t)
            held += len(row.t or "")
        if ids:
            empty = False
            yield build_piece(ids, texts, window)
    if empty:
        yield build_piece([], [], window)


def find_matches(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                 piece_words: int = PIECE_WORDS) -> DataFrame:
    """``keep`` and the text of each document, ``__words`` (its words) and ``__found`` (its matches)."""
    spark = ready(docs)
    columns = list(dict.fromkeys([*keep, text]))
    out = docs
    for number, piece in enumerate(pieces(benchmark, item_id, item_text, window, piece_words)):
        held = spark.sparkContext.broadcast(piece)
        out = map_texts(out, lambda block, held=held: _scan(block, held.value), f"__words long, __now {_FOUND}",
                        columns if number == 0 else [*columns, "__found"], text)
        out = (out.withColumnRenamed("__now", "__found") if number == 0
               else out.withColumn("__found", F.concat("__found", "__now")).drop("__now"))
    return out.select(*[quoted(c) for c in columns], "__words", "__found")


def _judge(found: pa.Array, counts: np.ndarray) -> dict[str, list]:
    hit, ids, digest, longest = [], [], [], []
    for spans, total in zip(found.to_pylist(), counts, strict=True):
        if not spans:
            hit.append(0), ids.append(0), digest.append(_EMPTY), longest.append(0)
            continue
        marks = covered(np.array([s["start"] for s in spans]), np.array([s["length"] for s in spans]), int(total))
        names = sorted({s["item_id"] for s in spans if s["item_id"] is not None})
        hit.append(int(marks.sum()))
        ids.append(len(names))
        digest.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        longest.append(max(s["length"] for s in spans))
    return {"n_hit": hit, "n_items": ids, "items_sha256": digest, "longest": longest}


_EMPTY = hashlib.sha256(b"").hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  **options) -> DataFrame:
    """Per document: ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``longest`` (words of the longest
    match) and ``contaminated`` (``n_hit`` > 0 and 20 * ``n_hit`` >= ``n_words``)."""
    found = find_matches(docs, benchmark, [doc_id], text, **options).select(quoted(doc_id), "__words", "__found")
    schema = f"{quoted(doc_id)} {found.schema[doc_id].dataType.simpleString()}, n_words long, n_hit long, " \
             "n_items long, items_sha256 string, longest long, contaminated boolean"
    names = ["n_hit", "n_items", "items_sha256", "longest"]

    def finish(batches):
        for batch in batches:
            counts = batch.column(1).to_numpy()
            judged = _judge(batch.column(2), counts)
            hit = np.array(judged["n_hit"])
            verdict = (hit > 0) & (MIN_SHARE * hit >= counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), *(pa.array(judged[n], pa.string() if n == "items_sha256" else pa.int64())
                                                      for n in names), pa.array(verdict)],
                names=[doc_id, "n_words", *names, "contaminated"])

    return found.mapInArrow(finish, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    names = docs.columns
    found = find_matches(docs, benchmark, names, text, **options)

    def clean(batches):
        for batch in batches:
            counts = batch.column(batch.num_columns - 2).to_numpy()
            hit = np.array(_judge(batch.column(batch.num_columns - 1), counts)["n_hit"], dtype=np.int64)
            keep = ~((hit > 0) & (MIN_SHARE * hit >= counts))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:-2]],
                                             names=names)

    return found.mapInArrow(clean, docs.schema)
