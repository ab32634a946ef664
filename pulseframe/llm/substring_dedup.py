"""Repeated passages by a greedy relative Lempel-Ziv parse against indexed reference blocks.

A window of ``WINDOW`` words that stands at an earlier place too (of a smaller document, or earlier in the same one) is
removed; every word decision is made on the input.

The index of reference blocks is distributed and holds blocks of ``ANCHOR`` words at chosen places only: every window
of ``WINDOW`` words has one anchor, its block with the smallest hash, and equal windows have equal anchors at equal
places. So

1. long pieces are settled first: whole documents, and pieces cut where the words themselves say so (a block hash
   with ``CUT_BITS`` low zeros). Of equal pieces all but the first are repeats, and so is every window inside them; no
   such window is the first of its kind, so none needs to be looked at again;
2. anchors that occur once are dropped, and with them most of the text;
3. documents with shared anchors emit their other windows around these, each under its hash; sorted by hash and
   place, the first is the reference of all that follow (a second, independent hash is compared for every piece and
   window);
4. each document is parsed greedily by these matches: the longest match with a reference at the next word that starts
   one is a factor, and the parse jumps past it (``factors``). Matches are a window long at least, so every factor is
   long enough to be removed. A jump hides matches that begin inside a factor and end behind it; they are checked at
   each factor's boundary and removed as well. A reference is the first place of a piece or window, and a factor goes on
   along it as long as the document's own first places do. ``n_factors`` counts the factors.

Texts are shuffled only for documents with shared anchors (step 3) and for those that lose words (step 4). A passage
that many documents share never forms a group in memory: its windows stream past the first one, and repeats within a
task's block are settled there.

Cases: null texts have no words; documents of fewer words than a window lose nothing; null ids come before all others;
rows that share an id, or have none, are documents of their own, in the order in which they are written when the operator
numbers them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.run import (column, emit_rows, fresh_bitmap, in_bitmap, map_texts, partitions, quoted, ready, stream)
from pulseframe.llm.text import Block, Words, blocks, covered, hash_runs, mix, window_starts
from pulseframe.operators.positions import sorted_positions
from pulseframe.session import materialize

WINDOW = 20
ANCHOR = 6
CUT_BITS = 7
_NULL_ID = -(1 << 63)


def window_anchors(words: Words, hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each window, the place of its anchor, and the hash of the block at every word."""
    starts = window_starts(words, window)
    count = len(words) - anchor + 1
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    runs = hash_runs(hashes, np.arange(count), np.arange(count) + anchor)
    spread = window - anchor + 1
    bits = np.uint64((1 << int(spread).bit_length()) - 1)
    best = np.full(len(starts), ~np.uint64(0))
    for offset in range(spread):  # smallest hash, the leftmost of equals
        np.minimum(best, (runs[starts + offset] & ~bits) | np.uint64(offset), out=best)
    return starts, starts + (best & bits).astype(np.int64), runs


def _ids(key: pa.Array) -> np.ndarray:
    return key.cast(pa.int64()).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)


def _anchors(block: Block, key: pa.Array, window: int, anchor: int) -> dict:
    """One row an anchor. Of equal anchors in the block, one stands for the block and the others are known as shared."""
    words = Words(block)
    _, at, hashes = window_anchors(words, words.hashes(), window, anchor)
    at = np.unique(at)
    keys = hashes[at] if len(at) else np.zeros(0, np.uint64)
    doc = words.doc()[at]
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(at), dtype=bool)
    again[order[1:]] = keys[order][1:] == keys[order][:-1]
    place = at - words.first[doc]
    ids = _ids(key)[doc]
    spread = mix(ids.view(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    # a block's own repeats make its representative shared as well: it is sent twice
    twice = np.zeros(len(at), dtype=bool)
    twice[order[:-1]] = (keys[order][1:] == keys[order][:-1]) & ~again[order[:-1]]
    return {"key": np.append(np.where(again, spread, keys), spread[twice]).view(np.int64),
            "known": np.append(again, np.ones(int(twice.sum()), dtype=bool)),
            "doc": np.append(ids, ids[twice]), "place": np.append(place, place[twice])}


def _shared_anchors(batches):
    """Places of anchors that occur more than once; of neighbours with equal keys, each is sent once."""
    waiting = None  # last row, not sent yet
    for batch in batches:
        if not batch.num_rows:
            continue
        key, known, doc, place = (column(batch, c) for c in ("key", "known", "doc", "place"))
        if waiting is not None:
            key, known = np.append(waiting[0], key), np.append(waiting[1], known)
            doc, place = np.append(waiting[2], doc), np.append(waiting[3], place)
        near = key[1:] == key[:-1]
        send = np.append(False, near) | np.append(near, False) | known
        if waiting is not None:
            send[0] |= waiting[4]
        waiting = (key[-1:], known[-1:], doc[-1:], place[-1:], bool(send[-1]))
        yield {"doc": doc[:-1][send[:-1]], "place": place[:-1][send[:-1]]}
    if waiting is not None and waiting[4]:
        yield {"doc": waiting[2], "place": waiting[3]}


_PLACED = "key long, check int, doc long, start int, length int, ref long, ref_start int"
_FOUND = "doc long, start int, length int, ref long, ref_start int"
_OPEN = -2  # as ref_start: not settled within the block; a whole document has start -1


def _placed(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray, start: np.ndarray) -> dict:
    """Rows of pieces or windows; repeats within the block are settled here and go anywhere."""
    key = hash_runs(hashes, begin, end)
    key[start < 0] ^= np.uint64(0xA0761D6478BD642F)  # whole documents meet whole documents only
    check = (hash_runs(hashes, begin, end, 1) >> np.uint64(44)).astype(np.int64)
    order = np.lexsort((start, doc, check, key))
    key, check, doc, start, length = (v[order] for v in (key, check, doc, start, end - begin))
    head = np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]))[:len(key)]
    index = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
    ref, ref_start = doc[index], start[index]
    settled = (doc != ref) | (start != ref_start)
    spread = mix(doc.view(np.uint64) + start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return {"key": np.where(settled, spread, key).view(np.int64), "check": check, "doc": doc, "start": start,
            "length": length, "ref": np.where(settled, ref, 0), "ref_start": np.where(settled, ref_start, _OPEN)}


def _first_places(batches):
    """Pieces or windows with an earlier occurrence, and that occurrence; rows are sorted by hashes and place."""
    first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, check, doc, start, length, ref, ref_start = (
            column(batch, c) for c in ("key", "check", "doc", "start", "length", "ref", "ref_start"))
        known = ref_start != _OPEN
        head = np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]))
        if first is not None and key[0] == first[0] and check[0] == first[1]:
            head[0] = False
        index = np.maximum.accumulate(np.where(head, np.arange(len(key)), -1))
        safe = np.maximum(index, 0)
        origin, origin_start = doc[safe], start[safe]
        if not head[0]:
            before = index < 0
            origin, origin_start = np.where(before, first[2], origin), np.where(before, first[3], origin_start)
        first = (key[-1], check[-1], origin[-1], origin_start[-1])
        send = known | (doc != origin) | (start != origin_start)
        yield {"doc": doc[send], "start": start[send], "length": length[send],
               "ref": np.where(known, ref, origin)[send], "ref_start": np.where(known, ref_start, origin_start)[send]}


def _settle(rows: DataFrame, width: int) -> DataFrame:
    return stream(rows.repartition(width, "key").sortWithinPartitions("key", "check", "doc", "start"), _first_places, _FOUND)


def _pieces(block: Block, key: pa.Array, window: int, anchor: int) -> dict:
    """Whole documents and their pieces, those of at least a window."""
    words = Words(block)
    hashes = words.hashes()
    total = len(words)
    count = max(0, total - anchor + 1)
    runs = hash_runs(hashes, np.arange(count), np.arange(count) + anchor)
    begins = np.unique(np.append(np.flatnonzero((runs & np.uint64((1 << CUT_BITS) - 1)) == 0), words.first[:-1]))
    begins = begins[begins < total]
    ends = np.append(begins[1:], total)
    doc = words.doc()[begins]
    start = begins - words.first[doc]
    whole = np.flatnonzero(words.counts() >= window)
    long = ends - begins >= window
    begin, end = np.append(begins[long], words.first[whole]), np.append(ends[long], words.first[whole + 1])
    owner = np.append(doc[long], whole)
    return _placed(hashes, begin, end, _ids(key)[owner], np.append(start[long], np.full(len(whole), -1)))


def factors(start: np.ndarray, length: np.ndarray, ref: np.ndarray,
            ref_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy parse of one document by its matches with references: factor starts, factor ends, matches to check.

    Matches that touch or overlap along one reference and shift are one longer match with it. The parse takes the
    longest match at the first word that starts one, jumps past it and goes on. A match that is not inside a factor
    crosses a factor's boundary, where the jump hides it: those are returned by index, to be looked at on their own.
    """
    order = np.lexsort((start, ref_start - start, ref))
    begin, end = start[order], (start + length)[order]
    shift, source = (ref_start - start)[order], ref[order]
    reach = begin[:0]
    if len(order):
        line = np.cumsum(np.append(False, (source[1:] != source[:-1]) | (shift[1:] != shift[:-1])))
        lift = line * (int(end.max()) + 1)
        reach = np.maximum.accumulate(end + lift) - lift  # furthest end so far along the line
        run = np.cumsum(np.append(False, (line[1:] != line[:-1]) | (begin[1:] > reach[:-1])))
        last = np.append(np.flatnonzero(run[1:] != run[:-1]), len(run) - 1)
        reach = reach[last][run]
    by_start = np.lexsort((-reach, begin))
    begin, reach = begin[by_start], reach[by_start]
    starts, ends, at = [], [], 0
    while (i := int(np.searchsorted(begin, at))) < len(begin):
        starts.append(int(begin[i]))
        at = int(reach[i])
        ends.append(at)
    starts, ends = np.array(starts, np.int64), np.array(ends, np.int64)
    inside = np.searchsorted(starts, start, "right") - 1
    held = (inside >= 0) & (start + length <= ends[np.maximum(inside, 0)]) if len(starts) else np.zeros(0, bool)
    return starts, ends, np.flatnonzero(~held)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                   anchor: int = ANCHOR) -> DataFrame:
    """``doc`` and ``spans``: its pieces and windows with an earlier occurrence, as (start, length, ref, ref_start)."""
    spark = ready(docs)
    width = partitions(spark)
    pieces = materialize(_settle(emit_rows(docs, lambda block, key: _pieces(block, key, window, anchor), _PLACED,
                                           doc_id, text), width), "repeated-pieces")
    whole = pieces.filter("start < 0").select("doc").distinct()
    settled = (pieces.filter("start >= 0").groupBy("doc")
               .agg(F.collect_list(F.struct("start", "length")).alias("settled")))
    anchors = emit_rows(docs, lambda block, key: _anchors(block, key, window, anchor),
                        "key long, known boolean, doc long, place int", doc_id, text)
    shared = stream(anchors.repartition(width, "key").sortWithinPartitions("key"), _shared_anchors, "doc long, place int")
    by_doc = materialize(shared.groupBy("doc").agg(F.sort_array(F.collect_set("place")).alias("places"))
                         .join(whole, "doc", "left_anti").join(settled, "doc", "left"), "shared-anchors")
    near = by_doc.join(_thinned(docs, fresh_bitmap(by_doc, "doc"), doc_id, text), "doc")

    def windows(block: Block) -> dict:
        words = Words(block)
        hashes = words.hashes()
        starts, at, _ = window_anchors(words, hashes, window, anchor)
        places = block.rows.column(1)
        chosen = np.zeros(len(words) + 1, dtype=bool)
        many = places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        spot = places.flatten().to_numpy(zero_copy_only=False) + np.repeat(words.first[:-1], many)
        chosen[spot[spot < len(words)]] = True
        starts = starts[chosen[at]]
        lists = block.rows.column(2)
        many = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        inside = lists.flatten()
        low = inside.field(0).to_numpy(zero_copy_only=False) + np.repeat(words.first[:-1], many)
        length = inside.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
        fits = low + length <= np.repeat(words.first[1:], many)
        # windows that lie whole in a settled piece
        starts = starts[~covered(low[fits], length[fits] - window + 1, len(words))[starts]]
        text_of = words.doc()[starts]
        return _placed(hashes, starts, starts + window, _ids(block.rows.column(0))[text_of], starts - words.first[text_of])

    def run(batches):
        for block in blocks(batches, "__text"):
            yield windows(block)

    found = _settle(stream(near.select("doc", "places", "settled", "__text"), run, _PLACED), width)
    return (pieces.union(found).groupBy("doc")
            .agg(F.collect_list(F.struct("start", "length", "ref", "ref_start")).alias("spans")))


def _thinned(docs: DataFrame, bitmap: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """``doc`` and text of the documents whose id may be among those wanted."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def pick(batches):
        for batch in batches:
            ids = _ids(batch.column(0))
            keep = pa.array(in_bitmap(held.value, ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids).filter(keep), batch.column(1).filter(keep)],
                                             names=["doc", "__text"])

    picked = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc"), F.col(quoted(text)).cast("string").alias("__text"))
    return picked.mapInArrow(pick, "doc long, __text string")


def _sha(words: Words, doc: int, keep: np.ndarray | None = None) -> str:
    return hashlib.sha256(words.joined(doc, keep)).hexdigest()


def _repeated_ids(docs: DataFrame, doc_id: str) -> bool:
    """Whether some rows share an id, or more than one has none."""
    key = F.col(quoted(doc_id)).cast("long").alias("id")
    return bool(docs.select(key).groupBy("id").count().filter("count > 1").take(1))


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                    anchor: int = ANCHOR) -> DataFrame:
    """Per document: ``n_words``, ``n_removed``, ``n_factors``, ``kept_sha256`` (kept words joined by one space)."""
    ready(docs)
    if not _repeated_ids(docs, doc_id):
        return _by_number(docs, doc_id, text, window, anchor)
    # Rows get numbers of their own in the order of ids (nulls first), those of an id in the order they are written here.
    rows = materialize(docs.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("text"),
                                   F.monotonically_increasing_id().alias("row")), "rows-of-ids")
    places = sorted_positions(rows.select("row", F.col("id").cast("long").alias("sorted")),
                              [F.asc_nulls_first("sorted"), F.asc("row")], out="number").select("row", "number")
    numbered = materialize(rows.join(places, "row"), "numbered-rows")
    found = _by_number(numbered, "number", "text", window, anchor)
    return (numbered.select("number", F.col("id").alias(doc_id)).join(found, "number")
            .select(quoted(doc_id), "n_words", "n_removed", "n_factors", "kept_sha256"))


def _by_number(docs: DataFrame, doc_id: str, text: str, window: int, anchor: int) -> DataFrame:
    """The same for rows with ids of their own."""
    repeated = materialize(repeated_spans(docs, doc_id, text, window, anchor), "repeated-spans")

    def whole(block: Block) -> dict:
        words = Words(block)
        zeros = np.zeros(len(block), np.int64)
        return {"n_words": words.counts(), "n_removed": zeros, "n_factors": zeros,
                "kept_sha256": [_sha(words, i) for i in range(len(block))]}

    result = "n_words long, n_removed long, n_factors long, kept_sha256 string"
    kind = docs.schema[doc_id].dataType
    all_docs = map_texts(docs, whole, result, [doc_id], text)
    key = F.coalesce(F.col(quoted(doc_id)).cast("long"), F.lit(_NULL_ID))
    untouched = all_docs.join(repeated.select("doc"), key == F.col("doc"), "left_anti")

    def cut(block: Block) -> dict:
        words = Words(block)
        removed, parsed, digest = [], [], []
        for i, spans in enumerate(block.rows.column(1)):
            start, length, ref, ref_start = (
                spans.values.field(n).to_numpy() for n in ("start", "length", "ref", "ref_start"))
            start, ref_start = np.maximum(start, 0), np.maximum(ref_start, 0)
            total = int(words.first[i + 1] - words.first[i])
            starts, ends, crossing = factors(start, length, ref, ref_start)
            gone = covered(starts, ends - starts, total) | covered(start[crossing], length[crossing], total)
            removed.append(int(gone.sum()))
            parsed.append(len(starts))
            keep = np.ones(len(words), dtype=bool)
            keep[words.first[i]:words.first[i + 1]] = ~gone
            digest.append(_sha(words, i, keep))
        return {"n_words": words.counts(), "n_removed": removed, "n_factors": parsed, "kept_sha256": digest}

    touched = repeated.join(_thinned(docs, fresh_bitmap(repeated, "doc"), doc_id, text), "doc")
    shortened = (map_texts(touched, cut, result, ["doc", "spans"], "__text")
                 .select(F.when(F.col("doc") != _NULL_ID, F.col("doc")).cast(kind).alias(doc_id),
                         "n_words", "n_removed", "n_factors", "kept_sha256"))
    return untouched.select(quoted(doc_id), "n_words", "n_removed", "n_factors", "kept_sha256").union(shortened)
