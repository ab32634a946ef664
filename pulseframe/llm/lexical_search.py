"""Ranked lexical search of a stated set of queries over all documents, by MaxScore with pair bounds.

1. ``postings`` writes one row a segment (some whole texts of one partition): the documents' ids and lengths, and for
   each query term the documents that hold it with their counts. Nothing is shuffled.
2. ``statistics`` adds up the number of documents, their terms and each term's document frequency over the segments.
3. ``impact_index`` turns counts into impacts and writes, beside each term's list and its largest impact, the
   intersection list of each chosen pair of terms with the largest joint impact of a document that holds both. The pairs
   are the neighbours of each query's terms in order of weight.
4. ``search`` walks every segment for every query. A document's terms ``a`` and ``b`` give it at most the larger of
   their two maxima or the pair's joint maximum, which is less than the sum of the maxima. The least sum over
   matchings of neighbours bounds what the terms of small weight can give together; as long as it is below the score
   of rank ``k`` so far, their lists propose no documents. Where intersection lists are shorter than the lists they stand
   for, a pair counts with the larger single maximum alone and its intersection list proposes the documents that
   hold both. Proposed documents are completed from the heaviest of the other terms to the lightest and dropped as
   soon as the bound of what is left cannot lift them to rank ``k``.
5. Each task's best ``k`` of each query are merged by salted groups, then by query.

Queries are taken in blocks of at most ``BLOCK_TERMS`` terms (or one query), so what is broadcast is bounded; every
block is searched in all documents. Terms are compared by 64-bit hashes.

Cases: null, empty and blank texts have no terms, are not counted and match nothing; documents with equal ids are
ranked each on its own; null ids rank behind others of equal score; repeated queries are answered each on its own;
queries without terms, empty documents and empty queries give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.run import map_texts, quoted, ready, stream
from pulseframe.llm.text import ALNUM, Block, Words, blocks
from pulseframe.session import materialize

#: Text bytes of a segment, at most (or one text).
SEGMENT_BYTES = 2_000_000
#: Terms of the queries that are searched together, at most (or one query).
BLOCK_TERMS = 200_000
#: Salts of a query's candidates in the first of two merges.
SALTS = 32

_NO_ID = np.iinfo(np.int64).max
_POSTINGS = ("ids array<long>, lengths array<long>, terms array<int>, starts array<int>, docs array<int>, "
             "counts array<int>")
_INDEX = ("ids array<long>, terms array<int>, starts array<int>, docs array<int>, impacts array<int>, "
          "peaks array<int>, pairs array<int>, pair_starts array<int>, pair_docs array<int>, pair_peaks array<long>")


class Queries:
    """A block of queries: ``terms`` (sorted hashes), and for each query its number and the places of its terms."""

    def __init__(self, numbers: list[int], hashes: list[np.ndarray]):
        self.numbers = numbers
        self.terms = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.int64)
        self.places = [np.searchsorted(self.terms, h) for h in hashes]
        self.weights = np.zeros(len(self.terms), np.int64)
        self.pairs = np.zeros((0, 2), np.int64)
        self.pair_places: list[np.ndarray] = []

    def weigh(self, documents: int, frequency: np.ndarray) -> None:
        """Weights by document frequency; each query's terms in order of weight, and the pairs of its neighbours."""
        self.weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * frequency + 1))).astype(np.int64)
        self.places = [p[np.lexsort((p, self.weights[p]))] for p in self.places]
        size = max(len(self.terms), 1)
        codes = [p[:-1] * size + p[1:] for p in self.places]
        held = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        self.pairs = np.stack([held // size, held % size], axis=1)
        self.pair_places = [np.searchsorted(held, c) for c in codes]


def query_blocks(items: DataFrame, number: str, limit: int = BLOCK_TERMS) -> Iterator[Queries]:
    """The queries of ``items`` in blocks; one block at a time is on the driver."""

    def distinct(block: Block) -> dict:
        words = Words(block.lowered(), ALNUM)
        hashes = words.hashes().view(np.int64)
        return {"terms": [np.unique(hashes[low:high]) for low, high in zip(words.first, words.first[1:])]}

    found = materialize(map_texts(items, distinct, "terms array<long>", keep=[number]), "query-terms")
    numbers: list[int] = []
    hashes: list[np.ndarray] = []
    held = 0
    for row in found.filter(F.size("terms") > 0).orderBy(number).toLocalIterator():
        if numbers and held + len(row.terms) > limit:
            yield Queries(numbers, hashes)
            numbers, hashes, held = [], [], 0
        numbers.append(row[number])
        hashes.append(np.array(row.terms, np.int64))
        held += len(row.terms)
    if numbers:
        yield Queries(numbers, hashes)


def postings(docs: DataFrame, terms: np.ndarray, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row a segment of ``docs`` (``doc_id``, ``text``): lists of the sorted hashes ``terms``."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def build(batches):
        wanted = held.value
        for block in blocks(batches, "__text", segment_bytes):
            words = Words(block.lowered(), ALNUM)
            hashes = words.hashes().view(np.int64)
            place = np.searchsorted(wanted, hashes)
            place[place == len(wanted)] = 0
            hit = np.flatnonzero(wanted[place] == hashes) if len(wanted) else np.zeros(0, np.int64)
            code, counts = np.unique(place[hit] * len(block) + words.doc()[hit], return_counts=True)
            term, starts = np.unique(code // len(block), return_index=True)
            ids = block.rows.column(0).cast(pa.int64()).fill_null(_NO_ID)
            yield {"ids": [ids.to_numpy(zero_copy_only=False)], "lengths": [words.counts().astype(np.int64)],
                   "terms": [term.astype(np.int32)], "starts": [np.append(starts, len(code)).astype(np.int32)],
                   "docs": [(code % len(block)).astype(np.int32)], "counts": [counts.astype(np.int32)]}

    picked = docs.select(F.col("doc_id").cast("long").alias("__key"), F.col("text").cast("string").alias("__text"))
    return stream(picked, build, _POSTINGS)


def _rows(batches) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield {n: batch.column(i)[row].values.to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}


def statistics(segments: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each query term."""

    def count(batches):
        found = np.zeros(n_terms + 2, np.int64)
        for row in _rows(batches):
            found[row["terms"]] += np.diff(row["starts"])
            found[-2] += np.count_nonzero(row["lengths"])
            found[-1] += row["lengths"].sum()
        some = np.flatnonzero(found)
        yield {"place": some, "n": found[some]}

    sums = stream(segments, count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    out = np.zeros(n_terms + 2, np.int64)
    for row in sums.toLocalIterator():  # one number a query term
        out[row.place] = row.n
    return int(out[-2]), int(out[-1]), out[:-2]


def length_factors(lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    if not total:
        return np.full(len(lengths), 10, np.int64)
    if int(lengths.max(initial=0)) * 90 * documents < 1 << 63:
        return 10 + (90 * documents * lengths) // total
    return np.array([10 + 90 * documents * int(n) // total for n in lengths], np.int64)


def impact_index(segments: DataFrame, queries: Queries, documents: int, total: int) -> DataFrame:
    """Segments with impacts, the largest impact of each list, and the intersection lists of the queries' pairs."""
    held = segments.sparkSession.sparkContext.broadcast((queries.weights, queries.pairs))

    def build(batches):
        weights, pairs = held.value
        for row in _rows(batches):
            terms, starts, docs, counts = (row[n] for n in ("terms", "starts", "docs", "counts"))
            counts = counts.astype(np.int64)
            factor = length_factors(row["lengths"], documents, total)
            impacts = (1_000_000_000 * counts) // (1000 * counts + 8 * factor[docs])
            peaks = np.maximum.reduceat(impacts, starts[:-1]) if len(terms) else np.zeros(0, np.int64)
            local = np.full(len(weights), -1, np.int64)
            local[terms] = np.arange(len(terms))
            sides = local[pairs]
            both = np.flatnonzero((sides >= 0).all(axis=1))
            dense = np.zeros(len(factor), np.int64)  # weighted impact of the left term, by document
            lists, joint, last = [], [], -1
            for pair in both:
                left, right = sides[pair]
                if left != last:
                    if last >= 0:
                        dense[docs[starts[last]:starts[last + 1]]] = 0
                    span = slice(starts[left], starts[left + 1])
                    dense[docs[span]] = weights[terms[left]] * impacts[span] + 1
                    last = left
                span = slice(starts[right], starts[right + 1])
                ahead = dense[docs[span]]
                at = np.flatnonzero(ahead)
                lists.append(docs[span][at])
                joint.append((ahead[at] - 1 + weights[terms[right]] * impacts[span][at]).max(initial=0))
            sizes = np.array([len(x) for x in lists], np.int64)
            yield {"ids": [row["ids"]], "terms": [terms], "starts": [starts], "docs": [docs], "impacts": [impacts.astype(np.int32)],
                   "peaks": [peaks.astype(np.int32)], "pairs": [both.astype(np.int32)],
                   "pair_starts": [np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)],
                   "pair_docs": [np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int32)],
                   "pair_peaks": [np.array(joint, np.int64)]}

    return stream(segments, build, _INDEX)


class Segment:
    """One row of the index, ready for queries."""

    def __init__(self, row: dict[str, np.ndarray], weights: np.ndarray, n_pairs: int):
        self.row, self.weights = row, weights
        self.list_of = np.full(len(weights), -1, np.int64)
        self.list_of[row["terms"]] = np.arange(len(row["terms"]))
        self.pair_of = np.full(n_pairs, -1, np.int64)
        self.pair_of[row["pairs"]] = np.arange(len(row["pairs"]))

    def rank(self, places: np.ndarray, pair_places: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (and scores) that may be among the best ``k``, given that a score below ``floor`` is not."""
        row, n = self.row, len(places)
        lists = self.list_of[places]
        weights = self.weights[places]
        peaks = np.where(lists >= 0, weights * row["peaks"][lists], 0) if len(row["peaks"]) else np.zeros(n, np.int64)
        if not peaks.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin = np.where(lists >= 0, row["starts"][lists], 0)
        sizes = np.where(lists >= 0, row["starts"][lists + 1] - begin, 0)
        joined = self.pair_of[pair_places]
        none = np.zeros(n - 1, np.int64)
        joint = np.where(joined >= 0, row["pair_peaks"][joined], 0) if len(row["pair_peaks"]) else none
        pair_sizes = (np.where(joined >= 0, row["pair_starts"][joined + 1] - row["pair_starts"][joined], 0)
                      if len(row["pair_peaks"]) else none)
        bounds = matched_bounds(peaks.tolist(), joint.tolist())[0]
        apart, taken = matched_bounds(peaks.tolist(), [0] * (n - 1))
        split = _below(bounds, floor)
        wider = _below(apart, floor)
        proposing = _matching(taken, wider)
        if sizes[wider:].sum() + sum(pair_sizes[i] for i in proposing) < sizes[split:].sum():
            split = wider
        else:
            proposing = []
        scores = np.zeros(len(row["ids"]), np.int64)
        proposed = np.zeros(len(scores), bool)
        for i in range(split, n):
            span = slice(begin[i], begin[i] + sizes[i])
            docs = row["docs"][span]
            scores[docs] += weights[i] * row["impacts"][span]
            proposed[docs] = True
        for i in proposing:
            if joined[i] >= 0:
                proposed[row["pair_docs"][row["pair_starts"][joined[i]]:row["pair_starts"][joined[i] + 1]]] = True
        found = np.flatnonzero(proposed)
        for i in range(split - 1, -1, -1):
            found = found[scores[found] + bounds[i + 1] >= _kth(scores[found], k, floor)]
            if not len(found):
                break
            if sizes[i]:
                docs = row["docs"][begin[i]:begin[i] + sizes[i]]
                at = np.searchsorted(docs, found)
                at[at == len(docs)] = 0
                hit = docs[at] == found
                scores[found[hit]] += weights[i] * row["impacts"][begin[i] + at[hit]]
        found = found[scores[found] >= max(_kth(scores[found], k, floor), 1)]
        return found, scores[found]


def matched_bounds(peaks: list[int], joint: list[int]) -> tuple[list[int], list[bool]]:
    """For each prefix of the terms the least bound over matchings of neighbours, and whether it ends with a pair.

    ``joint[i]`` is the most that a document which holds the terms ``i`` and ``i + 1`` gets from both.
    """
    bounds, taken = [0], [False]
    for i, peak in enumerate(peaks):
        alone = bounds[i] + peak
        paired = bounds[i - 1] + max(peaks[i - 1], peak, joint[i - 1]) if i else alone
        bounds.append(min(alone, paired))
        taken.append(paired < alone)
    return bounds, taken


def _matching(taken: list[bool], length: int) -> list[int]:
    """Left neighbours of the pairs in the best matching of a prefix."""
    out = []
    while length:
        if taken[length]:
            out.append(length - 2)
        length -= 2 if taken[length] else 1
    return out


def _below(bounds: list[int], floor: int) -> int:
    """The longest prefix whose bound is below ``floor``."""
    split = 0
    while split + 1 < len(bounds) and bounds[split + 1] < floor:
        split += 1
    return split


def _kth(scores: np.ndarray, k: int, floor: int) -> int:
    if len(scores) < k:
        return floor
    return max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]))


def search_index(index: DataFrame, queries: Queries, k: int) -> DataFrame:
    """The best ``k`` documents of each query in each task: ``query``, ``score``, ``doc_id``."""
    held = index.sparkSession.sparkContext.broadcast(queries)

    def walk(batches):
        asked = held.value
        best: list[list[tuple[int, int]]] = [[] for _ in asked.numbers]  # (-score, id), best first
        for row in _rows(batches):
            segment = Segment(row, asked.weights, len(asked.pairs))
            for q, (places, pairs) in enumerate(zip(asked.places, asked.pair_places, strict=True)):
                floor = -best[q][-1][0] if len(best[q]) == k else 1
                found, scores = segment.rank(places, pairs, floor, k)
                if len(found):
                    order = np.lexsort((row["ids"][found], -scores))[:k]
                    mine = zip((-scores[order]).tolist(), row["ids"][found[order]].tolist(), strict=True)
                    best[q] = sorted([*best[q], *mine])[:k]
        flat = [(asked.numbers[q], -s, d) for q, rows in enumerate(best) for s, d in rows]
        ids = pa.array([d for _, _, d in flat], pa.int64())
        none = pa.array([d == _NO_ID for _, _, d in flat], pa.bool_())
        yield {"query": pa.array([q for q, _, _ in flat], pa.int64()), "score": pa.array([s for _, s, _ in flat], pa.int64()),
               "doc_id": pc.if_else(none, pa.scalar(None, pa.int64()), ids)}

    return stream(index, walk, "query long, score long, doc_id long")


def best_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_key: str = "item_id", block_terms: int = BLOCK_TERMS,
           segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The ``k`` best documents of each item: the item's key, ``rank``, ``doc_id``, ``score``."""
    spark = ready(docs)
    numbered = materialize(
        items.select(F.monotonically_increasing_id().alias("query"), F.col(quoted(item_key)).alias("item"), "text"),
        "queries")
    answers = None
    for queries in query_blocks(numbered, "query", block_terms):
        segments = materialize(postings(docs, queries.terms, segment_bytes), "postings")
        documents, total, frequency = statistics(segments, len(queries.terms))
        queries.weigh(documents, frequency)
        index = materialize(impact_index(segments, queries, documents, total), "impact-index")
        found = materialize(search_index(index, queries, k), "ranked")
        answers = found if answers is None else answers.unionByName(found)
    if answers is None:
        answers = spark.createDataFrame([], "query long, score long, doc_id long")
    salted = answers.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    merged = best_of(best_of(salted, ["query", "salt"], k).drop("rank", "salt"), ["query"], k)
    return (merged.join(numbered.select("query", "item"), "query")
            .select(F.col("item").alias(item_key), "rank", "doc_id", "score"))
