"""Quality rules from a hashed n-gram log-likelihood ratio.

Two multinomials over ``2**BITS`` buckets of hashed character n-grams (UTF-8 bytes) are counted over all rows: one over
the trusted texts, one over the whole corpus, each with one added to every bucket. A document's score is the sum over
its n-grams of log p(trusted) - log p(corpus), divided by its number of n-grams. A document is kept if no base rule
fails it and its score is at least ``THRESHOLD``; the same input always gives the same verdict.

Each task counts its own texts into one array and emits it in chunks, so what is shuffled is bounded by tasks times
buckets, and the driver gets ``2**BITS`` numbers a table, whatever the size of the corpus.

Cases: null and empty texts have no words and fail the base rule; texts shorter than an n-gram score 0; without any
trusted text there is no verdict beyond the base rules; repeated rows count and are judged each; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.run import map_texts, quoted, ready, stream
from pulseframe.llm.text import Block, Words, blocks, covered, hash_bytes, hash_runs, sums_by_text, window_starts

GRAM = 3
BITS = 16
THRESHOLD = -0.25
MIN_WORDS = 10
REPEAT_WORDS = 5
REPEAT_PERCENT = 20
_CHUNK = 1024  # buckets that travel in one row
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_STARTS_CHARACTER = (np.arange(256) & 0xC0) != 0x80


def gram_buckets(block: Block, gram: int = GRAM, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of the block's texts, and where each text starts among them (at most 8 bytes a gram)."""
    sizes = np.diff(block.offsets)
    if len(block.data) < gram:
        return np.zeros(0, np.int64), np.zeros(len(block) + 1, np.int64)
    packed = np.zeros(len(block.data) - gram + 1, dtype=np.uint64)
    for k in range(gram):
        packed = (packed << np.uint64(8)) | block.data[k:len(block.data) - gram + 1 + k]
    bucket = ((packed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    inside = np.ones(len(bucket), dtype=bool)
    for back in range(1, gram):  # grams that would reach into the next text
        at = block.offsets[1:] - back
        at = at[(at >= block.offsets[:-1]) & (at < len(inside))]
        inside[at] = False
    many = np.maximum(sizes - gram + 1, 0)
    return bucket[inside], np.append(0, np.cumsum(many))


def gram_counts(docs: DataFrame, text: str = "text", gram: int = GRAM, bits: int = BITS) -> np.ndarray:
    """Counts of all n-grams of all texts by bucket."""

    def count(batches):
        sums = np.zeros(1 << bits, np.int64)
        for block in blocks(batches, "text"):
            sums += np.bincount(gram_buckets(block, gram, bits)[0], minlength=1 << bits)
        if sums.any():
            yield _chunks(sums.reshape(-1, min(_CHUNK, 1 << bits)))

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[chunk] = held.get(chunk, 0) + values.values.to_numpy()
        for chunk, values in held.items():
            yield {"chunk": [chunk], "counts": pa.array([values])}

    picked = docs.select(F.col(quoted(text)).cast("string").alias("text"))
    schema = "chunk int, counts array<long>"
    found = stream(stream(picked, count, schema).repartition(8, "chunk"), add, schema).toArrow()  # one row a chunk
    out = np.zeros((max(1, (1 << bits) // _CHUNK), min(_CHUNK, 1 << bits)), np.int64)
    for chunk, values in zip(found["chunk"].to_pylist(), found["counts"]):
        out[chunk] = values.values.to_numpy()
    return out.ravel()


def _chunks(rows: np.ndarray) -> dict:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
    return {"chunk": np.arange(len(rows)), "counts": lists}


def log_ratio(trusted: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    if not trusted.sum():
        return np.zeros(len(corpus))
    size = len(corpus)
    return (np.log((trusted + 1) / (trusted.sum() + size)) - np.log((corpus + 1) / (corpus.sum() + size)))


def base_counts(block: Block) -> dict[str, np.ndarray]:
    """Counts of words, their characters, symbols, repeated lines and words in repeated five-word windows."""
    words = Words(block)
    n_words = words.counts()
    inside = np.zeros(len(block.data) + 1, dtype=np.int64)
    inside[words.starts] += 1
    inside[words.ends] -= 1
    characters = (np.cumsum(inside[:-1]) > 0) & _STARTS_CHARACTER[block.data]
    doc = words.doc()
    starts = window_starts(words, REPEAT_WORDS)
    keys = hash_runs(words.hashes(), starts, starts + REPEAT_WORDS) ^ (doc[starts].astype(np.uint64) << np.uint64(40))
    again = _repeated(keys)
    marks = covered(starts[again], REPEAT_WORDS, len(words))
    return {"n_words": n_words, "word_chars": sums_by_text(characters, block.offsets),
            "n_symbols": sums_by_text(_SYMBOLS[block.data], block.offsets),
            "n_dup_lines": _repeated_lines(block, words), "n_repeat_words": sums_by_text(marks, words.first)}


def _repeated(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    same = np.zeros(len(keys), dtype=bool)
    equal = sorted_keys[1:] == sorted_keys[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    out = np.zeros(len(keys), dtype=bool)
    out[order] = same
    return out


def _repeated_lines(block: Block, words: Words) -> np.ndarray:
    if not len(words):
        return np.zeros(len(block), np.int64)
    cut = np.unique(np.concatenate([np.flatnonzero(block.data == 0x0A), block.offsets[1:] ]))
    # lines are numbered by the first cut after their words' starts; one at a start is the end of the text before
    line_of = np.searchsorted(cut, words.starts, "right")
    line, first_word = np.unique(line_of, return_index=True)
    before = line - 1
    start = np.where(before >= 0, cut[np.maximum(before, 0)] + (block.data[np.minimum(cut[np.maximum(before, 0)],
                     len(block.data) - 1)] == 0x0A), 0)
    text = words.doc()[first_word]
    start = np.maximum(start, block.offsets[text])
    keys = hash_bytes(block.data, start, cut[line]) ^ (text.astype(np.uint64) << np.uint64(40))
    order = np.argsort(keys, kind="stable")  # stable: the first of equal lines comes first
    again = np.append(False, keys[order][1:] == keys[order][:-1])
    return np.bincount(text[order][again], minlength=len(block))


def llr_quality(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text",
                threshold: float = THRESHOLD, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """Base counts, ``base_failed``, ``llr`` and ``kept`` of every document."""
    spark = ready(docs)
    ratio = log_ratio(gram_counts(trusted, text, gram, bits), gram_counts(docs, text, gram, bits))
    held = spark.sparkContext.broadcast(ratio)

    def judge(block: Block) -> dict:
        found = base_counts(block)
        bucket, first = gram_buckets(block, gram, bits)
        score = sums_by_text(held.value[bucket], first) / np.maximum(np.diff(first), 1)
        failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > REPEAT_PERCENT * found["n_words"])
        return {**found, "base_failed": failed, "llr": score, "kept": ~failed & (score >= threshold)}

    return map_texts(docs, judge, "n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                     "n_repeat_words long, base_failed boolean, llr double, kept boolean", [doc_id], text)


