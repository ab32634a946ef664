"""Statistics of whole texts, as one row of numbers a text: what the trained scores look at.

Only the text is read, never ids, labels, languages or sources.
"""

from __future__ import annotations

import numpy as np

from pulseframe.llm.text import Block, Words, hash_runs, sums_by_text, window_starts

NAMES = ["words", "word_length", "word_spread", "symbols", "marks", "commas", "capitals", "capital_words", "digits",
         "pipes", "lines", "distinct", "distinct_pairs", "same_next", "wide", "odd"]

_CLASSES = {
    "symbols": b"#*$%&<>@^~=+{}[]\\/_", "marks": b"!?", "commas": b",.;:", "digits": b"0123456789", "pipes": b"|",
    "capitals": bytes(range(0x41, 0x5B)), "odd": bytes(b for b in range(32) if b not in (9, 10, 13)) + b"\x7f",
}
_TABLES = {name: np.isin(np.arange(256), list(members)) for name, members in _CLASSES.items()}


def _distinct(keys: np.ndarray, text: np.ndarray, count: int) -> np.ndarray:
    tagged = keys + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # one key a (word, text)
    _, first = np.unique(tagged, return_index=True)
    return np.bincount(text[first], minlength=count)


def text_features(block: Block) -> np.ndarray:
    """One row a text; shares are smoothed logits or logarithms, so that no tail dominates."""
    count = len(block)
    words = Words(block)
    n = words.counts()
    text = words.doc()
    size = np.maximum(np.diff(block.offsets), 1)
    some = np.maximum(n, 1)
    length = words.ends - words.starts
    hashes = words.hashes()
    share = {name: sums_by_text(table[block.data], block.offsets) / size for name, table in _TABLES.items()}
    capital_words = sums_by_text(_TABLES["capitals"][block.data[words.starts]], words.first) / some
    pairs = window_starts(words, 2)
    pair_keys = hash_runs(hashes, pairs, pairs + 2)
    same = sums_by_text(np.append(hashes[1:] == hashes[:-1], False)[:len(hashes)], words.first) / some
    mean = sums_by_text(length, words.first) / some
    spread = np.sqrt(np.maximum(sums_by_text(length * length, words.first) / some - mean**2, 0))
    wide = sums_by_text(block.data >= 0x80, block.offsets) / size
    lines = sums_by_text(block.data == 0x0A, block.offsets)

    def logit(p, floor=0.002):
        p = np.clip(p, 0, 1)
        return np.log((p + floor) / (1 - p + floor))

    distinct = _distinct(hashes, text, count) / some
    distinct_pairs = _distinct(pair_keys, text[pairs], count) / np.maximum(n - 1, 1)
    out = [np.log1p(n), np.log1p(mean), np.log1p(spread), logit(share["symbols"]), logit(share["marks"]),
           logit(share["commas"]), logit(share["capitals"]), logit(capital_words), logit(share["digits"]),
           logit(share["pipes"]), np.log1p(lines) - np.log1p(n), logit(distinct), logit(distinct_pairs), logit(same),
           np.minimum(wide, 0.3), logit(share["odd"])]
    return np.stack(out, axis=1)
