"""Token counts by a count-only Viterbi search.

An Aho-Corasick automaton over a unigram vocabulary enumerates every vocabulary piece in a text; dynamic programming
over end positions carries the best score and the number of pieces on that path, never the pieces themselves. The
rules are those of the unigram model of the ``tokenizers`` library behind ``WhitespaceSplit`` and ``Metaspace``
(always prepended): scores add up as doubles from the left; of equal scores at a position the path whose last piece
starts first stays; a character that is no piece of its own may be passed as unknown at the smallest score less
ten; neighbouring unknown characters count as one token.

Words repeat, so every block runs the search on its distinct words only, all of them at once as arrays, and a
worker remembers ``CACHE_WORDS`` of them.

The vocabulary is read from a sentencepiece model file (its normal pieces and their scores). The public file at hand
holds merge ranks as scores; the operator takes any scores as they are.

Cases: null, empty and blank texts have no tokens; a word of any length is searched whole; rows and clashing column
names pass as they are because only the key and the text are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from pulseframe.llm.run import map_texts, ready
from pulseframe.llm.text import Block, hash_bytes, sums_by_text

CACHE_WORDS = 2_000_000
UNKNOWN_PENALTY = 10.0
MARK = "▁"
#: White space beyond one byte, as UTF-8 (fixed values of the Unicode property White_Space).
_WIDE_BLANK = [bytes([0xC2, 0x85]), bytes([0xC2, 0xA0]), bytes([0xE1, 0x9A, 0x80]),
               *(bytes([0xE2, 0x80, b]) for b in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)),
               bytes([0xE2, 0x81, 0x9F]), bytes([0xE3, 0x80, 0x80])]
_WIDE = re.compile(b"|".join(map(re.escape, _WIDE_BLANK)))


@dataclass
class Unigram:
    """Pieces and scores; ``pieces[0]`` is the unknown piece."""

    pieces: list[str]
    scores: list[float]

    @classmethod
    def from_sentencepiece(cls, path: str) -> Unigram:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [i for i in range(model.vocab_size())
                if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        return cls(["<unk>", *(model.id_to_piece(i) for i in kept)], [0.0, *(model.get_score(i) for i in kept)])


class Counter:
    def __init__(self, model: Unigram):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for number, piece in enumerate(model.pieces):
            if piece:
                self.automaton.add_word(piece, number)
        self.automaton.make_automaton()
        self.lengths = np.array([len(p) for p in model.pieces], np.int64)
        self.scores = np.array(model.scores, np.float64)
        self.unknown = min(model.scores, default=0.0) - UNKNOWN_PENALTY
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)

    def count(self, words: list[str]) -> np.ndarray:
        """Number of tokens of each word (none of them empty)."""
        size = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(size) - size
        whole = "".join(words)
        found = [(end, number) for end, number in self.automaton.iter(whole)]
        ends, number = np.array(found, np.int64).reshape(-1, 2).T
        starts = ends - self.lengths[number] + 1
        owner = np.searchsorted(begin, starts, "right") - 1
        inside = ends < begin[owner] + size[owner]  # a match must not reach into the next word
        ends, number, starts, owner = ends[inside], number[inside], starts[inside], owner[inside]
        single = np.zeros(len(whole), dtype=bool)
        single[starts[self.lengths[number] == 1]] = True
        lone = np.flatnonzero(~single)  # characters that are no piece: passed as unknown
        starts, ends = np.append(starts, lone), np.append(ends, lone)
        score = np.append(self.scores[number], np.full(len(lone), self.unknown))
        unknown = np.append(number == 0, np.ones(len(lone), dtype=bool))
        owner = np.append(owner, np.searchsorted(begin, lone, "right") - 1)
        local = ends - begin[owner]
        order = np.lexsort((starts, owner, local))
        starts, ends, score, unknown, local = (a[order] for a in (starts, ends, score, unknown, local))
        # positions before each character; the node before a word's first character is its origin
        best = np.zeros(len(whole) + 1)
        pieces = np.zeros(len(whole) + 1, np.int64)
        open_unknown = np.zeros(len(whole) + 1, dtype=bool)
        origin = np.zeros(len(whole), dtype=bool)
        origin[begin] = True
        head = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))  # one group for each end position
        group_end = ends[head]
        edges = np.searchsorted(local[head], np.arange(int(size.max()) + 1))
        tail = np.append(head[1:], len(ends))
        # node i + 1 stands for "after character i"; a word's origin scores zero and holds no piece
        for step in range(int(size.max())):
            low, high = edges[step], edges[step + 1] if step + 1 < len(edges) else len(head)
            if low == high:
                continue
            a, b = head[low], tail[high - 1]
            fresh = origin[starts[a:b]]
            came = np.where(fresh, 0.0, best[starts[a:b]])
            total = score[a:b] + came
            local_head = head[low:high] - a
            top = np.maximum.reduceat(total, local_head)
            width = np.diff(np.append(local_head, b - a))
            hit = np.flatnonzero(total == np.repeat(top, width))
            pick = hit[np.searchsorted(hit, local_head)]  # the first best, so the earliest start
            node = group_end[low:high] + 1
            old = ~fresh[pick]
            joined = unknown[a:b][pick] & open_unknown[starts[a:b][pick]] & old
            pieces[node] = np.where(old, pieces[starts[a:b][pick]], 0) + 1 - joined
            open_unknown[node] = unknown[a:b][pick]
            best[node] = top
        return pieces[begin + size]

    def texts(self, block: Block) -> np.ndarray:
        """Number of tokens of each text of a block."""
        data = block.data
        white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
        raw = data.tobytes()
        for match in _WIDE.finditer(raw):
            white[match.start():match.end()] = True
        begin, end = ~white, ~white
        begin[1:] &= white[:-1]
        end[:-1] &= white[1:]
        edges = block.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begin[edges] = ~white[edges]
        end[edges - 1] = ~white[edges - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        first = np.searchsorted(starts, block.offsets)
        if not len(starts):
            return np.zeros(len(block), np.int64)
        keys = hash_bytes(data, starts, ends) ^ (hash_bytes(data, starts, ends, 1) << np.uint64(1))
        distinct, sample, which = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        near = at < len(self.keys)
        known[near] = self.keys[at[near]] == distinct[near]
        if not known.all():
            if len(self.keys) > CACHE_WORDS:
                self._clear()
                known[:] = False
            new = np.flatnonzero(~known)
            parts = [_marked(raw[starts[i]:ends[i]].decode("utf-8", "replace")) for i in sample[new]]
            counts = np.add.reduceat(self.count([w for p in parts for w in p]),
                                     np.cumsum([0, *map(len, parts)])[:-1])
            place = np.searchsorted(self.keys, distinct[new])
            self.keys = np.insert(self.keys, place, distinct[new])
            self.counts = np.insert(self.counts, place, counts)
            at = np.searchsorted(self.keys, distinct)
        return sums_by_text(self.counts[at][which], first)


def _marked(word: str) -> list[str]:
    """The word behind one mark; marks that a text itself holds begin words of their own."""
    if MARK not in word:
        return [MARK + word]
    return [MARK + part for part in word.removeprefix(MARK).split(MARK)]


_counters: dict[str, Counter] = {}


def _counter(held) -> Counter:
    """One counter a worker, kept over its tasks."""
    if held.id_ not in _counters:
        _counters.clear()
        model = held.broadcast.value
        _counters[held.id_] = Counter(model)
    return _counters[held.id_]


@dataclass
class _Held:
    broadcast: object
    id_: str


def token_counts(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``n_tokens`` and ``n_bytes`` (UTF-8) of every text."""
    spark = ready(docs)
    held = _Held(spark.sparkContext.broadcast(Unigram.from_sentencepiece(vocabulary_path)), vocabulary_path)

    def count(block: Block) -> dict:
        return {"n_tokens": _counter(held).texts(block), "n_bytes": np.diff(block.offsets)}

    return map_texts(docs, count, "n_tokens long, n_bytes long", [doc_id], text)
