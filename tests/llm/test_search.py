"""Lexical search, exact shards and hard negatives against plain versions."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from pulseframe.llm import queries
from pulseframe.llm.exact_shards import Matrix, hypergeometric, shard_documents, shard_sizes, split_counts, write_shards
from pulseframe.llm.hard_negatives import Clusters, Rows, hard_negatives, integer_vectors, walk
from pulseframe.llm.lexical_search import Segment, matched_bounds, search
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def bag(rows):
    return sorted(map(tuple, rows), key=repr)


# lexical search

def items_of(spark):
    return spark.createDataFrame(
        [(1, "w1 w2 w3 W1 the tail"), (2, None), (None, "a B"), (3, ""), (4, "é 日本 x x"), (4, "é 日本 x x"), (5, "none of it q9"),
         (6, "line one w39")], "item_id long, text string")


def test_search_awkward(spark, awkward):
    items = items_of(spark)
    docs = awkward.withColumns({"rank": F.lit("r"), "score": F.lit(1), "query": F.lit(2), "item": F.lit(0)})
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute.ranked(rows, [(r.item_id, r.text) for r in items.collect()], k=3)
    for options in ({}, {"block_terms": 4}, {"segment_bytes": 100}):
        got = search(docs, items, k=3, **options)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert bag(got.collect()) == bag(want), options
    assert search(docs.filter("false"), items).count() == 0
    assert search(docs, items.filter("false")).count() == 0
    assert search(docs, items.filter("text is null")).count() == 0


def test_search_table(spark, documents):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = bag(brute.ranked(rows, [(r.item_id, r.text) for r in items.collect()]))
    assert bag(queries.op11_lexical_search(spark, SMALL).collect()) == want
    many = documents.repartition(7)
    assert bag(search(many, items, segment_bytes=20_000).collect()) == want


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_segment_keeps_the_best(data):
    """The walk returns every document that belongs to the best k above the floor, with its whole score."""
    n_docs, n_terms = data.draw(st.integers(1, 12)), data.draw(st.integers(1, 6))
    impact = np.array(data.draw(st.lists(st.integers(0, 9), min_size=n_docs * n_terms, max_size=n_docs * n_terms)))
    impact = impact.reshape(n_terms, n_docs)
    weights = np.array(sorted(data.draw(st.lists(st.integers(0, 5), min_size=n_terms, max_size=n_terms))), np.int64)
    held = np.flatnonzero(impact.any(axis=1))
    lists = [np.flatnonzero(impact[t]) for t in held]
    pairs = [i for i in range(n_terms - 1) if impact[i].any() and impact[i + 1].any()]
    both = [np.flatnonzero((impact[i] > 0) & (impact[i + 1] > 0)) for i in pairs]
    whole = weights[:, None] * impact
    row = {"ids": np.arange(n_docs), "terms": held, "starts": np.cumsum([0, *map(len, lists)]),
           "docs": np.concatenate([*lists, np.zeros(0, int)]).astype(int),
           "impacts": np.concatenate([*(impact[t][d] for t, d in zip(held, lists)), np.zeros(0, int)]).astype(int),
           "peaks": impact[held].max(axis=1) if len(held) else np.zeros(0, int), "pairs": np.array(pairs, int),
           "pair_starts": np.cumsum([0, *map(len, both)]),
           "pair_docs": np.concatenate([*both, np.zeros(0, int)]).astype(int),
           "pair_peaks": np.array([(whole[i] + whole[i + 1])[d].max(initial=0) for i, d in zip(pairs, both)], int)}
    k, floor = data.draw(st.integers(1, 4)), data.draw(st.integers(1, 60))
    docs, scores = Segment(row, weights, n_terms - 1).rank(np.arange(n_terms), np.arange(n_terms - 1), floor, k)
    total = whole.sum(axis=0)
    assert (total[docs] == scores).all()
    least = max(floor, sorted(total)[-k] if n_docs >= k else floor)
    assert set(np.flatnonzero(total >= least)) <= set(docs)


def test_pairs_tighten_bounds():
    assert matched_bounds([5, 6, 7], [6, 8])[0] == [0, 5, 6, 13]
    assert matched_bounds([5, 6, 7], [11, 13])[0] == [0, 5, 11, 18]


# exact shards

def test_shards_awkward(spark, awkward):
    docs = awkward.withColumns({"shard": F.lit("x"), "row": F.lit(1), "part": F.lit(2), "doc": F.lit(3), "Slot": F.lit(4)})
    got = shard_documents(docs.repartition(3), 5)
    assert got.columns == [c for c in docs.columns if c not in ("shard", "Slot")] + ["shard", "slot"]
    rows = got.collect()
    assert bag((r.doc_id, r.text, r.n_words) for r in rows) == bag((r.doc_id, r.text, r.n_words) for r in docs.collect())
    sizes = Counter(r.shard for r in rows)
    assert [sizes[s] for s in range(5)] == shard_sizes(len(rows), 5).tolist()
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert shard_documents(docs.filter("false"), 5).count() == 0
    assert sorted(r.shard for r in shard_documents(docs.limit(3), 40).collect()) == [0, 1, 2]


def test_shards_table(spark, documents, tmp_path):
    got = queries.op12_exact_shards(spark, SMALL).collect()
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (
        len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode()), "rows", None) for r in got)
    assert Counter(r.shard for r in got) == dict(enumerate(shard_sizes(len(texts), 40).tolist()))
    one, two = (shard_documents(documents, 7, seed=3) for _ in range(2))
    assert bag(one.select("doc_id", "shard", "slot").collect()) == bag(two.select("doc_id", "shard", "slot").collect())
    write_shards(one, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert bag(back.select("doc_id", "shard", "slot").collect()) == bag(one.select("doc_id", "shard", "slot").collect())


def test_shards_are_uniform():
    """Each row reaches each shard equally often, and any two rows share one as often as chance has it."""
    blocks, sizes, shards = np.array([5, 0, 1, 7, 3]), shard_sizes(16, 4), []
    for seed in range(3000):
        matrix = Matrix(blocks, sizes, seed)
        rows = [matrix.row(b) for b in range(5)]
        assert [r.sum() for r in rows] == blocks.tolist() and (sum(rows) == sizes).all()
        shards.append(np.concatenate([matrix.deal(b, 2)[0] for b in range(5)]))
    shards = np.array(shards)
    for s in range(4):
        assert np.abs((shards == s).mean(axis=0) - 0.25).max() < 0.04
    together = np.mean(shards[:, :, None] == shards[:, None, :], axis=0)[~np.eye(16, dtype=bool)]
    assert np.abs(together - 3 / 15).max() < 0.04


def test_large_draws():
    random = np.random.default_rng(5)
    drawn = [hypergeometric(random, 30_000_000_000, 70_000_000_000, 1_000_000) for _ in range(300)]
    assert abs(np.mean(drawn) - 300_000) < 120 and 300 < np.std(drawn) < 620
    counts = np.full(40, 2_500_000_000, np.int64)
    half = split_counts(random, counts, 50_000_000_000)
    assert half.sum() == 50_000_000_000 and np.abs(half - 1_250_000_000).max() < 300_000
    blocks = np.full(8, 400_000_000)
    matrix = Matrix(blocks, shard_sizes(3_200_000_000, 6), 1)
    rows = [matrix.row(b) for b in range(8)]
    assert matrix.drawn and (sum(rows) == shard_sizes(3_200_000_000, 6)).all()


# hard negatives

def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, row string, score int")


def test_hard_negatives_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.1], 1), (0, [0.5, 0.1], 1), (100, [0.5, 0.1], 1), (7, [0.4, 0.2], 0), (8, [0.4, 0.1], 1), (9, None, 1),
            (10, [0.4, None], 1), (11, [nan, 0.1], 2), (12, [inf, 0.1], 2), (13, [0.4, 0.1], None), (None, [0.4, 0.1], 1),
            (None, [0.4, 0.1], 3), (15, [0.4, 0.1], 3), (15, [0.4, 0.1], 3), (16, [0.4], 4), (17, [], 5), (200, [0.0, 0.0], 1),
            (300, [-0.5, -0.1], 1), (18, [0.45, 0.1], 2), (19, [0.0, 0.0], 7), (-100, [0.3, 0.3], 2)]
    table = vectors_of(spark, [(*r, "x", 1) for r in rows]).repartition(3)
    got = hard_negatives(integer_vectors(table, "vec_id", label(), "embedding"), F.col("id") % 100 == 0)
    assert bag(got.collect()) == bag(brute.hard_negatives(rows))
    none = integer_vectors(table.filter("false"), "vec_id", label(), "embedding")
    assert hard_negatives(none, F.col("id") % 100 == 0).count() == 0


def label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize("block", [1 << 15, 3])
def test_hard_negatives_random(spark, block):
    random = np.random.default_rng(4)
    centres = random.normal(0, 0.3, (5, 8))
    rows = [(i, (centres[i % 5] + random.normal(0, 0.1, 8)).astype(np.float32).tolist(), int(random.integers(0, 10)))
            for i in range(900)]
    table = vectors_of(spark, [(*r, "x", 1) for r in rows]).repartition(4)
    got = hard_negatives(integer_vectors(table, "vec_id", label(), "embedding"), F.col("id") % 100 == 0, block=block)
    assert bag(got.collect()) == bag(brute.hard_negatives(rows))


def test_walks_end_early():
    """Members stop before the end of a list that holds nothing more for them."""
    import pyarrow as pa
    random = np.random.default_rng(6)
    make = lambda centre, n, low: Rows(pa.table({
        "row": np.arange(low, low + n), "id": np.arange(low, low + n), "label": np.zeros(n, np.int64),
        "vector": [np.round(centre + random.normal(0, 4, 16)).astype(np.int64) for _ in range(n)]}), 16)
    near, far = np.full(16, 40.0), np.concatenate([np.full(8, 40.0), np.full(8, -40.0)])
    anchors, rows = make(near, 20, 0), make(far, 5000, 100)
    done = walk(anchors, Clusters(anchors), rows, np.full(20, 20_000.0), lambda *_: None)
    assert done == 0
    done = walk(anchors, Clusters(anchors), rows, np.full(20, -np.inf), lambda *_: None)
    assert done == 20 * 5000
