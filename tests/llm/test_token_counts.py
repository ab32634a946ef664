"""Counts against the tokenizer itself, and the defined cases."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

import public_tokenizers
from pulseframe.llm.text import text_block
from pulseframe.llm.token_counts import Counter, Unigram, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = Unigram.from_sentencepiece(PATH)


def tokenizer(model):
    made = Tokenizer(models.Unigram(list(zip(model.pieces, model.scores)), unk_id=0, byte_fallback=False))
    made.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
    return made


REFERENCE = tokenizer(MODEL)
COUNTER = Counter(MODEL)


def counts(counter, texts):
    block = text_block(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]))
    return counter.texts(block).tolist()


def wanted(reference, texts):
    return [len(reference.encode(t, add_special_tokens=False).ids) for t in texts]


CASES = ["", " ", "hello", "the cat sat\non the mat", "x" * 3000, " a b　c", "日本語 текст", "<unk> <unk><unk>a",
         "▁▁ a▁b", "é è ça", "\U0001f600\U0001f600a\U0001f600", "a\x1cb\x85c", "in in in"]


def test_cases():
    assert counts(COUNTER, CASES) == wanted(REFERENCE, CASES)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_random(texts):
    assert counts(COUNTER, texts) == wanted(REFERENCE, texts)


TIES = Unigram(["<unk>", "a", "b", "ab", "ba", "aba", "▁", "▁a", "bb"],
               [0.0, -1.0, -1.0, -2.0, -2.0, -3.0, -1.0, -2.0, -2.0])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abz \n", max_size=30), max_size=6))
def test_ties(texts):
    assert counts(Counter(TIES), texts) == wanted(tokenizer(TIES), texts)


def test_table(spark):
    rows = [(1, "a cat", 5), (1, "a cat", 5), (None, None, 6), (3, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts(docs, PATH).collect())
    assert got == [(0, 0), (1, wanted(REFERENCE, ["a cat"])[0]), (1, wanted(REFERENCE, ["a cat"])[0]), (3, 0)]
    assert token_counts(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_given_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, PATH).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert got == dict(zip([r.doc_id for r in rows], wanted(REFERENCE, [r.text for r in rows])))
