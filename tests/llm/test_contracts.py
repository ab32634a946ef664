"""Each operator against its plain version, on the smallest table and on awkward rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from pulseframe.llm import queries
from pulseframe.llm.decontamination import contamination, decontaminate
from pulseframe.llm.license_scan import TEMPLATES, license_scan
from pulseframe.llm.llr_quality import base_counts, llr_quality
from pulseframe.llm.mixing import domain_rates, mix
from pulseframe.llm.personal_data import personal_data
from pulseframe.llm.qda_quality import accepted, quality_scores
from pulseframe.llm.shingle_join import count_links, deduplicate, link_sets, near_duplicates, shingle_sets
from pulseframe.llm.substring_dedup import factors, substring_dedup
from pulseframe.llm.text import text_block
from pulseframe.llm.token_output import SeekableReader, read_documents, token_files, write_token_files

SMALL = "/root/testdata/sf0.001"
END = 2


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def bag(rows):
    return sorted(rows, key=repr)


@pytest.fixture(params=["documents", "awkward"])
def docs(request):
    return request.getfixturevalue(request.param)


def empty(docs):
    return docs.filter("false")


def test_base_rules(docs):
    got = llr_quality(docs, docs)
    assert got.columns[0] == "doc_id"
    assert bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
               for r in got.collect()) == bag((d, *brute.base_rules(t)) for d, t in pairs(docs))
    assert all(r.kept == (not r.base_failed) for r in got.collect())  # the same texts on both sides: ratio 0
    assert llr_quality(empty(docs), empty(docs)).count() == 0
    assert llr_quality(docs, empty(docs)).filter("llr <> 0").count() == 0


def test_repeated_lines_anywhere_in_a_block():
    """A text's count does not depend on the texts before it in its block."""
    texts = ["foo\nbar baz\nfoo", "a b", "a b\n", "", "\n", "foo", "foo\nfoo\nfoo", "\nfoo\nfoo", "x\n \nx\n", "é\né"]
    for first in texts:
        for rest in (texts, texts[::-1]):
            batch = pa.RecordBatch.from_pydict({"text": [first, *rest]})
            found = base_counts(text_block(batch))["n_dup_lines"].tolist()
            assert found == [brute.base_rules(t)[3] for t in (first, *rest)], first


def test_ratio_rejects_junk(spark):
    clean = [(i, f"the quiet river runs past old stone houses and {w} gardens by the mill") for i, w in
             enumerate(["green", "wide", "small", "north", "late"] * 4)]
    junk = [(100 + i, "@@## q0 ~~^^ zz%% 11$$ {{}} q1 ^^~~ \\\\// ==++ q2 <<>>" + str(i)) for i in range(5)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string")
    got = {r.doc_id: r.kept for r in llr_quality(docs, docs.filter("doc_id < 100")).collect()}
    assert all(got[d] for d, _ in clean) and not any(got[d] for d, _ in junk)


def test_licenses(docs):
    got = license_scan(docs)
    assert bag((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got.collect()) == bag(
        (d, *brute.licenses(t)) for d, t in pairs(docs))
    assert license_scan(empty(docs)).count() == 0


def test_license_templates(spark):
    filler = " ".join(f"f{i}" for i in range(300))
    rows = [(1, filler + " " + TEMPLATES["mit"] + " " + filler), (2, TEMPLATES["bsd"].upper()),
            (3, " ".join(TEMPLATES["gpl"].split()[:12])), (4, "MIT License and the GNU General Public License"),
            (5, TEMPLATES["isc"] + filler + TEMPLATES["apache"])]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("mit", 1.0) and got[2] == ("bsd", 1.0) and got[3] == ("", 0.0)
    assert got[4] == ("gpl,mit", 1.0) and got[5][0] == "apache,isc"


def test_license_long_templates(spark):
    """Verbatim templates longer than a block link wherever they begin; short ones keep their narrow blocks."""
    long, middle = ([f"{kind}{i}" for i in range(n)] for kind, n in (("l", 700), ("m", 150)))
    short = [f"s{i}" for i in range(20)]
    templates = {"long": " ".join(long), "middle": " ".join(middle), "short": " ".join(short)}
    filler = [f"f{i}" for i in range(1000)]
    texts = {n: filler[:n] + words + filler[n:2 * n] for n, words in enumerate([long, middle, short] * 5, 40)}
    texts |= {300: filler[:45] + middle, 301: filler[:333] + long + filler, 302: long[:559], 303: long[:560],
              304: [w for s in short for w in [s, *filler[:40]]], 305: filler[:9] + long + middle + short}
    docs = spark.createDataFrame([(n, " ".join(words)) for n, words in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan(docs, templates=templates, phrases={}).collect()}
    want = {n: ["long", "middle", "short"][(n - 40) % 3] for n in range(40, 55)}
    want |= {300: "middle", 301: "long", 302: "", 303: "long", 304: "", 305: "long,middle,short"}
    assert got == want
    none = license_scan(docs, templates={}, phrases={})
    assert {(r.labels, r.score) for r in none.collect()} == {("", 0.0)}


def test_license_join_is_exact(spark):
    """Random blocks around the threshold against plain containment."""
    rng = np.random.default_rng(5)
    templates = {f"t{k}": " ".join(f"v{i}" for i in sorted(rng.choice(60, 20, replace=False))) for k in range(6)}
    texts = [" ".join(f"v{i}" for i in rng.choice(70, int(rng.integers(10, 160)))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan(docs, templates=templates, phrases={}).collect()}
    for i, text in enumerate(texts):
        held = set(text.split())
        want = {n for n, t in templates.items() if len(held & set(t.split())) >= 16}
        assert got[i] == ",".join(sorted(want))


def dedup_rows(docs):
    return bag((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs).collect())


def test_substring_dedup(docs):
    assert dedup_rows(docs.coalesce(1)) == bag(brute.substring_dedup(pairs(docs)))
    assert substring_dedup(empty(docs)).count() == 0


def test_substring_dedup_rows_that_share_ids(spark):
    """Rows of one id are documents of their own: what stands in one of them alone stays."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    for ids in ((1, 2, 2), (2, 2, 1), (None, None, None), (1, None, None), (5, 5, 5)):
        rows = list(zip(ids, (a, a, b)))
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        assert dedup_rows(docs) == bag(brute.substring_dedup(rows)), ids
        assert sum(r[2] for r in dedup_rows(docs)) == 30


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(3, 9), st.integers(1, 2), st.integers(0, 4)), max_size=12))
def test_factors(matches):
    """The parse is greedy, its factors do not overlap, and with the checked matches it covers all matches."""
    start, length, ref, shift = (np.array([m[i] for m in matches], np.int64) for i in range(4))
    starts, ends, crossing = factors(start, length, ref, start + shift)
    assert all(e <= s for e, s in zip(ends, starts[1:]))
    got = {w for s, e in zip(starts, ends) for w in range(s, e)} | {
        w for i in crossing for w in range(start[i], start[i] + length[i])}
    assert got == {w for s, n, *_ in matches for w in range(s, s + n)}

    def longest(at):
        """By words: along each reference and shift, how far the matched words go on from a match that starts here."""
        best = 0
        for key in {(r, d) for s, _, r, d in matches if s == at}:
            words = {w for s, n, r, d in matches if (r, d) == key for w in range(s, s + n)}
            end = at
            while end in words:
                end += 1
            best = max(best, end)
        return best

    at, want = 0, []
    while any(s >= at for s, *_ in matches):
        begin = min(s for s, *_ in matches if s >= at)
        at = longest(begin)
        want.append((begin, at))
    assert list(zip(starts.tolist(), ends.tolist())) == want


def test_substring_dedup_random(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in range(60):
        parts = [rng.integers(0, 50, int(rng.integers(0, 60))) for _ in range(2)]
        if d and rng.random() < 0.7:
            source = rows[int(rng.integers(0, d))][1].split()
            low = int(rng.integers(0, max(1, len(source) - 10)))
            parts.insert(1, np.array([int(w[1:]) for w in source[low:low + int(rng.integers(10, 60))]], int))
        rows.append((d, " ".join(f"w{i}" for p in parts for i in p)))
    rows.append((60, "same word again " * 40))
    want = brute.substring_dedup(rows)
    assert dedup_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == bag(want)


def test_near_duplicates(docs):
    rows = pairs(docs)
    got = near_duplicates(docs).collect()
    want = brute.shingle_components(rows)
    assert bag((r.doc_id, r.n_shingles, r.component_id) for r in got) == bag((d, *w) for (d, _), w in zip(rows, want))
    assert near_duplicates(empty(docs)).count() == 0


@pytest.mark.parametrize("name", ["node", "root", "n_shingles", "stays", "token"])
def test_near_duplicates_with_clashing_names(spark, name):
    """Columns of documents, the id's too, may be called as the operator's own ones."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "a"), (2, text, "b"), (3, "x y z", "c"), (4, None, "d")], f"{name} long, t string, id string")
    got = near_duplicates(docs, name, "t").toDF("a", "b", "c", "d").collect()
    assert bag((r.a, r.c) for r in got) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    kept = deduplicate(docs, name, "t")
    assert kept.columns == docs.columns and bag(r[0] for r in kept.collect()) == [1, 3, 4]
    other = docs.toDF("doc_id", "t", name)
    assert bag(r.doc_id for r in deduplicate(other, "doc_id", "t").collect()) == [1, 3, 4]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[int(rng.integers(0, len(words)))] = f"e{rng.integers(0, 10**6)}"
    return words


def test_near_duplicate_chains(spark):
    """Chains of edits around the threshold, common passages, and small cells that are cut into blocks."""
    rng = np.random.default_rng(8)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for _ in range(12):
        words = [f"w{rng.integers(0, 10**5)}" for _ in range(int(rng.integers(6, 150)))] + common
        for _ in range(int(rng.integers(1, 14))):
            rows.append((len(rows), " ".join(words)))
            words = edited(rng, words, int(rng.integers(0, 5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {d: w for (d, _), w in zip(rows, brute.shingle_components(rows))}
    for options in ({}, {"cell_shingles": 300}, {"region": 0.5}, {"region": 0.05}):
        got = near_duplicates(docs, **options).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want, options


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1, max_size=12), min_size=1, max_size=12))
def test_link_sets(sets):
    """The walk's links give the components of all links."""
    arrays = [np.array(sorted(s), np.uint64) for s in sets]

    def roots(links):
        root = list(range(len(sets)))
        for a, b in links:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
        return root

    every = [(i, j) for i in range(len(sets)) for j in range(i)
             if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    links = link_sets(arrays)
    assert roots(links) == roots(every)
    assert all((max(l), min(l)) in every for l in links)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 14), min_size=1, max_size=12), st.integers(1, 5), st.booleans()),
                min_size=1, max_size=12, unique_by=lambda r: frozenset(r[0])), st.booleans())
def test_count_links(rows, cross):
    sets, copies, side = [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    got, _ = count_links([np.array(sorted(s), np.uint64) for s in sets], copies, side if cross else None)
    assert got.tolist() == [
        sum(n for j, (t, n, b) in enumerate(rows) if i != j and not (cross and a == b)
            and 100 * len(s & t) >= 80 * len(s | t)) for i, (s, _, a) in enumerate(rows)]


def test_number_of_links(spark, awkward):
    """All links of near and exact copies are counted, also in cells that are cut into blocks."""
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(4):
        words = [f"w{rng.integers(0, 10**5)}" for _ in range(120)]
        for _ in range(15):
            rows += [(len(rows) + k, " ".join(edited(rng, words, int(rng.integers(0, 3))))) for k in range(2)]
        rows += [(len(rows) + k, " ".join(words)) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(awkward.select("doc_id", "text")
                                                                         .withColumn("doc_id", awkward.doc_id + 1000))
    texts = docs.collect()
    keys, first = shingle_sets(text_block(pa.RecordBatch.from_pydict({"text": [r.text for r in texts]})))
    sets = [set(keys[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
    want = bag((r.doc_id, sum(100 * len(s & t) >= 80 * len(s | t) for t in sets if t) - 1 if s else 0)
               for r, s in zip(texts, sets))
    for options in ({}, {"cell_shingles": 1500}):
        got = near_duplicates(docs.repartition(3), **options).collect()
        assert bag((r.doc_id, r.n_links) for r in got) == want, options


def contamination_rows(got):
    return bag((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect())


@pytest.mark.parametrize("piece_words", [10**6, 40])
def test_contamination(docs, spark, piece_words):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text")
    more = spark.createDataFrame(
        [(1000, "w1 w2 w3"), (1001, None), (None, "w5 w6"), (1002, " - "), (1003, " ".join(f"w{i}" for i in range(20))),
         (1003, "A b"), (1004, "x")], "item_id long, text string")
    items = benchmark.union(more)
    want = brute.contamination(pairs(docs), [(r.item_id, r.text) for r in items.collect()])
    got = contamination(docs, items, piece_words=piece_words)
    assert contamination_rows(got) == bag((d, *w) for (d, _), w in zip(pairs(docs), want))
    clean = decontaminate(docs, items, piece_words=piece_words)
    assert clean.columns == docs.columns
    assert bag(clean.collect()) == bag(r for r, w in zip(docs.collect(), want) if not w[-1])


def test_contamination_empty(docs, spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs, nothing).filter("contaminated or n_hit > 0").count() == 0
    assert contamination(empty(docs), nothing).count() == 0


def test_longest_match(spark):
    docs = spark.createDataFrame([(1, "zz " + " ".join(f"w{i}" for i in range(5, 38)) + " zz")], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string")
    row = contamination(docs, items).first()
    assert (row.n_words, row.n_hit, row.longest, row.contaminated) == (35, 33, 33, True)


PII = ["mail a.b@c.de, x@y no @z.de a@b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 1..2.3.4",
       "card 4111 1111 1111 1111 and 4111-1111-1111-1112; 1234", "+49 (30) 1234-567. +1 2 +123456789012345678",
       "é\U0001f600 a@b.cd", None, "", "9" * 20000, "a" * 20000 + "@", "1-1 " * 3000, "+1+1+22222222", "a@b.c.d@e.f.g"]


def test_personal_data(docs):
    got = personal_data(docs)
    assert bag((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got.collect()) == bag(
        (d, *brute.personal(t)) for d, t in pairs(docs))
    assert personal_data(empty(docs)).count() == 0


def test_personal_data_cases(spark):
    rows = list(enumerate(PII))
    got = personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got.collect()} == {
        d: brute.personal(t) for d, t in rows}


def test_personal_data_random(spark):
    rng = np.random.default_rng(1)
    signs = list("01259 .-+()@ab.%_:é")
    rows = [(i, "".join(rng.choice(signs, int(rng.integers(0, 120))))) for i in range(400)]
    got = personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got.collect()} == {
        d: brute.personal(t) for d, t in rows}


def test_zero_octets(spark):
    rows = list(enumerate(["10.0.0.1", "1.2.3.0", "00.1.1.1", "0.0.0.0 and 127.0.0.1, 256.0.0.1 000.0000.255.010", "0.0.0.256"]))
    got = personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_ip for r in got} == {0: 1, 1: 1, 2: 1, 3: 3, 4: 0}
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got} == {
        d: brute.personal(t) for d, t in rows}


def test_added_kinds(spark):
    rows = [(1, "iban: GB82 WEST 1234 5698 7654 32 ok"), (2, "GB82WEST12345698765433"), (3, 'token = "24be64439e3e49cf46b2d7"'),
            (4, "social security 123-45-6789"), (5, "123-45-6789")]
    got = {r.doc_id: r.spans for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].startswith("iban:6:33") and "iban" not in got[2] and got[3].startswith("secret:0:")
    assert got[4] == "ssn:16:27" and got[5] == ""


def test_account_numbers_end_by_country(spark):
    """What follows a number, or precedes it, does not hide it."""
    german, norwegian = "DE89 3704 0044 0532 0130 00", "NO9386011117947"
    rows = [(1, f"IBAN {german} BIC COBADEFFXXX"), (2, "DE89370400440532013000 2024"), (3, f"{norwegian} {german} EUR"),
            (4, f"BE71 {german[:14]} {german}"), (5, "DE89370400440532013001 2024"), (6, "DE89370400440532013000X"),
            (7, f"REF ZZ12 AB CD EF {german} EUR"), (8, f"BE71 {german}")]
    got = {r.doc_id: r.spans for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: [s for s in spans.split(",") if s.startswith("iban")] for d, spans in got.items()} == {
        1: ["iban:5:32"], 2: ["iban:0:22"], 3: ["iban:0:15", "iban:16:43"], 4: ["iban:20:47"], 5: [], 6: [],
        7: ["iban:18:45"], 8: ["iban:5:32"]}


def test_context_is_equally_wide_everywhere(spark):
    """A context word counts up to 48 characters behind a span, at a text's start as in its middle."""
    number = "123-45-6789"
    rows = []
    for i, (before, gap) in enumerate((b, g) for b in ("", "x " * 30) for g in (30, 47, 70)):
        rows.append((i, f"{before}{number}{' ' * gap}security"))
    rows.append((6, "security" + " " * 40 + number))
    got = {r.doc_id: r.spans for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [bool(got[i]) for i in range(7)] == [True, False, False, True, False, False, True]


def test_many_spans_in_one_text(spark):
    """Places of matches over several runs."""
    text = " ".join(f"{'é' * (i % 3)} u{i}@h{i}.org +1 (2{i % 10}) 345-{1000 + i}" for i in range(300))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = personal_data(docs).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone, row.base_sha256) == brute.personal(text)


def test_long_secrets_are_whole(spark):
    rows = [(n, f"token={'aB3-_.x9' * n} end") for n in (2, 16, 17, 125, 5000)]
    got = {r.doc_id: r.spans for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: [s for s in spans.split(",") if s.startswith("secret")] for d, spans in got.items()} == {
        n: [f"secret:0:{6 + 8 * n}"] for n, _ in rows}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))


def encoded(tokenizer, texts):
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, END], "<u4") for t in texts]


def test_token_files(docs, tokenizer):
    rows = pairs(docs)
    ids = encoded(tokenizer, [t for _, t in rows])
    got = token_files(docs, queries.tokenizer_path("byte_bpe_50k.json"), END, shard_bytes=100_000).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    assert bag((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == bag(
        (d, len(i), zlib.crc32(i.tobytes())) for (d, _), i in zip(rows, ids))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert token_files(empty(docs), queries.tokenizer_path("byte_bpe_50k.json"), END).count() == 0


def test_pieces(spark, tokenizer):
    """White space of all kinds, special strings and odd characters."""
    rng = np.random.default_rng(4)
    signs = [" ", " ", "\n", "\t", "\r", "\x0b", " ", "　", "\x85", "\x1c", "a", "b", "'s", "'ll", "é", "ß", "日", "1",
             "!", "<|endoftext|>", "\U0001f600", " ", "x", "́"]
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 60)))) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids_crc32 for r in token_files(docs, queries.tokenizer_path("byte_bpe_50k.json"), END).collect()}
    assert got == {d: zlib.crc32(i.tobytes()) for d, i in enumerate(encoded(tokenizer, texts))}


def test_random_access(spark, tokenizer, tmp_path):
    import zstandard
    texts = [f"text number {i} " * (i * 50) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files = write_token_files(docs, f"file://{tmp_path}", queries.tokenizer_path("byte_bpe_50k.json"), END).collect()
    ids = encoded(tokenizer, texts)
    seen = 0
    for row in files:
        with open(row.path, "rb") as source:
            raw = source.read()
        for place, found in enumerate(read_documents(row.path, list(range(row.n_docs)))):
            assert (found == ids[seen + place]).all()
        whole = b"".join(i.tobytes() for i in ids[seen:seen + row.n_docs])
        assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(raw) == whole
        seen += row.n_docs
        import pyarrow.fs as pafs
        with pafs.LocalFileSystem().open_input_file(row.path) as source:
            reader = SeekableReader(source)
            reader.document(1)
            assert reader.frames_read == 1 or len(reader.table) == 1
        damaged = tmp_path / "damaged.zst"
        damaged.write_bytes(raw[:40] + bytes([raw[40] ^ 1]) + raw[41:])
        with pytest.raises((ValueError, zstandard.ZstdError)):
            read_documents(str(damaged), [0])
    assert seen == len(texts)


def test_quality_scores(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scores = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    held = [(scores[d].predicted, q) for d, q in marks.items() if d in scores and scores[d].held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in scores.items())
    assert sum(p == q for p, q in held) / len(held) > 0.93
    kept = accepted(docs, labels)
    assert bag(r.doc_id for r in kept.select("doc_id").collect()) == bag(d for d, r in scores.items() if r.predicted)
    assert kept.columns == docs.columns


def test_quality_awkward(awkward, spark):
    labels = spark.createDataFrame([(1, 1), (6, 0), (8, 0), (11, 1), (None, 1), (99, 0), (2, None), (9, 1), (7, 0)],
                                   "doc_id long, quality int")
    rows = quality_scores(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert [r.score for r in quality_scores(awkward, labels.filter("false")).collect()] == [0.5] * len(rows)
    assert {r.score for r in quality_scores(awkward, labels.filter("quality = 1")).collect()} == {1.0}
    assert quality_scores(empty(awkward), labels).count() == 0


def test_mixing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rates, model, fitted = domain_rates(docs, labels, queries.domain(), queries.TARGETS)
    rows = rates.collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 for r in rows)
    assert all(abs(sum(r.posteriors) - 1) < 1e-9 for r in rows)
    tokens = np.array([r.n_tokens for r in rows])
    p, rate = np.array([r.posteriors for r in rows]), np.array([r.rate for r in rows])
    reached = (rate * tokens) @ p / tokens.sum()
    assert np.abs(reached - [queries.TARGETS[d] for d in model.domains]).max() < 0.01
    again = np.ones(len(rows))
    assert np.allclose(fitted.replay(p)[0], rate) and not np.allclose(rate, again)


def _dense_rates(p, tokens, wanted, pull):
    """Least squares rates by Newton steps on the few multipliers, on whole arrays: r = max(0, 1 - p @ m / pull)."""
    weight = tokens.sum() / (tokens.sum() * ((p * tokens[:, None]).T @ p).diagonal())

    def fault(m):
        rate = np.maximum(0, 1 - p @ m / pull)
        return rate, m - weight * ((rate * tokens) @ p - wanted)

    m = np.zeros(len(wanted))
    for _ in range(200):
        rate, off = fault(m)
        active = p * ((rate > 0) * tokens)[:, None]
        move = np.linalg.solve(np.eye(len(m)) + weight[:, None] * (active.T @ p) / pull, off)
        share = 1.0
        while share > 1e-6 and np.abs(fault(m - share * move)[1]).max() > np.abs(off).max():
            share /= 2
        m = m - share * move
    assert np.abs(fault(m)[1]).max() < 1e-9
    return fault(m)[0]


@pytest.mark.parametrize("targets", [(0.2, 0.5, 0.3), (0.0, 0.02, 0.98), (1.0, 0.0, 0.0)])
def test_mixing_is_the_least_squares_answer(spark, monkeypatch, targets):
    """Against a dense solver on the same posteriors; where the targets cannot be met the many passes skip Spark."""
    from pulseframe.llm import mixing
    from pulseframe.llm.mixing import PULL, fit_rates
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.5, 0.5, 0.5], 200)
    tokens = rng.integers(0, 500, 200)
    members = spark.createDataFrame([(int(t), q.tolist()) for t, q in zip(tokens, p)], "n_tokens long, posteriors array<double>")
    if min(targets) == 0:
        monkeypatch.setattr(mixing, "_totals", lambda members, size, cells, add: np.array(add(tokens, p)))
    rates, wanted, reached = fit_rates(members.coalesce(1), np.array(targets), 0.0, 1e-9)
    want = _dense_rates(p, tokens, wanted, PULL)
    some = tokens > 0
    assert np.abs(rates.replay(p)[0] - want)[some].max() < 1e-3
    assert np.allclose(reached, (want * tokens) @ p, atol=1e-4 * tokens.sum())


def test_mixing_needs_all_targets(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    with pytest.raises(ValueError, match="toxic1"):
        domain_rates(docs, labels, queries.toxic_domain(), {"toxic0": 1.0})


def test_mixing_tells_missed_targets(spark, caplog, monkeypatch):
    """Every domain's residual is logged, those beyond the tolerance as warnings."""
    from pulseframe.llm import mixing
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(mixing, "fit_rates", lambda members, goal: (
        mixing.Rates(), goal / goal.sum() * 1e6, goal / goal.sum() * 1e6 + np.arange(len(goal)) * 150.0))
    with caplog.at_level("INFO", "pulseframe.llm.mixing"):
        _, model, _ = domain_rates(docs, labels, queries.toxic_domain(), queries.TOXIC_TARGETS)
    found = [(r.levelname, r.args[0], round(r.args[3])) for r in caplog.records if r.name == "pulseframe.llm.mixing"]
    assert found == [("INFO", "toxic0", 0), ("WARNING", "toxic1", 150)] and model.domains == ["toxic0", "toxic1"]


def test_mixing_awkward(awkward, spark):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (8, 0, 1), (11, 1, 0), (None, 1, 0), (99, 0, 0), (2, None, 0)],
                                   "doc_id long, quality int, toxic int")
    for some in (labels, labels.filter("false")):
        rates, _, _ = domain_rates(awkward, some, queries.domain(), queries.TARGETS)
        assert rates.count() == awkward.count()
        mixed = mix(awkward, some, queries.domain(), queries.TARGETS)
        assert mixed.columns == awkward.columns
        assert mixed.subtract(awkward).count() == 0
    assert bag(mix(awkward, labels.filter("false"), queries.domain(), queries.TARGETS).collect()) == bag(awkward.collect())
    assert mix(empty(awkward), labels, queries.domain(), queries.TARGETS).count() == 0


def test_deduplicate(docs):
    rows = docs.collect()
    want = brute.shingle_components([(r.doc_id, r.text) for r in rows])
    got = deduplicate(docs)
    assert got.columns == docs.columns
    kept, seen = [], set()
    for r, (size, component) in sorted(zip(rows, want), key=lambda p: (p[0].doc_id is None, p[0].doc_id or 0)):
        if not size or component not in seen:
            kept.append(r)
        if size:
            seen.add(component)
    assert bag(got.collect()) == bag(kept)
    assert deduplicate(empty(docs)).count() == 0
