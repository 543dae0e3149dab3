"""BPE, token files, counts and packing against brute force and round trips."""

import random
import zlib

import numpy as np
import pytest
from cases import awkward, empty, rows
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from loantriad.llm import bpe, common, packing, token_counts, token_files
from loantriad.llm.common import table, vocabulary_path
from loantriad.session import scratch_path

PATH = vocabulary_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.file_text(PATH))


def texts():
    rng = random.Random(5)
    letters = "abcdeéthinge 's.\n\t 你1 2,!'ll \x1c"
    fixed = ["", " ", "  a  b\n\n c", "it's 'll 'd don't   x", "<|endoftext|> a<|endoftext|>", "\tab\n", "a b \x1cx\x1c y", "aaaa" * 300, "x \n y"]
    return fixed + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(1_500)]


@pytest.mark.parametrize("kind", ["trie", "library"])
def test_ids_equal_the_library(library, vocabulary, kind):
    chunks = bpe.trie_chunks(vocabulary) if kind == "trie" else token_files.library_chunks(library)
    encoder, table_of = bpe.ChunkEncoder(vocabulary.special, chunks), bpe.byte_table(vocabulary)
    for text, packed in zip(texts(), encoder.batch(texts())):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids, text
        assert bpe.decode(np.array(ids), table_of) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, vocabulary, text):
    text = text.encode("utf-8", "replace").decode()
    encoder = bpe.ChunkEncoder(vocabulary.special, bpe.trie_chunks(vocabulary))
    assert np.frombuffer(encoder.batch([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", [bpe.ChunkEncoder, bpe.ChunkCounter])
def test_a_batch_holds_the_chunks_of_few_texts(monkeypatch, kind):
    monkeypatch.setattr(common, "BATCH_CHARS", 50)
    asked = []

    def encode(chunks):
        asked.append(sum(map(len, chunks)))
        return [len(c) if kind is bpe.ChunkCounter else c.encode() for c in chunks]

    lines = [None, "", *(f"a{i} b{i} c{i}" for i in range(200)), "long " * 40, "end"]
    got = kind({}, encode).batch(lines)
    assert got == [(len if kind is bpe.ChunkCounter else str.encode)(t or "") for t in lines]
    assert len(asked) > 30 and max(asked) <= 200


def test_small_cache_starts_anew(monkeypatch, library, vocabulary):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    encoder = bpe.ChunkEncoder(vocabulary.special, bpe.trie_chunks(vocabulary))
    for text in ("a b c d e f", "f g a b <|endoftext|> c"):
        assert np.frombuffer(encoder.batch([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_plain_words_need_no_pattern(monkeypatch, library, vocabulary):
    class Pattern:
        def findall(self, text):
            raise AssertionError(text)

    monkeypatch.setattr(bpe, "_PRE", Pattern())
    text = "Plain words need no pattern"
    packed, = bpe.ChunkEncoder(vocabulary.special, bpe.trie_chunks(vocabulary)).batch([text])
    assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_codec_on_awkward_rows(spark, library):
    out = {(r.doc_id, r.n_tokens): r for r in bpe.encode(awkward(spark), PATH).collect()}
    for i, text, *_ in rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = out[i, len(ids)]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.digests(empty(spark), PATH).count() == 0


def test_token_files_round_trip(spark, folder, library):
    docs = awkward(spark).unionByName(table(spark, folder, "documents"), allowMissingColumns=True)
    path = scratch_path(spark, "ids")
    token_files.write(docs, path, PATH)
    found = token_files.read(spark, path).orderBy("start").collect()
    expected = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.select("doc_id", "text").collect()))
    at = 0
    for r, (doc_id, text) in zip(found, expected, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        assert (r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids) == (doc_id, at, len(ids), ids)
        at += len(ids)
    sums = {(r.start): r.ids_crc32 for r in token_files.checksums(token_files.read(spark, path)).collect()}
    assert all(sums[r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in found)
    few = token_files.read(spark, path, [9, 11])
    assert sorted(r.doc_id for r in few.where("doc_id >= 0").collect() if r.doc_id in (9, 11)).count(9) >= 1
    assert {r.start for r in few.collect()} == {r.start for r in found if r.doc_id in (9, 11)}


def test_token_files_of_nothing(spark):
    path = scratch_path(spark, "ids")
    token_files.write(empty(spark), path, PATH)
    assert token_files.read(spark, path).count() == 0


def greedy(word, initial, continuing):
    at, n, pieces = 0, 0, initial
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n, pieces = end, n + 1, continuing
    return n


def test_counts_equal_greedy_pieces():
    rng = random.Random(3)
    draw = lambda n: bytes(rng.choice(b"abc") for _ in range(n))
    for _ in range(500):
        first, rest = ({draw(rng.randint(1, 4)) for _ in range(8)} for _ in range(2))
        both, one = token_counts.Automaton(first, rest), token_counts.Automaton(first)
        for _ in range(20):
            word = draw(rng.randint(0, 12))
            assert both.count(word) == greedy(word, first, rest)
            assert one.count(word) == greedy(word, first, first)


def test_counts_of_rows(spark, folder):
    pieces = set(token_counts.byte_pieces(bpe.file_text(PATH)))
    docs = awkward(spark).unionByName(table(spark, folder, "documents").limit(30), allowMissingColumns=True)
    expected = []
    for r in docs.select("doc_id", "text").collect():
        words = (r.text or "").encode().split()
        expected.append((r.doc_id or -1, len(words), sum(greedy(b" " + w, pieces, pieces) if len(w) < 200 else 0 for w in words)))
    found = [(r.doc_id or -1, r.n_words, r.n_tokens) for r in token_counts.token_counts(docs, PATH).collect()]
    assert sorted(x for x in found if x[0] != 9) == sorted(x for x in expected if x[0] != 9)
    assert token_counts.token_counts(empty(spark), PATH).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 64), min_size=1, max_size=80))
def test_packing_holds_everything(lengths):
    bins, slots, offsets, final = packing.pack(lengths, (8, 16, 32, 64))
    for b, capacity in enumerate(final):
        inside = np.flatnonzero(bins == b)
        inside = inside[np.argsort(slots[inside])]
        used = 0
        for place, i in enumerate(inside):
            assert slots[i] == place and offsets[i] == used
            used += lengths[i]
        assert used <= capacity and not any(used <= c < capacity for c in (8, 16, 32, 64))


def test_packing_is_tight():
    lengths = np.random.default_rng(1).lognormal(6, 1, 4_000).astype(int) % 8_192 + 1
    final = packing.pack(lengths)[3]
    assert lengths.sum() / sum(final) > 0.97


def test_packing_of_rows(spark):
    docs = spark.createDataFrame([(1, 0), (2, None), (3, 8), (4, 20), (4, 20), (5, 3), (None, 9)], "doc_id long, n_tokens long")
    out = packing.best_fit(docs.selectExpr("*", "'x' as bin", "1 as `group`"), (4, 8), group_rows=2).toPandas()
    total = out["length"].groupby(out["doc_id"].fillna(-1)).sum().to_dict()
    assert total == {1: 0, 2: 0, 3: 8, 4: 40, 5: 3, -1: 9}
    for _, b in out.groupby("bin"):
        b = b.sort_values("slot")
        assert b["length"].sum() <= b["capacity"].iloc[0] and (b["bin_offset"] == b["length"].cumsum() - b["length"]).all()
    assert packing.best_fit(docs.limit(0)).count() == 0
    assert packing.packed_documents(empty(spark)).count() == 0
    assert packing.packed_documents(awkward(spark)).select("doc_id").distinct().count() == len({i for i, *_ in rows()})


def test_packed_lengths_are_the_token_files(spark, folder, library):
    """Every text's pieces hold all ids of the tokenizer and the end id: white space and line breaks count."""
    docs = awkward(spark).select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts())], "doc_id long, text string"))
    docs = docs.unionByName(table(spark, folder, "documents").selectExpr("doc_id + 10000 as doc_id", "text")).where("doc_id is not null")
    expected = {}
    for r in docs.collect():
        expected[r.doc_id] = expected.get(r.doc_id, 0) + len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert {r[0]: r[1] for r in packing.packed_documents(docs).groupBy("doc_id").sum("length").collect()} == expected
