"""Periodic runs, cross-tokenizer alignment and language, each against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import cases
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loantriad.llm import alignment, language, perfect_hash, runs, whole_ids
from loantriad.llm.bpe import file_text
from loantriad.llm.common import vocabulary_path, words_of

BYTES, PIECES = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
BIG = (1 << 60) + 1


def brute_runs(ws, copies=4, words=6):
    """Every period, every stretch; of those the ones without a smaller period."""
    out = []
    for q in range(1, len(ws) // copies + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            stretch = ws[i:j + q]
            if len(stretch) >= max(words, copies * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=25), st.lists(st.integers(0, 2), min_size=1, max_size=8), st.integers(0, 9)), max_size=4))
def test_runs_equal_brute_force(parts):
    texts = [head + unit * times + head[::-1] for head, unit, times in parts]
    assert runs.batch_runs(texts) == [brute_runs(t) for t in texts]


def test_long_periodic_texts():
    assert runs.batch_runs([["a"] * 200_000]) == [[(0, 200_000, 1)]]
    assert runs.batch_runs([[i % 777 for i in range(100_000)], ["x"] * 5]) == [[(0, 100_000, 777)], []]


def planted(doc_id, text):
    """The contract's rule, word by word."""
    ws = [w.decode() for w in words_of(text)]
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not ws:
        return ws
    g, n = h // 10, len(ws)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]


def expected_runs(doc_id, text):
    ws = planted(doc_id, text)
    found = brute_runs(ws)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha(lines), sha(kept))


def small_docs(spark):
    rows = [(i, t) for i, t, *_ in cases.rows() if not t or len(t) < 20_000]
    rows += [(i, " ".join(f"v{(i * j) % 9}" for j in range(i))) for i in range(20, 120)]
    rows += [(BIG, "a b a b a b a b a b"), (None, "x x x x x x x"), (BIG + 2, "a b a b a b a b a b"), (BIG + 4, "y " * 40)]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, runs string, h string"), rows


def test_periodic_runs_query(spark):
    docs, rows = small_docs(spark)
    got = runs.digests(runs.periodic_runs(runs.with_planted_runs(docs))).collect()
    assert Counter(map(tuple, got)) == Counter(expected_runs(*r) for r in rows)


def test_periodic_runs_texts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.where("length(text) < 2500").select("doc_id", "text").collect()
    got = runs.op11_periodic_runs(spark, folder).collect()
    assert len(got) == docs.count()
    assert {tuple(r) for r in got} >= {expected_runs(*r) for r in rows}


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**32 - 1), max_size=400), st.sets(st.integers(0, 2**32 - 1), max_size=50))
def test_perfect_hash(keys, others):
    arrays = np.array(sorted(keys), np.uint32)
    buckets = perfect_hash.bucket_of(arrays)
    built = [(int(b), *perfect_hash.build(arrays[buckets == b])) for b in np.unique(buckets)]
    table = perfect_hash.PerfectHash(built)
    assert sorted(table.index(arrays).tolist()) == list(range(len(keys)))
    strangers = np.array(sorted(others - keys), np.uint32)
    assert (table.index(strangers) == -1).all()


@pytest.mark.parametrize("as_text", [True, False])
def test_whole_ids_are_the_librarys(as_text):
    whole, draw = whole_ids.WholeTexts(file_text(BYTES), as_text), random.Random(5)
    letters = [chr(i) for i in range(0x260)] + ["  ", " ", "\n", "'s", "'LL", "<|endoftext|>", "a", "7", "你", " ", "😀"] * 20
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 30))) for _ in range(4_000)]
    assert whole.fast is not None
    assert whole.ids(texts) == [e.ids for e in whole.library.encode_batch(texts, add_special_tokens=False)]


def test_piece_words_are_the_librarys():
    with open(PIECES, "rb") as f:
        both = alignment.TwoTokenizers(file_text(BYTES), f.read())
    assert both.apart
    draw = random.Random(7)
    letters = [chr(i) for i in range(0x260)] + [" "] * 200 + ["\n", "the", "é", "▁", "你", "<0x41>", "<s>", "tion"] * 20
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(3_000)]
    plain = [" ".join(t.split()) for t in texts] + ["".join(c for c in t if c < "~") for t in texts]
    for batch in (texts, plain):
        ids = [both.b.encode(t) if t else [] for t in batch]
        same = [b"".join(both.bytes_b[i] for i in x) == (" " + t).encode() for x, t in zip(ids, batch)]
        got_a, got_b = both.tokens(batch)
        assert got_b == [np.array(x, "<u4").tobytes() if t and s else b"" for x, t, s in zip(ids, batch, same)]
        full = [i for i, b in enumerate(got_b) if b]
        for i, e in zip(full, both.a.library.encode_batch([" " + batch[i] for i in full], add_special_tokens=False)):
            assert got_a[i] == np.array(e.ids, "<u4").tobytes()
    assert sum(not both.WHOLE.search(t) for t in plain if t) > 500


def brute_alignment(texts):
    """Byte by byte: which token of either side covers it."""
    with open(PIECES, "rb") as f:
        both = alignment.TwoTokenizers(file_text(BYTES), f.read())
    facts, counts = [], Counter()
    for text in texts:
        a = both.a.library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        if b"".join(both.bytes_b[i] for i in b) != (" " + text).encode() if text else True:
            a, b = [], []
        over_a = [i for i, x in enumerate(a) for _ in both.bytes_a[x]]
        over_b = [i for i, x in enumerate(b) for _ in both.bytes_b[x]]
        links = [(a[i], b[j]) for i, j in sorted(set(zip(over_a, over_b)))]
        groups, x, y = [], [], []
        for k in range(len(over_a)):
            x, y = [*x, over_a[k]], [*y, over_b[k]]
            if k + 1 == len(over_a) or over_a[k + 1] != over_a[k] and over_b[k + 1] != over_b[k]:
                side = lambda at, ids: ",".join(str(ids[i]) for i in dict.fromkeys(at))
                groups.append(f"{side(x, a)}|{side(y, b)}")
                x, y = [], []
        counts.update(set(links))
        facts.append((len(a), len(b), len(groups), links, ";".join(groups)))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    return [(na, nb, ng, len(ls), sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls), gs) for na, nb, ng, ls, gs in facts]


def odd_docs(spark, folder):
    rows = [(i, t) for i, t, *_ in cases.rows() if not t or len(t) < 20_000]
    rows += [(BIG, "some text"), (None, "some text"), (BIG + 2, "two  gaps"), (BIG + 4, "▁ as text <0x41> <unk> <s>"), (8, "\x00\ttab")]
    rows += [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40).collect()]
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, row string"), rows


def test_alignment_equals_brute_force(spark, folder):
    docs, rows = odd_docs(spark, folder)
    expected = Counter((i, *f) for (i, _), f in zip(rows, brute_alignment([t for _, t in rows])))
    assert Counter(map(tuple, alignment.align(docs, BYTES, PIECES).collect())) == expected
    # few keys a segment: several passes, the same rows
    assert Counter(map(tuple, alignment.align(docs, BYTES, PIECES, segment_keys=700).collect())) == expected


def test_alignment_encodes_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    def told(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(i, f"ab cd {i}") for i in range(50)], schema).mapInPandas(told, schema)
    out = alignment.align(docs, BYTES, PIECES)
    assert len(out.collect()) == 50 and read.value == 50
    assert "text" not in alignment.align(docs.select("doc_id", "text"), BYTES, PIECES)._jdf.queryExecution().optimizedPlan().toString()


def test_alignment_digest_and_lists(spark):
    docs = spark.createDataFrame([(1, "ab cd"), (2, None), (3, "")], "doc_id long, text string")
    plain = {r.doc_id: r for r in alignment.align(docs, BYTES, PIECES).collect()}
    hashed = {r.doc_id: r for r in alignment.align(docs, BYTES, PIECES, digest=True).collect()}
    assert hashed[1].groups == hashlib.sha256(plain[1].groups.encode()).hexdigest()
    assert tuple(hashed[2]) == (2, 0, 0, 0, 0, 0, 0, "") and tuple(hashed[3]) == (3, 0, 0, 0, 0, 0, 0, "")
    counts = alignment.PairCounts()
    for part in ([1, 5], [2], [5], [1, 2, 9], [5]):
        counts.add(np.array(part, np.int64), np.ones(len(part), np.int64))
    keys, n = counts.take()
    assert dict(zip(keys.tolist(), n.tolist())) == {1: 2, 2: 2, 5: 3, 9: 1}


def brute_set(text):
    """Runs of up to LONGEST letters of the text with one gap around words."""
    padded = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    codes = f" {' '.join(padded)} " if padded else ""
    return {codes[i:i + n] for n in range(1, language.LONGEST + 1) for i in range(len(codes) - n + 1)}


@pytest.mark.parametrize("text", ["", "...", "a", "Éa  b--c", " x\ny. ", "aaaa bbb", "ÀÉ 你好 w1w"])
def test_runs_of_letters(text):
    marked = np.zeros(language.BUCKETS, bool)
    language.mark(language.letters(text), marked)
    by_hand = np.zeros(language.BUCKETS, bool)
    for gram in brute_set(text):
        one = np.array([ord(c) for c in gram], np.uint64)
        h = np.zeros(1, np.uint64)
        for c in one:
            h = h * np.uint64(0x110001) + c
        by_hand[int(language.mix(h + np.uint64(len(gram) << 56))[0] >> np.uint64(47))] = True
    assert (marked == by_hand).all()


def test_long_texts_are_read_in_pieces(monkeypatch):
    codes, one, two = language.letters("some words of a language " * 50), np.zeros(language.BUCKETS, bool), np.zeros(language.BUCKETS, bool)
    language.mark(codes, one)
    monkeypatch.setattr(language, "PIECE", 37)
    language.mark(codes, two)
    assert (one == two).all()


def test_kernels_are_shares_of_sets():
    texts = ["the cat sat", "the hat", "un chat noir", "123"]
    kernels = language.Kernels(language.Landmarks([language.buckets_of(t) for t in texts[:3]]))
    got = kernels.batch(texts)
    sets = [brute_set(t) for t in texts]
    expected = [[len(a & b) / (len(a) * len(b)) ** 0.5 if a else 0.0 for b in sets[:3]] for a in sets]
    assert np.allclose(got, expected, atol=1e-6)


def test_language_held_out(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = language.op13_language(spark, folder).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null").collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert len(rows) > 50 and right >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_learns_from_allowed_rows_only(spark):
    rows = [(i, "der die das und nicht" if i % 2 else "the of and to in", "de" if i % 2 else "en") for i in range(1, 60)]
    held = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    docs = spark.createDataFrame(held, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == ["de", "en"]
    asked = spark.createDataFrame([(BIG, "das und die"), (None, "the of"), (BIG + 2, None), (BIG + 4, "12 ..."), (5, ""), (5, "")], "doc_id long, text string")
    got = Counter((r.doc_id, r.lang_pred) for r in language.predict(asked, model).collect())
    assert got == Counter({(BIG, "de"): 1, (None, "en"): 1, (BIG + 2, "und"): 1, (BIG + 4, "und"): 1, (5, "und"): 2})
    nothing = language.predict(asked, language.fit(docs.where("lang = 'none'")))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}


def test_awkward_and_empty_tables(spark):
    docs, none = cases.awkward(spark), cases.empty(spark)
    for operator in (lambda d: runs.digests(runs.periodic_runs(runs.with_planted_runs(d))),
                     lambda d: alignment.align(d, BYTES, PIECES, digest=True),
                     lambda d: language.predict(d, language.fit(d))):
        assert operator(docs).count() == len(cases.rows())
        assert operator(none).count() == 0
    same = [r for r in alignment.align(docs.where(F.col("doc_id") == 6), BYTES, PIECES).collect()]
    assert same[0] == same[1]


def test_large_ids_beside_null(spark):
    """Ids that a double cannot hold, in one batch with a null, come out as they went in."""
    from loantriad.llm import bpe, neardup, packing, pages, passages, quality, token_counts, toxicity


    ids = [BIG, BIG + 2, BIG + 4, None]
    shared = " ".join(f"s{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"own{k} {shared}") for k, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), -9.0)
    for found in (toxicity.score(docs, model), passages.digests(docs), quality.quality(docs, no_labels), bpe.digests(docs, BYTES),
                  token_counts.token_counts(docs, BYTES), neardup.near_duplicates(docs), packing.packed_documents(docs),
                  runs.periodic_runs(docs), alignment.align(docs, BYTES, PIECES), language.predict(docs, None)):
        assert Counter(r.doc_id for r in found.collect()) == Counter(ids)
    assert {r.n_removed for r in passages.digests(docs).collect()} == {60}
    html = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.lit("<p>text</p>").alias("html"))
    assert Counter(r.page_id for r in pages.extract(html).collect()) == Counter(ids)


def test_periodic_text_stays_small(spark):
    """One super-k-mer of all windows is split by window."""
    from loantriad.llm import passages

    docs = spark.createDataFrame([(1, "same " * 5_000), (2, "other words only")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in passages.digests(docs, hot=20).collect()}
    assert got == {1: (5_000, 5_000), 2: (3, 0)}


def naive_pack(lengths, capacities):
    """Best fit by looking through all open bins for every piece."""
    from loantriad.llm import packing

    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins, where = [], {}
    for place, i in enumerate(order):
        fitting = [(size - sum(lengths[j] for j in held), b) for b, (size, held) in enumerate(bins) if size - sum(lengths[j] for j in held) >= lengths[i]]
        if fitting:
            b = min(fitting)[1]
        else:
            def price(c):
                beside = sum(lengths[j] for j in order[place + 1:] if lengths[j] <= c - lengths[i])
                return packing.cost(c) / max(min(c, lengths[i] + beside), 1)
            b = len(bins)
            bins.append((min((c for c in sorted(capacities) if c >= lengths[i]), key=price), []))
        where[i] = b, len(bins[b][1]), sum(lengths[j] for j in bins[b][1])
        bins[b][1].append(i)
    final = [min(c for c in capacities if c >= sum(lengths[j] for j in held)) for _, held in bins]
    return [where[i] for i in range(len(lengths))], final


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=40))
def test_packing_equals_naive_packer(lengths):
    from loantriad.llm import packing

    capacities = (8, 16, 32, 64)
    bins, slots, offsets, final = packing.pack(lengths, capacities)
    assert (list(zip(bins.tolist(), slots.tolist(), offsets.tolist())), final) == naive_pack(lengths, capacities)
