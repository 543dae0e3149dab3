"""Quality, toxicity, passages, near duplicates, pages and search against brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from cases import PASSAGE, awkward, empty, labels, rows
from pyspark.sql import functions as F

from loantriad.llm import neardup, pages, passages, quality, topk, toxicity
from loantriad.llm.catalog import CORPUS_CHECKS, CORPUS_QUERIES
from loantriad.llm.common import table
from loantriad.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con(folder):
    from compare import connect

    return connect(folder)


@pytest.mark.parametrize("name", sorted(CORPUS_CHECKS))
def test_matches_sql(spark, folder, con, name):
    from compare import differ

    assert differ(name, spark, folder, CORPUS_QUERIES, CORPUS_CHECKS, con) is None


# --- quality ---------------------------------------------------------------------------------------------------------


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def spark_hash(*parts):
    """The engine's xxhash64 of strings: each part's hash seeds the next."""
    h = 42
    for part in parts:
        h = xxhash.xxh64_intdigest(part.encode(), seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def brute_quality(docs, good, buckets=quality.BUCKETS):
    import regex

    token = regex.compile(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+")
    grams = []
    for _, text in docs:
        w = token.findall(text or "")
        grams.append([spark_hash(x) % buckets for x in w] + [spark_hash(x, y) % buckets for x, y in zip(w, w[1:])])
    raw, target = Counter(), Counter()
    for (doc_id, _), g in zip(docs, grams):
        raw.update(g)
        if doc_id in good:
            target.update(g)
    share = sum(target.values()) / max(sum(raw.values()), 1)
    out = []
    for (doc_id, text), g in zip(docs, grams):
        n, chars, symbols, lines, repeats = base_counts(text)
        llr = sum(round(math.log((target[b] + quality.PRIOR) / (raw[b] * share + quality.PRIOR)) * quality.SCALE) for b in g) / quality.SCALE / max(len(g), 1)
        failed = n < 50 or 100 * repeats > 50 * n
        out.append((doc_id, n, chars, symbols, lines, repeats, failed, round(llr, 5), not failed and llr >= quality.THRESHOLD))
    return out


def test_quality_brute_force(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    good = {r.doc_id for r in table(spark, folder, "labels").where("quality = 1").collect()}
    expected = brute_quality([(r.doc_id, r.text) for r in docs.collect()], good)
    got = CORPUS_QUERIES["op5_quality_rules"](spark, folder).collect()
    assert sorted((*r[:7], round(r.llr, 5), r.kept) for r in got) == sorted(expected)


def test_quality_counts_every_ngram_apart(spark, folder, monkeypatch):
    """One row per distinct n-gram however many there are; ratios looked up by shuffle and by broadcast agree."""
    many = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i * 1_000, i * 1_000 + 1_000))) for i in range(30)], "doc_id long, text string")
    ratios = quality.log_ratios(many, many.limit(0).select("doc_id"))
    assert ratios.count() == 30 * (1_000 + 999)
    monkeypatch.setattr(quality, "FREQUENT", 64)
    docs, labels_ = table(spark, folder, "documents"), table(spark, folder, "labels")
    assert 0 < quality.log_ratios(docs, labels_.where("quality = 1")).where("frequent").count() <= 64
    good = {r.doc_id for r in labels_.where("quality = 1").collect()}
    expected = brute_quality([(r.doc_id, r.text) for r in docs.collect()], good)
    assert sorted((*r[:7], round(r.llr, 5), r.kept) for r in quality.quality(docs, labels_).collect()) == sorted(expected)


def test_quality_awkward(spark):
    got = quality.quality(awkward(spark), labels(spark)).collect()
    expected = sorted((i if i is not None else -1, *base_counts(t)) for i, t, *_ in rows() if i != 8)
    assert sorted((r.doc_id if r.doc_id is not None else -1, *r[1:6]) for r in got if r.doc_id != 8) == expected
    assert quality.quality(empty(spark), labels(spark)).count() == 0
    bare = quality.quality(awkward(spark), labels(spark).limit(0)).collect()
    assert all(r.llr == 0 and r.kept == (not r.base_failed) for r in bare)


def test_quality_keeps_clean_and_drops_junk(spark):
    folder = "/root/testdata/sf0.01"
    got = quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    marks = table(spark, folder, "labels").select("doc_id", "quality")
    seen = {(r[0], r[1]): r[2] for r in got.where("not base_failed").join(marks, "doc_id").groupBy("quality", "kept").count().collect()}
    assert seen.get((1, False), 0) == 0 and seen.get((0, True), 0) <= 0.1 * seen[0, False]


# --- toxicity --------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    got = CORPUS_QUERIES["op1_toxicity"](spark, folder).join(table(spark, folder, "labels"), "doc_id").where("held_out").collect()
    true = sum(r.predicted and r.toxic for r in got)
    assert true / sum(r.toxic for r in got) > 0.85
    assert true / max(1, sum(r.predicted for r in got)) > 0.95


def test_toxicity_finds_the_sentence_and_ignores_held_out_labels(spark):
    clean = [(i, f"Good day number {i}. All is fine here.\nNothing bad at all") for i in range(200)]
    bad = [(i, f"Good day number {i}. You total zorgwort!\nNothing bad at all") for i in range(200, 260)]
    docs = spark.createDataFrame(clean + bad, "doc_id long, text string").withColumn("toxic", F.lit(7))
    marks = spark.createDataFrame([(i, int(i >= 200)) for i in range(260)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.train_rows(docs, marks))
    for r in toxicity.score(docs, model).collect():
        assert r.predicted == (r.doc_id >= 200)
        if r.predicted:
            text = dict(clean + bad)[r.doc_id]
            assert [text[o.start:o.end].strip() for o in r.offending] == ["You total zorgwort"]
    held = marks.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.fit(toxicity.train_rows(docs, held))
    assert other.bias == model.bias and (other.weights == model.weights).all()
    assert {r.doc_id for r in docs.where(toxicity.fold(F.col("doc_id")) == 2).collect()} == {i for i in range(260) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_toxicity_noisy_or():
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), -2.0)
    score, parts = toxicity.Scorer(model).document("One. Two! Three")
    s = 1 / (1 + math.exp(2))
    assert score == pytest.approx(1 - (1 - s) ** 3) and [("One. Two! Three"[a:b]).strip() for a, b, _ in parts] == ["One", "Two", "Three"]


def test_toxicity_learns_from_whole_texts():
    text = "Some plain words of a long clean text here. " * 1_000 + "Then the offence."
    ids, sizes = toxicity._bag(text)
    assert len(sizes) == 1_001 and toxicity.features("offence") <= set(ids[-sizes[-1]:])


def test_toxicity_awkward(spark):
    got = toxicity.toxicity(awkward(spark), labels(spark)).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(empty(spark), labels(spark)).count() == 0
    assert all(r.score == 0 for r in toxicity.toxicity(awkward(spark), labels(spark).limit(0)).collect())


# --- passages --------------------------------------------------------------------------------------------------------


def brute_passages(texts, width):
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i:i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - width + 1) if count[tuple(w[i:i + width])] > 1 for j in range(i, i + width)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_passages_brute_force(spark, hot):
    rng = random.Random(hot)
    base = [rng.choice("abcdef") for _ in range(60)]
    texts = [None, "", "a b"] + [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += [" ".join(["x"] * n) for n in (3, 6, 7, 30)] + ["\n".join(base), "z ".join(base), " ".join(base[:30]) + " q", " ".join(base)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[1:]) for r in passages.digests(docs, width=6, run=3, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_passages(texts, 6)


def test_passages_join_alike_at_every_size_and_free_their_shuffles(spark, monkeypatch):
    plans, freed, real = [], [], passages.materialise

    def noted(df, name, **how):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        freed.append(how.get("free"))
        return real(df, name, **how)

    monkeypatch.setattr(passages, "materialise", noted)
    out = passages.digests(awkward(spark))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 6 and all(freed)
    assert not any("BroadcastHashJoin" in p for p in plans) and sum(p.count("SortMergeJoin") for p in plans) >= 4


def test_passages_awkward(spark):
    got = sorted(((r.doc_id if r.doc_id is not None else -1), *r[1:]) for r in passages.digests(awkward(spark)).collect())
    expected = brute_passages([t for _, t, *_ in rows()], 35)
    assert got == sorted(((i if i is not None else -1), *e) for (i, *_), e in zip(rows(), expected))
    assert passages.digests(empty(spark)).count() == 0
    docs = awkward(spark)
    cut = passages.remove_passages(docs)
    assert cut.columns == docs.columns and dict(cut.dtypes) == dict(docs.dtypes)
    texts = {r.doc_id: r for r in cut.collect()}
    assert texts[10].text == "one two" and texts[10].n_chars == 7 and texts[10].mark == "clash"
    assert texts[11].text == "" and texts[4].text == " \t\n\r " and texts[2].text is None
    assert PASSAGE not in "".join(r.text or "" for r in texts.values())


# --- near duplicates -------------------------------------------------------------------------------------------------


def brute_near(docs, percent):
    sets = []
    for _, text in docs:
        w = [x.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for x in WORD.findall(text or "")]
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted((d, len(sets[i]), least[top(i)], d == least[top(i)]) for i, (d, _) in enumerate(docs))


def near_cases(seed):
    """Chains, stars around a text that isn't the least, exact copies and unrelated texts."""
    rng = random.Random(seed)
    docs = []
    for _ in range(6):
        base = [f"t{rng.randint(0, 5000)}" for _ in range(rng.randint(40, 120))]
        chain = list(base)
        for _ in range(8):
            star = list(base)
            for _ in range(rng.randint(0, 2)):
                star[rng.randrange(len(star))] = "changed" + str(rng.randint(0, 99))
            docs.append(" ".join(star))
            chain[rng.randrange(len(chain))] = "moved" + str(rng.randint(0, 99))
            docs.append(" ".join(chain).upper() if rng.random() < 0.2 else " ".join(chain))
        docs += [" ".join(base)] * 3
    docs += ["", None, "one", "ONE", "a b c", " \t"]
    rng.shuffle(docs)
    return list(enumerate(docs, 100))


@pytest.mark.parametrize(("percent", "block"), [(80, 64), (85, 3)])
def test_near_duplicates_brute_force(spark, monkeypatch, percent, block):
    monkeypatch.setattr(neardup.block_links, "__defaults__", (block,))
    docs = near_cases(percent)
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent)
    assert sorted(map(tuple, got.collect())) == brute_near(docs, percent)


def test_near_duplicates_awkward(spark):
    got = neardup.near_duplicates(awkward(spark)).collect()
    assert len(got) == len(rows())
    ids = {r.doc_id: r.component_id for r in got}
    assert ids[5] == ids[6] == 5 and ids[13] == ids[14] == 13 and ids[2] == 2 and ids[3] == 3 and ids[4] == 4
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50, 90)] + [(1, 7), (3, 7), (3, 3)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**{i: 50 for i in range(50, 91)}, 1: 1, 3: 1, 7: 1}


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_sketch_loses_less_than_the_bands(similarity):
    """Exact: places that differ are binomial, each puts two balls into the bits, the odd bits are a Markov chain."""
    k, bits = neardup.BANDS * neardup.ROWS, np.arange(neardup.SKETCH_BITS + 1)
    left_out, odd, lost = bits > neardup.most_different_bits(similarity), (bits == 0).astype(float), 0.0
    for m in range(k + 1):
        lost += math.comb(k, m) * (1 - similarity) ** m * similarity ** (k - m) * odd[left_out].sum()
        for _ in range(2):
            up, down = odd * (1 - bits / neardup.SKETCH_BITS), odd * bits / neardup.SKETCH_BITS
            odd = np.append(0, up[:-1]) + np.append(down[1:], 0)
    assert lost < (1 - similarity ** neardup.ROWS) ** neardup.BANDS


def test_odd_sketch_distance_follows_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 1_000).astype(np.uint64)
    for similarity in (0.6, 0.8, 0.9):
        shared = int(1_000 * 2 * similarity / (1 + similarity))
        b = np.concatenate([a[:shared], rng.integers(0, 1 << 63, 1_000 - shared).astype(np.uint64)])
        bits = [np.unpackbits(neardup.odd_sketch(neardup.min_hashes(x))) for x in (a, b)]
        apart = int((bits[0] ^ bits[1]).sum())
        k = neardup.BANDS * neardup.ROWS
        guess = 1 + neardup.SKETCH_BITS / (4 * k) * math.log(1 - 2 * apart / neardup.SKETCH_BITS)
        assert abs(guess - similarity) < 0.12


# --- pages -----------------------------------------------------------------------------------------------------------

PAGES = [
    (None, ""), ("", ""), ("<p>x", "x"), ("<body>text only", "text only"), ("<div class=sidebar>only", ""),
    ("<p>plain &lt;b&gt; &amp;amp; x &eacute;&#233;</p>", "plain <b> &amp; x éé"),
    ("<html><body><div id=menu><a href=1>a</a></div><div><p>One two three, four.</p><p>Five <i>six</i>\n seven<br>eight</p></div><form>z</form></body>",
     "One two three, four.\n\nFive six seven eight"),
    ("<nav>n</nav><article><h1>T</h1><p>a<p>b<div class='cookie-notice'>c</div><ul><li>d<li>e</ul></article><footer>f</footer>", "T\n\na\n\nb\n\nd\n\ne"),
    ("<article><p>long text here, really long text</p><section id=comments><p>a much longer reader comment than the text itself</p></section></article>",
     "long text here, really long text"),
    ("<main><script>var a='<p>no</p>';</script><p>yes</p><!-- <p>no</p> --><style>p{}</style></main>", "yes"),
    ("<article>" + "<div>" * 3_000 + "deep" + "</div>" * 3_000 + "</article>", "deep"),
    ("<p>cut off <a href='x", "cut off"),
]


@pytest.mark.parametrize(("html", "text"), PAGES[:-1])
def test_main_text(html, text):
    assert pages.main_text(html) == text


def test_long_article_outweighs_unnamed_parts():
    links = "<div>" + "".join(f"<a href={i}>link {i}</a> " for i in range(40)) + "</div>"
    body = "".join(f"<p>{'word ' * 60}end {i}.</p>" for i in range(5))
    text = pages.main_text(f"<body>{links}<div>{body}</div>{links}</body>")
    assert "link 3" not in text and text.count("end") == 5


LONG = ("A long paragraph of running text, with several clauses, that says something about the matter at hand and goes on for a while. " * 4).strip()


@pytest.mark.parametrize("frame", ["article", "main", "div"])
@pytest.mark.parametrize("inside", [True, False])
def test_lists_of_links_without_telling_names_go(frame, inside):
    links = "<div><ul>" + "".join(f"<li><a href='/{i}'>Another story number {i}</a></li>" for i in range(20)) + "</ul></div>"
    side = "<section><p><a href='/a'>First link here</a></p><p><a href='/b'>Second link here</a></p><p><a href='/c'>Third</a> x</p></section>"
    body = f"<h2><a href='/self'>Heading as a link</a></h2>" + f"<p>{LONG}</p>" * 2 + (links + side if inside else "") + f"<p>{LONG} <a href='/s'>source</a></p><p>Short end.</p>"
    html = f"<body>{'' if inside else links}<{frame}>{body}</{frame}>{'' if inside else side}</body>"
    want = ["Heading as a link", LONG, LONG, LONG + " source", "Short end."]
    assert pages.main_text(html).split("\n\n") == want


def plain_density(node, ratio):
    """Counts, density and density sum of a node straight from the definition, by looking through everything below it."""
    def below(n):
        for p in n.parts:
            if not isinstance(p, str) and not p.left:
                yield p
                yield from below(p)

    def chars(n):
        return sum(len("".join(p.split())) if isinstance(p, str) else 0 if p.left else chars(p) for p in n.parts)

    def link_chars(n):
        return chars(n) if n.tag == "a" else sum(link_chars(p) for p in n.parts if not isinstance(p, str) and not p.left)

    def density(n):
        c, t = chars(n), max(sum(1 for _ in below(n)), 1)
        lc, lt = max(link_chars(n), 1), max(sum(1 for b in below(n) if b.tag == "a"), 1)
        base = math.log(c / max(c - link_chars(n), 1) * lc + ratio * c + math.e) if c else 0
        return 0.0 if not c else c / t * math.log(max(c / lc * t / lt, 1e-9)) / math.log(base) if base > 1.0000001 else c / t

    def total(n):
        return sum(density(p) if p.tag in pages.BLOCK else total(p) for p in n.parts if not isinstance(p, str) and not p.left)

    return chars(node), density(node), total(node)


def test_density_equals_its_definition_on_random_trees():
    rnd = random.Random(4)

    def grow(deep):
        if deep == 0 or rnd.random() < 0.3:
            return rnd.choice(["", " ", "word", "two words", "x" * rnd.randint(1, 80)])
        tag = rnd.choice(["div", "section", "span", "b", "a", "ul", "nav"])
        return f"<{tag}>" + "".join(grow(deep - 1) for _ in range(rnd.randint(0, 4))) + f"</{tag}>"

    for _ in range(150):
        builder = pages.TreeBuilder()
        builder.feed("<body>" + "".join(grow(4) for _ in range(3)) + "</body>")
        builder.close()
        nodes = pages.measure(builder.root)
        ratio = builder.root.link_chars / max(builder.root.chars, 1)
        for n in nodes:
            c, d, t = plain_density(n, ratio)
            assert n.chars == c and n.density == pytest.approx(d) and n.total == pytest.approx(t)


def test_deep_unclosed_inline_tags_take_linear_time():
    start = time.perf_counter()
    assert pages.main_text("<body><p>" + "<font>x " * 20_000).startswith("x x")
    assert time.perf_counter() - start < 10


def test_pages_of_rows(spark, folder):
    frame = table(spark, folder, "pages").select("*", F.lit("clash").alias("text"), F.lit(1).alias("n_chars"))
    got = {r.page_id: r for r in pages.extract(frame).collect()}
    for r in frame.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer|$)", r.html, re.S).group(1)
        import html as plain

        parts = [" ".join(plain.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        expected = "\n\n".join(x for x in parts if x)
        assert got[r.page_id].text == expected and got[r.page_id].n_chars == len(expected) and got[r.page_id].url == r.url
    assert pages.extract(frame.limit(0)).count() == 0


# --- search ----------------------------------------------------------------------------------------------------------


def brute_top(vectors, asked, k):
    out = []
    for q in asked:
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [3, 40, 10**8])
def test_search_brute_force(spark, scale):
    rng = random.Random(scale)
    vectors = {i: [rng.randint(-scale, scale) for _ in range(6)] for i in range(0, 600, 2)}
    vectors |= {i: [1, 2, 3, 4, 5, 6] for i in range(1_001, 1_201)} | {i: [rng.randint(-9, 9)] * 2 for i in range(2_000, 2_030)} | {3_000: [7, 7, 7], 3_020: []}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, v array<long>")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, shard_rows=60, leaf=8)
    assert sorted(map(tuple, got.collect())) == brute_top(vectors, [i for i in vectors if i % 20 == 0], 5)


def test_search_visits_few_shards_of_clustered_vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 12))
    x = (centres[rng.integers(30, size=3_000)] * 400 + rng.normal(size=(3_000, 12)) * 8).astype(int)
    x[:1_000] = x[0] + rng.integers(-2, 3, size=(1_000, 12))  # one ball holds a third of all rows
    vectors = {i: [int(e) for e in v] for i, v in enumerate(x)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, v array<long>")
    dealt = topk.deal(df, F.col("vec_id") % 20 == 0, shard_rows=50)
    shards = sum(int(c.subs.sum()) for c in dealt[1].values())
    best, rounds = topk._search(dealt, 5, 16)
    assert dealt[0].groupBy("shard").count().agg(F.max("count")).first()[0] < 150
    got = np.array(sorted(map(tuple, best.collect())))
    scores = x @ x.T
    for q in range(0, 3_000, 20):
        order = np.lexsort((np.arange(3_000), -scores[q]))
        want = [i for i in order[:6] if i != q][:5]
        assert got[got[:, 0] == q][:, 2].tolist() == want
    assert sum(r.count() for r in rounds) < 0.35 * 150 * shards


def test_search_awkward(spark):
    rows_ = [(0, [0.5, -0.5]), (0, [0.5, -0.5]), (1, [1.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
             (None, [1.0, 1.0]), (6, [0.25, 0.0]), (20, [1.0])]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("shard"), F.lit(2).alias("v"), F.lit(3).alias("asked"))
    got = topk.top_k(topk.whole_vectors(df), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 6, 512), (0, 2, 1, 0)]
    assert topk.top_k(topk.whole_vectors(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


def test_search_of_check_table(spark, folder):
    got = CORPUS_QUERIES["op3_exact_top_k"](spark, folder).toPandas()
    again = topk.top_k(topk.whole_vectors(table(spark, folder, "embeddings")), F.col("vec_id") % 20 == 0, shard_rows=50, leaf=4).toPandas()
    order = ["query_id", "rank"]
    assert got.sort_values(order, ignore_index=True).equals(again.sort_values(order, ignore_index=True))
    assert got["query_id"].nunique() == 25
