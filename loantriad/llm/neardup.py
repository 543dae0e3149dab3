"""Near duplicates: MinHash bands propose, odd sketches sift, whole shingle sets decide.

1. Every text becomes its words (A-Z in lower case), a digest of them, the number of distinct shingles, ``BANDS`` keys
   made of ``ROWS`` minimum hashes each, and an odd sketch: all minimum hashes folded into a bitmap of parities. Texts
   with the same words are one class, represented by its least doc_id.
2. Representatives meet in the buckets of their band keys. Each bucket compares its members with its least one (a star,
   never all pairs); links found join components. Buckets that hold several components compare their members once more
   with one that a hash chooses, another in every band.
3. Buckets that still hold several components are compared in full, in blocks of ``BLOCK`` members, each pair of
   blocks together. The bucket's largest component is not compared with itself: its blocks meet the others' only, so
   large groups of copies stay small. A pair of blocks is compared by products of 0/1 matrices of their
   shingles and hands on one link less than it has members, at most. The same set of members in several bands is
   compared once.

In both steps two texts whose sizes rule the similarity out, or whose odd sketches differ by so much that the similarity
lies ``SLACK`` below the threshold, are left; all others are decided on their whole sets of shingles. At a similarity
of 0.8 a pair is missed by bands and sketch together with a probability of 7.1e-10 (bands alone 7.0e-10), at 0.85 of 1.7e-13 (1.5e-13).

Defined results: a text without words (null, empty, white space) is linked with nothing and is its own component; rows
with the same words are linked whatever their ids; repeated rows get equal results; a doc_id on different texts gets each
text's own component; a row without doc_id gets the component of equal texts, else none, and is kept; an empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from loantriad.llm.common import WordHashes, beside, mix, table, window_hashes, words_of
from loantriad.llm.components import components
from loantriad.llm.registry import corpus_query
from loantriad.session import materialise

SHINGLE = 5
BANDS, ROWS = 40, 4
SKETCH_BITS = 512
SLACK = 0.3
BLOCK = 512
COLUMNS = 4_096

_U = np.uint64
_SALTS = mix(np.arange(1, BANDS * ROWS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
_PLACES = (np.arange(BANDS * ROWS, dtype=_U) + _U(1)) * _U(0xC2B2AE3D27D4EB4F)


def lower_words(text: str | None) -> list[bytes]:
    """``bytes.lower`` changes A-Z only."""
    return [w.lower() for w in words_of(text)]


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """Distinct shingles of a text's word hashes; a short text is one shingle."""
    return np.unique(window_hashes(h, min(SHINGLE, len(h)))) if len(h) else np.empty(0, _U)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least of each of the BANDS * ROWS scrambles of the set."""
    low = np.full(len(_SALTS), np.iinfo(_U).max, _U)
    for at in range(0, len(shingles), 512):
        part = shingles[at:at + 512]
        x = (part[:, None] ^ _SALTS[None, :]) * _U(0xD6E8FEB86659FD93)
        x ^= x >> _U(32)
        np.minimum(low, x.min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=_U)
    for column in low.reshape(BANDS, ROWS).T:
        keys = mix(keys * _U(0x9E3779B97F4A7C15) + column)
    return keys


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Bit i is the parity of how many (place, minimum hash) pairs fall on i."""
    at = (mix(low + _PLACES) % _U(SKETCH_BITS)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)


def most_different_bits(threshold: float) -> float:
    """Expected odd-sketch distance of a pair SLACK below the threshold; more means leave it."""
    k = BANDS * ROWS
    differ = 2 * k * (1 - max(0.0, threshold - SLACK))
    return SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differ)


def _signatures():
    hashes = WordHashes()

    def run(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        digests, sizes, bands, sketches = [], [], [], []
        for text in frame["text"]:
            words = lower_words(text)
            if not words:
                digests.append(None)
                sizes.append(0)
                bands.append(None)
                sketches.append(None)
                continue
            shingles = shingle_hashes(hashes.of(words))
            low = min_hashes(shingles)
            digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
            sizes.append(len(shingles))
            bands.append(band_keys(low).view(np.int64))
            sketches.append(odd_sketch(low).tobytes())
        yield pd.DataFrame({"digest": digests, "n_shingles": sizes, "bands": bands, "sketch": sketches})

    return run


def signatures(docs: DataFrame) -> DataFrame:
    return beside(docs, ["doc_id"], ["text"], _signatures, "digest binary, n_shingles long, bands array<long>, sketch binary")


def _bits(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


def _worth(size_a, size_b, bits_a: np.ndarray, bits_b: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (broadcast) that sizes and sketches don't rule out."""
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    apart = np.bitwise_count(bits_a ^ bits_b).sum(axis=-1)
    return (100 * small >= percent * large) & (apart <= most_different_bits(percent / 100))


def linked(a: set, b: set, percent: int) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def shingle_set(text: str | None) -> set:
    """The shingles themselves, so that a link rests on words rather than hashes."""
    w = lower_words(text)
    if len(w) < SHINGLE:
        return {tuple(w)} if w else set()
    return set(zip(*[w[i:] for i in range(SHINGLE)]))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of the classes in ``wanted`` (id, doc_id, digest); a doc_id on several texts is told by the digest."""

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = [hashlib.blake2b(b" ".join(lower_words(t)), digest_size=16).digest() == d for t, d in zip(frame["text"], frame["digest"])]
            yield frame.loc[keep, ["id", "text"]]

    return docs.select("doc_id", "text").join(wanted, "doc_id").select("id", "text", "digest").mapInPandas(
        own, "id long, text string").dropDuplicates(["id"])


def star_links(reps: DataFrame, texts: DataFrame, rows: DataFrame, percent: int, drawn: bool = False) -> DataFrame:
    """Links (a, b) of bucket members with one of their bucket: the least, or the one that a hash draws.

    ``rows``: key, id in shared buckets.
    """
    one = F.min_by("id", F.xxhash64("key", "id")) if drawn else F.min("id")
    least = materialise(rows.groupBy("key").agg(one.alias("lead")), "leads")
    pairs = rows.join(least, "key").where("id <> lead").select("id", "lead").distinct()
    facts = reps.select("id", "n_shingles", "sketch")
    sized = (pairs.join(facts, "id")
             .join(facts.select(F.col("id").alias("lead"), F.col("n_shingles").alias("lead_n"), F.col("sketch").alias("lead_sketch")), "lead"))
    close = materialise(sized.where(_worth_column(percent)).select("id", "lead"), "star-pairs")

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = {}
            keep = []
            for lead, x, y in zip(frame["lead"], frame["lead_text"], frame["text"]):
                if lead not in sets:
                    sets = {lead: shingle_set(x)}
                keep.append(linked(sets[lead], shingle_set(y), percent))
            yield frame.loc[keep, ["a", "b"]]

    with_text = close.join(texts, "id").join(
        texts.select(F.col("id").alias("lead"), F.col("text").alias("lead_text")), "lead")
    return with_text.select("lead", "text", "lead_text", F.col("lead").alias("a"), F.col("id").alias("b")).mapInPandas(decide, "a long, b long")


def _worth_column(percent: int):
    """``_worth`` for columns n_shingles, sketch, lead_n, lead_sketch."""
    sizes = 100 * F.least("n_shingles", "lead_n") >= percent * F.greatest("n_shingles", "lead_n")
    words = SKETCH_BITS // 64
    part = lambda c, i: F.conv(F.hex(F.substring(c, 8 * i + 1, 8)), 16, -10).cast("long")
    apart = sum(F.bit_count(part("sketch", i).bitwiseXOR(part("lead_sketch", i))) for i in range(words))
    return sizes & (apart <= most_different_bits(percent / 100))


def open_buckets(rows: DataFrame, found: DataFrame) -> DataFrame:
    """key, id, component of the buckets that hold several components; equal buckets once."""
    labelled = materialise(rows.join(found, "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("component")), "labelled")
    # the same members in several bands are one bucket
    buckets = labelled.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.min("id").alias("first"),
        F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("sum"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(20,0)")).alias("sum2"))
    buckets = buckets.where("low < high").groupBy("n", "first", "sum", "sum2").agg(F.min("key").alias("key")).select("key")
    return labelled.join(materialise(buckets, "open-buckets"), "key")


def _dealt_blocks(members: DataFrame, block: int) -> DataFrame:
    """key, id, component, own, i, j: a row for each pair of blocks (i, j) in which a member takes part.

    Blocks from 0 on hold the bucket's largest component, those below 0 the rest.
    """
    parts = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"))
    sized = members.join(materialise(sizes, "bucket-sizes"), "key")
    main = F.ceil(F.col("n_main") / block).cast("int")
    rest = F.ceil((F.col("n_all") - F.col("n_main")) / block).cast("int")
    inside = F.col("component") == F.col("main")
    own = F.when(inside, F.pmod(F.xxhash64("id", F.lit(7)), main)).otherwise(-1 - F.pmod(F.xxhash64("id", F.lit(7)), rest)).cast("int")
    others = F.sequence(-rest, F.when(inside, F.lit(-1)).otherwise(main - 1))
    return sized.select("key", "id", "component", own.alias("own"), F.explode(others).alias("other")).select(
        "key", "id", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _common(shingles: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a block's shingle sets: products of 0/1 matrices, some columns at a time."""
    n = len(shingles)
    owner = np.repeat(np.arange(n), [len(s) for s in shingles])
    _, column, counts = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
    shared = counts > 1  # a shingle of one text only is in no intersection
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((n, n), np.float32)
    width = int(shared.sum())
    for low in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((n, min(COLUMNS, width - low)), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        total += part @ part.T
    return total


def _compare(ids, component, own, crossing, sizes, bits, texts, percent: int, hashes: WordHashes, links: list) -> None:
    """Links between the members of one pair of blocks, a spanning forest of them at most."""
    worth = np.zeros((len(ids), len(ids)), bool)
    for x in range(len(ids) - 1):
        worth[x, x + 1:] = _worth(sizes[x], sizes[x + 1:], bits[x], bits[x + 1:], percent)
    worth &= component[:, None] != component[None, :]
    if crossing:  # pairs inside a block belong to the block's own turn
        worth &= own[:, None] != own[None, :]
    if not worth.any():
        return
    if len(ids) > 4:
        used = np.flatnonzero(worth.any(axis=0) | worth.any(axis=1))
        both = _common([shingle_hashes(hashes.of(lower_words(texts[x]))) for x in used])
        union = sizes[used][:, None] + sizes[used][None, :] - both
        worth[np.ix_(used, used)] &= 100 * both >= percent * union
    sets: dict[int, set] = {}
    root = {c: c for c in component.tolist()}

    def top(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for x, y in zip(*(at.tolist() for at in np.nonzero(worth))):
        p, q = top(component[x]), top(component[y])
        if p == q:
            continue
        for z in (x, y):
            if z not in sets:
                sets[z] = shingle_set(texts[z])
        if linked(sets[x], sets[y], percent):
            root[q] = p
            links.append((ids[x], ids[y]))


def _compare_sorted(percent: int):
    """Rows come sorted by pair of blocks; the last pair of a batch may go on in the next."""

    hashes = WordHashes()

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            keys = rest[["key", "i", "j"]].to_numpy()
            last = len(keys) - 1
            while last > 0 and (keys[last] == keys[last - 1]).all():
                last -= 1
            if last:
                yield from batch(rest.iloc[:last])
                rest = rest.iloc[last:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield from batch(rest)

    def batch(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        keys = frame[["key", "i", "j"]].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])).tolist() + [len(keys)]
        ids, component, own, sizes = (frame[c].to_numpy() for c in ("id", "component", "own", "n_shingles"))
        bits, texts, links = _bits(frame["sketch"].tolist()), frame["text"].tolist(), []
        for a, b in zip(starts, starts[1:]):
            _compare(ids[a:b], component[a:b], own[a:b], keys[a][1] != keys[a][2], sizes[a:b], bits[a:b], texts[a:b], percent, hashes, links)
        if links:
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return go


def block_links(reps: DataFrame, texts: DataFrame, members: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links between members (key, id, component) of a bucket that lie in different components."""
    full = _dealt_blocks(members, block).join(reps.select("id", "n_shingles", "sketch"), "id").join(texts, "id")
    by = ["key", "i", "j"]
    return full.repartition(*by).sortWithinPartitions(*by, "id").mapInPandas(_compare_sorted(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; texts are linked at a similarity of ``percent`` / 100."""
    signed = materialise(signatures(docs), "signatures")
    named = signed.where("doc_id is not null and digest is not null")
    classes = materialise(named.groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    first = named.join(classes, "digest").where("doc_id = id").dropDuplicates(["id", "digest"]).drop("id")
    # classes are known by their least doc_id; where one doc_id stands on different texts, by a hash below zero
    twins = first.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("twin"))
    own = F.when(F.col("twin"), F.xxhash64("digest").bitwiseOR(F.lit(-(1 << 63)))).otherwise(F.col("doc_id"))
    reps = materialise(first.join(twins, "doc_id", "left").select(
        own.alias("id"), "doc_id", "digest", "n_shingles", "sketch", "bands", "twin"), "representatives")
    bands = reps.select("id", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    rows = materialise(bands.join(materialise(shared, "shared-keys"), "key").select("key", "id"), "band-rows")
    wanted = rows.select("id").distinct().join(reps.select("id", "doc_id", "digest"), "id")
    texts = materialise(texts_of(docs, wanted), "texts")
    links = materialise(star_links(reps, texts, rows, percent), "star-links")
    found = components(links)
    members = open_buckets(rows, found)
    links = links.unionByName(materialise(star_links(reps, texts, members.select("key", "id"), percent, drawn=True), "more-links"))
    found = components(links)
    members = open_buckets(members.select("key", "id"), found)
    links = links.unionByName(materialise(block_links(reps, texts, members, percent), "block-links"))
    found = components(links)
    joined = reps.select("id", "doc_id", "digest").join(found, "id")
    least = materialise(joined.groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    ids = reps.select("id", "doc_id", "digest").join(found, "id", "left").join(least, "component", "left").select(
        "digest", F.coalesce("least", "doc_id").alias("component"))
    ids = materialise(ids, "class-components")
    out = signed.join(ids, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


OP9_SQL = """
with w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws
  from documents
), sh as (
  select distinct doc_id, case when len(ws) < 5 then array_to_string(ws, ' ') else array_to_string(ws[i:i + 4], ' ') end as s
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)
), n as (select doc_id, count(*) as n from sh group by doc_id
), pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as common
  from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)
), edges as (select a, b from links union select b, a from links
), reach as (
  with recursive r(id, other) as (
    select doc_id, doc_id from documents union select r.id, e.b from r join edges e on e.a = r.other
  ) select id, min(other) as component from r group by id
)
select w.doc_id, coalesce(n.n, 0) as n_shingles, component as component_id, w.doc_id = component as kept
from w left join n using (doc_id) join reach on reach.id = w.doc_id
"""


@corpus_query("op9_near_duplicates", OP9_SQL)
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
