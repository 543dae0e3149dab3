"""Cross-tokenizer alignment: which ids of one tokenizer overlap which ids of another, and how often.

Both tokenizers give ids whose bytes, joined, are the text behind one space. Byte offsets where tokens of both end cut a text
into groups; between two neighbouring ends of either side lies exactly one overlapping pair of tokens, a link.

1. Every document is encoded once; its ids are stored, two bytes each. Every task aligns its documents and keeps, for each distinct id
   pair, the number of its documents that hold it linked.
   Lists of pairs are dealt into ``perfect_hash.BUCKETS`` buckets by hash.
2. The lists of a bucket are united in two steps (heaps of ``FAN`` tasks' lists, then one) and a minimal perfect hash is built of its pairs.
3. Counts become dense vectors indexed by the hash and are summed the same way, as a tree.
4. A second pass aligns the stored ids again and looks the counts up; the key beside each count is compared.

Buckets are looked up ``SEGMENT_KEYS`` keys at a time: that bounds what is broadcast, some 13 bytes a key. More keys mean
more passes over the ids, whose parts are added up; nothing is left out.

Defined results: a text that is null or empty, or whose ids of either side don't give its bytes back, has no tokens: all numbers
0, groups ''. Every row counts as a document, repeated rows and rows without doc_id too. An empty table gives an empty
table. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from loantriad.llm import perfect_hash as ph
from loantriad.llm.bpe import file_text
from loantriad.llm.common import CACHE_WORDS, beside, slices, table, vocabulary_path
from loantriad.llm.registry import corpus_query
from loantriad.llm.whole_ids import WholeTexts
from loantriad.session import materialise

FAN = 64
SEGMENT_KEYS = 4_000_000
BATCH_IDS = 100_000
TASK_KEYS = 2_000_000
SHIFT = 16  # bits of an id


class TwoTokenizers:
    """Ids and bytes of both sides; A reads a space and the text, B adds that space itself.

    Neither side has a token that reaches over a space between other signs, so words are encoded one by one and
    remembered (at most CACHE_WORDS). Texts with other signs, or spaces side by side or at an end, are encoded whole.
    """

    WHOLE = re.compile(r"  |^ | $|[^\n -~À-ɏ]")

    def __init__(self, byte_content: str, piece_model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.a = WholeTexts(byte_content, as_text=True)
        self.b = SentencePieceProcessor(model_proto=piece_model)
        self.bytes_a = [b""] * (max(self.a.entries.values()) + 1)
        for entry, i in self.a.entries.items():
            self.bytes_a[i] = entry
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}
        # how an id is written inside a group, and as the last of its side
        self.written = [b"%d" % i + mark for n, marks in ((len(self.bytes_a), (b",", b"|")), (len(self.bytes_b), (b",", b";")))
                        for mark in marks for i in range(n)]

    def encoded(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of whole texts; none where B's don't give the text back (A's always do, it has all 256 bytes)."""
        left, right = [], []
        for text, a, b in zip(texts, self.a.ids([" " + t for t in texts]), self.b.encode(texts, num_threads=1) if texts else ()):
            same = b"".join(map(self.bytes_b.__getitem__, b)) == (" " + text).encode("utf-8", "surrogatepass")
            left.append(array("I", a).tobytes() if same else b"")
            right.append(array("I", b).tobytes() if same else b"")
        return left, right

    def tokens(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Ids of A and of B as unsigned 32-bit bytes; none for texts without tokens."""
        whole = [i for i, t in enumerate(texts) if t and (not self.apart or self.WHOLE.search(t))]
        alone = set(whole)
        split = {i: t.split(" ") for i, t in enumerate(texts) if t and i not in alone}
        new = set().union(*split.values()) - self.known_b.keys()
        if len(self.known_b) + len(new) > CACHE_WORDS:
            self.known_a, self.known_b, new = {}, {}, set().union(*split.values())
        words = list(new)
        left, right = self.encoded(words)
        self.known_a.update(zip(words, left))
        self.known_b.update(zip(words, right))
        ids_a, ids_b = [b""] * len(texts), [b""] * len(texts)
        for i, ws in split.items():
            found = list(map(self.known_b.__getitem__, ws))
            if b"" in found:
                whole.append(i)
            else:
                ids_a[i], ids_b[i] = b"".join(map(self.known_a.__getitem__, ws)), b"".join(found)
        for i, a, b in zip(whole, *self.encoded([texts[i] for i in whole])):
            ids_a[i], ids_b[i] = a, b
        return ids_a, ids_b


def _flat(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and where each text's begin."""
    bounds = np.concatenate([[0], np.cumsum([len(x) // 2 for x in ids])]).astype(np.int64)
    return np.frombuffer(b"".join(ids), "<u2").astype(np.int64), bounds


class Alignment:
    """Links and groups of a batch of texts, from their ids of either side (unsigned 16-bit bytes).
    Texts stand one after the other: their ends are ends of both sides."""

    def __init__(self, tokenizers: TwoTokenizers, lists_a: list[bytes], lists_b: list[bytes]):
        self.a, self.from_a = _flat(lists_a)
        self.b, self.from_b = _flat(lists_b)
        self.ends_a, self.ends_b = np.cumsum(tokenizers.size_a[self.a]), np.cumsum(tokenizers.size_b[self.b])
        total = int(self.ends_a[-1]) if len(self.a) else 0
        marks = np.zeros(total + 1, np.uint8)
        marks[self.ends_a] |= 1
        marks[self.ends_b] |= 2
        ends = np.flatnonzero(marks)
        flags = marks[ends]
        is_a, is_b = flags & 1, flags >> 1
        at_a = np.cumsum(is_a, dtype=np.int64) - is_a
        at_b = np.cumsum(is_b, dtype=np.int64) - is_b
        self.keys = self.a[at_a] << SHIFT | self.b[at_b]
        text_ends = np.concatenate([[0], self.ends_a])[self.from_a]
        self.from_link = np.searchsorted(ends, text_ends, side="right")
        self.closes_a, self.closes_b = marks[self.ends_a] == 3, marks[self.ends_b] == 3  # last token of its group
        self.from_group = np.searchsorted(ends[flags == 3], text_ends, side="right")

    def text_of_link(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.from_link) - 1), np.diff(self.from_link))

    def written(self, tokenizers: TwoTokenizers) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        n_a, n_b = len(tokenizers.bytes_a), len(tokenizers.bytes_b)
        group_a = np.cumsum(self.closes_a) - self.closes_a
        group_b = np.cumsum(self.closes_b) - self.closes_b
        before_b = np.concatenate([[0], 1 + np.flatnonzero(self.closes_b)])  # tokens of B in earlier groups
        upto_a = 1 + np.flatnonzero(self.closes_a)  # tokens of A in this group and earlier ones
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + before_b[group_a]] = self.a + n_a * self.closes_a
        codes[np.arange(len(self.b)) + upto_a[group_b]] = self.b + (2 * n_a + n_b * self.closes_b)
        parts = list(map(tokenizers.written.__getitem__, codes.tolist()))
        cuts = (self.from_a + self.from_b).tolist()
        return [b"".join(parts[x:y])[:-1] for x, y in zip(cuts, cuts[1:])]


def batches(ids: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    """Slices of about BATCH_IDS ids; a text with more is one by itself."""
    first, size = 0, 0
    for at, text in enumerate(ids):
        n = len(text) // 2
        if at > first and size + n > BATCH_IDS:
            yield first, at
            first, size = at, 0
        size += n
    if first < len(ids):
        yield first, len(ids)


_WORKER: dict[int, TwoTokenizers] = {}


def _tokenizers(shared) -> TwoTokenizers:
    content, model = shared.value
    key = hash((content, model))
    if key not in _WORKER:
        _WORKER[key] = TwoTokenizers(content, model)
    return _WORKER[key]


class PairCounts:
    """Documents per pair, as sorted arrays that are merged when the newer ones outgrow the older."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        while len(self.parts) > 1 and len(self.parts[-1][0]) * 2 > len(self.parts[-2][0]):
            self.parts[-2:] = [added(self.parts[-2:])]

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = added(self.parts)
        self.parts = []
        return out


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, inverse, np.concatenate([c for _, c in parts]))
    return keys, counts


def encoded_texts(docs: DataFrame, shared) -> DataFrame:
    """doc_id, a, b of every row: its ids of either side as unsigned 16-bit bytes."""

    def start():
        tokenizers = _tokenizers(shared)
        if max(len(tokenizers.bytes_a), len(tokenizers.bytes_b)) > 1 << SHIFT:
            raise ValueError(f"vocabularies of at most {1 << SHIFT} ids")
        short = lambda ids: [np.frombuffer(i, "<u4").astype("<u2").tobytes() for i in ids]

        def work(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            first = 0
            for texts in slices(frame["text"]):
                a, b = tokenizers.tokens(texts)
                yield pd.DataFrame({"at": np.arange(first, first + len(texts)), "a": short(a), "b": short(b)})
                first += len(texts)

        return work

    return beside(docs, ["doc_id"], ["text"], start, "a binary, b binary")


def pair_lists(ids: DataFrame, shared) -> DataFrame:
    """bucket, part, keys, counts: the distinct pairs of each task, by bucket."""

    def lists(counts: PairCounts, part: int) -> pd.DataFrame:
        keys, n = counts.take()
        buckets = ph.bucket_of(keys)
        by = np.argsort(buckets, kind="stable")
        cuts = np.searchsorted(buckets[by], np.arange(ph.BUCKETS + 1))
        rows = [(b, part, keys[by[x:y]].astype("<u4").tobytes(), n[by[x:y]].astype("<i8").tobytes())
                for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
        return pd.DataFrame(rows, columns=["bucket", "part", "keys", "counts"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizers, counts, part, held = _tokenizers(shared), PairCounts(), TaskContext.get().partitionId(), 0
        for frame in frames:
            a, b = frame["a"].tolist(), frame["b"].tolist()
            for x, y in batches(a):
                found = Alignment(tokenizers, a[x:y], b[x:y])
                once = np.unique(found.text_of_link() << 32 | found.keys) & 0xFFFFFFFF  # each pair once a document
                if len(once):
                    counts.add(*np.unique(once, return_counts=True))
                held = sum(len(k) for k, _ in counts.parts)
                if held > TASK_KEYS:
                    yield lists(counts, part)
        if counts.parts:
            yield lists(counts, part)

    return ids.select("a", "b").mapInPandas(run, "bucket int, part int, keys binary, counts binary")


def _united(frame: pd.DataFrame) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(k, "<u4") for k in frame["keys"]]))


def hash_rows(lists: DataFrame) -> DataFrame:
    """bucket, n, sizes, maps, keys: the minimal perfect hash of each bucket's distinct pairs."""

    def unite(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": frame["bucket"].iloc[:1], "keys": [_united(frame).tobytes()]})

    def hashed(frame: pd.DataFrame) -> pd.DataFrame:
        sizes, maps, keys = ph.build(_united(frame))
        return pd.DataFrame({"bucket": frame["bucket"].iloc[:1], "n": [len(keys)], "sizes": [sizes], "maps": [maps], "keys": [keys.tobytes()]})

    heaps = lists.select("bucket", F.floor(F.col("part") / FAN).alias("heap"), "keys").groupBy("bucket", "heap").applyInPandas(unite, "bucket int, keys binary")
    return heaps.groupBy("bucket").applyInPandas(hashed, "bucket int, n int, sizes array<int>, maps binary, keys binary")


def segments(sizes: dict[int, int], most: int) -> list[list[int]]:
    """Buckets in groups of at most ``most`` keys (one bucket at least)."""
    out: list[list[int]] = []
    held = 0
    for bucket, n in sorted(sizes.items()):
        if not out or held + n > most:
            out.append([])
            held = 0
        out[-1].append(bucket)
        held += n
    return out


def read_hash(rows: DataFrame, buckets: list[int]) -> ph.PerfectHash:
    """The hash of some buckets, SEGMENT_KEYS keys at most (or one bucket)."""
    found = rows.where(F.col("bucket").isin(buckets)).select("bucket", "sizes", "maps", "keys").collect()
    return ph.PerfectHash([(r.bucket, list(r.sizes), bytes(r.maps), np.frombuffer(bytes(r["keys"]), "<u4")) for r in found])


def count_vectors(lists: DataFrame, hashed: ph.PerfectHash, buckets: list[int]) -> DataFrame:
    """bucket, vector: documents per pair, dense in the order of the hash; summed as a tree."""
    shared = lists.sparkSession.sparkContext.broadcast(hashed)

    def dense(frame: pd.DataFrame) -> pd.DataFrame:
        table, bucket = shared.value, int(frame["bucket"].iloc[0])
        vector = np.zeros(table.first[bucket + 1] - table.first[bucket], np.int64)
        for keys, counts in zip(frame["keys"], frame["counts"]):
            vector[table.index(np.frombuffer(keys, "<u4")) - table.first[bucket]] += np.frombuffer(counts, "<i8")
        return pd.DataFrame({"bucket": [bucket], "vector": [vector.tobytes()]})

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, "<i8") for v in frame["vector"])
        return pd.DataFrame({"bucket": frame["bucket"].iloc[:1], "vector": [total.tobytes()]})

    schema = "bucket int, vector binary"
    heaped = lists.where(F.col("bucket").isin(buckets)).withColumn("heap", F.floor(F.col("part") / FAN))
    return heaped.groupBy("bucket", "heap").applyInPandas(dense, schema).groupBy("bucket").applyInPandas(summed, schema)


def best_counts(rows: DataFrame, vectors: DataFrame, n_a: int) -> np.ndarray:
    """The highest count of each id of A: one number an id of the vocabulary."""

    def tops(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for keys, vector in zip(frame["keys"], frame["vector"]):
                best = np.zeros(n_a, np.int64)
                np.maximum.at(best, np.frombuffer(keys, "<u4") >> SHIFT, np.frombuffer(vector, "<i8"))
                at = np.flatnonzero(best)
                yield pd.DataFrame({"a": at, "n": best[at]})

    found = rows.select("bucket", "keys").join(vectors, "bucket").mapInPandas(tops, "a long, n long").groupBy("a").agg(F.max("n").alias("n"))
    best = np.zeros(n_a, np.int64)
    for r in found.collect():  # at most the vocabulary
        best[r.a] = r.n
    return best


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _looked_up(ids: DataFrame, shared, looked, keep: list[str], digest: bool) -> DataFrame:
    """``keep`` and ALIGNED with the counts of one segment. ``digest``: the hash of the groups in their place."""

    def start():
        tokenizers = _tokenizers(shared)
        hashed, counts, best = looked.value

        def work(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            a, b = frame["a"].tolist(), frame["b"].tolist()
            for x, y in batches(a):
                found = Alignment(tokenizers, a[x:y], b[x:y])
                keys, inverse = np.unique(found.keys, return_inverse=True)
                at = hashed.index(keys)
                n = np.where(at >= 0, counts[at] if len(counts) else 0, 0)
                top = (at >= 0) & (n == best[keys >> SHIFT])
                groups = found.written(tokenizers)
                if digest:
                    groups = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                else:
                    groups = [g.decode() for g in groups]
                yield pd.DataFrame({
                    "at": np.arange(x, y), "n_a": np.diff(found.from_a), "n_b": np.diff(found.from_b),
                    "n_groups": np.diff(found.from_group), "n_links": np.diff(found.from_link),
                    "n_best": _sums(top[inverse], found.from_link), "count_sum": _sums(n[inverse], found.from_link), "groups": groups})

        return work

    return beside(ids, keep, ["a", "b"], start, ALIGNED)


def align(docs: DataFrame, byte_path: str, piece_path: str, digest: bool = False, segment_keys: int = SEGMENT_KEYS) -> DataFrame:
    """doc_id, ALIGNED of every row; ``groups`` as text, or its SHA-256 with ``digest``."""
    context = docs.sparkSession.sparkContext
    with open(piece_path, "rb") as f:
        shared = context.broadcast((file_text(byte_path), f.read()))  # two vocabulary files
    n_a = max(_tokenizers(shared).a.entries.values()) + 1
    ids = materialise(encoded_texts(docs, shared), "two-ids")
    lists = materialise(pair_lists(ids, shared), "pair-lists")
    rows = materialise(hash_rows(lists), "pair-hashes")
    sizes = {r.bucket: r.n for r in rows.select("bucket", "n").collect()}
    cuts = segments(sizes, segment_keys)
    hashes = [read_hash(rows, cut) for cut in cuts[:1]]
    vectors = None
    for i, cut in enumerate(cuts):
        part = materialise(count_vectors(lists, hashes[0] if i == 0 else read_hash(rows, cut), cut), "pair-counts")
        vectors = part if vectors is None else vectors.unionByName(part)
    if vectors is None:  # nothing is linked
        looked = context.broadcast((ph.PerfectHash([]), np.empty(0, np.int64), np.zeros(n_a, np.int64)))
        return _looked_up(ids, shared, looked, ["doc_id"], digest)
    best = best_counts(rows, vectors, n_a)

    def counted(i: int, cut: list[int]):
        hashed = hashes[0] if i == 0 else read_hash(rows, cut)
        found = {r.bucket: r.vector for r in vectors.where(F.col("bucket").isin(cut)).collect()}
        return context.broadcast((hashed, np.concatenate([np.frombuffer(bytes(found[b]), "<i8") for b in sorted(cut)]), best))

    if len(cuts) == 1:
        return _looked_up(ids, shared, counted(0, cuts[0]), ["doc_id"], digest)
    numbered = ids.withColumn("row", F.monotonically_increasing_id())
    parts = None
    for i, cut in enumerate(cuts):
        part = materialise(_looked_up(numbered, shared, counted(i, cut), ["row", "doc_id"], digest), "aligned")
        parts = part if parts is None else parts.unionByName(part)
    same = ["n_a", "n_b", "n_groups", "n_links", "groups"]
    out = parts.groupBy("row").agg(*[F.any_value(c).alias(c) for c in ["doc_id", *same]], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select("doc_id", *same[:4], "n_best", "count_sum", "groups")


@corpus_query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return align(docs, vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"), digest=True).withColumnRenamed("groups", "groups_sha256")
