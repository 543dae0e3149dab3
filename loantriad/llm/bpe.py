"""Byte-level BPE encoding and decoding by a prefix-sharing trie.

The encoding of a string is fixed by its last token and the encoding of what comes before it, so each prefix of a word
needs one number: its last token. Distinct words go into a trie; a depth-first walk gives every node the last token
of its prefix, once for all words that share the prefix: of the vocabulary entries that end there, it is the one
that may follow the last token of the prefix before it. Two tokens may stand side by side if encoding their joined bytes
would give them back, which unwinding their merges decides (and a cache remembers).

A text is cut into chunks at lone spaces and lone line breaks, which pretokenisation never joins across; chunks are
remembered in each worker (at most CACHE_WORDS), pretokenised by the public pattern, and their new words encoded
together, one trie per batch. Special tokens are found first, as the tokenizer does.

Defined results: null or empty text has no ids and decodes to the empty string; every row is treated alone, so repeated
rows repeat and an empty table gives an empty table; only doc_id and text are read. Decoding replaces bytes that aren't
UTF-8, as the tokenizer does; an id outside the vocabulary decodes to nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from loantriad.llm.common import CACHE_WORDS, beside, row_by_row, slices, table, vocabulary_path
from loantriad.llm.registry import corpus_query

#: The public pretokenisation pattern of this vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space or line break beside other white space: such texts are pretokenised whole.
_MIXED = re.compile(r"\s[\s]")


def byte_letters() -> dict[str, int]:
    """The letters in which vocabulary files write bytes: printable ones stand for themselves, others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merges by rank, special tokens; built from a tokenizer file's text."""

    def __init__(self, content: str):
        spec = json.loads(content)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {to_bytes(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.special = special
        self.ids = ids
        self.bytes_of = {i: b for b, i in ids.items()} | {i: s.encode() for s, i in special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> (rank, result)
        self.split_of: dict[int, tuple[int, int, int]] = {}  # token -> (rank, left, right)
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = ids[to_bytes(left)], ids[to_bytes(right)]
            out = ids[self.bytes_of[a] + self.bytes_of[b]]
            self.merges.setdefault((a, b), (rank, out))
            self.split_of.setdefault(out, (rank, a, b))
        self.single = [ids[bytes([b])] for b in range(256)]
        self._fits: dict[tuple[int, int], bool] = {}
        self._suffixes: dict[int, list[tuple[int, int]]] = {}
        self._trie()

    def _trie(self) -> None:
        """Trie of reversed tokens: walking back from a node finds every token that ends there and that merges can make."""
        self.back: list[dict[int, int]] = [{}]
        self.back_id: list[int] = [-1]
        for token, i in self.ids.items():
            at = 0
            for b in reversed(token):
                nxt = self.back[at].get(b)
                if nxt is None:
                    nxt = self.back[at][b] = len(self.back)
                    self.back.append({})
                    self.back_id.append(-1)
                at = nxt
            if len(token) == 1 or i in self.split_of:
                self.back_id[at] = i

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` by rank keeps the border between them."""
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) > CACHE_WORDS:
                self._fits.clear()
            known = self._fits[(a, b)] = self._keeps_border(a, b)
        return known

    def _keeps_border(self, a: int, b: int) -> bool:
        """Unwind the later merge of either side until both sides are bytes; a border pair that would have merged
        before the merge just unwound breaks the border."""
        limit = 1 << 60
        while True:
            pair = self.merges.get((a, b))
            if pair is not None and pair[0] < limit:
                return False
            left, right = self.split_of.get(a), self.split_of.get(b)
            if left is None and right is None:
                return True
            # the side formed last is undone first; at equal rank the left one was formed first
            if right is None or (left is not None and left[0] > right[0]):
                limit, a = left[0], left[2]
                # a pair of the same rank further left merges before the border pair
                pair = self.merges.get((a, b))
                if pair is not None and pair[0] < limit:
                    return False
            else:
                limit, b = right[0] + 1, right[1]
                pair = self.merges.get((a, b))
                if pair is not None and pair[0] < limit:
                    return False

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of every distinct word: one walk over their trie."""
        # sorted words are the trie in depth-first order: what two neighbours share is walked once
        out: dict[bytes, list[int]] = {}
        last: list[int] = []  # last token of each prefix of the current path, from length 1
        before = b""
        back, back_id, bytes_of = self.back, self.back_id, self.bytes_of
        known, fits = self._fits.get, self.fits
        for word in sorted(set(words)):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared:]
            for end in range(shared + 1, len(word) + 1):
                at, choice, k = 0, -1, end
                while k:
                    k -= 1
                    at = back[at].get(word[k])
                    if at is None:
                        break
                    token = back_id[at]
                    # several entries may end here, but only one may follow: the encoding is unique
                    if token >= 0:
                        if not k:
                            choice = token
                            break
                        fit = known((last[k - 1], token))
                        if fit or fit is None and fits(last[k - 1], token):
                            choice = token
                            break
                last.append(choice)
            ids, end = [], len(word)
            while end:
                token = last[end - 1]
                ids.append(token)
                end -= len(bytes_of[token])
            out[word] = ids[::-1]
            before = word
        return out


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes; ``encode_chunks`` turns new chunks into such bytes."""

    special_id = staticmethod(lambda i: int(i).to_bytes(4, "little"))
    joined = staticmethod(b"".join)

    def __init__(self, special: dict[str, int], encode_chunks: Callable[[list[str]], list[bytes]]):
        self.encode_chunks = encode_chunks
        self.ids_of_special = {name: self.special_id(i) for name, i in special.items()}
        self.known: dict[str, bytes] = dict(self.ids_of_special)
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def batch(self, texts: Iterable[str | None]) -> list[bytes]:
        """What each text is encoded to. Chunks take many times the memory of their text, so those of some texts are held at once."""
        return [ids for some in slices(texts) for ids in self._batch(some)]

    def _batch(self, texts: list[str | None]) -> list[bytes]:
        get = self.known.get
        parts = [self._chunks(text or "") for text in texts]
        found = [list(map(get, chunks)) for chunks in parts]
        gaps = [[i for i, ids in enumerate(line) if ids is None] if None in line else () for line in found]
        new = list({chunks[i] for chunks, at in zip(parts, gaps) for i in at})
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = dict(self.ids_of_special)
        fresh = dict(zip(new, self.encode_chunks(new)))
        self.known.update(fresh)
        for chunks, line, at in zip(parts, found, gaps):
            for i in at:
                line[i] = fresh[chunks[i]]
        return list(map(self.joined, found))

    def _chunks(self, text: str) -> list[str]:
        if self.at_special is None:
            return self._plain(text)
        parts = self.at_special.split(text)
        if len(parts) == 1:
            return self._plain(text)
        return [c for i, part in enumerate(parts) for c in ([part] if i % 2 else self._plain(part))]

    @staticmethod
    def _plain(text: str) -> list[str]:
        if not text:
            return []
        if text[0].isspace() or text[-1].isspace() or _MIXED.search(text):
            return _PRE.findall(text)
        out: list[str] = []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append("\n")
            head, *rest = line.split(" ")
            out.append(head)
            out += [" " + c for c in rest]
        return out


class ChunkCounter(ChunkEncoder):
    """How many ids texts have; ``encode_chunks`` turns new chunks into such numbers."""

    special_id = staticmethod(lambda i: 1)
    joined = staticmethod(sum)


_PRE = regex.compile(PATTERN)


def trie_chunks(vocabulary: Vocabulary) -> Callable[[list[str]], list[bytes]]:
    """Encodes chunks: pretokenise, then one trie over all their new words."""
    packed: dict[str, bytes] = {}

    def encode(chunks: list[str]) -> list[bytes]:
        # ASCII letters, with or without a space before them, are one piece
        pieces = [[c] if c.isascii() and c[1:].isalpha() and (c[0] == " " or c[0].isalpha()) else _PRE.findall(c) for c in chunks]
        new = {p for ps in pieces for p in ps if p not in packed}
        if len(packed) + len(new) > CACHE_WORDS:
            packed.clear()
            new = {p for ps in pieces for p in ps}
        words = {p: p.encode("utf-8", "replace") for p in new}
        ids = vocabulary.encode_words(words.values())
        packed.update({p: struct.pack(f"<{len(ids[w])}I", *ids[w]) for p, w in words.items()})
        return [b"".join([packed[p] for p in ps]) for ps in pieces]

    return encode


def decode(ids: np.ndarray, bytes_of: list[bytes]) -> str:
    return b"".join(map(bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def byte_table(vocabulary: Vocabulary) -> list[bytes]:
    return [vocabulary.bytes_of.get(i, b"") for i in range(max(vocabulary.bytes_of) + 1)]


def file_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


_STATE: dict[int, tuple[ChunkEncoder, list[bytes]]] = {}


def worker_state(content: str) -> tuple[ChunkEncoder, list[bytes]]:
    """Encoder of this worker process; kept between tasks."""
    key = hash(content)
    if key not in _STATE:
        vocabulary = Vocabulary(content)
        _STATE[key] = ChunkEncoder(vocabulary.special, trie_chunks(vocabulary)), byte_table(vocabulary)
    return _STATE[key]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit bytes) and the decoded text of every row."""
    content = docs.sparkSession.sparkContext.broadcast(file_text(path))  # a vocabulary file

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        encoder, bytes_of = worker_state(content.value)
        ids = encoder.batch(frame["text"])
        return pd.DataFrame({
            "n_tokens": [len(i) // 4 for i in ids], "ids": ids,
            "decoded": [decode(np.frombuffer(i, "<u4"), bytes_of) for i in ids]})

    return beside(docs, ["doc_id"], ["text"], row_by_row(run), "n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode``, with hashes in place of ids and text, so that neither leaves the task."""
    content = docs.sparkSession.sparkContext.broadcast(file_text(path))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        encoder, bytes_of = worker_state(content.value)
        ids = encoder.batch(frame["text"])
        texts = (decode(np.frombuffer(i, "<u4"), bytes_of) for i in ids)
        return pd.DataFrame({
            "n_tokens": [len(i) // 4 for i in ids], "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
            "decoded_sha256": [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts]})

    return beside(docs, ["doc_id"], ["text"], row_by_row(run), "n_tokens long, ids_sha256 string, decoded_sha256 string")


@corpus_query("op7_bpe_codec")
def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
