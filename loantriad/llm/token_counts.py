"""Greedy word-piece counts by a linear longest-match automaton, without building the pieces.

The vocabulary is a trie. When a word's next byte has no child, a failure link jumps to the trie node of what is left
after the longest-match pieces popped on the way, and a number per node says how many pieces that were. Every byte is
read once, so a word takes time in proportion to its length; words are remembered per worker (at most CACHE_WORDS).

A word is one longest match from ``initial`` pieces, then longest matches from ``continuing`` pieces; a word that can't
be finished is one unknown piece. With a byte vocabulary the two sets are the same and nothing is unknown; each word
is then read with the space before it.

Defined results: null or empty text has 0 words and 0 tokens; each row is counted alone; an empty table gives an empty
table; only doc_id and text are read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from loantriad.llm.bpe import byte_letters, file_text
from loantriad.llm.common import CACHE_WORDS, beside, row_by_row, table, vocabulary_path, words_of
from loantriad.llm.registry import corpus_query

UNKNOWN = -1


class Automaton:
    """Trie nodes as lists: children, failure link (UNKNOWN: none), pieces popped when following it."""

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes] | None = None):
        self.child: list[dict[int, int]] = [{}]
        self.fail: list[int] = [UNKNOWN]
        self.popped: list[int] = [0]
        ends: set[int] = set()
        self.start = 0
        self._insert(0, initial, ends)
        self.next = 0 if continuing is None else self._node()
        if continuing is not None:
            self._insert(self.next, continuing, ends)
        self._link(ends)

    def _node(self) -> int:
        self.child.append({})
        self.fail.append(UNKNOWN)
        self.popped.append(0)
        return len(self.child) - 1

    def _insert(self, root: int, pieces: Iterable[bytes], ends: set[int]) -> None:
        for piece in pieces:
            at = root
            for b in piece:
                if b not in self.child[at]:
                    self.child[at][b] = self._node()
                at = self.child[at][b]
            if piece:
                ends.add(at)

    def _link(self, ends: set[int]) -> None:
        """Breadth first, so that links of shorter prefixes are known."""
        child, fail, popped = self.child, self.fail, self.popped
        todo = deque({self.start, self.next})
        while todo:
            u = todo.popleft()
            for b, v in child[u].items():
                if v in ends:
                    fail[v], popped[v] = self.next, 1
                else:
                    z, n = fail[u], popped[u]
                    while z != UNKNOWN and b not in child[z]:
                        n += popped[z]
                        z = fail[z]
                    if z != UNKNOWN:
                        fail[v], popped[v] = child[z][b], n
                todo.append(v)

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; 1 if it can't be finished."""
        child, fail, popped = self.child, self.fail, self.popped
        at, n = self.start, 0
        for b in word:
            while b not in child[at]:
                n += popped[at]
                at = fail[at]
                if at == UNKNOWN:
                    return 1
            at = child[at][b]
        roots = (self.start, self.next)
        while at not in roots:
            n += popped[at]
            at = fail[at]
            if at == UNKNOWN:
                return 1
        return n


def byte_pieces(content: str) -> list[bytes]:
    """All entries of a byte-level vocabulary file, special tokens left out."""
    import json

    spec, letters = json.loads(content), byte_letters()
    special = {t["content"] for t in spec["added_tokens"]}
    return [bytes(letters[c] for c in s) for s in spec["model"]["vocab"] if s not in special]


class Counts(dict):
    """Pieces per word, remembered."""

    def __init__(self, automaton: Automaton, before: bytes):
        super().__init__()
        self.automaton, self.before = automaton, before

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = self[word] = self.automaton.count(self.before + word)
        return n


_COUNTS: dict[int, Counts] = {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every row; ``path`` is a byte-level vocabulary file."""
    content = docs.sparkSession.sparkContext.broadcast(file_text(path))  # a vocabulary file

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        key = hash(content.value)
        if key not in _COUNTS:
            _COUNTS[key] = Counts(Automaton(byte_pieces(content.value)), b" ")
        counts = _COUNTS[key]
        words = [words_of(text) for text in frame["text"]]
        return pd.DataFrame({"n_words": [len(w) for w in words], "n_tokens": [sum(map(counts.__getitem__, w)) for w in words]})

    return beside(docs, ["doc_id"], ["text"], row_by_row(run), "n_words long, n_tokens long")


@corpus_query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
