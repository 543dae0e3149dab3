"""Language by string kernels: blended-spectrum presence kernel, Nyström landmarks, one-versus-rest kernel ridge regression.

A text is the set of its runs of 1 to ``LONGEST`` letters (lower case; everything else is one gap), told apart by ``BUCKETS``
hash values. The kernel of two texts is the number of runs that both have over the root of the product of their
numbers. ``LANDMARKS`` training texts, the same number of each language, span the regression: with K the
kernels of training texts and landmarks and M those among landmarks, the coefficients solve (K'WK + r M) c = K'WY, where Y is
+1 for a text's own language and -1 else, and W weighs languages alike. Kernels of a batch of texts are one product of
its 0/1 matrix with that of the landmarks; their scores are one more product with the coefficients.

Trained on at most ``PER_LANGUAGE`` distinct texts (by hash of the text) of each of at most ``LANGUAGES`` languages (those
with the most rows), read whole; the normal equations are summed in the tasks, and the driver gets LANDMARKS^2 numbers from
each of ``PARTS`` parts. Every whole text is scored.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing can be learned;
rows without doc_id, text or lang are not learned from; equal texts get equal results; ties go to the first language by
name; an empty table gives an empty table. Only doc_id, text and (in training) lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loantriad.llm.common import beside, mix, table
from loantriad.llm.registry import corpus_query
from loantriad.session import materialise

LONGEST = 4
BUCKETS = 1 << 17
LANDMARKS = 128
PER_LANGUAGE = 1_024
LANGUAGES = 64
RIDGE = 1e-3
PARTS = 8
BATCH = 32
PIECE = 1 << 20
UNKNOWN = "und"

_U = np.uint64
_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def letters(text: str | None) -> np.ndarray:
    """Code points of the letters in lower case, with one gap (space) before, between and behind words; empty without letters."""
    if not text:
        return np.empty(0, _U)
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[codes]
    if not letter.any():
        return np.empty(0, _U)
    beside_word = letter | np.concatenate([letter[1:], [False]])  # a letter, or the sign before one
    beside_word[-1] = True
    codes = np.where(letter, codes, 32)[beside_word]
    if codes[-2] == 32:
        codes = codes[:-1]
    return codes.astype(_U)


def mark(codes: np.ndarray, row: np.ndarray) -> None:
    """Set the buckets of all runs in ``row``."""
    for first in range(0, len(codes), PIECE):
        part = codes[first:first + PIECE + LONGEST - 1]
        run = np.zeros(len(part), _U)
        for n in range(1, LONGEST + 1):
            run = run[:len(part) - n + 1] * _U(0x110001) + part[n - 1:]
            row[(mix(run + _U(n << 56)) >> _U(64 - 17)).astype(np.int64)] = True


@dataclass
class Landmarks:
    rows: list[np.ndarray]  # buckets of each landmark, ascending

    def __post_init__(self):
        self.used = np.unique(np.concatenate(self.rows)) if self.rows else np.empty(0, np.int64)
        self.roots = np.sqrt([len(r) for r in self.rows])

    def matrix(self) -> np.ndarray:
        """Used buckets x landmarks, 0 or 1."""
        out = np.zeros((len(self.used), len(self.rows)), np.float32)
        for j, r in enumerate(self.rows):
            out[np.searchsorted(self.used, r), j] = 1
        return out


class Kernels:
    """Kernels of batches of texts with the landmarks."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks, self.matrix = landmarks, landmarks.matrix()
        self.present = np.zeros((BATCH, BUCKETS), bool)

    def batch(self, texts: list[str | None]) -> np.ndarray:
        """Texts x landmarks; at most BATCH texts. A row of zeros for a text without letters."""
        self.present[:len(texts)] = False
        for row, text in zip(self.present, texts):
            mark(letters(text), row)
        here = self.present[:len(texts)]
        both = here[:, self.landmarks.used].astype(np.float32) @ self.matrix
        own = np.sqrt(np.maximum(here.sum(axis=1), 1))
        return both / own[:, None] / self.landmarks.roots[None, :]


def buckets_of(text: str | None) -> np.ndarray:
    row = np.zeros(BUCKETS, bool)
    mark(letters(text), row)
    return np.flatnonzero(row)


@dataclass
class Model:
    languages: list[str]
    landmarks: Landmarks
    coefficients: np.ndarray  # landmarks x languages


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def train_rows(docs: DataFrame, held_out: int | None = 1, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> DataFrame:
    """lang, place (1 is first), text: the bounded training sample."""
    rows = docs.where("doc_id is not null and lang is not null and text is not null")
    if held_out is not None:
        rows = rows.where(fold(F.col("doc_id")) != held_out)
    rows = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.02).alias("texts"))
    sizes = sizes.orderBy(F.desc("n"), "lang").limit(languages)
    # a share of all hash values that holds some three times the wanted texts, then the exact first ones of those
    share = F.least(F.lit(1.0), 3 * F.lit(float(per_language)) / F.col("texts"))
    near = rows.join(F.broadcast(sizes.select("lang", share.alias("share"))), "lang").where(
        F.pmod(F.xxhash64("h"), F.lit(1 << 30)) <= F.col("share") * (1 << 30))
    once = near.groupBy("lang", "h").agg(F.min("text").alias("text"))  # equal texts meet before the shuffle
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("h"), "h"))
    return once.withColumn("place", place).where(F.col("place") <= per_language).select("lang", "place", "text")


def normal_equations(rows: DataFrame, landmarks: Landmarks, languages: list[str], sizes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """K'WK and K'WY over all training rows."""
    shared = rows.sparkSession.sparkContext.broadcast((landmarks, languages, sizes))
    m, c = len(landmarks.rows), len(languages)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks, names, n_of = shared.value
        kernels, left, right = Kernels(marks), np.zeros((m, m)), np.zeros((m, c))
        number = {name: i for i, name in enumerate(names)}
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                part = frame.iloc[at:at + BATCH]
                k = kernels.batch(part["text"].tolist())
                weight = np.array([1.0 / n_of[x] for x in part["lang"]])
                y = np.full((len(part), c), -1.0)
                y[np.arange(len(part)), [number[x] for x in part["lang"]]] = 1.0
                left += k.T @ (weight[:, None] * k)
                right += k.T @ (weight[:, None] * y)
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "l": [left.tobytes()], "r": [right.tobytes()]})

    sums = rows.repartition(PARTS, "lang", "place").sortWithinPartitions("lang", "place").mapInPandas(run, "part int, l binary, r binary")
    found = sorted(sums.collect())  # PARTS rows
    return (sum(np.frombuffer(bytes(f.l)).reshape(m, m) for f in found), sum(np.frombuffer(bytes(f.r)).reshape(m, c) for f in found))


def fit(docs: DataFrame, held_out: int | None = 1, ridge: float = RIDGE, **bounds) -> Model | None:
    """None if there is nothing to learn from."""
    rows = materialise(train_rows(docs, held_out, **bounds), "language-sample")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    each = max(2, LANDMARKS // len(languages))

    def chosen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"lang": frame["lang"], "place": frame["place"], "buckets": [buckets_of(t) for t in frame["text"]]})

    picked = rows.where(F.col("place") <= each).mapInPandas(chosen, "lang string, place int, buckets array<int>").collect()
    found = [np.array(r.buckets, np.int64) for r in sorted(picked, key=lambda r: (r.lang, r.place)) if r.buckets]
    if not found:
        return None
    landmarks = Landmarks(found)
    left, right = normal_equations(rows, landmarks, languages, sizes)
    matrix = landmarks.matrix()
    among = (matrix.T @ matrix) / landmarks.roots[:, None] / landmarks.roots[None, :]
    m = len(found)
    coefficients = np.linalg.lstsq(left + ridge * len(languages) * among + 1e-9 * np.eye(m), right, rcond=None)[0]
    return Model(languages, landmarks, coefficients)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row; the score is the winner's regression value, moved from [-1, 1] to [0, 1]."""
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers a landmark

    def start():
        kernels = Kernels(shared.value.landmarks)
        names, coefficients = np.array(shared.value.languages, object), shared.value.coefficients

        def work(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            texts = frame["text"].tolist()
            k = kernels.batch(texts)
            spoken = kernels.present[:len(texts)].any(axis=1)
            values = k @ coefficients
            best = values.argmax(axis=1)
            score = np.clip((values[np.arange(len(texts)), best] + 1) / 2, 0.0, 1.0)
            yield pd.DataFrame({"lang_pred": np.where(spoken, names[best], UNKNOWN), "score": np.where(spoken, score, 0.0)})

        return work

    return beside(docs, ["doc_id"], ["text"], start, "lang_pred string, score double", rows=BATCH)


@corpus_query("op13_language")
def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs))
    return found.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")
