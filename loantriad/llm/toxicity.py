"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A document is a bag of sentences. A sentence's score is sigmoid(bias + sum of the weights of its features); the
document's score is 1 - prod(1 - sentence score). Training minimises the log loss of document labels, so blame settles
on the sentences that explain it; ``locate`` returns those. Features are the hashed words and their beginnings (four
and five letters), each once a sentence. A word's weight is the sum over its features, so scoring looks up one number
per word.

Only features with clear evidence (see ``telling``) get a weight. Training uses at most ``TRAIN_DOCS`` labelled documents (those with the smallest hash of their id; equal texts
count once), read whole; executors turn them into arrays of hashes, choose the features with
evidence and drop the rest, and the fit, a few dozen Adagrad passes over what remains, is one small numpy loop. Scoring reads every whole text.

Defined results: null or empty text is one empty sentence (score of the bias); rows with a null doc_id or label are not
learned from; a document labelled twice counts as toxic if any label says so; repeated rows get equal scores; without
labels of both classes every score is 0; an empty table gives an empty table. Only doc_id and text of the documents are
read, whatever else they hold.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from loantriad.llm.common import CACHE_WORDS, beside, table
from loantriad.llm.registry import corpus_query
from loantriad.session import materialise

TRAIN_DOCS = 12_000
BUCKETS = 1 << 18
PASSES = 150
RATE = 1.0
DECAY = 0.01
BIAS = -9.0
MIN_TOXIC = 3
FALSE_FEATURES = 2.0
MIN_LIFT = 3.0
THRESHOLD = 0.3

SENTENCE_END = re.compile(r"[.!?\n]+")
WORD = re.compile(r"[^\W_]+")


def features(word: str) -> set[int]:
    """Hashed word and its beginnings; markers keep the kinds apart."""
    names = [f"w:{word}", *(f"{n}:{word[:n]}" for n in (4, 5) if len(word) >= n)]
    return {zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS for name in names}


def sentences(text: str | None) -> Iterator[tuple[int, int]]:
    """(start, end) of each sentence that isn't empty; the whole text if there is none."""
    text = text or ""
    begin, found = 0, False
    for gap in SENTENCE_END.finditer(text):
        if gap.start() > begin:
            found = True
            yield begin, gap.start()
        begin = gap.end()
    if begin < len(text) or not found:
        yield begin if begin < len(text) else 0, len(text)


def _bag(text: str) -> tuple[list[int], list[int]]:
    """Feature hashes of all sentences, and how many each sentence has."""
    ids, sizes = [], []
    for a, b in sentences(text):
        found = set(WORD.findall(text[a:b].lower()))
        hashes = set().union(*map(features, found)) if found else set()
        ids.extend(hashes)
        sizes.append(len(hashes))
    return ids, sizes


def _bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        bags = [_bag(text or "") for text in frame["text"]]
        yield pd.DataFrame({
            "doc_id": frame["doc_id"], "toxic": frame["toxic"], "ids": [np.array(i, np.int32) for i, _ in bags],
            "sizes": [np.array(s, np.int32) for _, s in bags]})


def _only(used: np.ndarray):
    """Leaves the features ``used`` in the bags."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = np.zeros(BUCKETS, bool)
        wanted[used] = True
        for frame in frames:
            ids, sizes = [], []
            for i, s in zip(frame["ids"], frame["sizes"]):
                keep = wanted[np.asarray(i, np.int64)]
                sentence = np.repeat(np.arange(len(s)), s)
                ids.append(np.asarray(i, np.int32)[keep])
                sizes.append(np.bincount(sentence[keep], minlength=len(s)).astype(np.int32))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "toxic": frame["toxic"], "ids": ids, "sizes": sizes})

    return run


BAGS = "doc_id long, toxic int, ids array<int>, sizes array<int>"


def fold(doc_id):
    """crc32 of the id as text, modulo 4; fold 2 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def word(self, word: str) -> float:
        return float(sum(self.weights[i] for i in features(word)))


def train_rows(docs: DataFrame, labels: DataFrame, held_out: int | None = 2, most: int = TRAIN_DOCS) -> pd.DataFrame:
    """Bags of the bounded training sample."""
    marks = labels.where("doc_id is not null and toxic is not null").select("doc_id", "toxic")
    if held_out is not None:
        marks = marks.where(fold(F.col("doc_id")) != held_out)
    marks = marks.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = marks.orderBy(*order).limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most ``most`` ids
    rows = rows.dropDuplicates(["doc_id"]).withColumn("same", F.xxhash64("text")).dropDuplicates(["same", "toxic"]).drop("same")
    bags = materialise(rows.mapInPandas(_bags, BAGS), "bags")
    used = np.array([r[0] for r in telling(bags).collect()], np.int64)  # at most BUCKETS numbers
    return bags.mapInPandas(_only(used), BAGS).toPandas().sort_values("doc_id", ignore_index=True)


def telling(bags: DataFrame) -> DataFrame:
    """Features in at least MIN_TOXIC toxic documents that occur there MIN_LIFT times as often as without a link to the
    label, and whose G statistic is so large that chance would bring about FALSE_FEATURES of them.

    Rare features are as many as the documents' own words; left in, they would explain any label.
    """
    counts = bags.select("toxic", F.explode(F.array_distinct("ids")).alias("feature")).groupBy("feature").agg(
        F.sum("toxic").cast("double").alias("toxic"), F.count("*").cast("double").alias("n"))
    share = bags.agg(F.avg("toxic").alias("share")).scalar()
    toxic, clean = F.col("toxic"), F.col("n") - F.col("toxic")
    expected = F.col("n") * share
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g = 2 * (part(toxic, expected) + part(clean, F.col("n") - expected))
    counts = materialise(counts.where(F.col("n") >= MIN_TOXIC), "feature-counts")
    tried = counts.agg(F.greatest(F.count("*"), F.lit(1)).alias("m")).scalar()
    return counts.where((toxic >= MIN_TOXIC) & (toxic >= MIN_LIFT * expected) & (F.exp(-g / 2) * tried <= FALSE_FEATURES)).select("feature").orderBy("feature")


def fit(bags: pd.DataFrame, passes: int = PASSES) -> Model | None:
    """Noisy-or fit by Adagrad; None without both classes."""
    if bags.empty or bags["toxic"].nunique() < 2:
        return None
    ids = np.concatenate([np.asarray(i, np.int64) for i in bags["ids"]])
    sizes = [np.asarray(s, np.int64) for s in bags["sizes"]]
    sentence_of = np.repeat(np.arange(sum(map(len, sizes))), np.concatenate(sizes))
    doc_of = np.repeat(np.arange(len(sizes)), [len(s) for s in sizes])
    n_sentences, n_docs = len(doc_of), len(sizes)
    y = bags["toxic"].to_numpy(float)
    used, ids = np.unique(ids, return_inverse=True)
    w, bias, seen, seen_bias = np.zeros(len(used)), BIAS, np.full(len(used), 1e-3), 1e-3
    for _ in range(passes):
        z = np.clip(bias + np.bincount(sentence_of, w[ids], n_sentences), -30, 30)
        s = 1 / (1 + np.exp(-z))
        log_clean = np.bincount(doc_of, np.log1p(-np.minimum(s, 1 - 1e-12)), n_docs)
        p = np.clip(-np.expm1(log_clean), 1e-9, 1 - 1e-9)
        # d loss / d z: clean documents push each sentence by its score, toxic ones pull by score * (1 - p) / p
        pull = np.where(y > 0, -(1 - p) / p, 1.0) / n_docs
        g = s * pull[doc_of]
        grad = np.bincount(ids, g[sentence_of], len(used)) + DECAY * w / n_docs
        g_bias = g.sum()
        seen += grad ** 2 * n_docs ** 2
        seen_bias += (g_bias * n_docs) ** 2
        w -= RATE * grad * n_docs / np.sqrt(seen)
        bias -= RATE * 0.1 * g_bias * n_docs / math.sqrt(seen_bias)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    return Model(weights, float(bias))


class Scorer:
    """Scores texts; word weights are remembered between batches."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def sentence(self, words: set[str]) -> float:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        total = self.model.bias
        for word in sorted(words):
            weight = self.known.get(word)
            if weight is None:
                weight = self.known[word] = self.model.word(word)
            total += weight
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

    def document(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or of the sentences, and each sentence's place and score."""
        text, clean, parts = text or "", 1.0, []
        for a, b in sentences(text):
            s = self.sentence(set(WORD.findall(text[a:b].lower())))
            clean *= 1 - s
            parts.append((a, b, s))
        return 1 - clean, parts


SCORED = "score double, predicted int, offending array<struct<start:int,end:int,score:double>>"


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted and the offending sentences (score of their own >= threshold) of every row."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"),
                           F.array().cast("array<struct<start:int,end:int,score:double>>").alias("offending"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def start():
        scorer = Scorer(shared.value)

        def run(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            found = [scorer.document(text) for text in frame["text"]]
            yield pd.DataFrame({
                "score": [s for s, _ in found], "predicted": [int(s >= threshold) for s, _ in found],
                "offending": [[{"start": a, "end": b, "score": x} for a, b, x in parts if x >= threshold] for _, parts in found],
            })

        return run

    return beside(docs, ["doc_id"], ["text"], start, SCORED)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, fit(train_rows(docs, labels)), threshold)


@corpus_query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted",
                         F.size("offending").alias("n_offending"))
