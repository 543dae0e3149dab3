"""What the corpus operators share: tables, words, hashes of words, tokenizer files."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Space and the five ASCII controls that end a word; everything else belongs to words.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Words kept in a worker's memory between batches; the cache starts anew when it is full.
CACHE_WORDS = 400_000
#: Characters of texts that are cut into words at once.
BATCH_CHARS = 400_000

_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words; ``bytes.split`` cuts at exactly the characters of WORD_GAP."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def slices(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, some BATCH_CHARS characters at a time; a longer text is one by itself."""
    some, size = [], 0
    for text in texts:
        n = len(text or "")
        if some and size + n > BATCH_CHARS:
            yield some
            some, size = [], 0
        some.append(text)
        size += n
    if some:
        yield some


class WordHashes(dict):
    """64-bit hash per word, remembered; the same in every process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), _U, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` consecutive words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, _U)
    out = np.zeros(n, _U)
    for i in range(width):
        out = out * _U(0x9E3779B97F4A7C15) + h[i:i + n]
    return mix(out)


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's file lies; operators take the path as an argument."""
    import public_tokenizers

    return public_tokenizers.path(name)


def beside(docs: DataFrame, keep: list[str], take: list[str], start: Callable, added: str, rows: int | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` beside the ``added`` columns that Python makes of the ``take`` columns.

    ``keep`` never leaves Arrow: in pandas a null would turn all large integers beside it into doubles. ``start()`` runs
    once a task and returns a function from a frame of ``take`` (at most ``rows`` rows) to frames of ``added``, one row for
    each row it got; or any number of rows, with the place of the row that each came from in a column ``at``.
    """
    source = docs.select(*dict.fromkeys([*keep, *take]))
    fields = StructType.fromDDL(added)
    schema = StructType([*(source.schema[k] for k in keep), *fields])
    made_schema, names = to_arrow_schema(fields), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for whole in batches:
            for first in range(0, whole.num_rows, rows or max(whole.num_rows, 1)):
                batch = whole.slice(first, rows)
                for frame in work(batch.select(take).to_pandas()):
                    kept = [batch.column(k) for k in keep]
                    if "at" in frame:
                        at = pa.array(frame.pop("at"), pa.int64())
                        kept = [k.take(at) for k in kept]
                    made = pa.RecordBatch.from_pandas(frame, made_schema, preserve_index=False)
                    yield pa.RecordBatch.from_arrays([*kept, *made.columns], names)

    return source.mapInArrow(run, schema)


def row_by_row(fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable:
    """A ``start`` of ``beside`` for a function that needs nothing of its own."""
    return lambda: lambda frame: iter([fn(frame)])
