"""Token ids in ORC: stripes of run-length encoded integers, row indexes and Bloom filters on document ids.

Documents are dealt into ranges of doc_id (and, for one id, of beginnings of texts) and sorted inside, each range encoded in order and written as one file or
more. A row holds doc_id, the range's number, the ids of the range before the row, their count and the ids (ORC packs
integers by run length itself). Files are split by stripe for parallel reads; doc_id has min / max statistics per
stripe and per ``ROW_INDEX`` rows and a Bloom filter, so a lookup by id skips most stripes without decoding them.
The place of a document among all ids is the total of earlier ranges, one small row each, plus its place in the range.

Chunks of text are encoded by the tokenizers library, each distinct chunk once per worker and cache filling.

Defined results: null or empty text has only the end id; rows with the same doc_id keep all their ids, in an order that
depends on the text alone; a null doc_id comes first; an empty table writes no rows and reads back none. Only doc_id
and text are read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loantriad.llm.bpe import ChunkCounter, ChunkEncoder, file_text
from loantriad.llm.common import CACHE_WORDS, table, vocabulary_path
from loantriad.llm.registry import corpus_query
from loantriad.session import scratch_path

END_ID = 0
STRIPE_BYTES = 16 << 20
ROW_INDEX = 1_000
BLOOM_FPP = 0.01
BATCH_ROWS = 256

_ENCODERS: dict[tuple[int, bool], ChunkEncoder] = {}


#: One of these after a word of letters is a token by itself.
SIGNS = ".,;:!?"
#: Beyond these letters, libraries may differ in what they call one.
_FAR = re.compile("[^\x00-\u024f]")


def _is_word(c: str) -> bool:
    return len(c) > 1 and c[1:].isalpha() and (c[0] == " " or c[0].isalpha()) and not _FAR.search(c)


def packed_ids(encoding) -> bytes:
    return array("I", encoding.ids).tobytes()


def library_chunks(tokenizer, pack: Callable = packed_ids) -> Callable[[list[str]], list]:
    """Encodes chunks through the tokenizers library; words are remembered, with or without a sign after them.
    ``pack`` is what is kept of an encoding: its ids, or with ``len`` their number."""
    signs = {s: pack(tokenizer.encode(s, add_special_tokens=False)) for s in SIGNS}
    words: dict = {}  # half of the cache; when it is full it becomes the older half
    older: dict = {}

    def encode(chunks: list[str]) -> list:
        nonlocal words, older
        heads = [c[:-1] if c[-1] in signs and _is_word(c[:-1]) else c for c in chunks]
        new = {h for h in heads if h not in words}
        if len(words) + len(new) > CACHE_WORDS // 2:
            words, older = {}, words
            new = set(heads)
        if older:
            words.update({h: older[h] for h in new & older.keys()})
            new -= words.keys()
        new = list(new)
        words.update(zip(new, map(pack, tokenizer.encode_batch_fast(new, add_special_tokens=False))))
        return [words[h] if len(h) == len(c) else words[h] + signs[c[-1]] for c, h in zip(chunks, heads)]

    return encode


def library_encoder(content: str, counts: bool = False) -> ChunkEncoder:
    """This worker's encoder, or counter of ids; kept between tasks."""
    key = hash(content), counts
    if key not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        _ENCODERS[key] = ChunkCounter(special, library_chunks(tokenizer, len)) if counts else ChunkEncoder(special, library_chunks(tokenizer))
    return _ENCODERS[key]


ROWS = "doc_id long, part int, before long, n_tokens long, ids array<int>"


def encode_sorted(docs: DataFrame, path: str) -> DataFrame:
    """ROWS in ascending doc_id order within and between partitions."""
    content = docs.sparkSession.sparkContext.broadcast(file_text(path))  # a vocabulary file
    # rows of one hot id are spread by how their texts begin, which is in the order of the texts
    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id", F.substring("text", 1, 64))
    sorted_docs = ranged.sortWithinPartitions("doc_id", "text")
    end = int(END_ID).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = library_encoder(content.value), TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                ids = [i + end for i in encoder.batch(batch.column("text").to_pylist())]
                sizes = [len(i) // 4 for i in ids]
                offsets, starts = [0], []
                for n in sizes:
                    starts.append(before)
                    before += n
                    offsets.append(offsets[-1] + n)
                values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(ids))])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()),
                    pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values),
                ], ["doc_id", "part", "before", "n_tokens", "ids"])

    return sorted_docs.mapInArrow(run, ROWS)


def write(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Encode and write; a lost task is run again and gives the same file."""
    (encode_sorted(docs, tokenizer_path).write
     .option("orc.compress", "ZSTD").option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", ROW_INDEX)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", BLOOM_FPP).orc(path))


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids. ``doc_ids`` reads only stripes that may hold them."""
    rows = spark.read.schema(ROWS).orc(path)
    ranges = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per written range
    bases = ranges.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    return rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """``read`` with the ids replaced by their crc32 as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            data = memoryview(lists.values.buffers()[1]) if len(lists) else b""
            shift = lists.values.offset
            bounds = [4 * (shift + o) for o in lists.offsets.to_pylist()]
            sums = [zlib.crc32(data[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


@corpus_query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), path, vocabulary_path("byte_bpe_50k.json"))
    return checksums(read(spark, path))
