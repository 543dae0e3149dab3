"""Batches that appear as a whole, once, or not at all.

Rows are staged in a folder of their own; a numbered commit record, created only if that number is still free, makes
them visible. Readers read the staged folders that commit records name. So a batch that failed half way is not seen, a
batch that is sent again after it was committed changes nothing, and a replaced table is never seen empty.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from py4j.protocol import Py4JJavaError

COMMITS, STAGED = "_commits", "staged"
MODES = ("append", "replace")


@dataclass(frozen=True)
class Commit:
    number: int
    batch: str
    mode: str
    folder: str


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file; False when it is there already."""
    fs, where = _fs(spark, path)
    try:
        out = fs.create(where, False)
    except Py4JJavaError as refused:
        if fs.exists(where):
            return False
        raise refused
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    return True


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, where = _fs(spark, f"{root}/{COMMITS}")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def commits(spark: SparkSession, root: str) -> list[Commit]:
    """All commits in order, each batch once. A record without its closing line was never finished and does not count."""
    root = root.rstrip("/")
    numbers = _numbers(spark, root)
    if not numbers:
        return []
    # the first line counts, whatever a record that was cut off holds; one row per batch
    lines = spark.read.text(f"{root}/{COMMITS}/*.json", wholetext=True).selectExpr("_metadata.file_name as name", "value").collect()
    found, seen = [], set()
    for name, value in sorted((r.name, r.value) for r in lines):
        if not value.endswith("}\n"):
            continue
        record = json.loads(value)
        if record["batch"] not in seen:
            seen.add(record["batch"])
            found.append(Commit(int(name[:-5]), record["batch"], record["mode"], record["folder"]))
    return found


def commit_batch(df: DataFrame, root: str, batch: str, mode: str = "append") -> bool:
    """Add ``df`` as ``batch``, or with ``replace`` put it in the place of all batches before it.

    False when the batch was committed before: nothing is written then. Of two writers that send one batch at the same
    time, the first commit counts.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark, root = df.sparkSession, root.rstrip("/")
    if any(c.batch == batch for c in commits(spark, root)):
        return False
    folder = uuid.uuid4().hex
    df.write.parquet(f"{root}/{STAGED}/{folder}")
    record = json.dumps({"batch": batch, "mode": mode, "folder": folder}) + "\n"
    number = max(_numbers(spark, root), default=0) + 1
    while not _write_new(spark, f"{root}/{COMMITS}/{number:012d}.json", record):
        number += 1
    return any(c.folder == folder for c in commits(spark, root))


def visible(spark: SparkSession, root: str) -> list[Commit]:
    """Commits that make up the table: the last replacement and everything behind it."""
    found = commits(spark, root)
    last = max((i for i, c in enumerate(found) if c.mode == "replace"), default=0)
    return found[last:]


def read_batches(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of all visible batches; no commit gives an empty table."""
    root = root.rstrip("/")
    paths = [f"{root}/{STAGED}/{c.folder}" for c in visible(spark, root)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete staged folders that no reader can see; how many. Only while nobody writes or reads an older state."""
    root = root.rstrip("/")
    kept = {c.folder for c in visible(spark, root)}
    fs, where = _fs(spark, f"{root}/{STAGED}")
    if not fs.exists(where):
        return 0
    gone = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName() not in kept]
    for path in gone:
        fs.delete(path, True)
    return len(gone)
