"""Session settings, the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20


def build_session(app: str = "loantriad", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library relies on; anything can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per session, so that Python tasks can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_loantriad_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="loantriad-ship-"), "loantriad.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("loantriad", os.path.relpath(path, root)))
    sc.addPyFile(archive)
    sc._loantriad_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach. Only a local master may fall back to a temp folder."""
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="loantriad-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _stored(spark).append(path)
    return path


def _stored(spark: SparkSession) -> list[str]:
    """Paths that this session has stored tables under."""
    sc = spark.sparkContext
    if not hasattr(sc, "_loantriad_stored"):
        sc._loantriad_stored = []
    return sc._loantriad_stored


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables stored by this session (from the ``since``-th on). Frames that read them are void then."""
    paths = _stored(spark)
    for path in paths[since:]:
        _delete(spark, path)
    del paths[since:]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables stored inside the block go at its end: write or collect results before."""
    since = len(_stored(spark))
    try:
        yield
    finally:
        release(spark, since)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of a query that runs inside the block go at its end, not whenever the driver next collects garbage."""
    before = spark.conf.get(CLEANUP_KEY)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_KEY, before)


def materialise(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Cut lineage by writing parquet to the shared folder: survives executor loss, keeps pruning. ``free`` deletes the write's
    shuffle files at its end; it sets the session meanwhile, so not from several threads."""
    path = scratch_path(df.sparkSession, name)
    with freed_shuffles(df.sparkSession) if free else nullcontext():
        df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._loantriad_path = path
    return stored


def is_stored(df: DataFrame) -> bool:
    """Whether a table of ``materialise`` is still there."""
    return df._loantriad_path in _stored(df.sparkSession)


def drop(*stored: DataFrame) -> None:
    """Delete tables that ``materialise`` stored, once all that was made of them is stored itself."""
    for df in stored:
        spark, path = df.sparkSession, df._loantriad_path
        _delete(spark, path)
        _stored(spark).remove(path)


#: Nodes of a logical plan whose work is not worth repeating.
COSTLY = frozenset(
    "Join AsOfJoin Aggregate Window Repartition RepartitionByExpression RebalancePartitions Sort Distinct Deduplicate Intersect "
    "Except MapInPandas MapInArrow FlatMapGroupsInPandas FlatMapGroupsInArrow FlatMapCoGroupsInPandas ArrowEvalPython "
    "BatchEvalPython".split())


def _nodes(plan) -> Iterator[str]:
    yield plan.nodeName()
    below = plan.children()
    for i in range(below.size()):
        yield from _nodes(below.apply(i))


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """A table that is cheap to read again, for operators that need several passes.

    Scans with filters and projections are left as they are (each pass prunes for itself); a plan with
    a join, an aggregate or Python work is stored once.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    return materialise(df, name) if any(node in COSTLY for node in _nodes(plan)) else df


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a stored table that is too small to fill them; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only when it has at most ``max_rows`` rows of ``max_bytes`` together; else join by shuffle.

    Rows come to the driver one by one and no longer than both limits hold.
    """
    rows, size = [], 0
    for row in df.limit(max_rows + 1).toLocalIterator():
        rows.append(row)
        size += sum(len(v) if isinstance(v, (str, bytes, bytearray)) else 16 for v in row)
        if len(rows) > max_rows or size > max_bytes:
            return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
