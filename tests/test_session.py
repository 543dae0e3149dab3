"""Shipping the package, stored tables, and what counts as costly."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from loantriad import session as se

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from loantriad.session import build_session
spark = build_session("ship", "local[1]", **{{"spark.sql.shuffle.partitions": "2", "spark.python.worker.reuse": "false"}})
sys.path.remove({ROOT!r})

def where(frames):
    import loantriad.operators.ranks as module
    for frame in frames:
        yield frame.assign(path=module.__file__)

found = spark.range(3).mapInPandas(where, "id long, path string").collect()
print("shipped", len(found), all(".zip" in r.path for r in found))
spark.stop()
"""


def test_tasks_import_the_shipped_package(tmp_path):
    """From another folder, without PYTHONPATH: Python workers read the archive that the session sent."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "shipped 3 True" in done.stdout, done.stderr[-3000:]


def test_scratch_tables_go(spark, tmp_path):
    shared = se.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    with se.scratch(spark):
        assert se.materialise(spark.range(10), "kept").count() == 10
        assert len(set(os.listdir(shared)) - before) == 1
    assert set(os.listdir(shared)) == before


def test_settle_reads_plans_not_names(spark, tmp_path):
    path = str(tmp_path / "Join-Sort-Window")
    spark.range(5).select(F.col("id").alias("Aggregate")).write.parquet(path)
    plain = spark.read.parquet(path).where("Aggregate > 1")
    assert se.settle(plain) is plain
    assert se.settle(plain.groupBy("Aggregate").count()) is not plain.groupBy("Aggregate").count()
    stored = len(se._stored(spark))
    se.settle(plain.distinct())
    assert len(se._stored(spark)) == stored + 1


def test_small_side_counts_bytes(spark):
    long_texts = spark.range(20).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert se.small_side(long_texts, max_bytes=5_000) is long_texts
    assert "ResolvedHint" in se.small_side(long_texts)._jdf.queryExecution().analyzed().toString()


def test_freed_shuffles_hold_for_the_block_only(spark):
    before = spark.conf.get(se.CLEANUP_KEY)
    with se.freed_shuffles(spark):
        assert spark.conf.get(se.CLEANUP_KEY) == "true"
    assert spark.conf.get(se.CLEANUP_KEY) == before
    counts = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    assert se.materialise(counts, "freed", free=True).count() == 7 and spark.conf.get(se.CLEANUP_KEY) == before
    assert counts.count() == 7
