"""Quoted CSV read by many tasks, and batches that appear once."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from loantriad.sources import batches as ba
from loantriad.sources import records as rc

CELLS = ["a", "", '"two\nlines"', '"a ""quoted"" word"', '"x,y"', 'in"ner', '""', '"end""\n"', " lead", '"\r\n"', '"late" tail', "5\" wide", '"""\n"""']
SCHEMA = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(4)])


def one_task(spark, path):
    options = {"multiLine": True, "header": True, "enforceSchema": True, "escape": '"'}
    return spark.read.schema(SCHEMA).options(**options).csv(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed, size", [(1, 64), (2, 300), (3, 5000)])
def test_same_rows_as_one_task(spark, tmp_path, seed, size):
    """Ranges shorter than many records, so that quoted cells begin in one, cross others and end in another."""
    rng = random.Random(seed)
    for name in ("one.csv", "two.csv"):
        lines = ["h1,h2,h3,h4"] + [",".join(rng.choice(CELLS) for _ in range(rng.randint(1, 6))) for _ in range(400)]
        lines.insert(50, ",".join(['"' + "far\n" * 200 + '"'] * 2))
        (tmp_path / name).write_bytes("\n".join(lines).encode() + (b"\n" if seed % 2 else b""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        records = rc.read_records(spark, str(tmp_path))
        got = rows(rc.parse_records(records, SCHEMA))
        assert rc._lines(spark, str(tmp_path), "*.csv").rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == rows(one_task(spark, str(tmp_path)))


def test_windows_line_ends_empty_files_and_unclosed_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\r\nh,h\r\n1,"x\r\ny"\r\n\r\n2,b\r\n')
    (tmp_path / "b.csv").write_bytes(b"")
    (tmp_path / "c.csv").write_bytes(b"h\n")
    (tmp_path / "d.csv").write_bytes(b'h,h\n3,"open\nto the end')
    got = rows(rc.parse_records(rc.read_records(spark, str(tmp_path)), SCHEMA).select("c0", "c1"))
    assert got == [("1", "x\r\ny"), ("2", "b"), ("3", "open\nto the end")]


def test_ends_inside():
    cases = {'a,"b': True, 'a,"b"': False, 'a"b': False, '"a""': True, '"a"x,"': True, '"",""': False, "": False}
    assert {line: rc.ends_inside(line, False) for line in cases} == cases
    assert [rc.ends_inside(line, True) for line in ("a", 'a"', '""', 'a","', '"x"y')] == [True, False, True, True, False]


def test_batch_appears_once(spark, tmp_path):
    root = str(tmp_path / "table")
    df = spark.range(5)
    assert ba.read_batches(spark, root, "id long").count() == 0
    assert ba.commit_batch(df, root, "monday")
    assert not ba.commit_batch(df, root, "monday")
    broken = df.select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        ba.commit_batch(broken, root, "tuesday")
    assert ba.read_batches(spark, root, "id long").count() == 5
    assert ba.commit_batch(spark.range(5, 8), root, "tuesday")
    assert sorted(r.id for r in ba.read_batches(spark, root, "id long").collect()) == list(range(8))


def test_replacing_batch_and_unfinished_records(spark, tmp_path):
    root = str(tmp_path / "table")
    ba.commit_batch(spark.range(5), root, "a")
    (tmp_path / "table" / "_commits" / "000000000002.json").write_text('{"batch": "b", "mo')
    with pytest.raises(Exception, match="lost"):
        ba.commit_batch(spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("id")), root, "c", "replace")
    assert ba.read_batches(spark, root, "id long").count() == 5
    assert ba.commit_batch(spark.range(2), root, "c", "replace")
    assert ba.commit_batch(spark.range(2, 3), root, "d")
    assert [c.number for c in ba.commits(spark, root)] == [1, 3, 4]
    assert sorted(r.id for r in ba.read_batches(spark, root, "id long").collect()) == [0, 1, 2]
    assert ba.vacuum(spark, root) == 2  # batch a and what failed
    assert ba.read_batches(spark, root, "id long").count() == 3
    with pytest.raises(ValueError):
        ba.commit_batch(spark.range(1), root, "e", "upsert")


def test_lines_that_stay_outside_are_not_walked(monkeypatch):
    """The pattern tells the same lines as the walk, and only lines that open a quoted cell are walked."""
    rng = random.Random(7)
    lines = ["".join(rng.choice('",a\r ') for _ in range(rng.randint(0, 9))) for _ in range(20_000)]
    wanted = [i for i, line in enumerate(lines) if rc.ends_inside(line.removesuffix("\r"), False)]
    assert rc.open_lines(pa.array(lines)).tolist() == wanted
    walked, walk = [], rc.ends_inside
    monkeypatch.setattr(rc, "ends_inside", lambda line, inside: walked.append(line) or walk(line, inside))
    batch = pa.RecordBatch.from_pylist([{"file": "f", "start": 5, "value": v} for v in ['1,"a"', *['2,"b",c'] * 50, '3,"two', 'lines",d', *['4,"e"'] * 50]])
    assert [b.to_pylist() for b in rc._range_maps([batch])] == [[{"file": "f", "start": 5, "outside": False, "inside": False}]]
    assert len(walked) < 10
    walked.clear()
    out = [r for b in rc._assemble({})([batch]) for r in b.to_pylist()]
    assert sorted(r["value"] for r in out) == sorted(['1,"a"', *['2,"b",c'] * 50, '3,"two\nlines",d', *['4,"e"'] * 50])
    assert {r["kind"] for r in out} == {"whole"} and len(walked) < 10
