"""Records of quoted CSV files, read by many tasks although a quoted cell may hold line breaks.

The text source deals byte ranges of a file to tasks and gives every line to the range it starts in. A line starts
either outside or inside a quoted cell, and each range maps one to the other. So a first pass finds that map for
every range with quotes, the maps are chained along the file, and a second pass starts every range in its true state.
A record that crosses ranges is put together from its pieces, at most two of which come from one range.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

QUOTE, DELIMITER = '"', ","


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open behind ``line``, which starts inside a quoted cell or at a record's begin.

    A quote opens a cell at the cell's begin only; a doubled quote is text; behind the closing quote the cell
    lasts to the next delimiter.
    """
    at, end = 0, len(line)
    while True:
        if not inside:
            if line.startswith(QUOTE, at):
                at, inside = at + 1, True
            else:
                at = line.find(DELIMITER, at)
                if at < 0 or line.find(QUOTE, at) < 0:
                    return False
                at += 1
                continue
        while True:
            at = line.find(QUOTE, at)
            if at < 0:
                return True
            if not line.startswith(QUOTE, at + 1):
                break
            at += 2
        at = line.find(DELIMITER, at)
        if at < 0 or at == end - 1:
            return False
        at, inside = at + 1, False


#: Lines that start and end outside a quoted cell, as ``ends_inside`` has it.
_CELL = r'(?:"(?:[^"]|"")*"(?:[^",][^,]*)?|[^",][^,]*|)'
CLOSED = rf"\A{_CELL}(?:,{_CELL})*\z"


def open_lines(values) -> np.ndarray:
    """Places of the lines that, started outside, end inside a quoted cell."""
    return np.flatnonzero(~pc.match_substring_regex(values, CLOSED).to_numpy(zero_copy_only=False))


def _lines(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).text(folder)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _by_range(batches):
    """(file, start, lines) in order; a range may come in several parts."""
    for batch in batches:
        at = 0
        files, starts, values = batch.column(0), batch.column(1), batch.column(2)
        while at < batch.num_rows:
            file, start = files[at], starts[at]
            same = pc.and_(pc.equal(files.slice(at), file), pc.equal(starts.slice(at), start))
            stop = pc.index(same, False).as_py()
            stop = batch.num_rows if stop < 0 else at + stop
            yield file.as_py(), start.as_py(), values.slice(at, stop - at)
            at = stop


def _range_maps(batches):
    """For every range with quotes: the state behind it after a start outside, and after a start inside."""
    key, after = None, (False, True)
    for file, start, values in _by_range(batches):
        if key != (file, start):
            if key:
                yield _map_row(key, after)
            key, after = (file, start), (False, True)
        opens, at = open_lines(values), 0
        while at < len(values):
            if after == (False, False):  # nothing happens before the next line that opens a cell
                place = np.searchsorted(opens, at)
                if place == len(opens):
                    break
                at = int(opens[place])
            line = values[at].as_py().removesuffix("\r")
            # states that have met stay together
            behind = {state: ends_inside(line, state) for state in set(after)}
            after = (behind[after[0]], behind[after[1]])
            at += 1
    if key:
        yield _map_row(key, after)


def _map_row(key, after):
    return pa.RecordBatch.from_pylist([{"file": key[0], "start": key[1], "outside": after[0], "inside": after[1]}])


def range_states(lines: DataFrame) -> DataFrame:
    """(file, start, state): whether a quoted cell is open behind the range. Ranges without quotes change nothing and are left out."""
    quoted = lines.where(F.contains("value", F.lit(QUOTE)))
    maps = quoted.mapInArrow(_range_maps, "file string, start long, outside boolean, inside boolean")
    along = Window.partitionBy("file").orderBy("start")  # one row per range
    fixed = F.col("outside") == F.col("inside")
    turns = (F.col("outside") & ~F.col("inside")).cast("int")
    since = Window.partitionBy("file", "_chain").orderBy("start")
    return (
        maps.withColumn("_chain", F.sum(fixed.cast("int")).over(along))
        .withColumn("_base", F.first(F.when(fixed, F.col("outside")).otherwise(F.lit(False))).over(since))
        .withColumn("_turns", F.sum(turns).over(since))
        .select("file", "start", ((F.col("_base").cast("int") + F.col("_turns")) % 2 == 1).alias("state"))
    )


RECORD_SCHEMA = "file string, start long, kind string, first boolean, value string"


def _assemble(states: dict[str, tuple[list[int], list[bool]]]):
    """Function for mapInArrow: records of a task's ranges, and the pieces of those that cross ranges."""

    def opened(file: str, start: int) -> bool:
        starts, behind = states.get(file, ((), ()))
        at = bisect_left(starts, start)
        return at > 0 and behind[at - 1]

    def run(batches):
        key = kind = None
        pieces: list[str] = []
        inside = first = False

        def rows(values, kinds, firsts, file, start):
            n = len(values)
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(kinds, pa.string()),
                 pa.array(firsts, pa.bool_()), pa.array(values, pa.string())], names=["file", "start", "kind", "first", "value"])

        def rest():
            # the range ends inside a record: its begin, or, if it began before the range as well, its middle
            return rows(["\n".join(pieces)], ["begin" if kind == "whole" else "more"], [first], *key)

        for file, start, values in _by_range(batches):
            if key != (file, start):
                if pieces:
                    yield rest()
                key, pieces, first = (file, start), [], start == 0
                inside = opened(file, start)
                kind = "more" if inside else "whole"
            if not inside and not first and not pc.any(pc.match_substring(values, QUOTE)).as_py():
                n = len(values)
                yield rows(values, ["whole"] * n, [False] * n, file, start)
                continue
            done, kinds, firsts = [], [], []
            opens, at, alone = open_lines(values), 0, np.zeros(len(values), bool)
            while at < len(values):
                if not inside and not first:  # lines up to the next one that opens a cell are records
                    place = np.searchsorted(opens, at)
                    stop = int(opens[place]) if place < len(opens) else len(values)
                    alone[at:stop] = True
                    at = stop
                    if at == len(values):
                        break
                line = values[at].as_py()
                at += 1
                if inside or QUOTE in line:
                    inside = ends_inside(line.removesuffix("\r"), inside)
                pieces.append(line)
                if not inside:
                    done.append("\n".join(pieces))
                    kinds.append(kind)
                    firsts.append(first)
                    pieces, kind = [], "whole"
                    first = first and done[-1] in ("", "\r")  # the header is the first line that is not empty
            if alone.any():
                n = int(alone.sum())
                yield rows(values.filter(pa.array(alone)), ["whole"] * n, [False] * n, file, start)
            if done:
                yield rows(done, kinds, firsts, file, start)
        if pieces:
            yield rest()

    return run


def read_records(spark: SparkSession, folder: str, pattern: str = "*.csv", header: bool = True) -> DataFrame:
    """One string ``value`` per CSV record, without its line end, empty lines and each file's header.

    Lines end in ``\\n`` or ``\\r\\n``. Of each range that holds a quote one number and one bit come to the driver and go
    to the tasks: less than the list of ranges that the driver plans the scan with. A quote that is never closed takes
    the rest of its file into one record, as in any CSV reader.
    """
    lines = _lines(spark, folder, pattern)
    states: dict[str, tuple[list[int], list[bool]]] = {}
    for row in range_states(lines).orderBy("file", "start").toLocalIterator():
        starts, behind = states.setdefault(row.file, ([], []))
        starts.append(row.start)
        behind.append(row.state)
    parts = lines.mapInArrow(_assemble(states), RECORD_SCHEMA)
    whole = parts.where("kind = 'whole'")
    if any(any(behind) for _, behind in states.values()):
        # a begin opens a record, the pieces up to the next begin belong to it
        along = Window.partitionBy("file").orderBy("start", "_place")
        crossing = parts.where("kind <> 'whole'").withColumn("_place", (F.col("kind") == "begin").cast("int"))
        crossing = crossing.withColumn("_record", F.sum("_place").over(along))
        joined = crossing.groupBy("file", "_record").agg(
            F.min("start").alias("start"), F.bool_or("first").alias("first"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]), "\n").alias("value"))
        whole = whole.select("first", "value").unionByName(joined.select("first", "value"))
    text = F.regexp_replace("value", r"\r\z", "")
    keep = text != ""
    return whole.where(keep & ~F.col("first") if header else keep).select(text.alias("value"))


def parse_records(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Cells by position: short records end in NULLs, extra cells are dropped."""
    cells: Column = F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {"escape": QUOTE, "multiLine": "true", "mode": "PERMISSIVE"})
    return records.select(cells.alias("_cells")).select("_cells.*")
