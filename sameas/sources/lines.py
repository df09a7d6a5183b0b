"""Text files too large for one task, read in splits although a line's number or the
record it belongs to depends on what stands before.

Spark cuts files at line ends. What a split does to what follows it is little: how many
lines it holds, and whether it ends inside a quoted field, for either way it can begin. So
one pass sums up the splits, these few rows are put in order file by file, and a second
pass numbers lines or assembles records in parallel. Only records that lie across splits meet again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# A field is quoted, with quotes doubled inside, or has no quote at its beginning.
QUOTED = rb'"(?:[^"]|"")*"(?!")[^,]*'
FIELD = rb'(?:' + QUOTED + rb'|[^",][^,]*|)'
WHOLE = re.compile(FIELD + rb'(?:,' + FIELD + rb')*')
REST = re.compile(rb'(?:[^"]|"")*"(?!")[^,]*(?:,' + FIELD + rb')*')


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): raw lines; block is where the line's split begins."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                        F.col("value").cast("binary").alias("value"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes], bool]]:
    """(file, block, some lines in order, whether a split begins)."""
    now = None
    for batch in batches:
        files, blocks, values = (batch.column(i).to_pylist() for i in range(3))
        start = 0
        for at in range(1, len(files) + 1):
            if at == len(files) or (files[at], blocks[at]) != (files[start], blocks[start]):
                key = (files[start], blocks[start])
                yield *key, values[start:at], key != now
                now, start = key, at


def _inside(line: bytes, inside: bool) -> bool:
    """Whether a line ends in a quoted field."""
    if b'"' not in line:
        return inside
    return (REST if inside else WHOLE).fullmatch(line) is None


def _summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per split: lines, and for a split that begins outside or inside a field: how it
    ends and how many records end in it; whether it is UTF-8."""
    def row(key, state):
        return pa.RecordBatch.from_pylist([{"file": key[0], "block": key[1], "lines": state["lines"], "end0": state["ends"][0], "end1": state["ends"][1],
                                            "records0": state["records"][0], "records1": state["records"][1], "utf8": state["utf8"]}],
                                          schema=SUMMARY)

    key, state = None, None
    for file, block, lines, begins in _by_split(batches):
        if begins:
            if state:
                yield row(key, state)
            key, state = (file, block), {"lines": 0, "ends": [False, True], "records": [0, 0], "utf8": True}
        state["lines"] += len(lines)
        for line in lines:
            for way in (0, 1):
                state["ends"][way] = _inside(line, state["ends"][way])
                state["records"][way] += not state["ends"][way]
            if state["utf8"] and not line.isascii():
                try:
                    line.decode()
                except UnicodeDecodeError:
                    state["utf8"] = False
    if state:
        yield row(key, state)


SUMMARY = pa.schema([("file", pa.string()), ("block", pa.int64()), ("lines", pa.int64()), ("end0", pa.bool_()), ("end1", pa.bool_()),
                     ("records0", pa.int64()), ("records1", pa.int64()), ("utf8", pa.bool_())])


def _splits(lines: DataFrame) -> DataFrame:
    """(file, block, first_line, inside, first_record, utf8) of every split; the rows of
    a file, one for each of its splits, are put in order together."""
    def ordered(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", ignore_index=True)
        inside, record, line, out = False, 0, 0, []
        for x in rows.itertuples():
            out.append((x.file, x.block, line, inside, record, x.utf8))
            line += x.lines
            record += x.records1 if inside else x.records0
            inside = bool(x.end1 if inside else x.end0)
        return pd.DataFrame(out, columns=["file", "block", "first_line", "inside", "first_record", "utf8"])

    found = lines.mapInArrow(_summed_up, "file string, block bigint, lines bigint, end0 boolean, end1 boolean, records0 bigint, records1 bigint, utf8 boolean")
    return found.groupBy("file").applyInPandas(ordered, "file string, block bigint, first_line bigint, inside boolean, first_record bigint, utf8 boolean")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): every line with its number in its file, from 0."""
    lines = _lines(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for file, block, values, begins in _by_split(batches):
            number = 0 if begins else number
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(values)), pa.array([block] * len(values), pa.int64()),
                                              pa.array(range(number, number + len(values)), pa.int64()), pa.array(values, pa.binary())],
                                             ["file", "block", "at", "value"])
            number += len(values)

    counted = lines.mapInArrow(run, "file string, block bigint, at bigint, value binary")
    # a row for each split of the files
    starts = F.broadcast(_splits(lines).select("file", "block", "first_line"))
    return counted.join(starts, ["file", "block"]).select("file", (F.col("first_line") + F.col("at")).alias("line"),
                                                          F.col("value").cast("string").alias("value"))


def csv_records(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """((file, record, text), encoding): the records of CSV files, line breaks inside
    quotes and all, with their number in the file. One invalid byte anywhere makes all of it Latin-1."""
    lines = _lines(spark, path)
    splits = _splits(lines).persist()       # a row for each split of the files
    encoding = "UTF-8" if splits.filter("not utf8").isEmpty() else "ISO-8859-1"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [(), (), (), (), ()]
        names = ["file", "block", "record", "whole", "text"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        held, record, inside, head, key, size = [], 0, False, False, None, 0
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else columns, types)], names)

        def told(whole: bool) -> None:
            out.append((*key, record, whole, b"\n".join(held).decode(encoding)))

        for batch in batches:
            files, blocks, values, firsts, begins = (batch.column(i).to_pylist() for i in range(5))
            for file, block, line, first, within in zip(files, blocks, values, firsts, begins):
                if (file, block) != key:
                    if held:
                        told(False)
                    held, record, inside, head, key = [], first, within, within, (file, block)
                held.append(line)
                size += len(line)
                inside = _inside(line, inside)
                if not inside:
                    told(not head)
                    held, record, head = [], record + 1, False
                if len(out) >= 5000 or size > 4_000_000:
                    yield flushed()
                    out, size = [], 0
        if held:
            told(False)
        yield flushed()

    begun = lines.join(F.broadcast(splits.select("file", "block", "first_record", "inside")), ["file", "block"]).select(
        "file", "block", "value", "first_record", "inside")
    found = begun.mapInArrow(run, "file string, block bigint, record bigint, whole boolean, text string")
    pieces = F.array_sort(F.collect_list(F.struct("block", "text")))["text"]
    across = found.filter("not whole").groupBy("file", "record").agg(F.array_join(pieces, "\n").alias("text"))
    return found.filter("whole").select("file", "record", "text").unionByName(across), encoding
