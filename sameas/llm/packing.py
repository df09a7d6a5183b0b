"""Texts of an Arrow batch as one byte array, so that numpy works on all of them at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

BLOCK_BYTES = 2_000_000      # texts worked on together; a longer text is a block of its own
BASE = np.uint64(0x9E3779B97F4A7C15)      # odd, so it has an inverse modulo 2**64
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, by exact spelling, whatever else the table holds
    (a second column that differs only in case would be ambiguous to Spark)."""
    at = [df.columns.index(name) for name in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(name) for i, name in zip(at, names)])


def fold_of(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts, F.lit(0))


def pack(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if lower:
        column = pc.utf8_lower(column)
    column = pc.fill_null(column.cast(pa.large_string()).cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if len(offsets) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges (first, last) of about `limit` bytes each."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def row_of(offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The row each byte place lies in."""
    return np.searchsorted(offsets, places, side="right") - 1


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of True; a run ends where its text ends."""
    if len(inside) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0] = edge[-1] = True
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    kept = inside[cuts[:-1]]
    return cuts[:-1][kept], cuts[1:][kept]


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, kept between calls."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK_BYTES // 8)
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                _powers[name] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base)])
    return _powers["up"][:n], _powers["down"][:n]


class SpanHash:
    """64-bit polynomial hashes of any byte ranges of one array."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
