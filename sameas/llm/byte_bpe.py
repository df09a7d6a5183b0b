"""Byte-level BPE encoding and decoding.

The pieces that the pattern cuts from a text are looked up among those the worker
has seen; the new ones of a block are sorted into length buckets and merged
together as padded matrices. A piece of over LONG bytes takes its lowest pair from
a heap instead, which keeps a text without a break from costing its length squared.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sameas.llm.merges import PAD, PairTable, merge_matrix, merge_one
from sameas.llm.packing import BLOCK_BYTES, blocks, pack, pick

VOCABULARY = "byte_bpe_50k.tiktoken"
LONG = 256               # bytes of a piece up to which it joins a matrix
BUCKETS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, LONG)
CACHED = 250_000         # pieces a worker remembers
ROWS = 16_384            # rows of a matrix at most
# The usual pattern in the standard library's terms. The two differ on signs beyond
# Latin, on numbers that are no digits and on the separators U+001C to U+001F, so texts with those keep the first form.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
UNUSUAL = re.compile("[\x1c-\x1f\x85\u00b2\u00b3\u00b9\u00bc-\u00be\u0250-\U0010ffff]").search


class Encoder:
    """Ids of texts under a rank file, and texts of ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.bytes_of[number] = token
        self.table = PairTable(vocabulary)
        self.single = np.array([vocabulary[bytes([b])] for b in range(256)], np.int32)
        self.find = regex.compile(pattern).findall
        self.find_plain = re.compile(PLAIN).findall if pattern == public_tokenizers.PATTERN else self.find
        self.known: dict[str, bytes] = {}
        self.cached = CACHED

    def cut(self, text: str) -> list[str]:
        return self.find(text) if UNUSUAL(text) else self.find_plain(text)

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces not seen before, by length bucket."""
        raw = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(lengths, kind="stable")
        lengths, first = lengths[order], 0
        for bucket in BUCKETS:
            last = int(np.searchsorted(lengths, bucket, side="right"))
            for start in range(first, last, ROWS):
                mine = order[start:min(start + ROWS, last)].tolist()
                coded = self._matrix([raw[i] for i in mine], lengths[start:start + len(mine)], bucket)
                self.known.update(zip([pieces[i] for i in mine], coded))
            first = last
        for i in order[first:].tolist():
            ids = merge_one(self.single[np.frombuffer(raw[i], np.uint8)].tolist(), self.table)
            self.known[pieces[i]] = np.asarray(ids, "<u4").tobytes()

    def _matrix(self, raw: list[bytes], lengths: np.ndarray, width: int) -> list[bytes]:
        ids = np.full((len(raw), width), PAD, np.int32)
        ids[np.arange(width)[None, :] < lengths[:, None]] = self.single[np.frombuffer(b"".join(raw), np.uint8)]
        done = merge_matrix(ids, self.table)
        packed = done[done >= 0].astype("<u4").tobytes()
        ends = (4 * np.cumsum((done >= 0).sum(axis=1))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.cut(text) for text in texts]
        seen = set().union(*cut) if cut else set()
        if len(self.known) + len(seen) > self.cached:
            self.known = {p: self.known[p] for p in seen if p in self.known}
        new = [p for p in seen if p not in self.known]
        if new:
            self.learn(new)
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per worker process."""
    return Encoder(path, pattern)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    data, offsets = pack(column)
    for first, last in blocks(offsets, BLOCK_BYTES):
        raw = data[offsets[first]:offsets[last]].tobytes()
        at = (offsets[first:last + 1] - offsets[first]).tolist()
        yield first, last, [raw[a:b].decode() for a, b in zip(at, at[1:])]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id",
           text_col: str = "text", ids: bool = False, cached: int = CACHED) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids array<bigint>]) of every whole text.
    A worker remembers the ids of about `cached` pieces.

    A null text counts as empty: no tokens, the digests of nothing. Rows are kept
    one by one, repeated ids included; other columns are not read. The path must
    name the vocabulary on every executor.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    pattern = pattern or public_tokenizers.PATTERN
    source = pick(docs, id_col, text_col)
    kind = source.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        tool.cached = cached
        for batch in batches:
            for first, last, texts in _texts(batch.column(1)):
                coded = tool.encode_block(texts)
                columns = [batch.column(0).slice(first, last - first), pa.array([len(c) // 4 for c in coded], pa.int64()),
                           pa.array([sha256(c).hexdigest() for c in coded], pa.string()),
                           pa.array([sha256(tool.decode(c)).hexdigest() for c in coded], pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.array([np.frombuffer(c, "<u4").astype(np.int64) for c in coded], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """(id, text binary) of arrays of ids; a null array gives no bytes."""
    path = path or public_tokenizers.path(VOCABULARY)
    pattern = pattern or public_tokenizers.PATTERN
    source = pick(encoded, id_col, ids_col)
    kind = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        for batch in batches:
            texts = [tool.decode(np.asarray(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], [id_col, "text"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, text binary")
