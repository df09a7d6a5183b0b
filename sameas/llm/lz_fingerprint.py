"""Lempel-Ziv phrase fingerprints: which phrases a document's own dictionary holds.

Each text is cut into symbols (up to WORD word bytes and one byte that follows them)
and parsed into LZ78 phrases: the longest phrase known so far plus one symbol is a
new phrase. The set of phrases is hashed and the SIZE smallest hashes are the
fingerprint; the share that two fingerprints have in common among the smallest of
their union estimates how much of the phrases they share, as compression distances do.

The next document by id is found without one task seeing all: ids are cut into
ranges, each range is sorted in its own task, and the first document of the range
below is sent along as a guest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sameas.llm.packing import SpanHash, pick

SIZE = 128              # hashes of 32 bits in a fingerprint
RANGE_ROWS = 2_000      # documents per range of ids
RANGES = 16_384         # ranges at most; cuts are quantiles of the ids


WORD = 12               # bytes of a symbol at most
FLUSH_BYTES = 1_000_000 # texts hashed together
cut_symbols = re.compile(rb"[0-9A-Za-z\x80-\xff]{1,%d}[^0-9A-Za-z\x80-\xff]?|[^0-9A-Za-z\x80-\xff]{1,%d}" % (WORD, WORD)).findall


def parse(symbols: list[bytes], root: dict, node: dict, at: int, log: list | None = None) -> tuple[dict, list[int]]:
    """Goes on with an LZ78 parse whose phrases are the trie `root`, inside phrase
    `node`, at symbol number `at`: the phrase begun at the end, and after which
    symbols phrases end. `log` gets what was added to the trie."""
    ends: list[int] = []
    for place, symbol in enumerate(symbols, at + 1):
        if symbol in node:
            node = node[symbol]
        else:
            node[symbol] = {}
            if log is not None:
                log.append((node, symbol))
            node = root
            ends.append(place)
    return node, ends


class Document:
    """A text, its phrases, and the parse's state where its edit begins.

    A symbol depends on the byte after it, so the edit's own symbols begin with the
    last one that touches the kept part's end."""

    __slots__ = ("row_id", "n_chars", "text", "data", "kept", "root", "node", "shared", "begin", "starts", "ends", "hashes")

    def __init__(self, row_id, text: str):
        self.row_id, self.text, self.n_chars = row_id, text, len(text)
        self.kept = len(text[:len(text) - len(text) // 3].encode())
        self.data = text.encode()
        symbols = cut_symbols(self.data)
        places = np.zeros(len(symbols) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, symbols), np.int64, len(symbols)), out=places[1:])
        fixed = int(np.searchsorted(places[1:], self.kept, side="left"))      # symbols that end before the edit
        self.begin, self.root, added = int(places[fixed]), {}, []
        self.node, ends = parse(symbols[:fixed], self.root, self.root, 0)
        self.shared = len(ends)
        _, more = parse(symbols[fixed:], self.root, self.node, fixed, added)
        for at, symbol in added:
            del at[symbol]
        self.starts, self.ends = phrase_bounds(places, ends + more, 0)
        self.hashes: np.ndarray | None = None

    def edit(self, other: Document) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The edited text, and (starts, ends) of its phrases after the shared ones. Uses the trie up."""
        head = other.text[:self.n_chars // 3].encode()
        edited = self.data[:self.kept] + head
        symbols = cut_symbols(edited[self.begin:])
        places = np.full(len(symbols) + 1, self.begin, np.int64)
        places[1:] += np.cumsum(np.fromiter(map(len, symbols), np.int64, len(symbols)))
        _, ends = parse(symbols, self.root, self.node, 0)
        self.root = self.node = None
        return edited, *phrase_bounds(places, ends, int(self.ends[self.shared - 1]) if self.shared else 0)


def phrase_bounds(places: np.ndarray, ends: list[int], first: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) in bytes of phrases that follow each other from `first` on; a
    phrase still open at the end of the text counts."""
    stops = places[ends] if ends else np.zeros(0, np.int64)
    if places[-1] > (stops[-1] if len(stops) else first):
        stops = np.append(stops, places[-1])
    return np.concatenate([[first], stops[:-1]]).astype(np.int64) if len(stops) else stops, stops


def span_hashes(texts: list[bytes], spans: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """32-bit hashes of byte ranges of many texts at once."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    shifts = np.cumsum([0, *map(len, texts)])
    starts = np.concatenate([s + at for (s, _), at in zip(spans, shifts)])
    ends = np.concatenate([e + at for (_, e), at in zip(spans, shifts)])
    hashes = (SpanHash(data)(starts.astype(np.int64), ends.astype(np.int64)) >> np.uint64(32)).astype(np.uint32)
    return np.split(hashes, np.cumsum([len(s) for s, _ in spans])[:-1])


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def smallest(hashes: np.ndarray) -> np.ndarray:
    """The SIZE smallest distinct values, ascending."""
    if len(hashes) > 8 * SIZE:      # phrases hardly ever share a hash
        low = _distinct(np.partition(hashes, 4 * SIZE)[:4 * SIZE])
        if len(low) >= SIZE:
            return low[:SIZE]
    return _distinct(hashes)[:SIZE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of both among the SIZE smallest of the union; 1 for two empty ones."""
    both = np.sort(np.concatenate([a, b]))
    if not len(both):
        return 1.0
    twice = np.flatnonzero(both[1:] == both[:-1])
    union = min(SIZE, len(both) - len(twice))
    last = _distinct(both)[union - 1]
    return int((both[twice] <= last).sum()) / union


def as_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def fingerprint(text: str) -> str:
    one = Document(None, text)
    return as_text(smallest(span_hashes([one.data], [(one.starts, one.ends)])[0]))


def compare(one: str, other: str) -> float:
    return likeness(from_text(one), from_text(other))


def results(pairs: list[tuple[Document, Document]]) -> list[tuple]:
    """A result row for each document and the next one."""
    fresh = list({id(d): d for pair in pairs for d in pair if d.hashes is None}.values())
    if fresh:
        for one, hashes in zip(fresh, span_hashes([d.data for d in fresh], [(d.starts, d.ends) for d in fresh])):
            one.hashes = hashes
    edits = [one.edit(other) for one, other in pairs]
    tails = span_hashes([e[0] for e in edits], [e[1:] for e in edits])
    rows = []
    for (one, other), (edited, _, _), tail in zip(pairs, edits, tails):
        own, following = smallest(one.hashes), smallest(other.hashes)
        changed = smallest(np.concatenate([one.hashes[:one.shared], tail]))
        rows.append((one.row_id, one.n_chars, sha256(edited).hexdigest(), as_text(own), as_text(changed),
                     likeness(own, changed), likeness(own, following)))
    return rows


def _ranges(ids: DataFrame, id_col: str) -> list[float]:
    """Cuts between ranges of ids with about RANGE_ROWS rows each, ascending."""
    parts = int(min(RANGES, max(1, ids.count() // RANGE_ROWS)))
    if parts == 1:
        return []
    wanted = [i / parts for i in range(1, parts)]
    return sorted({float(c) for c in ids.agg(F.percentile_approx(id_col, wanted, 20 * parts)).head()[0] or []})


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Fingerprints every whole text and its edited text: the last third (rounded down)
    of its code points replaced by the first as many, or all, of the next document's,
    by falling numeric id; after the last comes the first. near_edited is the likeness
    of the two, near_next that to the next document's fingerprint. A null text counts
    as empty, and two empty texts are alike (1.0). Rows that repeat an id follow each
    other by text. A row without an id, and a single document, is its own next.
    """
    source = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    known = source.select("id").filter(F.col("id").isNotNull())
    cuts = _ranges(known, "id")
    cutter = Bucketizer(splits=[float("-inf"), *cuts, float("inf")] if cuts else [float("-inf"), 0.0, float("inf")],
                        inputCol="number", outputCol="range")
    parted = lambda df: cutter.transform(df.withColumn("number", F.col("id").cast("double"))).withColumn(
        "part", (F.lit(len(cuts) + 1) - F.col("range")).cast("int")).drop("number", "range")      # counts up as ids fall
    # one row per range: its first document also closes the range before it, the very first the last one
    firsts = sorted((r["part"], r["id"]) for r in parted(known).groupBy("part").agg(F.max("id").alias("id")).collect())
    before = [firsts[i - 1][0] for i in range(len(firsts))]
    guests = docs.sparkSession.createDataFrame([(i, p) for (_, i), p in zip(firsts, before)], f"first {kind}, to int")
    rows = parted(source.filter(F.col("id").isNotNull())).withColumn("turn", F.lit(1))
    sent = rows.join(F.broadcast(guests), F.col("id") == F.col("first")).select(
        "id", "text", F.col("to").alias("part"), F.lit(2).alias("turn"))
    loose = source.filter(F.col("id").isNull()).select(
        "id", "text", F.pmod(F.xxhash64("text"), F.lit(len(cuts) + 1)).cast("int").alias("part"), F.lit(0).alias("turn"))
    laid = rows.select("id", "text", "part", "turn").unionByName(sent).unionByName(loose).repartition("part").sortWithinPartitions(
        "part", "turn", F.col("id").desc(), "text")
    schema = (f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    id_type = to_arrow_type(source.schema["id"].dataType)
    types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_place, pairs, size = None, None, [], 0
        for batch in batches:
            ids, parts, turns = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for row_id, text, part, turn in zip(ids, batch.column(1), parts, turns):
                if turn == 2 and last_place != (part, 1):
                    continue        # another guest of the same range
                now = Document(row_id, text.as_py())
                if turn == 0:
                    pairs.append((now, now))
                elif last_place == (part, 1):
                    pairs.append((last, now))
                last, last_place, size = now, (part, turn), size + len(now.data)
                if size >= FLUSH_BYTES and pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*results(pairs)), types)], names)
                    pairs, size = [], 0
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*results(pairs)), types)], names)

    return laid.mapInArrow(run, schema)
