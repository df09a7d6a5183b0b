"""SimHash fingerprints, linked within a few bits by anchor points of a covering code.

Of two 64-bit fingerprints at most `bits` apart, one half differs in at most
bits // 2 places. A half (32 bits) is covered by a perfect Hamming code on 31 of its
bits, with the last bit free: every half lies within one bit of an anchor (its
home), and whatever is within t of it lies within 1 + t of that anchor. So each
distinct fingerprint goes once to its home and once to every anchor within 1 + t of
it, and homes are compared with visitors anchor by anchor. That finds every pair.

Copies have one fingerprint and are compared once. A fingerprint has at most
1 + 64 + 2016 others within two bits, so links never grow with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sameas.llm.packing import blocks, pack, pick
from sameas.operators.graph import connected_components
from sameas.session import cut_lineage, dealt

SHINGLE_ROWS = 100_000      # shingle hashes turned into bits at a time
SEED = 42
SPACE = bytes(range(9, 14)) + b" "
TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, width: int) -> int:
    """Majority of the bits of the shingles' XXH64; 0 without a word."""
    words = text.translate(TO_LOWER).split()      # splits at just the six signs of SPACE
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n, digest = len(words) - width + 1, xxhash.xxh64_intdigest
    firsts, lasts = starts[:n].tolist(), ends[width - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLE_ROWS):
        part = [digest(line[a:b], SEED) for a, b in zip(firsts[at:at + SHINGLE_ROWS], lasts[at:at + SHINGLE_ROWS])]
        bits = np.unpackbits(np.array(part, ">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint) of every whole text; a null text has no words."""
    source = pick(docs, id_col, text_col)
    kind = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = pack(batch.column(1))
            for first, last in blocks(offsets):
                raw = data[offsets[first]:offsets[last]].tobytes()
                at = (offsets[first:last + 1] - offsets[first]).tolist()
                fps = np.array([fingerprint(raw[a:b], width) for a, b in zip(at, at[1:])], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(fps)], [id_col, "fp"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def _syndrome(half: np.ndarray) -> np.ndarray:
    """Hamming syndrome of bits 1..31: 0 for an anchor, else the place to flip."""
    out = np.zeros(half.shape, np.uint32)
    for place in range(1, 32):
        out ^= np.where((half >> np.uint32(place)) & np.uint32(1), np.uint32(place), np.uint32(0))
    return out


def _flips(reach: int) -> tuple[np.ndarray, np.ndarray]:
    """All sets of at most `reach` bits of a half: as masks, with their syndromes."""
    masks = [sum(1 << p for p in places) for size in range(reach + 1) for places in combinations(range(32), size)]
    masks = np.array(masks, np.uint32)
    return masks, _syndrome(masks)


def anchors(halves: np.ndarray, spread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home of each half, row of each visit, anchor visited) at `spread` bits."""
    masks, syndromes = _flips(1 + spread)
    order = np.argsort(syndromes, kind="stable")
    masks, edges = masks[order], np.searchsorted(syndromes[order], np.arange(33))
    own = _syndrome(halves)
    home = halves ^ np.where(own > 0, np.uint32(1) << own, np.uint32(0))
    sizes = (edges[1:] - edges[:-1])[own]
    row = np.repeat(np.arange(len(halves)), sizes)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return home, row, halves[row] ^ masks[edges[own][row] + inner]


def _posts(fps: DataFrame, spread: int, home: bool) -> DataFrame:
    """(anchor, fp, rep) with the half's number in the anchor's upper bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 20_000):
                part = batch.slice(start, 20_000)
                fp = part.column(0).to_numpy(zero_copy_only=False)
                for half, shift in ((0, 0), (1, 32)):
                    own = ((fp.view(np.uint64) >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    at_home, row, visited = anchors(own, spread)
                    if home:
                        row, visited = np.arange(len(fp)), at_home
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(visited.astype(np.int64) | (half << 32)), part.column(0).take(pa.array(row)),
                         part.column(1).take(pa.array(row))], ["anchor", "fp", "rep"])

    kind = fps.schema["rep"].dataType.simpleString()
    return fps.select("fp", "rep").mapInArrow(run, f"anchor bigint, fp bigint, rep {kind}")


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """(src, dst): representatives whose fingerprints differ in 1 to `bits` bits,
    each pair once or more. `fps` is (fp, rep), a row per distinct fingerprint."""
    spread = bits // 2
    homes = _posts(fps, spread, True).select("anchor", F.col("fp").alias("home_fp"), F.col("rep").alias("src"))
    visits = _posts(fps, spread, False).select("anchor", "fp", F.col("rep").alias("dst"))
    apart = F.bit_count(F.col("home_fp").bitwiseXOR(F.col("fp")))
    # x finds y at x's home and y finds x at y's, so half of the meetings are enough
    return dealt(homes).join(dealt(visits), "anchor").filter((F.col("src") < F.col("dst")) & (apart <= bits)).select("src", "dst")


def simhash_groups(docs: DataFrame, width: int = 3, bits: int = 2, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, fp bigint, component_id): documents linked by fingerprints at most
    `bits` bits apart; component_id is the smallest id that links reach.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows
    with a null id are fingerprinted but belong to the smallest id of their equals
    (null where there is none). Repeated ids stay repeated rows.
    """
    marked = cut_lineage(fingerprints(docs, width, id_col, text_col))
    reps = marked.groupBy("fp").agg(F.min(id_col).alias("rep"))
    found = cut_lineage(links(reps.filter(F.col("rep").isNotNull()), bits).distinct())
    parts = connected_components(found).select(F.col("id").alias("rep"), F.col("cluster_id").alias("part"))
    smallest = reps.join(parts, "rep", "left").select("fp", F.coalesce("part", "rep").alias("component_id"))
    return marked.join(smallest, "fp").select(id_col, "fp", "component_id")


def drop_near_copies(docs: DataFrame, width: int = 3, bits: int = 3, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """The documents that are the smallest id of their group, all columns. Rows
    with a null id stay; of rows repeating an id all stay that belong to it."""
    gone = simhash_groups(docs, width, bits, id_col, text_col).filter(F.col(id_col) != F.col("component_id"))
    ids = gone.select(F.col(id_col).alias("__gone")).distinct()
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key = f"c{docs.columns.index(id_col)}"
    return plain.join(ids, plain[key] == ids["__gone"], "left_anti").toDF(*docs.columns)
