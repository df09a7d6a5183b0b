"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut into halves, each half has a codebook of its own, and the
product of the two is a fine grid of cells at the cost of two small codebooks. Every
vector lives in one cell. It then visits cells by rising distance (the sum of its
halves' distances to the two codes): a frontier over the two sorted lists gives the next nearest
cell, until the wanted recall is reached, that is the margin over its own cell's distance
that finds the wanted share of partners lying exactly at the threshold, measured
on turned copies of sampled vectors. Real partners lie closer and are found at least as often.

Residents and visitors of a cell are compared by matrix product in double precision,
in tiles of bounded size. Vectors that differ by a factor only are compared once, with their
number. Tiles return per vector a count and one link per vector to join it to others,
never pairs. Vectors of one length have an index of their own; those of rare lengths meet in one cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sameas.functions.text import once
from sameas.llm.packing import pick
from sameas.operators.graph import connected_components
from sameas.session import cut_lineage

SAMPLE = 20_000         # vectors that the codebooks and the margin are learned from, at most
CODES = 4096            # codes per half at most: cells keep their size up to 10**10 vectors
CELL_ROWS = 1024        # vectors wanted in a cell
WIDTHS = 16             # lengths of vectors that have an index, the commonest
BROADCAST_CELLS = 100_000       # cells of more than one tile that are sent to every task
TILE_ROWS = 2048        # residents, and visitors, of a tile
ROUNDS = 12             # of k-means
SLACK = 1e-12           # room for the order of summation


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; divided by their largest component first, so that no square is too large or small."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _distances(half: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (half * half).sum(axis=1, keepdims=True) + (codes * codes).sum(axis=1) - 2 * half @ codes.T


def learn_codes(half: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means on the rows of one half."""
    k = min(k, len(half))
    codes = half[rng.choice(len(half), k, replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = _distances(half, codes).argmin(axis=1)
        sums = np.zeros_like(codes)
        np.add.at(sums, nearest, half)
        counts = np.bincount(nearest, minlength=k)
        filled = counts > 0
        codes[filled] = sums[filled] / counts[filled, None]
    return codes


class Index:
    """Two codebooks and the margin of the walk."""

    def __init__(self, first: np.ndarray, second: np.ndarray, cut: int):
        self.first, self.second, self.cut, self.margin = first, second, cut, 0.0

    def sides(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(unit[:, :self.cut], self.first), _distances(unit[:, self.cut:], self.second)

    def home(self, unit: np.ndarray) -> np.ndarray:
        one, two = self.sides(unit)
        return one.argmin(axis=1) * len(self.second) + two.argmin(axis=1)

    def excess(self, unit: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How much farther than its own cell the given cell is for each vector."""
        one, two = self.sides(unit)
        row = np.arange(len(unit))
        a, b = one[row, cells // len(self.second)] - one.min(axis=1), two[row, cells % len(self.second)] - two.min(axis=1)
        return a + b

    def calibrate(self, unit: np.ndarray, cosine: float, recall: float, rng: np.random.Generator) -> None:
        turn = rng.normal(size=unit.shape)
        turn -= (turn * unit).sum(axis=1, keepdims=True) * unit
        partner = cosine * unit + np.sqrt(1 - cosine * cosine) * _unit(turn)
        # found when either visits the other's cell
        need = np.minimum(self.excess(unit, self.home(partner)), self.excess(partner, self.home(unit)))
        self.margin = float(np.quantile(need, recall)) + 1e-9

    def visits(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all visits, row by row, nearest cells first."""
        one, two = self.sides(unit)
        order = [np.argsort(d, axis=1, kind="stable") for d in (one, two)]
        near = [np.take_along_axis(d, o, axis=1) for d, o in zip((one, two), order)]
        near = [d - d[:, :1] for d in near]
        reach = [(d <= self.margin).sum(axis=1).tolist() for d in near]
        rows, cells = [], []
        for row in range(len(unit)):
            lists = [d[row, :n[row]].tolist() for d, n in zip(near, reach)]
            for i, j in frontier(*lists, self.margin):
                rows.append(row)
                cells.append(int(order[0][row, i]) * len(self.second) + int(order[1][row, j]))
        return np.array(rows, np.int64), np.array(cells, np.int64)


def frontier(one: list[float], two: list[float], margin: float) -> Iterator[tuple[int, int]]:
    """Pairs of places in two rising lists by rising sum, as far as the margin."""
    if not one or not two:
        return
    waiting, seen = [(one[0] + two[0], 0, 0)], set()
    while waiting:
        total, i, j = heappop(waiting)
        if total > margin:
            return
        yield i, j
        seen.add((i, j))
        # a pair waits once both pairs before it are out
        if i + 1 < len(one) and (j == 0 or (i + 1, j - 1) in seen):
            heappush(waiting, (one[i + 1] + two[j], i + 1, j))
        if j + 1 < len(two) and (i == 0 or (i - 1, j + 1) in seen):
            heappush(waiting, (one[i] + two[j + 1], i, j + 1))


def fit_index(sample: np.ndarray, n_rows: int, cosine: float, recall: float, seed: int) -> Index:
    """Codebooks sized for `n_rows` vectors, learned from at most SAMPLE of them. Of one dimension there is nothing to cut."""
    rng = np.random.default_rng(seed)
    cut = max(1, sample.shape[1] // 2)
    if sample.shape[1] < 2:
        return Index(np.zeros((1, cut)), np.zeros((1, 0)), cut)
    k = int(min(CODES, max(1, round((n_rows / CELL_ROWS) ** 0.5))))
    index = Index(learn_codes(sample[:, :cut], k, rng), learn_codes(sample[:, cut:], k, rng), cut)
    probe = sample[rng.choice(len(sample), min(len(sample), 4000), replace=False)]
    index.calibrate(probe, cosine, recall, rng)
    return index


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _indexes(distinct: DataFrame, cosine: float, recall: float, seed: int) -> dict[int, Index]:
    """An index for each of the commonest lengths."""
    found = {}
    sizes = distinct.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").limit(WIDTHS).collect()
    limit = SAMPLE // max(1, len(sizes))
    for width, n in sizes:
        rows = distinct.filter(F.size("v") == width)
        share = 1_000_000 * min(1.0, (limit + 4 * limit**0.5) / n)
        drawn = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < share).select("v").limit(2 * limit).toArrow()["v"].combine_chunks()
        if len(drawn) == 0:
            drawn = rows.select("v").limit(limit).toArrow()["v"].combine_chunks()
        found[width] = fit_index(_unit(_matrix(drawn, width)), n, cosine, recall, seed)
    return found


def _placed(vectors: DataFrame, indexes: dict[int, Index], only_sizes: bool = False) -> DataFrame:
    """A row for each cell that a vector visits, its home first: cell, rep, weight, home,
    visited (at home only), v. Or just (cell, n0, n1): residents and visitors of the cells, counted by batches."""
    base = {width: number << 32 for number, width in enumerate(indexes)}

    def walked(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, home of each, place of each visit in rows, cell of each visit) by length."""
        column = part.column(2)
        widths = np.diff(column.offsets.to_numpy())
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            if width not in indexes:
                yield rows, np.full(len(rows), -1 - int(width)), np.arange(len(rows)), np.full(len(rows), -1 - int(width))
                continue
            unit = _unit(_matrix(column.take(pa.array(rows)), int(width)))
            row, cell = indexes[width].visits(unit)
            yield rows, indexes[width].home(unit).astype(np.int64) + base[width], row, cell + base[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                for rows, home, row, cell in walked(part):
                    if only_sizes:
                        cells, at = np.unique(np.r_[home, cell], return_inverse=True)
                        n0, n1 = np.bincount(at[:len(home)], minlength=len(cells)), np.bincount(at[len(home):], minlength=len(cells))
                        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n0), pa.array(n1)], ["cell", "n0", "n1"])
                        continue
                    lists = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(len(rows) + 1)).astype(np.int32), pa.array(cell))
                    for at in range(0, len(row), 20_000):
                        here = slice(at, at + 20_000)
                        take = pa.array(rows[row[here]])
                        own = cell[here] == home[row[here]]
                        visited = lists.take(pa.array(row[here], mask=~own))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(cell[here]), part.column(0).take(take), part.column(1).take(take), pa.array(home[row[here]]),
                             visited, part.column(2).take(take)], ["cell", "rep", "weight", "home", "visited", "v"])

    if only_sizes:
        return vectors.select("rep", "weight", "v").mapInArrow(run, "cell bigint, n0 bigint, n1 bigint")
    kind, values = vectors.schema["rep"].dataType.simpleString(), vectors.schema["v"].dataType.simpleString()
    return vectors.select("rep", "weight", "v").mapInArrow(
        run, f"cell bigint, rep {kind}, weight bigint, home bigint, visited array<bigint>, v {values}")


def _tiles(distinct: DataFrame, indexes: dict[int, Index]) -> DataFrame:
    """Rows with (a, b), the tile of a cell, and whether they are residents and visitors
    there: residents are dealt over a and go to every b, visitors the other way round.
    Cells under TILE_ROWS on both sides are one tile."""
    sizes = _placed(distinct, indexes, only_sizes=True).groupBy("cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    parts = lambda n: F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col(n) / TILE_ROWS)).alias(f"parts_{n}")
    cut = cut_lineage(sizes.filter((F.col("n0") > TILE_ROWS) | (F.col("n1") > TILE_ROWS)).select("cell", parts("n0"), parts("n1")))
    many = cut.count()
    placed = _placed(distinct, indexes).join(F.broadcast(cut) if many <= BROADCAST_CELLS else cut, "cell", "left")
    number = lambda n: F.coalesce(f"parts_{n}", F.lit(1).cast("bigint"))
    own = lambda n: F.pmod(F.xxhash64("rep"), number(n))
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), number(n) - 1)
    at = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    visits = F.transform(every("n0"), lambda a: at(a, own("n1")))
    lives = F.when(F.col("home") == F.col("cell"), F.transform(every("n1"), lambda b: at(own("n0"), b))).otherwise(
        F.array().cast("array<struct<a:bigint,b:bigint>>"))
    tiled = placed.withColumn("tile", F.explode(F.array_union(visits, lives)))
    return tiled.select("cell", "tile.a", "tile.b", "rep", "weight", "home", "visited", "v",
                        ((F.col("home") == F.col("cell")) & (F.col("tile.a") == own("n0"))).alias("lives"),
                        (F.col("tile.b") == own("n1")).alias("visits"))


def _compare(cosine: float):
    """Per tile: (rep, other, n): n more links of rep, and one link to join it by."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = table["v"].chunk(0)
        unit = _unit(_matrix(column, len(column[0])))
        lives, visits = (table[c].to_numpy() for c in ("lives", "visits"))
        left, right = table.filter(pa.array(lives)).combine_chunks(), table.filter(pa.array(visits)).combine_chunks()
        unit_left, unit_right = unit[lives], unit[visits]
        out = []
        if left.num_rows and right.num_rows:
            ids = [side["rep"].to_numpy() for side in (left, right)]
            weights = [side["weight"].to_numpy() for side in (left, right)]
            homes = right["home"].to_numpy()
            visited = left["visited"].combine_chunks()
            cells, places = visited.flatten().to_numpy(), visited.offsets.to_numpy()
            places = places - places[0]
            span = int(max(cells.max(initial=0), homes.max(initial=0))) + 1
            known = np.sort(np.repeat(np.arange(left.num_rows), np.diff(places)) * span + cells)
            for at in range(0, left.num_rows, 512):
                i, j = np.nonzero(unit_left[at:at + 512] @ unit_right.T >= cosine - SLACK)
                i = i + at
                exact = np.einsum("ij,ij->i", unit_left[i], unit_right[j]) >= cosine
                i, j = i[exact & (ids[0][i] != ids[1][j])], j[exact & (ids[0][i] != ids[1][j])]
                # a pair that each finds in the other's cell is told where the smaller id lives
                key = i * span + homes[j]
                place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                told = (known[place] != key) | (ids[0][i] < ids[1][j])
                i, j = i[told], j[told]
                if len(i):
                    one, other = ids[0][i], ids[1][j]
                    both = pd.DataFrame({"rep": np.r_[one, other], "other": np.r_[other, one],
                                         "n": np.r_[weights[1][j], weights[0][i]]})
                    out.append(both)
        # within a tile: the count, the smallest partner, and a spanning link is enough as every link's two ends name theirs
        whole = pd.concat(out) if out else pd.DataFrame({"rep": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
        return pa.Table.from_pandas(_forest(whole), preserve_index=False)

    return run


def _forest(links: pd.DataFrame) -> pd.DataFrame:
    """Counts per rep, and as partner the smallest id of its component among the links."""
    counts = links.groupby("rep", as_index=False)["n"].sum()
    names = counts["rep"].to_numpy()
    root = np.arange(len(names))
    a, b = np.searchsorted(names, links["rep"].to_numpy()), np.searchsorted(names, links["other"].to_numpy())
    while len(names):
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, a, root[b])
        low = low[low]
        if (low == root).all():
            break
        root = low
    counts["other"] = names[root]
    return counts[["rep", "other", "n"]]


def embedding_groups(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.97, seed: int = 42,
                     id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept): near-duplicate vectors by cosine.

    n_links counts the other vectors found at or above the threshold, component_id is
    the smallest id reached by links, kept marks it. Vectors that are null, empty, zero, or
    hold null or non-finite components link with nothing; vectors link with those of
    their own length only. Repeated ids stay rows; a null id is never a component's.
    An empty table stays empty.
    """
    rows = pick(vectors, id_col, vector_col).toDF("id", "v")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    top = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    # the factor of a vector plays no part; + 0.0 makes one zero of two
    scaled = once(top, lambda t: F.transform("v", lambda x: (x.cast("double") / t + 0.0).cast("string")))
    keyed = rows.withColumn("key", F.when(usable, F.unhex(F.md5(F.array_join(scaled, ",")))))
    distinct = cut_lineage(keyed.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v")))
    kind = distinct.schema["rep"].dataType.simpleString()
    tiled = _tiles(distinct, _indexes(distinct, cosine, recall, seed))
    told = cut_lineage(tiled.groupBy("cell", "a", "b").applyInArrow(_compare(cosine), f"rep {kind}, other {kind}, n bigint"))
    counts = told.groupBy("rep").agg(F.sum("n").alias("n"))
    edges = told.filter(F.col("rep") != F.col("other")).select(F.col("rep").alias("src"), F.col("other").alias("dst"))
    parts = connected_components(edges).select(F.col("id").alias("rep"), F.col("cluster_id").alias("part"))
    groups = (
        distinct.select("key", "rep", "weight").join(counts, "rep", "left").join(parts, "rep", "left")
        .select("key", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("part", "rep").alias("component_id"))
    )
    linked = keyed.filter(F.col("key").isNotNull()).select("id", "key").join(groups, "key").select(
        F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    alone = keyed.filter(F.col("key").isNull()).select(
        F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)
