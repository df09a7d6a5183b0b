"""Exact k-nearest-neighbour join on dense vectors by cosine.

On unit vectors d^2 = 2 - 2 cos, and d obeys the triangle inequality. B lies in cells
around about sqrt(n) pivots, which are found through a table of sqrt(pivots) upper
ones. From its distances to pivots and the members that lie closest to them every A row has a
distance within which its k nearest must lie (Lu et al., PVLDB 2012, there per
cell); it visits only cells that reach into it, and whole branches of the tree
are ruled out first. Cells that follow each other in the tree form a group, and a row is sent once
to each group that holds a cell it visits, so that where it must see all of them it moves once per TILE_ROWS
members and not once per cell. Visitors and members of a group are compared in tiles of bounded
size, so that a cell holding a third of all rows is many tasks. Each tile keeps its k
best per A row and the rest is a top-k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from sameas.functions.ordering import hash_key
from sameas.operators.copies import best_columns, nearest_by_value, top_k
from sameas.session import cut_lineage

CELL_ROWS = 1024     # rows wanted in a cell at least
PIVOT_NUMBERS = 1 << 22      # components of all pivots, which every task holds: 32 MB
TILE_ROWS = 16_384   # vectors per block at most; a larger tile means fewer copies of each vector
TILE_NUMBERS = 1 << 22       # components per block at most: 32 MB
SLICE_ROWS = 1024    # rows of A whose cells are looked up at a time
SLICE_NUMBERS = 1 << 21      # products kept at a time: 16 MB
SLACK = 1e-6


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


class _Tree:
    """Pivots, each under the nearest of the upper ones, which are the first of them."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.upper = pivots[:max(1, int(np.ceil(len(pivots) ** 0.5)))]
        above = (pivots @ self.upper.T).argmax(axis=1)
        self.children = [np.flatnonzero(above == u) for u in range(len(self.upper))]
        self.away = [_distance(self.upper[u:u + 1], pivots[c])[0] for u, c in enumerate(self.children)]

    def nearest(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pivot, distance): the nearest one under the nearest upper one."""
        first = (unit @ self.upper.T).argmax(axis=1)
        cell, dist = np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for u in np.unique(first):
            rows = np.flatnonzero(first == u)
            apart = _distance(unit[rows], self.pivots[self.children[u]])
            best = apart.argmin(axis=1)
            cell[rows], dist[rows] = self.children[u][best], apart[np.arange(len(rows)), best]
        return cell, dist

    def visits(self, unit: np.ndarray, radius: np.ndarray, firsts: np.ndarray, k: int) -> list[list[int]]:
        """Cells that can hold one of the k nearest of each row. radius is -1 for empty
        cells; firsts are the k smallest distances of members per cell, else infinite."""
        to_upper = _distance(unit, self.upper)
        found = [[] for _ in range(len(unit))]
        bound = np.full(len(unit), np.inf)
        first = to_upper.argmin(axis=1)
        for u in np.unique(first):
            rows, cells = np.flatnonzero(first == u), self.children[u]
            seen = (_distance(unit[rows], self.pivots[cells])[:, :, None] + firsts[cells][None, :, :]).reshape(len(rows), -1)
            if seen.shape[1] >= k:
                bound[rows] = np.partition(seen, k - 1, axis=1)[:, k - 1]
        for u, cells in enumerate(self.children):
            full = radius[cells] >= 0
            if not full.any():
                continue
            cells, reach = cells[full], (self.away[u][full] + radius[cells[full]]).max()
            rows = np.flatnonzero(to_upper[:, u] - reach <= bound + SLACK)
            near = _distance(unit[rows], self.pivots[cells]) - radius[cells] <= bound[rows, None] + SLACK
            for row, cell in zip(*np.nonzero(near)):
                found[rows[row]].append(int(cells[cell]))
        return found


def _distance(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * one @ two.T, 0))


def _placed(df: DataFrame, tree: _Tree) -> DataFrame:
    """(id, v, cell, dist): unit vector, its pivot and the distance."""
    schema = T.StructType([T.StructField("id", df.schema["id"].dataType), T.StructField("v", T.ArrayType(T.DoubleType())),
                           T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType())])

    def nearest(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            unit = _unit(_matrix(pdf["v"]))
            cell, dist = tree.nearest(unit)
            yield pd.DataFrame({"id": pdf["id"], "v": list(unit), "cell": cell.astype("int32"), "dist": dist})

    return df.select("id", "v").mapInPandas(nearest, schema)


def _grouped(tree: _Tree, members: np.ndarray, most: int) -> np.ndarray:
    """Group of every cell: cells in the order of the tree, as many as hold `most` rows together; a larger cell is alone."""
    group, at, held = np.zeros(len(members), np.int64), 0, 0
    for cell in np.concatenate(tree.children):
        if held and held + members[cell] > most:
            at, held = at + 1, 0
        group[cell], held = at, held + members[cell]
    return group


def _visiting(df: DataFrame, tree: _Tree, radius: np.ndarray, firsts: np.ndarray, group: np.ndarray, k: int) -> DataFrame:
    """(id, v, groups): unit vector and the groups that hold a cell it must see."""
    schema = T.StructType([T.StructField("id", df.schema["id"].dataType), T.StructField("v", T.ArrayType(T.DoubleType())),
                           T.StructField("groups", T.ArrayType(T.IntegerType()))])

    def visits(batches):
        for pdf in batches:
            for at in range(0, len(pdf), SLICE_ROWS):
                part = pdf.iloc[at:at + SLICE_ROWS]
                unit = _unit(_matrix(part["v"]))
                seen = [np.unique(group[cells]) for cells in tree.visits(unit, radius, firsts, k)]
                yield pd.DataFrame({"id": part["id"], "v": list(unit), "groups": seen})

    return df.select("id", "v").mapInPandas(visits, schema)


def _search(a: DataFrame, b: DataFrame, k: int, n_pivots: int | None) -> DataFrame:
    """k best per A row. Zero vectors score 0 with everything and obey no distance
    bound, so they stay out of the tiles: an A row can need at most the k smallest
    ids among B's zero rows, and a zero row of A the k smallest ids of B."""
    some = F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    kind = b.schema["id"].dataType
    lowest = lambda df: [r["id"] for r in df.select("id").orderBy("id").limit(k).collect()]
    listed = lambda df, ids: df.select(F.col("id").alias("a_id"), F.explode(F.array(*[F.lit(i).cast(kind) for i in ids])).alias("b_id"),
                                       F.lit(0.0).alias("score"))
    found = _tile_search(a.filter(some), b.filter(some), k, n_pivots)
    if zeros := lowest(b.filter(~some)):
        found = found.unionByName(listed(a.filter(some), zeros))
    if first := lowest(b):
        found = found.unionByName(listed(a.filter(~some), first))
    return found


def _tile_search(a: DataFrame, b: DataFrame, k: int, n_pivots: int | None) -> DataFrame:
    spark = a.sparkSession
    n, width = b.agg(F.count(F.lit(1)), F.max(F.size("v"))).head()
    most = max(1, min(TILE_ROWS, TILE_NUMBERS // max(1, width or 1)))
    if n_pivots is None:
        n_pivots = max(1, min(int(n ** 0.5), n // CELL_ROWS, PIVOT_NUMBERS // max(1, width or 1)))
    pivot_rows = b.orderBy(hash_key("pivot", "id")).limit(n_pivots).select("v").toPandas()
    if len(pivot_rows) == 0:
        return a.join(b.select(F.col("id").alias("b_id")), F.lit(False)).select(F.col("id").alias("a_id"), "b_id", F.lit(0.0).alias("score"))
    tree = _Tree(_unit(_matrix(pivot_rows["v"])))
    in_b = cut_lineage(_placed(b, tree))        # read for the shape of the cells and for the tiles
    closest = top_k(in_b.select(F.col("cell").alias("a_id"), F.col("id").alias("b_id"), (-F.col("dist")).alias("score")), k)
    shape = in_b.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius")).join(
        closest.groupBy(F.col("a_id").alias("cell")).agg(F.sort_array(F.collect_list(-F.col("score"))).alias("firsts")), "cell").toPandas()
    cells = shape["cell"].to_numpy(np.int64)            # a row per pivot, k numbers each
    radius, firsts = np.full(len(tree.pivots), -1.0), np.full((len(tree.pivots), k), np.inf)
    radius[cells] = shape["radius"]
    for cell, some in zip(cells, shape["firsts"]):
        firsts[cell, :len(some)] = some
    members = np.zeros(len(tree.pivots), np.int64)
    members[cells] = shape["n"]
    group = _grouped(tree, members, most)
    in_a = cut_lineage(_visiting(a, tree, radius, firsts, group, k))
    visitors = {r["group"]: r["n"] for r in in_a.select(F.explode("groups").alias("group")).groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = np.bincount(group, members)
    blocks = lambda n: max(1, -(-int(n) // most))
    # enough tiles for every core, by more blocks of A; a row for each cell, as many as pivots
    cores = -(-spark.sparkContext.defaultParallelism // max(1, len(visitors)))
    na = lambda n: max(blocks(n), min(cores, -(-n // CELL_ROWS)))
    tiles = spark.createDataFrame([(int(c), int(g), na(visitors[g]), blocks(held[g])) for c, g in enumerate(group) if g in visitors] or [(-1, -1, 1, 1)],
                                  "cell int, group int, na int, nb int")
    wanted = tiles.drop("cell").distinct()
    spread = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["group", "ba", "bb"]
    # a row of A goes to every tile of a group it visits, a row of B to every tile of its group's visitors
    left = in_a.select("id", "v", F.explode("groups").alias("group")).join(F.broadcast(wanted), "group").withColumn(
        "ba", spread(F.col("na"))).withColumn("bb", every("nb")).select(*keys, F.col("id").alias("a_id"), "v")
    right = in_b.join(F.broadcast(tiles), "cell").withColumn("bb", spread(F.col("nb"))).withColumn(
        "ba", every("na")).select(*keys, F.col("id").alias("b_id"), "v")
    return _multiply(left, right.toDF(*right.columns), keys, k)


def _multiply(left: DataFrame, right: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Matrix product per tile; the k best of every A row in the tile."""
    schema = T.StructType([T.StructField("a_id", left.schema["a_id"].dataType),
                           T.StructField("b_id", right.schema["b_id"].dataType),
                           T.StructField("score", T.DoubleType())])

    def product(block_a: pd.DataFrame, block_b: pd.DataFrame) -> pd.DataFrame:
        if len(block_a) == 0 or len(block_b) == 0:
            return pd.DataFrame({"a_id": [], "b_id": [], "score": []})
        block_b = block_b.sort_values("b_id", ignore_index=True)
        ids_a, ids_b, unit_b = block_a["a_id"].to_numpy(), block_b["b_id"].to_numpy(), _unit(_matrix(block_b["v"]))
        parts, height = [], max(1, SLICE_NUMBERS // len(ids_b))
        for first in range(0, len(ids_a), height):
            row, column, score = best_columns(_unit(_matrix(block_a["v"].iloc[first:first + height])) @ unit_b.T, k)   # ties: smaller b_id
            parts.append(pd.DataFrame({"a_id": ids_a[first + row], "b_id": ids_b[column], "score": score}))
        return pd.concat(parts, ignore_index=True)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(product, schema)


def knn_embedding(a: DataFrame, b: DataFrame, k: int = 20, same_table: bool = False,
                  n_pivots: int | None = None, marked: bool = False) -> DataFrame:
    """(a_id, b_id, source, rank, score): for each A vector the k nearest B vectors.
    `a`, `b` are (id, embedding), if `marked` also fp: rows that share it have one
    embedding. Copies are then told by it, and no embedding is made for that."""
    value = F.col("fp") if marked else F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256)
    prepare = lambda df: df.withColumn("v", F.col("embedding").cast("array<double>")).select("id", "v", value.alias("fp"))
    side_a = prepare(a)
    side_b = side_a if same_table else prepare(b)

    def search(one_a: DataFrame, one_b: DataFrame, depth: int) -> DataFrame:
        one_a = cut_lineage(one_a)      # read by every step below; the vectors may be made by a Python step
        return _search(one_a, one_a if same_table else cut_lineage(one_b), depth, n_pivots)

    near = nearest_by_value(side_a, side_b, k, search, same_table)
    return near.select("a_id", "b_id", F.lit("embedding").alias("source"), "rank", "score")
