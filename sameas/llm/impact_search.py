"""Exact top-k by inner product over an impact-ordered index, score at a time.

Components are whole numbers. Distinct vectors lie in cells around sampled pivots, cells in
shards of bounded size. In a shard every dimension has its postings in the order of
their impact, cut into segments of equal quantised impact. A query takes the segments of
all dimensions by descending product of its weight and their impact, and adds that product,
which no posting of the segment exceeds, to the vectors in them. What a vector
can still get is at most the next product for each dimension that has not met it. When few vectors
can reach the k-th best score the rest are proven out; those few are scored exactly.
Products of zero or less are never processed: they can only lower a score.

A query first searches the shard it lies in, which gives a floor for its k-th score. Other
cells are skipped when neither their largest and smallest components nor their
centre and radius allow the floor; shards of the others are searched in blocks of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sameas.llm.packing import pick
from sameas.session import cut_lineage

SCALE = 256
SHARD_ROWS = 4096           # distinct vectors wanted in a shard
SHARD_NUMBERS = 1 << 20     # components in a shard at most, but for one vector
QUERY_ROWS = 1024           # queries searched together
LEVELS = 32                 # quantised impacts of a dimension, about
BATCHES = 6                 # parts of the postings between two looks at the bounds
MOST_PIVOTS = 1024          # cells of one length of vectors
PIVOT_NUMBERS = 1 << 20     # components of all pivots that the driver holds
WIDTHS = 8                  # lengths of vectors that have cells of their own
EXACT = 2.0**53
LONG = 2**63 - 1


class Shard:
    """The segments of one shard."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        n, width = matrix.shape
        self.order = np.argsort(-matrix, axis=0, kind="stable").T.astype(np.int32)
        low, high = matrix.min(axis=0), matrix.max(axis=0)
        self.step = np.exp2(np.ceil(np.log2(np.maximum(1.0, (high - low) / LEVELS))))
        level = np.floor(matrix / self.step) - np.floor(low / self.step)
        sizes = np.zeros((width, int(level.max(initial=0)) + 1), np.int64)
        np.add.at(sizes, (np.broadcast_to(np.arange(width), level.shape), level.astype(np.int64)), 1)
        # impacts by level: the least a posting has, and the most
        self.least = (np.floor(low / self.step)[:, None] + np.arange(sizes.shape[1])) * self.step[:, None]
        self.most = self.least + self.step[:, None] - 1
        self.sizes, self.largest = sizes, np.maximum(np.abs(low), np.abs(high))

    def bounds(self, query: np.ndarray, floor: float, counts: np.ndarray, k: int) -> tuple[np.ndarray, float]:
        """(rows that can be among the k best, floor): no other row reaches the floor."""
        n, width = self.matrix.shape
        down = query > 0
        # segments from the most valuable one of each dimension on
        impact = np.where(down[:, None], self.most[:, ::-1], self.least) * query[:, None]
        sizes = np.where(down[:, None], self.sizes[:, ::-1], self.sizes)
        ends = np.cumsum(sizes, axis=1)
        useful = (impact > 0) & (sizes > 0)
        ranked = np.sort(impact[useful])[::-1]
        cuts = [ranked[int(i * len(ranked) / BATCHES)] for i in range(1, BATCHES)] if len(ranked) >= BATCHES else []
        score, met = np.zeros(n), np.zeros(n)
        taken, done = np.zeros(width, np.int64), np.zeros_like(useful)
        slack = 1e-9 * float(np.abs(query) @ self.largest)
        can = np.ones(n, bool)
        for turn, cut in enumerate([*cuts, 0.0]):
            now = useful & ~done & (impact > cut)
            done |= now
            upto = np.maximum(taken, np.where(now, ends, 0).max(axis=1))
            rows = [self.order[d, a:b] if down[d] else self.order[d, n - b:n - a][::-1] for d, (a, b) in enumerate(zip(taken, upto)) if b > a]
            if rows:
                rows = np.concatenate(rows)
                score += np.bincount(rows, np.repeat(impact[now], sizes[now]), n)
                met += np.bincount(rows, minlength=n)
            taken = upto
            left = np.where(useful & ~done, impact, 0.0).max(axis=1)
            if turn == 0:
                best = np.argpartition(-score, min(n - 1, 4 * k))[:4 * k]
                floor = max(floor, _kth(exact_scores(self.matrix[best], query), counts[best], k))
            can = score + np.minimum((width - met) * left.max(initial=0), left.sum()) + slack >= floor
            if can.sum() <= max(4 * k, n // 32):
                break
        return np.flatnonzero(can), floor


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products without rounding; beyond 64 bits they are cut to the largest long."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, len(query))
    if most < EXACT:
        return (rows @ query).astype(np.int64)
    weights = [int(x) for x in query]
    return np.array([max(-LONG, min(LONG, sum(int(x) * w for x, w in zip(row, weights)))) for row in rows], np.int64)


def _kth(scores: np.ndarray, counts: np.ndarray, k: int) -> float:
    """The k-th best score of rows that stand for `counts` rows each."""
    order = np.argsort(-scores, kind="stable")
    at = int(np.searchsorted(np.cumsum(counts[order]), k))
    return float(scores[order[at]]) if at < len(order) else -np.inf


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def search(candidates: pa.Table, queries: pa.Table, k: int) -> Iterator[tuple[bytes, int, object, bool]]:
    """(query's key, score, id, whether of the query's own vector): at least the k best of
    the shard, as far as they reach the query's floor."""
    vectors = candidates["v"].combine_chunks()
    shard = Shard(_matrix(vectors))
    width = shard.matrix.shape[1]
    ids, keys = candidates["ids"].to_pylist(), candidates["key"].to_pylist()
    counts = np.array([len(x) for x in ids], np.int64)
    for key, vector, floor in zip(queries["key"].to_pylist(), queries["v"], queries["floor"].to_pylist()):
        query = np.zeros(width)
        given = vector.values.to_numpy(zero_copy_only=False)[:width]
        query[:len(given)] = given
        rows, least = shard.bounds(query, -np.inf if floor is None else float(floor), counts, k)
        scores = exact_scores(shard.matrix[rows], query)
        least = max(least, _kth(scores, counts[rows], k))
        fit = scores >= least
        found = [(int(s), i, keys[r] == key) for r, s in zip(rows[fit], scores[fit]) for i in ids[r]]
        for score, name, own in sorted(found, key=lambda x: (-x[0], x[1]))[:k]:
            yield key, score, name, own


def _searched(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(key, score, vec, own) of queries (cell, part, key, v, floor) in their shards."""
    at = ["cell", "part", "block"]
    blocks = queries.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).alias("blocks"))
    dealt = queries.join(blocks, ["cell", "part"]).withColumn("block", F.pmod(F.xxhash64("key"), "blocks")).drop("blocks")
    every = candidates.join(blocks, ["cell", "part"]).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).drop("blocks")
    kind = candidates.schema["ids"].dataType.elementType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(search(left, right, k)) if left.num_rows and right.num_rows else []
        names = ["key", "score", "vec", "own"]
        types = [pa.binary(), pa.int64(), left.schema.field("ids").type.value_type, pa.bool_()]
        return pa.table([pa.array([row[i] for row in found], t) for i, t in enumerate(types)], names)

    every, dealt = every.toDF(*every.columns), dealt.toDF(*dealt.columns)       # columns of their own
    return every.groupBy(*at).cogroup(dealt.groupBy(*at)).applyInArrow(run, f"key binary, score bigint, vec {kind}, own boolean")


class _Cells:
    """Pivots of the commonest lengths; other vectors are in cell -1, which has no bounds."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots, self.first, start = pivots, {}, 0
        for width, rows in pivots.items():
            self.first[width], start = start, start + len(rows)
        self.n = start

    def of(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot) of vectors of one length."""
        width = matrix.shape[1]
        if width not in self.pivots:
            return np.full(len(matrix), -1), np.zeros(len(matrix))
        pivots = self.pivots[width]
        nearest = ((pivots * pivots).sum(axis=1) - 2 * (matrix @ pivots.T)).argmin(axis=1)
        apart = matrix - pivots[nearest]
        return nearest + self.first[width], np.sqrt((apart * apart).sum(axis=1))


def _by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lengths = np.diff(column.offsets.to_numpy())
    for width in np.unique(lengths):
        rows = np.flatnonzero(lengths == width)
        yield rows, _matrix(column.take(pa.array(rows)))


def _sample_pivots(reps: DataFrame) -> _Cells:
    sizes = reps.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").limit(WIDTHS).collect()
    pivots = {}
    for width, n in sizes:
        wanted = int(min(MOST_PIVOTS, max(1, PIVOT_NUMBERS // max(1, width * WIDTHS)), max(1, n // SHARD_ROWS)))
        share = int(min(1 << 30, (1 << 30) * 4 * (wanted + 4) / n))
        drawn = reps.filter((F.size("v") == width) & (F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share)).select("key", "v").orderBy(
            "key").limit(wanted).toArrow()["v"].combine_chunks()
        if width and len(drawn):
            pivots[width] = _matrix(drawn)
    return _Cells(pivots)


def _assigned(reps: DataFrame, cells: _Cells) -> DataFrame:
    """reps with their cell and distance."""
    kind = reps.schema["ids"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(2)
            cell, apart = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for rows, matrix in _by_width(column):
                cell[rows], apart[rows] = cells.of(matrix)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(apart)], ["key", "ids", "v", "query", "cell", "apart"])

    return reps.select("key", "ids", "v", "query").mapInArrow(run, f"key binary, ids {kind}, v array<double>, query boolean, cell int, apart double")


def _cell_bounds(assigned: DataFrame, cells: _Cells) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Per cell its largest and smallest components and its radius; no more numbers than three times the pivots'."""
    inside = assigned.filter("cell >= 0")
    edges = inside.select("cell", F.posexplode("v").alias("d", "x")).groupBy("cell", "d").agg(F.max("x").alias("high"), F.min("x").alias("low"))
    radius = {r["cell"]: r["r"] for r in inside.groupBy("cell").agg(F.max("apart").alias("r")).collect()}
    table = edges.orderBy("cell", "d").toArrow()
    cell, high, low = (table[c].to_numpy() for c in ("cell", "high", "low"))
    return {c: (high[cell == c], low[cell == c], radius[c]) for c in radius}


def _visits(queries: DataFrame, cells: _Cells, bounds: dict, parts: DataFrame) -> DataFrame:
    """(cell, part, key, v, floor): the shards a query must see besides its own."""
    pivots = {cells.first[w] + i: p for w, rows in cells.pivots.items() for i, p in enumerate(rows)}
    widths = sorted({len(high) for high, _, _ in bounds.values()})
    groups = []
    for width in widths:
        names = [c for c, (high, _, _) in bounds.items() if len(high) == width]
        groups.append((width, np.array(names), np.array([bounds[c][0] for c in names]), np.array([bounds[c][1] for c in names]),
                       np.array([pivots[c] for c in names]), np.array([bounds[c][2] for c in names])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [[-1] for _ in range(batch.num_rows)]
            floors = batch.column(2).to_pylist()
            for rows, matrix in _by_width(batch.column(1)):
                for width, names, high, low, centre, radius in groups:
                    same = min(width, matrix.shape[1])
                    for row, q in zip(rows, matrix):
                        q = q[:same]
                        reach = np.where(q > 0, high[:, :same], low[:, :same]) @ q
                        reach = np.minimum(reach, centre[:, :same] @ q + np.sqrt(q @ q) * radius)
                        slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(high[:, :same]), np.abs(low[:, :same])).T)
                        floor = floors[row]
                        found[row] += names[reach + slack >= (-np.inf if floor is None else floor)].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], ["key", "v", "floor", "cell0", "part0", "cells"])

    seen = queries.select("key", "v", "floor", F.col("cell").alias("cell0"), F.col("part").alias("part0")).mapInArrow(
        run, "key binary, v array<double>, floor bigint, cell0 int, part0 bigint, cells array<int>")
    # `parts` has a row per cell
    spread = seen.withColumn("cell", F.explode("cells")).drop("cells").join(F.broadcast(parts), "cell").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    return spread.filter((F.col("cell") != F.col("cell0")) | (F.col("part") != F.col("part0"))).select("cell", "part", "key", "v", "floor")


def top_matches(vectors: DataFrame, queries: str = "id % 50 = 0", k: int = 5, id_col: str = "vec_id",
                vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row that meets `queries` (a condition on
    id) the k rows, itself left out, of highest inner product of floor(256 x); ties to the smaller id.

    Rows with a null id, or a vector that is null or holds null or non-finite components (256 x
    included), take no part. A shorter vector counts as followed by zeros, an empty
    one scores 0. Repeated ids are rows of their own; a query leaves out one row with its
    id and vector. Scores beyond 64 bits are cut to them. Fewer rows than k give what
    there is, an empty table nothing.
    """
    rows = pick(vectors, id_col, vector_col).select(
        F.col(id_col).alias("id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * SCALE).alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # floor of a double beyond 2^53 is itself
    whole = F.transform("x", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x) + 0.0)
    good = rows.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & finite).select("id", whole.alias("v"))
    key = F.unhex(F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ",")))
    keyed = good.select("id", "v", key.alias("key"), F.coalesce(F.expr(queries), F.lit(False)).alias("query"))
    by_id = Window.partitionBy("key").orderBy("id")
    least = keyed.select("key", "id").withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1).groupBy("key").agg(
        F.array_sort(F.collect_list("id")).alias("ids"))
    first = keyed.groupBy("key").agg(F.first("v").alias("v"), F.max("query").alias("query"))
    reps = cut_lineage(first.join(least, "key"))
    cells = _sample_pivots(reps)
    assigned = cut_lineage(_assigned(reps, cells))
    bounds = _cell_bounds(assigned, cells)
    # at most a row for every pivot
    parts = cut_lineage(assigned.groupBy("cell").agg(F.greatest(
        F.lit(1).cast("bigint"), F.ceil(F.count(F.lit(1)) / SHARD_ROWS), F.ceil(F.sum(F.size("v")) / SHARD_NUMBERS)).alias("parts")))
    placed = assigned.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("key"), "parts")).drop("parts", "apart")
    candidates = placed.select("cell", "part", "key", "ids", "v")
    asking = placed.filter("query").select("cell", "part", "key", "v")
    depth = k + 1
    home = cut_lineage(_searched(candidates, asking.withColumn("floor", F.lit(None).cast("bigint")), depth))
    floors = home.groupBy("key").agg(F.when(F.count(F.lit(1)) >= depth, F.min("score")).alias("floor"))
    away = _searched(candidates, _visits(asking.join(floors, "key"), cells, bounds, parts), depth)
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec")
    lists = home.unionByName(away).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= depth).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("n", "vec", "score", "own"))).alias("found"))
    own = F.array_position(F.transform("found", lambda x: x["own"] & (x["vec"] == F.col("id"))), True)
    others = F.slice(F.filter("found", lambda x, i: i + 1 != F.col("self")), 1, k)
    answered = keyed.filter("query").select("id", "key").join(lists, "key").withColumn("self", own)
    return answered.select(F.col("id").alias("query_id"), F.posexplode(others).alias("place", "x")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("x.vec").alias(id_col), F.col("x.score").alias("score"))
