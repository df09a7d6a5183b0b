import math
import random

import numpy as np
import pytest

from sameas.llm import impact_search

SCHEMA = "vec_id bigint, embedding array<double>"


def plain(rows, k=5, every=50):
    whole = []
    for name, v in rows:
        if name is None or v is None or any(x is None or not math.isfinite(x * 256) for x in v):
            continue
        whole.append((name, [math.floor(256 * x) for x in v]))
    out = []
    for at, (query, v) in enumerate(whole):
        if query % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), name) for i, (name, w) in enumerate(whole) if i != at)
        out += [(query, rank, name, max(-2**63 + 1, min(2**63 - 1, -s))) for rank, (s, name) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(spark, rows, k=5, every=50):
    table = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in impact_search.top_matches(table, f"id % {every} = 0", k).select(
        "query_id", "rank", "vec_id", "score").collect())


def clusters(seed, n, width, copies=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, width))
    rows = centres[rng.integers(0, 9, n)] + 0.3 * rng.normal(size=(n, width))
    rows /= np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    same = rng.random(n) < copies
    rows[same] = rows[rng.integers(0, 5, same.sum())]
    return [(i, v.tolist()) for i, v in enumerate(rows)]


@pytest.mark.parametrize("shard", [4096, 64])
def test_agrees_with_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(impact_search, "SHARD_ROWS", shard)
    monkeypatch.setattr(impact_search, "QUERY_ROWS", 16)
    rows = clusters(1, 900, 12)
    assert found(spark, rows, every=7) == plain(rows, every=7)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = clusters(2, 60, 5, 0.4) + [(100, [0.0] * 5), (150, []), (200, [1.0]), (250, [0.5] * 40), (300, None), (350, [nan] * 5), (400, [1.0, None]),
                                      (450, [inf] * 5), (None, [1.0] * 5), (50, [0.1] * 5), (500, [1e-200] * 5), (550, [-1e-200] * 5),
                                      (600, [3e9, -7e9, 1.0, 0.25, 2.0]), (650, [3e9, -7e9, 1.25, 0.25, 2.0]), (-50, [-0.004] * 5), (700, [1e307])]
    assert found(spark, rows, every=10) == plain(rows, every=10)


def test_one_vector_everywhere_and_small_tables(spark):
    rows = [(i, [0.3, -0.2, 0.1]) for i in range(200)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, [(50, [1.0])]) == []
    assert found(spark, [(50, [1.0]), (51, [-1.0])]) == [(50, 1, 51, -65536)]
    assert found(spark, []) == []


def test_repeated_ids_and_clashing_names(spark):
    rows = [(50, [1.0, 0.0])] * 2 + [(50, [0.5, 0.5]), (7, [0.5, 0.0])]
    assert found(spark, rows, k=2) == plain(rows, k=2)
    table = spark.createDataFrame([(50, [1.0], 1, "x"), (3, [2.0], 2, "y")], SCHEMA + ", id int, key string")
    assert [tuple(r) for r in impact_search.top_matches(table).collect()] == [(50, 1, 3, 131072)]


def test_shards_prove_most_rows_out():
    rows = np.floor(256 * np.array([v for _, v in clusters(3, 4000, 64)]))
    shard = impact_search.Shard(rows)
    left = [len(shard.bounds(rows[i], -np.inf, np.ones(4000, np.int64), 6)[0]) for i in range(0, 4000, 100)]
    assert max(left) <= 4000 // 4
