import random

import pytest

from conftest import rows_of
from pyspark.sql import functions as F
from sameas.functions.ordering import hash_rank, previous_point, running_totals
from sameas.operators import graph as G, sampling as S

PAIRS = "a_id long, b_id long"


def components(edges):
    parent = {}
    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for u, v in edges:
        ru, rv = root(u), root(v)
        if ru != rv:
            parent[max(ru, rv)] = min(ru, rv)
    return sorted((x, root(x)) for x in parent)


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(3, 3), (5, 4), (4, 5), (9, 8)],
    [(random.Random(1).randint(0, 99) * 7 % 100, random.Random(i).randint(0, 99)) for i in range(60)]])
def test_connected_components(make, edges):
    df = make(edges, "src long, dst long")
    assert rows_of(G.connected_components(df), "id", "cluster_id") == components(edges)


def test_components_of_nothing_and_of_lonely_nodes(make):
    none = make([], "src long, dst long")
    assert G.connected_components(none).count() == 0
    assert rows_of(G.connected_components(none, make([(4,), (5,)], "id long")), "id", "cluster_id") == [(4, 4), (5, 5)]


def one_round(matched, candidates):
    return {(a, d) for (a, b) in matched for (c, b2) in matched if b2 == b for (c2, d) in matched if c2 == c
            if (a, d) in candidates and (a, d) not in matched}


def in_place(matched, candidates):
    """One pass over the pairs with changes seen at once, in the given order."""
    state = {p: p in matched for p in candidates}
    for (a, b) in state:
        for (c, d) in state:
            if state[a, b] and state[c, d]:
                if state.get((c, b)) and state.get((a, d)) is False:
                    state[a, d] = True
                if state.get((a, d)) and state.get((c, b)) is False:
                    state[c, b] = True
    return {p for p, v in state.items() if v}


@pytest.mark.parametrize("seed", range(4))
def test_transitive_closure(make, seed):
    rng = random.Random(seed)
    candidates = {(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(45)}
    matched = {p for p in candidates if rng.random() < 0.3}
    rounds, now = {p: 0 for p in matched}, set(matched)
    step = 0
    while new := one_round(now, candidates):
        step += 1
        rounds.update({p: step for p in new})
        now |= new
    m, c = make(sorted(matched), PAIRS), make(sorted(candidates), PAIRS)
    assert rows_of(G.transitive_closure(m, c), "a_id", "b_id", "round") == sorted((*p, r) for p, r in rounds.items())
    first = {tuple(r) for r in G.transitive_round(m, c).collect()}
    assert first == one_round(matched, candidates)
    assert matched | first <= in_place(matched, sorted(candidates)) | matched <= now


def test_clusters(make):
    got = rows_of(G.match_clusters(make([(1, 1), (2, 1), (3, 9)], PAIRS)), "id", "cluster_id", "size")
    assert got == [("a:1", "a:1", 3), ("a:2", "a:1", 3), ("a:3", "a:3", 2), ("b:1", "a:1", 3), ("b:9", "a:3", 2)]


def test_hash_rank_is_a_permutation_and_ignores_partitions(make):
    df = make([(i, i % 3) for i in range(200)], "a_id long, b_id long")
    ranked = rows_of(hash_rank(df, ["a_id", "b_id"], 42), "rank", "a_id")
    assert [r for r, _ in ranked] == list(range(1, 201)) and [a for _, a in ranked] != list(range(200))
    assert ranked == rows_of(hash_rank(df.repartition(7), ["a_id", "b_id"], 42), "rank", "a_id")


def test_running_totals_and_previous_point(make):
    values = [(random.Random(i).random(), i % 4) for i in range(700)]
    df = make(values, "s double, n long")
    total, expected = 0, []
    for s, n in sorted(values, reverse=True):
        total += n
        expected.append((s, total))
    assert rows_of(running_totals(df, "s", ["n"], descending=True), "s", "cum_n") == sorted(expected)
    points = sorted((round(s, 1), n) for s, n in values)
    got = previous_point(make(points, "x double, y long"), "x", "y", ["x", "y"])
    by_hand = sorted((b[0], b[1], a[0], a[1]) for a, b in zip(points, points[1:]))
    assert sorted(tuple(r) for r in got.filter(F.col("prev_x").isNotNull()).collect()) == by_hand


def test_random_split_sizes(make):
    df = make([(i, i) for i in range(101)], PAIRS)
    counts = {r["split"]: r["count"] for r in S.random_split(df).groupBy("split").count().collect()}
    assert counts == {"train": 70, "val": 15, "test": 16}
    assert S.hashed_split(df).filter("split is null").count() == 0


def test_few_shot(make):
    df = make([(i, i, int(i < 3)) for i in range(50)], PAIRS + ", matching int")
    got = S.few_shot_sample(df, 5, 5)
    assert {r["matching"]: r["count"] for r in got.groupBy("matching").count().collect()} == {1: 3, 0: 5}
    drawn = S.few_shot_sample(df, 5, 8, replacement=True)
    assert {r["matching"]: r["count"] for r in drawn.groupBy("matching").count().collect()} == {1: 5, 0: 8}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.few_shot_sample(df.repartition(9), 5, 5).collect()))


def test_component_split_and_negatives(make):
    positives = make([(i, i) for i in range(30)] + [(i, i + 1) for i in range(0, 30, 3)], PAIRS)
    split = S.component_split(positives)
    assert split.count() == 40
    assert split.groupBy("cluster_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    negatives = S.negative_samples(split, ratio=2)
    assert negatives.count() > 0
    assert negatives.join(positives, ["a_id", "b_id"]).count() == 0
    few = split.groupBy("split", "a_id").agg(F.count("*").alias("own")).join(
        split.groupBy("split").agg(F.countDistinct("b_id").alias("size")), "split").join(
        negatives.groupBy("split", "a_id").agg(F.count("*").alias("n")), ["split", "a_id"], "left")
    assert few.filter("coalesce(n, 0) <> least(2 * own, size - own)").count() == 0      # whole, or all there are
    ends = split.select("split", "a_id").distinct()
    assert negatives.join(ends, ["split", "a_id"], "left_anti").count() == 0
    whole = S.assembled_split(split, negatives)
    for name in ("train", "val", "test"):
        places = [r["position"] for r in whole.filter(F.col("split") == name).collect()]
        assert sorted(places) == list(range(1, len(places) + 1))
    lonely = make([(1, 1, "train")], PAIRS + ", split string")
    assert S.negative_samples(lonely, ratio=3).count() == 0     # nothing to pair with: fewer, never a loop


def test_later_rounds_look_at_what_the_last_one_touched(make, monkeypatch):
    """A long chain closes round by round, a cluster that was finished at once is not looked at again."""
    from sameas.operators import graph
    chain = [(i, i) for i in range(12)] + [(i + 1, i) for i in range(11)]
    block = [(100 + i, 100 + j) for i in range(6) for j in range(6) if (i + j) % 2 == 0] + [(100, 101)]
    everything = [(i, j) for i in range(12) for j in range(12)] + [(100 + i, 100 + j) for i in range(6) for j in range(6)]
    seen, close = [], graph._close_once
    monkeypatch.setattr(graph, "_close_once", lambda known, waiting, degrees=None: seen.append(
        {tuple(r) for r in waiting.select("a_id", "b_id").collect()}) or close(known, waiting, degrees))
    pairs = lambda rows: make(rows, "a_id long, b_id long")
    got = {(r["a_id"], r["b_id"]): r["round"] for r in graph.transitive_closure(pairs(chain + block), pairs(everything)).collect()}

    known, number, expected = set(chain + block), 0, {p: 0 for p in chain + block}
    while True:
        by_a = {a: {b for x, b in known if x == a} for a, _ in known}
        new = {(a, b) for a, b in everything if (a, b) not in known and a in by_a and any(
            by_a[c] & by_a[a] and b in by_a[c] for c in by_a)}
        if not new:
            break
        number += 1
        expected |= {p: number for p in new}
        known |= new
    assert got == expected and number > 2
    assert all(len(later) < len(first) for first, later in zip(seen, seen[1:]))
    assert all(a < 100 for a, _ in seen[-1])
