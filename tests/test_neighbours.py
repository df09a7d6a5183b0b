import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from sameas.operators import editdistance as E, tfidf as X
from sameas.operators.editdistance import levenshtein_nearest
from sameas.operators.knn import knn_embedding
from sameas.operators.tfidf import knn_tfidf

WORDS = "red blue green widget bolt ring small large steel wood the the the of of and".split()


def texts(n, seed, words=6):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, words)))) for i in range(n)]


def tfidf_by_hand(a, b, k, same):
    cut = lambda t: Counter(re.findall(r"\w\w+", t.lower()))
    ca, cb = {i: cut(t) for i, t in a}, {i: cut(t) for i, t in b}
    df = Counter(tok for c in ca.values() for tok in c)
    idf = {t: math.log((1 + len(a)) / (1 + n)) + 1 for t, n in df.items()}

    def unit(c):
        w = {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()} if norm else {}

    ua, ub = {i: unit(c) for i, c in ca.items()}, {i: unit(c) for i, c in cb.items()}
    out = set()
    for i, x in ua.items():
        sims = [(-round(sum(w * y[t] for t, w in x.items() if t in y), 9), j) for j, y in ub.items() if not (same and i == j)]
        sims = sorted(s for s in sims if s[0] < 0)[:k]
        out |= {(i, j, r + 1, round(-s, 6)) for r, (s, j) in enumerate(sims)}
    return out


def found(df):
    return {(r["a_id"], r["b_id"], r["rank"], round(r["score"], 6)) for r in df.collect()}


@pytest.mark.parametrize("part_rows", [4096, 3])
@pytest.mark.parametrize("same", [False, True])
def test_tfidf_agrees_with_brute_force(make, monkeypatch, part_rows, same):
    monkeypatch.setattr(X, "PART_ROWS", part_rows)
    a = texts(40, 1)
    b = a if same else texts(60, 2)
    df = lambda rows: make(rows, "id long, text string")
    assert found(knn_tfidf(df(a), df(b), 4, same_table=same)) == tfidf_by_hand(a, b, 4, same)


def test_tfidf_token_in_every_text(make, monkeypatch):
    """The rare word decides, the common ones are left out and completed; their
    rows meet in parts of bounded size."""
    monkeypatch.setattr(X, "PART_ROWS", 32)
    rows = [(i, f"red steel code{i // 5} lot{i // 5} kind{i % 5}") for i in range(240)]
    df = make(rows, "id long, text string")
    assert found(knn_tfidf(df, df, 2, same_table=True)) == tfidf_by_hand(rows, rows, 2, True)
    seen, read = [], X._read
    monkeypatch.setattr(X, "_read", lambda entries, blocks: seen.append(entries) or read(entries, blocks))
    knn_tfidf(df, df, 2, same_table=True).count()
    assert seen[1].groupBy("term").agg(F.max("n").alias("n")).filter("n >= 240").count() == 0     # red, steel
    wa = make([(i, 5, 1.0) for i in range(240)], "id long, term long, w double")
    lists, blocks = X._posting_lists(wa, wa)
    assert lists.select("parts_a").distinct().collect() == [(8,)]
    entries = X._entries(wa, lists).withColumn("block", F.lit(0))
    assert read(entries, blocks).agg(F.count("*"), F.sum("dot")).head() == (240 * 240, 240.0 * 240)


def test_tfidf_reads_fewer_postings_of_larger_tables(make, monkeypatch):
    """Texts of one rare and many frequent words: the share of all postings that is read falls."""
    monkeypatch.setattr(X, "BLOCK_ROWS", 8)
    shares = []
    for n in (100, 1000):
        rng = random.Random(9)
        rows = [(i, f"code{i // 4} code{i // 4} code{i // 4} " + " ".join(rng.choices(WORDS, k=3))) for i in range(n)]
        df = make(rows, "id long, text string")
        wa = X.tfidf_vectors(df, df, same_table=True)[0].cache()
        asked, read = [], X._read
        monkeypatch.setattr(X, "_read", lambda entries, blocks: asked.append(entries) or read(entries, blocks))
        X.similarities(wa, wa, 3).count()
        monkeypatch.setattr(X, "_read", read)
        held = wa.groupBy("term").count()
        everything = held.agg(F.sum(F.col("count") * F.col("count"))).head()[0]
        shares.append(asked[1].dropDuplicates(["a_id", "term", "level"]).agg(F.sum("n")).head()[0] / everything)
    assert shares[1] < shares[0] / 2, shares


@pytest.mark.parametrize("sizes", [{}, {"TILE_ROWS": 16}, {"TILE_NUMBERS": 64, "DENSE_SHARE": 0.5, "SLICE_NUMBERS": 100}, {"DENSE_SHARE": 2.0},
                                   {"DENSE_NUMBERS": 200, "DENSE_SHARE": 0.0}])
@pytest.mark.parametrize("same", [False, True])
def test_tfidf_tiles_agree_with_brute_force(make, monkeypatch, sizes, same):
    """Rows that would meet through many postings meet in tiles, where no pair is moved."""
    for name, value in {"READ_ROWS": -1, **sizes}.items():
        monkeypatch.setattr(X, name, value)
    monkeypatch.setattr(X, "_read", lambda entries, blocks: pytest.fail("pairs were moved"))
    a = texts(40, 1) + [(100, ""), (101, "unseen"), (102, None)]
    b = a if same else texts(60, 2) + [(200, ""), (201, "another")]
    df = lambda rows: make(rows, "id long, text string")
    plain = lambda rows: [(i, t or "") for i, t in rows]
    assert found(knn_tfidf(df(a), df(b), 4, same_table=same)) == tfidf_by_hand(plain(a), plain(b), 4, same)
    assert knn_tfidf(df(a), df(b).limit(0), 4).count() == 0


def test_tfidf_hot_copies(make):
    """A third of all rows are one text: every list is whole, ties by id."""
    rows = [(i, "red steel ring") for i in range(50)] + [(100 + i, t) for i, t in texts(100, 3)]
    df = make(rows, "id long, text string")
    assert found(knn_tfidf(df, df, 3, same_table=True)) == tfidf_by_hand(rows, rows, 3, True)


def test_tfidf_edges(make):
    a = make([(1, "red ring"), (2, ""), (3, None), (4, "unseen?")], "id long, text string")
    b = make([(7, "red"), (8, "ring red"), (9, "other words")], "id long, text string")
    assert [r[:3] for r in sorted(found(knn_tfidf(a, b, 5)))] == [(1, 7, 2), (1, 8, 1)]
    padded = knn_tfidf(a, b, 2, pad_to_k=True)
    assert rows_of(padded, "a_id", "b_id") == [(1, 7), (1, 8), (2, 7), (2, 8), (3, 7), (3, 8), (4, 7), (4, 8)]
    assert knn_tfidf(a, b.limit(0), 2).count() == 0
    distance = {r["b_id"]: r["score"] for r in knn_tfidf(a, b, 5, metric="l2").collect()}
    cosine = {r["b_id"]: r["score"] for r in knn_tfidf(a, b, 5).collect()}
    assert all(abs(distance[i] - math.sqrt(max(0, 2 - 2 * cosine[i]))) < 1e-12 for i in cosine)
    with pytest.raises(ValueError):
        knn_tfidf(a, b, 2, metric="city")


@pytest.mark.parametrize("pivots", [None, 1, 2, 7, 3000])
@pytest.mark.parametrize("same", [False, True])
def test_embedding_paths_agree_with_brute_force(make, monkeypatch, pivots, same):
    from sameas.operators import knn
    monkeypatch.setattr(knn, "TILE_ROWS", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 6))
    points = lambda n: centres[rng.integers(0, 5, n)] + 0.2 * rng.normal(size=(n, 6))
    a = points(50)
    b = a if same else points(70)
    if same:
        a[10:30] = a[10]      # copies
        a[40] = 0             # a zero vector
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    sims = np.round(unit(a) @ unit(b).T, 9) + 0.0
    expected = set()
    for i in range(len(a)):
        order = sorted((-sims[i, j], j) for j in range(len(b)) if not (same and i == j))[:4]
        expected |= {(i, j, r + 1, round(-s, 6)) for r, (s, j) in enumerate(order)}
    df = lambda m: make([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<double>")
    got = found(knn_embedding(df(a), df(b), 4, same_table=same, n_pivots=pivots))
    assert got == expected


def test_embedding_rows_skip_far_cells():
    """Each row's cells hold its k nearest, and few of all cells are visited."""
    from sameas.operators import knn
    rng = np.random.default_rng(8)
    b = knn._unit(np.concatenate([c + 0.05 * rng.normal(size=(200, 8)) for c in 3 * rng.normal(size=(40, 8))]))
    tree = knn._Tree(b[rng.permutation(len(b))[:120]])
    cell, dist = tree.nearest(b)
    assert np.allclose(dist, np.linalg.norm(b - tree.pivots[cell], axis=1), atol=1e-6)
    radius, firsts = np.full(120, -1.0), np.full((120, 5), np.inf)
    for c in range(120):
        inside = np.sort(dist[cell == c])
        if len(inside):
            radius[c], firsts[c, :min(5, len(inside))] = inside[-1], inside[:5]
    visits = tree.visits(b[:300], radius, firsts, 5)
    nearest = np.argsort(-(b[:300] @ b.T), axis=1)[:, :5]
    assert all(set(cell[near]) <= set(seen) for near, seen in zip(nearest, visits))
    assert np.mean([len(v) for v in visits]) < 20


def test_embedding_rows_move_once_per_group(make, monkeypatch):
    """Unstructured vectors see nearly all cells; a row is sent once for each group of them."""
    from sameas.operators import knn
    sent, multiply = [], knn._multiply
    monkeypatch.setattr(knn, "_multiply", lambda left, *rest: sent.append(left.count()) or multiply(left, *rest))
    rng = np.random.default_rng(5)
    df = make([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 16)))], "id long, embedding array<double>")
    assert knn_embedding(df, df, 3, same_table=True, n_pivots=30).count() == 900
    assert sent == [300]


def test_embedding_groups_are_bounded():
    from sameas.operators import knn
    tree = knn._Tree(knn._unit(np.random.default_rng(6).normal(size=(50, 4))))
    members = np.random.default_rng(7).integers(0, 40, 50)
    members[7] = 500                                        # more than a group may hold
    group = knn._grouped(tree, members, 100)
    held = np.bincount(group, members)
    assert held.sum() == members.sum() and sorted(held)[-2] <= 100 and group.max() < 25


@pytest.mark.parametrize("pivots", [1, 2, 7])
@pytest.mark.parametrize("same", [False, True])
def test_embedding_zero_vectors_take_no_place(make, pivots, same):
    df = lambda rows: make(rows, "id long, embedding array<double>")
    b = [(10, [1.0, 0.0, 0.0]), (11, [0.3, 0.0, 0.954]), (12, [0.0] * 3), (13, [0.0] * 3), (14, [-1.0, 0.0, 0.0])]
    if same:
        got = {(r[0], r[1]) for r in found(knn_embedding(df(b), df(b), 2, same_table=True, n_pivots=pivots))}
        assert got == {(10, 11), (10, 12), (11, 10), (11, 12), (12, 10), (12, 11), (13, 10), (13, 11), (14, 12), (14, 13)}
    else:
        a = [(1, [0.999, 0.0447, 0.0]), (2, [0.0] * 3)]
        got = {(r[0], r[1]) for r in found(knn_embedding(df(a), df(b), 2, n_pivots=pivots))}
        assert got == {(1, 10), (1, 11), (2, 10), (2, 11)}


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("same", [False, True])
def test_edit_distance_nearest(make, same):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 14)))
    a = [(i, word()) for i in range(30)] + [(90, "x" * 40), (91, "abc"), (92, "abc"), (93, "abc")]
    b = a if same else [(i, word()) for i in range(40)]
    expected = []
    for i, x in a:
        d, j = min((edit(x, y), j) for j, y in b if not (same and i == j))
        expected.append((i, j, d))
    df = lambda rows: make(rows, "id long, text string")
    assert rows_of(levenshtein_nearest(df(a), df(b), same_table=same), "a_id", "b_id", "distance") == sorted(expected)


@pytest.mark.parametrize("deleted", [64, 9, 0])
def test_edit_distance_of_texts_of_few_words(make, monkeypatch, deleted):
    """Texts that share half of their letters with very many meet few of them, on both sides of the length DELETED."""
    from sameas.operators import editdistance as E
    monkeypatch.setattr(E, "DELETED", deleted)
    rng = random.Random(21)
    words = ["large ring", "old bolt", "blé"], ["Brand#1", "Brand#2"], [str(n) for n in range(100, 160)]
    rows = [(i, t) for i, t in enumerate(sorted({" ".join(rng.choice(w) for w in words) for _ in range(150)}))]
    df = make(rows, "id long, text string")
    expected = [(i, *min((edit(x, y), j) for j, y in rows if i != j)[::-1]) for i, x in rows]
    assert rows_of(levenshtein_nearest(df, df, same_table=True), "a_id", "b_id", "distance") == sorted(expected)
    if deleted == 64:
        met = E._by_deletions(*[df.withColumn("length", F.length("text"))] * 2)
        assert met.count() < len(rows) * 40


def test_edit_distance_of_long_texts(make):
    """Texts of 5,000 letters and more, near ones 1 to 20 edits apart, far ones that only meet in slices."""
    rng = random.Random(11)
    base = ["".join(rng.choices("abcdefgh ", k=n)) for n in (5000, 5200, 5200)]

    def edited(text, n):
        for _ in range(n):
            at = rng.randrange(len(text))
            text = rng.choice([text[:at] + text[at + 1:], text[:at] + "x" + text[at:], text[:at] + "y" + text[at + 1:]])
        return text

    rows = [(100 * i + n, edited(text, n)) for i, text in enumerate(base) for n in (0, 1, 5, 20)]
    df = make(rows, "id long, text string")
    got = {r["a_id"]: (r["b_id"], r["distance"]) for r in levenshtein_nearest(df, df, same_table=True).collect()}
    for i in range(3):
        assert got[100 * i + 1] == (100 * i, 1) and got[100 * i + 5][0] // 100 == i and got[100 * i + 20][0] // 100 == i
        assert got[100 * i][1] == 1 and got[100 * i + 5][1] <= 6 and got[100 * i + 20][1] <= 21


def test_edit_distance_of_many_texts_of_one_length(make):
    rng = random.Random(12)
    rows = [(i, "".join(rng.choices("abcdefghijkl", k=24))) for i in range(2500)]
    rows += [(2500 + i, t[:k] + "z" + t[k + 1:]) for i, (_, t) in enumerate(rows[:2500]) for k in [rng.randrange(24)]]
    df = make(rows, "id long, text string")
    got = rows_of(levenshtein_nearest(df, df, same_table=True), "a_id", "b_id", "distance")
    assert got == sorted([(i, 2500 + i, 1) for i in range(2500)] + [(2500 + i, i, 1) for i in range(2500)])


def test_exploded_letters_are_not_broadcast(make):
    """Spark takes what an explode lists, a row a letter or more, for as few rows as went in."""
    table = make([(i, f"some text {i}", 12) for i in range(30)], "id int, text string, length int")
    banded = table.withColumn("band", F.expr("6L"))
    for met in (E._by_deletions(table, table), E._by_pieces(table, banded, 1)):
        met.collect()
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_letter_counts_are_a_bound(make):
    from sameas.operators.editdistance import least_edits, letter_counts
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdeéß 9#") for _ in range(rng.randint(0, 12)))
    pairs = make([(word(), word()) for _ in range(300)], "x string, y string")
    bound = least_edits(letter_counts(F.col("x")), letter_counts(F.col("y")))
    rated = pairs.select(bound.alias("bound"), F.levenshtein("x", "y").alias("d"))
    assert rated.filter("bound > d").count() == 0 and rated.agg(F.max("bound")).head()[0] > 4


def test_document_words_are_counted_where_the_row_lies(spark):
    """The same bags as by counting rows, without moving any; texts of a repeated or null id count as one."""
    a = spark.createDataFrame([(1, "red green green blue"), (2, "blue white x")], "id bigint, text string").withColumn("fp", F.lit("a"))
    rows = [(1, "Red red green dark"), (2, None), (3, ""), (4, "none of them"), (5, "blue white blue RED"), (6, "blue " * 500 + "green")]
    b = spark.createDataFrame(rows, "id bigint, text string")
    _, idf, small = X._corpus_weights(a, None)
    plain = lambda df: {r["id"]: dict(zip(r["terms"], r["ws"])) for r in X._bags(X.unit_weights(X.raw_weights(X.term_counts(df), idf))).collect()}
    bags = X._bags_of(b, b, idf, small)
    assert small and "Exchange" not in bags._jdf.queryExecution().executedPlan().toString()
    repeated = b.unionByName(spark.createDataFrame([(5, "green"), (None, "red"), (None, "white")], b.schema))
    for table in (b, repeated):
        found = {r["id"]: dict(zip(r["terms"], r["ws"])) for r in X._bags_of(table, table, idf, small).collect()}
        expected = plain(table)
        assert found.keys() == expected.keys() >= {1, 5, 6}
        assert all(found[i] == pytest.approx(expected[i], abs=1e-12) for i in found)


def test_vectors_of_texts_are_made_once(make, monkeypatch):
    """A search over encoded texts encodes every text of B once, however many of its steps read the vectors."""
    from sameas.operators import matching
    from sameas.plans import runs
    counted = make([], "n int").sparkSession.sparkContext.accumulator(0)
    plain = matching._counter

    def counter(dim):
        count = plain(dim)
        return lambda words: counted.add(len(words)) or count(words)

    monkeypatch.setattr(matching, "_counter", counter)
    a = make([(1, "red ring"), (2, "iron bolt"), (3, None)], "id long, text string")
    b = make([(i, f"red ring of iron number {i // 2} with a bolt") for i in range(60)] + [(90, ""), (91, None)], "id long, text string")
    got = runs.block(a, b, 3, with_tfidf=False).collect()
    assert counted.value <= a.count() + b.count()
    monkeypatch.setattr(matching, "_counter", plain)
    plainly = knn_embedding(matching.encode_text(a), matching.encode_text(b), 3)
    assert {(r["a_id"], r["b_id"]) for r in got} == {(r["a_id"], r["b_id"]) for r in plainly.collect()}
