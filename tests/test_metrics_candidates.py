import math
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from conftest import rows_of
from sameas.operators import candidates as C, metrics as M

PAIRS = "a_id long, b_id long"


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = [(i, int(rng.random() < 0.4), round(rng.random(), 2)) for i in range(400)]
    return spark.createDataFrame(rows, "id long, y int, score double"), rows


def test_auc_and_curve(scored):
    df, rows = scored
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    brute = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(M.roc_auc(df).head()["roc_auc"] - brute) < 1e-12
    curve = M.roc_curve(df)
    assert abs(M.auc_of_curve(curve).head()["auc"] - brute) < 1e-12
    ml = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", numBins=0)
    assert abs(ml.evaluate(df.withColumn("y", F.col("y").cast("double"))) - brute) < 1e-9
    assert curve.filter("threshold is null").select("tp", "fp").head() == (0, 0)
    for t in (0.25, 0.5):
        row = curve.filter(F.col("threshold") == t).head()
        assert (row["tp"], row["fp"]) == (sum(p >= t for p in pos), sum(n >= t for n in neg))


def test_sweep_equals_single_evaluations(scored):
    df, _ = scored
    sweep = {r["threshold"]: r for r in M.threshold_sweep(df, [0.5, 0.0, 0.65, 1.0, 0.33]).collect()}
    assert len(sweep) == 5
    for t, row in sweep.items():
        one = M.classification_metrics(df.withColumn("pred", (F.col("score") > t).cast("int"))).head()
        assert all(row[c] == one[c] for c in one.asDict())
    best = M.best_threshold(M.threshold_sweep(df)).head()
    top = max(M.threshold_sweep(df).collect(), key=lambda r: (r["f1"], -r["threshold"]))
    assert (best["threshold"], best["f1"]) == (top["threshold"], top["f1"])


def test_one_class_and_empty(make):
    ones = make([(1, 0.2), (1, 0.9)], "y int, score double")
    assert M.roc_auc(ones).head()["roc_auc"] is None
    decided = ones.withColumn("pred", F.lit(0))
    assert M.classification_metrics(decided).head().asDict() == {
        "tp": 0, "fp": 0, "fn": 2, "tn": 0, "accuracy": 0.0, "precision": 0.0, "recall": 0.0, "f1": 0.0}
    assert M.classification_metrics(decided, zero_division=1.0).head()["precision"] == 1.0
    assert M.classification_metrics(decided, zero_division=None).head()["precision"] is None
    nothing = make([], "y int, score double")
    assert M.roc_curve(nothing).count() == 1 and M.roc_auc(nothing).head()["roc_auc"] is None
    assert M.confusion_matrix(nothing.withColumn("pred", F.lit(1))).agg(F.sum("n")).head()[0] == 0


def test_report_matrix_loss(make):
    df = make([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.2), (0, 1, 0.7), (0, 0, 0.0)], "y int, pred int, score double")
    assert rows_of(M.confusion_matrix(df), "y", "pred", "n") == [(0, 0, 2), (0, 1, 1), (1, 0, 1), (1, 1, 1)]
    report = {r["class"]: r for r in M.classification_report(df).collect()}
    assert report["0"]["precision"] == pytest.approx(2 / 3) and report["1"]["recall"] == 0.5
    assert report["accuracy"]["f1"] == 0.6 and report["macro avg"]["support"] == 5
    assert report["weighted avg"]["recall"] == pytest.approx((2 / 3 * 3 + 0.5 * 2) / 5)
    loss = -(math.log(0.9) + math.log(0.4) + math.log(0.8) + math.log(0.3) + math.log(1 - 1e-15)) / 5
    assert M.log_loss(df).head()["log_loss"] == pytest.approx(loss)


def test_examples_fill_up(make):
    few = make([(i, i, int(i == 0)) for i in range(8)], PAIRS + ", pred int")
    assert [r["a_id"] for r in M.example_pairs(few).orderBy("place").collect()] == [0, 1, 2, 3, 4]
    many = make([(i, i, int(i < 6)) for i in range(7)], PAIRS + ", pred int")
    assert sorted(r["a_id"] for r in M.example_pairs(many).collect()) == [0, 1, 2, 3, 6]


def test_set_metrics(make):
    m, r = make([(1, 1), (1, 1), (2, 2)], PAIRS), make([(1, 1), (3, 3), (4, 4)], PAIRS)
    got = M.match_set_metrics(m, r).head()
    assert (got["tp"], got["fp"], got["fn"], got["precision"], got["accuracy"]) == (1, 1, 2, 0.5, pytest.approx(1 / 3))
    assert M.match_set_metrics(m.limit(0), r.limit(0)).head()["f1"] == 0.0


def test_grid(make):
    rows = [("d", m, o, y, s) for m, o, y, s in [("x", 1, 1, 0.9), ("x", 1, 0, 0.1), ("x", 2, 1, 0.1), ("x", 2, 0, 0.9), ("z", 1, 1, 0.8)]]
    summary = M.grid_summary(make(rows, "data string, model string, opt int, y int, score double"), ["data", "model", "opt"])
    assert rows_of(M.best_f1(summary, ["data", "model"]), "model", "best_f1") == [("x", 1.0), ("z", 1.0)]
    assert rows_of(M.best_config(summary, ["data"], ["model", "opt"]), "model", "opt") == [("x", 1)]


@pytest.fixture
def blocked(make):
    one = make([(1, 1, "t", 1), (1, 2, "t", 2), (2, 5, "t", 1)], PAIRS + ", source string, rank int")
    two = make([(1, 2, "e", 1), (3, 3, "e", 1)], PAIRS + ", source string, rank int")
    gold = make([(1, 2, 1), (3, 4, 1), (2, 5, 0), (1, 2, 1)], PAIRS + ", matching int")
    return one, two, gold


def test_merge_and_label(blocked):
    one, two, gold = blocked
    merged = C.merge_candidates(one, two)
    assert rows_of(merged, "a_id", "b_id", "sources") == [(1, 1, ["t"]), (1, 2, ["e", "t"]), (2, 5, ["t"]), (3, 3, ["e"])]
    assert rows_of(C.merge_candidates(two, one), "a_id", "b_id", "sources") == rows_of(merged, "a_id", "b_id", "sources")
    assert rows_of(C.blocker_overlap(merged), "sources", "n_pairs") == [("e", 1), ("e+t", 1), ("t", 2)]
    assert rows_of(C.label_candidates(merged, gold), "a_id", "b_id", "matching") == [(1, 1, 0), (1, 2, 1), (2, 5, 0), (3, 3, 0)]
    assert rows_of(C.gold_missed(merged, gold), "a_id", "b_id") == [(3, 4)]
    assert rows_of(C.gold_found(merged, gold), "a_id", "b_id") == [(1, 2)]
    lists = C.neighbour_lists(merged)
    assert rows_of(C.explode_lists(lists), "a_id", "b_id") == rows_of(merged, "a_id", "b_id")


def test_blocking_metrics(blocked, make):
    one, _, gold = blocked
    row = C.blocking_metrics(one, gold, 3, 5).head()
    assert (row["n_candidates"], row["n_found"], row["n_gold"], row["recall"]) == (3, 1, 2, 0.5)
    assert row["reduction_ratio"] == pytest.approx(0.8) and row["f1"] == pytest.approx(2 * 0.8 * 0.5 / 1.3)
    none = C.blocking_metrics(one, gold.limit(0), 3, 5).head()
    assert none["recall"] is None and none["f1"] is None and none["reduction_ratio"] == pytest.approx(0.8)
    mean = C.average_neighbours(one, make([(1,), (2,), (3,)], "id long")).head()
    assert mean["avg_neighbors"] == 1.0


def test_k_sweep_equals_single_runs(blocked):
    one, two, gold = blocked
    ranked = one.unionByName(two)
    recalls = []
    for row in C.k_sweep(ranked, gold, 3, 5, 3).orderBy("k").collect():
        single = C.blocking_metrics(C.merge_candidates(ranked.filter(F.col("rank") <= row["k"])), gold, 3, 5).head()
        assert all(row[c] == single[c] for c in ("n_candidates", "n_found", "recall", "reduction_ratio", "f1"))
        recalls.append(row["recall"])
    assert recalls == sorted(recalls) and len(recalls) == 3


def test_undirected_and_attribution(make):
    pairs = make([(2, 1), (1, 2), (3, 3)], PAIRS)
    assert rows_of(C.undirected(pairs), "a_id", "b_id") == [(1, 2)]
    gold = make([(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 0)], PAIRS + ", matching int")
    got = C.error_attribution(gold, make([(1, 1), (2, 2), (4, 4)], PAIRS), make([(1, 1), (4, 4)], PAIRS))
    assert rows_of(got, "a_id", "outcome") == [(1, "correct"), (2, "missed in matching"), (3, "lost in blocking"), (4, "false match")]
