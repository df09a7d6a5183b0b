"""What the plans must not contain, and answers that must not move with them."""

import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry
from conftest import rows_of
from sameas.operators import candidates as C, graph as G
from sameas.operators.copies import top_k
from sameas.plans import catalog
from sameas.plans.tasks import Tasks
from sameas.session import ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"
CROSS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_catalogue_is_consistent():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 80
    assert set(catalog.QUERIES) <= set(queries) and set(catalog.ORACLE) <= set(oracle)
    assert {n for n in catalog.QUERIES if n not in oracle} <= {"supervised_match"}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["n_candidates", "n_found", "n_gold", "reduction_ratio", "recall", "f1"] and df.count() == 1


@pytest.mark.parametrize("name", ["knn_tfidf", "merge_candidates", "label_candidates", "pair_cosine", "transitive_round",
                                  "grid_summary", "threshold_sweep", "k_sweep", "blocking_metrics", "negative_samples"])
def test_no_cross_joins(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert not any(word in plan for word in CROSS)


def test_scan_reads_only_what_is_needed(spark):
    plan = plan_of(entry.queries()["get_entity"](spark, SF))
    assert "EqualTo(c_custkey,12)" in plan
    plan = plan_of(entry.queries()["text_length"](spark, SF))
    assert "ReadSchema: struct<text:string>" in plan


def test_top_k_is_pruned_before_the_shuffle(spark):
    t = Tasks(spark, SF)
    plan = plan_of(top_k(t.trades.select("a_id", "b_id", "score"), 5))
    assert plan.count("WindowGroupLimit") >= 2


def test_answers_do_not_depend_on_partitions(spark):
    t = Tasks(spark, SF)
    results = []
    for n in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        t = Tasks(spark, SF)
        results.append((rows_of(G.transitive_closure(t.strong_trades, t.trades), "a_id", "b_id", "round"),
                        rows_of(C.merge_candidates(t.gold_passages.selectExpr("a_id", "b_id", "'s' source")), "a_id", "b_id")))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2]


def test_checkpoint_folder_comes_from_the_session(spark):
    ensure_checkpoint_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir") in spark.sparkContext.getCheckpointDir()


def test_gold_of_a_grid_is_read_once(make, monkeypatch):
    """Cells run one after another and read kept gold pairs instead of making them again."""
    from sameas.plans import runs
    read, plain = [], runs.blocking_cell
    monkeypatch.setattr(runs, "blocking_cell", lambda a, b, gold, *rest: read.append(gold) or plain(a, b, gold, *rest))
    df = lambda rows: make(rows, "id long, text string")
    a, b = df([(1, "red ring"), (2, "iron bolt")]), df([(7, "red iron ring"), (8, "bolt of iron"), (9, "ring")])
    gold = df([(1, "7"), (2, "8")]).selectExpr("id as a_id", "cast(text as long) as b_id", "1 as matching").distinct()
    got = runs.blocking_grid(a, b, gold, [1, 2], orders=[False], blockers=["tfidf"]).collect()
    assert sorted((r["k"], r["n_found"]) for r in got) == [(1, 2), (1, 2), (2, 2), (2, 2)]
    assert len(read) == 2 and all("Aggregate" not in g._jdf.queryExecution().optimizedPlan().toString() for g in read)
