import numpy as np
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from sameas.operators import matching as D
from sameas.operators.metrics import roc_auc
from sameas.sources import entities as E, pairs as R, results as Z

PAIRS = "a_id long, b_id long"


def folder(tmp_path, name, files):
    here = tmp_path / name
    here.mkdir()
    for file, text in files.items():
        (here / file).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(here)


def test_two_table_layout_and_latin1(spark, tmp_path):
    path = folder(tmp_path, "left-right", {
        "1_left.csv": "subject_id,name\n1,caf\xe9\n2,\"a, \"\"b\"\"\"\n".encode("latin1"), "2_right.csv": "subject_id,name\n7,café\n",
        "gs_train.csv": "source_id,target_id,matching\n1,7,True\n2,7,False\n", "gs_test.csv": "source_id,target_id,matching\n2,7,1\n9,7,what\n"})
    layout = E.resolve_layout(spark, path)
    assert not layout.self_linkage and set(layout.gold) == {"train", "test"}
    a, b = E.read_entities(spark, layout.table_a), E.read_entities(spark, layout.table_b)
    assert rows_of(a, "id", "name") == [("1", "café"), ("2", 'a, "b"')] and rows_of(b, "name") == [("café",)]
    assert E.list_columns(a) == ["name"]
    gold = R.read_gold(spark, layout.gold)
    assert sorted((r["a_id"], r["matching"], r["split"]) for r in gold.fillna(-1).collect()) == [
        ("1", 1, "train"), ("2", 0, "train"), ("2", 1, "test"), ("9", -1, "test")]
    assert rows_of(R.resolve_pairs(gold.select("a_id", "b_id"), a, b).distinct(), "a_id", "resolved") == [
        ("1", True), ("2", True), ("9", False)]


def test_other_layouts(spark, tmp_path):
    one = folder(tmp_path, "shop", {f: "subject_id,x\n1,y\n" for f in ("shop.csv", "gs_train.csv", "gs_val.csv", "gs_test.csv")})
    assert E.resolve_layout(spark, one).self_linkage
    own = folder(tmp_path, "custom_dataset", {"1_custom.csv": "subject_id\n1\n", "2_custom.csv": "subject_id\n1\n"})
    layout = E.resolve_layout(spark, own)
    assert layout.table_b.endswith("2_custom.csv") and layout.gold == {}
    assert R.read_gold(spark, layout.gold).count() == 0


def test_labels(make):
    df = make([(v,) for v in ("1", "0", "True", "false", "1.0", " 0 ", "maybe", None)], "matching string")
    assert [r["matching"] for r in R.label_norm(df).collect()] == [1, 0, 1, 0, 1, 0, None, None]
    assert R.label_norm(make([(True,), (False,)], "matching boolean")).agg(F.sum("matching")).head()[0] == 1


def test_split_rules(make):
    rows = make([(i, i, 1) for i in range(20)], PAIRS + ", matching int")
    assert R.split_gold(rows, None, None).groupBy("split").count().count() == 3
    assert rows_of(R.split_gold(None, None, rows).select("split").distinct(), "split") == [("test",)]
    assert R.split_gold(rows, rows, rows).count() == 60
    assert R.split_gold(rows, rows, None) is None and R.split_gold(None, rows, None) is None


def test_round_trips(spark, make, tmp_path):
    scored = make([(1, 2, 0.5), (1, 3, 0.123456789012), (4, 2, 1.0)], PAIRS + ", score double")
    R.write_scored(scored, str(tmp_path / "scored"))
    assert rows_of(R.read_scored(spark, str(tmp_path / "scored")), "a_id", "score") == [("1", 0.123456789012), ("1", 0.5), ("4", 1.0)]
    R.write_candidate_lines(scored, str(tmp_path / "lines"))
    assert rows_of(R.read_candidate_lines(spark, str(tmp_path / "lines")), "a_id", "b_id") == [("1", "2"), ("1", "3"), ("4", "2")]
    named = make([("x1", "y1"), ("x1", "y,2"), ("50%", "y%2C")], "a_id string, b_id string")
    R.write_candidate_lines(named, str(tmp_path / "named"))
    assert rows_of(R.read_candidate_lines(spark, str(tmp_path / "named")), "a_id", "b_id") == [("50%", "y%2C"), ("x1", "y,2"), ("x1", "y1")]
    (tmp_path / "pairs.txt").write_text("3,5\n\n0\n")
    assert rows_of(R.read_candidate_positions(spark, str(tmp_path / "pairs.txt")), "a_id", "b_id") == [(0, 3), (0, 5), (2, 0)]
    Z.export_results(scored, str(tmp_path / "results"))
    assert spark.read.option("header", True).csv(str(tmp_path / "results")).columns == ["Entity A", "Entity B", "Score"]
    assert Z.read_results(spark, str(tmp_path / "results")).agg(F.sum("score")).head()[0] == pytest.approx(1.623456789012)
    R.write_gold(scored.withColumn("split", F.lit("test")), str(tmp_path / "gold"))
    assert spark.read.parquet(str(tmp_path / "gold")).filter("split = 'test'").count() == 3
    R.write_candidates(scored, str(tmp_path / "cand"))
    E.write_tables(make([(1, "x")], "id long, name string"), make([(2, "y")], "id long, name string"), str(tmp_path / "tables"))
    assert rows_of(E.read_entities(spark, str(tmp_path / "tables" / "table_b.parquet")), "id", "name") == [(2, "y")]


def test_results_bookkeeping(spark, make, tmp_path):
    names = make([("x/results_abt-buy.csv",), ("results_custom_dataset.csv",), ("results_other.csv",), ("abt-buy.csv",)], "f string")
    assert [r[0] for r in names.select(Z.dataset_name(F.col("f"))).collect()] == ["abt-buy", "custom_dataset", None, None]
    for seconds in (1.0, 3.0):
        Z.write_run_metric(spark, str(tmp_path / "runs"), "blocking", seconds)
    assert rows_of(Z.run_time(spark.read.parquet(str(tmp_path / "runs"))), "run", "mean_seconds", "n") == [("blocking", 2.0, 2)]
    (tmp_path / "m.json").write_text('{"Accuracy": 0.9,\n "Precision": 0.8, "Recall": 0.4, "F1": 0.5}')
    assert rows_of(Z.read_run_metrics(spark, str(tmp_path / "m.json"), "prior"), "method", "f1") == [("prior", 0.5)]
    grid = Z.option_grid(spark, {"model": ["m", "n"], "k": [5, 8]})
    done = make([("m", 5), ("m", 5)], "model string, k int")
    assert rows_of(Z.pending(grid, done, ["model", "k"]), "model", "k") == [("m", 8), ("n", 5), ("n", 8)]
    Z.write_summary(done, str(tmp_path / "summary"))
    (tmp_path / "few.csv").write_text("idA,idB,label\n1,2,1\n3,4,0\n")
    assert rows_of(R.read_few_shot(spark, str(tmp_path / "few.csv")), "a_id", "b_id", "label") == [("1", "2", 1), ("3", "4", 0)]
    labelled = make([(1, 1, 0), (2, 2, 1)], PAIRS + ", label int")
    assert rows_of(R.append_labels(labelled, make([(1, 1), (5, 5)], PAIRS), 1), "a_id", "label") == [(1, 1), (2, 1), (5, 1)]


@pytest.fixture(scope="module")
def products(spark):
    base = ["red steel ring", "blue oak table", "green tin box", "small iron bolt", "large glass jar", "white wool sock"]
    a = spark.createDataFrame([(i, t) for i, t in enumerate(base * 5)], "id long, text string")
    b = spark.createDataFrame([(i, t.replace("e", "a") + " new") for i, t in enumerate(base * 5)], "id long, text string")
    pairs = spark.createDataFrame([(i, j, int(i % 6 == j % 6)) for i in range(30) for j in range(i % 4, 30, 4)], PAIRS + ", matching int")
    return a, b, pairs


def test_encoders(products):
    a, _, _ = products
    vectors = D.encode_text(a, dim=64)
    assert rows_of(vectors, "id", "embedding") == rows_of(D.encode_text(a.repartition(5), dim=64), "id", "embedding")
    assert vectors.filter(F.size("embedding") != 64).count() == 0
    own = D.encode_text(a, lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert rows_of(own, "id", "embedding")[0] == (0, [14.0, 1.0])


def test_matcher_learns_saves_and_scores_two_entities(spark, products, tmp_path):
    a, b, pairs = products
    features = D.pair_features(pairs, a, b).persist()
    assert features.count() == pairs.count()
    model = D.fit_best(features, features, grid=(("logistic", 0.01), ("logistic", 0.5)))
    scored = D.score_pairs(model, features)
    assert roc_auc(scored, "matching").head()["roc_auc"] > 0.95
    row = D.evaluate(scored, 0.5).head()
    assert row["f1"] > 0.9
    assert D.validation_metrics(scored).head()["f1"] >= row["f1"]
    D.save_matcher(model, str(tmp_path / "model"))
    again = D.load_matcher(str(tmp_path / "model"))
    alike = D.score_entities(spark, again, "red steel ring", "red steel ring new")
    apart = D.score_entities(spark, again, "red steel ring", "blue oak table")
    assert alike > 0.5 > apart
    one = scored.filter("a_id = 0 and b_id = 0").head()
    assert D.score_entities(spark, again, "red steel ring", "rad staal ring naw") >= 0 and one["score"] > 0.5


def test_pair_scorer_and_few_shot(products):
    a, b, pairs = products
    scored = D.score_with(D.pair_texts(pairs, a, b), lambda x, y: [float(s[:3] == t[:3]) for s, t in zip(x, y)])
    assert scored.count() == pairs.count() and scored.schema["score"].dataType.simpleString() == "double"
    labelled = pairs.join(D.pair_cosine(pairs.select("a_id", "b_id"), D.encode_text(a), D.encode_text(b)), ["a_id", "b_id"])
    decided = D.few_shot_match(labelled, labelled.limit(60))
    assert set(r["pred"] for r in decided.select("pred").distinct().collect()) <= {0, 1}
    assert D.zero_shot_match(pairs, D.encode_text(a), D.encode_text(b), 0.2).filter("pred = 1").count() > 0


def test_grid_resumes_where_it_broke_off(spark, make, tmp_path):
    path, ran = str(tmp_path / "grid"), []
    grid = Z.option_grid(spark, {"model": ["m", "n"], "k": [5, 8, 9]})
    schema = "f1 double, model string, k int"

    def run(cell, fail_at=None):
        if len(ran) == fail_at:
            raise RuntimeError("lost")
        ran.append((cell["model"], cell["k"]))
        return make([(cell["k"] / 10,), (1.0,)], "f1 double")

    assert Z.read_cells(spark, path, schema).count() == 0
    with pytest.raises(RuntimeError):
        Z.run_grid(grid, lambda cell: run(cell, fail_at=3), path, schema)
    assert ran == [("m", 5), ("m", 8), ("m", 9)]
    assert rows_of(Z.run_grid(grid, run, path, schema, most=1).select("model", "k").distinct(), "model", "k") == [*ran]
    whole = Z.run_grid(grid, run, path, schema)
    assert ran == [(m, k) for m in ("m", "n") for k in (5, 8, 9)] and whole.count() == 12
    Z.write_cell(make([(0.0,)], "f1 double"), path, {"model": "m", "k": 8})      # a cell is replaced alone
    assert sorted(r["f1"] for r in Z.read_cells(spark, path, schema).filter("model = 'm'").collect()) == [0.0, 0.5, 0.9, 1.0, 1.0]


def test_folds_never_see_their_own_entities(make):
    rows = [(i % 40, i, int(i % 3 == 0)) for i in range(240)]
    features = make([(a, b, y, 0.9 * y + 0.05 * (b % 2)) for a, b, y in rows], "a_id long, b_id long, matching int, f double")
    wide = features.select("*", *[F.col("f").alias(c) for c in D.FEATURES]).drop("f")
    scored = D.out_of_fold_scores(wide, 3, grid=[("logistic", 0.01)])
    assert scored.count() == 240 and scored.groupBy("a_id").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    assert {r["fold"] for r in scored.select("fold").distinct().collect()} == {0, 1, 2}
    assert scored.filter("(score > 0.5) <> (matching = 1)").count() == 0
    one_label = D.out_of_fold_scores(wide.withColumn("matching", F.lit(0)), 2, grid=[("logistic", 0.01)])
    assert one_label.filter("score = 0").count() == 240


def odd_csv(seed, rows):
    import random
    rng = random.Random(seed)
    cell = lambda: rng.choice(['plain', '', '""', '"a, b"', '"two\nlines"', '"she said ""no"",\n\nthen ""yes"""', '5" disk', 'ü', '"\n"', ' x ', '"long ' + "y" * 300 + '"'])
    return "subject_id,name,note\n" + "".join(f"{i},{cell()},{cell()}\n" for i in range(rows)) + "\n"


@pytest.mark.parametrize("encoding", ["utf-8", "latin1"])
@pytest.mark.parametrize("split", ["257", "4096", "128m"])
def test_csv_is_read_in_splits(spark, tmp_path, split, encoding):
    text = odd_csv(3, 300)
    path = folder(tmp_path, "tables", {"table_a.csv": text.encode(encoding), "table_b.csv": odd_csv(4, 40).encode(encoding)})
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for source in (f"{path}/table_a.csv", path + "/*.csv"):
            whole = E._csv(spark, source, "UTF-8" if encoding == "utf-8" else "ISO-8859-1", True).toDF("id", "name", "note")
            read = E.read_entities(spark, source)
            assert read.columns == ["id", "name", "note"]
            order = lambda df: sorted(map(repr, df.collect()))
            assert order(read) == order(whole)
        assert split == "128m" or E.csv_records(spark, f"{path}/table_a.csv")[0].rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_positions_are_numbered_over_splits(spark, tmp_path):
    lines = [",".join(str((i * 7 + j) % 500) for j in range(i % 4)) for i in range(500)]
    path = folder(tmp_path, "blocked", {"positions.txt": "\n".join(lines) + "\n"})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        found = rows_of(R.read_candidate_positions(spark, path + "/positions.txt"), "a_id", "b_id")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == sorted((i, int(x)) for i, line in enumerate(lines) for x in line.split(",") if x)


def test_empty_csv_files(spark, tmp_path):
    path = folder(tmp_path, "none", {"a.csv": "subject_id,name\n"})
    df = E.read_entities(spark, path + "/a.csv")
    assert df.columns == ["id", "name"] and df.count() == 0


def test_encoder_hashes_a_word_once(make, monkeypatch):
    """Counts by hand; no expression hashes the pieces of every word of every text."""
    import hashlib
    import math
    from collections import Counter
    from sameas.operators import matching
    monkeypatch.setattr(matching, "ENCODED_ROWS", 2)
    texts = ["red ring é ab", "", None, "red red Ünder_9", "x", "𝒳abcd ring"]
    df = make(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["embedding"] for r in matching.encode_text(df, dim=32).collect()}
    for i, text in enumerate(texts):
        words = [w for w in re.findall(r"\w+", (text or "").lower()) if len(w) > 1]
        pieces = [p for w in words for p in [w, *(w[at:at + 3] for at in range(max(len(w) - 2, 1)))]]
        counts = Counter(int(hashlib.md5(p.encode()).hexdigest()[:8], 16) % 32 for p in pieces)
        norm = math.sqrt(sum(n * n for n in counts.values())) or 1.0
        assert got[i] == pytest.approx([counts[slot] / norm for slot in range(32)])
    plan = matching.encode_text(df)._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan.lower()


def test_pairs_bring_back_no_vectors(make, monkeypatch):
    """The cosine of a pair is that of its encodings, whose 512 numbers a text do not leave the task."""
    monkeypatch.setattr(D, "ENCODED_ROWS", 2)
    monkeypatch.setattr(D, "ENCODED_WORDS", 3)
    texts = ["red ring é ab", "", None, "red red Ünder_9", "many more words than three in this one", "ring red"]
    df = make(list(enumerate(texts)), "id long, text string")
    pairs = make([(i, j) for i in range(6) for j in range(6)], PAIRS)
    vectors = {r["id"]: np.array(r["embedding"]) for r in D.encode_text(df).collect()}
    features = D.pair_features(pairs, df, df)
    got = {(r["a_id"], r["b_id"]): r["text_cosine"] for r in features.collect()}
    assert len(got) == 36 and all(got[i, j] == pytest.approx(float(vectors[i] @ vectors[j])) for i, j in got)
    plan = features._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "zip_with" not in plan.lower()
