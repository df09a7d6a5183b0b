"""Whole runs: blocking, supervised, unsupervised, evaluation, full resolution."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sameas.functions.vectors import decide
from sameas.operators import candidates as C
from sameas.operators.graph import connected_components, two_sided_nodes
from sameas.operators.knn import knn_embedding
from sameas.operators.matching import encode_text, fit_matcher, out_of_fold_scores, pair_features, score_pairs, zero_shot_match
from sameas.operators.metrics import (best_threshold, classification_metrics, example_pairs, rates_of, roc_auc, roc_curve,
                                       threshold_sweep)
from sameas.operators.sampling import split_candidates
from sameas.operators.serialize import drop_columns, order_columns, serialize
from sameas.operators.tfidf import knn_tfidf
from sameas.session import cut_lineage
from sameas.sources.results import run_grid

PAIR = ["a_id", "b_id"]


def count_of(df: DataFrame):
    """Row count as a scalar column, evaluated with the query that uses it."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def prepare(a: DataFrame, b: DataFrame, drop_a: Sequence[str] = (), drop_b: Sequence[str] = (),
            order: bool = False, column_names: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two record tables to (id, text)."""
    a, b = drop_columns(a, drop_a), drop_columns(b, drop_b)
    if order:
        a, b = order_columns(a, b)
    return serialize(a, column_names=column_names), serialize(b, column_names=column_names)


def block(text_a: DataFrame, text_b: DataFrame, k: int = 15, vectors_a: DataFrame | None = None,
          vectors_b: DataFrame | None = None, with_tfidf: bool = True, same_table: bool = False) -> DataFrame:
    """(a_id, b_id, sources): embedding neighbours, merged with TF-IDF neighbours."""
    marked = vectors_a is None and (same_table or vectors_b is None)
    va = encode_text(text_a, marked=marked) if vectors_a is None else vectors_a
    vb = va if same_table else (encode_text(text_b, marked=marked) if vectors_b is None else vectors_b)
    found = [knn_embedding(va, vb, k, same_table, marked=marked)]
    if with_tfidf:
        found.append(knn_tfidf(text_a, text_b, k, same_table=same_table))
    return C.merge_candidates(*found)


def blocking_run(text_a: DataFrame, text_b: DataFrame, gold: DataFrame, k: int = 15, **options) -> DataFrame:
    """Blocking quality of one run, one row."""
    return C.blocking_metrics(block(text_a, text_b, k, **options), gold, count_of(text_a), count_of(text_b))


def blocking_cell(a: DataFrame, b: DataFrame, gold: DataFrame, ks: Sequence[int], order_cols: bool = False, remove_col_names: bool = True,
                  blocker: str = "tfidf") -> DataFrame:
    """Blocking quality for every k under one serialization: one neighbour search at the largest k, all k from its
    ranks. `blocker` is tfidf, embedding or merged."""
    text_a, text_b = prepare(a, b, order=order_cols, column_names=not remove_col_names)
    deepest = max(ks)
    found = {"tfidf": lambda: [knn_tfidf(text_a, text_b, deepest)],
             "embedding": lambda: [knn_embedding(encode_text(text_a, marked=True), encode_text(text_b, marked=True), deepest, marked=True)]}
    found["merged"] = lambda: found["tfidf"]() + found["embedding"]()
    ranked = reduce(DataFrame.unionByName, found[blocker]())
    return C.k_sweep(ranked, gold, count_of(a), count_of(b), deepest).filter(F.col("k").isin(list(ks)))


CELL = ["blocker", "order_cols", "remove_col_names"]
CELL_SCHEMA = ("k int, n_candidates bigint, n_found bigint, saved double, reduction_ratio double, recall double, f1 double, "
               "blocker string, order_cols boolean, remove_col_names boolean")


def blocking_grid(a: DataFrame, b: DataFrame, gold: DataFrame, ks: Sequence[int], orders: Sequence[bool] = (False, True),
                  removals: Sequence[bool] = (True, False), blockers: Sequence[str] = ("merged",), path: str | None = None,
                  most: int | None = None) -> DataFrame:
    """blocking_cell for every blocker and serialization. With a `path` cells are kept
    there as they finish and only the others run, at most `most` of them now."""
    cells = [(x, o, r) for x in blockers for o in orders for r in removals]
    gold = cut_lineage(gold)        # read by every cell
    run = lambda cell: blocking_cell(a, b, gold, ks, cell["order_cols"], cell["remove_col_names"], cell["blocker"])
    if path is not None:
        grid = a.sparkSession.createDataFrame(cells, "blocker string, order_cols boolean, remove_col_names boolean")
        whole = run_grid(grid, run, path, CELL_SCHEMA, most)
    else:
        whole = reduce(DataFrame.unionByName, [
            run(dict(zip(CELL, cell))).select("*", *[F.lit(v).alias(c) for c, v in zip(CELL, cell)]) for cell in cells])
    return whole.select(*CELL, *[c for c in whole.columns if c not in CELL])


def supervised_run(labelled: DataFrame, text_a: DataFrame, text_b: DataFrame, threshold: float = 0.65, seed=42) -> DataFrame:
    """Learn on 80 % of the labelled pairs, decide the rest: pairs with score, pred."""
    split = split_candidates(labelled.select(*PAIR, "matching"), seed=seed)
    features = cut_lineage(pair_features(split, text_a, text_b))     # read to learn and to score
    model = fit_matcher(features.filter(F.col("split") == "train"))
    scored = score_pairs(model, features.filter(F.col("split") == "test"))
    return scored.select(*PAIR, "matching", "score", decide(F.col("score"), threshold).alias("pred"))


def supervised_candidates_run(text_a: DataFrame, text_b: DataFrame, candidates: DataFrame, gold: DataFrame, folds: int = 3,
                              threshold: float = 0.65, seed=42) -> DataFrame:
    """From blocked candidates to decisions: pairs are labelled from `gold` (a_id, b_id,
    matching), scored by models that saw no pair of their a_id and decided. Columns
    a_id, b_id, matching, fold, score, pred."""
    labelled = C.label_candidates(candidates.select(*PAIR).distinct(), gold)
    scored = out_of_fold_scores(pair_features(labelled, text_a, text_b), folds, seed=seed)
    return scored.select(*PAIR, "matching", "fold", "score", decide(F.col("score"), threshold).alias("pred"))


def unsupervised_run(pairs: DataFrame, vectors_a: DataFrame, vectors_b: DataFrame, gold: DataFrame,
                     threshold: float = 0.65) -> DataFrame:
    """Candidate pairs decided by cosine and labelled from the gold pairs."""
    decided = zero_shot_match(pairs.select(*PAIR), vectors_a, vectors_b, threshold)
    return C.label_candidates(decided, gold)


def evaluation_report(decided: DataFrame, label: str = "matching") -> DataFrame:
    """Counts, metrics and ROC AUC of scored and decided pairs, one row."""
    auc = roc_auc(decided, label).scalar()
    return classification_metrics(decided, label).withColumn("roc_auc", auc)


def evaluation_table(decided: DataFrame, label: str = "matching") -> DataFrame:
    """(section, item, x, y): everything a report of scored and decided pairs shows, as one long table.

    count: pairs, matches and label sizes; cell: the confusion matrix; rate; auc; roc: x = fpr, y = tpr at
    every distinct score; best: threshold and F1; example: pairs with x = pred, y = label.
    Pairs are read once: grouping sets give the counts by score and label and by label and
    decision together, and all numbers follow from that table; examples are read in their own order.
    """
    pairs = decided.select(*PAIR, F.col("score").cast("double").alias("score"), F.col(label).alias("y"), "pred")
    sets = cut_lineage(pairs.groupingSets([[F.col("score"), F.col("y")], [F.col("y"), F.col("pred")]], F.col("score"), F.col("y"), F.col("pred")).agg(
        F.count(F.lit(1)).alias("n"), F.grouping("pred").alias("by_score")))
    by_score, cells = sets.filter("by_score = 1").select("score", "y", "n"), sets.filter("by_score = 0").select("y", "pred", "n")
    number = lambda c: c.cast("double")
    of = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")
    y, pred = F.col("y") == 1, F.col("pred") == 1
    counts = cells.agg(of(y & pred).alias("tp"), of(~y & pred).alias("fp"), of(y & ~pred).alias("fn"), of(~y & ~pred).alias("tn"))
    rates = rates_of(counts)
    listed = lambda df, section, names: df.select(F.lit(section).alias("section"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("item"), number(F.col(c)).alias("x"), F.lit(None).cast("double").alias("y")) for n, c in names.items()])))
    totals = counts.select((F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("pairs"), (F.col("tp") + F.col("fp")).alias("matches"),
                           (F.col("tp") + F.col("fn")).alias("positives"), (F.col("fp") + F.col("tn")).alias("negatives"))
    curve = roc_curve(by_score, weight="n")
    auc = roc_auc(by_score, weight="n")
    best = best_threshold(threshold_sweep(by_score, weight="n"))
    examples = example_pairs(pairs.select(*PAIR, "y", "pred"))
    section = lambda df, name, item, x, y: df.select(F.lit(name).alias("section"), item.alias("item"), number(x).alias("x"), number(y).alias("y"))
    parts = [
        listed(totals, "count", {c: c for c in totals.columns}), listed(counts, "cell", {c: c for c in counts.columns}),
        listed(rates, "rate", {c: c for c in ("accuracy", "precision", "recall", "f1")}), listed(auc, "auc", {"roc_auc": "roc_auc"}),
        section(curve, "roc", F.lit("point"), F.col("fpr"), F.col("tpr")), section(best, "best", F.lit("threshold"), F.col("threshold"), F.col("f1")),
        section(examples, "example", F.concat_ws(":", "a_id", "b_id"), F.col("pred"), F.col("y"))]
    return reduce(DataFrame.unionByName, parts)


def resolve_entities(candidates: DataFrame, matches: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, cluster_id, size, n_matches, n_candidates) of every entity of both tables,
    those without a match as clusters of one. `a`, `b` hold id; ids come as 'a:1', 'b:7'.

    A pair can only be closed inside a component of the matches, so closing adds no
    entity to a cluster: one component pass is enough. n_matches and n_candidates count
    the pairs with both ends in the cluster, decided and considered; their difference is
    what closing could still add.
    """
    known = cut_lineage(two_sided_nodes(matches).distinct())
    sides = a.select(F.concat(F.lit("a:"), F.col("id").cast("string")).alias("id")).unionByName(
        b.select(F.concat(F.lit("b:"), F.col("id").cast("string")).alias("id")))
    clusters = cut_lineage(connected_components(known, sides))
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    of = lambda end: clusters.select(F.col("id").alias(end), F.col("cluster_id").alias(f"{end}_cluster"))
    inside = lambda pairs, n: (
        pairs.join(of("src"), "src").join(of("dst"), "dst").filter(F.col("src_cluster") == F.col("dst_cluster"))
        .groupBy(F.col("src_cluster").alias("cluster_id")).agg(F.count(F.lit(1)).alias(n)))
    counts = (
        sizes.join(inside(known, "n_matches"), "cluster_id", "left")
        .join(inside(two_sided_nodes(candidates).distinct(), "n_candidates"), "cluster_id", "left")
        .fillna(0, ["n_matches", "n_candidates"]))
    return clusters.join(counts, "cluster_id").select("id", "cluster_id", "size", "n_matches", "n_candidates")
