"""Candidate sets: merge, label, compare with the gold pairs, sweep k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PAIR = ["a_id", "b_id"]


def merge_candidates(*blocked: DataFrame) -> DataFrame:
    """Union of candidate sets, once per pair: (a_id, b_id, sources)."""
    rows = blocked[0].select(*PAIR, "source")
    for other in blocked[1:]:
        rows = rows.unionByName(other.select(*PAIR, "source"))
    return rows.groupBy(*PAIR).agg(F.array_sort(F.collect_set("source")).alias("sources"))


def blocker_overlap(merged: DataFrame) -> DataFrame:
    """How many pairs each combination of blockers found."""
    return merged.groupBy(F.array_join("sources", "+").alias("sources")).agg(F.count(F.lit(1)).alias("n_pairs"))


def neighbour_lists(candidates: DataFrame) -> DataFrame:
    """One list per A row, as exported: (a_id, b_ids). A list is as long as the
    blockers' k together; keep pairs in long form where no k bounds them."""
    return candidates.groupBy("a_id").agg(F.array_sort(F.collect_set("b_id")).alias("b_ids"))


def explode_lists(lists: DataFrame) -> DataFrame:
    return lists.select("a_id", F.explode("b_ids").alias("b_id"))


def undirected(candidates: DataFrame) -> DataFrame:
    """Self-linkage: each unordered pair once, smaller id first, no self pairs."""
    pairs = candidates.filter(F.col("a_id") != F.col("b_id")).select(
        F.least(*PAIR).alias("a_id"), F.greatest(*PAIR).alias("b_id"))
    return pairs.distinct()


def true_matches(gold: DataFrame) -> DataFrame:
    """Pairs labelled 1 in any split, once each."""
    return gold.filter(F.col("matching") == 1).select(*PAIR).distinct()


def label_candidates(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """matching = 1 if the pair is a true match, else 0."""
    truth = true_matches(gold).withColumn("matching", F.lit(1))
    return candidates.join(truth, PAIR, "left").withColumn("matching", F.coalesce("matching", F.lit(0)))


def gold_missed(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """True matches the blocking lost."""
    return true_matches(gold).join(candidates.select(*PAIR), PAIR, "left_anti")


def gold_found(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    return true_matches(gold).join(candidates.select(*PAIR), PAIR, "left_semi")


def _with_gold(candidates: DataFrame, gold: DataFrame, about: Column) -> DataFrame:
    """(a_id, b_id, is_gold 0/1, about): candidate and true pairs together, once
    each, in one grouping. `about` aggregates the candidate's columns (null without one)."""
    truth = gold.filter(F.col("matching") == 1).select(*PAIR, F.lit(1).alias("is_gold"))
    rows = candidates.withColumn("is_gold", F.lit(0)).unionByName(truth, allowMissingColumns=True)
    return rows.groupBy(*PAIR).agg(F.max("is_gold").alias("is_gold"), about)


def blocking_metrics(candidates: DataFrame, gold: DataFrame, size_a, size_b) -> DataFrame:
    """One row: pair counts, reduction ratio, recall and their harmonic mean.
    Recall and F1 are null without gold pairs. Sizes are numbers or scalars."""
    space = (F.lit(size_a) if isinstance(size_a, int) else size_a).cast("double") * size_b
    seen = _with_gold(candidates.select(*PAIR, F.lit(1).alias("hit")), gold, F.sum("hit").alias("times"))
    counted = seen.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (
        (F.col("times"), "n_candidates"), (F.col("times") * F.col("is_gold"), "n_found"), (F.col("is_gold"), "n_gold"))])
    rates = counted.select(
        "n_candidates", "n_found", "n_gold",
        (1 - F.try_divide(F.col("n_candidates"), space)).alias("reduction_ratio"),
        F.try_divide("n_found", "n_gold").alias("recall"))
    return rates.withColumn("f1", F.try_divide(2 * F.col("reduction_ratio") * F.col("recall"),
                                               F.col("reduction_ratio") + F.col("recall")))


def average_neighbours(candidates: DataFrame, a: DataFrame) -> DataFrame:
    """Mean list length over all A rows; rows without candidates count 0."""
    n_a = a.agg(F.count(F.lit(1)).alias("n")).scalar()
    return candidates.agg(F.count(F.lit(1)).alias("n_candidates")).select(
        n_a.alias("n_a"), "n_candidates", F.try_divide(F.col("n_candidates"), n_a).alias("avg_neighbors"))


def k_sweep(ranked: DataFrame, gold: DataFrame, size_a, size_b, k_max: int) -> DataFrame:
    """Blocking quality for every k up to k_max from one ranked candidate set.

    A pair enters at its best rank and stays: count pairs per entry rank (at most
    k_max rows), then add up along k. `ranked` may union several blockers.
    """
    entry = _with_gold(ranked.filter(F.col("rank") <= k_max).select(*PAIR, "rank"), gold, F.min("rank").alias("k"))
    steps = entry.groupBy("k").agg(F.count("k").alias("new_pairs"), F.sum("is_gold").alias("golden"))
    every_k = ranked.sparkSession.range(1, k_max + 1).select(
        F.col("id").cast("int").alias("k"), F.lit(0).alias("new_pairs"), F.lit(0).alias("golden"))
    so_far = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)      # k_max + 1 rows; pairs not found: k null
    space = (F.lit(size_a) if isinstance(size_a, int) else size_a).cast("double") * size_b
    per_k = steps.unionByName(every_k).groupBy("k").agg(F.sum("new_pairs").alias("new_pairs"), F.sum("golden").alias("golden"))
    summed = per_k.select(
        "k", F.sum("new_pairs").over(so_far).alias("n_candidates"),
        F.sum(F.when(F.col("k").isNotNull(), F.col("golden")).otherwise(0)).over(so_far).alias("n_found"),
        F.sum("golden").over(Window.partitionBy()).alias("n_gold")).filter(F.col("k").isNotNull())
    rates = summed.select(
        "k", "n_candidates", "n_found",
        (space - F.col("n_candidates")).alias("saved"),
        (1 - F.try_divide(F.col("n_candidates"), space)).alias("reduction_ratio"),
        F.try_divide("n_found", "n_gold").alias("recall"))
    return rates.withColumn("f1", F.try_divide(2 * F.col("reduction_ratio") * F.col("recall"),
                                               F.col("reduction_ratio") + F.col("recall")))


def error_attribution(gold: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Where each true or predicted match was won or lost: (a_id, b_id, outcome)."""
    truth = true_matches(gold).withColumn("is_gold", F.lit(True))
    kept = candidates.select(*PAIR).distinct().withColumn("is_candidate", F.lit(True))
    said = matches.select(*PAIR).distinct().withColumn("is_match", F.lit(True))
    seen = truth.join(said, PAIR, "full_outer").join(kept, PAIR, "left")
    return seen.select(*PAIR, F.when(F.col("is_gold") & F.col("is_match"), "correct")
                       .when(F.col("is_match"), "false match")
                       .when(F.col("is_candidate"), "missed in matching")
                       .otherwise("lost in blocking").alias("outcome"))
