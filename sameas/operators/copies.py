"""Exact copies are compared once.

Rows with the same fingerprint have the same neighbours at the same scores, so a
nearest-neighbour join runs on one representative per distinct value and its
answer is expanded afterwards. A value shared by a third of all rows then costs
one comparison, not a quadratic number. Ties go to the smaller id, so of each
value only the k + 1 smallest ids can ever appear in a list of k neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from sameas.session import dealt

SCORE_DIGITS = 9   # scores are rounded before ranking, so copies tie exactly
ROOM = 1e-6        # scores this much below the k-th may still tie with it


def _members(df: DataFrame, limit: int) -> DataFrame:
    """The `limit` smallest ids of every fingerprint, with the smallest as rep."""
    by_value = Window.partitionBy("fp").orderBy("id")
    ranked = df.select("fp", "id").withColumn("n", F.row_number().over(by_value)).filter(F.col("n") <= limit)
    return ranked.drop("n")


def _representatives(df: DataFrame) -> DataFrame:
    return df.groupBy("fp").agg(F.min("id").alias("rep"))


def _one_each(df: DataFrame) -> DataFrame:
    """The row with the smallest id of every fingerprint."""
    first = df.groupBy("fp").agg(F.min_by(F.struct(*[c for c in df.columns if c != "fp"]), "id").alias("row"))
    return first.select("row.*", "fp")


def nearest_by_value(
    a: DataFrame,
    b: DataFrame,
    k: int,
    search: Callable[[DataFrame, DataFrame, int], DataFrame],
    same_table: bool = False,
) -> DataFrame:
    """k best (a_id, b_id, score, rank) by score desc, b_id asc.

    `a`, `b` hold (id, fp, ...); `search(reps_a, reps_b, k)` returns at least the
    k best (a_id, b_id, score) among representatives. With `same_table` a row is
    not its own neighbour.
    """
    depth = k + 1 if same_table else k
    rep_a = _representatives(a)
    rep_b = rep_a if same_table else _representatives(b)
    single_a = _one_each(a)
    single_b = single_a if same_table else _one_each(b)

    found = search(single_a, single_b, depth).withColumn("score", F.round("score", SCORE_DIGITS))
    groups = top_k(found, depth)

    members_b = dealt(_members(b, depth)).join(rep_b, "fp").select(F.col("rep").alias("b_rep"), F.col("id").alias("b_id"))
    lists = (
        groups.select("a_id", F.col("b_id").alias("b_rep"), "score")
        .join(dealt(members_b), "b_rep")
        .select("a_id", "b_id", "score")
    )
    lists = top_k(lists, depth).withColumnRenamed("a_id", "a_rep").drop("rank")

    owners = dealt(a.select("fp", "id")).join(rep_a, "fp").select(F.col("rep").alias("a_rep"), F.col("id").alias("a_id"))
    full = dealt(owners).join(lists, "a_rep").select("a_id", "b_id", "score")
    if same_table:
        full = full.filter(F.col("a_id") != F.col("b_id"))
    return top_k(full, k)


def top_k(scored: DataFrame, k: int, key: str = "a_id", tie: str = "b_id") -> DataFrame:
    """Best k rows per key by score desc, then smaller id; adds rank. Spark
    prunes to k per key before the shuffle (WindowGroupLimit)."""
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded score) of the k best of every row of a matrix, ties to the smaller column."""
    width = scores.shape[1]
    if not scores.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    place = width - min(k, width)
    least = np.partition(scores, place, axis=1)[:, place] - ROOM
    row, column = np.nonzero(scores >= least[:, None])
    score = np.round(scores[row, column], SCORE_DIGITS)
    order = np.lexsort((column, -score, row))
    row, column, score = row[order], column[order], score[order]
    few = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[few], column[few], score[few]
