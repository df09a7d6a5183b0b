"""Repeatable splits and samples of labelled pairs.

All randomness is md5(seed, key); shuffled positions come from hash_rank, which
never puts a table into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sameas.functions.ordering import hash_key, hash_number, hash_rank
from sameas.operators.graph import connected_components, two_sided_nodes
from sameas.session import cut_lineage

PAIR = ["a_id", "b_id"]


def _split_by_rank(rank: Column, first: Column, second: Column) -> Column:
    return F.when(rank <= first, "train").when(rank <= first + second, "val").otherwise("test")


def random_split(df: DataFrame, keys: Sequence[str] = PAIR, train: float = 0.7, val: float = 0.15, seed=42) -> DataFrame:
    """Adds split; exact sizes floor(train * n), floor(val * n), rest test."""
    ranked = hash_rank(df, keys, seed, total="n_rows")
    return ranked.withColumn("split", _split_by_rank(
        F.col("rank"), F.floor(train * F.col("n_rows")), F.floor(val * F.col("n_rows")))).drop("rank", "n_rows")


def hashed_split(df: DataFrame, keys: Sequence[str] = PAIR, train: float = 0.7, val: float = 0.15, seed=42) -> DataFrame:
    """Adds split row by row, without a shuffle; sizes are right on average."""
    at = hash_number(hash_key(seed, *keys)) / float(1 << 32)
    return df.withColumn("split", F.when(at < train, "train").when(at < train + val, "val").otherwise("test"))


def split_candidates(labelled: DataFrame, train: float = 0.8, seed=42) -> DataFrame:
    """Blocked pairs into train and test; validation stays the gold one."""
    return random_split(labelled, PAIR, train, 0.0, seed)


def few_shot_sample(labelled: DataFrame, positives: int = 5, negatives: int = 5, seed=0,
                    label: str = "matching", replacement: bool = False) -> DataFrame:
    """The first rows of each class in md5 order; with replacement, one draw per
    wanted row from the whole class."""
    want = F.when(F.col(label) == 1, positives).otherwise(negatives)
    if not replacement:
        order = Window.partitionBy(label).orderBy(hash_key(seed, *PAIR), *PAIR)
        ranked = labelled.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max(positives, negatives))
        return ranked.filter(F.col("n") <= want).drop("n")
    ranked = hash_rank(labelled, PAIR, seed, within=[label])
    sizes = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    draws = sizes.filter(want > 0).select(label, "size", F.explode(F.sequence(F.lit(1), want)).alias("draw"))
    draws = draws.select(label, "draw", (hash_number(hash_key(seed, label, "draw")) % F.col("size") + 1).alias("rank"))
    return ranked.join(draws, [label, "rank"]).drop("rank")      # positives + negatives rows


def component_split(positives: DataFrame, train: float = 0.7, val: float = 0.15, seed=42) -> DataFrame:
    """(a_id, b_id, cluster_id, split): whole components go to one split."""
    nodes = connected_components(two_sided_nodes(positives))
    groups = nodes.select("cluster_id").distinct()
    split = random_split(groups, ["cluster_id"], train, val, seed)
    owner = nodes.filter(F.col("id").startswith("a:")).select(F.substr("id", F.lit(3)).alias("a_text"), "cluster_id")
    pairs = positives.select(*PAIR).distinct().withColumn("a_text", F.col("a_id").cast("string"))
    return pairs.join(owner, "a_text").join(split, "cluster_id").select(*PAIR, "cluster_id", "split")


def negative_samples(positives: DataFrame, ratio: int = 1, seed=42) -> DataFrame:
    """(a_id, b_id, split): for every A end `ratio` non-matching pairs per positive it
    has, ends taken from positives of the same split.

    The B ends of a split stand in shuffled order; an A end with p positives walks
    (ratio + 1) * p of them from a place of its own and keeps the first ratio * p that
    are not its positives, so only a split with too few B ends gives fewer.
    """
    known = cut_lineage(positives.select(*PAIR, "split").distinct())
    ends = hash_rank(known.select("split", "b_id").distinct(), ["b_id"], seed, within=["split"])
    sizes = known.groupBy("split").agg(F.countDistinct("b_id").alias("size"))     # one row per split
    own = known.groupBy("split", "a_id").agg(F.count(F.lit(1)).alias("own"))
    place = hash_number(hash_key(seed, "split", "a_id"))
    walks = own.join(F.broadcast(sizes), "split").select(
        "split", "a_id", (ratio * F.col("own")).alias("wanted"), "size", place.alias("place"),
        F.explode(F.sequence(F.lit(0), F.least((ratio + 1) * F.col("own"), "size") - 1)).alias("step"))
    met = (
        walks.withColumn("rank", (F.col("place") + F.col("step")) % F.col("size") + 1).join(ends, ["split", "rank"])
        .join(known, [*PAIR, "split"], "left_anti")
    )
    first = Window.partitionBy("split", "a_id").orderBy("step")
    return met.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= F.col("wanted")).select(*PAIR, "split")


def assembled_split(positives: DataFrame, negatives: DataFrame, seed=42) -> DataFrame:
    """(a_id, b_id, split, matching, position): shuffled inside each split."""
    rows = positives.select(*PAIR, "split").withColumn("matching", F.lit(1)).unionByName(
        negatives.select(*PAIR, "split").withColumn("matching", F.lit(0)))
    return hash_rank(rows, PAIR, seed, out="position", within=["split"])


def shuffled(df: DataFrame, keys: Sequence[str] = PAIR, seed=42) -> DataFrame:
    """Adds position, a repeatable random order."""
    return hash_rank(df, keys, seed, out="position")
