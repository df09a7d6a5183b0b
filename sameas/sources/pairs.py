"""Labelled, candidate and scored pairs: readers, writers, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sameas.operators.sampling import random_split
from sameas.sources.lines import numbered_lines

PAIR = ["a_id", "b_id"]

# The header of a labelled pair file.
GOLD_A, GOLD_B, GOLD_LABEL = "source_id", "target_id", "matching"


def normal_label(raw: Column) -> Column:
    """1 or 0; null for what is neither (callers keep those as rejects)."""
    flag = F.try_to_number(F.trim(raw.cast("string")), F.lit("9.9")).cast("double")
    truth = raw.cast("string").try_cast("boolean")
    return F.when(flag.isNotNull(), (flag != 0).cast("int")).otherwise(truth.cast("int"))


def label_norm(df: DataFrame, label: str = GOLD_LABEL) -> DataFrame:
    return df.withColumn(label, normal_label(F.col(label)))


def read_gold(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """(a_id, b_id, matching, split) from the split files that exist; rows with an
    unreadable label keep matching = null."""
    parts = [spark.read.option("header", True).csv(path).select(
        F.col(GOLD_A).alias("a_id"), F.col(GOLD_B).alias("b_id"), normal_label(F.col(GOLD_LABEL)).alias("matching"),
        F.lit(split).alias("split")) for split, path in files.items()]
    if not parts:
        return spark.createDataFrame([], "a_id string, b_id string, matching int, split string")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def resolve_pairs(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Adds resolved: both ids exist, once each, in their tables."""
    known = lambda df, name: df.groupBy(F.col("id").alias(name)).agg(F.count(F.lit(1)).alias(f"n_{name}"))
    joined = pairs.join(known(a, "a_id"), "a_id", "left").join(known(b, "b_id"), "b_id", "left")
    once = (F.coalesce("n_a_id", F.lit(0)) == 1) & (F.coalesce("n_b_id", F.lit(0)) == 1)
    return joined.withColumn("resolved", once).select(*pairs.columns, "resolved")


def split_gold(train: DataFrame | None, val: DataFrame | None, test: DataFrame | None, seed=42) -> DataFrame | None:
    """What a saved dataset's splits become: train alone is cut 70/15/15, test
    alone and all three are kept, any other combination has no pairs."""
    if train is not None and val is None and test is None:
        return random_split(train.drop("split"), seed=seed)
    if train is None and val is None and test is not None:
        return test.drop("split").withColumn("split", F.lit("test"))
    if train is not None and val is not None and test is not None:
        named = [df.drop("split").withColumn("split", F.lit(s)) for df, s in ((train, "train"), (val, "val"), (test, "test"))]
        return named[0].unionByName(named[1]).unionByName(named[2])
    return None


def write_gold(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").partitionBy("split").parquet(path)


def candidate_lines(candidates: DataFrame) -> DataFrame:
    """(a_id, b_ids): the neighbour ids of one A row in one comma-joined text, at
    most the blockers' k together; write_candidates takes pairs without a bound."""
    return candidates.groupBy("a_id").agg(
        F.array_join(F.array_sort(F.collect_set("b_id")).cast("array<string>"), ",").alias("b_ids"))


def write_candidates(candidates: DataFrame, path: str) -> None:
    candidates.select(*PAIR).write.mode("overwrite").parquet(path)


def write_candidate_lines(candidates: DataFrame, path: str) -> None:
    """Text lines 'a_id,b_id,b_id,...', readable in any order of part files. A comma
    inside an id is written %2C, a percent sign %25."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "%", "%25"), ",", "%2C")
    lines = candidates.select(safe("a_id").alias("a_id"), safe("b_id").alias("b_id"))
    if dict(candidates.dtypes)["b_id"] == "string":
        lines = candidate_lines(lines)
    else:
        lines = candidate_lines(candidates.select(safe("a_id").alias("a_id"), "b_id"))
    lines.select(F.concat_ws(",", "a_id", "b_ids")).write.mode("overwrite").text(path)


def read_candidate_lines(spark: SparkSession, path: str) -> DataFrame:
    """(a_id, b_id), both text, from lines that start with the A id."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "%2C", ","), "%25", "%")
    fields = F.split("value", ",")
    return spark.read.text(path).filter(F.trim("value") != "").select(
        plain(fields[0]).alias("a_id"), F.explode(F.transform(F.slice(fields, F.lit(2), F.size(fields)), plain)).alias("b_id"))


def read_candidate_positions(spark: SparkSession, path: str) -> DataFrame:
    """(a_id, b_id) from an old positional file: line i holds the B positions of
    A row i. Lines are numbered split by split."""
    lines = numbered_lines(spark, path)
    return lines.select(F.col("line").alias("a_id"), F.explode(F.split("value", ",")).alias("b_id")).select(
        "a_id", F.col("b_id").try_cast("bigint").alias("b_id")).filter(F.col("b_id").isNotNull())


def write_scored(scored: DataFrame, path: str) -> None:
    """a_id,b_id,score without header."""
    scored.select(*PAIR, "score").write.mode("overwrite").option("header", False).csv(path)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("a_id string, b_id string, score double").csv(path)


def read_few_shot(spark: SparkSession, path: str) -> DataFrame:
    """(a_id, b_id, label): first, second and third column of a CSV, by position."""
    df = spark.read.option("header", True).csv(path)
    first, second, third = df.columns[:3]
    return df.select(F.col(first).alias("a_id"), F.col(second).alias("b_id"), normal_label(F.col(third)).alias("label"))


def append_labels(labelled: DataFrame, picked: DataFrame, label: int) -> DataFrame:
    """Labelled pairs plus pairs picked by search, each pair once; the new label wins."""
    new = picked.select(*PAIR).distinct().withColumn("label", F.lit(label))
    kept = labelled.select(*PAIR, "label").join(new.select(*PAIR), PAIR, "left_anti")
    return kept.unionByName(new)
