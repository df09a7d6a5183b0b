"""Classification quality of scored or decided pairs.

Label and prediction columns hold 0/1. Everything is one aggregate, or running
totals over distinct scores; nothing is evaluated once per threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from sameas.functions.ordering import previous_point, running_totals
from sameas.functions.vectors import decide, linspace


def _count(condition: Column, weight: str | None = None) -> Column:
    """Rows that meet the condition; with `weight` a row stands for that many."""
    each = condition.cast("bigint") if weight is None else F.when(condition, F.col(weight)).otherwise(0).cast("bigint")
    return F.coalesce(F.sum(each), F.lit(0).cast("bigint"))


def _rates(zero_division: float | None) -> list[Column]:
    """accuracy, precision, recall, f1 from tp, fp, fn, tn."""
    undefined = F.lit(zero_division).cast("double")
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    part = lambda num, den: F.coalesce(F.try_divide(num, den), undefined)
    return [part(tp + tn, tp + fp + fn + tn).alias("accuracy"), part(tp, tp + fp).alias("precision"),
            part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1")]


def confusion_counts(df: DataFrame, label: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn in one pass."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    return df.groupBy(*by).agg(_count(y & p).alias("tp"), _count(~y & p).alias("fp"),
                               _count(y & ~p).alias("fn"), _count(~y & ~p).alias("tn"))


def classification_metrics(df: DataFrame, label: str = "y", pred: str = "pred", by: Sequence[str] = (),
                           zero_division: float | None = 0.0) -> DataFrame:
    return confusion_counts(df, label, pred, by).select(*by, "tp", "fp", "fn", "tn", *_rates(zero_division))


def rates_of(counts: DataFrame, zero_division: float | None = 0.0) -> DataFrame:
    """Adds accuracy, precision, recall and f1 to tp, fp, fn, tn."""
    return counts.select("*", *_rates(zero_division))


def match_set_metrics(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """Two sets of pairs compared; 'accuracy' is the found share of the truth."""
    pair = ["a_id", "b_id"]
    said = matches.select(*pair).distinct().withColumn("m", F.lit(1))
    real = truth.select(*pair).distinct().withColumn("r", F.lit(1))
    counts = said.join(real, pair, "full_outer").agg(
        _count(F.col("m").isNotNull() & F.col("r").isNotNull()).alias("tp"),
        _count(F.col("r").isNull()).alias("fp"), _count(F.col("m").isNull()).alias("fn"))
    zero = lambda num, den: F.coalesce(F.try_divide(num, den), F.lit(0.0))
    rated = counts.select("tp", "fp", "fn", zero(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                          zero(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    return rated.select("*", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
                        .alias("f1"), F.col("recall").alias("accuracy"))


def confusion_matrix(df: DataFrame, label: str = "y", pred: str = "pred") -> DataFrame:
    """All four cells (y, pred, n), also the empty ones."""
    counts = confusion_counts(df, label, pred)
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    rows = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(p).alias("pred"), F.col(c).alias("n")) for y, p, c in cells])
    return counts.select(F.inline(rows))


def classification_report(df: DataFrame, label: str = "y", pred: str = "pred") -> DataFrame:
    """(class, precision, recall, f1, support) for 0, 1, accuracy, macro and weighted average."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    part = lambda num, den: F.coalesce(F.try_divide(num, den), F.lit(0.0))
    wide = confusion_counts(df, label, pred).select(
        part(tp, tp + fp).alias("p1"), part(tp, tp + fn).alias("r1"), part(2 * tp, 2 * tp + fp + fn).alias("f1"),
        part(tn, tn + fn).alias("p0"), part(tn, tn + fp).alias("r0"), part(2 * tn, 2 * tn + fp + fn).alias("f0"),
        (F.col("tp") + F.col("fn")).alias("n1"), (F.col("tn") + F.col("fp")).alias("n0"),
        part(tp + tn, tp + fp + fn + tn).alias("acc"))
    total = F.col("n0") + F.col("n1")
    macro = lambda m: (F.col(f"{m}0") + F.col(f"{m}1")) / 2
    weighted = lambda m: part(F.col(f"{m}0") * F.col("n0") + F.col(f"{m}1") * F.col("n1"), total)
    row = lambda name, p, r, f, n: F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                                            f.alias("f1"), n.alias("support"))
    return wide.select(F.inline(F.array(
        row("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("n0")),
        row("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("n1")),
        row("accuracy", F.col("acc"), F.col("acc"), F.col("acc"), total),
        row("macro avg", macro("p"), macro("r"), macro("f"), total),
        row("weighted avg", weighted("p"), weighted("r"), weighted("f"), total))))


def _by_score(df: DataFrame, label: str, score: str, weight: str | None = None) -> DataFrame:
    """(score, pos, neg): one row per distinct score."""
    return df.groupBy(F.col(score).alias("score")).agg(
        _count(F.col(label) == 1, weight).alias("pos"), _count(F.col(label) == 0, weight).alias("neg"))


def roc_curve(df: DataFrame, label: str = "y", score: str = "score", weight: str | None = None) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) at every distinct score, and the origin
    (threshold null). A rate without its class is null."""
    summed = running_totals(_by_score(df, label, score, weight), "score", ["pos", "neg"], descending=True)
    points = summed.select(F.col("score").alias("threshold"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                           "total_pos", "total_neg")
    none = F.lit(0).cast("bigint")
    origin = summed.agg(F.max("total_pos").alias("total_pos"), F.max("total_neg").alias("total_neg")).select(
        F.lit(None).cast("double").alias("threshold"), none.alias("tp"), none.alias("fp"), "total_pos", "total_neg")
    return points.unionByName(origin).select(
        "threshold", "tp", "fp", F.try_divide("tp", "total_pos").alias("tpr"), F.try_divide("fp", "total_neg").alias("fpr"))


def roc_auc(df: DataFrame, label: str = "y", score: str = "score", weight: str | None = None) -> DataFrame:
    """One row (roc_auc): share of (positive, negative) pairs in the right order,
    ties half. Null with one class only."""
    summed = running_totals(_by_score(df, label, score, weight), "score", ["neg"])
    below = F.col("cum_neg") - F.col("neg")
    sums = summed.agg(F.sum(F.col("pos") * (below + F.col("neg") / 2)).alias("won"),
                      F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return sums.select(F.try_divide(F.col("won"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("roc_auc"))


def auc_of_curve(curve: DataFrame, x: str = "fpr", y: str = "tpr") -> DataFrame:
    """One row (auc): trapezoids under the points taken in order of (x, y)."""
    linked = previous_point(curve.select(x, y), x, y, [x, y])
    area = (F.col(x) - F.col(f"prev_{x}")) * (F.col(y) + F.col(f"prev_{y}")) / 2
    return linked.agg(F.sum(area).alias("auc"))


def threshold_sweep(df: DataFrame, thresholds: Sequence[float] | None = None, label: str = "y",
                    score: str = "score", zero_division: float | None = 0.0, weight: str | None = None) -> DataFrame:
    """Metrics at each threshold (default 100 in [0, 1]).

    Every score falls between two thresholds, found by binary search; rows are counted
    per gap (as many as thresholds) and the gaps added up from above. A null score
    is above no threshold, NaN above all.
    """
    grid = sorted(linspace(0.0, 1.0, 100) if thresholds is None else thresholds)
    counts = df.select((-F.col(score)).cast("double").alias("__low"), F.col(label).alias("__label"), *([] if weight is None else [weight]))
    distinct = sorted(set(map(float, grid)))
    if distinct:
        splits = [float("-inf"), *[-t for t in reversed(distinct)], float("inf")]
        counts = Bucketizer(splits=splits, inputCol="__low", outputCol="__not", handleInvalid="keep").transform(counts)
        reached = F.when(F.col("__low").isNull(), 0).when(F.isnan("__low"), len(distinct)).otherwise(len(distinct) - F.col("__not").cast("int"))
    else:
        reached = F.lit(0)
    # equal thresholds are passed together
    upto = F.array(*[F.lit(sum(t in distinct[:i] for t in grid)) for i in range(len(distinct) + 1)])
    gaps = counts.groupBy(F.get(upto, reached).alias("passed")).agg(
        _count(F.col("__label") == 1, weight).alias("pos"), _count(F.col("__label") == 0, weight).alias("neg"))
    spark = df.sparkSession
    steps = spark.createDataFrame([(i, float(t)) for i, t in enumerate(grid)] + [(len(grid), None)],
                                  "passed int, threshold double")
    from_above = Window.orderBy(F.col("passed").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    filled = steps.join(gaps, "passed", "left").fillna(0, ["pos", "neg"])
    counted = filled.select(
        "threshold",
        F.coalesce(F.sum("pos").over(from_above), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("neg").over(from_above), F.lit(0)).alias("fp"),
        F.sum("pos").over(everything).alias("n_pos"), F.sum("neg").over(everything).alias("n_neg"),
    ).filter(F.col("threshold").isNotNull())
    full = counted.select("threshold", "tp", "fp", (F.col("n_pos") - F.col("tp")).alias("fn"),
                          (F.col("n_neg") - F.col("fp")).alias("tn"))
    return full.select("threshold", "tp", "fp", "fn", "tn", *_rates(zero_division))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row with the highest F1, the smallest threshold among equals."""
    best = sweep.agg(F.max(F.struct("f1", (-F.col("threshold")).alias("minus"))).alias("best"))
    return best.select((-F.col("best.minus")).alias("threshold"), F.col("best.f1").alias("f1"))


def log_loss(df: DataFrame, label: str = "y", prob: str = "score", eps: float = 1e-15) -> DataFrame:
    """One row (log_loss): mean binary cross-entropy, probabilities clipped."""
    p = F.greatest(F.least(F.col(prob), F.lit(1 - eps)), F.lit(eps))
    y = F.col(label)
    return df.agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def label_balance(df: DataFrame, label: str = "matching") -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def text_length(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.agg(F.max(F.length(text_col)).alias("max_length"))


def grid_summary(scored: DataFrame, config: Sequence[str], threshold: float = 0.65, label: str = "y") -> DataFrame:
    """Metrics of every configuration of a scored grid, in one pass."""
    return classification_metrics(scored.withColumn("pred", decide(F.col("score"), threshold)), label, "pred", config)


def best_f1(summary: DataFrame, by: Sequence[str]) -> DataFrame:
    return summary.groupBy(*by).agg(F.max("f1").alias("best_f1"))


def best_config(summary: DataFrame, by: Sequence[str], config: Sequence[str]) -> DataFrame:
    """The configuration with the highest F1 per group, the first among equals."""
    first = Window.partitionBy(*by).orderBy(F.col("f1").desc(), *config)
    return summary.withColumn("n", F.row_number().over(first)).filter(F.col("n") == 1).select(*by, *config, "f1")


def example_pairs(decided: DataFrame, matches: int = 3, others: int = 2, order: Sequence[str] = ("a_id", "b_id")) -> DataFrame:
    """First matches and first non-matches; a class that runs short is filled up
    from the other one."""
    want = matches + others
    ranked = decided.withColumn("n", F.row_number().over(Window.partitionBy("pred").orderBy(*order)))
    few = ranked.filter(F.col("n") <= want)      # at most `want` rows per class
    turn = F.when(F.col("pred") == 1, F.col("n") > matches).otherwise(F.col("n") > others)
    place = Window.orderBy(turn, F.col("pred").desc(), "n")
    return few.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= want).drop("n")
