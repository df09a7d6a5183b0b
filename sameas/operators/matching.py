"""Encoders, pair features, matchers and the plug-in points for user models."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sameas.functions.ordering import hash_key, hash_number
from sameas.functions.text import edit_ratio, length_ratio, text_fingerprint, token_jaccard, tokens
from sameas.functions.vectors import cosine_similarity, decide
from sameas.operators.metrics import best_threshold, classification_metrics, log_loss, threshold_sweep
from sameas.operators.serialize import pair_texts
from sameas.session import cut_lineage

PAIR = ["a_id", "b_id"]
FEATURES = ["edit_ratio", "token_jaccard", "length_ratio", "text_cosine"]
DIM = 512           # slots of the built-in encoder
PIECES = 100_000    # words, and as many letter triples, whose slots a task remembers
ENCODED_ROWS = 256  # texts whose words are counted together at most
ENCODED_WORDS = 50_000      # their words, about
GRID = (("logistic", 0.0), ("logistic", 0.01), ("logistic", 0.1))


def piece_slot(piece: str, dim: int) -> int:
    """The first 32 bits of a piece's md5 modulo `dim`, the same wherever md5 is."""
    return int.from_bytes(hashlib.md5(piece.encode(), usedforsecurity=False).digest()[:4], "big") % dim


def _slices(batch: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, last) of at most ENCODED_ROWS lists with about ENCODED_WORDS words."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch), 0).to_numpy())
    first = 0
    while first < len(batch):
        most = (ends[first - 1] if first else 0) + ENCODED_WORDS
        last = min(max(first + 1, int(np.searchsorted(ends, most, "right"))), first + ENCODED_ROWS)
        yield first, last
        first = last


def _counter(dim: int) -> Callable[[pa.Array], np.ndarray]:
    """Of lists of words the counts of their slots, a row of `dim` a list. A task hashes
    a word once, however often it comes, while it is among the last PIECES."""
    slot = lru_cache(PIECES)(lambda piece: piece_slot(piece, dim))
    triples = lambda word: map(slot, map("".join, zip(word, word[1:], word[2:]))) if len(word) > 2 else (slot(word),)
    slots_of = lru_cache(PIECES)(lambda word: (piece_slot(word, dim), *triples(word)))

    def count(words: pa.Array) -> np.ndarray:
        coded = pc.list_flatten(words).dictionary_encode()
        known = list(map(slots_of, coded.dictionary.to_pylist()))
        size = np.fromiter(map(len, known), np.int64, len(known))
        slots = np.fromiter(chain.from_iterable(known), np.int64, size.sum())
        begin, at = np.cumsum(size) - size, coded.indices.to_numpy().astype(np.int64)
        n = size[at]
        piece = np.arange(n.sum()) + np.repeat(begin[at] - (np.cumsum(n) - n), n)
        row = np.repeat(np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy()), n)
        return np.bincount(row * dim + slots[piece], minlength=len(words) * dim).reshape(len(words), dim)

    return count


def _words(text: str) -> Column:
    return tokens(F.coalesce(F.col(text), F.lit("")))


def _unit_counts(text: str, dim: int) -> Column:
    """The unit vector of the counts of a text's slots."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = _counter(dim)
        for batch in batches:
            parts = []
            for first, last in _slices(batch):
                counts = count(batch.slice(first, last - first))
                norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
                parts.append(np.divide(counts, norm, out=np.zeros(counts.shape), where=norm > 0).ravel())
            flat = np.concatenate([np.zeros(0), *parts])
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * dim, pa.int32()), pa.array(flat))

    return F.arrow_udf(run, T.ArrayType(T.DoubleType()))(_words(text))


def _text_cosine(left: str, right: str, dim: int) -> Column:
    """Cosine of the encodings of two texts of a row, which stay where they are counted; 0 without a word."""
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        count = _counter(dim)
        for a, b in batches:
            parts = []
            for first, last in _slices(a):
                ends = [(x + first, y + first) for x, y in _slices(b.slice(first, last - first))]
                for low, high in ends:
                    one, two = count(a.slice(low, high - low)), count(b.slice(low, high - low))
                    product = lambda x, y: np.einsum("ij,ij->i", x, y).astype(np.float64)
                    length = np.sqrt(product(one, one)) * np.sqrt(product(two, two))
                    parts.append(np.divide(product(one, two), length, out=np.zeros(high - low), where=length > 0))
            yield pa.array(np.concatenate([np.zeros(0), *parts]))

    return F.arrow_udf(run, T.DoubleType())(_words(left), _words(right))


def encode_text(df: DataFrame, encoder: Callable[[list[str]], np.ndarray] | None = None, dim: int = DIM, marked: bool = False) -> DataFrame:
    """(id, embedding), with `marked` also fp, which equal texts share. With a user's `encoder` (texts in, matrix out) it runs on
    Arrow batches; without one, words and their letter triples are hashed into
    `dim` counts of unit length. A text without a word has the zero vector."""
    if encoder is not None:
        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(list(np.asarray(encoder(texts.fillna("").tolist()), dtype=np.float32)))

        vector = apply("text")
    else:
        vector = _unit_counts("text", dim)
    return df.select("id", vector.alias("embedding"), *([text_fingerprint(F.col("text")).alias("fp")] if marked else []))


def pair_cosine(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Adds score = cosine of the two sides' (id, embedding), pair by pair."""
    side = lambda df, tag: df.select(F.col("id").alias(f"{tag}_id"), F.col("embedding").cast("array<double>").alias(f"{tag}_vec"))
    return (
        pairs.join(side(a, "a"), "a_id").join(side(b, "b"), "b_id")
        .withColumn("score", cosine_similarity(F.col("a_vec"), F.col("b_vec"))).drop("a_vec", "b_vec")
    )


def zero_shot_match(pairs: DataFrame, a: DataFrame, b: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Pairs with score and pred, from vectors alone."""
    return pair_cosine(pairs, a, b).withColumn("pred", decide(F.col("score"), threshold))


def pair_features(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """The columns of `pairs` and FEATURES, from the whole texts of both sides, which
    are brought to the pair once; only texts in pairs are encoded, and no vector leaves its task."""
    ta, tb = F.col("a_text"), F.col("b_text")
    # few bytes, much measuring: keep every core busy, which sizes alone would not
    spark = pairs.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = pair_texts(pairs, a, b).repartition(width)
    return texts.select(
        *pairs.columns, edit_ratio(ta, tb).alias("edit_ratio"), token_jaccard(ta, tb).alias("token_jaccard"),
        length_ratio(ta, tb).alias("length_ratio"), _text_cosine("a_text", "b_text", DIM).alias("text_cosine"))


def _estimator(kind: str, regularisation: float):
    if kind == "logistic":
        return LogisticRegression(labelCol="label", featuresCol="features", regParam=regularisation)
    if kind == "trees":
        return GBTClassifier(labelCol="label", featuresCol="features", maxIter=20, maxDepth=4, seed=42)
    raise ValueError(f"unknown matcher {kind!r}")


def fit_matcher(features: DataFrame, label: str = "matching", kind: str = "logistic",
                regularisation: float = 0.01, inputs: Sequence[str] = tuple(FEATURES)) -> PipelineModel:
    """Learn P(match) from labelled pair features; the fit is distributed."""
    rows = features.select(F.col(label).cast("double").alias("label"), *inputs).persist()     # many passes
    stages = [VectorAssembler(inputCols=list(inputs), outputCol="features"), _estimator(kind, regularisation)]
    try:
        return Pipeline(stages=stages).fit(rows)
    finally:
        rows.unpersist()


def score_pairs(model: PipelineModel, features: DataFrame) -> DataFrame:
    """The columns of `features` and score = P(match)."""
    out = model.transform(features)
    return out.select(*features.columns, vector_to_array("probability")[1].alias("score"))


def validation_metrics(scored: DataFrame, label: str = "matching") -> DataFrame:
    """(threshold, f1) best on these rows."""
    return best_threshold(threshold_sweep(scored, label=label))


def fit_best(train: DataFrame, validation: DataFrame, label: str = "matching",
             grid: Sequence[tuple[str, float]] = GRID) -> PipelineModel:
    """The grid point with the lowest loss on the validation pairs, the first
    among equals."""
    train, validation = train.persist(), validation.persist()
    try:
        best, best_loss = None, float("inf")
        for kind, regularisation in grid:
            model = fit_matcher(train, label, kind, regularisation)
            loss = log_loss(score_pairs(model, validation), label).head()["log_loss"]
            if best is None or (loss is not None and loss < best_loss):
                best, best_loss = model, float("inf") if loss is None else loss
        return best
    finally:
        train.unpersist()
        validation.unpersist()


def fold_of(key: str, folds: int, seed=42) -> Column:
    """A number below `folds` by hash: rows of one key are in one fold."""
    return (hash_number(hash_key(seed, F.lit("fold"), key)) % folds).cast("int")


def out_of_fold_scores(features: DataFrame, folds: int = 3, label: str = "matching", grid: Sequence[tuple[str, float]] = GRID,
                       seed=42) -> DataFrame:
    """`features` with fold and score, every score from a model that saw no pair of
    the row's a_id. One table of features serves all folds and grid points; the grid
    point of the lowest loss over all held-out rows, the first among equals, gives the scores."""
    rows = cut_lineage(features.withColumn("fold", fold_of("a_id", folds, seed)))
    best, best_loss = None, float("inf")
    for kind, regularisation in grid:
        parts = []
        for fold in range(folds):
            train = rows.filter(F.col("fold") != fold)
            if train.select(label).distinct().count() < 2:      # one label only: its share
                held = rows.filter(F.col("fold") == fold).join(train.agg(F.coalesce(F.avg(F.col(label).cast("double")), F.lit(0.5)).alias("score")))
            else:
                held = score_pairs(fit_matcher(train, label, kind, regularisation), rows.filter(F.col("fold") == fold))
            parts.append(held.select(*rows.columns, "score"))
        scored = cut_lineage(reduce(DataFrame.unionByName, parts))
        loss = log_loss(scored, label).head()["log_loss"]
        if best is None or (loss is not None and loss < best_loss):
            best, best_loss = scored, float("inf") if loss is None else loss
    return best


def few_shot_threshold(sample: DataFrame, label: str = "matching") -> DataFrame:
    """(threshold, f1) learned from a handful of scored, labelled pairs."""
    return best_threshold(threshold_sweep(sample, label=label))


def few_shot_match(pairs: DataFrame, sample: DataFrame, label: str = "matching") -> DataFrame:
    """Scored `pairs` decided with the threshold learned from the sample."""
    cut = few_shot_threshold(sample, label).select("threshold").scalar()
    return pairs.withColumn("pred", decide(F.col("score"), cut))


def score_with(texts: DataFrame, scorer: Callable[[list[str], list[str]], Sequence[float]]) -> DataFrame:
    """(a_id, b_id, score) from a user's model on batches of (a_text, b_text)."""
    schema = T.StructType([texts.schema["a_id"], texts.schema["b_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = scorer(pdf["a_text"].tolist(), pdf["b_text"].tolist()) if len(pdf) else []
            yield pdf[PAIR].assign(score=np.asarray(scores, dtype="float64"))

    return texts.select("a_id", "b_id", "a_text", "b_text").mapInPandas(run, schema)


def score_entities(spark: SparkSession, model: PipelineModel, a_text: str, b_text: str) -> float:
    """P(match) of two given serialized entities, by the batch code path."""
    side = lambda text: spark.createDataFrame([(0, text)], "id long, text string")
    pair = spark.createDataFrame([(0, 0)], "a_id long, b_id long")
    return score_pairs(model, pair_features(pair, side(a_text), side(b_text))).head()["score"]


def save_matcher(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_matcher(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def evaluate(scored: DataFrame, threshold: float = 0.65, label: str = "matching") -> DataFrame:
    return classification_metrics(scored.withColumn("pred", decide(F.col("score"), threshold)), label)
