"""Document quality from positives and unlabelled text alone.

Trusted documents are positives, the rest of the corpus is unlabelled: a mixture of
good text with a share called the class prior. A first classifier of positives against
unlabelled text gives the prior: among the texts it scores above a level, unlabelled
ones are at least prior times as frequent as positives, and where only good text lies,
no more than that. The final network then minimises the non-negative unbiased risk
(Kiryo et al. 2017): prior * loss of positives as good + max(0, loss of unlabelled as
bad - prior * loss of positives as bad).

Features are counts of kinds of signs and of three kinds in a row, of words and their
repetition, all from whole texts in numpy. Labels of any other kind are not used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sameas.llm.fitting import Adam, bounded_share, by_hash, score_texts, sigmoid
from sameas.llm.packing import SpanHash, fold_of, mix, pick, row_of, spans

POSITIVES = 6_000        # trusted texts learned from, at most
UNLABELLED = 12_000      # other texts, at most
THRESHOLD = 0.7          # score from which a text is predicted good
TRIGRAMS = 256           # buckets of three kinds of signs in a row
HIDDEN = 24
STEPS = 400
BATCH = 1024

_KIND = np.zeros(256, np.uint8)
_KIND[97:123] = 1                  # lower-case letters
_KIND[128:] = 1                    # letters beyond ASCII, byte by byte
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[32, 9]] = 4
_KIND[[10, 13]] = 5
for _n, _sign in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _KIND[ord(_sign)] = 6 + _n
KINDS = 6 + 32 + 1
BUCKET = (mix(np.arange(KINDS**3, dtype=np.uint64)) % np.uint64(TRIGRAMS)).astype(np.int32)
EXTRA = 12
FEATURES = KINDS + TRIGRAMS + EXTRA


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES numbers per text, of about unit size."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(n, dtype=np.int32), lengths)
    kind = _KIND[data]
    counts = np.bincount(row * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS).astype(np.float64)
    triple = np.zeros((n, TRIGRAMS))
    if len(data) > 2:
        code = (kind[:-2].astype(np.int32) * KINDS + kind[1:-1]) * KINDS + kind[2:]
        same = row[:-2] == row[2:]
        triple = np.bincount((row[:-2] * TRIGRAMS + BUCKET[code])[same], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    size = np.maximum(lengths, 1)[:, None]
    extra = np.zeros((n, EXTRA))
    starts, ends = spans((kind != 4) & (kind != 5), offsets)
    if len(starts):
        word = SpanHash(data)(starts, ends)
        at = row_of(offsets, starts)
        words = np.maximum(np.bincount(at, minlength=n), 1)
        again = (word[1:] == word[:-1]) & (at[1:] == at[:-1])
        order = np.lexsort((word, at))
        fresh = np.r_[True, (word[order][1:] != word[order][:-1]) | (at[order][1:] != at[order][:-1])]
        distinct = np.bincount(at[order][fresh], minlength=n)
        long = ends - starts
        first, last = kind[starts], kind[ends - 1]
        share = lambda mask: np.bincount(at, mask, minlength=n) / words
        repeats = np.bincount(at[1:], again, minlength=n) / words
        extra = np.stack([
            np.log1p(words) / 5, repeats, distinct / words, np.minimum(np.bincount(at, long, minlength=n) / words / 10, 3),
            share(long == 1), share(long > 15), share(first == 2), share((first == 2) & (last == 2)), share(last > 5),
            share((last > 5) & (long == 1)), share(first > 5), np.log1p(lengths) / 8], axis=1)
    return np.concatenate([np.sqrt(counts / size), np.sqrt(triple / size), extra], axis=1).astype(np.float32)


class Network:
    """One hidden layer."""

    def __init__(self, rng: np.random.Generator, mean: np.ndarray, spread: np.ndarray):
        self.mean, self.spread = mean, spread
        self.w = (rng.normal(size=(len(mean), HIDDEN)) / len(mean) ** 0.5).astype(np.float32)
        self.b, self.v, self.c = np.zeros(HIDDEN, np.float32), (rng.normal(size=HIDDEN) / HIDDEN**0.5).astype(np.float32), np.zeros(1, np.float32)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def logit(self, scaled: np.ndarray) -> np.ndarray:
        return np.tanh(scaled @ self.w + self.b) @ self.v + self.c[0]

    def train(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, rng: np.random.Generator, steps: int) -> None:
        """Rows already scaled. Without a prior: plain log loss of positive against unlabelled."""
        adam = Adam([self.w, self.b, self.v, self.c], 0.005)
        for _ in range(steps):
            p = positive[rng.integers(0, len(positive), min(BATCH, 2 * len(positive)))]
            u = unlabelled[rng.integers(0, len(unlabelled), min(2 * BATCH, 2 * len(unlabelled)))]
            x = np.concatenate([p, u])
            h = np.tanh(x @ self.w + self.b)
            g = h @ self.v + self.c[0]
            gp, gu = g[:len(p)], g[len(p):]
            if prior is None:
                slope = np.concatenate([(sigmoid(gp) - 1) / len(p), sigmoid(gu) / len(u)])
            else:
                # sigmoid loss: l(z) = 1 / (1 + exp(z)), slope -s(z) s(-z)
                bend_p, bend_u = sigmoid(gp) * sigmoid(-gp), sigmoid(gu) * sigmoid(-gu)
                negative = sigmoid(gu).mean() - prior * sigmoid(gp).mean()
                if negative >= 0:
                    slope = np.concatenate([-2 * prior * bend_p / len(p), bend_u / len(u)])
                else:           # the risk of bad text cannot be below zero: undo what made it so
                    slope = np.concatenate([prior * bend_p / len(p), -bend_u / len(u)])
            slope = slope.astype(np.float32)
            back = np.outer(slope, self.v) * (1 - h * h)
            adam.update([x.T @ back + 1e-4 * self.w, back.sum(axis=0), h.T @ slope, np.array([slope.sum()], np.float32)])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Smallest ratio of unlabelled to positive scores above a level, with room for chance."""
    levels = np.quantile(positive, np.linspace(0.02, 0.9, 60))
    above = lambda scores: np.array([(scores >= level).mean() for level in levels])
    p, u = above(positive), above(unlabelled)
    room = np.sqrt(u * (1 - u) / len(unlabelled)) + np.sqrt(np.maximum(p * (1 - p), 0) / len(positive))
    best = int(np.argmin((u + room) / np.maximum(p, 1e-9)))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.05, 0.98))


class QualityModel:
    def __init__(self, network: Network | None, prior: float):
        self.network, self.prior = network, prior

    def score(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        if self.network is None:
            return {"score": np.ones(len(offsets) - 1)}
        logit = self.network.logit(self.network.scaled(features(data, offsets)))
        # the network's border between good and bad is 0: it goes to the threshold
        return {"score": sigmoid(logit.astype(np.float64) + np.log(THRESHOLD / (1 - THRESHOLD)))}


def fit_quality(docs: DataFrame, trusted: DataFrame, held_out: int = 2, folds: int = 4, positives: int = POSITIVES,
                unlabelled: int = UNLABELLED, seed: int = 42) -> QualityModel:
    """Learns from at most `positives` trusted texts and `unlabelled` others, chosen by
    hash; `docs` is (doc_id, text), `trusted` (doc_id). Fold `held_out` is left out."""
    learn = lambda df: df.filter((F.col("doc_id").isNotNull()) & (fold_of("doc_id", folds) != held_out))
    names = learn(trusted).select("doc_id").distinct()
    chosen = names.filter(by_hash("doc_id", bounded_share(names.count(), positives))).withColumn("trusted", F.lit(True))
    rest = learn(docs)
    share = bounded_share(rest.select("doc_id").count(), unlabelled)
    marked = rest.join(F.broadcast(chosen), "doc_id", "left")          # at most `positives` ids, give or take
    drawn = marked.filter(F.col("trusted") | by_hash("doc_id", share)).select(
        "text", F.coalesce("trusted", F.lit(False)).alias("trusted"), by_hash("doc_id", share).alias("drawn"))
    table = score_texts(drawn, lambda data, offsets: {"x": [r.tobytes() for r in features(data, offsets)]}, "x binary").toArrow()
    if table.num_rows == 0:
        return QualityModel(None, 1.0)
    x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float32).reshape(-1, FEATURES)
    good, other = x[table["trusted"].to_numpy()][:positives], x[table["drawn"].to_numpy()][:unlabelled]
    if len(good) == 0 or len(other) == 0:
        return QualityModel(None, 1.0)
    rng = np.random.default_rng(seed)
    mean, spread = other.mean(axis=0), other.std(axis=0) + 0.02
    first = Network(rng, mean, spread)
    good, other = first.scaled(good)[rng.permutation(len(good))], first.scaled(other)
    half = len(good) // 2
    first.train(good[:max(half, 1)], other, None, rng, STEPS // 2)
    prior = class_prior(first.logit(good[half:]), first.logit(other))
    final = Network(rng, mean, spread)
    final.train(good, other, prior, rng, STEPS)
    return QualityModel(final, prior)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every whole text.

    Null and empty texts are scored like any text (all counts 0). A model without any
    trusted text has nothing to tell bad text by: score 1. Repeated ids stay rows;
    other columns are not read.
    """
    scored = score_texts(pick(docs, id_col, text_col).toDF("id", "text"), model.score, "score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that score at least `threshold`."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    twice = plain.withColumn("text", F.col(f"c{names.index(text_col)}"))
    scored = score_texts(twice, model.score, "score double")
    return scored.filter(F.col("score") >= threshold).drop("score").toDF(*names)
