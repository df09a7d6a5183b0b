"""Toxicity by a convolutional network over hashed words.

A word (lower case) and its beginnings are hashed to rows of a table, and the sum of the
rows is the word's embedding, so that inflections of a stem are alike. Filters of width
1, 2 and 3 slide over the words, each keeps its highest response in the whole text, and
a linear layer over those gives a logit. Training is plain numpy on a bounded sample.
Scoring multiplies each distinct word of a block by the filters once.

Thresholds are set per language so that score 0.5 is the border that fits each one
best. The language is read off the text by its function words; a table's language
column is never used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sameas.llm.fitting import Adam, bounded_share, by_hash, score_texts, sigmoid
from sameas.llm.packing import SpanHash, fold_of, pick, row_of, spans

LABELLED = 6_000         # labelled texts learned from, at most, half of them toxic where there are so many
BUCKETS = 1 << 16         # rows of the embedding table; 0 stands for nothing and for the border of a text
STEMS = (3, 4, 5, 6, 7, 8)      # bytes of a longer word's beginnings
DEPTH = 8                 # numbers per word
FILTERS = 8               # per width
WIDTHS = (1, 2, 3)
EPOCHS = 6
BATCH_TEXTS = 48
LEAST_OF_LANGUAGE = 30    # toxic texts that a threshold of its own needs

# Frequent short words, the same in any corpus of the language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on by this are",
    "de": "der die das und ist von den mit für ein eine sich auch zu im",
    "fr": "le la les des et une est que dans pour du au qui sur par",
    "es": "el los las que del una por con para su al se lo como más",
}
LANGUAGES = ["other", *FUNCTION_WORDS]

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True


def _function_hashes() -> tuple[np.ndarray, np.ndarray]:
    pairs = [(word.encode(), number) for number, name in enumerate(LANGUAGES) if number for word in FUNCTION_WORDS[name].split()]
    data = np.frombuffer(b"".join(w for w, _ in pairs), np.uint8)
    ends = np.cumsum([len(w) for w, _ in pairs])
    hashes = SpanHash(data)(np.r_[0, ends[:-1]], ends)
    order = np.argsort(hashes)
    return hashes[order], np.array([n for _, n in pairs])[order]


FUNCTION_HASHES, FUNCTION_LANGUAGES = _function_hashes()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of each word among the distinct ones, from 1; word at which each text
    starts; language of each text; buckets of each distinct word, row 0 of the border)."""
    n = len(offsets) - 1
    starts, ends = spans(_INSIDE[data], offsets)
    spell = SpanHash(data)
    hashes = spell(starts, ends)
    row = row_of(offsets, starts)
    firsts = np.searchsorted(row, np.arange(n + 1))
    place = np.minimum(np.searchsorted(FUNCTION_HASHES, hashes), len(FUNCTION_HASHES) - 1)
    known = FUNCTION_HASHES[place] == hashes
    votes = np.bincount(row[known] * len(LANGUAGES) + FUNCTION_LANGUAGES[place[known]], minlength=n * len(LANGUAGES))
    language = votes.reshape(n, -1).argmax(axis=1)
    distinct, at, number = np.unique(hashes, return_index=True, return_inverse=True)
    parts = np.zeros((len(distinct) + 1, 1 + len(STEMS)), np.uint16)
    bucket = lambda h: (h % np.uint64(BUCKETS - 1)).astype(np.uint16) + np.uint16(1)
    parts[1:, 0] = bucket(distinct)
    begin, size = starts[at], ends[at] - starts[at]
    for i, stem in enumerate(STEMS, 1):
        longer = size > stem
        parts[1:, i][longer] = bucket(~spell(begin[longer], begin[longer] + stem))
    return number + 1, firsts, language, parts


def framed(numbers: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with borders on both sides of every text, so that each has a window and none
    holds another text's words: (sequence, place of each text's first window)."""
    gap = max(WIDTHS)
    lead = gap - 1          # windows that begin in the border before a text are the text's
    lengths = np.diff(firsts)
    places = np.cumsum(np.r_[0, lengths[:-1] + gap]) if len(lengths) else np.zeros(0, np.int64)
    sequence = np.zeros(lead + int(lengths.sum()) + gap * len(lengths) + gap, np.int64)
    at = np.repeat(places + lead - firsts[:-1], lengths) + np.arange(len(numbers))
    sequence[at] = numbers
    return sequence, places


@dataclass
class ToxicityModel:
    table: np.ndarray
    filters: list[np.ndarray]           # per width: (width * DEPTH, FILTERS)
    offsets: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    thresholds: np.ndarray              # logit that counts as 0.5, per language

    def logits(self, sequence: np.ndarray, places: np.ndarray, parts: np.ndarray) -> np.ndarray:
        vectors = sum(self.table[parts[:, i]] for i in range(parts.shape[1]))
        peaks = []
        n = len(sequence) - max(WIDTHS) + 1
        for width, f, b in zip(WIDTHS, self.filters, self.offsets):
            response = sum((vectors @ f[j * DEPTH:(j + 1) * DEPTH])[sequence[j:n + j]] for j in range(width))
            peaks.append(np.maximum(np.maximum.reduceat(response, places, axis=0) + b, 0))
        return np.concatenate(peaks, axis=1) @ self.out + self.bias[0]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        numbers, firsts, language, parts = words(data, offsets)
        logit = self.logits(*framed(numbers, firsts), parts).astype(np.float64) - self.thresholds[language]
        return {"score": sigmoid(logit), "language": np.array(LANGUAGES, object)[language]}


def no_model() -> ToxicityModel:
    """Knows no toxic text: score near 0 for everything."""
    wide = [np.zeros((w * DEPTH, FILTERS), np.float32) for w in WIDTHS]
    return ToxicityModel(np.zeros((BUCKETS, DEPTH), np.float32), wide, [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                         np.zeros(FILTERS * len(WIDTHS), np.float32), np.full(1, -6, np.float32), np.zeros(len(LANGUAGES)))


def _word_odds(texts: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Lower bound of each bucket's log odds of standing in a toxic text."""
    counts = np.zeros((2, BUCKETS))
    for text, label in zip(texts, toxic):
        counts[int(label), np.unique(text)] += 1
    clean, bad = counts + 0.5
    odds = np.log(bad / (toxic.sum() + 1)) - np.log(clean / ((~toxic).sum() + 1))
    return np.clip(odds - 3 / np.sqrt(bad), -2, 4) * (counts[1] > 0)


def train(texts: list[np.ndarray], toxic: np.ndarray, rng: np.random.Generator) -> ToxicityModel:
    """`texts` are the words' buckets, (words, 1 + stems) each."""
    model = no_model()
    model.table[:] = rng.normal(size=model.table.shape) * 0.02
    model.table[:, 0] = _word_odds(texts, toxic) / 4          # a start that training moves on from
    model.table[0] = 0
    for width, f in zip(WIDTHS, model.filters):
        f[:] = rng.normal(size=f.shape) * 0.1
        f[::DEPTH] += 0.5 / width
    model.out[:] = 1.0 / len(model.out)
    model.bias[0] = -1
    adam = Adam([*model.filters, *model.offsets, model.out, model.bias], 0.01)
    rate, pull = 0.05, np.zeros(BUCKETS)
    balance = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum())) * len(toxic)
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH_TEXTS):
            rows = order[at:at + BATCH_TEXTS]
            firsts = np.cumsum([0, *(len(texts[i]) for i in rows)])
            parts = np.concatenate([np.zeros((1, 1 + len(STEMS)), np.uint16), *(texts[i] for i in rows)])
            sequence, places = framed(np.arange(1, len(parts)), firsts)
            n = len(sequence) - max(WIDTHS) + 1
            vectors = sum(model.table[parts[:, i]] for i in range(parts.shape[1]))
            text_of = np.repeat(np.arange(len(rows)), np.diff(np.r_[places, n]))
            peaks, where = [], []
            for width, f, b in zip(WIDTHS, model.filters, model.offsets):
                response = sum((vectors @ f[j * DEPTH:(j + 1) * DEPTH])[sequence[j:n + j]] for j in range(width)) + b
                top = np.maximum.reduceat(response, places, axis=0)
                peaks.append(top)
                where.append(np.minimum.reduceat(np.where(response == top[text_of], np.arange(n)[:, None], n), places, axis=0))
            peak = np.concatenate(peaks, axis=1)
            active = np.maximum(peak, 0)
            slope = ((sigmoid(active @ model.out + model.bias[0]) - toxic[rows]) * balance[rows] / len(rows)).astype(np.float32)
            back = np.outer(slope, model.out) * (peak > 0)
            gradients, grad_b = [], []
            for k, (width, f) in enumerate(zip(WIDTHS, model.filters)):
                d = back[:, k * FILTERS:(k + 1) * FILTERS]
                g = np.zeros_like(f)
                for j in range(width):
                    seen = sequence[where[k] + j]                                   # (texts, FILTERS)
                    g[j * DEPTH:(j + 1) * DEPTH] = np.einsum("tfd,tf->df", vectors[seen], d)
                    change = (d[:, :, None] * f[j * DEPTH:(j + 1) * DEPTH].T[None]).reshape(-1, DEPTH)
                    for bucket in parts[seen.ravel()].T:
                        np.add.at(pull, bucket, (change**2).sum(axis=1))
                        np.add.at(model.table, bucket, -rate * change / np.sqrt(pull[bucket] + 1e-4)[:, None])
                gradients.append(g + 1e-4 * f)
                grad_b.append(d.sum(axis=0))
            model.table[0] = 0
            adam.update([*gradients, *grad_b, active.T @ slope + 1e-4 * model.out, np.array([slope.sum()], np.float32)])
    return model


def best_threshold(logit: np.ndarray, toxic: np.ndarray) -> float:
    """Middle of the widest gap that gives the fewest errors (toxic and clean weigh the same)."""
    order = np.argsort(logit)
    values, bad = logit[order], toxic[order]
    missed = np.r_[0, np.cumsum(bad)] / max(1, bad.sum())
    false = np.r_[(~bad).sum(), (~bad).sum() - np.cumsum(~bad)] / max(1, (~bad).sum())
    errors = (missed + false)[1:-1]
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    gap = (values[1:] - values[:-1])[best]
    at = best[int(gap.argmax())]
    return float((values[at] + values[at + 1]) / 2)


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5, limit: int = LABELLED,
                 seed: int = 42) -> ToxicityModel:
    """Learns from at most `limit` labelled texts chosen by hash; `docs` is
    (doc_id, text), `labels` (doc_id, toxic 0/1). Fold `held_out` is left out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold_of("doc_id", folds) != held_out))
    sizes = {int(r["toxic"]): r["count"] for r in known.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return no_model()
    share = F.when(F.col("toxic") == 1, bounded_share(sizes[1], limit // 2)).otherwise(bounded_share(sizes[0], limit // 2))
    chosen = known.filter(by_hash("doc_id", share)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic")       # at most `limit` ids, give or take

    def tokens(data: np.ndarray, offsets: np.ndarray) -> dict:
        numbers, firsts, language, parts = words(data, offsets)
        return {"words": [parts[numbers[a:b]].tobytes() for a, b in zip(firsts, firsts[1:])], "language": language.astype(np.int32)}

    table = score_texts(drawn, tokens, "words binary, language int", lower=True).toArrow()
    if table.num_rows == 0:
        return no_model()
    texts = [np.frombuffer(t, np.uint16).reshape(-1, 1 + len(STEMS)) for t in table["words"].to_pylist()]
    toxic, language = table["toxic"].to_numpy() == 1, table["language"].to_numpy()
    if toxic.all() or not toxic.any():
        return no_model()
    rng = np.random.default_rng(seed)
    part = rng.random(len(texts)) < 0.75
    if not (toxic[part].any() and toxic[~part].any() and (~toxic[part]).any() and (~toxic[~part]).any()):
        part[:] = True
    model = train([t for t, p in zip(texts, part) if p], toxic[part], rng)
    judged = ~part if not part.all() else part
    mine = [t for t, p in zip(texts, judged) if p]
    logit = np.concatenate([model.logits(*framed(np.arange(1, len(t) + 1), np.array([0, len(t)])), np.concatenate(
        [np.zeros((1, 1 + len(STEMS)), np.uint16), t])) for t in mine]).astype(np.float64)
    model.thresholds[:] = best_threshold(logit, toxic[judged])
    for number in range(len(LANGUAGES)):
        own = language[judged] == number
        if toxic[judged][own].sum() >= LEAST_OF_LANGUAGE and (~toxic[judged][own]).sum() >= LEAST_OF_LANGUAGE:
            model.thresholds[number] = best_threshold(logit[own], toxic[judged][own])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, score, predicted, language) of every whole text; language is the one
    whose threshold was used.

    Null and empty texts are scored as texts without a word. A model without both
    kinds of labels scores everything near 0. Repeated ids stay rows; other columns
    are not read.
    """
    scored = score_texts(pick(docs, id_col, text_col).toDF("id", "text"), model.score, "score double, language string", lower=True)
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "language")
