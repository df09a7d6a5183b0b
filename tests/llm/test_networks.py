"""The trained networks of op1 and op2 against plain versions of their risk, convolution and gradients."""

import numpy as np
import pytest

from sameas.llm import quality, toxicity
from sameas.llm.packing import pack


class Seen(Exception):
    pass


def first_gradients(monkeypatch, module, run):
    """What the module's training hands to its first update."""
    held = {}

    class Recorder:
        def __init__(self, arrays, rate):
            held["arrays"] = [a.astype(float) for a in arrays]

        def update(self, gradients):
            held["gradients"] = [np.asarray(g, float) for g in gradients]
            raise Seen

    monkeypatch.setattr(module, "Adam", Recorder)
    with pytest.raises(Seen):
        run()
    return held["arrays"], held["gradients"]


def check_slopes(loss, arrays, gradients, rng, tolerance=2e-3):
    """Gradients against differences of the loss at a few places of every array. They are taken
    downwards: a filter that only meets the border responds with its offset, 0, and counts as off."""
    for k, (array, gradient) in enumerate(zip(arrays, gradients)):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in array.shape)
            sides = []
            for step in (0.0, -1e-5):
                moved = [a.copy() for a in arrays]
                moved[k][at] += step
                sides.append(loss(moved))
            slope = (sides[0] - sides[1]) / 1e-5
            assert abs(slope - gradient[at]) <= tolerance * max(0.05, abs(slope)), (k, at, slope, gradient[at])


@pytest.mark.parametrize("prior,shift", [(None, 0.0), (0.4, 0.0), (0.9, 3.0)])
def test_quality_gradient_is_that_of_the_non_negative_risk(monkeypatch, prior, shift):
    rng = np.random.default_rng(1)
    positive, unlabelled = rng.normal(size=(40, 7)) + shift, rng.normal(size=(90, 7)) - shift
    network = quality.Network(np.random.default_rng(2), np.zeros(7), np.ones(7))
    if shift:
        network.v[:] = abs(network.v)
        network.w[:] = abs(network.w)       # positives score high, unlabelled low: the risk of bad text falls below 0
    arrays, gradients = first_gradients(monkeypatch, quality, lambda: network.train(positive, unlabelled, prior, np.random.default_rng(3), 1))
    drawn = np.random.default_rng(3)
    p = positive[drawn.integers(0, 40, min(quality.BATCH, 80))]
    u = unlabelled[drawn.integers(0, 90, min(2 * quality.BATCH, 180))]
    logistic = lambda z: 1 / (1 + np.exp(-z))
    w0 = arrays[0]
    branches = set()

    def loss(moved):
        w, b, v, c = moved
        score = lambda x: np.tanh(x @ w + b) @ v + c[0]
        decay = 0.5e-4 * (w * w).sum()
        if prior is None:
            return -np.log(logistic(score(p))).mean() - np.log(1 - logistic(score(u))).mean() + decay
        bad = logistic(score(u)).mean() - prior * logistic(score(p)).mean()
        branches.add(bad >= 0)
        return (prior * logistic(-score(p)).mean() + bad if bad >= 0 else -bad) + decay

    check_slopes(loss, arrays, gradients, rng)
    assert branches == ({shift == 0} if prior else set()) and w0.shape == (7, quality.HIDDEN)


def plain_peaks(vectors, filters, offsets):
    """Largest response of every filter over all windows of one text, borders of nothing around it."""
    border = np.zeros((max(toxicity.WIDTHS) - 1, toxicity.DEPTH))
    padded = np.concatenate([border, vectors, border, np.zeros((1, toxicity.DEPTH))])
    peaks = []
    for width, f, b in zip(toxicity.WIDTHS, filters, offsets):
        # no window reaches beyond the border behind the text
        places = range(len(border) + len(vectors) + max(toxicity.WIDTHS) - max(toxicity.WIDTHS) + 1)
        responses = [padded[i:i + width].ravel() @ f + b for i in places]
        peaks.append(np.maximum(np.max(responses, axis=0), 0))
    return np.concatenate(peaks)


def start_model(texts, toxic, seed):
    """The model training begins with, and the order of the first texts."""
    rng, model = np.random.default_rng(seed), toxicity.no_model()
    model.table[:] = rng.normal(size=model.table.shape) * 0.02
    model.table[:, 0] = toxicity._word_odds(texts, toxic) / 4
    model.table[0] = 0
    for width, f in zip(toxicity.WIDTHS, model.filters):
        f[:] = rng.normal(size=f.shape) * 0.1
        f[::toxicity.DEPTH] += 0.5 / width
    return model, rng.permutation(len(texts))


def coded(texts):
    import pyarrow as pa
    return pack(pa.array(texts))


TEXTS = ["awful vile words here", "a fine day", "", "vile", "one two three four five six seven", "fine awful", "nothing of note at all today"]


def test_convolution_and_pooling_equal_loops():
    rng = np.random.default_rng(4)
    model = toxicity.no_model()
    for array in (model.table, *model.filters, *model.offsets, model.out):
        array[:] = rng.normal(size=array.shape)
    model.table[0] = 0
    numbers, firsts, _, parts = toxicity.words(*coded(TEXTS))
    found = model.logits(*toxicity.framed(numbers, firsts), parts)
    vectors = model.table.astype(float)[parts].sum(axis=1)
    expected = [plain_peaks(vectors[numbers[a:b]], model.filters, model.offsets) @ model.out + model.bias[0] for a, b in zip(firsts, firsts[1:])]
    assert np.allclose(found, expected, atol=1e-3)


def test_a_score_does_not_depend_on_the_texts_beside_it():
    rng = np.random.default_rng(5)
    model = toxicity.no_model()
    for array in (model.table, *model.filters, *model.offsets, model.out):
        array[:] = rng.normal(size=array.shape)
    model.table[0] = 0
    together = model.score(*coded(TEXTS))["score"]
    alone = [model.score(*coded([text]))["score"][0] for text in TEXTS]
    assert np.allclose(together, alone, atol=1e-5)


def test_toxicity_gradient_is_that_of_the_log_loss(monkeypatch):
    texts = []
    for text in TEXTS * 3:
        numbers, _, _, parts = toxicity.words(*coded([text]))
        texts.append(parts[numbers])
    toxic = np.array(["vile" in t or "awful" in t for t in TEXTS * 3])
    arrays, gradients = first_gradients(monkeypatch, toxicity, lambda: toxicity.train(texts, toxic, np.random.default_rng(6)))
    model, order = start_model(texts, toxic, 6)
    rows = order[:toxicity.BATCH_TEXTS]
    table = model.table.astype(float)
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum()) * len(toxic)
    widths = len(toxicity.WIDTHS)

    def loss(moved):
        filters, offsets, out, bias = moved[:widths], moved[widths:2 * widths], moved[-2], moved[-1]
        total = 0.0
        for i in rows:
            logit = plain_peaks(table[texts[i]].sum(axis=1).reshape(-1, toxicity.DEPTH), filters, offsets) @ out + bias[0]
            total += weight[i] * np.log1p(np.exp(-logit if toxic[i] else logit)) / len(rows)
        return total + 0.5e-4 * (sum((f * f).sum() for f in filters) + (out * out).sum())

    check_slopes(loss, arrays, gradients, np.random.default_rng(7), 2e-2)
