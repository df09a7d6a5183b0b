"""Language of every word, and of a text, by a linear-chain conditional random field.

A word's score for each language sums learned weights of its hashed features: the
whole word (a learned lexicon), its beginnings and endings, and the n-grams of its
bytes. Learned transitions join neighbouring words, so that a word common to two
languages follows its surroundings and a switch inside a text costs something.
Forward-backward gives each word's language probabilities; a text's are their mean,
weighted by the words' lengths.

Training sequences are windows of words from documents of known language, two windows
to a sequence and often of different languages, which is what teaches the transitions.

Forward-backward runs over all texts of a block at once: texts are cut into strips of
STRIP words, the strips' transfer matrices are multiplied step by step side by side,
then carried along each text, and the strips are walked again from exact borders. Time
and memory are linear in the words of a text of any length.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import cache
from unicodedata import category

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sameas.llm.fitting import bounded_share, by_hash, score_texts
from sameas.llm.packing import SpanHash, fold_of, pick, row_of, spans

PER_LANGUAGE = 600        # documents of each language learned from, at most
WINDOWS = 6               # windows taken from a document, spread over its whole length
WINDOW = 24               # words of a window
BUCKETS = 1 << 16
PASSES = 4
BATCH = 64                # sequences
STRIP = 64
EDGES = (1, 2, 3, 4)      # bytes of beginnings and endings
GRAMS = (2, 3, 4)
LONGEST = 32              # bytes of a word at most; longer runs of letters are several words
UNKNOWN = "und"

_LETTER = np.zeros(128, bool)
_LETTER[97:123] = True


@cache
def _kinds() -> np.ndarray:
    """2 for every code point that is a letter, 1 for a mark, else 0."""
    return np.array([{"L": 2, "M": 1}.get(category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], np.uint8)


def letter_kinds(data: np.ndarray) -> np.ndarray:
    """The kind of its code point at every byte of lower-cased UTF-8."""
    out = np.zeros(len(data), np.uint8)
    plain = data < 128
    out[plain] = _LETTER[data[plain]] * np.uint8(2)
    lead = np.flatnonzero(data >= 0xC0)
    size = 2 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
    lead, size = lead[lead + size <= len(data)], size[lead + size <= len(data)]
    code = data[lead].astype(np.int64) & (0x7F >> size)
    for i in range(1, 4):
        on = size > i
        code[on] = code[on] << 6 | (data[lead[on] + i] & 0x3F)
    kind = _kinds()[np.minimum(code, sys.maxunicode)]
    for i in range(4):
        on = size > i
        out[lead[on] + i] = kind[on]
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters, with their marks, of lower-cased text; letters are the code
    points of Unicode category L. A run without a letter is no word."""
    kinds = letter_kinds(data)
    starts, ends = spans(kinds > 0, offsets)
    letters = np.r_[0, np.cumsum(kinds == 2)]
    kept = letters[ends] > letters[starts]
    return cut_runs(data, starts[kept], ends[kept])


def cut_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of over LONGEST bytes cut into like parts, each at the start of a code point."""
    parts = -(-(ends - starts) // (LONGEST - 3))        # moving a cut lengthens a part by up to 3 bytes
    parts[ends - starts <= LONGEST] = 1
    run = np.repeat(np.arange(len(starts)), parts)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = starts[run] + nth * (ends - starts)[run] // parts[run]
    for _ in range(3):
        begin -= (nth > 0) & (data[begin] & 0xC0 == 0x80)
    last = np.r_[run[1:] != run[:-1], True] if len(run) else np.zeros(0, bool)
    return begin, np.where(last, ends[run], np.r_[begin[1:], 0] if len(run) else begin)


def word_features(spell: SpanHash, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, word of each), ordered by word, over all bytes of every word."""
    size = ends - starts
    number = np.arange(len(starts))
    parts = [(number, spell(starts, ends), 0)]
    for n in EDGES:
        has = size > n
        parts.append((number[has], spell(starts[has], starts[has] + n), 10 + n))
        parts.append((number[has], spell(ends[has] - n, ends[has]), 20 + n))
    for n in GRAMS:
        count = np.maximum(size - n + 1, 0)
        word = np.repeat(number, count)
        inner = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        place = starts[word] + inner
        parts.append((word, spell(place, place + n), 30 + n))
    words = np.concatenate([p[0] for p in parts])
    with np.errstate(over="ignore"):
        hashes = np.concatenate([(h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15) for _, h, kind in parts])
    buckets = (hashes >> np.uint64(48)).astype(np.int64) % BUCKETS
    order = np.argsort(words, kind="stable")
    return buckets[order], words[order]


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray           # (BUCKETS, languages)
    transitions: np.ndarray       # log, from row to column
    start: np.ndarray

    def emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log score of every word for every language, distinct words once."""
        spell = SpanHash(data)
        _, at, number = np.unique(spell(starts, ends), return_index=True, return_inverse=True)
        buckets, words = word_features(spell, starts[at], ends[at])
        edges = np.searchsorted(words, np.arange(len(at)))
        return np.add.reduceat(self.weights[buckets], edges, axis=0)[number]

    def marginals(self, emissions: np.ndarray, row: np.ndarray, n: int, moves: np.ndarray | None = None) -> np.ndarray:
        """Probability of each language for each word; `row` is the ascending text
        number of each word. `moves` (languages, languages) gets the expected number of
        steps inside strips and across their borders added."""
        k = len(self.languages)
        lengths = np.bincount(row, minlength=n)
        firsts = np.cumsum(lengths) - lengths
        strips = -(-lengths // STRIP)                                  # per text
        text = np.repeat(np.arange(n), strips)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(strips) - strips, strips)
        begin = firsts[text] + nth * STRIP
        size = np.minimum(STRIP, firsts[text] + lengths[text] - begin)
        score = np.exp(np.clip(emissions - emissions.max(axis=1, keepdims=True), -50, 0))
        step, ident = np.exp(self.transitions), np.eye(k)
        grid = np.minimum(begin[:, None] + np.arange(STRIP), len(score) - 1)
        inside = np.arange(STRIP)[None, :] < size[:, None]
        # transfer matrix of a strip: product of step and word scores, the first word of a text without a step
        product = np.broadcast_to(ident, (len(text), k, k)).copy()
        for t in range(STRIP):
            on = np.flatnonzero(inside[:, t])
            if not len(on):
                break
            ahead = product[on]
            if t == 0:
                moved = np.where((nth[on] == 0)[:, None, None], ahead, ahead @ step)
            else:
                moved = (ahead.reshape(-1, k) @ step).reshape(-1, k, k)
            moved = moved * score[grid[on, t]][:, None, :]
            product[on] = moved / moved.max(axis=(1, 2), keepdims=True)
        # carry along the strips of each text, all texts side by side
        first_strip = np.cumsum(strips) - strips
        enter, leave = np.empty((len(text), k)), np.ones((len(text), k))
        vector, back = np.tile(np.exp(self.start), (n, 1)), np.ones((n, k))
        for s in range(int(strips.max(initial=0))):
            on = np.flatnonzero(strips > s)
            here = first_strip[on] + s
            enter[here] = vector[on]
            out = np.einsum("ij,ijk->ik", vector[on], product[here])
            vector[on] = out / out.max(axis=1, keepdims=True)
            there = first_strip[on] + strips[on] - 1 - s
            leave[there] = back[on]
            out = np.einsum("ijk,ik->ij", product[there], back[on])
            back[on] = out / out.max(axis=1, keepdims=True)
        # walk the strips from their exact borders
        forward, entered = np.empty((len(text), STRIP, k)), enter
        for t in range(STRIP):
            enter = (np.where((nth == 0)[:, None], enter, enter @ step) if t == 0 else enter @ step) * score[grid[:, t]]
            enter /= enter.max(axis=1, keepdims=True)
            forward[:, t] = enter
        out = np.empty_like(emissions)
        for t in reversed(range(STRIP)):
            on = inside[:, t]
            both = forward[on, t] * leave[on]
            out[grid[on, t]] = both / both.sum(axis=1, keepdims=True)
            after = leave[on] * score[grid[on, t]]
            if moves is not None:
                before = forward[on, t - 1] if t else entered[on]
                pair = before[:, :, None] * step * after[:, None, :]
                if t == 0:
                    pair[nth[on] == 0] = 0
                mass = pair.sum(axis=(1, 2), keepdims=True)
                moves += np.divide(pair, mass, out=np.zeros_like(pair), where=mass > 0).sum(axis=0)
            behind = after @ step.T
            leave[on] = behind / behind.max(axis=1, keepdims=True)
        return out

    def label(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, probabilities) of all words of a block."""
        starts, ends = word_spans(data, offsets)
        if not len(starts) or not self.languages:
            return starts[:0], ends[:0], np.zeros((0, max(1, len(self.languages))))
        return starts, ends, self.marginals(self.emissions(data, starts, ends), row_of(offsets, starts), len(offsets) - 1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        n = len(offsets) - 1
        starts, ends, chance = self.label(data, offsets)
        row, k = row_of(offsets, starts), chance.shape[1]
        long = (ends - starts).astype(np.float64)
        total = np.stack([np.bincount(row, chance[:, i] * long, minlength=n) for i in range(k)], axis=1)
        weight = total.sum(axis=1)
        best = total.argmax(axis=1)
        names = np.array([*self.languages, UNKNOWN], object)
        label = chance.argmax(axis=1)
        new = np.bincount(row[1:], (label[1:] != label[:-1]) & (row[1:] == row[:-1]), minlength=n) if len(row) else np.zeros(n)
        return {"lang_pred": names[np.where(weight > 0, best, len(self.languages))],
                "score": np.where(weight > 0, total[np.arange(n), best] / np.maximum(weight, 1e-300), 0.0),
                "n_switches": new.astype(np.int64)}

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """For each text its runs of words of one language as (first byte, end byte, language)."""
        n = len(offsets) - 1
        starts, ends, chance = self.label(data, offsets)
        row, label = row_of(offsets, starts), chance.argmax(axis=1)
        out = [[] for _ in range(n)]
        if len(row):
            new = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (row[1:] != row[:-1])])
            last = np.r_[new[1:], len(row)] - 1
            for a, b in zip(new.tolist(), last.tolist()):
                base = int(offsets[row[a]])
                out[row[a]].append({"first": int(starts[a]) - base, "end": int(ends[b]) - base, "lang": self.languages[label[a]]})
        return {"runs": out}


def _windows(data: np.ndarray, offsets: np.ndarray) -> dict:
    """Texts of up to WINDOWS stretches of WINDOW words, spread over each whole text."""
    starts, ends = word_spans(data, offsets)
    row = row_of(offsets, starts)
    n = len(offsets) - 1
    firsts = np.searchsorted(row, np.arange(n + 1))
    out = []
    for a, b in zip(firsts, firsts[1:]):
        count = int(min(WINDOWS, -(-(b - a) // WINDOW))) if b > a else 0
        parts = []
        for i in range(count):
            at = a + (b - a) * i // count
            stop = min(at + WINDOW, b)
            parts.append(" ".join(data[s:e].tobytes().decode(errors="ignore") for s, e in zip(starts[at:stop], ends[at:stop])))
        out.append("\n".join(parts))
    return {"windows": np.array(out, object)}


def train(windows: list[list[bytes]], label: np.ndarray, languages: list[str], rng: np.random.Generator) -> LanguageModel:
    """Conditional likelihood by AdaGrad. A window's words all carry its label."""
    k = len(languages)
    model = LanguageModel(languages, np.zeros((BUCKETS, k)), np.eye(k) * 2.0, np.zeros(k))
    sums = [np.full_like(a, 1e-2) for a in (model.weights, model.transitions)]
    for _ in range(PASSES):
        order = rng.permutation(len(windows))
        # a sequence is two windows: neighbours in a random order, mostly of different languages
        pairs = order[:len(order) // 2 * 2].reshape(-1, 2)
        if not len(pairs):
            pairs = np.stack([order, order], axis=1)
        for at in range(0, len(pairs), BATCH):
            batch = pairs[at:at + BATCH]
            tokens = [w for pair in batch for i in pair for w in windows[i]]
            truth = np.concatenate([np.full(len(windows[i]), label[i]) for pair in batch for i in pair])
            row = np.repeat(np.arange(len(batch)), [sum(len(windows[i]) for i in pair) for pair in batch])
            data = np.frombuffer(b"".join(tokens), np.uint8)
            ends = np.cumsum([len(t) for t in tokens])
            buckets, words = word_features(SpanHash(data), np.r_[0, ends[:-1]], ends)
            edges = np.searchsorted(words, np.arange(len(tokens)))
            emissions = np.add.reduceat(model.weights[buckets], edges, axis=0)
            moves = np.zeros((k, k))
            wrong = model.marginals(emissions, row, len(batch), moves)
            wrong[np.arange(len(truth)), truth] -= 1
            wrong /= len(batch)
            gradient = np.stack([np.bincount(buckets, wrong[words, i], minlength=BUCKETS) for i in range(k)], axis=1)
            same = row[1:] == row[:-1]
            np.subtract.at(moves, (truth[:-1][same], truth[1:][same]), 1.0)
            for array, total, g, rate in ((model.weights, sums[0], gradient, 0.3),
                                          (model.transitions, sums[1], moves / len(batch), 0.05)):
                total += g * g
                array -= rate * g / np.sqrt(total)
    return model


def fit_languages(docs: DataFrame, held_out: int = 2, folds: int = 4, per_language: int = PER_LANGUAGE,
                  seed: int = 42) -> LanguageModel:
    """Learns from windows of at most `per_language` documents of each language, chosen
    by hash; `docs` is (doc_id, text, lang). Fold `held_out` and null languages are left out."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of("doc_id", folds) != held_out))
    sizes = known.groupBy("lang").count().collect()            # a row per language
    if not sizes:
        return LanguageModel([], np.zeros((BUCKETS, 1)), np.zeros((1, 1)), np.zeros(1))
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(bounded_share(r["count"], per_language))) for r in sizes])
    drawn = score_texts(known.filter(by_hash("doc_id", share)).select("lang", "text"), _windows, "windows string", lower=True).toArrow()
    languages = sorted(r["lang"] for r in sizes)
    windows, label = [], []
    for lang, text in sorted(zip(drawn["lang"].to_pylist(), drawn["windows"].to_pylist())):
        for line in text.split("\n"):
            if line:
                windows.append([w.encode() for w in line.split(" ")])
                label.append(languages.index(lang))
    return train(windows, np.array(label, np.int64), languages, np.random.default_rng(seed))


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text",
                       runs: bool = False) -> DataFrame:
    """(id, lang_pred, score, n_switches[, runs]) of every whole text.

    lang_pred is the language with the largest share of the text, score that share,
    n_switches how often neighbouring words differ. `runs` adds the stretches of one
    language as array<struct<first, end, lang>> in bytes of the lower-cased text. Null,
    empty and letterless texts, and all texts under a model that has learned nothing,
    give 'und' with score 0. Repeated ids stay rows; other columns are not read.
    """
    source = pick(docs, id_col, text_col).toDF("id", "text")
    outputs = "lang_pred string, score double, n_switches bigint"
    if not runs:
        return score_texts(source, model.score, outputs, lower=True).withColumnRenamed("id", id_col)
    both = lambda data, offsets: {**model.score(data, offsets), **model.runs(data, offsets)}
    return score_texts(source, both, f"{outputs}, runs array<struct<first:bigint,end:bigint,lang:string>>", lower=True).withColumnRenamed("id", id_col)
