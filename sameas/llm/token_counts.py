"""Exact token counts at every prefix of a text, by dynamic programming.

For byte-pair merges the last token of every prefix is unique, and a row of tokens
is the encoding of its text when each two neighbours, encoded together, give
themselves again. So the count of a prefix is one more than the count before its
last token: the vocabulary's pieces are walked forward from every place, and of
those that end at a place the one that stands its neighbour is kept. Truncation and
budget questions are then look-ups, without encoding anything again.

The texts are cut where no piece can reach across (before a space mark, around a
line break); the pieces a worker has not seen are solved together as a matrix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from sameas.llm.merges import NO_MERGE, PAD, IntMap, PairTable, merge_one
from sameas.llm.packing import blocks, pack, pick

MODEL = "piece_bpe_32k.model"
MARK = "▁"          # stands for a space
LONG = 40                # code points of a chunk up to which it joins a matrix
BUCKETS = (4, 6, 8, 10, 12, 16, 24, LONG)
ROWS = 65_536
CACHED = 300_000         # chunks a worker remembers
JUDGED = 1 << 20         # slots for pairs of tokens already judged
OTHER = -2               # a sign without a piece: its bytes are its tokens


class PrefixCounter:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size())
                 if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = [model.id_to_piece(i) for i in sorted(plain, key=lambda i: (-model.get_score(i), i))]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("pieces that reach across a space or a line break are not supported")
        self.vocabulary = {p: i for i, p in enumerate(pieces)}
        self.pairs = PairTable(self.vocabulary)
        self.symbol = np.full(0x110000, OTHER, np.int32)
        for piece, number in self.vocabulary.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = number
        self.longest = max(map(len, pieces))
        self.lengths = np.array([len(p) for p in pieces])
        self.letters = np.full((len(pieces), self.longest), PAD, np.int32)
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4")
        self.letters[np.arange(self.longest)[None, :] < self.lengths[:, None]] = self.symbol[codes]
        # a piece that its own merges never build ends no prefix
        self.stands = np.zeros(len(pieces), bool)
        self.parts = np.full((len(pieces), 2), PAD, np.int32)      # what a piece's last merge joins
        for number, row in enumerate(self.letters):
            trace: list[tuple[int, int]] = []
            self.stands[number] = merge_one(row[row != PAD].tolist(), self.pairs, trace) == [number]
            if self.stands[number] and trace:
                self.parts[number] = trace[-1]
        compound = self.parts[:, 0] != PAD
        self.formed = np.where(compound, np.arange(len(pieces)), -1)       # single signs are there from the start
        if (self.formed[self.parts[compound]].max(axis=1) >= np.flatnonzero(compound)).any():
            raise ValueError("a piece ranks before its own parts")
        self._trie(pieces)
        self.judged_keys, self.judged = np.full(JUDGED, -1, np.int64), np.zeros(JUDGED, bool)
        self.judged_one: dict[tuple[int, int], bool] = {}
        self.known: dict[str, int] = {}
        # a text can also be cut after letters; signs that a piece goes on after don't count as letters
        inner, standing = "", [p for p in pieces if self.stands[self.vocabulary[p]]]
        while found := {m[0] for p in standing for m in re.findall(rf"[^\W\d_{inner}][\W\d_{inner}]", p)}:
            inner += "".join(map(re.escape, found))
        letter, other = rf"[^\W\d_{inner}]", rf"(?:[^\w{MARK}\n]|[\d_{inner}])"
        self.cut = re.compile(f"{MARK}*{letter}+|{MARK}*{other}+{letter}*|{MARK}+|\n").findall

    def _trie(self, pieces: list[str]) -> None:
        nodes, edges, ends = {"": 0}, {}, [PAD]
        for number, piece in enumerate(pieces):
            for i, sign in enumerate(piece):
                part = piece[:i + 1]
                if part not in nodes:
                    nodes[part] = len(ends)
                    ends.append(PAD)
                    if (code := int(self.symbol[ord(sign)])) >= 0:
                        edges[nodes[piece[:i]] << 32 | code] = nodes[part]
            if self.stands[number]:
                ends[nodes[piece]] = number
        self.steps, self.ends = IntMap(list(edges), list(edges.values()), PAD), np.array(ends, np.int32)

    def normal(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def neighbours(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the tokens left + right, encoded together, stay as they are."""
        out = np.ones(len(left), bool)
        asked = np.flatnonzero((left >= 0) & (right >= 0))
        key = (left[asked].astype(np.int64) << 32) | right[asked]
        slot = (key * 0x9E3779B1 >> 7) & (JUDGED - 1)
        hit = self.judged_keys[slot] == key
        out[asked[hit]] = self.judged[slot[hit]]
        if not hit.all():
            fresh, back = np.unique(key[~hit], return_inverse=True)
            answer = self._judge((fresh >> 32).astype(np.int32), (fresh & 0xFFFFFFFF).astype(np.int32))
            at = (fresh * 0x9E3779B1 >> 7) & (JUDGED - 1)
            self.judged_keys[at], self.judged[at] = fresh, answer
            clash = self.judged_keys[at] != fresh
            self.judged[at[~clash]] = answer[~clash]
            out[asked[~hit]] = answer[back]
        return out

    def _judge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Undoes the merges of both tokens, the latest first. At each moment two
        parts touch at the border; had they a merge that comes before the one just
        undone, the border would not have lasted. A merge of the left token stands
        further left, so it also goes first on a tie."""
        answer = self.pairs.lookup(left, right) == NO_MERGE
        rows = np.flatnonzero(answer)
        left, right = left[rows], right[rows]
        while len(rows):
            on_left = self.formed[left] > self.formed[right]
            formed = np.where(on_left, left, right + 1)
            left, right = np.where(on_left, self.parts[left, 1], left), np.where(on_left, right, self.parts[right, 0])
            more = (left != PAD) & (right != PAD)
            rows, left, right, formed = rows[more], left[more], right[more], formed[more]
            lost = self.pairs.lookup(left, right) < formed
            answer[rows[lost]] = False
            rows, left, right = rows[~lost], left[~lost], right[~lost]
        return answer

    def solve(self, chunks: list[str], width: int) -> np.ndarray:
        """counts[i, e] of the first e code points of chunk i, PAD beyond its end."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")
        inside = np.arange(width)[None, :] < lengths[:, None]
        signs = np.full((len(chunks), width), PAD, np.int32)
        signs[inside] = self.symbol[codes]
        weight = np.ones((len(chunks), width), np.int32)
        weight[inside] = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        row, start = np.nonzero(signs >= 0)
        node, steps = np.zeros(len(row), np.int32), []
        for size in range(1, self.longest + 1):
            node = self.steps.get((node.astype(np.int64) << 32) | signs[row, start + size - 1])
            on = node != PAD
            row, start, node = row[on], start[on], node[on]
            token = self.ends[node]
            good = token >= 0
            steps.append((start[good], row[good], start[good] + size, token[good]))
            on = start + size < width
            row, start, node = row[on], start[on], node[on]
            on = signs[row, start + size] >= 0
            row, start, node = row[on], start[on], node[on]
            if not len(row):
                break
        begin, row, end, token = (np.concatenate(x) for x in zip(*steps))
        order = np.argsort(begin, kind="stable")
        begin, row, end, token = begin[order], row[order], end[order], token[order]
        edges = np.searchsorted(begin, np.arange(width + 1))
        counts = np.full((len(chunks), width + 1), PAD, np.int32)
        last = np.full((len(chunks), width + 1), PAD, np.int32)
        counts[:, 0] = 0
        for place in range(width):
            other = np.flatnonzero(signs[:, place] == OTHER)
            counts[other, place + 1] = counts[other, place] + weight[other, place]
            last[other, place + 1] = OTHER
            part = slice(edges[place], edges[place + 1])
            rows, stop, kind = row[part], end[part], token[part]
            fits = self.neighbours(last[rows, place], kind)
            rows, stop, kind = rows[fits], stop[fits], kind[fits]
            counts[rows, stop] = counts[rows, place] + 1
            last[rows, stop] = kind
        return counts

    def solve_long(self, chunk: str) -> np.ndarray:
        """The same for one chunk of any length, linear in it."""
        n, get = len(chunk), self.vocabulary.get
        counts, last = np.zeros(n + 1, np.int64), [PAD] * (n + 1)
        for place in range(n):
            if get(chunk[place]) is None:
                counts[place + 1], last[place + 1] = counts[place] + len(chunk[place].encode()), OTHER
                continue
            for stop in range(place + 1, min(n, place + self.longest) + 1):
                token = get(chunk[place:stop])
                if token is not None and self.stands[token] and self._fits(last[place], token):
                    counts[stop], last[stop] = counts[place] + 1, token
        return counts

    def _fits(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        answer = self.judged_one.get((left, right))
        if answer is None:
            if len(self.judged_one) > CACHED:
                self.judged_one.clear()
            answer = self.judged_one[left, right] = bool(self._judge(np.array([left]), np.array([right]))[0])
        return answer

    def learn(self, chunks: list[str]) -> None:
        chunks = sorted(chunks, key=len)
        lengths, first = np.fromiter(map(len, chunks), np.int64, len(chunks)), 0
        for width in BUCKETS:
            last = int(np.searchsorted(lengths, width, side="right"))
            for start in range(first, last, ROWS):
                mine = chunks[start:min(start + ROWS, last)]
                counts = self.solve(mine, width)
                self.known.update(zip(mine, counts[np.arange(len(mine)), lengths[start:start + len(mine)]].tolist()))
            first = last
        for chunk in chunks[first:]:
            self.known[chunk] = int(self.solve_long(chunk)[-1])

    def chunk_counts(self, texts: list[str]) -> list[tuple[list[str], list[int]]]:
        cut = [self.cut(self.normal(text)) for text in texts]
        seen = set().union(*cut) if cut else set()
        if len(self.known) + len(seen) > CACHED:
            self.known = {c: self.known[c] for c in seen if c in self.known}
        new = [c for c in seen if c not in self.known]
        if new:
            self.learn(new)
        return [(chunks, list(map(self.known.__getitem__, chunks))) for chunks in cut]

    def prefixes(self, text: str) -> np.ndarray:
        """Token count of every prefix of the text, from the empty one on."""
        parts, total = [np.zeros(1, np.int64)], 0
        for chunk in self.cut(self.normal(text)):
            counts = self.solve_long(chunk)[1:] + total
            parts.append(counts)
            total = int(counts[-1])
        joined = np.concatenate(parts)
        return np.r_[joined[:1], joined[2:]] if text else joined      # the first mark belongs to no sign of the text

    def fitting(self, chunks: list[str], counts: list[int], limit: int) -> int:
        """Code points of the longest prefix of at most `limit` tokens."""
        sums = np.cumsum(counts)
        whole = int(np.searchsorted(sums, limit, side="right"))
        place = sum(map(len, chunks[:whole]))
        if whole < len(chunks):
            inner = self.solve_long(chunks[whole]) + (int(sums[whole - 1]) if whole else 0)
            place += int(np.flatnonzero(inner <= limit)[-1])
        return max(0, place - 1)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One per worker process."""
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, limit: int = 4096, path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, fit_chars[, prefix_tokens array<bigint>]).

    n_tokens is what the model's own library gives for the whole text; fit_chars
    the code points of the longest prefix of at most `limit` tokens; prefix_tokens
    the count of every prefix, the empty one first. A null text counts as empty.
    Repeated ids give repeated rows; other columns are not read.
    """
    path = path or public_tokenizers.path(MODEL)
    source = pick(docs, id_col, text_col)
    kind = source.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, fit_chars bigint" + ", prefix_tokens array<bigint>" * prefixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path)
        for batch in batches:
            data, offsets = pack(batch.column(1))
            for first, last in blocks(offsets):
                raw = data[offsets[first]:offsets[last]].tobytes()
                at = (offsets[first:last + 1] - offsets[first]).tolist()
                texts = [raw[a:b].decode() for a, b in zip(at, at[1:])]
                solved = tool.chunk_counts(texts)
                totals = [sum(counts) for _, counts in solved]
                fits = [len(text) if total <= limit else tool.fitting(*parts, limit)
                        for text, total, parts in zip(texts, totals, solved)]
                columns = [batch.column(0).slice(first, last - first), pa.array(np.diff(at), pa.int64()),
                           pa.array(totals, pa.int64()), pa.array(fits, pa.int64())]
                names = [id_col, "n_bytes", "n_tokens", "fit_chars"]
                if prefixes:
                    columns.append(pa.array([tool.prefixes(t) for t in texts], pa.list_(pa.int64())))
                    names.append("prefix_tokens")
                yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
