"""Byte-pair merges over padded matrices of symbol ids.

A vocabulary maps strings (bytes or str) to ids that count up with the rank. Two
neighbours may merge when their concatenation is in the vocabulary; the pair with
the lowest rank goes first, the leftmost on a tie.
"""

from __future__ import annotations

import heapq

import numpy as np

from sameas.llm.packing import mix

NO_MERGE = np.iinfo(np.int32).max
PAD = -1


class IntMap:
    """Open-addressing hash table from non-negative 64-bit keys to 32-bit values."""

    def __init__(self, keys, values, missing: int):
        key, value = np.asarray(keys, np.int64), np.asarray(values, np.int32)
        self.missing = missing
        size = 1 << max(4, int(len(key) * 2).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, missing, np.int32)
        place = self._place(key)
        while len(key):
            free = self.keys[place] == -1
            self.keys[place[free]] = key[free]          # one of those that want a slot gets it
            won = free & (self.keys[place] == key)
            self.values[place[won]] = value[won]
            key, value, place = key[~won], value[~won], (place[~won] + 1) & int(self.mask)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(np.uint64)) & self.mask).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        place = self._place(key)
        found = self.keys[place]
        out = np.where(found == key, self.values[place], self.missing)
        todo = np.flatnonzero((found != key) & (found != -1))
        place = place[todo]
        while len(todo):
            place = (place + 1) & int(self.mask)
            found = self.keys[place]
            hit = found == key[todo]
            out[todo[hit]] = self.values[place[hit]]
            on = ~hit & (found != -1)
            todo, place = todo[on], place[on]
        return out


class PairTable:
    """Hashed pairs (left id, right id) -> merged id, NO_MERGE where the pair does
    not merge. Ids count up in the order of the ranks."""

    def __init__(self, vocabulary: dict):
        self.merged = {}
        for text, number in vocabulary.items():
            for cut in range(1, len(text)):
                left, right = vocabulary.get(text[:cut]), vocabulary.get(text[cut:])
                if left is not None and right is not None:
                    self.merged[left << 32 | right] = number
        self.table = IntMap(list(self.merged), list(self.merged.values()), NO_MERGE)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = self.table.get((left.astype(np.int64) << 32) | right.astype(np.int64))
        out[(left < 0) | (right < 0)] = NO_MERGE
        return out


def merge_matrix(ids: np.ndarray, table: PairTable) -> np.ndarray:
    """Merges every row of a PAD-filled matrix to its end. Each round every open
    row merges its leftmost pair of lowest rank and closes the gap; rows without
    a pair leave, and so do columns that no open row reaches."""
    out = ids.astype(np.int32, copy=True)
    n, width = out.shape
    if n == 0 or width < 2:
        return out
    live, work = np.arange(n), out.copy()
    merged = table.lookup(work[:, :-1].ravel(), work[:, 1:].ravel()).reshape(n, width - 1)
    while True:
        best = merged.argmin(axis=1)
        rows = np.arange(len(live))
        lowest = merged[rows, best]
        going = lowest != NO_MERGE
        if not going.all():
            out[live[~going]] = PAD
            out[live[~going], :work.shape[1]] = work[~going]
            live, work, merged, best, lowest = live[going], work[going], merged[going], best[going], lowest[going]
            if not len(live):
                return out
            rows = np.arange(len(live))
        reach = int((work >= 0).any(axis=0).sum())
        work, merged = work[:, :reach], merged[:, :reach - 1]
        work[rows, best] = lowest
        later = np.arange(reach - 1)[None, :] > best[:, None]
        work[:, :-1] = np.where(later, work[:, 1:], work[:, :-1])
        work[:, -1] = PAD
        merged[:, :-1] = np.where(later[:, :-1], merged[:, 1:], merged[:, :-1])
        merged[:, -1] = NO_MERGE
        # the two pairs around the new symbol
        at = np.minimum(best, reach - 2)
        merged[rows, at] = table.lookup(work[rows, at], work[rows, at + 1])
        at = np.maximum(best - 1, 0)
        merged[rows, at] = table.lookup(work[rows, at], work[rows, at + 1])


def merge_one(ids: list[int], table: PairTable, trace: list | None = None) -> list[int]:
    """The same for one long row: the lowest pair comes from a heap, so a text
    without a break costs n log n and not n squared. `trace` gets (left, right) of
    every merge."""
    n = len(ids)
    ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            merged = table.merged.get(ids[i] << 32 | ids[j]) if ids[i] >= 0 <= ids[j] else None
            if merged is not None:
                heapq.heappush(heap, (merged, i, ids[i], ids[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        merged, i, left, right = heapq.heappop(heap)
        j = after[i] if i < n else n
        if ids[i] != left or j >= n or ids[j] != right:
            continue
        if trace is not None:
            trace.append((left, right))
        ids[i], ids[j] = merged, PAD - 1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out
