"""An FM-index over a sequence of integer symbols: wavelet-tree ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; text ends with a symbol that occurs only there and is the smallest."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], (text[order][1:] != text[order][:-1]).astype(np.int64))))
    step = 1
    while n and rank[order[-1]] < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.cumsum(np.concatenate(([0], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64))))
        step *= 2
    return order


class WaveletTree:
    """Ranks of symbols in a sequence: one bit plane for each bit of the symbols, high bit first.

    On each level the zeros of the level above come before its ones, in order, so a node is a range.
    """

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros, self.planes = bits, [], [], []
        for bit in range(bits - 1, -1, -1):
            plane = ((sequence >> bit) & 1).astype(np.int32)
            self.planes.append(plane)
            self.ones.append(np.concatenate((np.zeros(1, np.int32), np.cumsum(plane, dtype=np.int32))))
            self.zeros.append(len(plane) - int(self.ones[-1][-1]))
            sequence = np.concatenate((sequence[plane == 0], sequence[plane == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        begin = np.zeros_like(end)
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            r, z = self.ones[level], self.zeros[level]
            begin = np.where(one, z + r[begin], begin - r[begin])
            end = np.where(one, z + r[end], end - r[end])
        return end - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at these places."""
        symbol = np.zeros_like(at)
        for level in range(self.bits):
            one = self.planes[level][at].astype(bool)
            r, z = self.ones[level], self.zeros[level]
            symbol = (symbol << 1) | one
            at = np.where(one, z + r[at], at - r[at])
        return symbol


class FMIndex:
    """text: symbols of 1 and more; the end symbol 0 is added here. Every SAMPLE-th text position is kept."""

    SAMPLE = 8

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.concatenate((text.astype(np.int64), [0]))
        order = suffix_array(text)
        self.n = len(text)
        self.tree = WaveletTree(text[order - 1], max(1, int(symbols).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols + 1))))
        kept = order % self.SAMPLE == 0
        self.sampled = np.concatenate(([0], np.cumsum(kept)))
        self.kept, self.positions = kept, order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases of one length (rows of symbols), by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k].astype(np.int64)
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
            live = live[high[live] > low[live]]
        dead = np.ones(len(phrases), bool)
        dead[live] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back in the text until a sampled row."""
        out, steps, todo, row = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.astype(np.int64)
        while len(todo):
            hit = self.kept[row]
            out[todo[hit]] = self.positions[self.sampled[row[hit]]] + steps
            todo, row = todo[~hit], row[~hit]
            c = self.tree.access(row)
            row = self.before[c] + self.tree.rank(c, row)
            steps += 1
        return out
