"""Recompression of word sequences: a parse in rounds that looks alike wherever the same words stand.

Round 0 names words. Each later round joins runs of one symbol, gives every symbol a side by its name, joins a left symbol before a right
one, and has the new symbols named. Names are handed out for the whole corpus between rounds (``substring_dedup``): a symbol that stands
in one place only gets none.

With each symbol goes the span of words that its standing there depends on; inside equal windows of words the symbols whose spans lie in
the window are equal. So a window that holds the span of a symbol without a name stands nowhere else; such windows are closed, and
symbols that no open window holds need no name. What stays open after the last round shares all its symbols with other places.
"""

from __future__ import annotations

import numpy as np

from .common import BASE, mixed

#: Rounds after that of words. Spans grow with each; three still fit in windows of 20 words.
ROUNDS = 3


class Parse:
    """Symbols of a block of texts: name (0: none), and span [low, high) of words depended on.

    A span that reaches over its text's end goes one past it, so no window inside holds it.
    """

    def __init__(self, words: np.ndarray, place: np.ndarray, starts: np.ndarray, window: int):
        """``words`` are the sorted distinct ones, ``place`` tells for each place of the texts which of them stands there."""
        at, sizes = np.arange(len(place)), np.diff(starts)
        self.window, self.words, self.place = window, words, place
        self.name, self.low, self.high = words[place], at, at + 1
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.first, self.last = starts[:-1] - 1, starts[1:] + 1
        self.open = at + window <= np.repeat(starts[1:], sizes)
        #: Symbols of the last round, and those of them that ask for a name.
        self.made = np.ones(len(place), bool)
        self.fresh = self.made.copy()

    def asked(self, round_: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct codes that a round asks names for, and how often each stands here."""
        if not round_:
            return self.words, np.bincount(self.place, minlength=len(self.words))
        self._runs()
        self._pairs(round_)
        before = np.append(0, np.cumsum(self.open))
        a, b = np.clip(self.high - self.window, 0, len(self.open)), np.clip(self.low + 1, 0, len(self.open))
        self.fresh &= (self.high - self.low <= self.window) & (before[np.maximum(a, b)] > before[a])
        codes, self.place, counts = np.unique(self.name[self.fresh], return_inverse=True, return_counts=True)
        return codes, counts

    def named(self, names: np.ndarray) -> None:
        """Takes the names of the codes asked (0: stands nowhere else) and closes windows."""
        given = names[self.place]
        gone = np.flatnonzero(self.fresh)[given == 0]
        change = np.zeros(len(self.open) + 1, np.int64)
        np.add.at(change, np.maximum(self.high[gone] - self.window, 0), 1)
        np.add.at(change, self.low[gone] + 1, -1)
        self.open &= np.cumsum(change[:-1]) == 0
        # Symbols of this round that no open window holds have no name either; older ones keep theirs.
        self.name = np.where(self.made, np.uint64(0), self.name)
        self.name[self.fresh] = given

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Low of the symbol before and high of the one after; past the end where the text ends."""
        same = self.text[:-1] == self.text[1:]
        low, high = self.first[self.text], self.last[self.text]
        low[1:][same] = self.low[:-1][same]
        high[:-1][same] = self.high[1:][same]
        return low, high

    def _runs(self) -> None:
        """Each run of one symbol becomes a symbol. A symbol depends on those around it, which end its run."""
        head = np.ones(len(self.name), bool)
        head[1:] = (self.text[:-1] != self.text[1:]) | (self.name[:-1] != self.name[1:]) | (self.name[1:] == 0)
        a = np.flatnonzero(head)
        b = np.append(a[1:], len(head)) - 1
        low, high = self._neighbours()
        count = (b - a + 1).astype(np.uint64)
        self.made = count > 1
        self.name = np.where(self.made, mixed(self.name[a] + count * BASE), self.name[a])
        # Inside a run every symbol's neighbours are of the run, so its ends tell the span.
        self.low, self.high = (np.minimum(low[a], self.low[a]), np.maximum(high[b], self.high[b])) if len(a) else (self.low, self.high)
        self.text = self.text[a]

    def _pairs(self, round_: int) -> None:
        n = len(self.name)
        right = mixed(self.name + np.uint64(round_)) >> np.uint64(63) == 1
        merge = np.zeros(n, bool)
        merge[:-1] = ~right[:-1] & right[1:] & (self.text[:-1] == self.text[1:]) & (self.name[:-1] != 0) & (self.name[1:] != 0)
        low, high = self._neighbours()
        # A symbol that stays depends on the neighbour that it could have joined.
        new_low, new_high = np.where(right, np.minimum(self.low, low), self.low), np.where(right, self.high, np.maximum(self.high, high))
        a = np.flatnonzero(merge)
        name = self.name.copy()
        name[a] = mixed(mixed(self.name[a] + BASE) + self.name[a + 1])
        new_low[a], new_high[a] = np.minimum(self.low[a], self.low[a + 1]), np.maximum(self.high[a], self.high[a + 1])
        keep = np.ones(n, bool)
        keep[a + 1] = False
        self.made[a] = True
        self.name, self.low, self.high, self.text, self.made = name[keep], new_low[keep], new_high[keep], self.text[keep], self.made[keep]
        self.fresh = self.made.copy()
