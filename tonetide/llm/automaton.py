"""Generalised suffix automaton over word sequences, with the windows of each sequence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np

#: Longer words are looked up by digest, so that one word cannot make the vocabulary large.
LONG = 64


def short_word(word: bytes) -> bytes:
    return word if len(word) <= LONG else b"\x00" + hashlib.sha256(word).digest()


class Automaton:
    """Accepts every run of words of the given sequences (``label``, words).

    A state stands for runs that end at the same places; ``size`` is its longest run and
    ``link`` leads to the longest suffix that ends elsewhere too. ``window`` consecutive words
    of a sequence are a window, a shorter sequence is one window as a whole.
    """

    def __init__(self, sequences: Sequence[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = []
        for label, words in sequences:
            codes = [self.words.setdefault(w, len(self.words)) for w in words]
            if codes:
                coded.append((label, codes))
                last = 0
                for code in codes:
                    last = self._extended(last, code)
        self.least = min([window, *(len(codes) for _, codes in coded)])
        self.long_words = any(w[:1] == b"\x00" for w in self.words)
        pairs = {a * len(self.words) + b for _, c in coded for a, b in zip(c, c[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self._mark(coded)

    def _extended(self, last: int, code: int) -> int:
        step, link, size = self.step, self.link, self.size
        known = step[last].get(code)
        if known is not None and size[known] == size[last] + 1:
            return known
        new = -1
        if known is None:
            new = len(step)
            step.append({})
            size.append(size[last] + 1)
            link.append(0)
        at = last
        while at >= 0 and code not in step[at]:
            step[at][code] = new
            at = link[at]
        if at < 0:
            return new
        target = step[at][code]
        if size[target] != size[at] + 1:
            copy = len(step)
            step.append(dict(step[target]))
            size.append(size[at] + 1)
            link.append(link[target])
            link[target] = copy
            while at >= 0 and step[at].get(code) == target:
                step[at][code] = copy
                at = link[at]
            target = copy
        if new < 0:
            return target
        link[new] = target
        return new

    def _mark(self, coded) -> None:
        """Labels of the windows: full ones by state, whole short sequences by state and length."""
        order = sorted(range(len(self.step)), key=self.size.__getitem__)
        self.full = [-1] * len(order)  # the state of a run's last ``window`` words
        for s in order:
            up = self.link[s]
            if self.size[s] >= self.window:
                self.full[s] = s if self.size[up] < self.window else self.full[up]
        self.labels: dict[tuple[int, int], set[int]] = {}
        shorts: dict[int, set[int]] = {}
        for label, codes in coded:
            s = 0
            for n, code in enumerate(codes, 1):
                s = self.step[s][code]
                if n >= self.window:
                    self.labels.setdefault((self.full[s], self.window), set()).add(label)
            if len(codes) < self.window:
                # the whole sequence: the state on the link chain that holds its length
                while self.size[self.link[s]] >= len(codes):
                    s = self.link[s]
                self.labels.setdefault((s, len(codes)), set()).add(label)
                shorts.setdefault(s, set()).add(len(codes))
        self.shorts = {s: sorted(sizes) for s, sizes in shorts.items()}
        self.next_short = [-1] * len(order)  # nearest state above with a short sequence
        for s in order[1:]:
            up = self.link[s]
            self.next_short[s] = up if up in self.shorts else self.next_short[up]

    def runs(self, words: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """Runs of the text whose words and pairs all occur in sequences: no window is elsewhere.

        Gives start and word codes of each run that is long enough for a window.
        """
        if not self.words or len(words) < self.least:
            return
        if self.long_words:
            words = [short_word(w) for w in words]
        get = self.words.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = codes >= 0
        joined = codes[:-1] * len(self.words) + codes[1:]
        place = np.searchsorted(self.pairs, joined)
        fits = np.zeros(len(joined), bool)
        inside = place < len(self.pairs)
        fits[inside] = self.pairs[place[inside]] == joined[inside]
        fits &= known[:-1] & known[1:]
        start = np.flatnonzero(known & ~np.append(False, fits))
        end = np.flatnonzero(known & ~np.append(fits, False)) + 1
        for a, b in zip(start, end):
            if b - a >= self.least:
                yield int(a), codes[a:b]

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word ranges covered by windows (disjoint, ascending) and labels of these windows."""
        step, link, size, window = self.step, self.link, self.size, self.window
        spans: list[tuple[int, int]] = []
        met: set[tuple[int, int]] = set()
        for start, codes in self.runs(words):
            s = length = 0  # longest match that ends here: state and number of words
            for at, code in enumerate(codes.tolist(), start + 1):
                while s and code not in step[s]:
                    s = link[s]
                    length = size[s]
                s = step[s].get(code, 0)
                length = length + 1 if s else 0
                covered = 0
                if length >= window:
                    covered = window
                    met.add((self.full[s], window))
                short = s if s in self.shorts else self.next_short[s]
                while short >= 0:
                    for n in self.shorts[short]:
                        if n <= length:
                            covered = max(covered, n)
                            met.add((short, n))
                    short = self.next_short[short]
                if covered:
                    _cover(spans, at - covered, at)
        labels: set[int] = set()
        return spans, labels.union(*(self.labels[m] for m in met))


def _cover(spans: list[tuple[int, int]], lo: int, hi: int) -> None:
    """Add a range that ends at or after all earlier ones."""
    while spans and spans[-1][1] >= lo:
        lo = min(lo, spans.pop()[0])
    spans.append((lo, hi))
