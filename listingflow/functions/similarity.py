"""Title similarity on a 0..100 scale.

``ratio`` is 200 * LCS / (len a + len b).  ``token_set_ratio`` compares the sets
of white-space tokens: 100 when one set contains the other, else the best ratio
among "common" and "common + rest" of both sides.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# The kernel travels with the UDF, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = 64  # bits of one machine word in the vectorised LCS


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = state = (1 << len(a)) - 1
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    size = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / size if size else 100.0


def token_set_ratio(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    common = left & right
    if common and (left <= right or right <= left):
        return 100.0
    only_left, only_right = " ".join(sorted(left - common)), " ".join(sorted(right - common))
    shared = len(" ".join(common)) if common else 0
    lead = shared + 1 if common else 0
    size_left, size_right = lead + len(only_left), lead + len(only_right)
    best = 200.0 * (lead + lcs_length(only_left, only_right)) / (size_left + size_right)
    if common:
        best = max(best, 200.0 * shared / (shared + min(size_left, size_right)))
    return best


def title_score(a: str, b: str, use_ratio: bool = True) -> float:
    """max(ratio, token_set_ratio), or the latter alone."""
    score = token_set_ratio(a, b)
    return max(score, ratio(a, b)) if use_ratio and score < 100.0 else score


def title_similarity(a: Column, b: Column, use_ratio: bool = True) -> Column:
    """Similarity of two title columns, in Arrow batches; null when either is null."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cached = cached_score(use_ratio)
        for left, right in batches:
            yield pd.Series([
                None if x is None or y is None else cached(x, y) for x, y in zip(left, right)
            ], dtype="float64")

    return score(a, b)


def cached_score(use_ratio: bool, size: int = 1 << 17):
    """``title_score`` with a bounded cache, made once per task: titles recur across blocks."""
    return lru_cache(maxsize=size)(lambda a, b: title_score(a, b, use_ratio))


class Leaders:
    """Ordered cluster leaders; ``first`` finds the earliest one similar to a title.

    Leaders that share a token are found through a token index and decided by their
    token-set score; all others by the ratio of the sorted tokens, which is that score
    where no token is common.  Lengths and LCS are evaluated as numpy vectors.
    """

    def __init__(self, threshold: float, use_ratio: bool):
        self.threshold, self.use_ratio = threshold, use_ratio
        self.names: list[str] = []
        self.by_token: dict[str, list[int]] = {}
        self.letters: dict[str, int] = {}
        self.forms = [_Forms(self.letters)]  # sorted unique tokens
        if use_ratio:
            self.forms.append(_Forms(self.letters))  # the title itself

    def add(self, name: str) -> None:
        tokens = sorted(set(name.split()))
        for token in tokens:
            self.by_token.setdefault(token, []).append(len(self.names))
        self.names.append(name)
        for form, text in zip(self.forms, (" ".join(tokens), name)):
            form.add(text)

    def first(self, name: str) -> int:
        """Position of the first leader with a score at the threshold, else -1."""
        tokens = set(name.split())
        best, sharing = self._first_sharing(name, tokens)
        best = self.forms[0].first(" ".join(sorted(tokens)), self.threshold, best, sharing)
        if self.use_ratio:
            best = self.forms[1].first(name, self.threshold, best)
        return best if best < len(self.names) else -1

    def _first_sharing(self, name: str, tokens: set[str]) -> tuple[int, list[int]]:
        """Earliest leader that shares a token and has a token-set score at the threshold;
        all leaders that share one."""
        shared: dict[int, int] = {}
        for token in tokens:
            for i in self.by_token.get(token, ()):
                shared[i] = shared.get(i, -1) + len(token) + 1
        own = len(" ".join(tokens))
        sizes = self.forms[0].sizes
        for i in sorted(shared):
            common, other = shared[i], sizes[i]
            if 200.0 * common >= self.threshold * (common + min(own, other)):
                return i, list(shared)
            if (200.0 * min(own, other) >= self.threshold * (own + other)
                    and token_set_ratio(name, self.names[i]) >= self.threshold):
                return i, list(shared)
        return len(self.names), list(shared)


class _Forms:
    """Character codes of the leaders as one padded matrix."""

    def __init__(self, letters: dict[str, int]):
        self.letters = letters
        self.sizes: list[int] = []
        self.texts: list[str] = []
        self.codes = np.zeros((64, WORD), dtype=np.uint16)

    def add(self, text: str) -> None:
        if len(self.sizes) == len(self.codes):
            self.codes = np.vstack([self.codes, np.zeros_like(self.codes)])
        if len(text) <= WORD:
            codes = [self.letters.setdefault(ch, len(self.letters) + 1) for ch in text]
            self.codes[len(self.sizes), : len(codes)] = codes
        self.sizes.append(len(text))
        self.texts.append(text)

    def first(self, text: str, threshold: float, before: int, skip: list[int] = ()) -> int:
        """Earliest row under ``before``, not in ``skip``, whose ratio reaches the threshold, else ``before``."""
        sizes = np.asarray(self.sizes[:before], dtype=np.int64)
        shorter, total = np.minimum(sizes, len(text)), sizes + len(text)
        fits = (200.0 * shorter >= threshold * total) & (total > 0)
        fits[[i for i in skip if i < before]] = False
        near = np.flatnonzero(fits)
        if len(text) > WORD:
            fast, slow = near[:0], near
        else:
            fast, slow = near[sizes[near] <= WORD], near[sizes[near] > WORD]
        if fast.size:
            hits = fast[200.0 * self._lcs(text, fast) >= threshold * total[fast]]
            if hits.size:
                before = int(hits[0])
        for i in slow:
            if i >= before:
                break
            if ratio(text, self.texts[i]) >= threshold:
                before = int(i)
        return before

    def _lcs(self, text: str, rows: np.ndarray) -> np.ndarray:
        masks = np.zeros(len(self.letters) + 1, dtype=np.uint64)
        for i, ch in enumerate(text):
            if ch in self.letters:
                masks[self.letters[ch]] |= np.uint64(1 << i)
        full = np.uint64((1 << len(text)) - 1)
        codes = self.codes[rows]
        width = int(np.count_nonzero(codes, axis=1).max())
        state = np.full(len(rows), full)
        for j in range(width):
            hit = state & masks[codes[:, j]]
            state = (state + hit) | (state - hit)
        return len(text) - np.bitwise_count(state & full).astype(np.int64)


def follow_leaders(titles, leaders: Leaders) -> list[str]:
    """Greedy pass: each title joins its first similar leader or becomes one."""
    out = []
    for name in titles:
        i = leaders.first(name)
        if i < 0:
            leaders.add(name)
            out.append(name)
        else:
            out.append(leaders.names[i])
    return out


def follow_few(titles, score, threshold: float) -> list[str]:
    """The same pass for a handful of titles: ``score`` of each pair, without an index over the leaders."""
    leaders, out = [], []
    for name in titles:
        found = next((x for x in leaders if score(x, name) >= threshold), None)
        if found is None:
            leaders.append(name)
        out.append(name if found is None else found)
    return out
