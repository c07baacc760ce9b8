"""Suffix arrays by induced sorting, with whole buckets as array operations, and permuted common prefixes."""

from __future__ import annotations

from array import array

import numpy as np


def types_of(text: np.ndarray) -> np.ndarray:
    """True for S: the suffix is less than the one that starts a place later. The last suffix is S."""
    n = len(text)
    rises = np.zeros(n, np.int8)
    rises[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    rises[-1] = 1
    # Equal neighbours have the type of the next place at which the text rises or falls.
    at = np.where(rises != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return rises[at] > 0


class Buckets:
    """The suffix array being filled: a bucket for each symbol, L suffixes from its head, S suffixes from its end."""

    def __init__(self, text: np.ndarray, is_s: np.ndarray, sigma: int):
        self.text, self.is_s, self.sigma = text, is_s, sigma
        size = np.bincount(text, minlength=sigma)
        self.ends = np.cumsum(size)
        self.heads = self.ends - size

    def put(self, sa: np.ndarray, suffixes: np.ndarray, at: np.ndarray, step: int) -> None:
        """Appends suffixes, in the given order, each to its bucket: at heads going up or at ends going down."""
        symbols = self.text[suffixes]
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order]
        new = np.flatnonzero(np.diff(symbols, prepend=-1) != 0)
        counts = np.diff(new, append=len(symbols))
        rank = np.arange(len(symbols)) - np.repeat(new, counts)
        if step > 0:
            sa[at[symbols] + rank] = suffixes[order]
        else:
            sa[at[symbols] - 1 - rank] = suffixes[order]
        at[symbols[new]] += step * counts

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes in order, given the leftmost S suffixes in order."""
        text, is_s, n = self.text, self.is_s, len(self.text)
        sa = np.full(n, -1, np.int64)
        lms_symbols = text[lms]
        bounds = np.searchsorted(lms_symbols, np.arange(self.sigma + 1))
        heads = self.heads.copy()
        for c in range(self.sigma):
            lo = self.heads[c]
            while lo < heads[c]:  # L suffixes of this bucket, also those that it induces itself
                hi = heads[c]
                self.left(sa, sa[lo:hi], heads, False)
                lo = hi
            self.left(sa, lms[bounds[c] : bounds[c + 1]], heads, False)
        ends = self.ends.copy()
        sa_s = sa  # S suffixes go behind the L suffixes of their buckets
        for c in range(self.sigma - 1, -1, -1):
            hi = self.ends[c]
            if c == text[n - 1] and is_s[n - 1] and hi == ends[c]:
                sa_s[hi - 1] = n - 1  # the last suffix, which nothing induces
                ends[c] -= 1
            while hi > ends[c]:
                lo = ends[c]
                self.left(sa_s, sa_s[lo:hi][::-1], ends, True)
                hi = lo
            self.left(sa_s, sa_s[self.heads[c] : heads[c]][::-1], ends, True)
        return sa_s

    def left(self, sa: np.ndarray, suffixes: np.ndarray, at: np.ndarray, s_type: bool) -> None:
        before = suffixes - 1
        before = before[before >= 0]
        before = before[self.is_s[before] == s_type]
        if len(before):
            self.put(sa, before, at, -1 if s_type else 1)


def ints(values: np.ndarray) -> array:
    return array("i", values.astype(np.int32).tobytes())


class Singly:
    """The same over a large alphabet, suffix by suffix: a step for each bucket would cost more than one for each place."""

    def __init__(self, text: np.ndarray, is_s: np.ndarray, sigma: int):
        self.text = text
        # By place: the symbol in front of it, if that suffix is L (or S), else -1; -1 for no place, too.
        before = np.concatenate([[-1], text[:-1], [-1]])
        s_before = np.concatenate([[False], is_s[:-1], [False]])
        self.left = ints(np.where(s_before, -1, before))
        self.right = ints(np.where(s_before, before, -1))
        size = np.bincount(text, minlength=sigma)
        self.ends = np.cumsum(size)
        self.heads = self.ends - size

    def induce(self, lms: np.ndarray) -> np.ndarray:
        n, found = len(self.text), np.full(len(self.text), -1, np.int64)
        symbols = self.text[lms]
        found[self.ends[symbols] - (np.searchsorted(symbols, symbols, "right") - np.arange(len(lms)))] = lms
        sa, left, heads = ints(found), self.left, ints(self.heads)
        for i in sa:  # what is put in stands further on, and is read when its turn comes
            c = left[i]
            if c >= 0:
                at = heads[c]
                sa[at] = i - 1
                heads[c] = at + 1
        right, ends = self.right, ints(self.ends)
        last = int(self.text[n - 1])  # nothing induces the last suffix
        ends[last] -= 1
        sa[ends[last]] = n - 1
        for at in range(n - 1, -1, -1):
            i = sa[at]
            c = right[i]
            if c >= 0:
                ends[c] = to = ends[c] - 1
                sa[to] = i - 1
        return np.frombuffer(sa, np.int32).astype(np.int64)


#: Symbols up to which a bucket is worth a few array operations.
FEW_SYMBOLS = 1 << 10


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of a sequence of symbols below sigma, whose last symbol, the least, occurs once.

    Suffixes are classified, the substrings between leftmost S places sorted by inducing and named, the sequence of
    their names sorted by the same function in turn, unless all names differ, and all suffixes induced from it, in
    linear time. A sequence of names is at most half as long and ends in its least name, which occurs once.
    """
    text = np.asarray(text, np.int64)
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    is_s = types_of(text)
    is_lms = is_s.copy()
    is_lms[0] = False
    is_lms[1:] &= ~is_s[:-1]
    lms = np.flatnonzero(is_lms)
    buckets = (Buckets if sigma <= FEW_SYMBOLS else Singly)(text, is_s, sigma)
    if len(lms) <= 1:
        return buckets.induce(lms)
    by_symbol = lms[np.argsort(text[lms], kind="stable")]
    sorted_once = buckets.induce(by_symbol)
    sorted_lms = sorted_once[is_lms[sorted_once]]
    # Names of the substrings: equal neighbours get one name.
    length = np.diff(lms, append=n - 1) + 1
    length_of = np.zeros(n, np.int64)
    length_of[lms] = length
    a, b = sorted_lms[:-1], sorted_lms[1:]
    same = length_of[a] == length_of[b]
    live, depth = np.flatnonzero(same), 0
    while len(live):
        live = live[depth < length_of[a[live]]]
        equal = text[a[live] + depth] == text[b[live] + depth]
        same[live[~equal]] = False
        live = live[equal]
        depth += 1
    name_of = np.zeros(n, np.int64)
    name_of[sorted_lms] = np.concatenate([[0], np.cumsum(~same)])
    names = name_of[lms]
    n_names = int(names.max()) + 1
    order = np.argsort(names) if n_names == len(names) else suffix_array(names, n_names)
    return buckets.induce(lms[order])


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the common prefix of its suffix with the one before it in the order, and
    that suffix (-1 for the first). Only irreducible places are compared; at others, where the symbols before are
    equal, it is one less than at the place before."""
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    irreducible = np.ones(n, bool)
    i = np.arange(1, n)
    inner = (phi[i] > 0) & (phi[i - 1] >= 0)
    i = i[inner]
    irreducible[i] = (text[i - 1] != text[phi[i] - 1]) | (phi[i - 1] != phi[i] - 1)
    places = np.flatnonzero(irreducible & (phi >= 0))
    lcp = np.zeros(n, np.int64)
    words, live, depth = sevens(text), np.flatnonzero(irreducible & (phi >= 0)), 0
    while len(live):
        a, b = live + depth, phi[live] + depth
        inside = (a < n) & (b < n)
        a, b, live = a[inside], b[inside], live[inside]
        equal = words[a] == words[b]
        lcp[live[equal]] += 7
        x, y, ends = a[~equal], b[~equal], live[~equal]
        for _ in range(6):
            on = (x < n) & (y < n)
            x, y, ends = x[on], y[on], ends[on]
            on = text[x] == text[y]
            x, y, ends = x[on] + 1, y[on] + 1, ends[on]
            lcp[ends] += 1
        live = live[equal]
        depth += 7
    last = np.maximum.accumulate(np.where(irreducible, np.arange(n), -1))
    out = np.maximum(lcp[last] - (np.arange(n) - last), 0)
    out[phi < 0] = 0
    return out, phi


def sevens(text: np.ndarray) -> np.ndarray:
    """For each place the seven symbols from it (below 2**9, 0 past the end) as one number."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(7, np.uint64)])
    out = np.zeros(n, np.uint64)
    for d in range(7):
        out |= padded[d : d + n] << np.uint64(9 * d)
    return out
