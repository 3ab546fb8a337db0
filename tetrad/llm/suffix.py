"""Suffix arrays by induced sorting, in whole-array steps.

Suffixes are classified as smaller (S) or larger (L) than the next; the leftmost S suffixes of each run (LMS) are sorted
first, and from their order all others are induced in one ascending and one descending pass over the buckets of first
characters. LMS substrings themselves are sorted by the same induction and named; unless all names differ, the string of
names is sorted by recursion. Its alphabet would be nearly as large as itself, and passes over its buckets would be loops
over single entries, so a name is written with two digits or three: the order of the suffixes at first digits is that of
the names.
"""

from __future__ import annotations

import numpy as np

#: Base of the digits of names.
BASE = 1024


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S. The last character is the sole least one, a sentinel."""
    if len(t) == 1:
        return np.ones(1, bool)
    differs = np.flatnonzero(t[:-1] != t[1:])  # the last is before the sentinel
    rises = t[differs] < t[differs + 1]
    return np.append(np.repeat(rises, np.diff(differs, prepend=-1)), True)


class _Buckets:
    """Entries of each first character in the order in which a pass appends them."""

    def __init__(self, sizes: np.ndarray, from_end: bool):
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.array = np.empty(self.first[-1], np.int32)
        self.fill = (self.first[1:] if from_end else self.first[:-1]).copy()
        self.from_end = from_end

    def append(self, chars: np.ndarray, entries: np.ndarray) -> None:
        order = chars.argsort(kind="stable")
        chars = chars[order]
        new = np.empty(len(chars), bool)
        new[0] = True
        np.not_equal(chars[1:], chars[:-1], out=new[1:])
        start = new.nonzero()[0]
        chars, size = chars[start], np.empty(len(start), np.int64)
        size[-1] = len(order) - start[-1]
        np.subtract(start[1:], start[:-1], out=size[:-1])
        place = np.arange(len(order))
        if self.from_end:
            place = (self.fill[chars] - 1 + start).repeat(size) - place
            self.fill[chars] -= size
        else:
            place += (self.fill[chars] - start).repeat(size)
            self.fill[chars] += size
        self.array[place] = entries[order]


def _before(t: np.ndarray, small: np.ndarray, of: bool) -> np.ndarray:
    """For each suffix the first character of the one that begins before it, 0 unless that is of the type (only the sentinel's
    character is 0, which no suffix follows)."""
    out = np.zeros_like(t)
    np.multiply(t[:-1], small[:-1] == of, out=out[1:])
    return out


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The order of all suffixes, from LMS suffixes in an order that is right within each bucket."""
    large = _Buckets(np.bincount(t[~small], minlength=sigma), False)
    by_char = lms[np.argsort(t[lms], kind="stable")]
    cut = np.searchsorted(t[by_char], np.arange(sigma + 1)).tolist()
    chars = np.flatnonzero(np.bincount(t, minlength=sigma)).tolist()
    first, before = large.first.tolist(), _before(t, small, False)

    def induced(into: _Buckets, batch: np.ndarray) -> None:
        char = before[batch]
        some = char.nonzero()[0]
        if len(some):
            into.append(char[some], batch[some] - 1)

    for c in chars:
        done = first[c]
        while done < (fill := int(large.fill[c])):  # entries that the bucket gets from itself come next in it
            batch, done = large.array[done:fill], fill
            induced(large, batch)
        if cut[c] < cut[c + 1]:
            induced(large, by_char[cut[c] : cut[c + 1]])
    tiny = _Buckets(np.bincount(t[small], minlength=sigma), True)
    last = len(t) - 1
    tiny.append(t[[last]], np.array([last]))
    end, before = tiny.first.tolist(), _before(t, small, True)
    for c in reversed(chars):
        done = end[c + 1]
        while done > (fill := int(tiny.fill[c])):
            batch, done = tiny.array[fill:done][::-1], fill
            induced(tiny, batch)
        if first[c] < first[c + 1]:
            induced(tiny, large.array[first[c] : first[c + 1]][::-1])
    out = np.empty(len(t), np.int32)
    sizes = np.diff(large.first) + np.diff(tiny.first)
    start = np.cumsum(sizes) - sizes
    out[np.arange(len(large.array)) + np.repeat(start - large.first[:-1], np.diff(large.first))] = large.array
    out[np.arange(len(tiny.array)) + np.repeat(start + np.diff(large.first) - tiny.first[:-1], np.diff(tiny.first))] = tiny.array
    return out


def _names(t: np.ndarray, small: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings, in text order. order: LMS positions as the first induction leaves them."""
    n = len(t)
    length = np.diff(np.append(lms, n - 1)) + 1  # to the next LMS position, which is included
    place = np.searchsorted(lms, order)
    a, b = order[:-1], order[1:]
    la, lb = length[place[:-1]], length[place[1:]]
    same = la == lb
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        live = live[k < la[live]]
        apart = (t[a[live] + k] != t[b[live] + k]) | (small[a[live] + k] != small[b[live] + k])
        same[live[apart]] = False
        live = live[~apart]
        k += 1
    rank = np.empty(len(lms), np.int64)
    rank[place] = np.concatenate([[0], np.cumsum(~same)])
    return rank


def _doubled(rank: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names by rank doubling."""
    n, step = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while rank.max() < n - 1:
        after = np.full(n, -1, np.int64)
        after[: max(0, n - step)] = rank[step:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        step *= 2
    return order


def _reduced(rank: np.ndarray, above: int) -> np.ndarray:
    """Order of the suffixes of a string of names, by recursion. above: length of the string it was reduced from.

    With digits the string may fail to be shorter than ``above`` (LMS positions at every second place throughout); then, and
    where names are so few that passes over the buckets would cost more, ranks are doubled.
    """
    if len(rank) < BASE * BASE >> 4:
        return _doubled(rank)
    digits, most = 1, int(rank.max())
    while most >= BASE**digits:
        digits += 1
    if digits * len(rank) > 0.9 * above:
        return _doubled(rank)
    base = round(most ** (1 / digits)) + 1  # as few buckets as these digits need
    string = rank[:, None] // base ** np.arange(digits - 1, -1, -1) % base
    order = suffix_array(string.ravel())
    return order[order % digits == 0] // digits


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of an array of small integers."""
    n = len(text)
    sigma = int(text.max()) + 2 if n else 1
    t = np.zeros(n + 1, np.uint16 if sigma < 1 << 16 else np.int32)  # short integers are sorted by their digits
    t[:-1] = text
    t[:-1] += 1
    small = classify(t)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        first = induce(t, small, lms, sigma)
        is_lms = np.zeros(n + 1, bool)
        is_lms[lms] = True
        sorted_lms = first[is_lms[first]]
        rank = _names(t, small, lms, sorted_lms)
        lms = sorted_lms if rank.max() == len(lms) - 1 else lms[_reduced(rank, n)]
    return induce(t, small, lms, sigma)[1:]


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each text position the common prefix, up to ``most``, with the suffix before it in the order.

    In text order (permuted), where both sides of a repeat are read from left to right. Eight characters are compared at a
    time; only the positions still equal are looked at again. text: uint8.
    """
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    padded = np.concatenate([text.astype(np.uint8), np.zeros(most + 16, np.uint8)])
    word = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(phi >= 0)
    other, k = phi[live], 0
    while len(live) and k < most:
        apart = word[live + k] ^ word[other + k]
        whole = apart == 0
        at = np.flatnonzero(~whole)
        low = apart[at]
        # the lowest set bit is a power of two, whose exponent a double shows
        out[live[at]] = k + (np.frexp((low & (~low + np.uint64(1))).astype(np.float64))[1] - 1 >> 3)
        live, other = live[whole], other[whole]
        k += 8
    out[live] = k
    # neither side reads past the text's end
    return np.minimum(out, np.minimum(most, np.minimum(n - np.arange(n), np.where(phi >= 0, n - phi, 0))))
