"""Words of texts as 64-bit hashes, in whole-array steps."""

from __future__ import annotations

import hashlib

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_K = np.uint64(0x9E3779B97F4A7C15)
#: The first n bytes of eight, little-endian.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words are hashed one by one.
LONG = 1024


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits from each uint64 (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(bodies: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and how many words each text has.

    Words stand between ASCII white space; A-Z count as a-z. Eight bytes at a time are mixed into a word's hash, which
    begins with its length.
    """
    raw = [t.encode() for t in bodies]
    data = b" ".join(raw).lower() + b" " * 8
    space = _SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, length = edge[::2], edge[1::2] - edge[::2]
    sizes = np.diff(np.searchsorted(start, np.cumsum([len(r) + 1 for r in raw])), prepend=0) if raw else np.zeros(0, np.int64)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = mixed(length.astype(np.uint64) * _K)
    h = mixed(h * _K ^ eight[start] & _MASK[np.minimum(length, 8)])
    k, live = 8, np.flatnonzero((length > 8) & (length <= LONG))
    while len(live):
        left = length[live] - k
        h[live] = mixed(h[live] * _K ^ eight[start[live] + k] & _MASK[np.minimum(left, 8)])
        k, live = k + 8, live[left > 8]
    for i in np.flatnonzero(length > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + length[i]], digest_size=8).digest(), "little")
    return h, sizes
