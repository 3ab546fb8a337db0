"""Language-model scores by stupid backoff (T. Brants and others, 2007), computed relationally.

Blocks of documents give tables of their distinct n-grams with counts, partitioned by the n-gram's hash; every part is
summed over all blocks; each block's n-grams are joined to the sums, exploded over its texts and summed per document. Rows
of these tables travel packed: one Spark row holds what a block and a part of the hash space have in common, as arrays.

A document's own occurrences are taken off the counts that score it, so that no text is likely for having been counted. So
n-grams of one document alone need no counts: blocks first tell the leading bits of their n-grams' hashes, and count only
those that another document may have. What shares the leading bits by chance is counted like the rest.

Words are 64-bit hashes, and n-grams as many bits of one as the corpus's size needs: two n-grams of one hash would be
counted as one, which befalls an n-gram about once in 2**29 times at any size.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BLOCK_BYTES, block_count, ddl, forget, in_blocks, release, ship, texts
from .words import hashed_words, mixed

ORDER, BACKOFF = 3, 0.4
#: Text bytes whose n-grams one part of the hash space holds on average.
PART = 8 << 20
#: Bits of a hash beyond those that number the corpus's bytes: those first told, and those that tell n-grams apart.
LEAD, APART = 2, 26

OUT = {"doc_id": pa.int64(), "n_words": pa.int64(), "log_score": pa.float64(), "mean_log_score": pa.float64(), "backed_off": pa.int64()}

_G = np.uint64(0x9E3779B97F4A7C15)


def ngrams(words: np.ndarray, sizes: np.ndarray, order: int, bits: int = 64):
    """Keys of the n-grams that end at each word, for n from 1 to ``order``; 0 where the document has too few words before.
    Only their leading bits are set."""
    place, key, last = _ramp(sizes), np.zeros(len(words), np.uint64), np.uint64(1 << 64 - bits)
    for n in range(1, order + 1):
        key[n - 1 :] += words[: max(0, len(words) - n + 1)] * np.uint64(pow(int(_G), 2 * n - 1, 1 << 64))
        yield np.where(place >= n - 1, mixed(mixed(key) + np.uint64(n)) & ~(last - np.uint64(1)) | last, np.uint64(0))


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def in_order(x: np.ndarray, bits: int = 64) -> np.ndarray:
    """The stable order of values below 2**bits: they are sorted with their places in the low bits, which is faster."""
    k = np.uint64(max(1, (len(x) - 1).bit_length()))
    place, low = np.arange(len(x), dtype=np.uint64), (np.uint64(1) << k) - np.uint64(1)
    if bits + int(k) <= 64:
        return (np.sort(x << k | place) & low).astype(np.int64)
    order = (np.sort(x >> k << k | place) & low).astype(np.int64)
    y = x[order]  # in order but for values that differ in the low bits alone
    return np.argsort(x, kind="stable") if (y[1:] < y[:-1]).any() else order


def squeezed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences in R. Rice's code: what exceeds k bits in unary, the k low bits as bytes and the rest of bits.
    The differences of hashes are even enough for this to come near their entropy."""
    if not len(keys):
        return b""
    d = np.diff(keys)
    k = max(0, int(d.mean()).bit_length() - 1) if len(d) else 0
    high = (d >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(high.sum()) + len(d), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    low = d.view(np.uint8).reshape(-1, 8)
    rest = (d >> np.uint64(k - k % 8)).astype(np.uint8)[:, None] >> np.arange(k % 8, dtype=np.uint8) & 1
    whole = np.ascontiguousarray(low[:, : k // 8].T)
    return struct.pack("<BQII", k, int(keys[0]), len(keys), len(unary)) + np.packbits(unary).tobytes() + whole.tobytes() + np.packbits(rest.ravel()).tobytes()


def count_of(data: bytes) -> int:
    """How many keys are in squeezed data."""
    return struct.unpack_from("<BQII", data)[2] if data else 0


def expanded(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    k, first, n, bits = struct.unpack_from("<BQII", data)
    at = struct.calcsize("<BQII")
    raw, m = np.frombuffer(data, np.uint8), n - 1
    ends = np.flatnonzero(np.unpackbits(raw[at : at - (-bits // 8)], count=bits))
    d = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    at -= -bits // 8
    for i in range(k // 8):
        d |= raw[at + i * m : at + (i + 1) * m].astype(np.uint64) << np.uint64(8 * i)
    at += k // 8 * m
    if k % 8:
        rest = np.unpackbits(raw[at:], count=m * (k % 8)).reshape(m, -1)
        d |= (rest.astype(np.uint64) << np.arange(k - k % 8, k, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return np.cumsum(np.concatenate([np.array([first], np.uint64), d]), dtype=np.uint64)


def planes(x: np.ndarray) -> bytes:
    """Counts byte by byte of equal weight, as many as the largest needs."""
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8)[1:].reshape(width, -1)
    return sum(raw[i].astype(np.int64) << 8 * i for i in range(width))


class Grams:
    """The n-grams of one order in a block: distinct keys in order with counts, and whether several documents have them."""

    def __init__(self, keys: np.ndarray, of: np.ndarray):
        at = np.flatnonzero(keys)
        order = at[in_order(keys[at])]
        k, docs = keys[order], of[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        new_doc = new.copy()
        new_doc[1:] |= docs[1:] != docs[:-1]
        first = np.flatnonzero(new)
        self.known, self.count = k[first], np.diff(first, append=len(k))
        self.many = np.add.reduceat(new_doc, first, dtype=np.int64) > 1 if len(first) else first > 0
        self._words, self._order, self._new, self._new_doc = len(keys), order, new, new_doc

    def of_words(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word the place of its n-gram among the keys (-1 without one), and how often its document has it."""
        place, own, first = np.full(self._words, -1), np.zeros(self._words, np.int64), np.flatnonzero(self._new_doc)
        place[self._order] = np.cumsum(self._new) - 1
        times = np.diff(first, append=len(self._order))
        own[self._order] = np.repeat(times, times)
        return place, own

    def cuts(self, parts: int) -> np.ndarray:
        """Where the keys of each part begin; parts are equal ranges of the hash space."""
        return np.searchsorted((self.known >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))


def _block(table: pa.Table, order: int, bits: int):
    """(sizes of the texts, document of each word, an iterator of Grams by order)."""
    forget("backoff")
    words, sizes = hashed_words(table.column("text").to_pylist())
    of = np.repeat(np.arange(len(sizes)), sizes)
    return sizes, of, (Grams(keys, of) for keys in ngrams(words, sizes, order, bits))


def _by_part(rows: pa.Table, *columns: str) -> dict[int, tuple]:
    return dict(zip(rows.column("part").to_pylist(), zip(*[rows.column(c).to_pylist() for c in columns])))


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    return pa.table({n: pa.array([r[i] for r in rows], kinds[k]) for i, (n, k) in enumerate(x.split() for x in schema.split(", "))})


# Arrays have an entry for each order.
_HEARD = "part int, block int, keys array<binary>, many binary"
_FLAGS = "block int, part int, flags binary"
_COUNTS = "part int, block int, keys array<binary>, counts array<binary>, words long"
_TOTALS = "block int, part int, totals array<binary>, words long"


def backoff_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score and backed_off of every row of ``docs``.

    A word scores the count of the longest n-gram that ends at it and stands in another document too, over the count of its
    context, times ``backoff`` for each word of context given up; a word seen nowhere else counts once over all words plus
    one. log_score sums the natural logarithms, mean_log_score is that per word, and backed_off counts the words that gave
    up context. A null or empty text scores 0 over no words. Repeated rows count and score as rows of their own; null ids
    stay null; other columns are ignored; texts of any length count whole.
    """
    ship(docs.sparkSession)
    docs = texts(docs)
    blocks = block_count(docs, block_bytes)
    parts = max(8, -(-blocks * block_bytes // PART))
    blocked = in_blocks(docs, blocks).select("block", "doc_id", "text")
    size = (blocks * block_bytes).bit_length()
    # by chance an n-gram shares the leading bits of another one in about one of 30 cases, at any size
    bits, shift = min(64, size + APART), np.uint64(64 - min(64, size + LEAD))

    def heard(table: pa.Table) -> pa.Table:
        """Leading bits of the block's n-grams by part."""
        b, rows = table.column("block")[0].as_py(), [([], []) for _ in range(parts)]
        for g in _block(table, order, bits)[2]:
            cut, lead = g.cuts(parts), g.known >> shift
            for row, x, y in zip(rows, cut, cut[1:]):
                row[0].append(squeezed(lead[x:y]))
                row[1].append(g.many[x:y])
        return _table(_HEARD, [(p, b, k, np.packbits(np.concatenate(m)).tobytes()) for p, (k, m) in enumerate(rows) if any(k)])

    def flags_of(table: pa.Table) -> pa.Table:
        """For each block which of its n-grams another document may have."""
        p, data = table.column("part")[0].as_py(), table.column("keys").to_pylist()
        sizes = np.array([[count_of(x) for x in row] for row in data])
        many = [np.unpackbits(np.frombuffer(x, np.uint8), count=s.sum()).astype(bool) for x, s in zip(table.column("many").to_pylist(), sizes)]
        out = [[] for _ in data]
        for n in range(order):
            lead = np.concatenate([expanded(row[n]) for row in data])
            lead -= lead.min() if len(lead) else np.uint64(0)
            o = in_order(lead, int(lead.max()).bit_length() if len(lead) else 1)
            new = np.ones(len(o), bool)
            new[1:] = lead[o][1:] != lead[o][:-1]
            group = np.cumsum(new) - 1
            flag = np.empty(len(o), bool)
            flag[o] = (np.bincount(group) > 1)[group] if len(o) else False
            for i, f in enumerate(np.split(flag, np.cumsum(sizes[:, n])[:-1])):
                a = int(sizes[i, :n].sum())
                out[i].append(f | many[i][a : a + len(f)])
        release()
        return _table(_FLAGS, [(b, p, np.packbits(np.concatenate(x)).tobytes()) for b, x in zip(table.column("block").to_pylist(), out)])

    def wanted(flags: dict, cuts: list, p: int) -> list[np.ndarray]:
        """Which keys of a part are counted, for each order."""
        sizes = [int(c[p + 1] - c[p]) for c in cuts]
        return np.split(np.unpackbits(np.frombuffer(flags[p][0], np.uint8), count=sum(sizes)).astype(bool), np.cumsum(sizes)[:-1])

    def counts_of(left: pa.Table, right: pa.Table) -> pa.Table:
        """Counts of the n-grams that matter, by part; the block's words go to the first part."""
        if not left.num_rows:
            return _table(_COUNTS, [])
        b, flags = left.column("block")[0].as_py(), _by_part(right, "flags")
        sizes, _, grams = _block(left, order, bits)
        known, cuts, rows = [], [], []
        for g in grams:
            known.append((g.known >> np.uint64(64 - bits), g.count))
            cuts.append(g.cuts(parts))
        for p in sorted({0, *flags} if sizes.sum() else ()):
            keep = wanted(flags, cuts, p) if p in flags else [np.zeros(0, bool)] * order
            some = [[x[c[p] : c[p + 1]][f] for x in ks] if len(f) else [x[:0] for x in ks] for ks, c, f in zip(known, cuts, keep)]
            if p == 0 or any(len(k) for k, _ in some):
                rows.append((p, b, [squeezed(k) for k, _ in some], [planes(c) for _, c in some], int(sizes.sum()) if p == 0 else 0))
        release()
        return _table(_COUNTS, rows)

    def summed(table: pa.Table) -> pa.Table:
        """For each block its n-grams' counts in all blocks."""
        told, counted = table.column("keys").to_pylist(), table.column("counts").to_pylist()
        out = [[] for _ in told]
        for n in range(order):
            keys, counts = [expanded(row[n]) for row in told], np.concatenate([unplaned(row[n]) for row in counted])
            flat = np.concatenate(keys)
            o = in_order(flat, bits)
            new = np.ones(len(o), bool)
            new[1:] = flat[o][1:] != flat[o][:-1]
            group = np.cumsum(new) - 1
            totals = np.empty(len(o), np.int64)
            totals[o] = np.bincount(group, counts[o])[group].astype(np.int64) if len(o) else 0
            for x, t in zip(out, np.split(totals, np.cumsum([len(k) for k in keys])[:-1])):
                x.append(planes(t))
        words = sum(table.column("words").to_pylist())
        release()
        return _table(_TOTALS, [(b, p, x, words) for b, p, x in zip(table.column("block").to_pylist(), table.column("part").to_pylist(), out)])

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({k: pa.array([], t) for k, t in OUT.items()})
        is_total = np.asarray(right.column("kind")) == 1
        flags, totals = _by_part(right.filter(pa.array(~is_total)), "flags"), _by_part(right.filter(pa.array(is_total)), "totals", "words")
        sizes, of, grams = _block(left, order, bits)
        place = _ramp(sizes)
        at = dict.fromkeys(flags, 0)  # flags that the orders before have used
        log = level = before = None
        for n, g in enumerate(grams, 1):
            cut, total = g.cuts(parts), np.zeros(len(g.known) + 1, np.int64)  # the last place stands for no n-gram
            for p, used in at.items():
                at[p] = used + int(cut[p + 1] - cut[p])
                hit = np.flatnonzero(np.unpackbits(np.frombuffer(flags[p][0], np.uint8), count=at[p])[used:])
                if len(hit):
                    total[cut[p] + hit] = unplaned(totals[p][0][n - 1])
            at_key, own = g.of_words()
            elsewhere = np.maximum(total[at_key] - own, 0).astype(np.float64)  # uncounted: in no other document
            if n == 1:
                log = np.log(np.maximum(elsewhere, 1)) - np.log(totals[0][1] - sizes[of] + 1.0) if len(of) else elsewhere
                level = np.ones(len(of), np.int64)
            else:
                context = np.zeros(len(of))
                context[1:] = before[:-1]
                hit = elsewhere > 0
                log[hit] = np.log(elsewhere[hit]) - np.log(np.maximum(context[hit], elsewhere[hit]))
                level[hit] = n
            before = elsewhere
        given_up = np.minimum(place + 1, order) - level
        log += given_up * np.log(backoff)
        sums = np.bincount(of, log, len(sizes)).astype(np.float64)
        release()
        return pa.table({
            "doc_id": left.column("doc_id"), "n_words": pa.array(sizes), "log_score": pa.array(sums), "mean_log_score": pa.array(sums / np.maximum(sizes, 1)),
            "backed_off": pa.array(np.bincount(of[given_up > 0], minlength=len(sizes)).astype(np.int64)),
        })

    flags = blocked.groupBy("block").applyInArrow(heard, _HEARD).groupBy("part").applyInArrow(flags_of, _FLAGS)
    counted = blocked.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(counts_of, _COUNTS)
    totals = counted.groupBy("part").applyInArrow(summed, _TOTALS)
    told = flags.selectExpr("block", "part", "0 AS kind", "flags", "CAST(NULL AS array<binary>) AS totals", "0L AS words").union(totals.selectExpr("block", "part", "1", "NULL", "totals", "words"))
    return blocked.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(scored, ddl(OUT))
