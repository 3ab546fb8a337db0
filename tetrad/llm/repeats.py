"""Removal of repeated passages with suffix arrays built shard by shard.

A byte goes if a string of 100 bytes that covers it also starts earlier in the corpus. To bring equal strings together
without moving the corpus, each string is filed under its anchor, the least hash among its 32-byte pieces: equal strings
have equal anchors at equal places. Neighbouring strings with one anchor form a stretch.

1. Every block of documents tells the anchors that it has; anchors seen in one place only are done with.
2. The distinct stretches of the other anchors go to the anchor's shard, one for each block that has them, with their first
   place there. A shard leaves out strings whose hash no other has, which equal none, sorts the suffixes of the rest by induced
   sorting, computes permuted common prefixes, takes neighbours that share 100 bytes together and finds the first place of every
   string.
3. Each block learns which of its strings come first in the corpus, and cuts out what all others cover.

Strings are compared by their bytes: stretches of one identity when they meet, all others in the suffix array. Hashes only
decide what meets where, and what meets nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count, ddl, forget, in_blocks, release, ship, texts
from .suffix import permuted_common_prefixes, suffix_array
from .words import mixed

LENGTH, PIECE = 100, 32
BLOCK, SHARD = 2 << 20, 12 << 20
#: Bytes of stretches whose suffixes are sorted at one time; a suffix takes about 60 bytes of memory.
LOT = 2 << 20

OUT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}

_B = 0x9E3779B97F4A7C15


#: Places whose hashes are computed together (a power of two): their arrays stay in a core's cache.
STEP = 1 << 15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_B, STEP + LENGTH), _powers(pow(_B, -1, 1 << 64), STEP)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_B, n, 1 << 64))


class Hashes:
    """Polynomial hashes of the windows of bytes, as differences of sums in which byte i counts ``_B ** -i`` times."""

    def __init__(self, t: np.ndarray):
        self.sums = np.zeros(len(t) + 1, np.uint64)
        for a in range(0, len(t), STEP):
            part = t[a : a + STEP].astype(np.uint64)
            part += np.uint64(1)
            part *= _DOWN[: len(part)]
            part *= _power(-a)
            np.cumsum(part, out=part)
            np.add(part, self.sums[a], out=self.sums[a + 1 : a + 1 + len(part)])
        self.up = np.array([_power(a) for a in range(0, len(t) + 1, STEP)], np.uint64)

    def at(self, start: np.ndarray, size: int) -> np.ndarray:
        """Of the windows of ``size`` bytes from the starts."""
        return (self.sums[start + size] - self.sums[start]) * _UP[start & STEP - 1] * self.up[start // STEP] * _power(size - 1)

    def row(self, a: int, n: int, size: int) -> np.ndarray:
        """Of the n windows (STEP + LENGTH at most) from place a on."""
        out = self.sums[a + size : a + size + n] - self.sums[a : a + n]
        out *= _UP[:n]
        out *= _power(a + size - 1)
        return out


class Stretches:
    """The stretches of a block's texts: their strings' starts, anchors and identities.

    start: of the first string; count: strings (their starts follow one another); anchor: hash of the anchor; at: place of the
    anchor from the start; same: identity of the stretch (anchor, place, count and bytes).
    """

    def __init__(self, flat: np.ndarray, ends: np.ndarray):
        self.start = self.count = self.at = np.zeros(0, np.int64)
        self.anchor = self.same = np.zeros(0, np.uint64)
        m = len(flat) - LENGTH + 1
        if m <= 0:
            return
        hashes, width, tail = Hashes(flat), LENGTH - PIECE + 1, np.uint64((1 << 16) - 1)
        place, numbers = np.empty(m, np.int64), np.arange(STEP + width, dtype=np.uint64)
        for a in range(0, m, STEP):
            n = min(STEP, m - a)
            low = mixed(hashes.row(a, n + width - 1, PIECE))
            # a hash's high bits before its place: the least is the leftmost of equal ones
            low &= ~tail
            low |= numbers[: len(low)]
            k = 1
            while 2 * k <= width:
                low = np.minimum(low[:-k], low[k:])
                k *= 2
            low = np.minimum(low[:n], low[width - k : width - k + n])
            low &= tail
            np.add(low.view(np.int64), a, out=place[a : a + n])
        valid = np.ones(m, bool)
        for first, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
            valid[max(first, end - LENGTH + 1) : end] = False
        # bounds between places that do not belong to one stretch
        apart = np.ones(m + 1, bool)
        np.not_equal(place[1:], place[:-1], out=apart[1:-1])
        new, stop = valid & apart[:-1], valid & apart[1:]
        new[1:] |= valid[1:] & ~valid[:-1]
        stop[:-1] |= valid[:-1] & ~valid[1:]
        self.start = np.flatnonzero(new)
        last = np.flatnonzero(stop)
        self.count = last - self.start + 1
        self.at = place[self.start] - self.start
        self.anchor = mixed(hashes.at(place[self.start], PIECE))
        self.same = mixed(self.anchor ^ mixed(hashes.at(self.start, LENGTH) + (self.at.astype(np.uint64) << np.uint64(8)) + self.count.astype(np.uint64)) ^ (hashes.at(last, LENGTH) * np.uint64(_B)))

    def only(self, keep: np.ndarray) -> None:
        for k in ("start", "count", "at", "anchor", "same"):
            setattr(self, k, getattr(self, k)[keep])


def _differ(flat: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, lot: int = 4 << 20) -> np.ndarray:
    """Whether the bytes at a and those at b differ, for each of the sizes (all above 0)."""
    out, ends, i = np.zeros(len(sizes), bool), np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + lot, side="right")))
        step = _ramp(sizes[i:j])
        unequal = flat[np.repeat(a[i:j], sizes[i:j]) + step] != flat[np.repeat(b[i:j], sizes[i:j]) + step]
        out[i:j] = np.logical_or.reduceat(unequal, np.cumsum(sizes[i:j]) - sizes[i:j])
        i = j
    return out


def told_apart(same: np.ndarray, start: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Identities that are equal only where bytes are: where 64 bits are not enough, others get a digest of their bytes."""
    if not len(same):
        return same
    order = np.argsort(same, kind="stable")
    new = np.concatenate([[True], same[order][1:] != same[order][:-1]])
    rows, lead = order[~new], order[new][np.cumsum(new) - 1][~new]
    wrong = sizes[rows] != sizes[lead]
    fit = np.flatnonzero(~wrong)
    wrong[fit] = _differ(flat, start[rows[fit]], start[lead[fit]], sizes[rows[fit]])
    if not wrong.any():
        return same
    same = same.copy()
    for i in rows[wrong].tolist():
        same[i] = int.from_bytes(hashlib.blake2b(flat[start[i] : start[i] + sizes[i]].tobytes(), digest_size=8).digest(), "little")
    return told_apart(same, start, sizes, flat)


def _bytes(text: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end, and where each ends."""
    text = pa.concat_arrays(text.cast(pa.large_binary()).chunks) if text.num_chunks else pa.array([], pa.large_binary())
    _, offsets, data = text.buffers()
    ends = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return flat, ends[1:] - ends[0]


class Block:
    """A block's rows by (doc_id, tag), end to end as bytes."""

    def __init__(self, table: pa.Table):
        forget("repeats")
        order = table.select(["doc_id", "tag"]).to_pandas().sort_values(["doc_id", "tag"], kind="stable", na_position="first").index.to_numpy()
        table = table.take(pa.array(order))
        self.rows = table
        self.doc_id = table.column("doc_id")
        self.tag = np.asarray(table.column("tag"))
        self.flat, self.ends = _bytes(table.column("text"))
        self.id = np.asarray(self.doc_id.combine_chunks().fill_null(-(2**63)) if isinstance(self.doc_id, pa.ChunkedArray) else self.doc_id.fill_null(-(2**63)))
        self.stretches = Stretches(self.flat, self.ends)

    def texts(self, gone: np.ndarray):
        """(bytes, which of them are gone) of each row."""
        for a, b in zip([0, *self.ends[:-1].tolist()], self.ends.tolist()):
            yield self.flat[a:b], gone[a:b]

    def shard(self, n: int) -> np.ndarray:
        return (self.stretches.anchor % np.uint64(n)).astype(np.int64)

    def keep_repeated(self, rows: pa.Table, n: int) -> None:
        """Leave only the stretches of the anchors that a shard has called repeated. rows: shard, flags."""
        flags = {s: np.unpackbits(np.frombuffer(f, np.uint8)) for s, f in zip(rows.column("shard").to_pylist(), rows.column("flags").to_pylist())}
        shard = self.shard(n)
        keep = np.zeros(len(shard), bool)
        for s, at in _groups(shard):
            anchors, place = np.unique(self.stretches.anchor[at], return_inverse=True)
            keep[at] = flags[s][: len(anchors)].astype(bool)[place]
        self.stretches.only(keep)
        z = self.stretches
        z.same = told_apart(z.same, z.start, z.count + LENGTH - 1, self.flat)

    def distinct(self, n: int):
        """(shard, first, inverse of its own) for each shard: first occurrences of its distinct stretches by identity."""
        shard = self.shard(n)
        for s, at in _groups(shard):
            _, first, inverse = np.unique(self.stretches.same[at], return_index=True, return_inverse=True)
            yield s, at, at[first], inverse


def _groups(key: np.ndarray):
    """(value, places in order) of each value."""
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(key[order], prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(order)]):
        yield int(key[order[a]]), order[a:b]


def _recurs(hashes: np.ndarray) -> np.ndarray:
    """Where another of the hashes is the same."""
    order = np.argsort(hashes)
    equal = hashes[order[1:]] == hashes[order[:-1]]
    out = np.zeros(len(hashes), bool)
    out[order[1:][equal]] = out[order[:-1][equal]] = True
    return out


def _judge(entries: dict[str, np.ndarray], strings: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits (row: entry, column: string of its stretch) of the strings whose first place in the corpus is the entry's.

    entries: anchor, same, count, doc, tag, start. Equal stretches are taken together beforehand; the suffixes of the
    different ones are sorted, and strings that share LENGTH bytes are one. A string whose hash no other has equals none and
    comes first where it is; of a stretch only what lies between other strings is sorted.
    """
    n = len(entries["same"])
    entries["same"] = told_apart(entries["same"], offsets, entries["count"] + LENGTH - 1, strings)
    corpus = np.lexsort((entries["start"], entries["tag"], entries["doc"]))
    rank = np.empty(n, np.int64)
    rank[corpus] = np.arange(n)
    key = corpus[np.argsort(entries["same"][corpus], kind="stable")]
    lead = key[np.concatenate([[True], entries["same"][key][1:] != entries["same"][key][:-1]])] if n else key
    bits = np.zeros((n, LENGTH - PIECE + 1), bool)
    count = entries["count"][lead]
    # an anchor with one stretch needs no sorting: all its strings come first at the least entry
    _, place, times = np.unique(entries["anchor"][lead], return_inverse=True, return_counts=True)
    alone = times[place] == 1
    bits[lead[alone]] = np.arange(bits.shape[1])[None, :] < count[alone][:, None]
    lead = lead[~alone]
    lead = lead[np.argsort(entries["anchor"][lead], kind="stable")]
    bounds, a = np.cumsum(entries["count"][lead] + LENGTH), 0
    while a < len(lead):  # lots of whole anchors of about LOT bytes
        b = max(a + 1, int(np.searchsorted(bounds, (bounds[a - 1] if a else 0) + LOT)))
        while b < len(lead) and entries["anchor"][lead[b]] == entries["anchor"][lead[b - 1]]:
            b += 1
        some, a = lead[a:b], b
        count = entries["count"][some]
        sizes, own, step = count + LENGTH - 1, np.repeat(some, count), _ramp(count)
        lot, first = strings[np.repeat(offsets[some], sizes) + _ramp(sizes)], np.cumsum(sizes) - sizes
        again = _recurs(Hashes(lot).at(np.repeat(first, count) + step, LENGTH))
        bits[own[~again], step[~again]] = True
        # of each stretch, what lies between its first and last string that may have an equal
        low, high = np.where(again, step, LENGTH), np.where(again, step, -1)
        row = np.cumsum(count) - count
        low, high = np.minimum.reduceat(low, row), np.maximum.reduceat(high, row)
        live = high >= low
        if not live.any():
            continue
        some, count, low, first = some[live], (high - low + 1)[live], low[live], first[live]
        sizes = count + LENGTH - 1
        to = np.cumsum(sizes + 1) - sizes - 1
        narrow = np.zeros(to[-1] + sizes[-1] + 1, np.uint8)  # ends do not matter: only strings within stretches are held together
        is_in = np.ones(len(narrow), bool)
        is_in[to + sizes] = False
        narrow[is_in] = lot[np.repeat(first + low, sizes) + _ramp(sizes)]
        suffixes = suffix_array(np.where(is_in, narrow + np.uint16(1), np.uint16(0)))  # a 0 ends each stretch
        which = np.full(len(narrow), -1, np.int32)
        which[np.repeat(to, count) + _ramp(count)] = np.arange(count.sum())
        common = permuted_common_prefixes(narrow, suffixes, LENGTH)[suffixes] >= LENGTH
        which = which[suffixes]
        told = which >= 0
        common[1:] &= told[:-1]  # equal strings stand side by side, all within stretches
        group, which = np.flatnonzero(~common[told]), which[told]
        place = ((rank[some] << 8)[:, None] + low[:, None] + np.arange(bits.shape[1]))[np.arange(bits.shape[1]) < count[:, None]][which]
        least = np.minimum.reduceat(place, group)
        bits[corpus[least >> 8], least & 255] = True
    return bits


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


_ANCHORS = "shard int, block int, anchors binary, many binary"
_FLAGS = "block int, shard int, flags binary"
_ENTRIES = "shard int, block int, anchor binary, same binary, count binary, doc binary, tag binary, start binary, strings binary"
_BITS = "block int, shard int, bits binary"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    names = [x.split() for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.table({n: pa.array([r[i] for r in rows], kinds[k]) for i, (n, k) in enumerate(names)})


def repeated_bytes(docs: DataFrame, block_bytes: int = BLOCK, shard_bytes: int = SHARD, more: tuple = ()):
    """The blocked documents with, for each block, the verdicts of all shards; and the function that marks a block's bytes."""
    ship(docs.sparkSession)
    docs = texts(docs, *more)
    blocks = block_count(docs, block_bytes)
    shards = max(8, -(-blocks * block_bytes // shard_bytes))
    blocked = in_blocks(docs, blocks).select("block", "doc_id", "text", F.xxhash64("text").alias("tag"), *more)

    def anchors_of(table: pa.Table) -> pa.Table:
        block = Block(table)
        rows = []
        for s, at in _groups(block.shard(shards)):
            own, times = np.unique(block.stretches.anchor[at], return_counts=True)
            rows.append((s, int(table.column("block")[0].as_py()), own.tobytes(), np.packbits(times > 1).tobytes()))
        return _table(_ANCHORS, rows)

    def flags_of(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint64) for x in table.column("anchors").to_pylist()]
        many = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(o)] for x, o in zip(table.column("many").to_pylist(), own)]
        every = np.concatenate(own)
        order = np.argsort(every, kind="stable")
        new = np.concatenate([[True], every[order][1:] != every[order][:-1]])
        group = np.cumsum(new) - 1
        flag = np.empty(len(every), bool)
        flag[order] = (np.bincount(group, np.concatenate(many)[order] + 1.0) > 1)[group]
        cut = np.cumsum([len(o) for o in own])
        return _table(_FLAGS, [(b, s, np.packbits(f).tobytes()) for b, s, f in zip(table.column("block").to_pylist(), table.column("shard").to_pylist(), np.split(flag, cut[:-1]))])

    def entries_of(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table(_ENTRIES, [])
        block = Block(left)
        block.keep_repeated(right, shards)
        z, rows = block.stretches, []
        owner = np.searchsorted(block.ends, z.start, side="right")
        begin = np.concatenate([[0], block.ends[:-1]]).astype(np.int64)
        for s, _, first, _ in block.distinct(shards):
            sizes = z.count[first] + LENGTH - 1
            strings = block.flat[np.repeat(z.start[first], sizes) + _ramp(sizes)]
            o = owner[first]
            rows.append((s, int(left.column("block")[0].as_py()), z.anchor[first].tobytes(), z.same[first].tobytes(), z.count[first].astype(np.uint8).tobytes(), block.id[o].tobytes(), block.tag[o].tobytes(), (z.start[first] - begin[o]).tobytes(), strings.tobytes()))
        return _table(_ENTRIES, rows)

    def bits_of(table: pa.Table) -> pa.Table:
        kinds = {"anchor": np.uint64, "same": np.uint64, "count": np.uint8, "doc": np.int64, "tag": np.int64, "start": np.int64}
        lots = {k: [np.frombuffer(x, t) for x in table.column(k).to_pylist()] for k, t in kinds.items()}
        entries = {k: np.concatenate(v) for k, v in lots.items()}
        entries["count"] = entries["count"].astype(np.int64)
        strings = np.frombuffer(b"".join(table.column("strings").to_pylist()), np.uint8)
        sizes = entries["count"] + LENGTH - 1
        forget("repeats")
        bits = _judge(entries, strings, np.cumsum(sizes) - sizes)
        release()
        cut = np.cumsum([len(x) for x in lots["same"]])
        return _table(_BITS, [(b, s, np.packbits(x, axis=1).tobytes()) for b, s, x in zip(table.column("block").to_pylist(), table.column("shard").to_pylist(), np.split(bits, cut[:-1]))])

    flags = blocked.groupBy("block").applyInArrow(anchors_of, _ANCHORS).groupBy("shard").applyInArrow(flags_of, _FLAGS)
    entries = blocked.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(entries_of, _ENTRIES)
    bits = entries.groupBy("shard").applyInArrow(bits_of, _BITS)
    # what a block needs at its end: flags and bits of each shard
    verdicts = flags.select("block", "shard", F.lit(0).alias("kind"), F.col("flags").alias("data")).union(bits.select("block", "shard", F.lit(1), "bits"))

    def marked(left: pa.Table, right: pa.Table) -> tuple[Block, np.ndarray]:
        block = Block(left)
        kind = np.asarray(right.column("kind"))
        flag_rows, bit_rows = right.filter(pa.array(kind == 0)), right.filter(pa.array(kind == 1))
        block.keep_repeated(flag_rows.rename_columns(["block", "shard", "kind", "flags"]), shards)
        z = block.stretches
        edge = np.zeros(len(block.flat) + 1, np.int64)
        told = dict(zip(bit_rows.column("shard").to_pylist(), bit_rows.column("data").to_pylist()))
        width = LENGTH - PIECE + 1
        for s, at, first, inverse in block.distinct(shards):
            keep = np.unpackbits(np.frombuffer(told[s], np.uint8).reshape(len(first), -1), axis=1)[:, :width].astype(bool)
            gone = np.arange(width)[None, :] < z.count[at][:, None]
            lead = np.zeros(len(z.start), bool)
            lead[first] = True
            gone &= ~(keep[inverse] & lead[at][:, None])
            row, step = np.nonzero(gone)
            begin = z.start[at[row]] + step
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + LENGTH, -1)
        return block, np.cumsum(edge[:-1]) > 0

    return blocked, verdicts, marked


def remove_repeats(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``; with ``keep`` also kept (binary).

    A byte is removed if some string of 100 bytes over it also starts earlier, in a document of smaller id or earlier in its
    own; strings never cross documents, are judged on the input, and may overlap. A null or empty text has no bytes; shorter
    texts keep all. Rows that repeat an id are ordered by a hash of their text, and equal rows one after another; a null id
    stands first. Other columns are ignored.
    """
    blocked, verdicts, marked = repeated_bytes(docs)
    out = OUT | ({"kept": pa.binary()} if keep else {})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({k: pa.array([], t) for k, t in out.items()})
        block, gone = marked(left, right)
        rows: dict = {k: [] for k in out}
        rows["doc_id"] = block.doc_id
        for raw, mask in block.texts(gone):
            n = int(np.count_nonzero(mask))
            rest = raw[~mask].tobytes() if n else raw.tobytes()
            rows["n_bytes"].append(len(raw))
            rows["n_removed"].append(n)
            rows["n_spans"].append(int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1])) if n else 0)
            rows["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            if keep:
                rows["kept"].append(rest)
        return pa.table({k: v if isinstance(v, pa.ChunkedArray) else pa.array(v, out[k]) for k, v in rows.items()})

    return blocked.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(run, ddl(out))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns and rows, and texts without the bytes that remove_repeats removes; n_chars follows.

    A character of which a cut leaves only some bytes goes too. A null text stays null.
    """
    from pyspark.sql import types as T

    rest = T.StructType(docs.schema.fields)
    carried = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    blocked, verdicts, marked = repeated_bytes(carried, more=("__row",))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(["__row"]).append_column("__kept", pa.array([], pa.string()))
        block, gone = marked(left, right)
        kept = [raw[~mask].tobytes().decode(errors="ignore") for raw, mask in block.texts(gone)]
        return block.rows.select(["__row"]).append_column("__kept", pa.array(kept, pa.string()))

    schema = T.StructType([T.StructField("__row", rest), T.StructField("__kept", T.StringType())])
    done = blocked.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(run, schema)
    text = F.when(F.col("__row.text").isNull(), F.lit(None)).otherwise(F.col("__kept"))
    new = {"text": text, "n_chars": F.when(F.col("__row.n_chars").isNull(), F.lit(None)).otherwise(F.length(text).cast("long"))} if "n_chars" in docs.columns else {"text": text}
    return done.select(*[(new[c] if c in new else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])
