"""Near-duplicates by b-bit MinHash.

A document's set is its distinct word shingles. Documents with equal sets form a class. Of each class's minima the low bits
are packed; bands of whole minima give candidates, the packed bits of two candidates give a collision-corrected estimate by
counting bits, and candidates that may reach the threshold are confirmed on their full sets.

Candidates never are all pairs of a bucket. Every member is first held against its bucket's least class. Links found so
join classes to components; a bucket whose members then are in one component is done, since further links in it would
change nothing. Members outside the least class's component are next, in a few rounds, each held against one member of it
drawn at random, which joins what is linked at all to a large group. Whoever is still outside is held against all members
of other components, so no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attached, checkpointed, forget, ship, split_batch, texts
from .components import components
from .words import hashed_words, mixed

WORDS, THRESHOLD = 5, 75
#: Bands of rows: a pair of similarity 0.75 is missed by all bands once in 190,000 times, one of 0.8 once in 20 million.
BANDS, ROWS, BITS = 32, 4, 4
#: Pairs estimated below this are not confirmed: five standard deviations below the threshold.
LEAST_ESTIMATE = 0.55
#: Rounds in which members outside their bucket's main component are held against one random member of it at most.
MOST_ROUNDS = 3
#: Members of a bucket that one task holds against as many others.
CHUNK = 1024
#: Partners of a class that one group of a task confirms, and requests for texts that are broadcast (40 bytes each).
PARTNERS, MOST_BROADCAST = 256, 500_000

_M = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(bodies: list[str], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: n words, or all of fewer."""
    forget("minhash")
    h, sizes = hashed_words(bodies)
    m = max(0, len(h) - n + 1)
    roll = np.zeros(m, np.uint64)
    for j in range(n):
        roll = roll * _M + h[j : j + m]
    roll = mixed(roll)
    out, a = [], 0
    for k in sizes.tolist():
        if k >= n:
            s = np.sort(roll[a : a + k - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif k:
            x = np.uint64(k)
            with np.errstate(over="ignore"):
                for y in h[a : a + k]:
                    x = x * _M + y
            out.append(mixed(np.array([x], np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        else:
            out.append(np.zeros(0, np.uint64))
        a += k
    return out


_SEEDS = mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * _M)
_A, _B = _SEEDS[: BANDS * ROWS] | np.uint64(1), _SEEDS[BANDS * ROWS :]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """uint32 minima of each nonempty set (row) under each permutation (column)."""
    out = np.zeros((len(sets), BANDS * ROWS), np.uint32)
    a = 0
    while a < len(sets):
        b, size = a, 0
        while b < len(sets) and (b == a or size + len(sets[b]) <= 1 << 16):
            size += len(sets[b])
            b += 1
        flat = np.concatenate(sets[a:b])
        first = np.cumsum([0, *map(len, sets[a : b - 1])])
        for k in range(BANDS * ROWS):
            out[a:b, k] = np.minimum.reduceat((flat * _A[k] + _B[k]) >> np.uint64(32), first)
        a = b
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, packed into uint64 words."""
    per = 64 // BITS
    x = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(low), -1, per)
    return np.bitwise_or.reduce(x << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (last axis: words): the share of equal fields, less that of chance collisions."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x = (x | (x >> np.uint64(2))) & np.uint64(0x1111111111111111)
    same = 1 - np.bitwise_count(x).sum(-1) / (BANDS * ROWS)
    return (same - 2.0**-BITS) / (1 - 2.0**-BITS)


def band_keys(low: np.ndarray) -> np.ndarray:
    """One int64 key for each band of each row of minima."""
    x = low.astype(np.uint64).reshape(len(low), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(low), BANDS)).copy()
    for r in range(ROWS):
        key = mixed(key * _M + x[:, :, r])
    return key.view(np.int64)


def _class_ids(sets: list[np.ndarray], salt: int) -> np.ndarray:
    """A 64-bit id of each set, by its content; ids of another salt are independent of it."""
    with np.errstate(over="ignore"):
        add, by = mixed(np.array([salt, salt + 1], np.uint64) * _M) | np.uint64(1)
        return np.array([np.bitwise_xor.reduce(mixed(s * by + add)) + mixed(np.array([len(s)], np.uint64))[0] + s.sum(dtype=np.uint64) * by if len(s) else 0 for s in sets], np.uint64).view(np.int64)


def signed_documents(docs: DataFrame, salt: int = 0) -> DataFrame:
    """doc_id, row, n_shingles, cid (the set's id), check (another one), keys (of its bands), bits (packed low bits); the last
    four are null for empty sets. docs: of texts(), with ``row``."""

    def run(batches):
        for whole in batches:
            for b in split_batch(whole):
                sets = shingle_sets(b.column("text").to_pylist())
                full = [s for s in sets if len(s)]
                low = minima(full)
                keys, bits = iter(band_keys(low)), iter(packed(low))
                cid, check = ([int(c) if len(s) else None for s, c in zip(sets, _class_ids(sets, n))] for n in (salt, salt + 1_000_000))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(cid, pa.int64()), pa.array(check, pa.int64()), *[pa.array([next(x).tobytes() if len(s) else None for s in sets], pa.binary()) for x in (keys, bits)]],
                    names=["doc_id", "row", "n_shingles", "cid", "check", "keys", "bits"],
                )

    return docs.mapInArrow(run, "doc_id long, row long, n_shingles long, cid long, check long, keys binary, bits binary")


def _in_bands(classes: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                keys = np.frombuffer(b"".join(b.column("keys").to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(np.asarray(b.column("cid")), BANDS))], names=["bucket", "cid"])

    return classes.select("cid", "keys").mapInArrow(run, "bucket long, cid long")


def _estimated(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, bits_a, bits_b) whose estimate may reach the threshold, without their bits."""

    def run(batches):
        for t in batches:
            if t.num_rows:
                x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint64).reshape(t.num_rows, -1) for c in ("bits_a", "bits_b"))
                yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(estimate(x, y) >= LEAST_ESTIMATE))

    return pairs.mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= threshold * union."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < threshold * len(y):
        return False
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * common >= threshold * (len(x) + len(y) - common)


def _sets(docs: DataFrame, wanted: DataFrame, columns: list[str], salt: int) -> DataFrame:
    """The wanted rows (row, cid, ...) with the set of their class, from the texts read again.

    ``row`` is a hash of the id and the text, never null, so that texts without an id are found too. What asks for a text is
    broadcast if it is small; otherwise the texts are shuffled to it.
    """
    asked = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted.hint("shuffle_hash")
    types = {n: "long" if t == "bigint" else t for n, t in wanted.dtypes}

    def sets_of(batches):
        for whole in batches:
            for b in split_batch(whole):
                texts_: dict[str, int] = {}
                place = [texts_.setdefault(t, len(texts_)) for t in b.column("text").to_pylist()]
                sets = shingle_sets(list(texts_))
                own = _class_ids(sets, salt)
                some = pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array([sets[i].tobytes() for i in place], pa.binary())], names=[*columns, "set"])
                yield some.filter(pa.array(own[place] == np.asarray(b.column("cid"))))

    return docs.join(asked, "row").select("text", *columns).mapInArrow(sets_of, ", ".join(f"{c} {types[c]}" for c in columns) + ", set binary")


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, threshold: int, salt: int) -> DataFrame:
    """Those of the pairs (a, b) of classes whose full sets link.

    Only the texts of classes in question are read again. Each set travels once for each of its pairs to its partner's
    bucket of pairs; a class with many partners is split over buckets, which each get its set.
    """
    buckets = F.ceil(F.col("n") / PARTNERS).cast("int").alias("parts")
    partners = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", buckets)
    split = attached(pairs, ["a"], ["b"], [F.count("*").alias("n")], [F.sum("n").alias("n")]).select("a", "b", buckets).withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    wanted = split.select(F.col("b").alias("cid"), "a", "part", F.lit(1).alias("side")).union(partners.select(F.col("a").alias("cid"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0)))
    wanted = checkpointed(wanted.join(classes.select("cid", "row"), "cid"))
    groups = max(8, wanted.count() // PARTNERS)
    sets = _sets(docs, wanted, ["cid", "a", "part", "side"], salt)

    def run(table: pa.Table) -> pa.Table:
        first: dict = {}
        rows = list(zip(*[table.column(c).to_pylist() for c in ("a", "part", "side", "cid")], table.column("set")))
        for a, part, side, _, x in rows:
            if side == 0:
                first[a, part] = np.frombuffer(x.as_buffer(), np.uint64)
        found = {}
        for a, part, side, b, y in rows:
            if side == 1 and (a, b) not in found:
                found[a, b] = similar(first[a, part], np.frombuffer(y.as_buffer(), np.uint64), threshold)
        linked = [k for k, yes in found.items() if yes]
        return pa.table({"a": pa.array([k[0] for k in linked], pa.int64()), "b": pa.array([k[1] for k in linked], pa.int64())})

    return sets.groupBy(F.pmod(F.xxhash64("a", "part"), F.lit(groups)).alias("group")).applyInArrow(run, "a long, b long").distinct()


def _told(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members with their component and that of their bucket's leader, for buckets that hold several components."""
    of = lambda column, name: comps.select(F.col("node").alias(column), F.col("component").alias(name))
    told = members.join(of("cid", "comp"), "cid", "left").join(of("leader", "leader_comp"), "leader", "left")
    told = told.withColumn("comp", F.coalesce("comp", "cid")).withColumn("leader_comp", F.coalesce("leader_comp", "leader"))
    several = told.groupBy("bucket").agg(F.sum((F.col("comp") != F.col("leader_comp")).cast("long")).alias("minor")).where("minor > 0")
    return told.join(several, "bucket")


def _drawn(told: DataFrame, round_: int) -> DataFrame:
    """Pairs (a, b) of members outside the leader's component with one random member inside it, for each bucket."""
    inside = F.col("comp") == F.col("leader_comp")
    one = told.where(inside).groupBy("bucket").agg(F.min_by("cid", F.xxhash64("cid", "bucket", F.lit(round_))).alias("one"))
    pairs = told.where(~inside).select("bucket", "cid").join(one, "bucket")
    return pairs.select(F.least("cid", "one").alias("a"), F.greatest("cid", "one").alias("b")).distinct()


def _with_bits(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    return pairs.join(bits.select(F.col("cid").alias("a"), F.col("bits").alias("bits_a")), "a").join(bits.select(F.col("cid").alias("b"), F.col("bits").alias("bits_b")), "b").select("a", "b", "bits_a", "bits_b")


def _across(told: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates between components in mixed buckets, each from the first band that both have in common.

    One row (tile, a, b) for each pair of chunks of a bucket that has any; a and b are arrays, packed as bytes.
    """
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    minor_chunks = F.greatest(F.lit(1), F.ceil(F.col("minor") / CHUNK)).cast("int")
    known = told.join(classes.select("cid", "bits", "keys"), "cid")
    own = F.col("comp") != F.col("leader_comp")
    mine = known.where(own).withColumn("i", F.pmod(F.xxhash64("cid", F.lit(1)), minor_chunks).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), chunks - 1))).withColumn("side", F.lit(0))
    other = known.withColumn("j", F.pmod(F.xxhash64("cid", F.lit(2)), chunks).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), minor_chunks - 1))).withColumn("side", F.when(own, 1).otherwise(2))
    columns = ["bucket", "i", "j", "side", "cid", "comp", "bits", "keys"]

    def run(table: pa.Table) -> pa.Table:
        side, bucket = np.asarray(table.column("side")), table.column("bucket")[0].as_py()
        cid, comp = np.asarray(table.column("cid")), np.asarray(table.column("comp"))
        word = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(side), -1)
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64).reshape(len(side), -1)
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
        found = []
        for a in range(0, len(x), 64):
            s = x[a : a + 64]
            apart = (comp[s][:, None] != comp[y][None, :]) & ((side[y] == 2)[None, :] | (cid[s][:, None] < cid[y][None, :]))
            p, q = np.nonzero(apart)
            p, q = s[p], y[q]
            fit = estimate(word[p], word[q]) >= LEAST_ESTIMATE
            p, q = p[fit], q[fit]
            same = keys[p] == keys[q]
            first = keys[p, same.argmax(1)] == bucket if len(p) else np.zeros(0, bool)
            found.append((cid[p[first]], cid[q[first]]))
        u, v = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        some = [(f"{bucket} {table.column('i')[0].as_py()} {table.column('j')[0].as_py()}", u.tobytes(), v.tobytes())] if len(u) else []
        return pa.table({"tile": pa.array([r[0] for r in some], pa.string()), "a": pa.array([r[1] for r in some], pa.binary()), "b": pa.array([r[2] for r in some], pa.binary())})

    return mine.select(*columns).union(other.select(*columns)).groupBy("bucket", "i", "j").applyInArrow(run, "tile string, a binary, b binary")


def _confirmed_tiles(tiles: DataFrame, docs: DataFrame, classes: DataFrame, threshold: int, salt: int) -> DataFrame:
    """Links (a, b) among the tiles' candidates, as many as join what they join; each set travels once to each tile.

    Pairs that links found before in the tile already join are not looked at again: their link would change nothing.
    """

    def members(batches):
        for t in batches:
            for tile, a, b in zip(t.column("tile").to_pylist(), t.column("a").to_pylist(), t.column("b").to_pylist()):
                cid = np.unique(np.concatenate([np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)]))
                yield pa.RecordBatch.from_arrays([pa.array([tile] * len(cid), pa.string()), pa.array(cid)], names=["tile", "cid"])

    wanted = checkpointed(tiles.select("tile", "a", "b").mapInArrow(members, "tile string, cid long").join(classes.select("cid", "row"), "cid"))
    sets = _sets(docs, wanted, ["cid", "tile"], salt)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sets_ = {c: np.frombuffer(x.as_buffer(), np.uint64) for c, x in zip(left.column("cid").to_pylist(), left.column("set"))}
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                parent[x] = x = parent.get(y, y)
            return x

        links = []
        for a, b in zip(right.column("a").to_pylist(), right.column("b").to_pylist()):
            for u, v in zip(np.frombuffer(a, np.int64).tolist(), np.frombuffer(b, np.int64).tolist()):
                p, q = find(u), find(v)
                if p != q and similar(sets_[u], sets_[v], threshold):
                    parent[p] = q
                    links.append((u, v))
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return sets.groupBy("tile").cogroup(tiles.groupBy("tile")).applyInArrow(run, "a long, b long").distinct()


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after further links (a, b) between their nodes."""
    of = lambda column, name: comps.select(F.col("node").alias(column), F.col("component").alias(name))
    wider = links.join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v"))
    wider = checkpointed(components(checkpointed(wider.distinct())))
    old = comps.join(wider.select(F.col("node").alias("component"), F.col("component").alias("wider")), "component", "left").select("node", F.coalesce("wider", "component").alias("component"))
    return checkpointed(old.union(wider.join(comps.select("node"), "node", "left_anti").select("node", "component")))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, salt: int = 0) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Linked are documents with 100 * intersection >= threshold * union of their sets of five-word shingles (or of one
    sequence of fewer words); component_id is the least id reachable by links, kept whether that is the own id. A null or
    empty text has an empty set, links with nothing and is kept. Rows that repeat an id are judged each by its own text; a
    null id takes part in links but never is a component's id, and is kept only if its component has no other. Other
    columns are ignored; texts of any length count whole.

    A shingle is its 64-bit hash, and sets are one class if both of two 64-bit ids are the same. If sets of one id differ in
    the other, all is done again with ids of another ``salt``.
    """
    ship(docs.sparkSession)
    given, docs = docs, texts(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    signed = checkpointed(signed_documents(docs, salt))
    row = F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), F.col("row"))), F.min("row"))  # a row with an id, if there is any
    classes = signed.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), row.alias("row"), F.first("keys").alias("keys"), F.first("bits").alias("bits"), (F.min("check") != F.max("check")).alias("mixed"))
    classes = checkpointed(classes)
    if not classes.where("mixed").isEmpty():
        return near_duplicates(given, threshold, salt + 1)
    bands = _in_bands(classes)  # read twice, for the counts and for the members
    buckets = bands.groupBy("bucket").agg(F.min("cid").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = checkpointed(bands.join(buckets, "bucket"))
    bits = classes.select("cid", "bits")
    confirm = lambda pairs: checkpointed(_confirmed(checkpointed(_estimated(_with_bits(pairs, bits))), docs, classes, threshold, salt))
    links = confirm(members.where("cid <> leader").select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct())
    comps = checkpointed(components(links.toDF("u", "v")))
    outside = None
    for round_ in range(MOST_ROUNDS):
        told = checkpointed(_told(members, comps))
        before, outside = outside, told.where("comp <> leader_comp").select("cid").distinct().count()
        if not outside or (before is not None and outside > 0.8 * before):
            break
        links = confirm(_drawn(told, round_))
        if links.isEmpty():
            break
        comps = _joined(comps, links)
    else:
        told = checkpointed(_told(members, comps))
    if outside:
        final = _joined(comps, checkpointed(_confirmed_tiles(checkpointed(_across(told, classes)), docs, classes, threshold, salt)))
    else:
        final = comps
    linked = classes.select("cid", "doc_id").join(final.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = linked.join(least, "component").select("cid", "component_id")
    own = F.coalesce("component_id", "doc_id")
    return signed.select("doc_id", "n_shingles", "cid").join(named, "cid", "left").select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, own.isNull()).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose ids near_duplicates keeps; rows without an id stay."""
    dropped = near_duplicates(docs, threshold).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept and doc_id is not null").select(F.col("doc_id").alias("__dropped"))
    return docs.join(dropped, docs["doc_id"].cast("long") == F.col("__dropped"), "left_anti")
