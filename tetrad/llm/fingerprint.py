"""Document fingerprints by consistent weighted sampling (S. Ioffe, 2010).

A document is a multiset of word pairs. For every sample and term, gamma and uniform variates that depend on the term
alone give a sample point below the term's weight; the term of least exponential clock is the sample. Two documents
agree on a sample with the probability of their generalised Jaccard similarity, sum of minima over sum of maxima.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, block_count, ddl, forget, ship, split_batch, texts
from .words import hashed_words, mixed

SAMPLES = 64
#: Terms whose variates are drawn at one time, so that the arrays stay in a core's cache.
_LOT = 2048
#: Terms whose clocks are held at one time; a term takes 4 bytes for each sample.
MOST_TERMS = 1 << 17
#: Text bytes, and texts, whose terms are numbered together.
WINDOW_BYTES, WINDOW = 512 << 10, 256
#: Cuts of the ids at most: the driver gets as many numbers. Blocks are streamed, so more text makes them longer, not larger
#: in memory.
MOST_CUTS = 20_000

OUT = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}

_G = np.uint64(0x9E3779B97F4A7C15)


def terms(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes and counts from the word hashes of a text: pairs of neighbours, or its only word."""
    h = mixed(words[:-1] * np.uint64(3) + words[1:] * _G) if len(words) > 1 else words
    h = np.sort(h)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.diff(first, append=len(h))


def batch_terms(bodies: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Terms of each body."""
    words, sizes = hashed_words(bodies)
    return [terms(words[e - n : e]) for e, n in zip(np.cumsum(sizes).tolist(), sizes.tolist())]


def variates(terms: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exp(-r beta), exp(-s), a1) of each term (row) and sample (column), from four uniform variates of 16 bits in one hash.

    r is Gamma(2, 1) and split by the uniform beta into r beta and s = r (1 - beta), which are independent and exponential;
    c is Gamma(2, 1). The clock of weight 1 is a1 = c exp(-s), and that of a point exp(r (t - beta)) is a1 exp(-r t).
    """
    k = mixed(np.arange(1, samples + 1, dtype=np.uint64) * _G)
    u = mixed(terms[:, None] ^ k[None, :]).view("<u2").reshape(len(terms), samples, 4).astype(np.float32)
    u += np.float32(0.5)
    u *= np.float32(2**-16)
    a1 = np.log(u[..., 0] * u[..., 1])
    a1 *= -u[..., 2]
    return u[..., 3], u[..., 2], a1


def signatures(docs: list[tuple[np.ndarray, np.ndarray]], samples: int, most: int = MOST_TERMS) -> np.ndarray:
    """uint32 samples of each document (row); a document without terms gets zeros.

    docs: (terms, counts). The winner of a sample is a term and the quantised logarithm t of its point; both are told by
    the bits of its clock a1 exp(-r t), t = floor(ln weight / r + beta), which depends on nothing else. Documents are taken
    as many at a time as have ``most`` terms together, and longer ones in parts, whose least clocks are put together.
    """
    out = np.full((len(docs), samples), np.inf, np.float32)
    lot: list[tuple[int, np.ndarray, np.ndarray]] = []

    def done() -> None:
        for (i, *_), low in zip(lot, least_clocks([x[1:] for x in lot], samples)):
            out[i] = np.minimum(out[i], low)
        lot.clear()

    size = 0
    for i, (t, w) in enumerate(docs):
        for a in range(0, len(t), most):
            if lot and size + len(t[a : a + most]) > most:
                done()
                size = 0
            lot.append((i, t[a : a + most], w[a : a + most]))
            size += len(lot[-1][1])
    done()
    return np.where(np.isinf(out), np.float32(0), out).view(np.uint32)


def least_clocks(docs: list[tuple[np.ndarray, np.ndarray]], samples: int) -> np.ndarray:
    """The least clock of each document (row; with a term at least) in each sample (column)."""
    out = np.empty((len(docs), samples), np.float32)
    known, place = np.unique(np.concatenate([d[0] for d in docs] or [np.zeros(0, np.uint64)]), return_inverse=True)
    weight = np.concatenate([d[1] for d in docs] or [np.zeros(0, np.int64)])
    single = np.empty((len(known), samples), np.float32)
    for i in range(0, len(known), _LOT):
        single[i : i + _LOT] = variates(known[i : i + _LOT], samples)[2]
    pairs, which = np.unique(place[weight > 1] << 24 | np.minimum(weight[weight > 1], (1 << 24) - 1), return_inverse=True)
    several = np.empty((len(pairs), samples), np.float32)
    for i in range(0, len(pairs), _LOT):
        some = pairs[i : i + _LOT]
        v2, v1, a1 = variates(known[some >> 24], samples)
        part = -np.log(v2)
        r = part - np.log(v1)
        several[i : i + _LOT] = a1 * np.exp(-r * np.floor((np.log((some & 0xFFFFFF).astype(np.float32))[:, None] + part) / r))
    at = where = 0
    for i, (t, w) in enumerate(docs):
        if len(t):
            low = single[place[at : at + len(t)][w == 1]].min(0, initial=np.inf)
            if n := int((w > 1).sum()):
                low = np.minimum(low, several[which[where : where + n]].min(0))
            out[i] = low
            at, where = at + len(t), where + n
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples; documents without terms are alike each other and nothing else."""
    return float((a == b).mean())


def as_string(signature: np.ndarray) -> str:
    """The samples in hexadecimal."""
    return signature.astype(">u4").tobytes().hex()


def edit(text: str, after: str) -> str:
    """The text with its last quarter replaced by as much of the next text's start."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likeness to the edited and to the next document's text.

    The next document is the one after it by (doc_id, text), the first after the last; nulls stand first. A null text is
    empty; two texts without terms are alike. Equal texts have equal fingerprints wherever they stand. Repeated rows are rows
    of their own; one document alone is its own next. Other columns are ignored, texts are taken whole.

    Blocks of neighbouring ids are cut at quantiles of the ids, sorted, and streamed; each also gets the first row of the
    block after it. Rows of one id, or without one, are in one block. One shuffle of the texts; the driver gets the cut
    points, MOST_CUTS numbers at most.
    """
    spark = docs.sparkSession
    ship(spark)
    given = texts(docs)
    n = min(block_count(given, block_bytes), MOST_CUTS)
    edges = (given.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("q")).first()["q"] or []) if n > 1 else []
    edges = sorted(set(edges))

    def block_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(np.array(edges, np.int64), np.asarray(ids.fill_null(-(2**63))), side="left").astype(np.int32))

    def cut(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, block_of(b.column("doc_id"))], names=[*b.schema.names, "block"])

    # each block's first row by (doc_id, text), to the block before it; the first of all goes after the last of all
    least = F.when(F.count("*") > F.count("doc_id"), F.lit(None)).otherwise(F.min("doc_id"))
    firsts = {r["block"]: r["doc_id"] for r in given.select("doc_id").mapInArrow(cut, "doc_id long, block int").groupBy("block").agg(least.alias("doc_id")).collect()}
    order = sorted(firsts)
    before = {firsts[b]: a for a, b in zip([order[-1], *order] if order else [], order)}

    def doubled(batches):
        names = ["doc_id", "text", "block", "halo"]
        for b in batches:
            ids = b.column("doc_id")
            yield pa.RecordBatch.from_arrays([ids, b.column("text"), block_of(ids), pa.array(np.zeros(b.num_rows, bool))], names=names)
            at = [i for i, d in enumerate(ids.to_pylist()) if d in before]
            if at:
                some = b.take(pa.array(at))
                to = pa.array([before[d] for d in some.column("doc_id").to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text"), to, pa.array(np.ones(len(at), bool))], names=names)

    def compared(rows: list[tuple]) -> pa.RecordBatch:
        """The results of all rows (doc_id, text) but the last, which is the next one of the row before."""
        forget("fingerprints")
        bodies = [t for _, t in rows]
        edited = [edit(t, u) for t, u in zip(bodies, bodies[1:])]
        s = signatures(batch_terms(bodies + edited), samples)
        got = []
        for i, ((doc, t), e) in enumerate(zip(rows, edited)):
            x, y, z = s[i], s[len(bodies) + i], s[i + 1]
            got.append((doc, len(t), hashlib.sha256(e.encode()).hexdigest(), as_string(x), as_string(y), likeness(x, y), likeness(x, z)))
        return pa.RecordBatch.from_arrays([pa.array(v, t) for t, v in zip(OUT.values(), zip(*got))], names=list(OUT))

    def run(batches):
        rows = (r for whole in batches for b in split_batch(whole) for r in zip(*[b.column(c).to_pylist() for c in ("block", "halo", "doc_id", "text")]))
        for _, own in groupby(rows, key=lambda r: r[0]):
            window, size = [], 0
            for _, halo, doc, text in own:
                window.append((doc, text))
                size += len(text)
                if halo:  # the first row of the block after it
                    break
                if len(window) > 1 and (size > WINDOW_BYTES or len(window) > WINDOW):
                    yield compared(window)
                    window, size = window[-1:], len(text)
            if len(window) > 1:
                yield compared(window)

    sort = ["block", "halo", F.col("doc_id").asc_nulls_first(), "text"]
    blocked = given.mapInArrow(doubled, "doc_id long, text string, block int, halo boolean")
    return blocked.repartition("block").sortWithinPartitions(*sort).mapInArrow(run, ddl(OUT))
