"""Byte-level BPE encoding and decoding by relational contraction.

Every partition hands its distinct pre-tokens to an in-process DuckDB. There a recursive query holds one row for each
token position, joins neighbouring rows to the merge table, contracts in each word the leftmost pair of least rank and
repeats until no pair joins. A document is then the concatenation of its words' ids, since merges never cross pre-tokens.
Decoding joins the ids of each document to the tokens' bytes and concatenates them by an ordered aggregation.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Cache, ddl, held, record, ship, split_batch, texts

#: Bytes of pre-tokens, and of pieces between spaces, that a worker remembers before it starts afresh.
MOST_BYTES = 128 << 20
#: Words in one recursive query, and ids in one decoding query.
BULK, IDS = 40_000, 1 << 20
#: Bytes from which a word is contracted with a heap: the recursion keeps all steps, so its rows grow with the square.
LONG = 2000

OUT = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

#: A space between white space, or before the end: only there do pieces cut at spaces differ from the whole text's.
_KNOTTY = re.compile(r"\s (?:\s|\Z)")

# One row of s is a token at a position of a word: k is word * 4096 + position. A word with a pair that joins is contracted
# at the leftmost pair of least rank; rows of other words are final. A merged token's id is its rank.
_CONTRACT = """
WITH RECURSIVE s(step, k, id) AS (
    SELECT 0, k, id FROM start
  UNION ALL
    (WITH pair AS (
        SELECT a.k, m.rank FROM s a JOIN s b ON b.k = a.k + 1 JOIN merges m ON m.pair = a.id * 65536 + b.id),
     least AS (SELECT k // 4096 AS w, min(rank * 4096 + k % 4096) AS x FROM pair GROUP BY 1),
     hit AS (SELECT w, w * 4096 + x % 4096 AS q, x // 4096 AS rank FROM least)
    SELECT s.step + 1, CASE WHEN s.k > q THEN s.k - 1 ELSE s.k END, CASE WHEN s.k = q THEN rank ELSE s.id END
    FROM s JOIN hit ON s.k // 4096 = hit.w WHERE s.k <> q + 1)
)
SELECT s.k, s.id FROM s SEMI JOIN (SELECT k // 4096 AS w, max(step) AS step FROM s GROUP BY 1) last ON s.k // 4096 = last.w AND s.step = last.step
"""
# A token's bytes stand as the characters of the same numbers, since only text is concatenated.
_DECODE = "SELECT doc, string_agg(bytes, '' ORDER BY k) FROM coded JOIN token USING (id) GROUP BY doc"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


class Coder:
    """Encodes and decodes words with a rank table in DuckDB; one for each Python worker."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB"})
        rows = [(ranks[t[:i]] * 65536 + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self._put("merges", {"pair": [x[0] for x in rows], "rank": [x[1] for x in rows]})
        self._put("token", {"id": list(ranks.values())}, bytes=pa.array([t.decode("latin-1") for t in ranks], pa.string()))

    def _put(self, name: str, columns: dict, **more: pa.Array) -> None:
        self.db.register("given", pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()} | more))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def words(self, words: list[str]) -> list[bytes]:
        """Ids, as little-endian uint32, of each word. A word that is a token is that token, as in the library."""
        raw = [w.encode() for w in words]
        out: list = [None if (r := self.ranks.get(w)) is None else r.to_bytes(4, "little") for w in raw]
        rest = sorted((i for i, x in enumerate(out) if x is None), key=lambda i: len(raw[i]))  # words of like length end in like many steps
        while rest and len(raw[rest[-1]]) > LONG:
            i = rest.pop()
            out[i] = self._long(raw[i])
        a = 0
        while a < len(rest):  # very long words go in smaller lots
            b, size = a, 0
            while b < len(rest) and b - a < BULK and (b == a or size + len(raw[rest[b]]) ** 2 < 8_000_000):
                size += len(raw[rest[b]]) ** 2
                b += 1
            for i, got in zip(rest[a:b], self._bulk([raw[i] for i in rest[a:b]])):
                out[i] = got
            a = b
        return out

    def _bulk(self, words: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.arange(len(words)) * 4096 - (np.cumsum(sizes) - sizes)
        flat = np.frombuffer(b"".join(words), np.uint8)
        self._put("start", {"k": np.arange(len(flat)) + np.repeat(first, sizes), "id": self.single[flat]})
        got = self.db.execute(f"SELECT k, id FROM ({_CONTRACT}) ORDER BY k").fetchnumpy()
        ids = np.asarray(got["id"]).astype("<u4").tobytes()
        cut = np.searchsorted(np.asarray(got["k"]), np.arange(len(words) + 1) * 4096) * 4
        return [ids[cut[i] : cut[i + 1]] for i in range(len(words))]

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """The bytes of each sequence of ids. A lot of ids may end within a sequence, which then is put together of parts."""
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        ids, doc = np.frombuffer(b"".join(coded), "<u4").astype(np.int64), np.repeat(np.arange(len(coded)), sizes)
        out = [b""] * len(coded)
        for a in range(0, len(ids), IDS):
            some = slice(a, a + IDS)
            self._put("coded", {"doc": doc[some], "k": np.arange(len(ids[some])), "id": ids[some]})
            for i, text in self.db.execute(_DECODE).fetchall():
                out[i] += text.encode("latin-1")
        return out

    def _long(self, word: bytes) -> bytes:
        """One very long word: the same contraction, leftmost pair of least rank first, with a heap."""
        import heapq

        ranks, ids = self.ranks, [self.ranks[bytes([b])] for b in word]
        part = [bytes([b]) for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(len(ids) - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if part[i] != x or j >= len(part) or part[j] != y or part[i] is None:
                continue
            part[i], part[j] = x + y, None
            ids[i] = r
            after[i] = after[j]
            if after[j] < len(part):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (n := after[k]) < len(part) and (q := ranks.get(part[k] + part[n])) is not None:
                    heapq.heappush(heap, (q, k, part[k], part[n]))
        keep = [i for i, x in enumerate(part) if x is not None]
        return np.array([ids[i] for i in keep], "<u4").tobytes()


class Pieces:
    """A worker's memory: ids of words and of what stands between spaces, with the space before it.

    spaced: whether the pattern ends a piece before any space that stands neither between white space nor at the end, so
    that a text can be cut there and its parts remembered.
    """

    def __init__(self, coder: Coder, find, spaced: bool, most: int = MOST_BYTES):
        self.coder, self.find, self.spaced = coder, find, spaced
        self.words, self.parts = Cache(coder.words, most), Cache(self._parts, most)

    def _parts(self, parts: list[str]) -> list[bytes]:
        out = []
        for a in range(0, len(parts), 50_000):
            cut = [self.find(" " + p) for p in parts[a : a + 50_000]]
            self.words.want(w for c in cut for w in c)
            out += [b"".join([self.words[w] for w in c]) for c in cut]
        return out

    def code(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian uint32."""
        cut = [t.split(" ") if self.spaced and not _KNOTTY.search(t) else [t] for t in texts]
        first = [self.find(c[0]) for c in cut]
        return [b"".join(f) + b"".join(c) for f, c in zip(self.words.lists(first), self.parts.lists([c[1:] for c in cut]))]


def _pieces(vocabulary: bytes, pattern: str, spaced: bool) -> Pieces:
    """The worker's memory for a vocabulary."""

    def make() -> Pieces:
        import regex

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, vocabulary.split(b"\n")))}
        return Pieces(Coder(ranks), regex.compile(pattern).findall, spaced)

    return held(("bpe", hashlib.sha256(vocabulary).digest(), pattern, spaced), make)


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, keep: bool = False, spaced: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of ``docs``; with ``keep`` also ids (binary,
    little-endian uint32) and decoded (binary). A null text is empty: no tokens, hashes of nothing. Rows with equal ids
    or texts each give a row; a null doc_id stays null; other columns are ignored. A word of any length is encoded whole.
    ``spaced`` may be set for patterns that begin a piece at every single space (see Pieces), and saves time.
    No shuffle: one pass over the input's partitions, with MOST_BYTES of remembered words in a worker.
    """
    ship(docs.sparkSession)
    with open(vocabulary_path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())  # the file's size is fixed
    out = OUT | ({"ids": pa.binary(), "decoded": pa.binary()} if keep else {})

    def run(batches):
        pieces = _pieces(vocabulary.value, pattern, spaced)
        for whole in batches:
            for batch in split_batch(whole):
                rows: dict = {k: [] for k in out}
                rows["doc_id"] = batch.column("doc_id")
                coded = pieces.code(batch.column("text").to_pylist())
                for ids, decoded in zip(coded, pieces.coder.decode(coded)):
                    rows["n_tokens"].append(len(ids) // 4)
                    rows["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                    if keep:
                        rows["ids"].append(ids)
                        rows["decoded"].append(decoded)
                yield record(out, rows)

    return texts(docs).mapInArrow(run, ddl(out))
