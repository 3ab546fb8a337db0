"""Packing by power-of-two decomposition.

Each document's token count is written as full sequences plus the binary digits of what remains; every digit gives one
piece of that length. Pieces of equal length form a bucket, and each piece is a sequence of its own there: none is padded
and none crosses documents.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import Cache, ddl, held, record, ship, split_batch, texts

#: Bytes of pieces between white space that a worker remembers.
MOST_BYTES = 112 << 20

OUT = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "bucket": pa.int32()}


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, others from U+0100 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    rest = iter(range(256, 512))
    return {chr(b if b in plain else next(rest)): b for b in range(256)}


class WordCoder:
    """Ids of a lower-casing vocabulary with word ends, exactly as ``tokenizers`` gives them, by distinct words.

    The merges run in ``tiktoken`` with a zero byte for the word's end: it takes, as the vocabulary's own merges do, the
    adjacent pair of least rank. Words with a zero byte of their own, texts with the control characters that Python but
    not Unicode counts as white space, and texts with the string of a special token, which is that token's id, go to
    ``tokenizers`` itself.
    """

    def __init__(self, vocabulary: bytes, most: int = MOST_BYTES):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(vocabulary.decode())
        told = json.loads(vocabulary)
        split = next(x["pattern"]["Regex"] for x in told["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.find = regex.compile(split).findall
        of, end = _byte_characters(), told["model"]["end_of_word_suffix"]
        ended = lambda t: (bytes(of[c] for c in t.removesuffix(end)) + b"\0" * t.endswith(end))
        ranks = dict.fromkeys([bytes([b]) for b in range(256)] + [bytes([b, 0]) for b in range(256)])
        ranks |= dict.fromkeys(ended(a) + ended(b) for a, b in (m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]))
        ranks = {t: r for r, t in enumerate(ranks)}
        special = {x["content"] for x in told["added_tokens"]}
        self.special = tuple(x.lower() for x in special)
        self.id_of = [b""] * len(ranks)
        for t, i in told["model"]["vocab"].items():
            if t not in special:
                self.id_of[ranks[ended(t)]] = i.to_bytes(4, "little")
        self.piece = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.chunks = Cache(lambda pieces: [b"".join(map(self._word, (p,) if p.isalpha() else self.find(p))) for p in pieces], most)

    def _word(self, word: str) -> bytes:
        if "\0" in word:
            return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self.id_of[i] for i in self.piece(word.encode() + b"\0")])

    def code(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian uint32."""
        lower = [t.lower() if "<" in t else "" for t in texts]
        odd = [not t.isprintable() and any(c in t for c in "\x1c\x1d\x1e\x1f") or any(x in u for x in self.special) for t, u in zip(texts, lower)]
        cut = [[] if o else (t if t.isascii() else unicodedata.normalize("NFC", t).replace("Σ", "σ")).lower().split() for t, o in zip(texts, odd)]
        return [np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if o else b"".join(ids) for t, o, ids in zip(texts, odd, self.chunks.lists(cut))]


def coder(vocabulary: bytes) -> WordCoder:
    return held(("packing", hashlib.sha256(vocabulary).digest()), lambda: WordCoder(vocabulary))


def decompose(n: int, most: int) -> list[int]:
    """Lengths of the pieces of n tokens: as many of ``most`` (a power of two) as fit, then powers of two, longest first."""
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if n % most >> k & 1]


def pack_documents(docs: DataFrame, vocabulary_path: str, most: int = 2048, end_id: int = 1, keep: bool = False) -> DataFrame:
    """Cut every document's ids, and ``end_id`` after them, to pieces of power-of-two lengths, each a sequence.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (0) and bucket (the length's logarithm, for
    writing buckets apart); with ``keep`` also ids (binary). A null or empty text is its end id alone; repeated rows and
    null doc_ids are packed as rows of their own; other columns are ignored; a text of any length is cut to its end.
    No shuffle. A sequence's id is its place in its partition with the partition's number in the high bits.
    """
    if most & (most - 1):
        raise ValueError("most must be a power of two")
    ship(docs.sparkSession)
    with open(vocabulary_path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())  # the file's size is fixed
    out = OUT | ({"ids": pa.binary()} if keep else {})
    end = end_id.to_bytes(4, "little")

    def run(batches):
        words, sequence = coder(vocabulary.value), TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in split_batch(whole):
                rows: dict[str, list] = {k: [] for k in out}
                for doc, ids in zip(batch.column("doc_id").to_pylist(), words.code(batch.column("text").to_pylist())):
                    ids += end
                    n, start = len(ids) // 4, 0
                    for length in decompose(n, most):
                        piece = ids[4 * start : 4 * (start + length)]
                        for k, v in zip(out, (doc, start, length, zlib.crc32(piece), n, sequence, 0, length.bit_length() - 1, piece)):
                            rows[k].append(v)
                        start += length
                        sequence += 1
                yield record(out, rows)

    return texts(docs).mapInArrow(run, ddl(out))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write pieces (pack_documents with ``keep``) with a folder for each bucket of equal lengths."""
    packed.write.partitionBy("bucket").parquet(path)
