"""Quality rules, and tokeniser fertility with rejection bands by script.

A public vocabulary with byte fallback is run over the distinct words. Characters per token, the share of tokens that are
fallback bytes, and the entropy of the token distribution must lie in the band of the text's main script.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import MOST_BYTES, Numbers, ddl, held, record, ship, split_batch, texts
from .words import mixed

SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARABIC", "HEBREW", "DEVANAGARI", "HAN", "OTHER", "NONE")

#: Numbers of tokens, 32 to 4096, at which a band states the least entropy; between them it is interpolated.
LENGTHS = 2.0 ** np.arange(5, 13)


def _flat(bits: float) -> tuple[float, ...]:
    """The same least entropy at all lengths, or half of what the length allows if that is less."""
    return tuple(min(bits, 0.5 * k) for k in range(5, 13))


#: (least, most) characters per token; most share of byte tokens; least entropy of tokens in bits, by LENGTHS. A script's
#: vocabulary is small where the tokeniser saw little of it, so bands differ: what is one token in Latin is several, or
#: bytes, elsewhere. The entropy of running text grows with its length up to that of the language; texts that are laden
#: with symbols, separators or repeats stay half a bit below. The Latin floor lies 0.15 bits or more under all 3,302
#: documents that the labels of the synthetic tables call good; in other scripts, of which there are no labels, it is flat.
BANDS = {
    "LATIN": ((1.2, 6.5), 0.10, (4.2, 4.8, 5.3, 5.7, 5.95, 6.2, 6.35, 6.45)),
    "CYRILLIC": ((1.0, 6.0), 0.15, _flat(3.5)),
    "GREEK": ((0.7, 4.0), 0.50, _flat(3.0)),
    "ARABIC": ((0.7, 4.0), 0.50, _flat(3.0)),
    "HEBREW": ((0.6, 4.0), 0.60, _flat(3.0)),
    "DEVANAGARI": ((0.4, 3.0), 0.80, _flat(2.5)),
    "HAN": ((0.3, 2.0), 0.90, _flat(2.5)),
    "OTHER": ((0.25, 6.0), 1.00, _flat(2.0)),
    "NONE": ((0.25, 6.0), 0.50, _flat(2.0)),
}


def least_entropy(floors: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
    """The least entropy of texts by their numbers of tokens. floors: one row of a band for each text. Under the first
    length a floor falls with the logarithm of the tokens, beyond the last it stays."""
    k = np.log2(np.maximum(n_tokens, 1)) - np.log2(LENGTHS[0])
    at = np.clip(k, 0, len(LENGTHS) - 1)
    low = np.minimum(at.astype(int), len(LENGTHS) - 2)
    row = np.arange(len(floors))
    floor = floors[row, low] + (at - low) * (floors[row, low + 1] - floors[row, low])
    return np.where(k < 0, floors[:, 0] * (1 + k / np.log2(LENGTHS[0])), floor)


_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"

OUT = {
    "doc_id": pa.int64(), "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(), "script": pa.string(), "chars_per_token": pa.float64(), "byte_share": pa.float64(), "token_entropy": pa.float64(),
}


def _script(word: str) -> int:
    """The script of a word's first letter, as a place in SCRIPTS."""
    for c in word:
        if c.isalpha():
            if c < "ɐ":
                return 0
            name = unicodedata.name(c, "").split(" ")[0]
            name = {"CJK": "HAN", "HIRAGANA": "HAN", "KATAKANA": "HAN", "HANGUL": "OTHER"}.get(name, name)
            return SCRIPTS.index(name) if name in SCRIPTS else SCRIPTS.index("OTHER")
    return SCRIPTS.index("NONE")


class Vocabulary:
    """Token ids, byte tokens and script of each distinct word; a word's number stands for it in arrays."""

    def __init__(self, model: bytes, most: int = MOST_BYTES):
        import sentencepiece

        self.most = most
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.fallback = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.tokens = np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)
        self.script = np.zeros(0, np.int8)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of words, all of which tokens, first and script then know."""
        if self.number.bytes + 4 * len(self.tokens) > self.most:
            self.forget()
        at = self.number.of(words)
        if new := self.number.taken():
            said = [w.decode() for w in new]
            ids = self.model.encode(said, num_threads=1)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.tokens = np.concatenate([self.tokens, np.fromiter((i for x in ids for i in x), np.int32, sizes.sum())])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            self.script = np.concatenate([self.script, np.fromiter(map(_script, said), np.int8, len(said))])
        return at


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def repeat_words(words: np.ndarray, of: np.ndarray, n: int, docs: int) -> np.ndarray:
    """Words of each document in windows of n words that it has twice or more. words: numbers; of: their documents."""
    total = len(words)
    if total < n:
        return np.zeros(docs, np.int64)
    h = mixed(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    m = total - n + 1
    w = np.zeros(m, np.uint64)
    for j in range(n):
        w = w * np.uint64(0x9E3779B97F4A7C15 | 1) + h[j : j + m]
    inside = np.flatnonzero(of[:m] == of[n - 1 :])
    w = mixed(w[inside] ^ mixed(of[inside].astype(np.uint64)))
    order = np.argsort(w)
    same = w[order][1:] == w[order][:-1]
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(total + 1, np.int64)
    at = inside[twice]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.bincount(of[np.cumsum(edge[:-1]) > 0], minlength=docs)


def measure(texts_: list[str], vocabulary: Vocabulary, bands: dict) -> dict[str, list]:
    """The output columns but doc_id for a batch of texts."""
    raw = [t.encode() for t in texts_]
    words = [b.split() for b in raw]  # bytes split at exactly the six ASCII spaces
    docs = len(raw)
    n_words = np.fromiter(map(len, words), np.int64, docs)
    spaces = np.array([len(b) - len(b.translate(None, _SPACES)) for b in raw], np.int64)
    word_chars = np.fromiter(map(len, texts_), np.int64, docs) - spaces
    symbols = [len(b) - len(b.translate(None, _SYMBOLS)) for b in raw]
    number = vocabulary.numbers([w for ws in words for w in ws])
    of = np.repeat(np.arange(docs), n_words)
    repeated = repeat_words(number, of, 8, docs)
    failed = (n_words < 20) | (100 * repeated > 30 * n_words)

    sizes = np.diff(vocabulary.first)[number]
    n_tokens = np.bincount(of, sizes, docs)
    at = np.repeat(vocabulary.first[number] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    token, whose = vocabulary.tokens[at], np.repeat(of, sizes)
    share = np.bincount(whose, vocabulary.fallback[token], docs) / np.maximum(n_tokens, 1)
    pair, count = np.unique(whose * len(vocabulary.fallback) + token, return_counts=True)
    p = count / n_tokens[pair // len(vocabulary.fallback)]
    entropy = np.bincount(pair // len(vocabulary.fallback), -p * np.log2(p), docs)
    per_token = word_chars / np.maximum(n_tokens, 1)
    by_script = np.bincount(of * len(SCRIPTS) + vocabulary.script[number], minlength=docs * len(SCRIPTS)).reshape(docs, -1)
    by_script[:, -1] = by_script[:, :-1].sum(1) == 0
    script = by_script.argmax(1)
    low, high, most, floors = (np.array([f(bands[s]) for s in SCRIPTS])[script] for f in (lambda b: b[0][0], lambda b: b[0][1], lambda b: b[1], lambda b: b[2]))
    kept = ~failed & (per_token >= low) & (per_token <= high) & (share <= most) & (entropy >= least_entropy(floors, n_tokens))
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": [dup_lines(t) for t in texts_], "n_repeat_words": repeated, "base_failed": failed,
        "kept": kept, "script": [SCRIPTS[s] for s in script], "chars_per_token": per_token, "byte_share": share, "token_entropy": entropy,
    }


def known(model: bytes) -> Vocabulary:
    return held(("fertility", hashlib.sha256(model).digest()), lambda: Vocabulary(model))


def rule_measures(docs: DataFrame, vocabulary_path: str, bands: dict | None = None) -> DataFrame:
    """Rule counts, fertility and verdict for every whole text, one row for each row of ``docs``.

    A null or empty text has no words and fails; repeated rows and null doc_ids are measured as rows of their own; other
    columns are ignored; texts of any length are measured to their end. One pass without a shuffle.
    """
    ship(docs.sparkSession)
    with open(vocabulary_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # the file's size is fixed
    bands = BANDS | (bands or {})

    def run(batches):
        vocabulary = known(model.value)
        for whole in batches:
            for batch in split_batch(whole):
                yield record(OUT, measure(batch.column("text").to_pylist(), vocabulary, bands) | {"doc_id": batch.column("doc_id")})

    return texts(docs).mapInArrow(run, ddl(OUT))


def keep_documents(docs: DataFrame, vocabulary_path: str, bands: dict | None = None) -> DataFrame:
    """The rows of ``docs`` that rule_measures keeps, with all their columns."""
    ship(docs.sparkSession)
    with open(vocabulary_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    bands = BANDS | (bands or {})

    def run(batches):
        vocabulary = known(model.value)
        for whole in batches:
            for batch in split_batch(whole):
                found = measure([t or "" for t in batch.column("text").to_pylist()], vocabulary, bands)
                yield batch.filter(pa.array(found["kept"]))

    return docs.mapInArrow(run, docs.schema)
