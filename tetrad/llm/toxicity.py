"""Toxicity by a lexicon trie, Levenshtein automata and context windows.

The lexicon is learned from labelled documents: words that stand in toxic documents far more often than in others. Each
distinct word of a text runs as a Levenshtein automaton through the trie of the lexicon, so misspelled terms are found too.
A window around every hit tells quotation from abuse, and a logistic model over the weighted hits gives the score.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, checkpointed, ddl, held, record, ship, split_batch, texts
from .minhash import shingle_sets

#: The lexicon's size, and about how many labelled documents are learned from at most (by a hash of their id).
MOST_TERMS, MOST_LABELLED = 4_000, 40_000
#: Words in fewer labelled texts are not tested. Of the terms that pass, about so large a share passes by chance.
LEAST_TEXTS, FALSE_SHARE = 4, 0.05

# Characters that stand for letters in disguised spellings.
_DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
# Words that report speech, and words that address somebody.
_REPORTING = frozenset("said says wrote writes called calls quoted quotes quote term word phrase slur insult means sagte schrieb wort dit écrit mot dijo escribió palabra".split())
_ADDRESS = frozenset("you your you're youre u ur du dein euch sie tu vous toi votre tú usted vosotros eres".split())
_OPEN, _CLOSE = "\"'“«„‘‹(", "\"'”»“’›)"
_QUOTES = re.compile(r"[\"“”«»„‹›]")

OUT = {"doc_id": pa.int64(), "score": pa.float64(), "hits": pa.int64(), "quoted_hits": pa.int64()}


def bare(chunk: str) -> str:
    """A lower-case piece of text without the marks around it."""
    a, b = 0, len(chunk)
    while a < b and not chunk[a].isalnum():
        a += 1
    while b > a and not chunk[b - 1].isalnum():
        b -= 1
    return chunk[a:b]


def spellings(word: str) -> list[str]:
    """The word; with disguised letters told; without runs of a letter or marks between single letters."""
    out = [word]
    if not word.isalpha():
        plain = "".join(c for c in word.translate(_DISGUISE) if c.isalpha())
        if plain and plain != word:
            out.append(plain)
    short = re.sub(r"(.)\1{2,}", r"\1", out[-1])
    if short != out[-1]:
        out.append(short)
    return out


def edits_allowed(term: str) -> int:
    """Edits that a misspelling of a term may have: one from five letters on, none for shorter terms."""
    return int(len(term) >= 5)


def without_one(word: str) -> list[str]:
    """The word, and the word less each of its letters."""
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


class Trie:
    """The lexicon as a trie; ``find`` walks it with a Levenshtein automaton."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.root: dict = {}
        self.exact = {t: i for i, t in enumerate(terms)}
        # words one edit apart have a form less a letter, or their own, in common: other words need no walk
        self.near = {x for t in terms if edits_allowed(t) for x in without_one(t)}
        for i, t in enumerate(terms):
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = i

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term within its allowed edits; the first such term of the lexicon."""
        if (i := self.exact.get(word)) is not None:
            return i, 0
        if not 4 <= len(word) <= 41 or self.near.isdisjoint(without_one(word)):
            return None
        best: list = [2, -1]
        self._walk(self.root, word, list(range(len(word) + 1)), None, "", best)
        return (best[1], best[0]) if best[1] >= 0 else None

    def _walk(self, node: dict, word: str, row: list[int], before: list[int] | None, last: str, best: list) -> None:
        """One state of the automaton is a row of the edit table; transpositions count as one edit."""
        for c, child in node.items():
            if c == "":
                d = row[-1]
                if d <= edits_allowed(self.terms[child]) and (d, child) < (best[0], best[1] if best[1] >= 0 else 1 << 30):
                    best[0], best[1] = d, child
                continue
            new = [row[0] + 1]
            for j, w in enumerate(word, 1):
                x = min(new[-1] + 1, row[j] + 1, row[j - 1] + (w != c))
                if before is not None and j > 1 and w == last and word[j - 2] == c:
                    x = min(x, before[j - 2] + 1)
                new.append(x)
            if min(min(new), min(row)) <= 1:  # a transposition may lead back from the row before
                self._walk(child, word, new, row, c, best)


class Model:
    """A lexicon with weights by edits, and the logistic model over a document's features."""

    def __init__(self, terms: list[str], weights: list[float]):
        self.trie = Trie(terms)
        self.weights = weights
        self.misspelled = [0.6 * w for w in weights]
        self.coefficients = np.array([-6.0, 1.2, 0.4, 0.3, 0.5])

    def __getstate__(self):
        return self.trie.terms, self.weights, self.misspelled, self.coefficients

    def __setstate__(self, state):
        self.__init__(*state[:2])
        self.misspelled, self.coefficients = state[2:]

    def code(self, chunk: str) -> int:
        """0 without a hit, else 1 + 4 * term + edits, for a lower-case piece between white space."""
        for w in spellings(bare(chunk)):
            if w and (hit := self.trie.find(w)):
                return 1 + 4 * hit[0] + hit[1]
        return 0

    def codes(self, chunks: list[str]) -> list[int]:
        memory = held(("toxicity", self), lambda: Cache(lambda words: list(map(self.code, words)), size=lambda code: 0))
        return memory.lists([chunks])[0]

    def features(self, text: str) -> tuple[list[float], int, int]:
        """(features, hits, quoted hits). A hit counts less in quotation or report, more beside other hits or an address."""
        chunks = text.lower().split()
        codes = self.codes(chunks)
        if not any(codes):
            return [1.0, 0.0, 0.0, 0.0, 0.0], 0, 0
        at = [i for i, c in enumerate(codes) if c]
        best, total, exact, quoted = 0.0, 0.0, 0, 0
        for n, i in enumerate(at):
            term, edits = divmod(codes[i] - 1, 4)
            w = (self.misspelled if edits else self.weights)[term]
            window = chunks[max(0, i - 6) : i + 7]
            if in_quotation(chunks, i) or not _REPORTING.isdisjoint(map(bare, chunks[max(0, i - 4) : i])):
                w *= 0.35
                quoted += 1
            else:
                near = (n > 0 and i - at[n - 1] <= 6) + (n + 1 < len(at) and at[n + 1] - i <= 6)
                w *= 1 + 0.1 * near + 0.1 * (not _ADDRESS.isdisjoint(map(bare, window)))
                exact += edits == 0
            best, total = max(best, w), total + w
        return [1.0, best, math.log1p(total), math.log1p(exact), math.log1p(100 * total / len(chunks))], len(at), quoted

    def score(self, features: list[float]) -> float:
        z = float(np.dot(self.coefficients, features))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def in_quotation(chunks: list[str], i: int, reach: int = 12) -> bool:
    """Whether a quotation opens before place i and closes after it, both within reach."""
    own = chunks[i]
    opened = own[:1] in _OPEN
    for c in reversed(chunks[max(0, i - reach) : i]):
        if opened or _QUOTES.search(c[-1:]) or _QUOTES.search(c[-2:-1]):
            break
        opened = bool(_QUOTES.match(c))
    if not opened:
        return False
    if len(own) > 1 and (own[-1] in _CLOSE or own[-2:-1] in _CLOSE):
        return True
    for c in chunks[i + 1 : i + 1 + reach]:
        if _QUOTES.match(c):
            return False
        if _QUOTES.search(c[-3:]):
            return True
    return False


def labelled(docs: DataFrame, labels: DataFrame, target: str, held_out, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, text, label) of labelled rows outside the held-out fold, about ``most`` of them at most.

    The sample is a fraction of all, by a hash of the id, so that classes keep their shares. Its ids are broadcast, which
    ``most`` bounds, so that only its texts are shuffled. Of labels that disagree the greater stands, and of rows that
    repeat an id the least text: one row for an id.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, most / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).groupBy("doc_id").agg(F.max("label").alias("label"))
    return texts(docs).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def learn_lexicon(train: DataFrame, most_terms: int = MOST_TERMS) -> tuple[list[str], list[float]]:
    """Terms and weights (log odds of toxic documents) from (text, label) rows; copies of a text count once, and so do most
    near copies, whose words are no evidence of their own: texts with one least shingle.

    A term stands in twenty times as large a share of the toxic texts as of the others, and in so many that chance would not
    do: of all tested words, those with the greatest G-statistics are taken as long as about FALSE_SHARE of them may be
    there by chance (Y. Benjamini and Y. Hochberg, 1995), and ``most_terms`` at most. So neither the size of the sample nor
    a language's share of it sets a floor.
    """

    def words(batches):
        for b in batches:
            for part in split_batch(b):
                seen = [(w, y) for t, y in zip(part.column("text").to_pylist(), part.column("label").to_pylist()) for w in {bare(c) for c in t.lower().split()} if 3 <= len(w) <= 40 and w.isalpha()]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in seen], pa.string()), pa.array([x[1] for x in seen], pa.int32())], names=["word", "label"])

    def keys(batches):
        for b in batches:
            for part in split_batch(b):
                sets = shingle_sets(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([int(s[0]) if len(s) else 0 for s in sets], pa.uint64()).cast(pa.int64(), safe=False)], names=[*part.schema.names, "key"])

    once = train.select("text", "label").mapInArrow(keys, "text string, label int, key long").groupBy("key").agg(F.max("label").alias("label"), F.min("text").alias("text")).select("text", "label")
    sizes = {r["label"]: r["n"] for r in once.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1:
        return [], []
    counted = once.mapInArrow(words, "word string, label int").groupBy("word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    counted = checkpointed(counted.where(F.col("a") + F.col("b") >= LEAST_TEXTS))
    tested = counted.count()
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    n, share = F.col("a") + F.col("b"), n1 / (n1 + n0)
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    gain = 2 * (part(F.col("a"), n * share) + part(F.col("b"), n * (1 - share))) if n0 else 4.0 * F.col("a")
    rows = counted.where(odds > math.log(20)).select("word", odds.alias("odds"), gain.alias("gain")).orderBy(gain.desc(), "word").limit(most_terms).collect()
    rows = rows[: max((k for k, r in enumerate(rows, 1) if math.erfc(math.sqrt(r["gain"] / 2)) <= FALSE_SHARE * k / tested), default=0)]
    return [r["word"] for r in rows], [r["odds"] / math.log(20) for r in rows]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Newton steps for a ridge logistic regression."""
    beta = np.zeros(x.shape[1])
    pull = ridge * len(y) * np.diag([1e-3] + [1.0] * (x.shape[1] - 1)) / 10
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull + 1e-9 * np.eye(x.shape[1]), x.T @ (y - p) - pull @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def weigh(model: Model, train: DataFrame) -> None:
    """Weights of misspelled and exact hits of each term, from the labelled texts that have them."""
    shared = train.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_TERMS

    def run(batches):
        m = shared.value
        for b in batches:
            for part in split_batch(b):
                seen = [(c, y) for t, y in zip(part.column("text").to_pylist(), part.column("label").to_pylist()) for c in {0, *m.codes(t.lower().split())}]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in seen], pa.int64()), pa.array([x[1] for x in seen], pa.int32())], names=["code", "label"])

    rows = train.mapInArrow(run, "code long, label int").groupBy("code").agg(F.sum("label").alias("a"), F.count("*").alias("n")).collect()
    found = {r["code"]: (r["a"], r["n"] - r["a"]) for r in rows}
    n1, n0 = found.get(0, (0, 0))
    for i in range(len(model.weights)):
        for edits, weights in ((0, model.weights), (1, model.misspelled)):
            a, b = found.get(1 + 4 * i + edits, (0, 0))
            if a + b >= 5:
                weights[i] = min(3.0, max(0.0, (math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))) / math.log(20)))


def train_model(docs: DataFrame, labels: DataFrame, held_out=lambda doc_id: F.lit(False)) -> Model:
    """Learn lexicon and weights from labelled documents outside the held-out fold. Without any, nothing is toxic."""
    ship(docs.sparkSession)
    train = checkpointed(labelled(docs, labels, "toxic", held_out))  # bounded, and read three times
    model = Model(*learn_lexicon(train))
    weigh(model, train)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_TERMS

    def run(batches):
        m = shared.value
        for b in batches:
            for part in split_batch(b):
                rows = [m.features(t)[0] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), part.column("label")], names=["x", "label"])

    # bounded: rows are grouped by features, of which most documents have the same empty ones
    rows = train.mapInArrow(run, "x array<double>, label int").groupBy(F.transform("x", lambda v: F.round(v, 2)).alias("x"), "label").agg(F.count("*").alias("n")).collect()
    if rows and model.trie.terms:
        x = np.array([r["x"] for r in rows])
        n = np.array([r["n"] for r in rows])
        y = np.array([r["label"] for r in rows])
        x, y = np.repeat(x, n, axis=0), np.repeat(y, n)
        if len(set(y.tolist())) == 2:
            model.coefficients = fit_logistic(x, y)
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), hits and quoted_hits of every whole text, one row for each row of ``docs``.

    A null or empty text has no hits and the score of a text without hits. Repeated rows and null ids are rows of their own;
    other columns are never looked at. One pass without a shuffle; texts of any length are read to their end.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_TERMS

    def run(batches):
        m = shared.value
        for whole in batches:
            for b in split_batch(whole):
                got = [m.features(t) for t in b.column("text").to_pylist()]
                yield record(OUT, {"doc_id": b.column("doc_id"), "score": [m.score(x) for x, _, _ in got], "hits": [h for _, h, _ in got], "quoted_hits": [q for _, _, q in got]})

    return texts(docs).mapInArrow(run, ddl(OUT))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns; null texts stay."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_TERMS

    def run(batches):
        m = shared.value
        for whole in batches:
            for b in split_batch(whole):
                yield b.filter(pa.array([m.score(m.features(t or "")[0]) < threshold for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
