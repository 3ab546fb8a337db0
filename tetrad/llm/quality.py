"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each class has its mean and its covariance, shrunk towards the pooled covariance and that towards its diagonal. A document's
log-density under a class is a Mahalanobis distance through the cached Cholesky factor; the score is the logistic of the
difference. The statistics are transformed (logarithms, square roots of shares) so that they come near to normal.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, record, ship, split_batch, texts
from .toxicity import labelled

#: About how many labelled documents are learned from at most, by a hash of their id.
MOST_LABELLED = 40_000
NAMES = (
    "log_chars", "log_words", "word_length", "upper", "digits", "spaces", "symbols", "marks", "pipes", "shouts", "line_length", "dup_lines",
    "distinct_words", "top_word", "marked_words", "compression", "letters_per_word",
)

OUT = {"doc_id": pa.int64(), "score": pa.float64()}

_UPPER, _DIGIT, _SPACE = bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\r\x0b\x0c"
_SYMBOL, _MARK = b"#*$%&<>=+~^_\\{}[]@/", b".,;:?!-'\"()"


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text, all finite; an empty text has those of no characters."""
    raw = text.encode()
    n = max(1, len(raw))
    share = lambda some: (len(raw) - len(raw.translate(None, some))) / n
    words = raw.split()
    w = max(1, len(words))
    kinds = set(words)
    lines = text.split("\n")
    full = [x for x in lines if x and not x.isspace()]
    dup = (len(full) - len(set(full))) / max(1, len(full))
    marked = sum(1 for x in words if x[-1] in b"#*$%&!|@~^") / w
    letters = len(raw.translate(None, _UPPER + _DIGIT + _SPACE + _SYMBOL + _MARK + b"|"))
    root = math.sqrt
    return [
        math.log1p(len(raw)), math.log1p(len(words)), math.log1p(sum(map(len, words)) / w), root(share(_UPPER)), root(share(_DIGIT)), root(share(_SPACE)), root(share(_SYMBOL)), root(share(_MARK)),
        root(raw.count(b"|") / n), root(raw.count(b"!") / n), math.log1p(n / max(1, len(full))), root(dup), root(len(kinds) / w), root(max(map(len, kinds), default=0) / n), root(marked),
        math.log(max(1e-3, len(zlib.compress(raw, 1)) / n)), math.log1p(letters / w),
    ]


class Discriminant:
    """Two classes' means, Cholesky factors of their shrunk covariances and log priors; scores rows of statistics."""

    def __init__(self, moments: dict[int, tuple[int, np.ndarray, np.ndarray]], pooled: float = 0.2, diagonal: float = 0.1):
        """moments: of each class the count, the sum of statistics and the sum of their outer products."""
        self.mean, self.factor, self.log_det = {}, {}, {}
        self.scale, self.shift = 1.0, 0.0
        size = len(NAMES)
        total = sum(m[0] for m in moments.values())
        within = sum((m[2] - np.outer(m[1], m[1]) / m[0] for m in moments.values() if m[0]), np.zeros((size, size))) / max(1, total)
        for k, (n, s, o) in moments.items():
            if n:
                mean = s / n
                own = o / n - np.outer(mean, mean)
                cov = (1 - pooled) * own + pooled * within
                cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + 1e-4 * np.eye(size)
                self.mean[k] = mean
                self.factor[k] = np.linalg.inv(np.linalg.cholesky(cov))  # cached: a distance is one product
                self.log_det[k] = -2 * np.log(np.diag(self.factor[k])).sum()

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density under class 1 less that under class 0."""
        if len(self.mean) < 2:
            return np.full(len(x), 40.0 if 1 in self.mean else -40.0 if self.mean else 0.0)
        d = {k: -0.5 * (np.square((x - self.mean[k]) @ self.factor[k].T).sum(1) + self.log_det[k]) for k in self.mean}
        return d[1] - d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.difference(x) + self.shift, -35, 35)))


def calibrate(model: Discriminant, x: np.ndarray, y: np.ndarray, threshold: float = 0.3) -> None:
    """Set the score's scale to the spread of the differences, and its shift so that the threshold parts the classes best.

    The cut maximises the mean of both classes' rates of right answers on the given labelled rows.
    """
    d = model.difference(x)
    order = np.argsort(d)
    d, y = d[order], y[order]
    if len(set(y.tolist())) < 2:
        return
    wrong_low = np.cumsum(y == 1) / (y == 1).sum()
    right_low = np.cumsum(y == 0) / (y == 0).sum()
    best = int(np.argmax(right_low - wrong_low))
    cut = (d[best] + d[min(best + 1, len(d) - 1)]) / 2
    model.scale = 1 / max(1.0, float(np.median(np.abs(d - cut))) / 4)
    model.shift = math.log(threshold / (1 - threshold)) - model.scale * cut


def train_model(docs: DataFrame, labels: DataFrame, held_out=lambda doc_id: F.lit(False), most: int = MOST_LABELLED) -> Discriminant:
    """Fit on labelled documents outside the held-out fold. The driver gets 18 numbers for each of a bounded sample."""
    ship(docs.sparkSession)
    train = labelled(docs, labels, "quality", held_out, most)

    def run(batches):
        for whole in batches:
            for b in split_batch(whole):
                yield pa.RecordBatch.from_arrays([pa.array([np.array(statistics(t), np.float32).tobytes() for t in b.column("text").to_pylist()], pa.binary()), b.column("label")], names=["x", "label"])

    rows = train.mapInArrow(run, "x binary, label int").collect()
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(len(rows), len(NAMES)).astype(float)
    y = np.array([r["label"] for r in rows], int)
    moments = {k: (int((y == k).sum()), x[y == k].sum(0), x[y == k].T @ x[y == k]) for k in (0, 1)}
    model = Discriminant(moments)
    if len(rows):
        calibrate(model, x, y)
    return model


def score_documents(docs: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text, one row for each row of ``docs``.

    A null or empty text is scored by the statistics of no characters; repeated rows and null ids are rows of their own;
    other columns are never looked at. Without labels of both classes every score is that of the class there is, or 0.5.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two small matrices

    def run(batches):
        for whole in batches:
            for b in split_batch(whole):
                x = np.array([statistics(t) for t in b.column("text").to_pylist()]).reshape(-1, len(NAMES))
                yield record(OUT, {"doc_id": b.column("doc_id"), "score": shared.value.score(x)})

    return texts(docs).mapInArrow(run, ddl(OUT))
