"""Quality scores by Bradley-Terry pairwise ranking.

A document's latent worth is a linear function of text features. Preference pairs (a document marked 1 against one marked 0)
give the logistic loss of their feature differences, minimised by Newton steps with an L2 term. The worth becomes a score
from 0 to 1 by a logistic link whose origin is a quantile of the labelled sample: the quantile that parts the two marks best
gets the score `threshold`, so a document is kept when its worth lies above that quantile.

The fit reads a bounded sample of labelled rows (`sample`, 20,000 by default, the smallest hashes of doc_id); features of all
documents are computed where they lie, without a shuffle, and only the weights travel.

Edge cases: a null text is an empty one; an empty text has all features 0 and still gets a score; labels with a null mark, with two marks
that differ for one id, or without a document are skipped; without both marks among the labels every score is 1; a doc_id that repeats is scored each
time; documents' other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passwatch.llm.common import SPACE, joined_bytes, map_arrow, prefix_hash, range_hash, words_of

SAMPLE = 20_000
PAIRS = 200_000
THRESHOLD = 0.3
LAGS = (1, 2, 3, 4)
#: Byte classes whose shares are features.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "bar": b"|/\\<>[]{}=_~^",
    "symbol": b"#%&*$@+",
    "shout": b"!?",
    "stop": b".,;:",
    "line": b"\n",
    "blank": b" \t",
}
NAMES = (*CLASSES, "other", "word_length", "log_words", "short_words", *(f"lag{k}" for k in LAGS), "spread", "longest", "plain_words")
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _i, _bytes in enumerate(CLASSES.values()):
    _CLASS[list(_bytes)] = _i
_LETTER = np.zeros(256, bool)
_LETTER[list(CLASSES["upper"] + CLASSES["lower"])] = True
_LETTER[128:] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text of a joined byte array."""
    n, k = len(offsets) - 1, len(CLASSES) + 1
    out = np.zeros((n, len(NAMES)))
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n, dtype=np.int32), size)
    shares = np.bincount(doc * np.int32(k) + _CLASS[data], minlength=n * k).reshape(n, k)
    out[:, :k] = shares / np.maximum(size, 1)[:, None]
    start, end, owner = words_of(data, offsets, ~SPACE)
    words = np.bincount(owner, minlength=n)
    most = np.maximum(words, 1)
    length = end - start
    code = range_hash(prefix_hash(data), start, end)
    col = k
    out[:, col] = np.bincount(owner, length, n) / most / 10
    out[:, col + 1] = np.log1p(words) / 10
    out[:, col + 2] = np.bincount(owner, length <= 3, n) / most
    for i, lag in enumerate(LAGS):
        same = (code[lag:] == code[:-lag]) & (owner[lag:] == owner[:-lag])
        out[:, col + 3 + i] = np.bincount(owner[lag:][same], minlength=n) / most
    seen = np.unique((code >> np.uint64(44)).astype(np.int64) + (owner.astype(np.int64) << 20)) >> 20
    out[:, col + 3 + len(LAGS)] = np.bincount(seen, minlength=n) / most
    top = np.zeros(n)
    np.maximum.at(top, owner, length)
    out[:, col + 4 + len(LAGS)] = np.log1p(top) / 10
    if len(data):
        good = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
        letters = good[end] - good[start]
        out[:, col + 5 + len(LAGS)] = np.bincount(owner, letters >= length - 1, n) / most
    return out


@dataclass(frozen=True)
class Ranker:
    """weights and bias on the features and their squares; flat: no preference was learned."""

    weights: np.ndarray
    bias: float
    flat: bool = False

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.ones(len(x))
        return 1 / (1 + np.exp(-np.clip(widened(x) @ self.weights + self.bias, -30, 30)))


def widened(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, x * x])


def fit(x: np.ndarray, mark: np.ndarray, pairs: int = PAIRS, threshold: float = THRESHOLD, l2: float = 1e-3) -> Ranker:
    """Bradley-Terry weights from features and 0/1 marks."""
    order = np.lexsort([*x.T, mark])  # the same pairs whatever the order of the rows
    x, mark = x[order], mark[order]
    good, bad = np.flatnonzero(mark == 1), np.flatnonzero(mark == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(2 * x.shape[1]), 0.0, flat=True)
    draw = np.random.default_rng(7)
    n = min(pairs, len(good) * len(bad))
    wide = widened(x)
    scale = np.maximum(wide.std(axis=0), 1e-6)
    diff = (wide[draw.choice(good, n)] - wide[draw.choice(bad, n)]) / scale
    w = np.zeros(diff.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        gradient = diff.T @ (p - 1) / n + l2 * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / n + l2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    w /= scale
    worth = wide @ w
    by = np.argsort(worth)
    # right marks if the lowest i are rejected
    right = np.concatenate([[0], np.cumsum(mark[by] == 0)]) + np.concatenate([np.cumsum((mark[by] == 1)[::-1])[::-1], [0]])
    best = np.flatnonzero(right == right.max())
    quantile = best[len(best) // 2] / len(by)
    cut = np.quantile(worth, quantile)
    spread = max(np.std(worth), 1e-9)
    return Ranker(w / spread * 3, float(np.log(threshold / (1 - threshold)) - cut / spread * 3))


def sample_features(docs: DataFrame, labels: DataFrame, sample: int, key: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and marks of at most `sample` labelled ids, a row for each; of an id with several texts that with the least hash is taken."""
    marks = labels.where("quality in (0, 1)").groupBy(key).agg(F.min("quality").alias("__mark"), F.max("quality").alias("__most"))
    chosen = marks.where("__mark = __most").drop("__most").orderBy(F.xxhash64(key), key).limit(sample)
    picked = docs.select(key, F.col(text).alias("__text")).join(F.broadcast(chosen), key).groupBy(key, "__mark").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(*joined_bytes(batch.column(0)))
        return pa.record_batch([batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["mark", "x"])

    rows = map_arrow(picked.select("__text", F.col("__mark").cast("int").alias("mark")), kernel, "mark int, x array<double>", "__text").toPandas()
    return np.array(rows.x.tolist()).reshape(len(rows), len(NAMES)), rows.mark.to_numpy()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Ranker:
    """Fit on at most `sample` labelled documents; `labels` has key and quality."""
    return fit(*sample_features(docs, labels, sample, key, text))


def score(df: DataFrame, ranker: Ranker, text: str, keep: list[str], name: str = "score") -> DataFrame:
    """The columns `keep` and the score of `text`."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema] + [f"`{name}` double"])

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([*batch.columns[: len(keep)], pa.array(ranker.score(features(*joined_bytes(batch.column(len(keep))))))], [*keep, name])

    return map_arrow(df.select(*keep, F.col(text).alias("__text")), kernel, schema, "__text")
