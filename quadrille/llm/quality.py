"""Document quality by Bradley-Terry pairwise ranking.

Of a pair of one better and one worse document the better wins with probability
sigmoid(s(better) - s(worse)), s being linear in features of the text's shape; the weights
come from the logistic loss on feature differences. The cut lies at a quantile of the
training scores: as large a share passes as is labelled good. Scores are mapped to 0..1 so
that the cut becomes `threshold`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample

#: Byte classes: counted together, of any text.
_BYTES = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:", b"!?", b"|", b"#$%&*@^~_=+<>\\/", b"()[]{}\"'`-"), 1):
    _BYTES[list(_chars)] = _i
_BYTES[128:] = 11
CLASSES = 12
FEATURES = CLASSES + 9


@dataclass(frozen=True)
class Settings:
    #: Labelled documents used at most; a larger set of labels is sampled by hash.
    sample: int = 20_000
    #: Preference pairs drawn: each worse document meets so many better ones at most.
    pairs: int = 120_000
    rounds: int = 300
    rate: float = 0.1
    decay: float = 1e-4
    seed: int = 5


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    cut: float
    steep: float
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        s = expand((x - self.mean) / self.scale) @ self.w
        at = np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(self.steep * (s - self.cut) + at, -40, 40)))


def shape(text: str) -> list[float]:
    """FEATURES numbers of a whole text; of the empty text too."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    share = np.bincount(_BYTES, np.bincount(np.frombuffer(data, np.uint8), minlength=256), CLASSES) / (n + 1)
    words = data.split()
    lines = data.split(b"\n")
    m = len(words) or 1
    distinct = len(set(words))
    again = sum(map(bytes.__eq__, words[1:], words))
    return [
        *np.log(share + 1e-3).tolist(), np.log1p(n), np.log1p(len(words)), distinct / m, np.log(distinct / m + 1e-3), n / m if n / m < 50 else 50.0,
        again / m, np.log(again / m + 1e-3), len(set(lines)) / len(lines), np.log1p(len(lines)),
    ]


def shapes(texts: list[str]) -> np.ndarray:
    return np.array([shape(t) for t in texts], np.float64).reshape(len(texts), FEATURES)


def expand(z: np.ndarray) -> np.ndarray:
    """Each feature, how far it lies off to either side, and its square: a preference may peak between the ends."""
    z = np.clip(z, -6, 6)
    return np.concatenate([z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0), z * z / 6], axis=1)


def fit(x: np.ndarray, y: np.ndarray, threshold: float = 0.7, settings: Settings = Settings()) -> Ranker:
    """x: features, y: 1 better, 0 worse. With one class only the score is that class's side of the threshold for all."""
    s = settings
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(mean, scale, np.zeros(4 * FEATURES), 0.0 if len(good) or not len(y) else 1.0, 1.0, threshold)
    z = expand((x - mean) / scale)
    rng = np.random.default_rng(s.seed)
    n = min(s.pairs, len(good) * len(bad))
    left, right = rng.choice(good, n), bad[np.arange(n) % len(bad)]
    w, g = np.zeros(z.shape[1]), np.full(z.shape[1], 1e-8)
    for i in range(s.rounds):  # batches of the pairs in turn
        part = np.arange(i * 8192, (i + 1) * 8192) % n
        d = z[left[part]] - z[right[part]]
        grad = -(1 / (1 + np.exp(np.clip(d @ w, -40, 40)))) @ d / len(part) + s.decay * w
        g += grad * grad
        w -= s.rate * grad / np.sqrt(g)
    raw = z @ w
    cut = float(np.quantile(raw, 1 - len(good) / len(y)))
    return Ranker(mean, scale, w, cut, 1.0, threshold)


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, settings: Settings = Settings()) -> Ranker:
    rows = labelled_sample(docs, labels, label, settings.sample).select("text", "y")
    schema = "y int, x array<double>"
    found = rows.mapInArrow(_shaped, schema).toPandas()
    x = np.array(found["x"].tolist(), np.float64).reshape(len(found), FEATURES)
    order = np.lexsort([found["y"].to_numpy(), *x.T])  # the order of the rows doesn't matter then
    return fit(x[order], found["y"].to_numpy()[order], threshold, settings)


def _shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = shapes(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents; labels of the held-out quarter aren't looked at.

    Null texts count as empty; the empty text has a score like any other. Every row is
    scored by its text alone, repeated ids and rows too. Without labels of both kinds all
    scores are alike. An empty table gives no row.
    """
    ranker = trained(docs, labels, "quality", threshold, settings)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ranker.scores(shapes(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    done = rows.mapInArrow(of, "doc_id long, score double, predicted int")
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
