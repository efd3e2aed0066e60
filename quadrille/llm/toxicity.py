"""Toxicity by a factorization machine over hashed terms.

A text is read whole, in windows of `width` words, each half over the next. A window's terms are its words, their
heads and its length, x being log2(1 + count); its logit is bias + sum w[t] x[t] + the sum over
pairs of terms of <v[t], v[u]> x[t] x[u], and the text's is that of its worst window, so a long
text doesn't hide a short insult. For the fit, windows are made on executors; the driver gets
counts of terms, and then only the terms that take part. Linear weights begin at damped log odds; weights, factors
and bias are then fitted together by AdaGrad on the logistic loss of the worst windows. The
pairs' factors tell an insult next to a mention of a group, or next to a second insult, from
either alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, held_out, labelled_sample, settled
from .features import Hasher, length_term, slices, windows


#: Windows whose logits are taken at once in the fit.
BLOCK = 2048


@dataclass(frozen=True)
class Settings:
    #: Labelled documents used at most, whatever their lengths; a larger set of labels is sampled by hash.
    sample: int = 8_000
    #: Windows of a document that the rounds of the fit look at; all are looked at for counts and for choosing these.
    windows: int = 4
    buckets: int = 1 << 18
    factors: int = 4
    width: int = 256
    rounds: int = 80
    rate: float = 0.1
    decay: float = 1e-3
    #: A term takes part from so many documents and so many standard errors of its log odds.
    least_docs: int = 3
    least_z: float = 2.0
    seed: int = 11


@dataclass
class Machine:
    settings: Settings
    bias: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, term: np.ndarray, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A logit for each window, and the sums of its factors. A window's terms end where the next begins; it may have none."""
        size = np.diff(np.r_[first, len(term)])
        rows = np.flatnonzero(size)
        logit, sums = np.full(len(first), self.bias), np.zeros((len(first), self.v.shape[1]))
        if len(rows):
            begins = first[rows]
            own = self.v[term] * x[:, None]
            sums[rows] = np.add.reduceat(own, begins, axis=0)
            squares = np.add.reduceat((own * own).sum(axis=1), begins)
            logit[rows] += np.add.reduceat(self.w[term] * x, begins) + 0.5 * ((sums[rows] ** 2).sum(axis=1) - squares)
        return logit, sums

    def scores(self, texts: list[str], hasher: Hasher) -> np.ndarray:
        worst = np.full(len(texts), -np.inf)
        for found in windows(texts, hasher, self.settings.width):
            found = found.only(self.active)
            np.maximum.at(worst, found.doc, self.logits(found.term, found.x, found.first)[0])
        return sigmoid(np.where(np.isinf(worst), self.bias, worst))

    @cached_property
    def active(self) -> np.ndarray:
        return self.w != 0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def term_counts(texts: list[str], y: np.ndarray, settings: Settings, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """In how many documents of class 0 and of class 1 each term stands."""
    good, bad = np.zeros(settings.buckets, np.int64), np.zeros(settings.buckets, np.int64)
    for i, text in enumerate(texts):
        met = np.zeros(settings.buckets, bool)
        for w in windows([text], hasher, settings.width):
            met[w.term] = True
        (bad if y[i] == 1 else good)[met] += 1
    return good, bad


def leaning(good: np.ndarray, bad: np.ndarray, n: int, toxic: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Of each term the damped log odds over documents, and whether it takes part: it has a clear lean, or tells a window's length."""
    s, prior = settings, (toxic + 0.5) / (n + 1)
    odds = np.log((bad + prior) / (toxic + 1)) - np.log((good + 1 - prior) / (n - toxic + 1))
    z = odds / np.sqrt(1 / (bad + prior) + 1 / (good + 1 - prior))
    active = (good + bad >= s.least_docs) & (np.abs(z) >= s.least_z)
    active[[length_term(i, s.buckets) for i in range(int(np.log2(s.width)) + 1)]] = True
    return odds, active


@dataclass
class Examples:
    """The windows of some documents, with the terms that take part; documents without a window are left out."""

    term: np.ndarray
    x: np.ndarray
    #: Terms of each window, windows of each document, and its label.
    size: np.ndarray
    count: np.ndarray
    y: np.ndarray


def first_weights(odds: np.ndarray, active: np.ndarray) -> np.ndarray:
    return np.where(active, np.where(odds > 0, 0.25, 0.02) * np.clip(odds, -2, 4) + 1e-6, 0).astype(np.float32)


def examples(text: str, hasher: Hasher, weights: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, their x and the sizes of a text's worst windows by these weights, in the order of the text; of equal ones the first."""
    kept: list[tuple[float, np.ndarray, np.ndarray]] = []
    for found in windows([text], hasher, settings.width):
        found = found.only(weights != 0)
        parts = zip(np.split(found.term, found.first[1:]), np.split(found.x, found.first[1:]))
        kept += [(float((weights[t] * x).sum()), t.astype(np.int32), x) for t, x in parts]
        if len(kept) > settings.windows:
            worst = sorted(sorted(range(len(kept)), key=lambda i: -kept[i][0])[: settings.windows])
            kept = [kept[i] for i in worst]
    if not kept:
        return np.empty(0, np.int32), np.empty(0, np.float32), np.empty(0, np.int32)
    return np.concatenate([t for _, t, _ in kept]), np.concatenate([x for _, _, x in kept]), np.array([len(x) for _, _, x in kept], np.int32)


def fit(texts: list[str], y: np.ndarray, settings: Settings = Settings()) -> Machine:
    """The machine for labels 0 and 1 of texts at hand."""
    y, hasher = np.asarray(y), Hasher(settings.buckets)
    odds, active = leaning(*term_counts(texts, y, settings, hasher), len(y), int(y.sum()), settings)
    found = [(*examples(t, hasher, first_weights(odds, active), settings), label) for t, label in zip(texts, y)]
    return fitted(_stacked(found), odds, active, len(y), int(y.sum()), settings)


def _stacked(found: list[tuple]) -> Examples:
    found = [f for f in found if len(f[2])]
    none = (np.empty(0, np.int32), np.empty(0, np.float32), np.empty(0, np.int32))
    return Examples(*(np.concatenate([f[i] for f in found]) if found else none[i] for i in range(3)), np.array([len(f[2]) for f in found], np.int64), np.array([f[3] for f in found], np.float64))


def fitted(found: Examples, odds: np.ndarray, active: np.ndarray, n: int, toxic: int, settings: Settings) -> Machine:
    """With one class only, or no row, the machine is a constant, the share of ones damped towards a tenth: it tells no text from another."""
    s, prior = settings, (toxic + 0.5) / (n + 1) if 0 < toxic < n else (toxic + 0.1) / (n + 1)
    machine = Machine(s, float(np.log(prior / (1 - prior))), np.zeros(s.buckets, np.float32), np.zeros((s.buckets, s.factors), np.float32))
    if not len(found.y) or toxic in (0, n):
        return machine
    machine.w = first_weights(odds, active)
    machine.v = (active[:, None] * np.random.default_rng(s.seed).normal(0, 0.02, machine.v.shape)).astype(np.float32)
    term, x, target = found.term, found.x, found.y
    ends = np.cumsum(found.size, dtype=np.int64)
    first = ends - found.size
    begins = np.cumsum(found.count) - found.count
    groups = np.repeat(np.arange(len(target)), found.count)
    blocks = [(i, min(i + BLOCK, len(first))) for i in range(0, len(first), BLOCK)]  # windows, some at a time
    g_w, g_v, g_b = np.full(s.buckets, 1e-2, np.float32), np.full(machine.v.shape, 1e-2, np.float32), 1e-2
    for _ in range(s.rounds):
        logit = np.concatenate([machine.logits(term[first[i] : ends[j - 1]], x[first[i] : ends[j - 1]], first[i:j] - first[i])[0] for i, j in blocks])
        worst = np.flatnonzero(logit == np.maximum.reduceat(logit, begins)[groups])
        worst = worst[np.unique(groups[worst], return_index=True)[1]]
        error = sigmoid(logit[worst]) - target
        at, begin = slices(first[worst], ends[worst])
        size = ends[worst] - first[worst]
        sums = machine.logits(term[at], x[at], begin)[1]
        terms, value, per = term[at], x[at], np.repeat(error, size) * x[at]
        d_w = np.bincount(terms, per, s.buckets).astype(np.float32) + s.decay * len(target) * machine.w * active
        d_x = per[:, None] * (np.repeat(sums, size, axis=0) - machine.v[terms] * value[:, None])
        d_v = np.stack([np.bincount(terms, d_x[:, f], s.buckets) for f in range(s.factors)], axis=1).astype(np.float32) + 10 * s.decay * len(target) * machine.v
        d_b = float(error.sum())
        g_w += d_w * d_w
        g_v += d_v * d_v
        g_b += d_b * d_b
        machine.w -= np.where(active, s.rate * d_w / np.sqrt(g_w), 0).astype(np.float32)
        machine.v -= np.where(active[:, None], 0.3 * s.rate * d_v / np.sqrt(g_v), 0).astype(np.float32)
        machine.bias -= s.rate * d_b / float(np.sqrt(g_b))
    return machine


def trained(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings = Settings()) -> Machine:
    """Of at most `sample` labelled documents, whole texts of any length; those of lowest hash.

    Texts stay on executors. The driver gets a number for each hashed term, and of at most
    `windows` windows of each document the terms that take part: both follow the bounds of
    the settings, not the texts' lengths. Null labels and labels without a document teach
    nothing; null and empty texts are documents without a window. Without labels of both
    classes (an empty table, too) the machine is a constant.
    """
    spark = docs.sparkSession
    rows = settled(labelled_sample(docs, labels, label, settings.sample).select("_id", "y", "text"))
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(settings.buckets), np.zeros((2, settings.buckets), np.int64)
        for batch in by_bytes(batches, 2):
            total += term_counts(batch.column(2).to_pylist(), batch.column(1).to_numpy(), settings, hasher)
        met = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[0][met]), pa.array(total[1][met])], names=["term", "good", "bad"])

    by = rows.mapInArrow(count, "term long, good long, bad long").groupBy("term").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toPandas()
    good, bad = np.zeros(settings.buckets), np.zeros(settings.buckets)
    good[by["term"].to_numpy(np.int64)], bad[by["term"].to_numpy(np.int64)] = by["good"], by["bad"]
    odds, active = leaning(good, bad, n, int(toxic), settings)
    box = spark.sparkContext.broadcast(first_weights(odds, active))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(settings.buckets)
        for batch in by_bytes(batches, 2):
            found = [[p.tobytes() for p in examples(t, hasher, box.value, settings)] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[i] for f in found], pa.binary()) for i in range(3))], names=["_id", "y", "term", "x", "size"])

    seen = sorted(rows.mapInArrow(read, "_id long, y int, term binary, x binary, size binary").collect(), key=lambda r: r["_id"])
    kinds = (np.int32, np.float32, np.int32)
    return fitted(_stacked([(*(np.frombuffer(r[c], k) for c, k in zip(("term", "x", "size"), kinds)), r["y"]) for r in seen]), odds, active, n, int(toxic), settings)


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted behind its columns; columns of these names give way.

    Null and empty texts, and texts without a word, get the machine's bias. Every row is
    scored by its text alone. An empty table gives no row.
    """
    others = [c for c in docs.columns if c not in ("score", "predicted")]
    box = docs.sparkSession.sparkContext.broadcast(machine)  # of a fixed size: the settings' buckets x (1 + factors) floats

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(box.value.settings.buckets)
        for batch in by_bytes(batches, 1, 1024):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = box.value.scores(texts, hasher)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    packed = docs.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)]).alias("row"), F.col("text").cast("string").alias("text"))
    out = StructType([packed.schema["row"], StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    schema = to_arrow_schema(out)
    done = packed.mapInArrow(of, out)
    return done.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(others)], "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents; labels of the held-out quarter aren't looked at."""
    machine = trained(docs, labels, "toxic", settings)
    return score(docs.select("doc_id", "text"), machine, threshold).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """The documents that the machine does not reject, with their own columns. Where the labels don't hold both classes it tells none from another, and all stay."""
    machine = trained(docs, labels, "toxic", settings)
    if not machine.active.any():
        return docs
    # under internal names, so that columns called score or predicted pass unharmed
    plain = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return score(plain, machine, threshold).where("predicted = 0").select(*[F.col("row")[c].alias(c) for c in docs.columns])
