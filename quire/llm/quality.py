"""Quality classifier learned from positive and unlabelled texts by the non-negative unbiased risk.

Trusted positives are labelled rows with quality 1; the unlabelled side is web text whose labels are not looked at. The class
prior (share of good texts among the unlabelled) is estimated from positives and unlabelled texts alone: a first network
tells the two apart on one half of them; on the other half, the share of the unlabelled over the share of the positives above
a score bounds the prior, and the score with the least bound, sampling error included, gives it. The risk is
prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)); where the bracket turns negative the step ascends it instead.

Fitting uses bounded samples: at most SAMPLE positives and SAMPLE unlabelled texts, the ones with the smallest hash of their
id and text (the parameter bounds the driver's memory); repeated rows are drawn once, so no group of them can grow it. Scoring
covers every text; a very long one is read whole. Features look at characters, words and lines only; lang, source, ids, labels
and other columns, whatever their names, are never inputs. Null texts count as empty and are scored like any text. A null
doc_id is in the learning fold; equal rows have equal scores. The prior is kept inside [0.01, 0.99]; without any texts to learn
from, every text scores 0.5. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._core import runs, small_batches, utf8, windows, word_hashes

#: Most positives, and most unlabelled texts, that the fit reads.
SAMPLE = 12_000
#: Scores from here on are good; least steps of a fit.
THRESHOLD, STEPS = 0.3, 400
_MARKS = np.frombuffer(b"#*$%&|<>!?.,;:\"'-_=/\\@+()[]{}^~`", np.uint8)
_CLASSES = np.zeros(256, np.int64)
for _k, _range in enumerate(((0x09, 0x0E), (0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100))):
    _CLASSES[_range[0] : _range[1]] = _k + 1
_CLASSES[0x20] = 6
_GROUPS = 7
N_FEATURES = len(_MARKS) + _GROUPS + _GROUPS * _GROUPS + 10


def features(data: np.ndarray) -> np.ndarray:
    """Shares of marks, of character classes and of their pairs, and shape figures of words and lines, of one text."""
    n = max(1, len(data))
    counts = np.bincount(data, minlength=256)
    kinds = _CLASSES[data]
    pairs = np.bincount(kinds[:-1] * _GROUPS + kinds[1:], minlength=_GROUPS * _GROUPS) if len(data) > 1 else np.zeros(_GROUPS * _GROUPS)
    words, first = word_hashes(data)
    w = max(1, len(words))
    lengths = np.diff(np.append(first, len(data))) if len(words) else np.zeros(1)
    lines = int(counts[10]) + 1
    tri, seen = np.unique(windows(words, 3), return_counts=True) if len(words) else (np.zeros(0), np.zeros(0))
    distinct, often = np.unique(words, return_counts=True) if len(words) else (np.zeros(0), np.zeros(1))
    letters = max(1, int(counts[0x41:0x5B].sum() + counts[0x61:0x7B].sum()))
    shape = [
        np.log1p(len(words)) / 10, len(distinct) / w, float(seen[seen > 1].sum()) / w, often.max() / w, lengths.mean() / 10,
        min(1.0, lengths.std() / 10), min(1.0, w / lines / 50), counts[0x41:0x5B].sum() / letters, (lengths <= 3).mean(), float((words[1:] == words[:-1]).sum()) / w,
    ]
    return np.concatenate([np.sqrt(counts[_MARKS] / n), np.bincount(kinds, minlength=_GROUPS) / n, np.sqrt(pairs / n), shape]).astype(np.float32)


def _matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(np.frombuffer(x.encode("utf-8", "replace"), np.uint8)) for x in texts], np.float32).reshape(len(texts), N_FEATURES)


@dataclass
class Model:
    """A network with one hidden layer."""

    prior: float = 0.5
    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES, np.float32))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_FEATURES, np.float32))
    weights: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(x))
        w, b, v, c = self.weights
        return (np.maximum(np.clip((x - self.mean) / self.scale, -8, 8) @ w + b, 0) @ v + c)[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _apart(z: np.ndarray, n: int, prior: float) -> np.ndarray:
    """Gradient of the plain logistic loss of n positives against the others."""
    s = _sigmoid(z)
    return np.concatenate([(s[:n] - 1) / n, s[n:] / (len(z) - n)])


def _risk(z: np.ndarray, n: int, prior: float) -> np.ndarray:
    """Gradient of the non-negative risk of n positives and the unlabelled with the sigmoid loss."""
    s = _sigmoid(z)
    slope = s * (1 - s)
    bracket = s[n:].mean() - prior * s[:n].mean()
    negative = np.concatenate([-prior * slope[:n] / n, slope[n:] / (len(z) - n)])
    if bracket < 0:
        return -negative
    return negative + np.concatenate([-prior * slope[:n] / n, np.zeros(len(z) - n)])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, gradient=_risk, hidden: int = 24, epochs: int = 30, batch: int = 512, rate: float = 0.01, seed: int = 7) -> Model:
    """Minimises the non-negative risk by Adam; deterministic for equal inputs."""
    model = Model(prior=float(np.clip(prior, 0.01, 0.99)))
    if not len(positive) or not len(unlabelled):
        return model
    rng = np.random.default_rng(seed)
    model.mean, model.scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = (np.clip((x - model.mean) / model.scale, -8, 8) for x in (positive, unlabelled))
    weights = [rng.normal(0, np.sqrt(2 / N_FEATURES), (N_FEATURES, hidden)), np.zeros(hidden), rng.normal(0, 0.1, (hidden, 1)), np.zeros(1)]
    first, second, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    steps = max(1, len(u) // batch)
    for _ in range(max(epochs, STEPS // steps)):
        for part in np.array_split(rng.permutation(len(u)), steps):
            xp, xu = p[rng.integers(0, len(p), min(batch, len(p)))], u[part]
            x = np.concatenate([xp, xu])
            hid = np.maximum(x @ weights[0] + weights[1], 0)
            grad = gradient((hid @ weights[2] + weights[3])[:, 0], len(xp), model.prior)
            back = grad[:, None] @ weights[2].T * (hid > 0)
            t += 1
            for k, g in enumerate((x.T @ back, back.sum(0), hid.T @ grad[:, None], grad.sum(keepdims=True))):
                g = g + 1e-4 * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    model.weights = [w.astype(np.float32) for w in weights]
    return model


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from the score above which the unlabelled hold fewest per positive."""
    if len(positive) < 2 or len(unlabelled) < 2:
        return 0.5
    known = fit(positive[::2], unlabelled[::2], 0.5, _apart, epochs=15)
    p, u = np.sort(known.logits(positive[1::2])), np.sort(known.logits(unlabelled[1::2]))
    in_p, in_u = 1 - np.searchsorted(p, p) / len(p), 1 - np.searchsorted(u, p) / len(u)
    error = np.sqrt(np.log(40) / 2 / len(p)) + np.sqrt(np.log(40) / 2 / len(u))
    best = int(np.argmin((in_u + error) / in_p))
    return float(np.clip(in_u[best] / in_p[best], 0.01, 0.99))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column(3))
        rows = [features(data[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.binary())], names=["good", "id", "print", "x"])


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample: int = SAMPLE) -> Model:
    """Fits on the rows of docs(doc_id, text) whose fold is not the held one; labels(doc_id, quality)."""
    small_batches(docs.sparkSession)
    fold = lambda c: F.crc32(F.col(c).cast("string")) % folds
    outside = lambda c: F.coalesce(fold(c) != held, F.lit(True))
    trusted = labels.filter("quality = 1").select(F.col("doc_id").alias("id"), F.lit(1).alias("good")).filter(F.col("id").isNotNull() & outside("id")).distinct()
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).filter(outside("id"))
    rows = rows.withColumn("print", F.xxhash64("text"))
    chance = F.xxhash64("id", "print", F.lit("sample"))
    seen = rows.select("id", "print").distinct()
    positives = seen.join(trusted, "id").orderBy(chance, "id", "print").limit(sample)
    unlabelled = seen.orderBy(chance, "id", "print").limit(sample).withColumn("good", F.lit(0))
    picked = F.broadcast(positives.select("id", "print", "good").unionByName(unlabelled).select(F.col("id").alias("of"), F.col("print").alias("by"), "good"))
    taken = rows.join(picked, (F.col("id").eqNullSafe(F.col("of"))) & (F.col("print") == F.col("by")))
    taken = taken.select("good", "id", "print", "text").mapInArrow(_features_of, f"good int, id {rows.schema['id'].dataType.simpleString()}, print long, x binary")
    learned = taken.groupBy("good", "id", "print").agg(F.first("x").alias("x")).select("good", "x").toPandas()  # at most 2 * sample rows
    x = np.frombuffer(b"".join(learned.x), np.float32).reshape(len(learned), N_FEATURES)
    good = learned.good.to_numpy() == 1
    order = np.lexsort(x.T[::-1])  # the fit doesn't depend on the order in which partitions arrive
    x, good = x[order].astype(float), good[order]
    return fit(x[good], x[~good], class_prior(x[good], x[~good]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher is better) of every row of docs(doc_id, text)."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(data, at, model), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(scored, f"doc_id {kind}, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold, with all their columns; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    where = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(where))
            scores = _scores(data, at, model)
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(kept, docs.schema)


def _scores(data: np.ndarray, at: np.ndarray, model: Model) -> np.ndarray:
    parts = [np.zeros(0)]
    for i, j in runs(at):
        x = np.array([features(data[a:b]) for a, b in zip(at[i:j], at[i + 1 : j + 1], strict=True)])
        parts.append(model.score(x))
    return np.concatenate(parts)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model learned outside the held fold."""
    out = score(docs, learn(docs, labels, folds, held))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
