"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each class has a Gaussian over the transformed statistics of ``features``; its covariance is shrunk towards the
pooled covariance and that towards its diagonal. The Cholesky factors are computed once, on the driver, and every
score is the difference of the classes' Mahalanobis log-densities (with log-determinants and class shares), passed
through the logistic function.

The statistics of every text are written once as a narrow table; labels join that table, not the texts. Counts, sums
and cross products of the labelled rows are added up in the tasks and by Spark, so all labelled rows count and the
driver gets a few hundred numbers.

Cases: null texts are empty texts, and these are scored like any; labels of unknown documents, null labels and null
ids are ignored; several labels of one document count each; if a class has no labelled row, all scores are the share
of class 1 (0.5 without any label); repeated rows are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.features import NAMES, text_features
from pulseframe.llm.run import map_texts, quoted, ready, stream
from pulseframe.llm.text import Block
from pulseframe.session import materialize

FOLDS = 5
CUT = 0.3
POOL = 0.2       # share of the pooled covariance in each class covariance
DIAGONAL = 0.1   # share of the diagonal in the pooled covariance
RIDGE = 1e-3
TEMPERATURE = 10.0


def held_out(doc_id, folds: int = FOLDS):
    """True for the rows kept from learning: crc32 of the id as text is a multiple of ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors, constants; ``classes`` are those with labelled rows."""

    classes: list[int]
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    shift: np.ndarray
    scale: np.ndarray

    def log_densities(self, rows: np.ndarray) -> np.ndarray:
        z = (rows - self.shift) / self.scale
        out = np.empty((len(z), len(self.classes)))
        for k in range(len(self.classes)):
            w = (z - self.means[k]) @ self.factors[k].T
            out[:, k] = self.constants[k] - 0.5 * np.einsum("ij,ij->i", w, w)
        return out

    def posteriors(self, rows: np.ndarray, temperature: float = 1.0) -> np.ndarray:
        logs = self.log_densities(rows) / temperature
        logs -= logs.max(axis=1, keepdims=True)
        p = np.exp(logs)
        return p / p.sum(axis=1, keepdims=True)


def moments(rows: DataFrame, size: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and cross products by class, from ``features`` (array) and ``class`` (int)."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.asarray(batch.column(0).flatten()).reshape(-1, size)
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            ones = np.column_stack([np.ones(len(values)), values])
            for label in np.unique(labels):
                mine = ones[labels == label]
                held[int(label)] = held.get(int(label), 0) + mine.T @ mine
        for label, sums in held.items():
            yield {"class": np.full(sums.size, label), "cell": np.arange(sums.size), "value": sums.ravel()}

    added = (stream(rows.select("features", "class"), add, "class int, cell int, value double")
             .groupBy("class", "cell").agg(F.sum("value").alias("value")))
    out: dict[int, np.ndarray] = {}
    for row in added.collect():  # (size + 1)**2 rows a class
        out.setdefault(row["class"], np.zeros((size + 1) ** 2))[row.cell] = row.value
    return {k: ((m := v.reshape(size + 1, size + 1))[0, 0], m[0, 1:], m[1:, 1:]) for k, v in out.items()}


def fit(found: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = POOL,
        diagonal: float = DIAGONAL) -> Discriminant | None:
    """None if fewer than two classes have rows."""
    if len(found) < 2:
        return None
    classes = sorted(found)
    total = sum(found[c][0] for c in classes)
    shift = sum(found[c][1] for c in classes) / total
    square = sum(np.diag(found[c][2]) for c in classes) / total
    scale = np.sqrt(np.maximum(square - shift**2, 1e-8))
    means, covariances, counts = [], [], []
    for c in classes:
        n, sums, products = found[c]
        mean = sums / n
        centred = products / n - np.outer(mean, mean)
        means.append((mean - shift) / scale)
        covariances.append(centred / np.outer(scale, scale))
        counts.append(n)
    pooled = sum(n * s for n, s in zip(counts, covariances, strict=True)) / total
    pooled = (1 - diagonal) * pooled + diagonal * np.diag(np.diag(pooled))
    size = len(shift)
    factors, constants = [], []
    for n, cov in zip(counts, covariances, strict=True):
        weight = pool + (1 - pool) * size / (size + n)  # few rows: closer to the pooled one
        lower = np.linalg.cholesky((1 - weight) * cov + weight * pooled + RIDGE * np.eye(size))
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(n / total) - np.log(np.diag(lower)).sum())
    return Discriminant(classes, np.array(means), np.array(factors), np.array(constants), shift, scale)


def feature_table(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``features`` of every text."""

    def compute(block: Block) -> dict:
        rows = text_features(block)
        flat = pa.array(rows.ravel())
        return {"features": pa.ListArray.from_arrays(
            pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), flat)}

    return map_texts(docs, compute, "features array<double>", keep, text)


def learn(features: DataFrame, labels: DataFrame, doc_id: str, label: str, folds: int = FOLDS):
    """The discriminant (or None) and the share of class 1 among the labelled rows that may be learned from."""
    marks = labels.select(F.col(quoted(doc_id)).alias("__id"), F.col(quoted(label)).cast("int").alias("class"))
    rows = (features.filter(~held_out(F.col(quoted(doc_id)), folds))
            .join(marks.filter(F.col("class").isin(0, 1)), F.col(quoted(doc_id)) == F.col("__id")))
    found = moments(rows, len(NAMES))
    total = sum(n for n, _, _ in found.values())
    share = found[1][0] / total if 1 in found else (0.0 if total else 0.5)
    return fit(found), share


def _scores(rows: np.ndarray, model: Discriminant | None, share: float, temperature: float) -> np.ndarray:
    if model is None:
        return np.full(len(rows), share)
    logs = model.log_densities(rows)
    gap = np.clip((logs[:, 1] - logs[:, 0]) / temperature, -500, 500)
    return 1 / (1 + np.exp(-gap))


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   label: str = "quality", cut: float = CUT, folds: int = FOLDS,
                   temperature: float = TEMPERATURE) -> DataFrame:
    """``held_out``, ``score`` and ``predicted`` of every document."""
    ready(docs)
    table = materialize(feature_table(docs, [doc_id], text), "quality-features")
    model, share = learn(table, labels, doc_id, label, folds)
    kind = table.schema[doc_id].dataType.simpleString()

    def score(batches):
        for batch in batches:
            rows = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, len(NAMES))
            values = _scores(rows, model, share, temperature)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), pa.array((values >= cut).astype(np.int32))],
                                             names=[doc_id, "score", "predicted"])

    scored = table.select(quoted(doc_id), "features").mapInArrow(
        score, f"{quoted(doc_id)} {kind}, score double, predicted int")
    return scored.select(quoted(doc_id), held_out(F.col(quoted(doc_id)), folds).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
             cut: float = CUT, folds: int = FOLDS, temperature: float = TEMPERATURE) -> DataFrame:
    """The documents that the classifier accepts, with all their columns.

    Learns from the labelled documents, then scores each text where it is read: the texts are never shuffled.
    """
    ready(docs)
    table = materialize(feature_table(docs, [doc_id], text), "quality-features")
    model, share = learn(table, labels, doc_id, label, folds)
    names = docs.columns

    def judge(block: Block) -> dict:
        return {"__score": _scores(text_features(block), model, share, temperature)}

    scored = map_texts(docs, judge, "__score double", names, text)
    return scored.filter(F.col("__score") >= cut).select(*[quoted(c) for c in names])
