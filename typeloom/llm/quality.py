"""Operator 3: quality by a regularised quadratic discriminant over document statistics.

Every whole text gives a few transformed statistics. Each class gets a mean and a covariance, shrunk towards a
diagonal, from sums that Spark adds up over all labelled training rows; the driver sees only those sums. A score is
the logistic of the difference of the log densities, by Mahalanobis distances with Cholesky factors that are computed
once and sent with the tasks, plus the classes' log frequencies.

Defined cases: a null text is scored as an empty one; labels that are null or not 0 or 1 are not learned from; where a
class has no training row the score is the share of label 1 among the training rows (0.5 without any); repeated rows
are scored each; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, crc_fold, saved, table, trimmed

FOLDS, HELD_OUT = 4, 2
ACCEPT = 0.7
SHRINKAGE = 0.05
FEATURES = 13


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_CLASSES = np.stack(
    [
        _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        _bytes("0123456789"),
        _bytes("#$%&*+=@^_~\\<>{}[]"),
        _bytes("|"),
        _bytes("!?"),
        _bytes(".,;:'\"-()"),
        _bytes("\n"),
    ]
).astype(float)


def statistics(raw: bytes) -> np.ndarray:
    """The transformed statistics of a whole text in UTF-8."""
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, words, lines = max(1, len(raw)), raw.split(), raw.splitlines()
    letters = max(1, len(words))
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    shares = np.log(_CLASSES @ counts / n + 0.002)
    return np.concatenate(
        [
            [np.log1p(len(words)), np.log1p(lengths.mean()), np.log1p(lengths.std()), np.log(len(set(words)) / letters + 0.01)],
            [np.log(len(set(lines)) / max(1, len(lines)) + 0.01), np.log(counts[raw_ends].sum() / letters + 0.01)],
            shares,
        ]
    )


raw_ends = list(b".!?")


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text."""

    def run(batches):
        for b in batches:
            found = [statistics(t) for _, texts in byte_slices(b.column("text")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, x array<double>")


def matrix(x: pa.Array) -> np.ndarray:
    """The statistics of a column, a row each."""
    return x.flatten().to_numpy().reshape(len(x), FEATURES)


def sums(labelled: DataFrame) -> dict[int, np.ndarray]:
    """For each label the sum of (1, x) times (1, x) transposed, over rows with columns label and x."""

    def run(batches):
        total = {}
        for b in batches:
            label, x = b.column("label").to_numpy(), np.column_stack([np.ones(b.num_rows), matrix(b.column("x"))])
            for k in np.unique(label).tolist():
                total[k] = total.get(k, 0) + x[label == k].T @ x[label == k]
        for k, s in total.items():
            columns = [pa.array(np.full(s.size, k, np.int32)), pa.array(np.arange(s.size, dtype=np.int32)), pa.array(s.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["label", "at", "v"])

    added = labelled.mapInArrow(trimmed(run), "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in added.collect():  # two labels' moments
        out.setdefault(r["label"], np.zeros((FEATURES + 1) ** 2))[r["at"]] = r["v"]
    return {k: v.reshape(FEATURES + 1, -1) for k, v in out.items()}


class Discriminant:
    """Two Gaussian classes with shrunk covariances and cached Cholesky factors."""

    def __init__(self, moments: dict[int, np.ndarray], shrinkage: float = SHRINKAGE):
        n = {k: m[0, 0] for k, m in moments.items()}
        self.share = n.get(1, 0) / sum(n.values()) if n else 0.5
        self.classes = None
        if min(n.get(0, 0), n.get(1, 0)) < 1:
            return
        both = sum(moments.values())
        pooled = both[1:, 1:] / both[0, 0] - np.outer(both[0, 1:], both[0, 1:]) / both[0, 0] ** 2
        scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
        self.classes = []
        for k in (0, 1):
            mean = moments[k][0, 1:] / n[k]
            own = moments[k][1:, 1:] / n[k] - np.outer(mean, mean)
            weight = shrinkage + (1 - shrinkage) * FEATURES / (FEATURES + n[k])
            factor = np.linalg.cholesky((1 - weight) * own + weight * scale)
            self.classes.append((mean, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(n[k] / sum(n.values()))))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.share)
        density = [prior - 0.5 * logdet - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) for mean, inverse, logdet, prior in self.classes]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def train(found: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Learn from the training folds of ``labels`` (doc_id and a 0/1 column)."""
    known = labels.filter((crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    return Discriminant(sums(found.join(known, "doc_id").select("label", "x")))


def scored(found: DataFrame, model: Discriminant) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(matrix(b.column("x"))))], ["doc_id", "score"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(trimmed(run), f"doc_id {kind}, score double")


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``accept``, for the model learned on them."""
    model = train(features(docs), labels)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = [statistics(t) for _, some in byte_slices(texts) for t in some]
        return pa.array(model.scores(np.array(found).reshape(-1, FEATURES)))

    return docs.filter(score("text") >= accept)


def op3_quality(spark, sf_dir):
    found = saved(features(table(spark, sf_dir, "documents")))
    out = scored(found, train(found, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
