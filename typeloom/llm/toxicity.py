"""Operator 8: toxicity by a convolutional text classifier trained in numpy.

Words (lower-cased, with signs as spaces) are hashed to rows of an embedding table; a word's embedding is the sum of
its own row and those of its beginnings, so that words of one stem help each other. Filters of several widths slide over the whole text, each keeps its maximum, and a linear
layer gives the score. Training takes a bounded sample of labelled training rows (``SAMPLE``, in the order of a hash
of the id) and runs on the driver; scoring runs in tasks with the filters applied to the table beforehand, so that a
convolution is a sum of looked-up rows.

Thresholds are calibrated by language: the score's logit is shifted by an offset for the language that the text's own
common words suggest, so that 0.5 is each language's best threshold on the training rows. The ``lang`` column is not
read.

Defined cases: a null text is scored as an empty one, by the bias alone; labels that are null or not 0 or 1 are not
learned from; without both labels among the training rows the score is their share of label 1 (0.5 without any);
repeated rows are scored each; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, pieces, table, trimmed, word_hashes

FOLDS, HELD_OUT = 5, 0
#: Labelled rows at most that the model learns from.
SAMPLE = 6000
BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 16, 12, 16, (1, 2, 3)
BEGINNINGS = (4, 5)
EPOCHS, BATCH, RATE = 6, 32, 0.01

# Fixed lists of common words by language, for the calibration.
COMMON = {
    "en": "the and of to in is that it was for are with".split(),
    "de": "der die und das ist nicht ein zu mit den von auf".split(),
    "fr": "le la les des et un une est que dans pour du".split(),
    "es": "el los las de que y en una por con para del".split(),
}
LANGUAGES = ["", *COMMON]

#: Signs become spaces, so that a word's marks don't change it; A-Z become small.
_FOLD = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\n\r\x0b\x0c" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def _common_hashes() -> np.ndarray:
    return np.stack([word_hashes([" ".join(words).encode()])[0] for words in COMMON.values()])


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows of all words (a row per word of its own and its beginnings' numbers), each text's first word (one more at the end), and each text's language number."""
    hashes, firsts, *begun = word_hashes([t.translate(_FOLD) for t in texts], BEGINNINGS)
    counts = []
    for known in _common_hashes():
        hit = np.concatenate(([0], np.cumsum(np.isin(hashes, known))))
        counts.append(hit[firsts[1:]] - hit[firsts[:-1]])
    counts = np.stack(counts)
    return (np.column_stack([hashes, *begun]) % np.uint64(BUCKETS)).astype(np.int64), firsts, np.where(counts.max(0) > 0, counts.argmax(0) + 1, 0)


class Network:
    """Hashed embeddings, filters of several widths, max pooling, and a linear layer with a logistic output."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {"E": r.normal(0, 0.3, (BUCKETS, SIZE)).astype(np.float32), "o": r.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), "c": np.zeros(1, np.float32)}
        for w in WIDTHS:
            self.p[f"W{w}"] = r.normal(0, 0.4 / w**0.5, (w, SIZE, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.share, self.offsets = None, np.zeros(len(LANGUAGES))

    def pooled(self, ids: np.ndarray, firsts: np.ndarray, tables: np.ndarray | None = None):
        """Per text the filters' maxima (0 at least, and for texts shorter than a filter), and where they lie."""
        texts = len(firsts) - 1
        tops, wheres = [], []
        if tables is not None:
            one = tables[ids[:, 0]] + tables[ids[:, 1]] + tables[ids[:, 2]]
            each = {wk: one[:, i * FILTERS : (i + 1) * FILTERS] for i, wk in enumerate((w, k) for w in WIDTHS for k in range(w))}
        else:
            x = self.p["E"][ids].sum(1)
        for w in WIDTHS:
            ends = np.maximum(firsts[1:] - (w - 1), firsts[:-1])
            spans = ends - firsts[:-1]
            top, where = np.zeros((texts, FILTERS), np.float32), np.full((texts, FILTERS), -1)
            full = np.flatnonzero(spans)
            if len(full):
                n = len(ids) - (w - 1)
                total = self.p[f"b{w}"] + sum((each[w, k][k : k + n] if tables is not None else x[k : k + n] @ self.p[f"W{w}"][k]) for k in range(w))
                for t in full:
                    part = total[firsts[t] : ends[t]]
                    at = part.argmax(0)
                    value = part[at, np.arange(FILTERS)]
                    top[t], where[t] = np.maximum(value, 0), np.where(value > 0, at + firsts[t], -1)
            tops.append(top)
            wheres.append(where)
        return np.concatenate(tops, 1), wheres

    def step(self, ids: np.ndarray, firsts: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        top, wheres = self.pooled(ids, firsts)
        p = 1 / (1 + np.exp(-(top @ self.p["o"] + self.p["c"])))
        g = ((p - y) * weight / len(y)).astype(np.float32)
        grads = {"o": top.T @ g, "c": g.sum(keepdims=True)}
        into = (g[:, None] * self.p["o"]).reshape(len(y), len(WIDTHS), FILTERS)
        rows, row_grads = [], []
        for i, w in enumerate(WIDTHS):
            t, f = np.nonzero(wheres[i] >= 0)
            at, d = wheres[i][t, f], into[t, i, f]
            grads[f"b{w}"] = np.bincount(f, d, FILTERS).astype(np.float32)
            dw = np.zeros_like(self.p[f"W{w}"])
            for k in range(w):
                word = ids[at + k]
                np.add.at(dw[k].T, f, d[:, None] * self.p["E"][word].sum(1))
                rows.append(word.ravel())
                row_grads.append(np.repeat(d[:, None] * self.p[f"W{w}"][k].T[f], word.shape[1], 0))
            grads[f"W{w}"] = dw
        for k, v in grads.items():
            self.m[k] = 0.95 * self.m[k] + 0.05 * v * v
            self.p[k] -= rate * v / (np.sqrt(self.m[k]) + 1e-6)
        touched, back = np.unique(np.concatenate(rows), return_inverse=True)
        de = np.zeros((len(touched), SIZE), np.float32)
        np.add.at(de, back, np.concatenate(row_grads))
        self.m["E"][touched] = 0.95 * self.m["E"][touched] + 0.05 * de * de
        self.p["E"][touched] -= rate * de / (np.sqrt(self.m["E"][touched]) + 1e-6)

    def tables(self) -> np.ndarray:
        """Every embedding row under every filter's every place."""
        return np.concatenate([self.p["E"] @ self.p[f"W{w}"][k] for w in WIDTHS for k in range(w)], 1)

    def logits(self, texts: list[bytes], tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, langs = np.zeros(len(texts)), np.zeros(len(texts), int)
        for first, end in pieces(texts, 500_000):
            ids, firsts, langs[first:end] = words(texts[first:end])
            out[first:end] = self.pooled(ids, firsts, tables)[0] @ self.p["o"] + self.p["c"]
        return out, langs

    def scores(self, texts: list[bytes], tables: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(texts), self.share)
        logit, langs = self.logits(texts, tables)
        return 1 / (1 + np.exp(-np.clip(logit - self.offsets[langs], -50, 50)))


def best_threshold(logit: np.ndarray, y: np.ndarray) -> float:
    """The logit that makes the fewest errors, half-way between its neighbours; 0 without both labels."""
    if not 0 < y.sum() < len(y):
        return 0.0
    o = np.argsort(logit)
    errors = np.concatenate(([0], np.cumsum(np.where(y[o] == 1, 1, -1)))) + (y == 0).sum()
    edges = np.concatenate(([logit[o[0]] - 1], (logit[o][1:] + logit[o][:-1]) / 2, [logit[o[-1]] + 1]))
    best = np.flatnonzero(errors == errors.min())
    return float(edges[best[len(best) // 2]])


def fit(texts: list[bytes], y: np.ndarray, seed: int = 5) -> Network:
    """Train on the texts; a fifth of them is kept from training, for the calibration."""
    net = Network(seed)
    if not 0 < y.sum() < len(y):
        net.share = float(y.mean()) if len(y) else 0.5
        return net
    spare = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    train = np.flatnonzero(~spare)
    weight = np.where(y == 1, min(4.0, (y == 0).sum() / y.sum()), 1.0)
    r = np.random.default_rng(seed)
    prepared = [words([t])[0] for t in texts]
    epochs = max(EPOCHS, min(40, 6000 // max(1, len(train))))
    for epoch in range(epochs):
        for some in np.array_split(r.permutation(train), max(1, len(train) // BATCH)):
            firsts = np.concatenate(([0], np.cumsum([len(prepared[i]) for i in some])))
            if firsts[-1]:
                net.step(np.concatenate([prepared[i] for i in some]), firsts, y[some], weight[some], RATE * (1 - epoch / epochs) + 1e-4)
    logit, langs = net.logits(texts, net.tables())
    held = spare if spare.any() else ~spare
    common = best_threshold(logit[held], y[held])
    net.offsets[:] = common
    for k in range(len(LANGUAGES)):
        mine = held & (langs == k)
        if mine.sum() >= 40 and 5 <= y[mine].sum() <= mine.sum() - 5:
            net.offsets[k] = best_threshold(logit[mine], y[mine])
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Network:
    """Learn from at most ``sample`` rows of the training folds of ``labels`` (doc_id and a 0/1 column)."""
    known = labels.filter((crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label"))
    # the sample's ids are bounded by a parameter: they are sent to all tasks, and the texts don't move
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text")).toPandas()
    rows = rows.sort_values(["doc_id", "label", "text"], ignore_index=True)
    rows = rows.iloc[np.random.default_rng(3).permutation(len(rows))]
    return fit([t.encode() for t in rows["text"]], rows["label"].to_numpy(float))


def scored(docs: DataFrame, model: Network) -> DataFrame:
    """doc_id and score of every whole text."""

    def run(batches):
        tables = model.tables()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.scores([(t or "").encode() for t in b["text"]], tables)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(trimmed(run), f"doc_id {kind}, score double")


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
