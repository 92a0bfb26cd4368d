"""Operator 12: importance resampling towards a target, by an external sort-count of hashed features.

1. Each task turns slices of documents into packed streams of 16-bit bucket numbers, with each document's number of
   features, and writes them once;
2. the streams are read back, sorted and run-length encoded: the runs give bucket counts, one row per bucket and task
   at most, which are summed to ``BUCKETS`` rows in all;
3. gains per bucket are found on the driver from the two tables of ``BUCKETS`` counts, gathered along each stream and
   summed per document by ``np.add.reduceat``;
4. scores get a noise that depends on the id only, and the highest are drawn: positions come from one range-sorted
   table and the number of rows in the ranges before.

Features are chained crc32 values: the crc of "a b" goes on from the crc of "a", so no phrase is ever put together.

Defined cases: a null or empty text has no features and weight 0; repeated rows are weighed and ranked one by one;
a null id hashes as the empty text and stands before other ids of its score; an empty table gives an empty result, an
empty target counts 0 in every bucket; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, numbered, saved, table, trimmed

BUCKETS = 10_000
#: Documents with fewer words are never drawn.
LEAST = 20
PERCENT = 5
SEED = 42
#: Bytes of a text that are split into words at once.
WINDOW = 1_000_000

#: A-Z in lower case, ASCII but digits and letters as spaces.
_PLAIN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in (ord(chr(b).lower()) if b < 0x80 else b for b in range(256)))


def features(text: bytes, buckets: int = BUCKETS, window: int = WINDOW) -> tuple[int, np.ndarray]:
    """Number of words, and the buckets of all runs of one to three words."""
    plain, start, n = text.translate(_PLAIN), 0, 0
    held: list[bytes] = []
    found: list[np.ndarray] = []
    while start < len(plain):
        end = plain.find(b" ", start + window)
        end = len(plain) if end < 0 else end
        new = plain[start:end].split()
        start, n, k = end, n + len(new), len(held)
        words = held + new
        led = [b" " + w for w in words[1:]]
        one = list(map(crc32, words))
        two = list(map(crc32, led, one))
        three = list(map(crc32, led[1:], two))
        # what ends within the words held over was counted before
        found.append((np.array(one[k:] + two[max(k - 1, 0) :] + three, np.uint32) % buckets).astype("<u2"))
        held = words[-2:]
    return n, np.concatenate(found) if found else np.zeros(0, "<u2")


def streams(docs: DataFrame, buckets: int = BUCKETS, key: str = "doc_id") -> DataFrame:
    """A row per slice of documents: ids, words and sizes (arrays, a member per document), stream (packed buckets)."""
    def run(batches):
        for batch in batches:
            for at, raw in byte_slices(batch.column("text")):
                words, parts = zip(*(features(t, buckets) for t in raw), strict=True)
                ends = pa.array([0, len(raw)], pa.int32())
                lists = [batch.column(key).slice(at, len(raw)), pa.array(words, pa.int64()), pa.array(map(len, parts), pa.int64())]
                columns = [pa.ListArray.from_arrays(ends, x) for x in lists]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([np.concatenate(parts).tobytes()], pa.binary())], ["ids", "words", "sizes", "stream"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(trimmed(run), f"ids array<{kind}>, words array<long>, sizes array<long>, stream binary")


def bucket_counts(written: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket stands in the streams: ``buckets`` numbers, whatever the size of the corpus."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column("stream"):
                sorted_ = np.sort(np.frombuffer(packed.as_buffer(), "<u2"), kind="stable")
                firsts = np.flatnonzero(np.diff(sorted_, prepend=-1))  # run-length encoding
                total[sorted_[firsts]] += np.diff(firsts, append=len(sorted_))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    rows = written.select("stream").mapInArrow(trimmed(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, target over source."""
    m, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = ((t + 1) * (s_all + m) / ((s + 1) * (t_all + m)) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighed(written: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: gains summed over each document's part of its stream."""
    def run(batches):
        for batch in batches:
            for ids, words, sizes, packed in zip(*(batch.column(c) for c in ("ids", "words", "sizes", "stream")), strict=True):
                size = sizes.values.to_numpy()
                some = size > 0  # an empty document would take its successor's first gain
                weight = np.zeros(len(size), np.int64)
                if some.any():
                    weight[some] = np.add.reduceat(gain[np.frombuffer(packed.as_buffer(), "<u2")], (np.cumsum(size) - size)[some])
                yield pa.RecordBatch.from_arrays([ids.values, words.values, sizes.values, pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    kind = written.schema["ids"].dataType.elementType.simpleString()
    return written.mapInArrow(trimmed(run), f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id, seed: int = SEED):
    """Gumbel noise from the id alone, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h.cast("double") + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Every row's n_words, n_features, weight, score, and rank where it is drawn; ``target`` needs a column text."""
    written = saved(streams(docs, buckets))
    aimed = streams(target.select(F.lit(0).alias("doc_id"), "text"), buckets)
    gain: Callable = gains(bucket_counts(written, buckets), bucket_counts(aimed, buckets))
    rows = saved(weighed(written, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    fit = F.col("n_words") >= least
    drawn = rows.filter(fit).count() * percent // 100
    placed = numbered(rows.withColumn("fit", fit), [F.desc("fit"), F.desc("score"), F.asc("doc_id")], "rank")
    return placed.withColumn("rank", F.when(F.col("fit") & (F.col("rank") <= drawn), F.col("rank"))).drop("fit")


def op12_importance(spark, sf_dir):
    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
