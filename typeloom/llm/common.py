"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import os
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import ship

#: Words of the contracts that split on ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch between the JVM and Python: whole texts by the ten thousand would hold much more.
ARROW_BATCH = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. The package is sent to the executors, Python workers also look for it where it is here, as
    they may start in another folder, and get batches of bounded size."""
    ship(spark)
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(run):
    """A task's function over batches that gives memory back to the system at its end: workers are reused, and what they
    keep of a task adds up over an executor's life."""

    def over(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return over


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found.rstrip("/")


def saved(df: DataFrame, codec: str = "lz4_raw") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    The table stays until the folder is cleaned, for a lazy result may still read it. The default codec works within the
    heap: others keep buffers of their own on executors that write many tables.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/typeloom-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: later filters and projections can copy the expression without blowing it up."""
    return F.element_at(F.transform(F.array(value), body), 1)


def swept(items: Column, carry: Column, step, kind: str, chunk: int = 64) -> Column:
    """All results of ``step(carry, item)``, which gives the next carry and an array of ``kind`` of results, in order.

    Results are gathered by chunks, so that no long array is copied for each item.
    """
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    state = lambda c, out: F.struct(c.alias("carry"), out.alias("out"))

    def one(held: Column, item: Column) -> Column:
        after, made = step(held["carry"], item)
        return state(after, F.concat(held["out"], made))

    def over(listed: Column) -> Column:
        def part(held: Column, i: Column) -> Column:
            done = F.aggregate(F.slice(listed, i * chunk + 1, chunk), state(held["carry"], none), one)
            return bound(done, lambda d: state(d["carry"], F.concat(held["out"], F.array(d["out"]))))

        chunks = F.sequence(F.lit(0), F.floor((F.size(listed) - 1) / chunk).cast("int"))
        return F.when(F.size(listed) > 0, F.flatten(F.aggregate(chunks, state(carry, nothing), part, lambda d: d["out"]))).otherwise(none)

    return bound(items, over)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list[Column], name: str, by: str | None = None) -> DataFrame:
    """``df`` with each row's place, from 1, in the order (within ``by``, a column without nulls), as column ``name``.

    Rows are sorted by range and written once; a place is the row's in its range, and the rows in the ranges before.
    Equal rows are spread by their place in the input, which should be a written table; no group meets in one task.
    """
    tie, at, part, first, n = fresh(df, "tie", "at", "part", "first", "n")
    keys = [*([F.asc(by)] if by else []), *order, F.asc(tie)]
    placed = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    written = saved(placed.drop(tie).withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, 33))
    group = [by] if by else []
    sizes = written.groupBy(part, *group).agg(F.min(at).alias(first), F.count("*").alias(n))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, *group, (F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(first) + 1).alias(first))
    return written.join(starts, [part, *group]).select(*df.columns, (F.col(at) + F.col(first)).alias(name))


def crc_fold(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fold of a labelled row. A null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of an unsigned array."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(texts: list[bytes], beginnings: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """64-bit hashes of all white-space-delimited words of the texts, and each text's first index (one more at the end).

    One pass over the joined bytes: a word's hash is a polynomial in its bytes, finalised. ``beginnings`` asks for
    further arrays with the hashes of the words' first so many bytes.
    """
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~_SPACE[joined]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    ends = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    firsts = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    if not len(starts):
        return np.zeros(0, np.uint64), firsts, *(np.zeros(0, np.uint64) for _ in beginnings)
    powers = np.ones(int((ends - starts).max()), np.uint64)
    powers[1:] = _BASE
    powers = np.multiply.accumulate(powers)
    where = np.flatnonzero(inside)
    first_in = np.concatenate(([0], np.cumsum(ends - starts)[:-1]))
    place = np.arange(len(where)) - np.repeat(first_in, ends - starts)
    terms = (joined[where].astype(np.uint64) + np.uint64(1)) * powers[place]
    begun = (mixed(np.add.reduceat(np.where(place < n, terms, np.uint64(0)), first_in) + np.uint64(n << 32)) for n in beginnings)
    return mixed(np.add.reduceat(terms, first_in)), firsts, *begun


def byte_slices(column: pa.Array, most: int = 400_000):
    """(first, values as bytes) of slices of a text column, null as empty, of at most ``most`` bytes each (or one text).

    The rest of the Arrow batch stays in its buffers, so that a pass holds one slice's values at a time.
    """
    raw = pc.fill_null(column, "").cast(pa.large_binary())
    sizes = pc.binary_length(raw).to_numpy()
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and total + size > most:
            yield first, raw.slice(first, i - first).to_pylist()
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, raw.slice(first).to_pylist()


def pieces(texts: list[bytes], most: int = 400_000):
    """Slices of a batch of at most ``most`` bytes each (or one text), so that a pass over them stays in bounded memory."""
    first, total = 0, 0
    for i, text in enumerate(texts):
        if i > first and total + len(text) > most:
            yield first, i
            first, total = i, 0
        total += len(text)
    if first < len(texts):
        yield first, len(texts)
