"""Operator 9: mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each source gets a target share of all words. Within a source every document has the same expected number of copies,
target / source size; documents stand in order of size, and a document is emitted once for each integer that the
prefix sum of expected copies, shifted by one offset per source, crosses. Sorting by size makes the sample a
stratified one, so that the words taken come near the target. As expected copies are constant within a source, the
prefix sum is rank x rate; ranks come from counts per (source, size, bucket), and no source is ever ordered in one
task.

Defined cases: a null text has size 0; null sources form one source, last in order; repeated rows are separate
documents; an empty table gives an empty result; input columns are kept. In ``mix`` the operator's own columns
replace columns of the same name; ``emitted`` returns the rows as they are, whatever their columns are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, partitions, saved, table

#: Documents of one source and size are ranked in so many independent buckets, or as many as there are partitions.
BUCKETS = 32


def targets(per_size: DataFrame, weights=(5, 2, 1), cap: float = 3.0) -> DataFrame:
    """One row per source: _source, source_size, target. ``per_size`` has _source, _size, n.

    Water filling: with sources in order of cap / weight, those before the first that stays under its cap at the
    current level are capped. Runs over one row per source.
    """
    total = per_size.groupBy("_source").agg(F.sum(F.col("_size") * F.col("n")).alias("source_size"))
    by_name = Window.orderBy(F.col("_source.source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = total.withColumn("w", F.element_at(cycle, (((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("int")))
    weighed = weighed.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), F.col("_source.source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    levelled = weighed.withColumn("level", level).withColumn(
        "level", F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct(F.col("most") / F.col("w"), F.col("level").alias("at")))).over(everything)["at"]
    )
    return levelled.select("_source", "source_size", F.least(F.col("level") * F.col("w"), F.col("most")).alias("target"))


OUT = ("size", "source_size", "target", "copies", "taken")


def counted(docs: DataFrame, out: list[str], weights, cap: float, seed: int) -> DataFrame:
    """``docs`` with five more columns, named by ``out`` in the order of ``OUT``; no column of ``docs`` has these names."""
    of_source, of_size, of_bucket, tie, rank, before_, size_, target_ = fresh(docs.select("*", *[F.lit(0).alias(o) for o in out]), *(f"_{x}" for x in ("source", "size", "bucket", "tie", "rank", "before", "source_size", "target")))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    buckets = max(BUCKETS, partitions(docs.sparkSession))
    rows = docs.select(
        "*",
        F.struct(F.col("source")).alias(of_source),
        size.alias(of_size),
        F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias(of_bucket),
        F.xxhash64("text").alias(tie),
    )
    plain = rows.select(F.col(of_source).alias("_source"), F.col(of_size).alias("_size"), F.col(of_bucket).alias("_bucket"))
    counts = saved(plain.groupBy("_source", "_size", "_bucket").agg(F.count("*").alias("n")))
    per_size = counts.groupBy("_source", "_size").agg(F.sum("n").alias("n"))
    running = lambda keys, *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before_size = per_size.withColumn("before", F.coalesce(F.sum("n").over(running(["_source"], "_size")), F.lit(0))).drop("n")
    before = (
        counts.withColumn("within", F.coalesce(F.sum("n").over(running(["_source", "_size"], "_bucket")), F.lit(0)))
        .join(before_size, ["_source", "_size"])
        .join(targets(per_size, weights, cap), "_source")
    )
    before = before.select(
        F.col("_source").alias(of_source), F.col("_size").alias(of_size), F.col("_bucket").alias(of_bucket), (F.col("before") + F.col("within")).alias(before_), F.col("source_size").alias(size_), F.col("target").alias(target_)
    )
    order = Window.partitionBy(of_source, of_size, of_bucket).orderBy("doc_id", tie)
    ranked = rows.withColumn(rank, F.row_number().over(order)).join(before, [of_source, of_size, of_bucket])
    rate = F.when(F.col(size_) > 0, F.col(target_) / F.col(size_)).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col(of_source)["source"]), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = F.col(before_) + F.col(rank)
    copies = (F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)).cast("int")
    made = (F.col(of_size), F.col(size_), F.col(target_), copies, copies * F.col(of_size))
    return ranked.select(*docs.columns, *(c.alias(name) for c, name in zip(made, out, strict=True)))


def mix(docs: DataFrame, weights=(5, 2, 1), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (copies x size) for every row."""
    return counted(docs.drop(*OUT), list(OUT), weights, cap, seed)


def emitted(docs: DataFrame, weights=(5, 2, 1), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """The mix itself: the rows of ``docs``, all their columns as they are, each as often as it is taken."""
    names = fresh(docs, *OUT, "copy")
    rows = counted(docs, names[:-1], weights, cap, seed).filter(F.col(names[3]) > 0)
    return rows.withColumn(names[-1], F.explode(F.sequence(F.lit(1), F.col(names[3])))).select(*docs.columns)


def op9_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
