"""Operator 5: near-duplicate documents by banded MinHash with odd-sketch verification.

1. A row's set is its distinct word shingles, hashed; rows with equal sets form one class, a node of the link graph.
2. Each class gets MinHash samples. Groups of samples are the bands; all samples, folded into a parity bitmap, are the
   odd sketch: the XOR of two sketches counts the samples that differ, which is precise just where likeness is high.
3. Classes that share a band are candidates. A band's group has a few landmarks, drawn from its members by hash. Each
   class is first paired with the landmark whose sketch is nearest to its own, then, where landmarks lie in other
   components, with the nearest one of each; both rounds are linear in the group. Pairs are confirmed on full sets.
4. What a group holds besides its largest component is compared with all members of other components by a finer odd
   sketch of many more samples; pairs that may be links are confirmed, the nearest of each member's pairs with another
   component first, then all that still lie apart. Members that are connected already are never paired, so a group of
   near copies doesn't become all its pairs, and a group's members are dealt out in parts.
5. Components by alternating large-star and small-star steps, all in DataFrames.

What can be lost: two sets of likeness 0.8 share none of the bands with a chance of 5 in a million, less at higher
likeness; the sketches' margins are four to five standard deviations. Sets are of 64-bit hashes, classes are named by 64
bits of their digest. Every link that is made is confirmed on full sets.

Defined cases: a null text, or one without words, has n_shingles 0, is its own component and is kept; a text with
fewer words than a shingle has the whole sequence as its one shingle. Nodes are texts, not ids: rows that repeat a
doc_id with other texts belong to the components of their texts. A component is named by the smallest doc_id of its
rows; a null doc_id counts only where there is no other. An empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, fresh, mixed, saved, table, trimmed, word_hashes

BANDS, ROWS = 40, 6
#: 64-bit words of the odd sketch.
SKETCH = 8
#: Likeness that the sketch may give less than the threshold: some six standard deviations.
MARGIN = 0.15
#: Samples, 64-bit words and margin of the fine sketch, which only documents get that are compared within a band.
FINE_SAMPLES, FINE, FINE_MARGIN = 3200, 128, 0.03
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: A seed gives two samples: the upper and the lower half of a product.
_SEEDS = mixed(np.arange(1, BANDS * ROWS // 2 + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
_FINE_SEEDS = mixed(np.arange(1001, 1001 + FINE_SAMPLES // 2, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
_PLACES = mixed(np.arange(1, ROWS + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
#: Landmarks of a band's group.
MARKS = 4
#: Members of a group that one part holds.
PART = 512
#: Of a member's pairs with another component so many go first.
TRIES = 8
#: Rows of ids that may be sent to all executors at once, some 25 MB; more are joined by shuffle.
SENT_IDS = 300_000
#: Pairs of one document that are confirmed together.
GROUP = 256


def shingles(texts: list[bytes], width: int):
    """The sorted distinct shingle hashes of each lower-cased text."""
    hashes, firsts = word_hashes(texts)
    for first, end in zip(firsts[:-1], firsts[1:], strict=True):
        words = hashes[first:end]
        span = max(1, min(width, len(words)))
        whole = np.zeros(max(0, len(words) - span + 1), np.uint64)
        for k in range(span):
            whole = mixed(whole * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(whole)] + np.uint64(k + 1))
        yield np.unique(whole)


def column_shingles(column: pa.Array, width: int):
    """The shingles of every text of an Arrow column, in its order."""
    for _, texts in byte_slices(column):
        yield from shingles([t.lower() for t in texts], width)


def samples(found: np.ndarray, seeds: np.ndarray = _SEEDS) -> np.ndarray:
    """MinHash samples of a set of hashes, two a seed, in blocks so that memory stays bounded."""
    high = np.full(len(seeds), np.iinfo(np.uint64).max)
    low = np.full(len(seeds), np.iinfo(np.uint32).max, np.uint32)
    folded, step = found ^ (found >> np.uint64(32)), max(1, 100_000 // len(seeds))
    for i in range(0, len(found), step):
        values = folded[None, i : i + step] * seeds[:, None]
        values ^= values >> np.uint64(29)
        values *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(high, values.min(1), out=high)
        np.minimum(low, values.astype(np.uint32).min(1), out=low)
    return np.concatenate([high >> np.uint64(32), low.astype(np.uint64)])


def odd_sketch(sample: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """The samples, folded into a bitmap: a bit is on if an odd number of samples fall on it."""
    places = mixed(sample + (np.arange(len(sample), dtype=np.uint64) << np.uint64(32))) % np.uint64(64 * words)
    odd = (np.bincount(places.astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def band_keys(sample: np.ndarray) -> np.ndarray:
    """A key per band; keys of different bands differ."""
    return mixed((sample.reshape(BANDS, ROWS) * _PLACES).sum(1, dtype=np.uint64) * _GOLDEN + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def most_differing(threshold: float, n: int = BANDS * ROWS, words: int = SKETCH, margin: float = MARGIN) -> int:
    """XOR bits that a pair may differ in, by the expected count at the threshold less the margin."""
    differing, bits = 2 * n * (1 - threshold + margin), 64 * words
    return int(bits / 2 * (1 - (1 - 2 / bits) ** differing))


def node_of(found: np.ndarray) -> int:
    """The name of a set's class: 64 bits of its digest."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's hash: together they find a row again."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n_shingles, and the class, band keys and odd sketch of the set (null for an empty one)."""
    kind = pa.list_(pa.int64())

    def run(batches):
        for b in batches:
            sizes, nodes, bands, sketches = [], [], [], []
            for found in column_shingles(b.column("text"), width):
                sample = samples(found) if len(found) else None
                sizes.append(len(found))
                nodes.append(node_of(found) if len(found) else None)
                bands.append(None if sample is None else band_keys(sample))
                sketches.append(None if sample is None else odd_sketch(sample))
            columns = [b.column("doc_id"), b.column("text_key"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bands, kind), pa.array(sketches, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "node", "bands", "sketch"])

    of_id = docs.schema["doc_id"].dataType.simpleString()
    return keyed(docs).mapInArrow(trimmed(run), f"doc_id {of_id}, text_key long, n_shingles long, node long, bands array<long>, sketch array<long>")


def sent(named: DataFrame) -> DataFrame:
    """``named``, saved, and to be sent to all executors if it is counted to be small, so that the texts it is joined with stay where they are."""
    named = saved(named)
    return F.broadcast(named) if named.count() <= SENT_IDS else named


def texts_of(docs: DataFrame, named: DataFrame, *columns: str) -> DataFrame:
    """The named columns and the text of the rows that ``named`` finds by doc_id and text_key."""
    rows = sent(named.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}))
    here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    return keyed(docs).join(rows, here).select(*columns, "text")


def confirmed(pairs: DataFrame, heads: DataFrame, docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are alike enough. ``heads`` names a row of each class.

    A pair's second text travels once, the first one once for every ``GROUP`` pairs of its class: rows are dealt by
    the first class and a part of its pairs, and a task holds one first set while it reads the second texts.
    """
    pairs = saved(pairs)
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    dealt = pairs.join(parts.filter("parts > 1"), "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).alias("part"))
    dealt = saved(dealt)
    first = dealt.select("a", F.col("a").alias("b"), "part").distinct().withColumn("head", F.lit(True))
    asked = dealt.withColumn("head", F.lit(False)).unionByName(first).join(heads.withColumnRenamed("node", "b"), "b")
    rows = texts_of(docs, asked, "a", "b", "part", "head")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("head"), "b")
    least = round(threshold * 100)

    def alike(p: np.ndarray, q: np.ndarray) -> bool:
        both = len(np.intersect1d(p, q, assume_unique=True))
        return 100 * both >= least * (len(p) + len(q) - both) > 0

    def run(batches):
        here, whole = None, None
        for batch in batches:
            keep = []
            names = (batch.column(c).to_pylist() for c in ("a", "b", "part", "head"))
            for a, b, part, head, found in zip(*names, column_shingles(batch.column("text"), width), strict=True):
                same = node_of(found) == b  # else another text with the same id and hash
                if head:
                    here, whole = ((a, part), found) if same else (here, whole)
                keep.append(not head and same and here == (a, part) and alike(whole, found))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return saved(rows.mapInArrow(trimmed(run), "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node reachable."""
    stars = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours go to the smallest of them
        large = large.filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        small = large.join(down, "u").select(F.explode(edges).alias("e"))
        stars = saved(small.select("e.u", "e.v").filter("u <> v").distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    nodes = stars.groupBy("u").agg(F.min("v").alias("component"))
    roots = stars.select(F.col("v").alias("u")).distinct().join(nodes.select("u"), "u", "left_anti").withColumn("component", F.col("u"))
    return saved(nodes.unionByName(roots).withColumnRenamed("u", "node"))


def joined_by(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``found``, joined by further links (a, b)."""
    if links.isEmpty():
        return found
    return components(links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def placed_in(rows: DataFrame, found: DataFrame, node: str, component: str) -> DataFrame:
    """``rows`` with the component of a column's node; a node without links is its own."""
    names = found.select(F.col("node").alias(node), F.col("component").alias(component))
    return rows.join(names, node, "left").withColumn(component, F.coalesce(component, node))


def _near(threshold: float, name: str, words: int, most: int) -> Column:
    """n and sketches of a pair allow the threshold: by the sizes of the sets, and by the bits that differ."""
    return (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * round(threshold * 100)) & (_differing(name, words) <= most)


def _differing(name: str, words: int) -> Column:
    return F.expr(" + ".join(f"bit_count({name}_a[{k}] ^ {name}_b[{k}])" for k in range(words)))


def linked(reps: DataFrame, docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """(node, component) of the classes that have a link. ``reps``: node, n, doc_id, text_key, bands, sketch."""
    heads = reps.select("node", "doc_id", "text_key")
    banded = reps.select("node", F.explode("bands").alias("key"))
    # most keys have one member: they go before anything else is made of a group
    groups = banded.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    members = saved(banded.join(groups, "key"))
    marks = F.array_distinct(F.array(*(F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(MARKS))))
    marked = members.join(members.groupBy("key").agg(marks.alias("marks")), "key").select(F.col("node").alias("b"), "members", F.explode("marks").alias("a"))
    # a pair of two goes one way
    asked = marked.filter((F.col("a") < F.col("b")) | (F.col("members") > 2) & (F.col("a") != F.col("b"))).select("a", "b").distinct()

    def side(x: str) -> DataFrame:
        return reps.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    near = asked.join(side("a"), "a").join(side("b"), "b").filter(_near(threshold, "sketch", SKETCH, most_differing(threshold)))
    near = saved(near.select("a", "b", _differing("sketch", SKETCH).alias("d")))
    nearest = F.min_by("a", F.struct("d", "a")).alias("a")

    first = near.groupBy("b").agg(nearest)
    found = components(confirmed(first, heads, docs, width, threshold))
    apart = placed_in(placed_in(near, found, "a", "in_a"), found, "b", "in_b").filter("in_a <> in_b")
    second = apart.groupBy("b", "in_a").agg(nearest).select("a", "b").join(first, ["a", "b"], "left_anti")
    found = joined_by(found, confirmed(second, heads, docs, width, threshold))

    # one link joins two components: the likeliest pairs go first, so that most others needn't be confirmed
    pairs = saved(rest(members, found, reps, docs, width, threshold))
    tries = placed_in(pairs, found, "b", "in_b").groupBy("a", "in_b", F.pmod(F.xxhash64("b"), F.lit(TRIES)))
    tried = saved(tries.agg(F.min_by("b", F.struct("d", "b")).alias("b")).select("a", "b"))
    found = joined_by(found, confirmed(tried, heads, docs, width, threshold))
    apart = placed_in(placed_in(pairs, found, "a", "in_a"), found, "b", "in_b").filter("in_a <> in_b")
    left = apart.select("a", "b").join(tried, ["a", "b"], "left_anti")
    return joined_by(found, confirmed(left, heads, docs, width, threshold))


def rest(members: DataFrame, found: DataFrame, reps: DataFrame, docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (a, b) that may still be links, and the bits d that differ: of one group, in different components, and alike by the fine sketch."""
    placed = placed_in(members.select("key", "node", "members"), found, "node", "component")
    shares = placed.groupBy("key", "component").agg(F.count("*").alias("share"))
    mixed_groups = shares.groupBy("key").agg(F.max_by("component", F.struct("share", "component")).alias("main"), F.count("*").alias("many")).filter("many > 1")
    placed = saved(placed.join(mixed_groups.select("key", "main"), "key"))
    fine = saved(fine_sketches(docs, placed.select("node").distinct().join(reps.select("node", "doc_id", "text_key"), "node"), width))
    # of the bands' keys their lower halves tell which ones a pair shares
    bands = F.transform("bands", lambda k: F.shiftright(F.shiftleft(k, 32), 32).cast("int")).alias("bands")
    traits = saved(placed.join(reps.select("node", "n", bands), "node").join(fine, "node").withColumn("parts", F.ceil(F.col("members") / PART).cast("int")))

    def side(rows: DataFrame, x: str) -> DataFrame:
        return rows.select("key", "part", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "main", "n", "bands", "fine")])

    # a member stands in one part of its group, and what lies outside the group's main component meets every part
    whole = traits.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    outside = traits.filter("component <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cross = (F.col("component_a") != F.col("component_b")) & ((F.col("component_b") == F.col("main_b")) | (F.col("node_a") < F.col("node_b")))
    # of the bands that a pair shares only the first compares it
    shared = F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), F.lit(True)).cast("int")
    first = F.element_at("bands_a", F.greatest(shared, F.lit(1))) == F.shiftright(F.shiftleft("key", 32), 32).cast("int")
    alike = _near(threshold, "fine", FINE, most_differing(threshold, FINE_SAMPLES, FINE, FINE_MARGIN))
    pairs = side(outside, "a").join(side(whole, "b"), ["key", "part"]).filter(cross & alike & first)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), _differing("fine", FINE).alias("d")).distinct()


def fine_sketches(docs: DataFrame, named: DataFrame, width: int) -> DataFrame:
    """(node, fine): a larger odd sketch of many more samples, only for the classes that ``named`` names by a row."""
    kind = pa.list_(pa.int64())

    def run(batches):
        for b in batches:
            nodes, made = [], []
            for node, found in zip(b.column("node").to_pylist(), column_shingles(b.column("text"), width), strict=True):
                if node_of(found) == node:
                    nodes.append(node)
                    made.append(odd_sketch(samples(found, _FINE_SEEDS), FINE))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(made, kind)], ["node", "fine"])

    return texts_of(docs, named, "node").mapInArrow(trimmed(run), "node long, fine array<long>").dropDuplicates(["node"])


def labelled(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """doc_id, text_key, n_shingles and head of every row: doc_id and text_key of the first row of its component (null without words)."""
    signed = saved(signatures(docs, width))
    # null ids come after all others
    head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    found = signed.filter("node is not null")
    reps = found.groupBy("node").agg(F.min(head).alias("head"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = saved(reps.select("node", "n", "head", "head.doc_id", "head.text_key", "bands", "sketch"))
    joined = linked(reps, docs, width, threshold)
    within = joined.join(reps.select("node", "head"), "node")
    firsts = within.groupBy("component").agg(F.min("head").alias("first"))
    named = reps.select("node", "head").join(within.join(firsts, "component").select("node", "first"), "node", "left")
    named = named.select("node", F.coalesce("first", "head").alias("head"))
    return signed.select("doc_id", "text_key", "n_shingles", "node").join(named, "node", "left").select("doc_id", "text_key", "n_shingles", "head")


def classes(docs: DataFrame, width: int = 2, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    component = F.when(F.col("head").isNotNull(), F.col("head.doc_id")).otherwise(F.col("doc_id"))
    return labelled(docs, width, threshold).select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def kept_rows(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` of which one of each component stays, and all rows without words."""
    found = saved(labelled(docs, width, threshold).filter("head is not null"))
    stays = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key"))
    gone = found.filter(~stays).select("doc_id", "text_key").distinct()
    again = found.filter(stays).groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "text_key")

    of_id, of_key, key = fresh(docs, "id", "key", "text_key")

    def without(rows: DataFrame, named: DataFrame, how: str) -> DataFrame:
        named = sent(named.withColumnsRenamed({"doc_id": of_id, "text_key": of_key}))
        return rows.join(named, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.xxhash64("text") == F.col(of_key)), how)

    kept = without(docs, gone, "left_anti")
    again = saved(again)
    if again.isEmpty():
        return kept
    # rows that repeat both the id and the text of the one that stays: one of them
    once = without(docs, again, "left_semi").withColumn(key, F.xxhash64("text")).dropDuplicates(["doc_id", key]).drop(key)
    return without(kept, again, "left_anti").unionByName(once)


def op5_near_duplicates(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents"))
