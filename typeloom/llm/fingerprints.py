"""Operator 1: SpotSigs fingerprints, with DataFrame functions only.

A signature is an anchor (a common word) with the next two content words after it, whatever anchors stand between.
A text's fingerprint is its set of signature hashes, sorted, in hex. Fingerprints are compared by Jaccard likeness.
Sets are partitioned by length, by powers of two. Partitions d apart bound a likeness from above by 2^(1 - d), and the
lengths' ratio does so more tightly: what can't reach the likeness that a caller asks for is 0 without being
intersected. Sets whose hashes lie in ranges apart are disjoint, and are never intersected.

Words are lower-cased runs of letters and digits. A text without any signature has one for each three words in a row,
or one for all its words if there are fewer; a text without words has the empty fingerprint.

Defined cases: a null text is an empty one; two empty fingerprints have likeness 1, an empty and another 0; rows with
equal ids are ordered by their text; a null id comes first; an empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound, partitions, table

# Fixed list of common words: English, German, French, Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were with you "
    "als auch auf aus das dem den der des die ein eine einen einer er es für ich im ist mit nicht sich sie so und von war wie zu zum zur "
    "au aux avec ce dans de du elle en est et il la le les leur mais ne ou par pas pour que qui sa se ses son sur un une vous "
    "al como con del el esta lo los las más no para pero por su sus y"
).split()
#: Documents in a bucket of neighbours, and buckets at most (their bounds are sent to the tasks).
IN_BUCKET, MOST_BUCKETS = 64, 16384


def signatures(text: Column) -> Column:
    """The sorted set of signature hashes of a text."""
    none = F.array().cast("array<bigint>")

    def spots(w: Column, at: Column) -> Column:
        content = F.transform(at, lambda i: F.element_at(w, i))

        # the anchors between content words k - 1 and k each begin a signature with content words k and k + 1
        def chains(c: Column) -> Column:
            def chain(k: Column) -> Column:
                before = F.when(k == 1, F.lit(0)).otherwise(F.element_at(at, F.greatest(k - 1, F.lit(1))))
                gap = F.slice(w, before + 1, F.element_at(at, k) - before - 1)
                return F.transform(gap, lambda a: F.xxhash64(a, F.element_at(c, k), F.element_at(c, k + 1)))

            return F.when(F.size(c) >= 2, F.flatten(F.transform(F.sequence(F.lit(1), F.size(c) - 1), chain))).otherwise(none)

        return bound(content, chains)

    def of_words(w: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: ~F.element_at(w, i).isin(ANCHORS))
        threes = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
        plain = F.when(F.size(w) >= 3, threes).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(none)
        found = F.when(F.size(w) > 0, bound(places, lambda at: spots(w, at))).otherwise(none)
        return bound(found, lambda s: F.when(F.size(s) > 0, s).otherwise(plain))

    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_sort(F.array_distinct(bound(words, of_words)))


def partition(sigs: str) -> Column:
    """Number of a set's length partition."""
    return F.floor(F.log2(F.greatest(F.size(sigs), F.lit(1)).cast("double"))).cast("int")


def likeness(x: str, y: str, least: float = 0.0) -> Column:
    """Jaccard of two sorted signature sets. With ``least``, sets whose lengths rule that likeness out are 0: by their
    length partitions, then by the ratio of the lengths. Without, every likeness is as it is."""
    n, m = F.size(x), F.size(y)
    both = F.size(F.array_intersect(x, y))
    pruned = (F.get(x, n - 1) < F.get(y, F.lit(0))) | (F.get(y, m - 1) < F.get(x, F.lit(0)))
    if least > 0:
        far = F.pow(F.lit(2.0), 1 - F.abs(partition(x) - partition(y))) < F.lit(least)
        pruned = far | (F.least(n, m) < F.greatest(n, m) * F.lit(least)) | pruned
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0) | pruned, F.lit(0.0)).otherwise(both / (n + m - both)).cast("double")


def fingerprint(sigs: str) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s)), 16, "0")), "")


def beside_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and the next document's text and signatures, in order of ids; the last is followed by the first.

    Ids are cut into buckets at quantiles that are ids themselves. The first row of a bucket also goes to the bucket
    before it, and the very first row to the last, so that each bucket finds all its neighbours; texts move once.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    many = max(1, min(MOST_BUCKETS, ids["n"] // IN_BUCKET))
    shares = [k / many for k in range(1, many)]
    found = rows.agg(F.percentile_approx("doc_id", shares, 10 * many).alias("q")).first()["q"] if shares else None
    bounds = sorted({q for q in found or [] if q > ids["least"]})
    kind = docs.schema["doc_id"].dataType.simpleString()
    listed = F.split(F.lit(",".join(map(str, bounds))), ",").cast(f"array<{kind}>") if bounds else F.array().cast(f"array<{kind}>")
    # two steps of a search: the coarse one among every 128th bound
    step = 128
    coarse = F.split(F.lit(",".join(map(str, bounds[::step]))), ",").cast(f"array<{kind}>") if bounds else listed
    block = F.greatest(F.size(F.filter(coarse, lambda q: q <= F.col("doc_id"))) - 1, F.lit(0))
    bucket = block * step + F.size(F.filter(F.slice(listed, block * step + 1, step), lambda q: q <= F.col("doc_id")))
    at_bound = (F.col("bucket") > 0) & (F.element_at(listed, F.greatest(F.col("bucket"), F.lit(1))) == F.col("doc_id"))
    very_first = F.col("doc_id").isNull() if ids["nulls"] else F.col("doc_id") == F.lit(ids["least"])
    place = lambda b, role: F.struct(b.cast("int").alias("b"), F.lit(role).alias("role"))
    places = F.array_compact(
        F.array(place(F.col("bucket"), 0), F.when(at_bound, place(F.col("bucket") - 1, 1)), F.when(very_first, place(F.lit(len(bounds)), 2)))
    )
    dealt = rows.withColumn("bucket", bucket).withColumn("_place", F.explode(places)).select("doc_id", "text", "_place.b", "_place.role")
    dealt = dealt.repartition(max(partitions(docs.sparkSession), 1), "b").withColumn("sigs", signatures(F.col("text")))
    order = Window.partitionBy("b").orderBy("role", "doc_id", "text")
    lead = lambda c: F.lead(c).over(order)
    out = dealt.withColumn("next_text", lead("text")).withColumn("next_sigs", lead("sigs"))
    return out.filter("role = 0").select("doc_id", "text", "sigs", "next_text", "next_sigs")


def compared(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses (0 below ``least``): the rows of ``op1_fingerprints``."""
    n = F.length("text")
    half = "cast(floor(length(text) / 2) as int)"
    edited = F.concat(F.expr(f"substring(text, 1, length(text) - {half})"), F.expr(f"substring(next_text, 1, {half})"))
    rows = beside_next(docs).withColumn("edited", edited)
    rows = rows.withColumn("edited_sigs", signatures(F.col("edited")))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("sigs").alias("fingerprint"), fingerprint("edited_sigs").alias("edited_fingerprint"),
        likeness("sigs", "edited_sigs", least).alias("near_edited"), likeness("sigs", "next_sigs", least).alias("near_next"),
    )


def op1_fingerprints(spark, sf_dir):
    return compared(table(spark, sf_dir, "documents"))
