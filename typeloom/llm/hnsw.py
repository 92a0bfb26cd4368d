"""Operator 6: approximate nearest neighbours by one navigable small-world graph per shard.

Equal vectors are collapsed to one with their smallest ids (one more than can be asked for, so nothing is lost).
Distinct vectors are dealt to shards by hash; the number of shards grows with the square root of the table until a
shard holds ``MOST`` vectors. A shard's index is a hierarchy of layers: each vector is on layer 0 and on a further one
with probability 1/16. A layer is built by insertion: batches of vectors search the graph so far with a beam, from
what the layer above gives as nearest, and are linked to near ones that are spread in direction (one is taken if it is
nearer to the vector than to those already taken); links are made two-way and cut to the layer's degree, nearest
first. Links are flat integer arrays, one row of a table per shard.

A search looks at all vectors of the highest layers down to one of at most ``ENTRY``, and holds a beam on each layer
below; a block of queries goes in step. Queries go in blocks to every shard: a task reads a shard once and then the
blocks of its part. The shards' results are merged by window, and scores are computed in double precision from the
original values. Recall against brute force, measured in the tests on full shards: see the README.

Inner-product search is made a nearest-neighbour search by one more coordinate that gives all vectors of a shard the
same length.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, take no part, nor do null
ids; only vectors of equal dimension meet; rows that repeat an id with the same vector are one, as candidates
and as queries; those with other vectors are candidates of their own, but never for their own id, and queries that
share the places of their id; fewer candidates than asked for are all returned if
found; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, saved, table, trimmed

NEIGHBOURS = 20
#: Vectors of a shard: a table of n has sqrt(n / SHARD) shards, and none holds more than MOST but by chance of the hash:
#: the largest size at which the beam was measured to find 0.9 of the nearest on vectors of any length.
SHARD, MOST = 4096, 12_800
#: Queries of a block, and blocks that one task reads a shard for.
BLOCK, BLOCKS = 256, 6
DEGREE = 64
#: Vectors held by a search for neighbours while a graph is built, and for queries.
BUILD_BEAM, BEAM = 64, 224
#: Vectors of a layer at most that a search looks at as a whole; vectors inserted at once.
ENTRY, INSERT = 4096, 512


def valid(rows: DataFrame, column: str) -> DataFrame:
    """vec_id and v, in double precision, of the rows that take part."""
    v = F.transform(column, lambda x: x.cast("double"))
    usable = F.col(column).isNotNull() & (F.size(column) > 0)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(usable & F.col("vec_id").isNotNull()).select("vec_id", v.alias("v")).filter(F.coalesce(finite, F.lit(False)))
    return rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 and 0.0 are equal


def distinct_vectors(rows: DataFrame, column: str, k: int) -> DataFrame:
    """key, v, ids: each distinct valid vector with its k + 1 smallest ids."""
    rows = valid(rows, column)
    # rows that repeat an id with the same vector go first, for they would take places of other ids
    rows = rows.withColumn("key", F.sha2(F.to_json(F.struct("v")).cast("binary"), 256)).dropDuplicates(["key", "vec_id"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    # the smallest ids in two steps, so that no common vector meets in one task
    for keys in (["key", "salt"], ["key"]):
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).filter(F.col("n") <= k + 1).drop("n")
    return rows.groupBy("key").agg(F.first("v").alias("v"), F.sort_array(F.collect_set("vec_id")).alias("ids"))


def lifted(x: np.ndarray) -> np.ndarray:
    """One more coordinate, so that all rows have the longest row's length: order by distance is then order by inner product."""
    squares = (x * x).sum(1)
    return np.column_stack([x, np.sqrt(np.maximum(squares.max() - squares, 0))]).astype(np.float32)


def walk(x: np.ndarray, graph: np.ndarray, q: np.ndarray, starts: np.ndarray, beam: int, many: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Beam search on one layer from each query's ``starts``: numbers (-1 where fewer) and scores, best first.

    What has fallen out of a beam can't come back, for the beam's least score only rises; so no list of visited vectors
    is needed, and memory doesn't grow with the shard.
    """
    beam = max(beam, starts.shape[1])
    ids = np.full((len(q), beam), -1)
    held, done = np.full((len(q), beam), -np.inf, np.float32), np.zeros((len(q), beam), bool)
    ids[:, : starts.shape[1]] = starts
    held[:, : starts.shape[1]] = np.where(starts >= 0, np.einsum("qd,qnd->qn", q, x[starts]), -np.inf)
    a = np.arange(len(q))
    while len(a):
        open_ = np.where(done[a] | (ids[a] < 0), -np.inf, held[a])
        pick = np.argpartition(-open_, many - 1, 1)[:, :many] if open_.shape[1] > many else np.tile(np.arange(open_.shape[1]), (len(a), 1))
        usable = np.isfinite(np.take_along_axis(open_, pick, 1))
        alive = usable.any(1)
        a, pick, usable = a[alive], pick[alive], usable[alive]
        if not len(a):
            break
        done[a[:, None], pick] |= usable
        near = np.where(usable[:, :, None], graph[ids[a[:, None], pick]], -1).reshape(len(a), -1)
        gain = np.where(near >= 0, np.einsum("qd,qnd->qn", q[a], x[near]), -np.inf)
        every, scores = np.column_stack([ids[a], near]), np.column_stack([held[a], gain])
        flags = np.column_stack([done[a], np.zeros(near.shape, bool)])
        # of equal numbers the first stays, which is the one already held
        by_id = np.argsort(every, 1, kind="stable")
        ordered = np.take_along_axis(every, by_id, 1)
        again = np.zeros(every.shape, bool)
        np.put_along_axis(again, by_id, np.column_stack([np.zeros(len(a), bool), ordered[:, 1:] == ordered[:, :-1]]), 1)
        scores[again] = -np.inf
        top = np.argpartition(-scores, beam - 1, 1)[:, :beam]
        held[a] = np.take_along_axis(scores, top, 1)
        ids[a] = np.where(np.isfinite(held[a]), np.take_along_axis(every, top, 1), -1)
        done[a] = np.take_along_axis(flags, top, 1)
    order = np.argsort(-held, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(held, order, 1)


def spread(x: np.ndarray, own: np.ndarray, ids: np.ndarray, scores: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates, best first, those that are nearer to the row's vector than to any taken before, up to ``degree``; the rest of the places go to the best that are left."""
    between = np.einsum("qad,qbd->qab", x[ids], x[ids])
    usable = (ids >= 0) & np.isfinite(scores) & (ids != own[:, None])
    taken = np.zeros(ids.shape, bool)
    for c in range(ids.shape[1]):
        blocked = (taken[:, :c] & (between[:, c, :c] > scores[:, c : c + 1])).any(1)
        taken[:, c] = usable[:, c] & ~blocked & (taken[:, :c].sum(1) < degree)
    rank = np.where(taken, 0, np.where(usable, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
    first = np.argsort(rank, 1)[:, :degree]
    return np.where(np.take_along_axis(usable, first, 1), np.take_along_axis(ids, first, 1), -1)


def link(x: np.ndarray, graph: np.ndarray, new: np.ndarray, to: np.ndarray) -> None:
    """Enter links from ``new`` to the rows of ``to`` into the graph, both ways; a full row keeps its nearest."""
    degree = graph.shape[1]
    graph[new, : to.shape[1]] = to
    i, j = np.nonzero(to >= 0)
    touched, at = np.unique(to[i, j], return_inverse=True)
    order = np.argsort(at, kind="stable")
    counts = np.bincount(at)
    place = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
    for first in range(0, counts.max(initial=0), degree):  # so many newcomers at once
        some = (place >= first) & (place < first + degree)
        more = np.full((len(touched), degree), -1)
        more[at[order[some]], place[some] - first] = new[i[order[some]]]
        every = np.column_stack([graph[touched], more])
        scores = np.where(every >= 0, np.einsum("qd,qnd->qn", x[touched], x[every]), -np.inf)
        best = np.argsort(-scores, 1, kind="stable")[:, :degree]
        graph[touched] = np.where(np.isfinite(np.take_along_axis(scores, best, 1)), np.take_along_axis(every, best, 1), -1)


def entries(x: np.ndarray, levels: np.ndarray, graphs: dict[int, np.ndarray], q: np.ndarray, above: int, beam: int) -> np.ndarray:
    """The best vectors of the layers from the top down to ``above``: one layer as a whole, beams on those below it."""
    sizes = [int((levels >= k).sum()) for k in range(levels.max() + 2)]
    scanned = next(k for k in range(above, len(sizes)) if sizes[k] <= ENTRY)
    members = np.flatnonzero(levels >= scanned)
    scores = q @ x[members].T
    n = min(beam, len(members))
    starts = members[np.argpartition(-scores, n - 1, 1)[:, :n]] if n else np.full((len(q), 1), -1)
    for k in range(scanned - 1, above - 1, -1):
        starts = walk(x, graphs[k], q, starts, beam)[0]
    return starts


def build(vectors: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The layers' links, lowest first, as one flat array of shape (layers, n, DEGREE), and each vector's highest layer."""
    x = lifted(vectors)
    draws = (mixed(keys.astype(np.uint64)) >> np.uint64(11)).astype(float) / 2.0**53
    levels = np.floor(-np.log(np.maximum(draws, 1e-18)) / np.log(16)).astype(int)
    graphs: dict[int, np.ndarray] = {}
    top = int(levels.max())
    for k in range(top, -1, -1):
        graphs[k] = graph = np.full((len(x), DEGREE), -1, np.int32)
        degree = DEGREE // 2
        # what is on the layer above goes first: it is where searches begin
        members = np.flatnonzero(levels >= k)
        members = members[np.argsort(-levels[members], kind="stable")]
        for at in range(0, len(members), INSERT):
            new = members[at : at + INSERT]
            peers = x[new] @ x[new].T
            np.fill_diagonal(peers, -np.inf)
            n = min(BUILD_BEAM, len(new))
            mine = np.argpartition(-peers, n - 1, 1)[:, :n]
            ids, scores = new[mine], np.take_along_axis(peers, mine, 1)
            if at:
                starts = entries(x, np.where(np.isin(np.arange(len(x)), members[:at]), levels, -1), graphs, x[new], k + 1, 8)
                starts = np.where((starts < 0).all(1, keepdims=True), members[0], starts)
                found, gain = walk(x, graph, x[new], starts, BUILD_BEAM)
                ids, scores = np.column_stack([found, ids]), np.column_stack([gain, scores])
            best = np.argsort(-scores, 1, kind="stable")[:, :BUILD_BEAM]
            link(x, graph, new, spread(x, new, np.take_along_axis(ids, best, 1), np.take_along_axis(scores, best, 1), degree))
    return np.stack([graphs[k] for k in range(top + 1)]), levels.astype(np.int32)


def search(vectors: np.ndarray, links: np.ndarray, levels: np.ndarray, queries: np.ndarray, k: int, beam: int = BEAM) -> np.ndarray:
    """Per query the k best found, as vector numbers (-1 where fewer), best first by inner product."""
    x, q = vectors.astype(np.float32), queries.astype(np.float32)
    starts = entries(x, levels, dict(enumerate(links)), q, 1, beam // 2)
    starts = np.where((starts < 0).all(1, keepdims=True), 0, starts)
    return walk(x, links[0], q, starts, min(max(beam, k), max(len(x), 1)))[0][:, :k]


def indexes(found: DataFrame) -> DataFrame:
    """One row per shard and dimension: its vectors, ids, levels and links as bytes."""
    shards = F.greatest(F.ceil(F.sqrt(F.col("n") / SHARD)), F.ceil(F.col("n") / MOST))
    sizes = found.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).withColumn("shards", shards).drop("n")
    dealt = found.withColumn("dim", F.size("v")).join(F.broadcast(sizes), "dim")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int")).select("dim", "shard", "key", "v", "ids")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", ignore_index=True)
        x = np.stack(rows["v"].to_numpy())
        links, levels = build(x, np.array([int(k[:16], 16) for k in rows["key"]], np.uint64))
        ids = rows["ids"].tolist()
        return pd.DataFrame(
            {
                "dim": [rows["dim"][0]], "shard": [rows["shard"][0]], "n": [len(rows)], "vectors": [x.tobytes()], "links": [links.astype(np.int32).tobytes()], "levels": [levels.tobytes()],
                "ids": [np.concatenate(ids).astype(np.int64).tobytes()], "counts": [np.array([len(i) for i in ids], np.int32).tobytes()],
            }
        )

    return dealt.groupBy("dim", "shard").applyInPandas(run, "dim int, shard int, n int, vectors binary, links binary, levels binary, ids binary, counts binary")


class Shard:
    """A shard's index, read from its row."""

    def __init__(self, row: dict):
        self.x = np.frombuffer(row["vectors"]).reshape(row["n"], row["dim"])
        self.links, self.levels = np.frombuffer(row["links"], np.int32).reshape(-1, row["n"], DEGREE), np.frombuffer(row["levels"], np.int32)
        self.ids, self.counts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.int32)
        self.firsts = np.concatenate(([0], np.cumsum(self.counts)))

    def best(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
        """query_id, vec_id, score of the k nearest found for each query."""
        found = search(self.x, self.links, self.levels, q, k + 1)
        i, j = np.nonzero(found >= 0)
        at = found[i, j]
        score = np.einsum("nd,nd->n", q[i], self.x[at])
        times = self.counts[at]
        member = np.repeat(self.firsts[at], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        out = pd.DataFrame({"query_id": np.repeat(q_ids[i], times), "vec_id": self.ids[member], "score": np.repeat(score, times)})
        out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        # an id whose rows differ asks, and is found, more than once
        return out.drop_duplicates(["query_id", "vec_id"]).groupby("query_id").head(k)


def nearest(rows: DataFrame, queries: DataFrame, column: str = "embedding", k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score for the vectors of ``queries`` among all of ``rows``."""
    built = saved(indexes(saved(distinct_vectors(rows, column, k))))
    asked = valid(queries, column).select("v", F.col("vec_id").alias("query_id")).dropDuplicates(["query_id", "v"]).withColumn("dim", F.size("v"))
    count = asked.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = asked.join(F.broadcast(count), "dim").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [group["dim"][0]], "block": [group["block"][0]], "q_ids": [group["query_id"].to_numpy(np.int64).tobytes()], "q": [np.stack(group["v"].to_numpy()).tobytes()]})

    blocked = blocks.select("dim", "block", "query_id", "v").groupBy("dim", "block").applyInPandas(packed, "dim int, block int, q_ids binary, q binary")
    # a shard goes to each part of the blocks, ahead of them; a block to every shard
    parts = F.broadcast(count.select("dim", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / BLOCKS).cast("int"))).alias("part")))
    shards = F.broadcast(built.groupBy("dim").agg(F.max("shard").alias("last")))
    asks = blocked.join(shards, "dim").withColumn("part", F.floor(F.col("block") / BLOCKS).cast("int")).select("dim", "part", F.explode(F.sequence(F.lit(0), "last")).alias("shard"), "block", "q_ids", "q")
    both = built.join(parts, "dim").withColumn("block", F.lit(-1)).unionByName(asks, allowMissingColumns=True)
    dealt = both.repartition("dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "block")

    def run(batches):
        shard = None
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if r["block"] < 0:
                    shard = Shard(r)
                    continue
                out = shard.best(np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q"]).reshape(-1, r["dim"]), k)
                yield pa.RecordBatch.from_pandas(out, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]), preserve_index=False)

    found = dealt.mapInArrow(trimmed(run), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter(F.col("vec_id") % 20 == 0))
