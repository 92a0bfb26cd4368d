"""Operator 13: phrase collocations from depth-limited count tries.

1. A task counts its documents' runs of one to three words in tries, one per language and shard of ``SHARD`` words. A
   trie is three levels of sorted arrays: words; pairs (word, next word); triples (pair, next word), each with counts.
2. Each trie is cut at common prefixes of two words (quantiles of a sample, which settles only where to cut) and
   serialised, sorted, range by range. A word whose pairs lie in several ranges goes to each of them.
3. All serialised runs of a range meet in one task and are merged: words in byte order, so that the runs stay sorted
   and a merging sort joins them. Walks down the merged trie give the left parts of each phrase and the most
   frequent phrase that it begins; only phrases frequent enough leave the task.
4. Right parts are suffix links: joins of a phrase without its first word, or its last word, with the phrases found.
   Every part of a candidate is at least as frequent as the candidate, so it is among them.
5. Scores are whole quotients of decimals. Places within a language come from a range-sorted table.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows count repeatedly; ties
stand in the order of the phrase's bytes; an empty table gives an empty result; other columns of the input are not
read. Counts up to 10^14 are exact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, numbered, partitions, saved, table, trimmed

LEAST = 10
TOP = 2000
#: A longer phrase of so many hundredths of a phrase's occurrences stands for it.
INSIDE = 50
#: Words of a shard: more than these are not gathered, but for a single longer text.
SHARD = 2_000_000
#: Documents and pairs of each that the ranges' limits are taken from.
SAMPLE, PAIRS = 8192, 16

Limit = tuple[str, bytes, bytes]  # language, first word, second word

_LINES = bytes.maketrans(bytes(range(0x41, 0x5B)) + b".,;:!?\x0a\x0b\x0c\x0d\x09", bytes(range(0x61, 0x7B)) + b"\n" * 10 + b" ")
_ZSTD = pa.Codec("zstd", 1)


def tokens(text: bytes) -> bytes:
    """The words of a text, parted by spaces; a word of one line break between its pieces."""
    return text.translate(_LINES).replace(b"\n", b" \n ")


# --- tries ---------------------------------------------------------------------------------------------------------


class Trie:
    """words: sorted; pairs: first * len(words) + second, sorted; triples: place of the pair * len(words) + third, sorted."""

    def __init__(self, texts: list[bytes]):
        # a last line break, so that there is one to find
        split = pc.split_pattern(pa.array([*texts, b"\n"], pa.large_binary()), " ")
        # a break behind each text
        ends = split.offsets.to_numpy()[1:-1]
        coded = split.values.dictionary_encode()
        found = np.array(coded.dictionary.to_pylist(), object)
        order = np.argsort(found) if len(found) else np.zeros(0, np.int64)
        rank = np.empty(len(found), np.int64)
        rank[order] = np.arange(len(found))
        codes, names = rank[coded.indices.to_numpy()], found[order].tolist()
        stop = names.index(b"\n")
        codes = np.insert(codes[:-1], ends, stop)
        if names[0] == b"":  # between two spaces
            codes, names, stop = codes[codes != 0] - 1, names[1:], stop - 1
        # breaks get the last code, so that words are numbered in a row
        codes = np.where(codes > stop, codes - 1, np.where(codes == stop, len(names) - 1, codes))
        self.words = names[:stop] + names[stop + 1 :]
        n = len(self.words)
        word = codes < n
        self.word_counts = np.bincount(codes[word], minlength=n)
        two = word[:-1] & word[1:]
        at = np.flatnonzero(two)
        self.pairs, node, self.pair_counts = np.unique(codes[at] * max(n, 1) + codes[at + 1], return_inverse=True, return_counts=True)
        on = np.flatnonzero(np.append(two, False)[at + 1])
        self.triples, self.triple_counts = np.unique(node[on] * max(n, 1) + codes[at[on] + 2], return_counts=True)

    def place(self, limit: Limit | None, end: int) -> int:
        """The first pair that isn't before the limit."""
        if limit is None:
            return end
        n, first = len(self.words), bisect_left(self.words, limit[1])
        same = first < n and self.words[first] == limit[1]
        return int(np.searchsorted(self.pairs, first * n + (bisect_left(self.words, limit[2]) if same else 0)))

    def cut(self, low: Limit | None, high: Limit | None) -> bytes | None:
        """What of the trie lies between the limits, serialised; None for nothing."""
        n = len(self.words)
        p, q = self.place(low, 0), self.place(high, len(self.pairs))
        w0 = bisect_left(self.words, low[1]) if low else 0
        w1 = n if high is None else (bisect_right if high[2] else bisect_left)(self.words, high[1])
        if p == q and w0 >= w1:
            return None
        t, u = np.searchsorted(self.triples, [p * n, q * n])
        pairs, triples = self.pairs[p:q], self.triples[t:u]
        first, second, third = pairs // n, pairs % n, triples % n
        used = np.unique(np.concatenate((np.arange(w0, w1), first, second, third)))
        local = lambda x: np.searchsorted(used, x)
        arrays = [
            local(np.arange(w0, w1)), self.word_counts[w0:w1],
            local(first), local(second), self.pair_counts[p:q],
            triples // n - p, local(third), self.triple_counts[t:u],
        ]
        return packed([self.words[i] for i in used.tolist()], arrays)


#: Arrays of a serialised trie that grow: kept as differences.
_RISING = (0, 2, 5)


def packed(words: list[bytes], arrays: list[np.ndarray]) -> bytes:
    """Words and arrays of 32-bit numbers, compressed; numbers by their bytes' places, which lie close in value."""
    numbers = [np.diff(x, prepend=0) if i in _RISING else x for i, x in enumerate(arrays)]
    planes = b"".join(np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in numbers)
    names = b"\n".join(words)
    head = np.array([len(words), len(names), *map(len, arrays)], "<i8").tobytes()
    body = names + planes
    return head + _ZSTD.compress(body, asbytes=True)


def unpacked(blob: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    head = np.frombuffer(blob, "<i8", 10)
    n_words, n_names, sizes = int(head[0]), int(head[1]), head[2:].tolist()
    body = _ZSTD.decompress(blob[80:], decompressed_size=n_names + 4 * sum(sizes), asbytes=True)
    words = body[:n_names].split(b"\n") if n_words else []
    out, at = [], n_names
    for i, n in enumerate(sizes):
        planes = np.frombuffer(body, np.uint8, 4 * n, at).reshape(4, n)
        x = np.ascontiguousarray(planes.T).reshape(-1).view("<i4").astype(np.int64)
        out.append(np.cumsum(x) if i in _RISING else x)
        at += 4 * n
    return words, out


def summed(runs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of sorted runs, their sums, and the place of each key of the runs in a row. The stable sort merges runs."""
    keys, n = np.concatenate(runs), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    firsts = np.flatnonzero(np.diff(keys, prepend=-1))
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(np.diff(keys, prepend=-1) != 0) - 1
    return keys[firsts], np.add.reduceat(n, firsts) if len(firsts) else n, place


def merged(blobs: list[bytes], low: Limit | None, least: int) -> list[tuple]:
    """The frequent phrases of a range: n, phrase, suffix, last, a, left1, left2, inside; a row of n = 0 has the number of words.

    left1 and left2 are the counts of the first word and the first two, inside that of the most frequent candidate
    that the phrase begins. Words that belong to a lower range are only walked through.
    """
    parts = [unpacked(b) for b in blobs]
    words = sorted(set().union(*(p[0] for p in parts)))
    code = {w: i for i, w in enumerate(words)}
    n = max(len(words), 1)
    to = [np.fromiter(map(code.__getitem__, p[0]), np.int64, len(p[0])) for p in parts]
    arrays = [p[1] for p in parts]
    w_keys, w_counts, _ = summed([t[a[0]] for t, a in zip(to, arrays, strict=True)], [a[1] for a in arrays])
    p_keys, p_counts, node = summed([t[a[2]] * n + t[a[3]] for t, a in zip(to, arrays, strict=True)], [a[4] for a in arrays])
    starts = np.cumsum([0, *(len(a[2]) for a in arrays)])
    t_keys, t_counts, _ = summed([node[s + a[5]] * n + t[a[6]] for s, t, a in zip(starts, to, arrays, strict=False)], [a[7] for a in arrays])
    by_word = np.zeros(n, np.int64)
    by_word[w_keys] = w_counts
    out: list[tuple] = []
    own = by_word.copy()
    if low and low[2] and low[1] in code:
        own[code[low[1]]] = 0
    out.append((0, "", None, None, int(own.sum()), None, None, None))
    text = [w.decode("utf-8", "replace") for w in words]
    out += [(1, text[i], None, text[i], int(own[i]), None, None, None) for i in np.flatnonzero(own >= least).tolist()]
    often = t_counts >= least
    parent, third, many = t_keys[often] // n, t_keys[often] % n, t_counts[often]
    inside = np.zeros(len(p_keys), np.int64)
    np.maximum.at(inside, parent, many)
    for i in np.flatnonzero(p_counts >= least).tolist():
        a, b = divmod(int(p_keys[i]), n)
        out.append((2, f"{text[a]} {text[b]}", None, text[b], int(p_counts[i]), int(by_word[a]), None, int(inside[i])))
    for p, c, f in zip(parent.tolist(), third.tolist(), many.tolist(), strict=True):
        a, b = divmod(int(p_keys[p]), n)
        out.append((3, f"{text[a]} {text[b]} {text[c]}", f"{text[b]} {text[c]}", text[c], f, int(by_word[a]), int(p_counts[p]), None))
    return out


# --- jobs ----------------------------------------------------------------------------------------------------------


def limits(docs: DataFrame, ranges: int) -> list[Limit]:
    """Prefixes of two words that cut the corpus into ranges of about equal size, from pairs of a sample of documents."""
    def run(batches):
        for batch in batches:
            out = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = tokens(text.encode()).split(b" ")
                pairs = [(a, b) for a, b in zip(words, words[1:], strict=False) if a and b and b"\n" not in (a, b)]
                out += [(lang, *p) for p in pairs[:: -(-len(pairs) // PAIRS)]] if pairs else []
            columns = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.binary(), pa.binary()), strict=True)], ["lang", "a", "b"])

    share = min(1.0, SAMPLE / max(docs.count(), 1))
    some = docs.filter(F.col("text").isNotNull()).sample(False, share, 13).mapInArrow(trimmed(run), "lang string, a binary, b binary").collect()
    found = sorted((r["lang"], bytes(r["a"]), bytes(r["b"])) for r in some)
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


def tries(docs: DataFrame, cuts: list[Limit], shard: int = SHARD) -> DataFrame:
    """lang, range, trie: each shard's serialised runs."""
    def emitted(held: dict[str, list[bytes]]):
        for lang, texts in held.items():
            trie = Trie(texts)
            # ranges that hold something of the language
            start, stop = bisect_left(cuts, (lang, b"", b"")), bisect_left(cuts, (lang + "\0", b"", b""))
            for k in range(start, stop + 1):
                low = cuts[k - 1] if k > start else None
                high = cuts[k] if k < stop else None
                if blob := trie.cut(low, high):
                    yield lang, k, blob

    def batches_of(rows):
        some = []
        for row in rows:
            some.append(row)
            if len(some) >= 64:
                yield some
                some = []
        if some:
            yield some

    def run(batches):
        def shards():
            held: dict[str, list[bytes]] = {}
            n = 0
            for batch in batches:
                langs = batch.column("lang")
                for at, raw in byte_slices(batch.column("text")):
                    for lang, text in zip(langs.slice(at, len(raw)).to_pylist(), raw, strict=True):
                        line = tokens(text)
                        held.setdefault(lang, []).append(line)
                        n += line.count(b" ") + 1
                    if n >= shard:
                        yield from emitted(held)
                        held, n = {}, 0
            yield from emitted(held)

        for some in batches_of(shards()):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)], ["lang", "range", "trie"])

    return docs.mapInArrow(trimmed(run), "lang string, range int, trie binary")


def frequent(serialised: DataFrame, cuts: list[Limit], ranges: int, least: int) -> DataFrame:
    """The phrases of ``merged`` over all ranges; runs of a range stand together in a task and are merged when the next begins."""
    names = ["lang", "n", "phrase", "suffix", "last", "a", "left1", "left2", "inside"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 4]

    def done(lang: str, k: int, blobs: list[bytes]):
        low = cuts[k - 1] if k and cuts[k - 1][0] == lang else None
        rows = merged(blobs, low, least)
        for i in range(0, len(rows), 50_000):
            columns = list(zip(*rows[i : i + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(columns[0]), kinds[0]), *(pa.array(c, t) for c, t in zip(columns, kinds[1:], strict=True))], names)

    def run(batches):
        now, held = None, []
        for batch in batches:
            for lang, k, blob in zip(*(batch.column(c).to_pylist() for c in ("lang", "range", "trie")), strict=True):
                if now != (lang, k):
                    if held:
                        yield from done(*now, held)
                    now, held = (lang, k), []
                held.append(blob)
        if held:
            yield from done(*now, held)

    dealt = serialised.repartition(ranges, "range", "lang").sortWithinPartitions("range", "lang")
    return dealt.mapInArrow(trimmed(run), "lang string, n int, phrase string, suffix string, last string, a long, left1 long, left2 long, inside long")


def quotient(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exactly: the product needs more than 64 bits, the quotient doesn't."""
    big = lambda x: x.cast("decimal(14,0)")
    return F.call_function("div", big(a) * big(a) * F.lit(1_000_000).cast("decimal(7,0)"), big(left) * big(right))


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, shard: int = SHARD) -> DataFrame:
    """All phrases that stand: lang, phrase, a, l, r, n, score."""
    docs = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    ranges = partitions(docs.sparkSession)
    cuts = limits(docs, ranges)
    found = saved(frequent(tries(docs, cuts, shard), cuts, ranges, least))
    sizes = found.filter("n = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    words = found.filter("n = 1").select("lang", "last", F.col("a").alias("right1"))
    pairs, triples = found.filter("n = 2"), found.filter("n = 3")
    # suffix links: a triple's right part, and the most frequent triple that a pair ends
    linked = triples.join(pairs.select("lang", F.col("phrase").alias("suffix"), F.col("a").alias("right2")), ["lang", "suffix"])
    ended = triples.groupBy("lang", F.col("suffix").alias("phrase")).agg(F.max("a").alias("ended"))
    apart = pairs.join(ended, ["lang", "phrase"], "left").filter(100 * F.greatest("inside", F.coalesce("ended", F.lit(0))) < inside * F.col("a"))
    columns = ["lang", "phrase", "last", "a", "left1", "left2"]
    both = apart.select(*columns, F.lit(None).cast("long").alias("right2")).unionByName(linked.select(*columns, "right2")).join(words, ["lang", "last"])
    # of a pair the one cut, of a triple the lower of two
    cut = lambda left, right: F.struct(F.col(left).alias("l"), F.col(right).alias("r"), quotient(F.col("a"), F.col(left), F.col(right)).alias("score"))
    first, second = cut("left1", "right2"), cut("left2", "right1")
    best = F.when(F.col("right2").isNull(), cut("left1", "right1")).when(first["score"] <= second["score"], first).otherwise(second)
    scored = both.select("lang", "phrase", "a", best.alias("cut")).select("lang", "phrase", "a", "cut.*")
    return scored.join(sizes, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def ranked(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first phrases of each language, with their rank."""
    placed = numbered(saved(phrases), [F.desc("score"), F.desc("a"), F.asc("phrase")], "rank", "lang")
    return placed.filter(F.col("rank") <= top)


#: The same in SQL, for tables of some megabytes.
ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), listed AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), runs AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed
), grams AS (
  SELECT lang, 1 AS k, w[i] AS p FROM runs
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM runs WHERE i < len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM runs WHERE i + 1 < len(w)
), f AS (
  SELECT lang, k, p, count(*) AS a FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), often AS (
  SELECT *, string_split(p, ' ') AS s FROM f WHERE a >= 10
), three AS (
  SELECT *, s[1] || ' ' || s[2] AS head, s[2] || ' ' || s[3] AS tail FROM often WHERE k = 3
), longest AS (
  SELECT lang, p, max(a) AS a FROM (SELECT lang, head AS p, a FROM three UNION ALL SELECT lang, tail, a FROM three) GROUP BY ALL
), cuts AS (
  SELECT o.lang, o.p, o.a, 1 AS c, o.s[1] AS x, o.s[2] AS y FROM often o LEFT JOIN longest g ON o.lang = g.lang AND o.p = g.p WHERE o.k = 2 AND 100 * coalesce(g.a, 0) < 50 * o.a
  UNION ALL SELECT lang, p, a, 1, s[1], tail FROM three
  UNION ALL SELECT lang, p, a, 2, head, s[3] FROM three
), scored AS (
  SELECT c.lang, c.p, c.a, c.c, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN often x ON c.lang = x.lang AND c.x = x.p JOIN often y ON c.lang = y.lang AND c.y = y.p
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, c) AS nth FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM best WHERE nth = 1
)
SELECT ranked.lang, rank, p AS phrase, a, l, r, n, score FROM ranked JOIN totals ON ranked.lang = totals.lang WHERE rank <= 2000
"""


def op13_collocations(spark, sf_dir):
    return ranked(collocations(table(spark, sf_dir, "documents"))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
