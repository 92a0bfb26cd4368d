"""Operator 2: best-fit packing by linear grouping.

Documents are tokenised and cut once, in tasks. What is packed is then only a histogram of piece lengths (at most
``SEQUENCE`` entries, whatever the corpus), so the plan is made on the driver and its size doesn't grow with the data:

1. lengths above a threshold are sorted and split into groups of equal cardinality; each is rounded up to its group's
   longest length;
2. the few-size problem is solved by column generation over configurations, rounded down to whole sequences;
3. the actual lengths are substituted for the rounded ones, group by group;
4. what is left over, and all small lengths, go longest first to the sequence class with the tightest room.

Low thresholds use configurations of many sizes, high ones leave more to best fit; each threshold in ``SMALL`` is
planned and the plan of fewest sequences kept. All steps work on runs (a length, a number of pieces), and give placements: the pieces of a length with rank r0 to
r0 + n stand k to a sequence from sequence s0 on. Each piece finds its placement by its length and its rank among the
pieces of that length; ranks come from counts per (length, bucket), so no length is ranked in one task.

Defined cases: a null or empty text is one piece with only the closing id; repeated rows are packed separately; an
empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict, deque
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, partitions, saved, table, trimmed

SEQUENCE = 2048
#: Thresholds between large and small lengths; each gives a plan, and the one of fewest sequences is taken.
SMALL = (SEQUENCE // 3, 9 * SEQUENCE // 20, SEQUENCE // 2)
GROUPS = 32
#: Pieces of one length are ranked in so many independent buckets, or as many as there are partitions.
BUCKETS = 64
#: Chunks whose ids a worker remembers; beyond, half of them are forgotten, so memory stays bounded.
MEMO = 150_000
#: Bytes of texts that are cut into chunks at once.
SLICE = 600_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _marked(*ranges: tuple[int, int]) -> np.ndarray:
    """A table over bytes: those within the ranges, ends included."""
    held = np.zeros(256, bool)
    for low, high in ranges:
        held[low : high + 1] = True
    return held


_LETTER = _marked((0x41, 0x5A), (0x61, 0x7A))
_GRAPH = _marked((0x21, 0x7E))
_OTHER = _marked((0x00, 0x7F)) & ~_LETTER
#: Bytes that begin a character that surely isn't white space: beyond ASCII, that of C2 and E1 to E3 may be.
_SOLID = _GRAPH | _marked((0xC3, 0xE0), (0xE4, 0xF4))
#: A space in the letters of a byte-level vocabulary.
_SPACE = "\u0120".encode()


def beginnings(text: np.ndarray) -> np.ndarray:
    """Where pre-tokens surely begin in UTF-8, whatever stands around, as marks on bytes.

    A space before a character that isn't white space begins one; so does what follows an ASCII letter and is none, and a
    letter after a line feed that has no white space before it. A chunk between such places has the same ids alone.
    """
    marks = np.zeros(len(text), bool)
    letter = _LETTER[text]
    marks[:-1] = (text[:-1] == 0x20) & _SOLID[text[1:]]
    marks[1:] |= letter[:-1] & _OTHER[text[1:]]
    marks[2:] |= _GRAPH[text[:-2]] & (text[1:-1] == 0x0A) & letter[2:]
    return marks


class TokenIds:
    """The ids of texts by tokenizers, with the ids of chunks remembered.

    A text's ids are those of its chunks (``beginnings``) in a row. A slice's distinct chunks are found in Arrow, and the
    unknown ones are encoded together and told apart by the bytes that each id stands for. A text that holds an added
    token, which has an id of its own within plain text too, is one chunk.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokens = Tokenizer.from_file(str(path))
        added = self.tokens.get_added_tokens_decoder()
        self.added = [t.content.encode() for t in added.values()]
        self.fewest = min(map(len, self.added), default=64)
        # in a byte-level vocabulary a token has a character for each byte
        self.width = np.zeros(max([*self.tokens.get_vocab(True).values(), 0]) + 1, np.int64)
        for token, i in self.tokens.get_vocab(True).items():
            self.width[i] = len(added[i].content.encode() if i in added else token)
        # chunk 0 is what closes a document: id 0
        self.known: dict[bytes, int] = {}
        self.ids, self.count = np.zeros(1, np.uint32), np.ones(1, np.int64)

    def encoded(self, texts: list[str], some: int = 1024) -> list[np.ndarray]:
        """So many texts at once: an encoding holds far more than its ids."""
        parts = (texts[i : i + some] for i in range(0, len(texts), some))
        return [np.array(e.ids, np.uint32) for part in parts for e in self.tokens.encode_batch_fast(part, add_special_tokens=False)]

    def together(self, chunks: list[bytes], words: bool = False, some: int = 2048) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, how many each chunk has) of chunks that are written one after the other.

        ``words`` are ASCII letters, with a space before them or not, and so a pre-token each: they are handed over in the
        vocabulary's own letters, line by line, without the search for pre-tokens, which is dearer than all else.
        """
        from tokenizers import pre_tokenizers

        usual, out = self.tokens.pre_tokenizer, []
        if words:
            self.tokens.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        for i in range(0, len(chunks), some):
            part = chunks[i : i + some]
            text = b"\n".join(part).replace(b" ", _SPACE) if words else b"".join(part)
            (ids,) = self.encoded([text.decode()])
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
            at = np.concatenate(([0], np.cumsum(self.width[ids])))
            last = np.minimum(np.searchsorted(at, ends), len(ids))
            if at[-1] != ends[-1] or (at[last] != ends).any():
                raise ValueError("the vocabulary's tokens don't stand for bytes")
            out.append((ids, np.diff(last, prepend=0)))
        if words:
            self.tokens.pre_tokenizer = usual
        return out

    def numbers(self, chunks: list[bytes]) -> np.ndarray:
        """The chunks' numbers in ``count``; chunks that aren't known are encoded. Long ones come last and aren't remembered."""
        found = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        words, led, single, long = [], [], [], []
        for i in np.flatnonzero(found < 0).tolist():
            c = chunks[i]
            if len(c) >= 64 or (self.fewest <= len(c) and any(t in c for t in self.added)):
                long.append(i)
            elif c.isalpha() or (c[0] == 0x20 and c[1:].isalpha()):
                words.append(i)
            elif c[0] == 0x20 and len(c) > 1 and _SOLID[c[1]]:
                led.append(i)
            else:
                single.append(i)
        new = self.together([chunks[i] for i in words], words=True) + self.together([chunks[i] for i in led])
        new += [(ids, np.array([len(ids)])) for ids in self.encoded([chunks[i].decode() for i in single + long])]
        order, n = words + led + single + long, len(self.count)
        found[order] = np.arange(n, n + len(order))
        self.known.update((chunks[i], n + k) for k, i in enumerate(words + led + single))
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in new)])
        self.count = np.concatenate([self.count, *(many for _, many in new)])
        return found

    def shorten(self) -> None:
        """Ids only of what is remembered."""
        self.count = self.count[: len(self.known) + 1]
        self.ids = self.ids[: self.count.sum()]

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text's closed by id 0, and each text's end there."""
        if len(self.known) >= MEMO:  # what was met first is mostly what is frequent
            self.known = dict(islice(self.known.items(), MEMO // 2))
            self.shorten()
        joined = b"".join(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        begins = np.concatenate(([0], ends[:-1]))
        marks = beginnings(np.frombuffer(joined, np.uint8))
        if any(t in joined for t in self.added):
            for text, begin, end in zip(texts, begins.tolist(), ends.tolist(), strict=True):
                if any(t in text for t in self.added):
                    marks[begin:end] = False
        marks[begins[begins < ends]] = True
        at = np.flatnonzero(marks)
        places = [None, pa.py_buffer(np.append(at, len(joined))), pa.py_buffer(joined)]
        coded = pa.Array.from_buffers(pa.large_binary(), len(at), places).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes microseconds for each
        numbers = self.numbers(distinct)[coded.indices.to_numpy()]
        closing = np.searchsorted(at, ends)
        numbers = np.insert(numbers, closing, 0)
        count, first = self.count[numbers], (np.cumsum(self.count) - self.count)[numbers]
        upto = np.cumsum(count)
        ids = self.ids[np.repeat(first - upto + count, count) + np.arange(upto[-1])]
        self.shorten()
        return ids, upto[closing + np.arange(len(texts))]


def cut(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Tokenise whole texts, add id 0, and cut: doc_id, piece, start, length, ids_crc32. Only the first piece may be shorter."""
    path = path or vocabulary_path()

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        ids_of = TokenIds(path)
        for batch in batches:
            out = []
            for at, raw in byte_slices(batch.column("text"), SLICE):
                doc_ids = batch.column("doc_id").slice(at, len(raw)).to_pylist()
                ids, ends = ids_of.of(raw)
                before = 0
                for doc_id, upto in zip(doc_ids, ends.tolist(), strict=True):
                    n = upto - before
                    start, end = 0, (n - 1) % sequence + 1
                    for piece in range(-(-n // sequence)):
                        out.append((doc_id, piece, start, end - start, zlib.crc32(ids[before + start : before + end])))
                        start, end = end, end + sequence
                    before = upto
            kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*out, strict=True) if out else ([] for _ in names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# --- the plan over the histogram ---------------------------------------------------------------------------------


def grouped(histogram: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, count), longest first, in groups of equal cardinality."""
    total, out, room = sum(histogram.values()), [], 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not room:
                out.append([])
                room = -(-total // groups)
            n = min(left, room)
            out[-1].append((length, n))
            left, room = left - n, room - n
    return out


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes of most value within the capacity: an unbounded knapsack."""
    worth, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    least = int(sizes.min())
    for room in range(least, capacity + 1):
        fits = sizes <= room
        gain = np.where(fits, worth[room - np.minimum(sizes, room)] + values, -1.0)
        k = int(gain.argmax())
        worth[room], chosen[room] = (worth[room - 1], -1) if worth[room - 1] >= gain[k] else (gain[k], k)
    out, room = np.zeros(len(sizes)), capacity
    while room >= least:
        if chosen[room] < 0:
            room -= 1
        else:
            out[chosen[room]] += 1
            room -= int(sizes[chosen[room]])
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Few-size packing as a linear program by column generation: (how many of each size, how often)."""
    size, need = np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // size).astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        column = best_configuration(size, np.maximum(inverse.sum(0), 0), capacity)
        if inverse.sum(0) @ column <= 1 + 1e-7:
            break
        level, change = inverse @ need, inverse @ column
        ratio = np.where(change > 1e-9, np.maximum(level, 0) / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    return list(zip(basis.T, np.maximum(np.linalg.solve(basis, need), 0), strict=True))


def plan(histogram: dict[int, int], sequence: int = SEQUENCE, thresholds=SMALL, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """The best of the plans for the thresholds; stops at one that leaves no sequence to save."""
    least, best = -(-sum(k * v for k, v in histogram.items()) // sequence), None
    for small in thresholds:
        found = plan_above(histogram, sequence, small, groups)
        best = found if best is None or found[1] < best[1] else best
        if best[1] <= least:
            break
    return best


def plan_above(histogram: dict[int, int], sequence: int, small: int, groups: int) -> tuple[np.ndarray, int]:
    """Placements (length, first rank, pieces, pieces per sequence, first sequence, offset) and the number of sequences."""
    placed: list[tuple[int, int, int, int, int, int]] = []
    rank: dict[int, int] = defaultdict(int)
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs of sequences (first, how many)
    opened = 0

    def put(length: int, pieces: int, each: int, first: int, used: int) -> None:
        placed.append((length, rank[length], pieces, each, first, used))
        rank[length] += pieces

    left = dict(histogram)
    whole = left.pop(sequence, 0)
    if whole:
        put(sequence, whole, 1, 0, 0)
        opened = whole
    runs = grouped({k: v for k, v in left.items() if k > small}, groups)
    queues = [deque(r) for r in runs]
    for column, level in configurations([r[0][0] for r in runs], [sum(n for _, n in r) for r in runs], sequence) if runs else []:
        slots = [(g, int(k)) for g, k in enumerate(column) if k > 0.5]
        many = int(level + 1e-9)
        while many > 0 and all(sum(n for _, n in queues[g]) >= k for g, k in slots):
            batch = min(many, *(max(1, queues[g][0][1] // k) for g, k in slots)) if slots else 0
            used = 0
            for g, k in slots:
                if queues[g][0][1] >= k * batch:
                    length, n = queues[g].popleft()
                    if n > k * batch:
                        queues[g].appendleft((length, n - k * batch))
                    put(length, k * batch, k, opened, used)
                    used += k * length
                else:  # batch is 1: the sequence takes pieces of neighbouring lengths
                    for _ in range(k):
                        length, n = queues[g].popleft()
                        if n > 1:
                            queues[g].appendleft((length, n - 1))
                        put(length, 1, 1, opened, used)
                        used += length
            rooms[sequence - used].append((opened, batch))
            opened, many = opened + batch, many - batch
    rest: dict[int, int] = {k: v for k, v in left.items() if k <= small}
    for q in queues:
        for length, n in q:
            rest[length] = rest.get(length, 0) + n
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            room = next((r for r in range(length, sequence + 1) if rooms.get(r)), 0)
            if room:
                first, bins = rooms[room].pop()
            else:
                room, first, bins = sequence, opened, -(-n // (sequence // length))
                opened += bins
            each = room // length
            full = min(bins, n // each)
            if full:
                put(length, full * each, each, first, sequence - room)
                rooms[room - each * length].append((first, full))
                n, first, bins = n - full * each, first + full, bins - full
            if n and bins and n < each:
                put(length, n, n, first, sequence - room)
                rooms[room - n * length].append((first, 1))
                n, first, bins = 0, first + 1, bins - 1
            if bins:
                rooms[room].append((first, bins))
    return np.array(placed, np.int64).reshape(-1, 6), opened


# --- from the plan to rows ----------------------------------------------------------------------------------------


def place(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to the rows of ``cut``. ``pieces`` is read more than once and should be a written table."""
    buckets = max(BUCKETS, partitions(pieces.sparkSession))
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = saved(keyed.groupBy("length", "_bucket").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `sequence` rows
    placements, _ = plan(histogram, sequence)
    order = np.lexsort((placements[:, 1], placements[:, 0]))
    placements = placements[order]
    # one sorted key for (length, rank): lengths' ranks follow each other
    lengths = np.array(sorted(histogram), np.int64)
    base = np.concatenate(([0], np.cumsum([histogram[int(x)] for x in lengths])))[:-1].astype(np.int64)
    starts = base[np.searchsorted(lengths, placements[:, 0])] + placements[:, 1]

    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, ["length", "_bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_rank")).alias("_rank"))

    names = pieces.columns

    def run(batches):
        for b in batches:
            length, r = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            at = placements[np.searchsorted(starts, base[np.searchsorted(lengths, length)] + r, "right") - 1]
            nth = r - at[:, 1]
            sequence_id, offset = at[:, 4] + nth // at[:, 3], at[:, 5] + nth % at[:, 3] * length
            kept = b.select(names)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence_id), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(trimmed(run), f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pack all documents: a row per piece with its sequence and its place there."""
    return place(saved(cut(docs, path)))


def op2_pack_sequences(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
