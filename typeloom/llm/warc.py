"""Operator 10: WARC archives and an external merge of their index.

Writing: equal payloads are found by their SHA-256; the smallest page_id of each is the response, the others are
revisits that refer to it. Only ids and digests meet for that; payloads go from the table to the archives at once
where the revisits are few enough to be sent to all tasks, by one shuffle otherwise. Archives are gzipped WARC/1.1
files of bounded size that Spark's text sink writes, with the records' closing CRLF CRLF as line separator, so any
file system that Spark knows will do; a whole archive is one gzip member, as that sink compresses files, not records.

Reading: every archive is parsed by its Content-Length fields into an index run that is sorted locally by URL key,
timestamp and page_id; the runs are written as a table. Ranges of keys, of about ``RANGE`` rows each however large the
table, are dealt to tasks; each task merges the runs' slices of its range with a loser tree that holds a block of each
run, which gives globally ordered capture histories. A revisit takes its payload's size and digest from its own
headers.

Defined cases: a null html is an empty payload; a null url has an empty URL key; a null page_id is written as such and
counts as larger than all others; rows that repeat a page_id are records of their own, of which those that equal the
response's id and payload are responses too; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, saved, shared_dir, table, trimmed

END = "\r\n\r\n"
#: Captures have no time of their own in a table without one; they get this one.
CAPTURED = "2024-01-01T00:00:00Z"
#: Bytes of payload that an archive holds, about.
ARCHIVE = 8_000_000
#: Index rows that a task merges, about, and rows of a run that are looked at together.
RANGE, BLOCK = 100_000, 1024
#: Revisits whose ids and digests may be sent to all executors: some 30 MB.
SENT_IDS = 300_000
INDEX = "urlkey string, captured string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, at long, size long, nth long"


def base32(hexes: Column) -> Column:
    """The base32 form of a SHA-1 in hex: four characters for each five hex digits."""
    signs = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for i in range(8):
        bits = F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(signs, F.shiftright(bits, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*out)


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """One column ``value``: a WARC record without its closing line ends, for each page."""
    html = F.coalesce("html", F.lit(""))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    keyed = pages.select("page_id", url.alias("url"), html.alias("html"), F.unhex(F.sha2(html.cast("binary"), 256)).alias("key"))
    ids = keyed.filter(F.octet_length("html") >= least).select("page_id", "key")
    first = ids.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # only the ids and keys of repeated payloads meet here; the pages are joined by id, which no hot payload skews
    again = ids.join(first, "key").filter(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    again = saved(again.select(F.col("page_id").alias("_id"), F.col("key").alias("_key"), "first"))
    again = F.broadcast(again) if again.count() <= SENT_IDS else again
    all_ = keyed.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")

    size = F.octet_length("html")
    http = lambda n: F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n.cast("string"), F.lit(END))
    revisit = F.col("first").isNotNull()
    block = F.when(revisit, http(size)).otherwise(F.concat(http(size), F.col("html")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(f"\r\n{k}: "), v)
    refers = F.concat(line("WARC-Refers-To", name(F.col("first"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
    made = all_.withColumn("digest", base32(F.sha1(F.col("html").cast("binary")))).withColumn("block", block)
    return made.select(
        F.concat(
            F.lit("WARC/1.1"),
            line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", name(F.col("page_id"))),
            line("WARC-Date", F.lit(CAPTURED)),
            line("WARC-Target-URI", F.col("url")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            F.when(revisit, refers).otherwise(F.lit("")),
            line("Content-Type", F.lit("application/http;msgtype=response")),
            line("Content-Length", F.octet_length("block").cast("string")),
            F.lit(END),
            F.col("block"),
        ).alias("value")
    )


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write the pages' records as archives of about ``ARCHIVE`` bytes at most in a folder."""
    held = pages.agg(F.sum(F.octet_length("html")).alias("bytes"), F.count("*").alias("n")).first()
    many = max(1, ARCHIVE * held["n"] // max(1, held["bytes"] or 0))
    records(pages, least).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", min(many, 1_000_000)).text(path)


def url_key(url: str) -> str:
    """The host's parts in reverse order, then the rest of the URL, in lower case."""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return url.lower()
    return f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower() if host else url.lower()


def parse(archive: str, data: bytes) -> list[tuple]:
    """The index rows of an archive, in its order. Payloads of responses are hashed anew."""
    rows, at = [], 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        block = data[head_end + 4 : head_end + 4 + n]
        http_end = block.index(b"\r\n\r\n") + 4
        number = lambda name: None if (x := head[name][10:-1]) == "null" else int(x)  # noqa: E731, B023
        if head["WARC-Type"] == "revisit":
            sizes = [x for x in block[:http_end].split(b"\r\n") if x.startswith(b"Content-Length: ")]
            size, digest, refers = int(sizes[0][16:]), head["WARC-Payload-Digest"].removeprefix("sha1:"), number("WARC-Refers-To")
        else:
            payload = block[http_end:]
            size, digest, refers = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), None
        end = head_end + 4 + n + 4
        rows.append((url_key(head["WARC-Target-URI"]), head["WARC-Date"], number("WARC-Record-ID"), head["WARC-Target-URI"], size, digest, head["WARC-Type"], refers, archive, at, end - at))
        at = end
    return rows


def order(row: tuple) -> tuple:
    """Sorting key of an index row: URL key, time, page_id (null last), then its place."""
    return row[0], row[1], row[2] is None, row[2] or 0, row[8], row[9]


class Run:
    """The slice of a sorted run that lies in a range: its rows stay in Arrow buffers, one block of keys is looked at."""

    def __init__(self, rows: pa.Table):
        self.rows, self.at, self.first, self.keys = rows, 0, 0, []

    def key(self) -> tuple | None:
        """The sorting key of the next row; None at the end."""
        if self.at >= len(self.rows):
            return None
        if self.at - self.first >= len(self.keys):
            self.first = self.at
            block = self.rows.slice(self.at, BLOCK)
            self.keys = [order(r) for r in zip(*(block.column(c).to_pylist() for c in NAMES), strict=True)]
        return self.keys[self.at - self.first]


class LoserTree:
    """k-way merge of sorted runs: inner nodes hold the loser of their match, the overall winner stands on top."""

    def __init__(self, runs: list[Run]):
        self.runs = runs
        self.keys = [r.key() for r in runs]
        self.k = len(runs)
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, x: int, y: int) -> bool:
        if y < 0 or x < 0:
            return x < 0 and y >= 0  # while the tree is built an empty place wins and waits above
        if self.keys[x] is None or self.keys[y] is None:
            return self.keys[y] is None
        return self.keys[x] < self.keys[y]

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        """(run, row) in global order."""
        while self.k and self.keys[self.tree[0]] is not None:
            run = self.tree[0]
            yield run, self.runs[run].at
            self.runs[run].at += 1
            self.keys[run] = self.runs[run].key()
            self._play(run)


NAMES = [x.split()[0] for x in INDEX.split(", ")]
_SCHEMA = pa.schema([(n, pa.string() if x.endswith("string") else pa.int64()) for n, x in zip(NAMES, INDEX.split(", "), strict=True)])


def runs(batches):
    """The sorted run of every archive of the batches."""
    for b in batches:
        for archive, data in zip(b.column("path"), b.column("content"), strict=True):
            rows = sorted(parse(archive.as_py(), zlib.decompress(data.as_buffer(), 47)), key=order)
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in NAMES[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, range(len(rows))], _SCHEMA, strict=True)], schema=_SCHEMA)


def merged(batches):
    """A range's rows in order: each run's slice is put together by its row numbers, then the slices are merged."""
    held = list(batches)
    if not held:
        return
    every = pa.Table.from_batches(held).select(NAMES).cast(_SCHEMA).combine_chunks()
    by_run = every.column("archive").combine_chunks().dictionary_encode().indices.to_numpy()
    place = np.lexsort((every.column("nth").to_numpy(), by_run))
    every = every.take(pa.array(place))
    starts = np.flatnonzero(np.diff(by_run[place], prepend=-1))
    ends = np.append(starts[1:], len(place))
    out = []
    for run, row in LoserTree([Run(every.slice(a, b - a)) for a, b in zip(starts, ends, strict=True)]):
        out.append(starts[run] + row)
        if len(out) == 8 * BLOCK:
            yield from every.take(pa.array(out)).to_batches()
            out = []
    if out:
        yield from every.take(pa.array(out)).to_batches()


def index(spark: SparkSession, path: str) -> DataFrame:
    """The captures of a folder of archives in global order: partitions follow each other by URL key and time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    local = saved(files.mapInArrow(trimmed(runs), INDEX))
    ranges = max(partitions(spark), -(-local.count() // RANGE))
    # a place in an archive ends the order, so no URL's captures must stay in one range
    dealt = local.repartitionByRange(ranges, "urlkey", "captured", F.col("page_id").asc_nulls_last(), "archive", "at")
    return dealt.mapInArrow(trimmed(merged), INDEX).drop("nth")


def op10_warc(spark, sf_dir):
    path = f"{shared_dir(spark)}/typeloom-warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    return index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
