"""Operator 11: SentencePiece encoding and decoding through a table of distinct chunks.

The model's pieces hold a whitespace marker only at their beginning, or are runs of markers. So no merge can join what
stands before a marker to the marker, and a text's ids are the ids of its marked words in a row. A task splits texts
at the markers, segments each distinct marked word once, and joins ids back by position. The table is a task's own and
starts anew beyond ``MEMO`` words: a table for the whole corpus would have to be joined with every word of every
text. A model whose pieces do cross markers, or that changes its input, is given whole texts.

Defined cases: a null text counts as empty; an empty text has the end id only and decodes to the empty text; a marker
character within a text counts as a space, as in the library; repeated rows are encoded one by one; long texts are
encoded window by window; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, table, trimmed

#: Distinct marked words that a task remembers.
MEMO = 200_000
#: Characters of a text that are split at once.
WINDOW = 400_000

MARK = "▁"
_CHUNK = re.compile(" *[^ ]+| +")
_CUT = re.compile("(?<=[^ ]) ")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def loaded(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=str(path))


def splits_at_markers(model) -> bool:
    """Whether the marked words of a text can be segmented one by one: byte pairs, text taken as it is behind one marker,
    no symbols of the user's, and no piece with a marker behind another character."""
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    proto = ModelProto.FromString(model.serialized_model_proto())
    made, spec = proto.trainer_spec, proto.normalizer_spec
    plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
    kinds = ModelProto.SentencePiece
    ordinary = {kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE}
    apart = all(p.type in ordinary and (MARK not in p.piece[1:] or not p.piece.strip(MARK)) for p in proto.pieces)
    return made.model_type == made.BPE and not made.treat_whitespace_as_suffix and plain and apart


def windows(text: str, size: int = WINDOW) -> Iterator[list[str]]:
    """The marked words of a text, by windows of about so many characters; markers are spaces here."""
    text, start = " " + text.replace(MARK, " "), 0
    while start < len(text):
        cut = _CUT.search(text, start + size) if len(text) - start > size else None
        end = cut.start() if cut else len(text)
        yield _CHUNK.findall(text, start, end)
        start = end


class ChunkTable:
    """Ids of texts, as bytes of little-endian 32-bit numbers, by a table of distinct marked words."""

    def __init__(self, path: str, memo: int = MEMO, window: int = WINDOW):
        self.model, self.memo, self.window = loaded(path), memo, window
        self.apart = splits_at_markers(self.model)
        # the model itself puts the first marker, which a lone marker would lose
        self.alone = {" ": np.array([self.model.piece_to_id(MARK)], "<i4").tobytes()}
        self.known: dict[str, bytes] = dict(self.alone)

    def segmented(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, "<i4").tobytes() for ids in self.model.encode(texts, num_threads=1)]

    def of(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.apart:
            return self.segmented([text])[0]
        out = []
        for words in windows(text, self.window):
            if len(self.known) > self.memo:
                self.known = dict(self.alone)
            if missing := list(set(words).difference(self.known)):
                self.known.update(zip(missing, self.segmented([w[1:] for w in missing]), strict=True))
            out.append(b"".join(map(self.known.__getitem__, words)))
        return b"".join(out)


def encode(docs: DataFrame, path: str | None = None, end: bool = True) -> DataFrame:
    """doc_id, ids (array of int) of every row's text, with an end id if asked for."""
    path = path or model_path()

    def run(batches):
        chunks = ChunkTable(path)
        last = np.array([chunks.model.eos_id()] if end else [], "<i4").tobytes()
        for batch in batches:
            for at, raw in byte_slices(batch.column("text")):
                ids = [chunks.of(t.decode("utf-8", "replace")) + last for t in raw]
                ends = np.cumsum([0, *map(len, ids)]) // 4
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(raw)), lists], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded: the text of each row's ids; null ids give null."""
    path = path or model_path()

    def run(batches):
        model = loaded(path)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids) for ids in (x.as_py() for x in batch.column("ids"))] if batch.column("ids").null_count else decoded(model, batch.column("ids"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(trimmed(run), f"doc_id {kind}, ids array<int>, decoded string")


def decoded(model, lists: pa.ListArray) -> list[str]:
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [model.decode(values[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def op11_sentencepiece(spark, sf_dir):
    both = decode(encode(table(spark, sf_dir, "documents")))
    digits = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
