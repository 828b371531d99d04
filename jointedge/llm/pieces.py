"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece of a model crosses from a letter to a white-space marker, no merge does either, so a text falls into chunks (a run of markers
and what follows it) that are segmented apart. A task keeps one table of the chunks that it has met: each is segmented once, and
texts become sequences of positions in that table, from which their ids are gathered. Chunks repeat within any few megabytes of text, and a
table for all tasks would have to meet every position in a shuffle of several times the corpus, so each task has its own.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import BLOCK

MARK = "▁"
_CHUNK = re.compile(" +[^ ]*")

#: A task's table is begun anew beyond so many ids and bytes of chunks.
TABLE_LIMIT = 1 << 25


def separable(model: bytes) -> bool:
    """Whether chunks can be segmented apart: no piece goes on with a marker after another character, and texts are only given a marker in front."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    how = proto.normalizer_spec
    plain = how.name == "identity" and not how.precompiled_charsmap and how.add_dummy_prefix and how.escape_whitespaces and not how.remove_extra_whitespaces
    own = any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in proto.pieces)
    return plain and proto.trainer_spec.model_type == pb.TrainerSpec.BPE and not own and not any(MARK in p.piece.lstrip(MARK) for p in proto.pieces)


class Chunks:
    """The distinct chunks met so far, with the ids of each in one array."""

    def __init__(self, processor, limit: int = TABLE_LIMIT):
        self.processor, self.limit = processor, limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.size = array("i"), array("q", [0]), 0

    def add(self, new: list[str]) -> None:
        """Segments chunks that the table has not; the library puts back the marker that each begins with."""
        for chunk, ids in zip(new, self.processor.encode([c[1:] for c in new], num_threads=1)):
            if chunk == " ":  # of an empty text the library makes nothing
                ids = [self.processor.piece_to_id(MARK)]
            self.place[chunk] = len(self.place)
            self.ids.extend(ids)
            self.starts.append(len(self.ids))
            self.size += len(chunk) + len(ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.size > self.limit:
            self.clear()
        chunks = [_CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        self.add([c for c in dict.fromkeys(c for row in chunks for c in row) if c not in self.place])
        flat, starts = np.array(self.ids, np.int32), np.array(self.starts)
        out = []
        for row in chunks:
            at = np.fromiter(map(self.place.__getitem__, row), np.int64, len(row))
            sizes = starts[at + 1] - starts[at]
            ends = np.cumsum(sizes)
            out.append(flat[np.repeat(starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if ends.size else 0)])
        return out


def _runs(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about a megabyte, or one longer text, with the place of the first; null is empty."""
    first, total, run = 0, 0, []
    for i, text in enumerate(texts):
        text = text.as_py() or ""
        if run and total + len(text) > BLOCK:
            yield first, run
            first, total, run = i, 0, []
        run.append(text)
        total += len(text)
    if run:
        yield first, run


def encoded(docs: DataFrame, model: bytes, end: bool = True) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (what the library's ``decode`` makes of them) for each row of ``docs``.

    ``model`` holds a model file, a few megabytes; every task gets it. Ids are those of the library's ``encode``, with the end id where ``end`` is set. Null and
    empty texts have no other id and decode to the empty text. A null doc_id stays null, repeated rows each get a row, and other columns are not read.
    A model whose chunks are not separable encodes each text as a whole.
    """
    apart = separable(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        processor = SentencePieceProcessor(model_proto=model)
        table, last = Chunks(processor), np.array([processor.eos_id()] if end else [], np.int32)
        for batch in batches:
            for first, run in _runs(batch.column(1)):
                found = table.encode(run) if apart else [np.array(ids, np.int32) for ids in processor.encode(run, num_threads=1)]
                rows = [np.concatenate([ids, last]) for ids in found]
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows)))
                texts = pa.array([processor.decode(r.tolist()) for r in rows], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(run)), ids, texts], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, ids array<int>, decoded string")
