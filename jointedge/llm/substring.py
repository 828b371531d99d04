"""Substring dedup: words inside passages that also start in an earlier document are removed.

1. One pass hashes the word runs of ``gram`` words and keeps, for each window of ``window`` words, its least one (the
   anchor). Equal windows have equal anchors, so a window can recur only if its anchor is in two documents. About one
   run in twenty is an anchor; only their hashes are shuffled.
2. Anchors in at least two documents are candidate phrases. Their texts are read from the documents that hold them, and
   a phrase whose text is in two documents is confirmed: the table of recurring phrases.
3. Phrases are dealt to shards by the first document that holds them, so that what was copied together stays together. Each
   shard's phrases are compiled into an Aho-Corasick automaton, and documents are streamed through it in doc_id order; what
   the automaton reports is the only source of positions. A document meets the shards whose phrases its anchors name:
   in no other shard can it hold a recurring window, so the work grows with the documents and not with documents times shards.
   A shard with many occurrences is split by salt: its documents are spread, its phrases repeated.
4. Windows around the occurrences get 128-bit hashes. Equal windows share their anchor and so their shard; they are
   settled where they meet, and only runs of removed windows leave the task. Windows of salted or overfull shards stay
   open and meet in a shuffle, one row per distinct window of a task.

Exact copies (equal word sequences) are settled first by digest, so large groups of copies cost one short row each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import as_id, drop_saved, freed, fresh, from_id, map_batches, saved, spread_lookup

_NONE = hashlib.sha256(b"").hexdigest()
_FLUSH = 1_000_000  # windows that a task holds before it settles them
_SHARD = 10_000  # occurrences of the phrases of a shard, on average
_U = np.uint64


def _normal(raw: bytes) -> bytes:
    return b" ".join(raw.split())  # bytes: exactly space and 0x09-0x0D


class Block:
    """Words, run hashes and window anchors of a block of documents."""

    def __init__(self, run: list[bytes], window: int, gram: int):
        self.run = [_normal(r) for r in run]
        self.data, self.first, last = tb.joined(self.run, b" ")
        self.starts, self.ends = tb.words(self.data != 0x20)
        self.hashes = tb.span_hashes(self.data, self.starts, self.ends)
        self.stop = np.searchsorted(self.starts, last)
        self.begin = np.concatenate([[0], self.stop[:-1]])
        self.owner = np.repeat(np.arange(len(run)), self.stop - self.begin)
        n = self.hashes.size
        self.grams = tb.gram_hashes(self.hashes, gram)
        if n < window:
            self.valid, self.anchor = np.empty(0, bool), np.empty(0, _U)
        else:
            self.valid = self.owner[: n - window + 1] == self.owner[window - 1 :]
            self.anchor = tb.sliding(self.grams, window - gram + 1)

    def anchors(self, width: int) -> np.ndarray:
        """Positions of runs that are the least of some window."""
        if not self.anchor.size:
            return np.empty(0, np.int64)
        pad = np.zeros(width - 1, _U)
        best = tb.sliding(np.concatenate([pad, np.where(self.valid, self.anchor, _U(0)), pad]), width, np.maximum)
        return np.flatnonzero(best == self.grams)


def _outline(batch: pa.RecordBatch, window: int, gram: int) -> pa.RecordBatch:
    counts, digests, sizes, values = [], [], [], []
    for _, run in tb.blocks(batch.column(2).to_pylist()):
        block = Block(run, window, gram)
        counts.append(block.stop - block.begin)
        digests += [hashlib.sha256(r).digest() for r in block.run]
        at = block.anchors(window - gram + 1)
        pairs = np.unique(np.stack([block.owner[at].astype(_U), block.grams[at]], axis=1), axis=0) if at.size else np.empty((0, 2), _U)
        sizes.append(np.bincount(pairs[:, 0].astype(np.int64), minlength=len(run)))
        values.append(pairs[:, 1])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
    flat = np.concatenate(values).view(np.int64) if values else np.empty(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
    n_words = pa.array(np.concatenate(counts) if counts else [], pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n_words, pa.array(digests, pa.binary()), lists], names=["doc_id", "t", "n_words", "words_sha", "anchors"])


def _phrases(batch: pa.RecordBatch, window: int, gram: int) -> pa.RecordBatch:
    """anchor, phrase and doc_id: the texts of the runs whose hashes are among the documents' candidate phrases."""
    anchors, texts, docs = [], [], []
    ids, lists = batch.column(0).to_numpy(), batch.column(2)
    for first, run in tb.blocks(batch.column(1).to_pylist()):
        block = Block(run, window, gram)
        known = np.unique(lists.slice(first, len(run)).flatten().to_numpy(zero_copy_only=False).view(_U))
        at = np.flatnonzero(np.isin(block.grams, known))
        at = at[block.owner[at] == block.owner[at + gram - 1]]
        whole = block.data.tobytes()
        anchors.append(block.grams[at])
        texts += [whole[s:e] for s, e in zip(block.starts[at].tolist(), block.ends[at + gram - 1].tolist())]
        docs.append(ids[first + block.owner[at]])
    anchors = np.concatenate(anchors).view(np.int64) if anchors else np.empty(0, np.int64)
    docs = np.concatenate(docs) if docs else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(texts, pa.binary()), pa.array(docs, pa.int64())], names=["anchor", "phrase", "doc_id"])


class Shard:
    """The automaton of one shard's phrases, and the windows of the documents that were streamed through it."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        self.rows: list[tuple] = []
        self.held, self.whole = 0, True

    def add(self, phrases: list[bytes]) -> None:
        for phrase in phrases:
            self.automaton.add_word(f" {phrase.decode('latin-1')} ")

    def occurrences(self, block: Block) -> np.ndarray:
        """Words of the block at which a phrase of the shard begins, in order."""
        found: list[int] = []
        for raw, first in zip(block.run, block.first.tolist()):
            found += [first + end - size + 1 for end, size in self.automaton.iter(f" {raw.decode('latin-1')} ")]
        return np.searchsorted(block.starts, np.unique(np.array(found, np.int64)))

    def stream(self, ids: np.ndarray, keys: np.ndarray, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
        """Documents in doc_id order; windows whose least run is an occurrence are held until they are settled."""
        if not len(self.automaton):
            return
        if self.automaton.kind != ahocorasick.AHOCORASICK:
            self.automaton.make_automaton()
        for first, run in tb.blocks(texts):
            block = Block(run, self.window, self.gram)
            found = self.occurrences(block)
            near = np.zeros(block.valid.size + 1, np.int64)  # windows that hold an occurrence
            np.add.at(near, np.maximum(0, found - self.window + self.gram)[found - self.window + self.gram < block.valid.size], 1)
            np.add.at(near, np.minimum(found + 1, block.valid.size), -1)
            at = np.flatnonzero(block.valid & (np.cumsum(near)[:-1] > 0))
            at = at[np.isin(block.anchor[at], block.grams[found])]
            if not at.size:
                continue
            one, two = (tb.POWERS[i].spans(tb.POWERS[i].prefix(block.hashes), at, at + self.window) for i in (0, 1))
            owner = block.owner[at]
            self.rows.append((ids[first + owner], keys[first + owner], at - block.begin[owner], one, two))
            self.held += at.size
            if self.held >= _FLUSH:
                self.whole = False
                yield from _settled(self.rows, open_=True)
                self.rows, self.held = [], 0

    def rest(self, salts: int) -> Iterator[pa.RecordBatch]:
        """What is still held. If all windows of the shard were held at once, none of them stays open."""
        yield from _settled(self.rows, open_=salts > 1 or not self.whole)


def _settled(rows: list[tuple], open_: bool) -> Iterator[pa.RecordBatch]:
    """Windows that an earlier document of ``rows`` has, as runs (done), and with ``open_`` the first of each distinct window."""
    if not rows:
        return
    doc, t, pos, one, two = (np.concatenate(c) for c in zip(*rows))
    order = np.lexsort((doc, two, one))
    doc, t, pos, one, two = (c[order] for c in (doc, t, pos, one, two))
    new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    done = doc > least
    for which in (~done, done) if open_ else (done,):
        d, k, p, a, b = (c[which] for c in (doc, t, pos, one, two))
        run = np.ones(d.size, np.int32)
        if which is done and d.size:
            order = np.lexsort((p, k, d))
            d, k, p, a, b = (c[order] for c in (d, k, p, a, b))
            start = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (p[1:] != p[:-1] + 1)]))
            run = np.diff(np.append(start, d.size)).astype(np.int32)
            d, k, p, a, b = (c[start] for c in (d, k, p, a, b))
        for at in range(0, d.size, 50_000):
            cut = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d[cut]), pa.array(k[cut]), pa.array(p[cut].astype(np.int32)), pa.array(run[cut]), pa.array(a[cut].view(np.int64)), pa.array(b[cut].view(np.int64)), pa.array(np.full(d[cut].size, which is done))],
                names=["doc_id", "t", "pos", "run", "one", "two", "done"],
            )


def _windows(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows by shard and salt, phrases before documents: each shard is compiled once and its documents stream past it."""
    now, shard, salts = None, None, 1
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)])  # shard, salt, kind
        edges = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])).tolist() if batch.num_rows else []
        for a, b in zip(edges, [*edges[1:], batch.num_rows]):
            if now != (key := tuple(keys[:2, a].tolist())):
                if shard is not None:
                    yield from shard.rest(salts)
                now, shard, salts = key, Shard(window, gram), batch.column(3)[a].as_py()
            part = batch.slice(a, b - a)
            if keys[2, a] == 0:
                shard.add(part.column(6).to_pylist())
            else:
                yield from shard.stream(part.column(4).to_numpy(), part.column(5).to_numpy(), part.column(7).to_pylist())
    if shard is not None:
        yield from shard.rest(salts)


def _kept(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    removed, digests, texts = [], [], []
    for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        edge = np.zeros(len(words) + 1, np.int64)
        for s in spans:
            edge[s["pos"]] += 1
            edge[min(len(words), s["pos"] + s["run"] + window - 1)] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
        removed.append(int(gone.sum()))
        digests.append(hashlib.sha256(kept).hexdigest())
        texts.append(kept.decode("utf-8", "surrogatepass"))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "t", "n_removed", "kept_sha256", "kept_text"])


def _sharded(runs: DataFrame) -> DataFrame:
    """anchor, n (its occurrences), shard and salts for each anchor in two documents or more."""
    shared = saved(runs.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select("anchor", "low", "n"), "shared")
    shards = (shared.agg(F.sum("n")).first()[0] or 0) // _SHARD + 1
    placed = shared.withColumn("shard", F.pmod(F.xxhash64("low"), F.lit(shards)))
    size = placed.groupBy("shard").agg(F.sum("n").alias("size")).select("shard", F.ceil(F.col("size") / (2 * _SHARD)).cast("int").alias("salts"))
    return saved(placed.join(size, "shard").select("anchor", "n", "shard", "salts"), "sharded")


def repeats(docs: DataFrame, window: int = 50, gram: int = 12) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text and t (xxhash64 of the text) for each row of ``docs``.

    A word goes if a window of ``window`` words over it has a word sequence that also starts in a document with a smaller
    doc_id. kept_text, the kept words joined by one space, is null where nothing goes. A null or empty text has no
    words; rows that share a doc_id do not remove each other's words; a null doc_id sorts last. Other columns are not read.
    """
    source = docs.select(as_id(F.col("doc_id").cast("long")).alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"))
    outline = saved(map_batches(source, lambda b: _outline(b, window, gram), "doc_id long, t long, n_words long, words_sha binary, anchors array<long>"), "outline")
    copies = saved(outline.where(F.col("n_words") >= window).groupBy("words_sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "copies")
    marked = saved(spread_lookup(outline, ["words_sha"], F.col("doc_id"), copies, "n", ["first"]).withColumn("copy", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))).drop("first"), "marked")
    drop_saved(outline)
    runs = marked.where("not copy").select("doc_id", "t", F.explode("anchors").alias("anchor"))
    sharded = _sharded(runs)
    hits = spread_lookup(runs, ["anchor"], F.col("t"), sharded, "n", ["shard", "salts"]).where("shard is not null")
    hits = hits.groupBy("doc_id", "t").agg(F.collect_set(F.struct("shard", "salts")).alias("shards"), F.collect_set("anchor").alias("known"))
    held = saved(source.join(hits, ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).select("doc_id", "t", "text", "known", "shards"), "held")
    found = map_batches(held.select("doc_id", "text", "known"), lambda b: _phrases(b, window, gram), "anchor long, phrase binary, doc_id long")
    confirmed = found.groupBy("anchor", "phrase").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    phrases = confirmed.join(sharded, "anchor").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "salts", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("t"), "phrase", F.lit(None).cast("string").alias("text"))
    routed = held.select("doc_id", "t", "text", F.explode("shards").alias("to"))
    routed = routed.select("to.shard", F.pmod(F.xxhash64("doc_id", "t"), F.col("to.salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "to.salts", "doc_id", "t", F.lit(None).cast("binary").alias("phrase"), "text")
    dealt = phrases.union(routed).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind", "doc_id")
    windows = saved(dealt.mapInArrow(lambda batches: freed(_windows(batches, window, gram)), "doc_id long, t long, pos int, run int, one long, two long, done boolean"), "windows")
    later = windows.where("not done").withColumn("least", F.min("doc_id").over(Window.partitionBy("one", "two"))).where("least < doc_id")
    spans = windows.where("done").select("doc_id", "t", "pos", "run").union(later.select("doc_id", "t", "pos", "run")).groupBy("doc_id", "t").agg(F.collect_list(F.struct("pos", "run")).alias("spans"))
    cut = map_batches(held.select("doc_id", "t", "text").join(spans, ["doc_id", "t"]).select("doc_id", "t", "text", "spans"), lambda b: _kept(b, window), "doc_id long, t long, n_removed long, kept_sha256 string, kept_text string")
    out = marked.select("doc_id", "t", "n_words", "words_sha", "copy").join(cut, ["doc_id", "t"], "left")
    return out.select(
        from_id("doc_id").alias("doc_id"),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(_NONE)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("words_sha")))).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        "t",
    )


def without_repeats(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with the kept words in ``text`` where words went; other rows and columns as they were. No row is dropped."""
    key, t, kept = (fresh(docs, name) for name in ("__id", "__t", "__kept"))
    cut = repeats(docs, **settings).where("kept_text is not null").select(as_id().alias(key), F.col("t").alias(t), F.col("kept_text").alias(kept)).dropDuplicates([key, t])
    out = docs.join(cut, (as_id() == F.col(key)) & (F.xxhash64("text") == F.col(t)), "left")
    return out.select(*(F.coalesce(kept, "text").alias("text") if c == "text" else F.col(c) for c in docs.columns))
