"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of ``window`` consecutive words of each benchmark item (a shorter item is one window). They are
grouped by length. For each length, a block of two words ending at a position gives the safe shift to the next
possible end. Where the shift is zero, the hash of the last words (the suffix) selects a bucket of patterns, in which they stand
by the hash of their first words (the prefix), and the bytes of each pattern so selected are compared before anything counts.
Many stretches of documents are scanned in lockstep as numpy lanes.

Items are cut into stretches of at most about ``_STRETCH`` bytes, which overlap so that each window is in one, and dealt to
groups of about ``group_bytes``. Each group is compiled once, in a task, into arrays of some eight times its size, in a file of the shared
folder (a single group is broadcast). Documents are read once: a task takes some ``DOCUMENTS`` bytes of them at a time (a batch, if there is one group) and passes
these by the groups, of which it holds one. So a larger benchmark means more reading of patterns, and neither more passes over the corpus nor larger broadcasts.
"""

from __future__ import annotations

import pickle
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .common import delete, drop_saved, freed, new_path, saved, until_end

#: Lower-cases A-Z; what is not a digit, a-z or part of a non-ASCII character becomes a space.
_LOWER = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_LANE = 256
_STRETCH = 1 << 18
_BLOCK, _ENDS = 2, 4  # words of a shift block, and of a suffix or prefix
_U = np.uint64


def normal(raw: bytes) -> bytes:
    """The words of a text, one space apart."""
    return b" ".join(raw.translate(_LOWER).split())


def block_hashes(word_hashes: np.ndarray, block: int) -> np.ndarray:
    if block == 1:
        return word_hashes
    return tb.mixed(word_hashes[:-1] * _U(0x9E3779B97F4A7C15) + word_hashes[1:])


def _ranks(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The places of ``values`` in the sorted ``known``; -1 where they are not."""
    at = np.minimum(np.searchsorted(known, values), known.size - 1)
    return np.where(known[at] == values, at, -1)


@dataclass
class Patterns:
    """All patterns of one length: shift table, and buckets by suffix, in these by prefix, of offsets into the group's bytes."""

    length: int
    shift: np.ndarray
    suffixes: np.ndarray  # sorted hashes
    prefixes: np.ndarray
    keys: np.ndarray  # suffix rank and prefix rank of each pattern, sorted
    offset: np.ndarray
    size: np.ndarray
    first: np.ndarray  # of each pattern's items
    items: np.ndarray

    @property
    def block(self) -> int:
        return min(_BLOCK, self.length)

    @property
    def ends(self) -> int:
        return min(_ENDS, self.length)

    def selected(self, word_hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of windows within texts of words first..last-1, and the patterns that their buckets give; to be compared."""
        none = np.empty(0, np.int64)
        if word_hashes.size < self.length:
            return none, none
        blocks = np.zeros(word_hashes.size, _U)
        blocks[self.block - 1 :] = block_hashes(word_hashes, self.block)
        shifts = self.shift[(blocks & _U(self.shift.size - 1)).astype(np.int64)]
        lanes = np.maximum(0, -(-(last - first - self.length + 1) // _LANE))
        text = np.repeat(np.arange(first.size), lanes)
        nth = np.arange(text.size) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = first[text] + self.length - 1 + nth * _LANE
        stop = np.minimum(at + _LANE, last[text])
        out = [none]
        while at.size:
            step = shifts[at]
            if (zero := step == 0).any():
                out.append(at[zero])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        end = np.sort(np.concatenate(out))
        tails = tb.gram_hashes(word_hashes, self.ends)
        suffix, prefix = _ranks(self.suffixes, tails[end - self.ends + 1]), _ranks(self.prefixes, tails[end - self.length + 1])
        known = (suffix >= 0) & (prefix >= 0)
        end, key = end[known], (suffix[known] << 32) | prefix[known]
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        n = high - low
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(end, n), np.repeat(low, n) + place


@dataclass
class Group:
    """The compiled patterns of some items; ``data`` holds the items' words, one space apart."""

    data: bytes = b""
    names: list[str] = field(default_factory=list)
    lengths: list[Patterns] = field(default_factory=list)


def _patterns(length: int, at: np.ndarray, item: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Patterns:
    """Patterns from the windows of ``length`` words that begin at words ``at`` of items ``item``."""
    one, two = (tb.POWERS[i].spans(tb.POWERS[i].prefix(hashes), at, at + length) for i in (0, 1))
    order = np.lexsort((item, two, one))
    new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
    more = np.concatenate([[True], item[order][1:] != item[order][:-1]]) | new  # an item once for each of its windows
    which, at_ = (np.cumsum(new) - 1)[more], at[order][new]
    block, ends_ = min(_BLOCK, length), min(_ENDS, length)
    blocks, count = block_hashes(hashes, block), length - block + 1
    shift = np.full(1 << max(12, int((at_.size + count) * 4).bit_length()), count, np.uint8 if length < 256 else np.int64)
    for j in range(count):  # later blocks have smaller shifts and overwrite
        shift[(blocks[at_ + j] & _U(shift.size - 1)).astype(np.int64)] = count - 1 - j
    tails = tb.gram_hashes(hashes, ends_)
    suffixes, suffix = np.unique(tails[at_ + length - ends_], return_inverse=True)
    prefixes, prefix = np.unique(tails[at_], return_inverse=True)
    keys = (suffix.astype(np.int64) << 32) | prefix
    by_key = np.argsort(keys, kind="stable")
    n = np.bincount(which, minlength=at_.size)
    begin, n = (np.cumsum(n) - n)[by_key], n[by_key]
    first = np.concatenate([[0], np.cumsum(n)])
    items = item[order][more][np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(first[:-1], n)]
    at_ = at_[by_key]
    size = ends[at_ + length - 1] - starts[at_]
    return Patterns(length, shift, suffixes, prefixes, keys[by_key], starts[at_].astype(np.uint32), size.astype(np.uint32), first.astype(np.uint32), items.astype(np.int32))


def compiled(items: list[tuple[str, bytes]], window: int) -> Group:
    """The group of items (item_id, normal text); a name may come more than once."""
    items = [(name, text) for name, text in items if text]
    if not items:
        return Group()
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    data, _, last_byte = tb.joined([text for _, text in items], b" ")
    starts, ends = tb.words(data != 0x20)
    hashes = tb.span_hashes(data, starts, ends)
    last = np.searchsorted(starts, last_byte)
    first = np.concatenate([[0], last[:-1]])
    count, item = last - first, np.array([number[name] for name, _ in items])
    out = []
    for length in np.unique(np.minimum(count, window)).tolist():
        mine = np.flatnonzero(np.minimum(count, window) == length)
        n = count[mine] - length + 1
        at = np.repeat(first[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out.append(_patterns(length, at, np.repeat(item[mine], n), hashes, starts, ends))
    return Group(data.tobytes(), names, out)


def scan(texts: list[str | None], group: Group) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """For each text its number of words, which words are inside an occurrence, and the items that occur."""
    for _, run in tb.blocks(texts):
        data, _, text_ends = tb.joined([normal(r) for r in run], b" ")
        starts, ends = tb.words(data != 0x20)
        hashes = tb.span_hashes(data, starts, ends)
        last = np.searchsorted(starts, text_ends)
        first = np.concatenate([[0], last[:-1]])
        edge = np.zeros(starts.size + 1, np.int64)
        items: dict[int, set[int]] = defaultdict(set)
        whole = data.tobytes()
        for p in group.lengths:
            end, pattern = p.selected(hashes, first, last)
            begin = starts[end - p.length + 1]
            here, there, size = begin.tolist(), p.offset[pattern].tolist(), p.size[pattern].tolist()
            same = np.fromiter((whole[h : h + n] == group.data[o : o + n] and whole[h + n] == 0x20 for h, o, n in zip(here, there, size)), bool, len(here))
            end, pattern = end[same], pattern[same]
            np.add.at(edge, end - p.length + 1, 1)
            np.add.at(edge, end + 1, -1)
            owner = np.searchsorted(last, end, side="right")
            for text, k in np.unique(np.stack([owner, pattern]), axis=1).T.tolist() if end.size else ():
                items[text].update(p.items[p.first[k] : p.first[k + 1]].tolist())
        hit = np.cumsum(edge)[:-1] > 0
        for i in range(len(run)):
            yield int(last[i] - first[i]), hit[first[i] : last[i]], [group.names[k] for k in sorted(items.get(i, ()))]


def _stretches(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    names, parts, words_ = [], [], []
    for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        whole = normal((text or "").encode("utf-8", "surrogatepass"))
        held = whole.split() if len(whole) > _STRETCH else []
        per = max(2 * window, len(held) * _STRETCH // (len(whole) + 1))
        cut = [b" ".join(held[a : a + per + window - 1]) for a in range(0, max(1, len(held) - window + 1), per)] if held else [whole]
        names += [name] * len(cut)
        parts += range(len(cut))
        words_ += cut
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.int64()), pa.array(words_, pa.binary())], names=["item_id", "part", "words"])


DOCUMENTS = 16 << 20  # bytes of texts that a task passes by all groups at a time, if there are several


def _compile(batches: Iterator[pa.RecordBatch], window: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Writes a file of compiled patterns for each group and names it; rows come by group. A task that runs again writes files of its own, and only named ones count."""

    def done(group: int, rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"{path}/{group}-{uuid.uuid4().hex}"
        with store.open_output_stream(name, compression=None) as out:
            out.write(pickle.dumps(compiled(rows, window), protocol=5))
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([name.rsplit("/", 1)[1]])], names=["group", "file"])

    now, rows = None, []
    for batch in batches:
        for group, name, words_ in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if group != now and rows:
                yield done(now, rows)
                rows = []
            now = group
            rows.append((name, words_))
    if rows:
        yield done(now, rows)


def _read(folder: str, name: str) -> bytes:
    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{path}/{name}", compression=None) as held:
        return held.read()


def _runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in runs of about ``least`` bytes."""
    run, size = [], 0
    for batch in batches:
        run.append(batch)
        size += batch.nbytes
        if size >= least:
            yield run
            run, size = [], 0
    if run:
        yield run


def _searched(docs: DataFrame, groups: list[Callable[[], bytes]]) -> DataFrame:
    """n_words, hits (how many words), item_ids and the row for each of ``docs`` (doc_id, text, row); each of ``groups`` gives compiled patterns."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = pickle.loads(groups[0]()) if len(groups) == 1 else None
        for run in _runs(batches, DOCUMENTS if len(groups) > 1 else 0):
            count = sum(b.num_rows for b in run)
            size, bits, names = [0] * count, [None] * count, [[] for _ in range(count)]
            for group in groups:
                found = ready if ready is not None else pickle.loads(group())
                for i, (n, hit, ids) in enumerate(scan((t.as_py() for b in run for t in b.column(1)), found)):
                    size[i] = n
                    if hit.any():
                        bits[i] = hit if bits[i] is None else bits[i] | hit
                        names[i] += ids
            at = 0
            for b in run:
                part = slice(at, at + b.num_rows)
                at = part.stop
                hits = [0 if h is None else int(h.sum()) for h in bits[part]]
                ids = pa.array([sorted(set(x)) for x in names[part]], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size[part], pa.int64()), pa.array(hits, pa.int64()), ids, b.column(2)], names=["doc_id", "n_words", "n_hit", "item_ids", "row"])

    long, ids = T.LongType(), T.ArrayType(T.StringType())
    return docs.mapInArrow(lambda batches: freed(each(batches)), T.StructType([docs.schema["doc_id"], T.StructField("n_words", long), T.StructField("n_hit", long), T.StructField("item_ids", ids), docs.schema["row"]]))


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, ratio: int = 20, group_bytes: int = 8 << 20, carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted strings) and contaminated (n_hit > 0 and ratio * n_hit >= n_words) for each row of ``docs``.

    ``items`` has item_id and text. Words are runs of digits, letters a-z after lower-casing A-Z, and non-ASCII characters. A null
    or empty text has no words; an item without words matches nothing; a null item_id is the empty string. Rows that repeat
    an id each count. Other columns are not read; with ``carry`` the whole row comes along as a struct named row.
    """
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    cut = saved(named.mapInArrow(lambda batches: (_stretches(b, window) for b in batches), "item_id string, part long, words binary"), "stretches")
    groups = (cut.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // group_bytes + 1
    dealt = cut.select(F.pmod(F.xxhash64("item_id", "part", "words"), F.lit(groups)).alias("group"), "item_id", "part", "words").repartition(min(groups, 10_000), "group").sortWithinPartitions("group", "item_id", "part")
    folder = new_path(docs.sparkSession, "patterns")
    files = dealt.select("group", "item_id", "words").mapInArrow(lambda batches: _compile(batches, window, folder), "group long, file string").collect()  # a name for each group
    drop_saved(cut)
    if len(files) > 1:
        found = [partial(_read, folder, r.file) for r in files]
        until_end(folder)
    else:
        whole = docs.sparkSession.sparkContext.broadcast(_read(folder, files[0].file) if files else pickle.dumps(Group()))  # at most about group_bytes of items, compiled
        found = [lambda: whole.value]
        delete(docs.sparkSession, folder)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if carry else F.struct(F.lit(0).alias("none"))
    out = _searched(docs.select("doc_id", F.col("text").cast("string").alias("text"), row.alias("row")), found)
    return out.select("doc_id", "n_words", "n_hit", "item_ids", *["row"] * carry).withColumn("contaminated", (F.col("n_hit") > 0) & (ratio * F.col("n_hit") >= F.col("n_words")))


def without_contaminated(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows that are contaminated; rows are judged one by one where they are read, and nothing is shuffled."""
    return contamination(docs, items, carry=True, **settings).where("not contaminated").select("row.*")
