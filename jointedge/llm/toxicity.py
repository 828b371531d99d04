"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A document is read as overlapping passages of a few words. The bag of a passage holds its words and their character n-grams,
hashed into buckets; a misspelling that was never seen shares most n-grams with the word it stands for. The bag's embeddings
are averaged and a linear softmax classifies the average. A document's score is that of its most toxic passage,
calibrated: one average over a whole long document would hide one insult.

Training alternates between choosing, in each labelled document, the passages that decide it under the present model and
fitting embeddings and softmax together on these by Adam. As the classifier is linear in the average, scoring folds the model
into one weight per bucket, and whole texts are scored by a few vector operations per block.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import freed, held_out
from .quality import labelled_rows

BUCKETS = 1 << 17
SIZES = (3, 4, 5)  # of n-grams, in bytes, with a space before and after each word
WIDTH = 8  # of an embedding
SEED = 11
PASSAGE, STRIDE = 6, 3  # words of a passage, and from one to the next
ROUNDS, STEPS, RATE = 5, 50, 0.1
PARTS = 2  # copies of each toxic passage that hold a random half of its n-grams
DECAY = 1e-3
GATHERED = 1 << 17  # places whose values a sum holds at once
# Documented bounds: labelled documents that a fit takes at most, and bytes of their texts; of each half may be toxic.
MAX_TRAINED, MAX_BYTES = 4000, 32 << 20
MAX_TEXT = 1 << 20

#: Digits, letters and non-ASCII bytes make words; A-Z become a-z.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


@dataclass
class Bags:
    """The subword buckets of the words of a block: ``ids`` by byte position and size, and the words' places."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # of each word
    n_docs: int

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each n-gram size, buckets by byte position and whether the n-gram stays inside one spaced word."""
        space = self.data == 0x20
        seen = np.concatenate([[0], np.cumsum(space)])
        byte = self.data.astype(np.uint32)
        for n in SIZES:
            count = self.data.size - n + 1
            code = np.zeros(count, np.uint32)
            for i in range(n):
                code = code * np.uint32(0x01000193) + byte[i : i + count]
            code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            code ^= code >> np.uint32(13)
            inner = seen[n - 1 : n - 1 + count] - seen[1 : 1 + count]  # spaces strictly inside
            yield (code & np.uint32(BUCKETS - 1)).astype(np.int32), inner == 0

    def word_buckets(self) -> np.ndarray:
        return (tb.span_hashes(self.data, self.starts, self.ends) & np.uint64(BUCKETS - 1)).astype(np.int32)


def bags(run: list[bytes]) -> Bags:
    text = b" " + b" ".join(r.translate(_FOLD) for r in run) + b" " * max(SIZES)
    data = np.frombuffer(text, np.uint8)
    starts, ends = tb.words(data != 0x20)
    last = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)) + 1)
    return Bags(data, starts, ends, np.searchsorted(last, starts, side="right"), len(run))


def word_sums(b: Bags, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of ``weight`` over the bag of each word, and the bag's size."""
    total = weight[b.word_buckets()].astype(np.float64)
    count = np.ones(b.starts.size)
    for n, (code, valid) in zip(SIZES, b.grams()):
        sums = np.concatenate([[0.0], np.cumsum(np.where(valid, weight[code], 0), dtype=np.float64)])
        first, past = b.starts - 1, np.minimum(np.maximum(b.ends + 1 - n + 1, b.starts - 1), code.size)
        total += sums[past] - sums[first]
        count += past - first
    return total, count


def passages(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word past the last, and document of each passage of documents of ``sizes`` words that follow one another."""
    n = np.where(sizes > 0, np.maximum(0, -(-(sizes - PASSAGE) // STRIDE)) + 1, 0)
    doc = np.repeat(np.arange(sizes.size), n)
    stop = np.cumsum(sizes)
    first = (stop - sizes)[doc] + (np.arange(doc.size) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return first, np.minimum(first + PASSAGE, stop[doc]), doc


def means(total: np.ndarray, count: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """The average over each passage's bag from the sums and sizes of the words' bags."""
    t, c = (np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)]) for x in (total, count))
    return (t[past] - t[first]) / (c[past] - c[first])


@dataclass
class Model:
    weight: np.ndarray | None = None  # by bucket
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.0

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The largest passage score of each text; a text without words has the least."""
        out = []
        for _, run in tb.blocks(texts):
            b = bags(run)
            best = np.full(b.n_docs, -50.0)
            first, past, doc = passages(np.bincount(b.doc, minlength=b.n_docs))
            if doc.size:
                value = means(*word_sums(b, self.weight), first, past)
                at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                best[doc[at]] = np.maximum.reduceat(value, at)
            out.append(best)
        return np.concatenate(out) if out else np.empty(0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weight is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -40, 40)))


class Ragged:
    """Rows of unequal length over one array of members, with sums by row and, turned round, by member.

    Sums gather the values of some rows at a time, as those of all members together are many times the size of the rest.
    """

    def __init__(self, members: np.ndarray, sizes: np.ndarray):
        self.members, self.sizes = members.astype(np.int32), sizes
        self.starts = np.cumsum(sizes) - sizes
        order = np.argsort(self.members, kind="stable")
        kept = self.members[order]
        self.owners = np.repeat(np.arange(sizes.size, dtype=np.int32), sizes)[order]  # the rows that hold each member, member by member
        self.first = np.flatnonzero(np.concatenate([[True], kept[1:] != kept[:-1]]))
        self.known = kept[self.first]

    def sums(self, values: np.ndarray) -> np.ndarray:
        return _gathered(values, self.members, self.starts)

    def back(self, rows: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, rows.shape[1]), rows.dtype)
        out[self.known] = _gathered(rows, self.owners, self.first)
        return out


def _gathered(values: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` at the places ``at`` from each of ``starts`` to the next, for as many sums at once as take about GATHERED places."""
    out, low = np.empty((starts.size, *values.shape[1:]), values.dtype), 0
    while low < starts.size:
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + GATHERED)))
        end = starts[high] if high < starts.size else at.size
        out[low:high] = np.add.reduceat(values[at[starts[low] : end]], starts[low:high] - starts[low])
        low = high
    return out


def _softmax_fit(e: np.ndarray, u: np.ndarray, c: np.ndarray, words: Ragged, held: Ragged, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adam on the weighted cross-entropy of softmax(mean of e over the bag @ u + c), all three trained together.

    ``words`` has the buckets of each word, ``held`` the words of each passage.
    """
    used, ids = np.unique(words.members, return_inverse=True)
    words = Ragged(ids, words.sizes)
    size = held.sums(words.sizes.astype(np.float32))[:, None]
    params = [e[used], u, c]
    one, two = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    target = np.eye(2, dtype=np.float32)[y]
    for step in range(1, STEPS + 1):
        mean = held.sums(words.sums(params[0])) / size
        logit = mean @ params[1] + params[2]
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - target) * w[:, None]
        back = words.back(held.back(g @ params[1].T / size, words.sizes.size), used.size)
        grads = [back + DECAY / used.size * params[0], mean.T @ g + DECAY * params[1], g.sum(axis=0)]
        for i, grad in enumerate(grads):
            one[i] = 0.9 * one[i] + 0.1 * grad
            two[i] = 0.99 * two[i] + 0.01 * grad**2
            params[i] = params[i] - RATE * (one[i] / (1 - 0.9**step)) / (np.sqrt(two[i] / (1 - 0.99**step)) + 1e-8)
    e = e.copy()
    e[used] = params[0]
    return e, params[1], params[2]


def _top(value: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """The k passages of the largest value of each document; ``doc`` is sorted."""
    order = np.lexsort((-value, doc))
    return order[np.arange(order.size) - np.searchsorted(doc, doc[order]) < k]


def train(texts: list[str], labels: np.ndarray) -> Model:
    """A model from whole texts and their 0/1 labels; without both kinds it scores the share of ones, or 0.5."""
    labels = np.asarray(labels, np.int64)
    if not labels.size or labels.min() == labels.max():
        return Model(prior=float(labels.mean()) if labels.size else 0.0)
    words, word, sizes = _vocabulary(texts)
    if not words:
        return Model(prior=float(labels.mean()))
    ids, bag_size = _bag_ids(words)
    bag_start = np.cumsum(bag_size) - bag_size
    first, past, doc = passages(sizes)
    # the start: log odds of a bucket's words to be in toxic documents
    n = np.bincount(labels, minlength=2)
    pairs = np.unique(word.astype(np.int64) * labels.size + np.repeat(np.arange(labels.size), sizes))
    seen = [np.bincount(ids, np.repeat(np.bincount(pairs[labels[pairs % labels.size] == k] // labels.size, minlength=len(words)), bag_size), minlength=BUCKETS) for k in (0, 1)]
    weight = (np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))).astype(np.float32)
    rng = np.random.default_rng(SEED)
    e = (rng.standard_normal((BUCKETS, WIDTH)) * 0.1).astype(np.float32)
    u = (rng.standard_normal((WIDTH, 2)) * 0.1).astype(np.float32)
    c = np.zeros(2, np.float32)
    toxic, hard = labels[doc] == 1, np.zeros(doc.size, bool)
    for _ in range(ROUNDS):
        total = np.add.reduceat(weight[ids], bag_start)[word]
        value = means(total, bag_size[word], first, past)
        top = _top(value, doc, 4)
        hard[top[~toxic[top]]] = True
        top = _top(value, doc, 2)
        positive, negative = top[toxic[top]], np.flatnonzero(hard)
        if not positive.size or not negative.size:
            break
        # each toxic passage also in parts, so that what is left of a misspelt word still counts
        chosen = np.concatenate([positive, negative])
        length = (past - first)[chosen]
        held = word[np.repeat(first[chosen], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)]
        whole = held[: length[: positive.size].sum()]
        known, held = np.unique(held, return_inverse=True)
        buckets = [ids[np.repeat(bag_start[known], bag_size[known]) + np.arange(bag_size[known].sum()) - np.repeat(np.cumsum(bag_size[known]) - bag_size[known], bag_size[known])]]
        counts, members, lengths = [bag_size[known]], [held], [length]
        for k in range(PARTS):
            part = np.repeat(np.arange(whole.size), bag_size[whole])
            every = ids[np.repeat(bag_start[whole], bag_size[whole]) + np.arange(part.size) - np.repeat(np.cumsum(bag_size[whole]) - bag_size[whole], bag_size[whole])]
            keep = rng.random(part.size) < 0.5
            keep[np.cumsum(bag_size[whole]) - 1] = True  # no bag is empty
            buckets.append(every[keep])
            counts.append(np.bincount(part[keep], minlength=whole.size))
            members.append(known.size + k * whole.size + np.arange(whole.size))
            lengths.append(length[: positive.size])
        y = np.concatenate([np.ones(positive.size, np.int64), np.zeros(negative.size, np.int64), np.ones(PARTS * positive.size, np.int64)])
        w = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()).astype(np.float32)
        e, u, c = _softmax_fit(e, u, c, Ragged(np.concatenate(buckets), np.concatenate(counts)), Ragged(np.concatenate(members), np.concatenate(lengths)), y, w)
        weight = (e @ (u[:, 1] - u[:, 0]) + (c[1] - c[0])).astype(np.float32)
    model = Model(weight, prior=float(labels.mean()))
    model.slope, model.shift = _platt(model.logits(texts), labels)
    return model


def _vocabulary(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of all texts, the words of the texts one after another, and how many each text has."""
    known: dict[bytes, int] = {}
    word, sizes = array("i"), []
    for text in texts:
        mine = [known.setdefault(w, len(known)) for w in text.encode("utf-8", "surrogatepass").translate(_FOLD).split()]
        word.extend(mine)
        sizes.append(len(mine))
    return list(known), np.frombuffer(word, np.int32) if word else np.empty(0, np.int32), np.array(sizes, np.int64)


def _bag_ids(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all bags, one after another, and the size of each."""
    b = bags(words)
    ids, owner = [b.word_buckets()], [np.arange(b.starts.size)]
    for code, valid in b.grams():
        at = np.flatnonzero(valid)
        word = np.searchsorted(b.ends + 1, at, side="right")
        ids.append(code[at])
        owner.append(np.minimum(word, b.starts.size - 1))
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, classes weighing alike, by damped Newton steps."""
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    scale = max(x.std(), 1e-6)
    z = np.column_stack([x / scale, np.ones(x.size)])
    beta = np.array([1.0, -x.mean() / scale])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        grad = z.T @ (w * (p - y)) + 1e-4 * beta
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from at most MAX_TRAINED labelled documents, the least by hash of their ids, and MAX_BYTES of their texts.

    Of each class documents are taken until their texts reach half of that, those over MAX_TEXT last; the text that reaches it counts whole, so no long
    text shuts out the others of its class, and a class of long texts alone has one. They are chosen on ids and lengths, so of the texts only theirs move.
    """
    known = labelled_rows(docs.select("doc_id"), labels, "toxic").select("doc_id", "y").distinct()
    half = MAX_TRAINED // 2
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.where("y = 1").orderBy(*order).limit(half).unionAll(known.where("y = 0").orderBy(*order).limit(half))
    here = F.broadcast(chosen.select(F.col("doc_id").alias("__chosen"), "y"))  # at most MAX_TRAINED rows
    sizes = docs.select("doc_id", F.octet_length(F.col("text").cast("string")).cast("long").alias("size")).join(here, F.col("doc_id") == F.col("__chosen"))
    size = F.coalesce(F.sum("size"), F.lit(0))
    sizes = sizes.groupBy("doc_id", "y").agg(size.alias("size"), (size > MAX_TEXT).alias("long"))
    before = F.sum("size").over(Window.partitionBy("y").orderBy("long", *order).rowsBetween(Window.unboundedPreceding, -1))
    within = sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < MAX_BYTES // 2)
    named = F.broadcast(within.select(F.col("doc_id").alias("__chosen"), "y"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(named, F.col("doc_id") == F.col("__chosen"))
    # one task trains, as the sample is bounded; the driver gets half a megabyte of weights
    found = rows.repartition(1).sortWithinPartitions("doc_id", "y", "text").select("text", "y").mapInArrow(lambda batches: freed(_train_task(batches)), "weight binary, slope double, shift double, prior double").collect()
    if not found:
        return Model()
    weight = None if found[0].weight is None else np.frombuffer(found[0].weight, np.float32)
    return Model(weight, found[0].slope, found[0].shift, found[0].prior)


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = [], []
    for batch in batches:
        texts += [t or "" for t in batch.column(0).to_pylist()]
        labels += batch.column(1).to_pylist()
    m = train(texts, np.array(labels, np.int64))
    weight = pa.array([None if m.weight is None else m.weight.tobytes()], pa.binary())
    yield pa.RecordBatch.from_arrays([weight, pa.array([m.slope]), pa.array([m.shift]), pa.array([m.prior])], names=["weight", "slope", "shift", "prior"])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``.

    Learns from ``labels`` (doc_id, toxic 0/1) of rows where crc32(doc_id) mod 5 is not 0. Null and empty texts get the least
    score; a null doc_id is never held out nor learned from; other label values are left out; an id or label that repeats
    counts once per label value; without any label all scores are 0. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # half a megabyte, whatever the input

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: freed(scored(batches)), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows predicted toxic; rows are judged one by one where they are read, and nothing is shuffled.

    A null or empty text has the least score and stays; repeats are judged alike; an empty table, or labels of one kind, leave
    every row whose score, then the share of ones, is below the threshold. Columns come along whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column(at).to_pylist())
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(lambda batches: freed(clean(batches)), docs.schema)
