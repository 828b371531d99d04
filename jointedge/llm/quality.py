"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

One pass over the texts gives about twenty statistics per document. Random Fourier features of the standardised statistics
approximate a Gaussian kernel; each task adds up its part of the normal equations, Spark sums the parts, and the driver solves
one system of fixed size. Isotonic regression on labelled rows that the fit did not see turns scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import held_out, saved

FEATURES = 256
BANDWIDTH = 6.0  # of the Gaussian kernel, in standard deviations
RIDGE = 1e-3  # times the rows
SEED = 7
CALIBRATION_BINS = 1000
MAX_LABELLED = 400_000  # rows that a fit takes at most, chosen by hash of the id; a documented bound
FIT_TASKS = 8

# byte classes: lower, upper, digit, space, newline, comma or stop, ! or ?, bar, other ASCII symbol, other (non-ASCII)
_CLASS = np.full(256, 9, np.int64)
_CLASS[:128] = 8
for _set, _k in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), (b" \t", 3), (b"\n\r", 4), (b".,;:", 5), (b"!?", 6), (b"|", 7)):
    _CLASS[list(_set)] = _k
STATISTICS = 21


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of STATISTICS numbers per text; a null text is empty."""
    out = []
    for _, run in tb.blocks(texts):
        data, first, last = tb.joined(run, b"\n")
        n = len(run)
        owner = np.repeat(np.arange(n), last - first + 1)
        classes = np.bincount(owner * 10 + _CLASS[data], minlength=n * 10).reshape(n, 10).astype(float)
        classes[:, 4] -= 1  # the separator
        size = np.maximum(1, last - first)[:, None]
        starts, ends = tb.words(~tb.SPACE[data])
        hashes = tb.span_hashes(data, starts, ends)
        word_of = owner[starts]
        words = np.bincount(word_of, minlength=n).astype(float)
        per_word = lambda x: np.bincount(word_of, x, minlength=n) / np.maximum(1, words)
        length = (ends - starts).astype(float)
        kinds = np.concatenate([[0], np.cumsum(_CLASS[data] == 1)])
        upper = (kinds[ends] - kinds[starts]) >= np.maximum(2, length * 0.6)
        symbol = np.isin(_CLASS[data[ends - 1]], (6, 7, 8)) if ends.size else np.empty(0)
        distinct = lambda h, of: np.bincount(np.unique(np.stack([of.astype(np.uint64), h]), axis=1)[0].astype(np.int64), minlength=n) if h.size else np.zeros(n)
        grams = tb.gram_hashes(hashes, 3)
        whole = word_of[: grams.size] == word_of[2:] if grams.size else np.empty(0, bool)
        gram_of = word_of[: grams.size][whole]
        n_grams = np.bincount(gram_of, minlength=n)
        line_starts, line_ends = tb.words(data != 0x0A)
        lines = np.bincount(owner[line_starts], minlength=n)
        line_hashes = tb.span_hashes(data, line_starts, line_ends)
        out.append(
            np.column_stack(
                [
                    classes / size,
                    np.log1p(size[:, 0]),
                    np.log1p(words),
                    per_word(length),
                    np.sqrt(np.maximum(0, per_word(length**2) - per_word(length) ** 2)),
                    per_word(upper),
                    per_word(symbol),
                    distinct(hashes, word_of) / np.maximum(1, words),
                    distinct(grams[whole], gram_of) / np.maximum(1, n_grams),
                    np.log1p(words / np.maximum(1, lines)),
                    distinct(line_hashes, owner[line_starts]) / np.maximum(1, lines),
                    (words == 0).astype(float),
                ]
            )
        )
    return np.concatenate(out) if out else np.empty((0, STATISTICS))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of the text, for each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * STATISTICS, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(each, f"doc_id {kind}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    ridge: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None  # raw scores and calibrated values, both rising
    prior: float = 0.5

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.standard_normal((STATISTICS, FEATURES)) / BANDWIDTH
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.sqrt(2 / FEATURES) * np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ w + b)
        return np.column_stack([np.ones(len(x)), z])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.ridge is None:
            return np.full(len(x), self.prior)
        raw = self.raw(x)
        if self.steps is None:
            return np.clip(raw, 0, 1)
        return np.interp(raw, *self.steps)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to ``values`` in weighted squares, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist()):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else np.empty(0)


def fit(labelled: DataFrame) -> Model:
    """A model from rows (x, y in 0 and 1, calibrate boolean); without rows of both kinds it scores the share of ones, or 0.5."""
    moments = labelled.select("y", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.avg("y").alias("y")).orderBy("i").collect()
    if not moments or moments[0].y in (0.0, 1.0):
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), prior=float(moments[0].y) if moments else 0.5)
    model = Model(np.array([r.m for r in moments]), np.array([max(r.s, 1e-9) for r in moments]), prior=moments[0].y)
    width = FEATURES + 2  # the features, a one, and the label

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            z = np.column_stack([model.features(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False)])
            total += z.T @ z
        at = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array((at[0] * width + at[1]).astype(np.int32)), pa.array(total[at])], names=["cell", "v"])

    rows = labelled.where("not calibrate").select("x", F.col("y").cast("double").alias("y"))
    cells = rows.repartition(FIT_TASKS).mapInArrow(parts, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((width, width))
    cell = cells["cell"].to_numpy()
    total[cell // width, cell % width] = cells["v"].to_numpy()
    total = np.triu(total) + np.triu(total, 1).T
    gram, right = total[:-1, :-1], total[:-1, -1]
    n = gram[0, 0]
    if not n:
        return model
    model.ridge = np.linalg.solve(gram + RIDGE * n * np.diag([0.0, *[1.0] * FEATURES]) + 1e-9 * np.eye(width - 1), right)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_matrix(batch.column(0)))
            at = np.clip((raw + 0.5) / 2 * CALIBRATION_BINS, 0, CALIBRATION_BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw), batch.column(1)], names=["bin", "raw", "y"])

    kept = labelled.where("calibrate").select("x", F.col("y").cast("double").alias("y"))
    bins = kept.mapInArrow(binned, "bin int, raw double, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("raw").alias("raw"), F.avg("y").alias("y")).orderBy("bin").collect()
    if len(bins) > 1:
        values = isotonic(np.array([r.y for r in bins]), np.array([float(r.n) for r in bins]))
        raw = np.array([r.raw for r in bins])
        edges = np.flatnonzero(np.concatenate([[True], np.diff(values) > 0]))  # the middle of each pool, joined by lines
        ends = np.append(edges[1:], values.size)
        middle = np.array([np.average(raw[a:b], weights=[r.n for r in bins[a:b]]) for a, b in zip(edges, ends)])
        # beyond the outer pools a small slope keeps the order of scores
        model.steps = (np.concatenate([[-1.0], middle, [2.0]]), np.concatenate([[values[0] * 0.9], values[edges], [values[-1] + (1 - values[-1]) * 0.1]]))
    return model


def labelled_rows(documents: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``documents`` (doc_id and more) joined with the 0/1 labels that may be learned from, as y; at most about MAX_LABELLED rows."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").alias("__labelled"), F.col(label).cast("int").alias("y"))
    total = usable.count()
    if total > MAX_LABELLED:
        usable = usable.where(F.pmod(F.xxhash64("__labelled"), F.lit(1 << 20)) < (MAX_LABELLED << 20) // total)
    return documents.join(usable, F.col("doc_id") == F.col("__labelled"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``.

    Learns from ``labels`` (doc_id, quality 0/1) of rows where crc32(doc_id) mod 5 is not 0; of these, remainder 4 calibrates. Null and
    empty texts are scored like any other; a null doc_id is never held out nor learned from; other label values are left
    out; an id or label that repeats counts each time. Other columns are not read.
    """
    facts = saved(document_statistics(docs), "statistics")
    known = labelled_rows(facts, labels, "quality").withColumn("calibrate", F.crc32(F.col("doc_id").cast("string")) % 5 == 4)
    known = saved(known.select("x", "y", "calibrate"), "labelled")
    model = fit(known)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.clip(model.score(_matrix(batch.column(1))), 0, 1) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    kind = facts.schema["doc_id"].dataType.simpleString()
    out = facts.select("doc_id", "x").mapInArrow(scored, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
