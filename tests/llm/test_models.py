"""Trained models and searches against dense or slow versions of the same."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jointedge.llm import chat, decontam, jaccard, quality, substring, toxicity
from jointedge.llm.common import saved, temporary


def test_ridge_of_partition_sums_is_that_of_all_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, quality.STATISTICS))
    y = (x[:, 0] + 0.3 * x[:, 1] ** 2 > 0).astype(int)
    rows = [(v.tolist(), int(k), i % 4 == 0) for i, (v, k) in enumerate(zip(x, y))]
    model = quality.fit(spark.createDataFrame(rows, "x array<double>, y int, calibrate boolean").repartition(5))
    z = model.features(x[np.arange(300) % 4 != 0])
    n, width = z.shape
    dense = np.linalg.solve(z.T @ z + quality.RIDGE * n * np.diag([0.0, *[1.0] * (width - 1)]) + 1e-9 * np.eye(width), z.T @ y[np.arange(300) % 4 != 0])
    assert np.allclose(model.ridge, dense, atol=1e-6)


def test_passage_scores_are_averages_over_subword_bags():
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS).astype(np.float32))
    texts = ["", None, "one", "Word " * 5, " ".join(f"w{i}é" for i in range(40)), "a b c d e f g"]

    for text, got in zip(texts, model.logits(texts)):
        words = (text or "").lower().split()
        starts = range(0, max(1, len(words) - toxicity.PASSAGE + toxicity.STRIDE), toxicity.STRIDE)
        best = -50.0
        for s in starts if words else ():
            b = toxicity.bags([" ".join(words[s : s + toxicity.PASSAGE]).encode()])
            total, count = toxicity.word_sums(b, model.weight)
            best = max(best, total.sum() / count.sum())
        assert got == pytest.approx(best, abs=1e-5)


def test_joint_training_follows_the_dense_gradient(monkeypatch):
    """A step of Adam moves each parameter against the sign of its gradient, which a dense bag matrix gives."""
    monkeypatch.setattr(toxicity, "STEPS", 1)
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 50, size=k) for k in (3, 1, 4, 2, 5)]
    held = [np.array(p) for p in ([0, 1], [2], [3, 4, 0], [1, 1])]
    y, w = np.array([1, 0, 1, 0]), np.full(4, 0.25, np.float32)
    e, u, c = rng.normal(size=(50, 4)).astype(np.float32), rng.normal(size=(4, 2)).astype(np.float32), np.zeros(2, np.float32)
    ragged = lambda rows: toxicity.Ragged(np.concatenate(rows), np.array([len(r) for r in rows]))
    e2, u2, _ = toxicity._softmax_fit(e, u, c, ragged(words), ragged(held), y, w)
    mean = np.zeros((4, 50))
    for i, p in enumerate(held):
        for k in p:
            np.add.at(mean[i], words[k], 1)
    mean /= mean.sum(axis=1, keepdims=True)
    p = np.exp(mean @ e @ u + c)
    g = (p / p.sum(axis=1, keepdims=True) - np.eye(2)[y]) * w[:, None]
    used = mean.sum(axis=0) > 0
    for moved, grad in (((e2 - e)[used], (mean.T @ (g @ u.T))[used] + toxicity.DECAY / used.sum() * e[used]), (u2 - u, (mean @ e).T @ g + toxicity.DECAY * u)):
        clear = np.abs(grad) > 1e-5
        assert (np.sign(moved)[clear] == -np.sign(grad)[clear]).all()
    assert (e2[~used] == e[~used]).all()


def test_windows_come_from_the_automaton(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(1, "a b " + passage), (2, passage + " c"), (3, "d " * 80)], "doc_id long, text string")
    removed = lambda: {r.doc_id: r.n_removed for r in substring.repeats(docs).collect()}
    assert removed() == {1: 0, 2: 60, 3: 0}
    clash = docs.withColumns({"__id": F.lit(1), "__t": F.lit(2), "__kept": F.lit(3)})
    assert {r.doc_id: len(r.text.split()) for r in substring.without_repeats(clash).collect()} == {1: 62, 2: 1, 3: 80}
    monkeypatch.setattr(substring, "_SHARD", 1)  # every shard is salted
    assert removed() == {1: 0, 2: 60, 3: 0}
    # what the automaton does not find holds no window
    texts, ids = ["a b " + passage, passage + " c"], np.array([1, 2])

    def held():
        shard = substring.Shard(50, 12)
        phrases = passage.split()
        shard.add([" ".join(phrases[i : i + 12]).encode() for i in range(len(phrases) - 11)])
        list(shard.stream(ids, ids, texts))
        return shard.held

    assert held() == 13 + 12
    monkeypatch.setattr(substring.Shard, "occurrences", lambda self, block: np.empty(0, np.int64))
    assert held() == 0


def test_a_large_benchmark_compiles_into_bounded_tables():
    rng = np.random.default_rng(4)
    vocabulary = [f"v{i}" for i in range(4000)]
    items = [(f"i{k}", " ".join(rng.choice(vocabulary, 300)).encode()) for k in range(5000)]
    group = decontam.compiled(items, 13)
    arrays = [getattr(p, k).nbytes for p in group.lengths for k in ("shift", "suffixes", "prefixes", "keys", "offset", "size", "first", "items")]
    assert sum(arrays) < 20 * len(group.data)
    found = list(decontam.scan(["x y " + items[7][1].decode().upper() + " z", "v1 v2"], group))
    assert [(n, int(hit.sum()), names) for n, hit, names in found] == [(303, 300, ["i7"]), (2, 0, [])]


def test_logs_of_conversations_are_folded(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "hi"), (1, 2, "user", None), (1, 3, "assistant", "")], "conv_id long, turn long, role string, text string")
    log = chat.rows_as_events(rows)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"open", "delta", "edit", "regenerate"}
    got = [(r.role, r.text) for r in chat.reconstruct(log).orderBy("at").collect()]
    assert got == [("user", "hello there"), ("assistant", "hi"), ("user", ""), ("assistant", "")]


def test_temporary_tables_go(spark):
    with temporary(spark):
        held = saved(spark.range(5).toDF("x"), "t")
        path = held.inputFiles()[0].removeprefix("file://")
        assert held.count() == 5
    import os

    assert not os.path.exists(path)


def test_one_long_text_does_not_shut_out_its_class(spark, monkeypatch):
    rng = random.Random(7)
    ordinary = lambda bad: " ".join([rng.choice(["mild", "plain", "kind", "even"]) for _ in range(20)] + (["grumblor"] if bad else []))
    rows = [(i, ordinary(i % 2 == 1), i % 2) for i in range(1, 120)]
    monkeypatch.setattr(toxicity, "MAX_BYTES", 12_000)
    monkeypatch.setattr(toxicity, "MAX_TEXT", 3_000)
    for late in ((), (1000, 1001)):  # long toxic texts under any hash order
        held = rows + [(i, "grumblor " * 5000, 1) for i in late]
        docs = spark.createDataFrame([r[:2] for r in held], "doc_id long, text string")
        labels = spark.createDataFrame([(r[0], r[2]) for r in held], "doc_id long, toxic int")
        model = toxicity.fit(docs, labels)
        assert model.weight is not None
        score = model.score(["mild plain grumblor kind", "mild plain kind even"])
        assert score[0] >= 0.5 > score[1]
    only = spark.createDataFrame([(i, "grumblor " * 5000) for i in range(1, 9)] + [(i, ordinary(False)) for i in range(10, 60)], "doc_id long, text string")
    marks = only.select("doc_id", (F.col("doc_id") < 9).cast("int").alias("toxic"))
    assert toxicity.fit(only, marks).weight is not None


def test_stages_keep_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "mild words", 5, "x"), (2, None, 6, "y"), (3, "", 7, None)], "doc_id long, text string, score int, y string").withColumn("__chosen", F.lit(1)).withColumn("label", F.lit("l")).withColumn("node", F.lit(2))
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.without_toxic(docs, labels).columns == docs.columns and toxicity.without_toxic(docs, labels).count() == 3
    assert toxicity.without_toxic(docs.limit(0), labels).count() == 0 and toxicity.without_toxic(docs, labels.limit(0)).count() == 3
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
