"""Near-dedup among the texts of one large key."""

import random

import numpy as np
from jointedge.llm import jaccard
from jointedge.llm.common import spread_join
from pyspark.sql import functions as F
from test_jaccard import brute_first


def test_links_of_a_large_key_without_a_hub(spark, monkeypatch):
    """All texts share their only key; pairs of near copies meet though no drawn text knows either."""
    monkeypatch.setattr(jaccard, "band_keys", lambda held: np.zeros(1, np.int64))
    monkeypatch.setattr(jaccard, "_BLOCK", 16, raising=False)
    rng = random.Random(2)
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    passage, texts = words(20), []
    for _ in range(70):
        base = passage + words(60)
        texts += [base, [*base[:-1], "end"]]
    crowd = words(100)
    texts += [[*crowd[:-1], f"w{i}"] for i in range(40)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = [r.doc_id for r in jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == 71 and set(got) == brute_first(rows)


def test_rows_do_not_grow_with_the_pairs_of_a_large_key(spark, monkeypatch):
    """Copies of one text with too many changes to link are near in pairs; no table holds these pairs, and all links are found."""
    counts, saved = {}, jaccard.saved

    def counted(df, name):
        out = saved(df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(jaccard, "saved", counted)
    monkeypatch.setattr(jaccard, "band_keys", lambda held: np.zeros(1, np.int64))
    monkeypatch.setattr(jaccard, "_BLOCK", 64)
    rng = random.Random(3)
    base, texts = [f"v{i}" for i in range(150)], []
    for i in range(240):
        near = list(base)
        for at in rng.sample(range(30), 1 if i % 4 == 0 else 4):
            near[5 * at + rng.randrange(5)] = f"w{rng.randrange(10**6)}"
        texts.append(near)
    for near in texts[1:200:10]:  # links between texts that are not linked to the rest
        texts.append([*near[:-1], "end"])
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = [r.doc_id for r in jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_first(rows) and 100 < len(got) < 200
    assert max(counts.values()) <= 8 * len(rows), counts


def test_keys_of_many_rows_join_apart(spark):
    """All rows of keys that repeat come with their values, whether or not some key is heavy."""
    for crowd in (3, 2000):
        keys = [k for k in range(700) for _ in range(1 + k % 2)] + [1] * crowd
        rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key long, node long")
        side = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("x")).where("n > 1")
        got = {(r.key, r.node, r.n, r.x) for r in spread_join(rows, "key", side, "n").collect()}
        assert got == {(k, i, keys.count(k), keys.index(k)) for i, k in enumerate(keys) if k % 2}
