"""The near-dedup stage against the Jaccard similarity of all pairs."""

import random

import corpus_pipeline
from jointedge.llm import jaccard


def sets(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_first(texts, least=0.8):
    held, label = {i: sets(t) for i, t in texts}, {i: i for i, _ in texts}
    find = lambda i: i if label[i] == i else find(label[i])
    ids = sorted(label)
    for i in ids:
        for j in ids:
            if i < j and (len(held[i] & held[j]) >= least * len(held[i] | held[j])):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i for i in ids if find(i) == i}


def test_stage_links_every_pair_at_the_threshold(spark):
    rng = random.Random(4)
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    passage, texts = words(60), []
    for i in range(120):
        base = words(rng.choice([8, 30, 100, 300]))
        texts.append(base)
        for _ in range(2):  # about half of these are near copies
            near = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 30))):
                near[rng.randrange(len(near))] = f"w{rng.randrange(10**6)}"
            texts.append(near)
        if i % 3 == 0:  # one passage in unlike texts
            texts.append(words(40) + passage)
    crowd = words(200)
    for _ in range(60):
        near = list(crowd)
        near[rng.randrange(200)] = f"w{rng.randrange(10**6)}"
        texts.append(near)
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, " A b"), (1003, "a B"), (1004, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_first(rows) and len(got) < 350


def test_one_row_for_each_component(spark):
    """Texts that share a doc_id stay apart, and rows without one can be copies too."""
    long = " ".join(f"v{i}" for i in range(50))
    docs = spark.createDataFrame([(1, "x y z"), (1, "other words here"), (None, "x y z"), (2, long), (None, long + " end"), (None, "alone")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in jaccard.keep_first(docs).collect()), key=str)
    assert got == sorted([(1, "x y z"), (1, "other words here"), (2, long), (None, "alone")], key=str)
    assert jaccard.keep_first(docs.limit(0)).count() == 0
