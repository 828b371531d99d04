"""The stages of the pipeline against brute-force versions of their decisions."""

import random

import corpus_pipeline
from jointedge.llm import toxicity
from test_operators import brute_components, brute_contamination, brute_fingerprint, brute_repeats


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(500)]
    ws = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, item = ws(60), ws(20)
    docs, labels = [], []
    for i in range(300):
        text = ws(rng.randrange(60, 120))
        if i % 10 == 3:
            text[5] = rng.choice(["grumblor", "grumblix", "grumbla"])
        if i % 10 == 4:
            text[10:10] = passage
        if i % 10 == 5:
            text = ws(30) + item + ws(20)
        if i % 10 == 6 and i > 20:
            text = docs[i - 20][1].split()
        docs.append((i, " ".join(text), "en", f"src{i % 20}", 0))
        labels.append((i, 1, int(i % 10 == 3)))
    docs += [(400, None, None, None, None), (401, "", "", "", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf_dir, now = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in now.collect()]
        out = stage(spark, now, sf_dir)
        if k < 4:
            assert out.columns == columns
            out.write.parquet(f"{tmp_path}/stage{k}")
            now = spark.read.parquet(f"{tmp_path}/stage{k}")
            after = {r.doc_id: r.text for r in now.collect()}
            assert len(after) == now.count()
        if k == 0:
            bad = {r.doc_id for r in toxicity.toxicity(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).where("predicted = 1").collect()}
            assert set(after) == {i for i, _ in before} - bad and {i for i in range(300) if i % 10 == 3} <= bad
        if k == 1:
            comp = brute_components({i: brute_fingerprint(t) for i, t in before})
            assert set(after) == {i for i, c in comp.items() if i == c}
        if k == 2:
            brute = brute_repeats(before)
            for i, t in before:
                assert len((after[i] or "").split()) == brute[i][0] - brute[i][1]
                assert brute[i][1] or after[i] == t
        if k == 3:
            assert set(after) == {r[0] for r in brute_contamination(before, [(1, " ".join(item))]) if not r[4]}
        if k == 4:
            assert {r.doc_id for r in out.collect()} <= {i for i, _ in before}
            tokens = sum(len((t or "").split()) for _, t in before)
            assert 0.4 * tokens < sum(r.n_tokens * r.epochs for r in out.collect()) <= tokens / 2
    assert corpus_pipeline.run(spark, sf_dir).count() == out.count()
