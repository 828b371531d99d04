"""The operators against brute force, exact round trips and held-out accuracy, with null, empty, long and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from jointedge.llm import audio, chat, decontam, html_extract, mixing, quality, queries, simhash, substring, toxicity, warc
from jointedge.llm.common import saved

WORDS = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def docs_of(spark, texts, extra=None):
    rows = [(i, t, "en", f"src{(i or 0) % 4}", 0) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("fp", F.lit("clash")).withColumn("t", F.lit(1)).withColumn("label", F.lit(None).cast("string")).withColumn("n", F.lit(0)) if extra else df


def corpus():
    rng = random.Random(5)
    base, passage = words(rng, 150), words(rng, 70)
    texts = [None, "", "   \t\n", "one", "one two", "ONE two", "one two three", " ".join(base), " ".join(base[:60]), " ".join(base)]
    for k in range(12):
        near = list(base)
        near[k * 7] = "changed"
        texts.append(" ".join(near))
        texts.append(" ".join(words(rng, 40) + passage[k % 3 : 70 - k % 2] + words(rng, 30)))
    texts.append(" ".join(words(rng, 20000)))
    texts.append(" ".join(passage * 3))
    return texts


def brute_fingerprint(text, n=3):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps, distance=2):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= distance:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark):
    texts = list(enumerate(corpus()))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts, extra=True)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts}
    comp = brute_components(fps)
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == comp


@pytest.mark.parametrize("crowd,distance", [(1, 0), (1, 1), (4, 2), (10_000, 2)])
def test_links_connect_as_all_pairs_do(spark, crowd, distance):
    rng = random.Random(distance)
    fps = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(25):
            fps.add(f)
            f ^= 1 << rng.randrange(64)
            if rng.random() < 0.3:
                f ^= 1 << rng.randrange(64)
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    edges = saved(simhash.links(df, distance=distance, crowd=crowd), "e")
    assert all(bin(signed[r.a] ^ signed[r.b]).count("1") <= distance for r in edges.collect())
    labels = {r.node: r.label for r in simhash.components(edges).collect()}
    want = brute_components(signed, distance)
    least = {}
    for node, c in want.items():
        least[c] = min(least.get(c, node), node)
    assert {n: labels.get(n, n) for n in signed} == {n: least[c] for n, c in want.items()}


def test_chain_filter_keeps_every_close_pair(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(63)
        b = a
        for _ in range(rng.randrange(3)):
            b ^= 1 << rng.randrange(63)
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a long, b long").withColumn("d", F.col("a").bitwiseXOR(F.col("b")))
    for segments in (3, 4, 6):
        held = F.lit(False)
        for s in range(segments):
            held = held | simhash.chain_holds(F.col("d"), s, segments, 2)
        assert df.where(~held).count() == 0


def test_simhash_nulls_repeats_and_empty(spark):
    df = docs_of(spark, [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, None), (9, "")])
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 3), (3, 3), (3, 3), (None, 9), (9, 9)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def brute_repeats(texts, window=50):
    docs = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts}
    first = {}
    for i in sorted(docs):
        for k in range(len(docs[i]) - window + 1):
            first.setdefault(tuple(docs[i][k : k + window]), i)
    out = {}
    for i, ws in docs.items():
        gone = set()
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(ws), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(ws) if k not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("flush", [1, 400_000])
def test_substring_against_brute_force(spark, flush, monkeypatch):
    monkeypatch.setattr(substring, "_FLUSH", flush)
    texts = list(enumerate(corpus()))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeats(docs_of(spark, texts, extra=True)).collect()}
    assert got == brute_repeats(texts)


def test_substring_nulls_repeats_empty_and_stage(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = docs_of(spark, [(None, "x " + passage), (5, passage), (5, passage), (7, passage + " tail"), (8, None), (9, "")])
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.repeats(df).collect()), key=str)
    assert got == sorted([(None, 61, 60), (5, 60, 0), (5, 60, 0), (7, 61, 60), (8, 0, 0), (9, 0, 0)], key=str)
    out = substring.without_repeats(df)
    assert out.columns == df.columns and out.count() == 6
    assert {r.doc_id: r.text for r in out.collect()} == {None: "x", 5: passage, 7: "tail", 8: None, 9: ""}
    assert substring.repeats(df.limit(0)).count() == 0


def brute_contamination(texts, items, window=13):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    pats = defaultdict(set)
    for i, t in items:
        ws = norm(t)
        m = min(window, len(ws))
        for k in range(len(ws) - m + 1 if ws else 0):
            pats[tuple(ws[k : k + m])].add(str(i) if i is not None else "")
    out = []
    for i, t in texts:
        ws, hit, names = norm(t), set(), set()
        for m in {len(p) for p in pats}:
            for k in range(len(ws) - m + 1):
                if (w := tuple(ws[k : k + m])) in pats:
                    hit.update(range(k, k + m))
                    names |= pats[w]
        out.append((i, len(ws), len(hit), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(ws)))
    return out


def test_decontamination_reads_documents_once(spark, monkeypatch, tmp_path):
    """Three groups of items and documents of several batches: one scan, no table of documents in between, one group of patterns at a time."""
    rng = random.Random(12)
    items = [(f"i{k}", " ".join(words(rng, 20))) for k in range(30)]
    texts = [(i, " ".join(words(rng, 30) + (items[i % 30][1].split() if i % 4 == 0 else []))) for i in range(400)]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(decontam, "DOCUMENTS", 4000)
    written = []
    monkeypatch.setattr(decontam, "saved", lambda df, name: written.append(name) or saved(df, name))
    bench, docs = spark.createDataFrame(items, "item_id string, text string"), spark.read.parquet(f"{tmp_path}/docs")
    size = sum(len(t) for _, t in items)
    found = decontam.contamination(docs, bench, group_bytes=size // 3 + 1)
    assert written == ["stretches"] and found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    tell = lambda df: {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in df.collect()}
    assert tell(found) == tell(decontam.contamination(docs, bench)) and sum(r.contaminated for r in found.collect()) == 100


@pytest.mark.parametrize("group_bytes", [1 << 24, 300])
def test_decontamination_against_brute_force(spark, group_bytes):
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([30, 13, 12, 5, 2, 14, 40])] + [(50, "W1"), (51, None), (52, "..."), (None, "Ünï cödé w1 w2"), (3, "w9 w9 w9")]
    texts = list(enumerate(corpus()))
    for k, (i, t) in enumerate(items):
        if t:
            texts.append((100 + k, " ".join(words(rng, 30)) + " -- " + t.upper().replace(" ", ", ") + "!" + " ".join(words(rng, 500 * (k % 2)))))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = decontam.contamination(docs_of(spark, texts, extra=True), bench, group_bytes=group_bytes).collect()
    key = lambda r: (r[0], r[1])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in got), key=key) == sorted(brute_contamination(texts, items), key=key)
    none = decontam.contamination(docs_of(spark, texts), bench.limit(0)).where("n_hit > 0 or contaminated")
    assert none.count() == 0
    kept = decontam.without_contaminated(docs_of(spark, texts, extra=True), bench)
    bad = {r[0] for r in brute_contamination(texts, items) if r[4]}
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in texts} - bad


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "", None, "<p>a</p>", "é" * 100_000, "", "<p>a</p>"]
    rows = [(i, None if i == 3 else f"http://x/{i}%\r\n", h) for i, h in enumerate(html)] + [(None, "u", "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(1)).repartition(3)
    for least in (0, 1):
        folder = warc.archive_folder(spark)
        index = warc.write_archives(pages, folder, min_payload=least)
        got = {r.page_id: r for r in warc.read_records(index, folder, gap=0, most=10).collect()}
        assert len(got) == len(rows)
        for page, url, h in rows:
            raw = (h or "").encode()
            same = [p for p, _, x in rows if (x or "") == (h or "") and p is not None]
            r = got[page]
            assert r.url == url and r.payload_bytes == len(raw) and r.payload_digest == warc.payload_digest(hashlib.sha1(raw).digest())
            revisit = len(raw) >= least and page != min(same)
            assert r.record_type == ("revisit" if revisit else "response") and r.refers_to == (min(same) if revisit else None)
            assert r.payload == (None if revisit else raw)
    one = warc.read_records(index.where("page_id = 4"), folder).collect()
    assert [r.payload for r in one] == [html[4].encode()]
    assert warc.read_records(warc.write_archives(pages.limit(0), folder), folder).count() == 0


def test_chat_fold(spark):
    log = [
        (1, 1, "open", 1, "user", "hi"), (1, 2, "open", 2, "assistant", None), (1, 3, "delta", 2, None, "he"), (1, 4, "delta", 2, None, "llo"),
        (1, 5, "open", 3, "user", "again"), (1, 6, "edit", 1, None, "HI"), (1, 7, "open", 4, "assistant", "yes"), (1, 8, "regenerate", 4, None, None), (1, 9, "delta", 4, None, "no"),
        (2, 1, "open", 1, "us\ner\\n", "<|im_end|>\n\\<|"), (2, 2, "delta", 9, None, "lost"), (None, 1, "open", 1, None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string").withColumn("at", F.lit("x"))
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.reconstruct(events).collect()}
    assert got == {(1, 1): ("user", "HI"), (1, 4): ("assistant", "no"), (2, 1): ("us\ner\\n", "<|im_end|>\n\\<|"), (2, 9): ("", "lost"), (None, 1): ("", "")}
    out = chat.render(chat.reconstruct(events)).withColumn("turns", chat.parsed(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    back = {r.conv_id: ([tuple(t) for t in r.turns], r.loss) for r in out.collect()}
    assert back == {1: ([("user", "HI"), ("assistant", "no")], "no"), 2: ([("us\ner\\n", "<|im_end|>\n\\<|"), ("", "lost")], ""), None: ([("", "")], "")}
    with pytest.raises(Exception, match="event kinds"):
        chat.reconstruct(events.withColumn("kind", F.lit("odd"))).collect()
    assert chat.formatted(events.selectExpr("conv_id", "seq as turn", "role", "text").limit(0)).count() == 0


def test_chat_round_trip_of_hostile_texts(spark):
    pieces = ["<|im_start|>", "<|im_end|>", "\\", "<", "|", "\n", "é😀", "a", "<|im_end|>\n", "\\|", "\\<|"]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant"]), "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))) for c in range(40) for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(df).withColumn("turns", chat.parsed(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    for r in out.collect():
        mine = [(x[2], x[3]) for x in rows if x[0] == r.conv_id]
        assert [tuple(t) for t in r.turns] == mine
        assert r.loss == "".join(t for role, t in mine if role == "assistant")


def test_mixing_budgets_water_fill(spark):
    leaves = [("a", "en", "x", 100), ("a", "en", "y", 1000), ("a", "de", "x", 50), ("b", "en", "x", 10), ("c", "", "", 5000)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    weights = {"domain": {"a": 5, "b": 3, "c": 2}, "lang": {"en": 3, "de": 1}}
    got = {tuple(r)[:3]: r.budget for r in mixing.leaf_budgets(df, 1000, weights, 2).collect()}
    # b takes its capacity of 20; a and c share 980 by 5 : 2; inside a, de takes 100 and en the rest, where x takes 200
    assert got == {("b", "en", "x"): 20, ("c", "", ""): 280, ("a", "de", "x"): 100, ("a", "en", "x"): 200, ("a", "en", "y"): 400}
    full = {tuple(r)[:3]: r.budget for r in mixing.leaf_budgets(df, 10**9, weights, 2).collect()}
    assert full == {x[:3]: 2 * x[3] for x in leaves}
    none = mixing.leaf_budgets(df, 1000, {"domain": {"a": 0}}, 2).where("domain = 'a' and budget > 0")
    assert none.count() == 0


def test_mixture_rows(spark):
    texts = [(i, " ".join(["w"] * (i % 9))) for i in range(200)] + [(None, "a b"), (3, "a b c"), (7, None)]
    df = docs_of(spark, texts, extra=True)
    got = mixing.mixture(df, F.lit("d"), {}, 50, 2, 1).collect()
    leaves = defaultdict(int)
    for r in got:
        assert r.n_tokens > 0 and 1 <= r.epochs <= 2
        leaves[r.source] += r.n_tokens * r.epochs
    total = sum(len((t or "").split()) for _, t in texts)
    assert total * 0.4 < sum(leaves.values()) <= total // 2
    assert mixing.mixture(df.limit(0), F.lit("d"), {}).count() == 0
    assert mixing.mixture(df.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")), F.lit(None), {}).count() > 0


def test_audio_round_trip_and_shape(spark):
    texts = [(0, None), (1, ""), (2, "é" * 97), (3, "x" * 192), (4, "hello " * 5000), (5, "hello " * 5000), (None, "x" * 192)]
    df = docs_of(spark, texts, extra=True)
    got = audio.digests(df).collect()
    by = {r.doc_id: r for r in got}
    for i, t in texts:
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        media = audio.wav(padded)
        assert r.media_bytes == len(media) and r.media_sha256 == hashlib.sha256(media).hexdigest() and audio.samples_of(media) == (8000, padded)
    assert by[4].feature == by[5].feature and by[3].feature == by[None].feature
    table = audio.as_tensors(audio.patches(df).toArrow())
    assert table.schema.field("mel").type == audio.TENSOR
    long = table.filter(pa.compute.equal(table["doc_id"], 4))
    assert long.num_rows == -(-audio.analysed(audio.wav(audio.payload(texts[4][1])[1]))[0].shape[0] // audio.PATCH)
    assert audio.digests(df.limit(0)).count() == 0


def test_resampler_keeps_a_tone():
    t = np.arange(8000) / 8000
    out = audio.resampled(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    assert out.size == 6000
    spectrum = np.abs(np.fft.rfft(out[500:5500] * np.hanning(5000)))
    assert abs(np.fft.rfftfreq(5000, 1 / 6000)[spectrum.argmax()] - 440) < 3


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site head</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>Title &amp; more</h1><p><b>First   para&nbsp;graph.<br>Next line<p>Second one, with a <a href=x>link</a>.
<div class="ad">Buy!</div><script>var t="</p>";</script><!-- hidden --><table><tr><td>x</td><td>y</td></tr></table></article>
<section id="comments"><p>Reader said.</p></section><aside>Side</aside><form>Name <input></form><footer>&copy; 2024</footer></body></html>"""


def test_html_extraction(spark):
    want = "Title & more\n\nFirst para graph. Next line\n\nSecond one, with a link.\n\nx y"
    assert html_extract.main_text(PAGE) == want
    plain = "<body><div><a href=1>Home</a> <a href=2>About</a></div><div class=story>" + "".join(f"<p>Long sentence number {i}, which goes on and on, as content does.</p>" for i in range(6)) + "</div><span>x</span>"
    text = html_extract.main_text(plain)
    assert text.count("Long sentence") == 6 and "Home" not in text
    assert html_extract.main_text("just text &lt;b&gt;") == "just text <b>"
    for odd in ("<", "<p", "<a href='x", "</p></div>", "<script>x", "<!-- x", "&#0; &bogus; &amp", "<p>" * 5000):
        html_extract.main_text(odd)
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extracted(pages).collect()), key=str)
    assert got == sorted([(1, "u", want, len(want)), (1, "u", want, len(want)), (None, None, "", 0), (2, "v", "", 0)], key=str)
    assert html_extract.extracted(pages.limit(0)).count() == 0


def test_isotonic():
    v = quality.isotonic(np.array([0.0, 0.5, 0.2, 0.9, 0.8]), np.array([1, 1, 1, 1, 3.0]))
    assert np.allclose(v, [0, 0.35, 0.35, 0.825, 0.825])


def labelled(spark, n=600):
    rng = random.Random(0)
    docs, labels = [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 3 == 0
        ws = words(rng, rng.randrange(5, 200))
        if bad:
            ws = [w.upper() + "!!" for w in ws]
        if toxic:
            ws[rng.randrange(len(ws))] = rng.choice(["grumblor", "grumbla", "snarkish", "grumblix", "snarkery", "grumbl0r"])
        docs.append((i, " ".join(ws)))
        labels.append((i, int(not bad), int(toxic)))
    return docs_of(spark, docs, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


@pytest.mark.parametrize("score,label", [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_classifiers_hold_out_and_generalise(spark, score, label):
    docs, labels = labelled(spark)
    odd = docs_of(spark, [(None, "x y"), (10_000, None), (10_001, ""), (10_001, "")], extra=True)
    got = score(docs.union(odd), labels.union(labels.limit(1).selectExpr("cast(null as long)", "quality", "toxic", "text"))).collect()
    assert len(got) == 604
    truth = {r.doc_id: r[label] for r in labels.collect()}
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in test) / len(test) > 0.95
    turned = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col(label)).otherwise(F.col(label)))
    again = {r.doc_id: r.score for r in score(docs, turned).collect()}  # held-out labels are never read
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in test)
    for few in (labels.limit(0), labels.where(f"{label} = 1")):
        assert len(score(docs, few).collect()) == 600
    assert score(docs.limit(0), labels).count() == 0


def test_toxicity_of_unseen_misspellings(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    a, b = model.score(["this grumblorr thing w1 w2"])[0], model.score(["w5 w7 this thing w9"])[0]
    assert a > 0.5 > b


def test_registered_queries(spark, sf_dir):
    for name in queries.QUERIES:
        assert re.fullmatch(r"op\d+_\w+", name)
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
