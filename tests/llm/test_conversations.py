"""Conversation repair against exhaustive search, SentencePiece against the library."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from jointedge.llm import pieces, repair

CONV = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def conversations_of(spark, rows):
    return spark.createDataFrame(rows, CONV).withColumn("code", F.lit("clash")).withColumn("part", F.lit(7)).withColumn("n", F.lit(0)).withColumn("id", F.lit(None).cast("long"))


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(c, t, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def brute_repair(rows):
    """rows in order: the summary's columns, by trying all edits."""
    seen, faults = set(), []
    for _, role, text in rows:
        fault = "blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if text.strip(WHITE)[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
    def after(state, c):
        new = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state]
        return new.get(c)

    @cache
    def best(i, state, inserted):
        options = []
        if i == len(rows):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            _, role, text = rows[i]
            cost, audit, turns = best(i + 1, state, 0)
            options.append((2 + cost, "D" + audit, turns))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                for edit, price, new in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    to = after(state, new[:1])
                    if to:
                        cost, audit, turns = best(i + 1, to, 0)
                        options.append((price + more + cost, edit + audit, ((new, text), *turns)))
        if inserted < 3:
            for new in ("user", "assistant"):
                if to := after(state, new[0]):
                    cost, audit, turns = best(i, to, inserted + 1)
                    options.append((5 + cost, "I" + audit, ((new, ""), *turns)))
        return min(options, default=(10**9, "", ()))

    cost, audit, turns = best(0, "", 0)
    numbers = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest(),
    }


def conversation_rows():
    rng, rows = random.Random(3), []
    roles, texts = ["user", "assistant", "system", "u", "", None, "tool", "User"], ["Yes.", "No!", "open", "", " \t\n", "end. \n", None, "same?", "é?", "x" * 3000 + "."]
    for c in [*range(60), -7, None]:
        turn = 0
        for _ in range(rng.randint(1, 9)):
            turn += rng.choice([0, 1, 1, 1, 2])
            rows.append((c, rng.choice([turn, turn, turn, turn, turn, None]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}."))
    for turn in range(400):  # one long conversation
        rows.append((500, turn, rng.choice(roles[:3]), rng.choice(["Hm", f"{turn}.", f"{turn}", "", "Again!"])))
    rows += [(501, 3, "user", "twice.")] * 40
    return rows


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], [])
    for c, t, role, text in brute_damage(rows):
        groups[c].append((t, role, text))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1][:16], r[2][:64], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
    return {c: brute_repair(sorted(g, key=key)) for c, g in groups.items()}


@pytest.mark.parametrize("size", [None, 3])
def test_repair_against_exhaustive_search(spark, size):
    rows = conversation_rows()
    got = {r.conv_id: r for r in repair.summary(repair.repaired(repair.damaged(conversations_of(spark, rows)), size)).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    for c, w in want.items():
        assert {k: got[c][k] for k in w} == w, c


def test_repair_spreads_a_long_conversation(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"{i}") for i in range(3000)] + [(2, 0, "user", "a.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one task
    try:
        found = repair.repaired(conversations_of(spark, rows).withColumn("kept", F.lit(True)), size=50)
        pieces_ = [r for r in found.collect() if r.conv_id == 1]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(pieces_) >= 60 and len({r.part for r in pieces_}) > 3
    sizes = [len(r.audit) - r.audit.count("I") for r in pieces_]
    assert max(sizes) <= 50 and sum(sizes) == 3000


def test_repair_of_empty_tables_and_dropped_conversations(spark):
    assert repair.summary(repair.repaired(spark.createDataFrame([], CONV))).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = repair.summary(repair.repaired(repair.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], CONV)))).first()
    assert (row.conv_id, row.gaps, row.cost, row.audit, row.repaired_sha256) == (gone, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_walk_recomputes_from_checkpoints():
    rng = random.Random(4)
    codes = bytes(repair.code(rng.randint(0, 3), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(500))
    after, vectors = repair.END, [repair.END]
    for of in reversed(codes):
        after = repair.back(of, after)
        vectors.append(after)
    assert [tuple((repair.matrix(codes[i:]) + repair.END).min(axis=1)) for i in range(0, 500, 50)] == [vectors[500 - i] for i in range(0, 500, 50)]
    whole, state = repair.walk(codes, 0, repair.END)
    parts, at = [], 0
    for i in range(0, 500, 37):
        part, at = repair.walk(codes[i : i + 37], at, vectors[max(0, 500 - i - 37)])
        parts += part
    assert parts == whole and at == state


def model():
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def piece_texts():
    rng = random.Random(6)
    bits = [" ", " ", "  ", "▁", "a", "th", "é", "日本", "\t", "\n", "\x00", "　", "\U0001f600", "<s>", "ing", " " * 40, "x" * 200]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    return [None, "", " ", "   ", "▁", "a", "word " * 50_000, "same text", "same text", *texts]


def test_pieces_equal_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    texts, processor = piece_texts(), SentencePieceProcessor(model_proto=model())
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int").union(spark.createDataFrame([(None, "null id", 1)], "doc_id long, text string, ids int"))
    got = {r.doc_id: r for r in pieces.encoded(docs, model()).collect()}
    assert len(got) == len(texts) + 1
    for i, text in [*enumerate(texts), (None, "null id")]:
        want = processor.encode(text or "", add_eos=True)
        assert got[i].ids == want and got[i].decoded == processor.decode(want), text
    assert pieces.encoded(docs.limit(0), model()).count() == 0


def test_chunks_are_segmented_once_and_a_full_table_begins_anew():
    from sentencepiece import SentencePieceProcessor

    processor, asked = SentencePieceProcessor(model_proto=model()), []

    class Counted:
        def __getattr__(self, name):
            return getattr(processor, name)

        def encode(self, texts, **how):
            asked.extend(texts)
            return processor.encode(texts, **how)

    table = pieces.Chunks(Counted())
    for _ in range(3):
        assert [x.tolist() for x in table.encode(["one two one", "two  three"])] == processor.encode(["one two one", "two  three"])
    assert sorted(asked) == [" three", "one", "two"]
    small = pieces.Chunks(processor, limit=4)
    for text in ("one two", "three four", "one two"):
        assert small.encode([text])[0].tolist() == processor.encode(text)
        assert len(small.place) <= 2


def test_models_whose_pieces_cross_markers_are_not_cut():
    from sentencepiece import sentencepiece_model_pb2 as pb

    assert pieces.separable(model())
    proto = pb.ModelProto()
    proto.ParseFromString(model())
    proto.pieces.add(piece="the▁of", score=-1.0)
    assert not pieces.separable(proto.SerializeToString())
