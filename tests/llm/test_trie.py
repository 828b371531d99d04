"""The prefix trie against a dictionary of all prefixes, in one range and in many."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from jointedge.llm import trie
from jointedge.llm.textbytes import mixed

CONV = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t, role or "", text or ""))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1][:16], r[2][:64], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
    own = {c: [r[1:] for r in sorted(g, key=key)] for c, g in own.items()}
    seqs = {}
    for c, g in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        lender = c - int(np.fmod(c, 20))
        seqs[c] = tuple(own.get(lender, [])[:h] + g[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = set()
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, savings = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        own_saving = (len(members[p]) - 1) * len(p[-1][1].encode().split()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            savings[p[:d]] += own_saving
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if seqs[c] == p)
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], savings[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversation_rows():
    rng, rows = random.Random(8), []
    said = ["hello there", "and then  some", "", None, "more\twords here now", "x"]
    for c in range(140):
        if c % 20 == 0 and c % 3 == 0:
            continue  # families without their first conversation, and perhaps turnless ones
        for turn in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(said)))
    for c in range(1000, 1060):  # exact copies, some of which go on
        rows += [(c, t, "user", f"turn {t}") for t in range(45 + (c % 4 == 0) * (c % 7))]
    rows += [(2000, t, "user", f"long {t}") for t in range(700)] + [(-3, 0, "user", "minus")] + [(None, 0, "user", "nobody")] * 3
    return rows + [(2001, 5, "user", "twice")] * 9


def rows_of(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_trie_against_all_prefixes(spark, coalesce):
    rows = conversation_rows()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        df = spark.createDataFrame(rows, CONV).withColumn("depth", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("first", F.lit(0))
        assert rows_of(trie.trie(df)) == sorted(brute(rows), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_nothing(spark):
    assert trie.trie(spark.createDataFrame([], CONV)).collect() == []
    assert trie.trie(spark.createDataFrame([(None, 1, "user", "x")], CONV)).collect() == []


def test_a_turnless_conversation_ends_in_the_root(spark):
    c = next(i for i in range(1, 999) if i % 20 and zlib.crc32(str(i).encode()) % 4 == 3)
    row = trie.trie(spark.createDataFrame([(c, 0, "user", "gone")], CONV)).collect()
    assert [tuple(r) for r in row] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_each_prefix_is_one_node_across_panels():
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 70, 60)
    turns = [mixed(rng.integers(0, 2, n).astype(np.uint64) + np.arange(n).astype(np.uint64) * np.uint64(9)).view(np.int64) for n in sizes]
    flat = np.concatenate(turns)
    whole = trie.Shard(np.arange(60), sizes, np.zeros(60, bool), flat, flat, np.ones(flat.size, np.int64), np.zeros(flat.size, np.int64))
    prefixes = {tuple(t[:d].tolist()) for t in turns for d in range(len(t) + 1)}
    assert sum(1 for _ in whole.nodes(0, 0)) == len(prefixes)
