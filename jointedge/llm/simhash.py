"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a small Hamming distance.

Fingerprints are computed in Arrow batches. Candidate pairs come from a pigeonring filter on distinct fingerprints:
with the bits cut into segments on a ring and at most ``distance`` differing bits, some segment starts a chain
in which each prefix of l segments has at most ``l * distance / segments`` differences. The links of the chain
whose budget is zero are an equi-join on their bits; the longer prefixes are tested on the joined rows before the full
Hamming check. More segments make the exact part of the chain longer (21 bits of 3 segments, 26 of 5, up to 31 of 31), so
their number is chosen by the count of fingerprints, and a key's share of them stays small on average.

Hot keys (a large group of near copies) remain at any length. A chain value that more than ``crowd`` fingerprints share
is not joined with itself: its fingerprints are each filed under itself and every fingerprint one bit away, and all
that are filed under the same value are within two bits of each other, so one link to the smallest of them keeps every
connection. That costs 65 rows per fingerprint and no pairs, and holds for ``distance`` up to 2.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import as_id, drop_saved, from_id, map_batches, saved, spread_lookup

_SEED = 42


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """Bit i is set if it is set in more than half of the shingles' XXH64; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle_words + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(joined, _SEED)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20).tolist()
    starts, ends = [0, *(s + 1 for s in spaces)], [*spaces, len(joined)]
    hashes = np.fromiter((digest(joined[s:e], _SEED) for s, e in zip(starts, ends[shingle_words - 1 :])), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for each row of ``docs``; a null text has no words."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in batch.column(1)), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), each, "doc_id long, fp long")


def segment_bits(segments: int) -> list[tuple[int, int]]:
    """Offset and width of each segment of the 64 bits."""
    edges = [round(64 * i / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _mask(bits: list[tuple[int, int]]) -> Column:
    value = sum(((1 << width) - 1) << at for at, width in bits)
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")


def exact_length(segments: int, distance: int) -> int:
    """How many segments a chain begins with whose budget is zero."""
    return max(n for n in range(segments + 1) if n * distance // segments == 0)


def segments_for(count: int, distance: int, per_key: int = 8) -> int:
    """The fewest segments whose exact chains give each key at most ``per_key`` of ``count`` fingerprints on average, 31 at most."""
    tried = range(distance + 1, 32, max(1, distance))
    return next((m for m in tried if count <= per_key << (64 * exact_length(m, distance) // m)), tried[-1])


def _chain(fp: Column, start: int, segments: int, distance: int) -> Column:
    """The bits of the exact part of the chain that starts at segment ``start``."""
    bits = segment_bits(segments)
    return fp.bitwiseAND(_mask([bits[(start + j) % segments] for j in range(exact_length(segments, distance))]))


def chain_holds(differ: Column, start: int, segments: int, distance: int) -> Column:
    """Whether the chain that starts at segment ``start`` keeps every prefix within its proportional budget."""
    bits = segment_bits(segments)
    held = F.lit(True)
    for length in range(1, segments + 1):
        ring = [bits[(start + j) % segments] for j in range(length)]
        held = held & (F.bit_count(differ.bitwiseAND(_mask(ring))) <= length * distance // segments)
    return held


def ring_holds(differ: Column, segments: int, distance: Column) -> Column:
    """Whether some chain on a ring of segments, given the array of their differences, keeps every prefix within its budget."""
    places = lambda start: F.transform(F.sequence(F.lit(1), F.lit(segments)), lambda n: F.struct(n.alias("n"), F.get(differ, (start + n - 1) % segments).alias("d")))
    none = F.struct(F.lit(0).alias("total"), F.lit(True).alias("held"))
    step = lambda acc, p: F.struct((acc["total"] + p["d"]).alias("total"), (acc["held"] & ((acc["total"] + p["d"]) * segments <= p["n"] * distance)).alias("held"))
    return F.exists(F.sequence(F.lit(0), F.lit(segments - 1)), lambda start: F.aggregate(places(start), none, step)["held"])


def links(distinct: DataFrame, distance: int = 2, segments: int | None = None, crowd: int = 64) -> DataFrame:
    """a < b for fingerprints of ``distinct`` (one column fp): connected by these exactly as by all pairs within ``distance`` bits.

    Pairs from uncrowded chains are each within ``distance``; so are the links of crowded ones.
    """
    if segments is None:
        segments = segments_for(distinct.count(), distance)
    if not 0 <= distance <= 2 or distance >= segments:
        raise ValueError("distance is 0, 1 or 2 and below the number of segments")
    fp = F.col("fp")
    filed = distinct.select("fp", F.posexplode(F.array(*(_chain(fp, start, segments, distance) for start in range(segments)))).alias("part", "value"))
    crowded = saved(filed.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > crowd), "crowded")
    where = saved(spread_lookup(filed, ["part", "value"], F.col("fp"), crowded, "n", ["n"]), "filed")
    calm = where.where(F.col("n").isNull())
    left = calm.select(F.col("fp").alias("a"), "part", "value")
    right = calm.select(F.col("fp").alias("b"), "part", "value")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    held = F.lit(False)
    for start in range(segments):
        held = held | ((F.col("part") == start) & chain_holds(differ, start, segments, distance))
    pairs = left.join(right, ["part", "value"]).where((F.col("a") < F.col("b")) & held & (F.bit_count(differ) <= distance)).select("a", "b")
    near = where.where(F.col("n").isNotNull()).select("fp").distinct()
    one_off = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long") for i in range(64)))
    reach = {2: one_off, 1: one_off, 0: F.array(F.lit(0).cast("long"))}[distance]
    shelves = near.select("fp", F.explode(reach).alias("flip")).select("fp", fp.bitwiseXOR(F.col("flip")).alias("shelf"))
    if distance == 1:  # within one bit: one of the two is the shelf itself
        shelves = shelves.withColumn("own", F.col("fp") == F.col("shelf"))
        star = shelves.groupBy("shelf").agg(F.max("own").alias("own"), F.collect_set("fp").alias("fps")).where("own").select(F.col("shelf"), F.explode("fps").alias("fp"))
        star = star.select(F.least("shelf", "fp").alias("a"), F.greatest("shelf", "fp").alias("b"))
    else:
        low = shelves.groupBy("shelf").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps"))  # at most 65 on a shelf
        star = low.select("a", F.explode("fps").alias("b"))
    return pairs.union(star.where("a < b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node reachable over ``edges`` (a, b), for each node that has an edge.

    Each round takes the least label among the neighbours, then the label of that label, and writes the result to the
    shared folder, so the rounds grow with the logarithm of the longest path in the usual case and lineage stays short. Nodes
    with very many edges and labels of very many nodes are looked up as hot keys.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    degrees = saved(both.groupBy("a").agg(F.count("*").alias("n"), F.least(F.col("a"), F.min("b")).alias("label")), "degrees")
    nodes, ends = degrees.agg(F.count("*"), F.sum("n")).first()
    labels, moved = saved(degrees.select(F.col("a").alias("node"), "label"), "labels"), True
    while moved:
        named = degrees.select(F.col("a").alias("b"), "n").join(labels.withColumnRenamed("node", "b"), "b")
        told = spread_lookup(both, ["b"], F.col("a"), named, "n", ["label"], ends or 0)
        heard = told.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        near = saved(labels.join(heard, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("now")), "near")
        hop = near.groupBy("now").agg(F.count("*").alias("n")).join(labels.select(F.col("node").alias("now"), F.col("label").alias("far")), "now").where("far < now")
        new = spread_lookup(near, ["now"], F.col("node"), hop, "n", ["far"], nodes)
        seen = Observation()
        new = saved(new.select("node", "was", F.least("now", "far").alias("label")).observe(seen, F.count_if(F.col("label") < F.col("was")).alias("moved")), "labels")
        moved = seen.get["moved"] > 0
        for old in (labels, near):
            drop_saved(old)
        labels = new.select("node", "label")
    return labels


def near_duplicates(docs: DataFrame, distance: int = 2, shingle_words: int = 3, segments: int | None = None, crowd: int = 64) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) for each row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other. Rows that share a doc_id each get a row. A null
    doc_id sorts after all others and comes back as null. Other columns are not read.
    """
    prints = saved(fingerprints(docs, shingle_words).withColumn("doc_id", as_id()), "prints")
    groups = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "groups")
    edges = links(groups.select("fp"), distance, segments, crowd)
    named = edges.join(groups.select(F.col("fp").alias("a"), F.col("first").alias("ia")), "a").join(groups.select(F.col("fp").alias("b"), F.col("first").alias("ib")), "b")
    # labels are doc ids: two fingerprints may share a first id only if a doc_id repeats, which joins them
    label = components(named.select(F.col("ia").alias("a"), F.col("ib").alias("b")).where("a <> b"))
    classes = saved(groups.join(label.withColumnRenamed("node", "first"), "first", "left").select("fp", "n", F.coalesce("label", "first").alias("component_id")), "classes")
    out = spread_lookup(prints, ["fp"], F.col("doc_id"), classes, "n", ["component_id"])
    return out.select(from_id("doc_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), from_id("component_id").alias("component_id"))
