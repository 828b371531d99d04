"""Near-duplicate texts for stages on word shingles: fixed keys name candidates, SimHash and pigeonring prune, exact Jaccard similarity decides.

64 bits cannot name every pair at a Jaccard similarity of 0.8: its fingerprints differ by estimate in about 10 bits, in some
pairs in more than 15, and so many bits also link unrelated texts, a number that grows with the square of the rows. So each distinct text
gets a fixed number of keys, 32 bands of five minima of its hashed shingles: two texts at the threshold have no key in common with a
probability of 3e-6, and texts with half of their shingles in common share a key in one of 32 bands.

The texts of a key do not meet each other but one of them, another in each round: first any two, then the one with the most confirmed
links, by which the copies of a text find it. Keys whose texts are in one component by then are done with. The rest are
compared in full across components: small keys by a join, larger ones in blocks of texts, a task's work each, in which the texts of the component that
most texts of the key are in do not meet each other. A block is compared twice, by fingerprints and then, with the texts that have a near one in it, by
their shingles. Rows are texts and links between components and never the pairs of a block, whose number grows with the square of a group of
texts that are alike but below the threshold; a large group costs its rows once for each block of those that are still apart, and no link of a key is left out.

Candidates are pruned by fingerprints of 512 bits: chains of 64-bit segments whose cumulative differences stay within proportional
budgets, then the full Hamming distance. Pairs at the threshold have 78 bits on average, with a deviation of 8; the distance is 116,
so a pair is lost with a probability of 1e-6. Tiny texts, whose bits are less even (96 on average), get 150. Texts that
share no more than half mostly go. The pairs that are left are confirmed on the texts, which are never broadcast.

Shingles and distinct texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_id, fresh, map_batches, saved, spread_join, spread_lookup
from .simhash import _SEED, components, ring_holds
from .textbytes import mixed

_PAIRS = 2000  # that a task compares
BANDS, MINIMA = 32, 5
_FEW = 16  # texts of a key that a join compares in full
_BLOCK, _BULK = 1024, 1 << 20  # texts of a key on either side of a block, and their shingles
_DRAWN = np.random.default_rng(20240601).integers(0, 2**64, (2, BANDS * MINIMA), np.uint64)
_SALTS, _FACTORS = _DRAWN[0], _DRAWN[1] | np.uint64(1)
LANES = 8  # of 64 bits each
DISTANCE, TINY, TINY_DISTANCE = 116, 64, 150  # differing bits that a candidate may have; texts of fewer shingles are tiny


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of all words where they are fewer, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    joined, n, digest = b" ".join(words), max(1, len(words) - size + 1), xxhash.xxh64_intdigest
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20).tolist()
    starts, ends = [0, *(s + 1 for s in spaces)], [*spaces, len(joined)]
    runs = zip(starts[:n], ends[min(size, len(words)) - 1 :])
    return np.unique(np.fromiter((digest(joined[s:e], _SEED) for s, e in runs), np.uint64, n).view(np.int64))


def wide_fingerprint(held: np.ndarray) -> np.ndarray:
    """LANES words whose bits are set where over half of the shingles' hashes, mixed anew for each lane, have them set."""
    ones, hashes = np.zeros(64 * LANES, np.int64), held.view(np.uint64)
    for at in range(0, held.size, 1 << 12):
        part = hashes[at : at + (1 << 12)]
        lanes = np.stack([mixed(part + np.uint64(lane)) for lane in range(1, LANES + 1)], axis=1)
        ones += np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > held.size, bitorder="little").view(np.int64)


def band_keys(held: np.ndarray) -> np.ndarray:
    """One hash for each band of minima of the shingles' hashes, permuted anew for each minimum."""
    least, hashes = np.full(_SALTS.size, 2**64 - 1, np.uint64), held.view(np.uint64)
    for at in range(0, held.size, 1 << 10):
        least = np.minimum(least, ((hashes[at : at + (1 << 10), None] ^ _SALTS) * _FACTORS).min(axis=0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, MINIMA).T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (a.size + b.size - both)


def _outline(texts: DataFrame, words: int) -> DataFrame:
    """node, size (number of shingles), fp (its wide fingerprint) and keys of each text that has words."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sizes, prints, parts = [], [], [], []
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            held = shingles(text.as_py(), words)
            if held.size:
                nodes.append(node)
                sizes.append(held.size)
                prints.append(wide_fingerprint(held))
                parts.append(band_keys(held))
        lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]), pa.int32()), pa.array(np.concatenate(c) if c else np.empty(0, np.int64))) for c in (prints, parts)]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["node", "size", "fp", "keys"])

    return map_batches(texts, each, "node long, size long, fp array<long>, keys array<long>")


def _sides(pairs: DataFrame, side: DataFrame, values: list[str], name: str) -> DataFrame:
    """``pairs`` (a, b) with ``values`` of both from ``side`` (node and values), as a_<value> and b_<value>."""
    out = pairs
    for end, other in (("a", "b"), ("b", "a")):
        used = pairs.groupBy(end).agg(F.count("*").alias("n"))
        own = saved(used.join(side.select(F.col("node").alias(end), *(F.col(v).alias(f"{end}_{v}") for v in values)), end), name)
        out = spread_lookup(out, [end], F.col(other), own.hint("merge"), "n", [f"{end}_{v}" for v in values])
    return out


def _near(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b, n) whose fingerprints are near: some chain on the ring of lanes holds, then all bits count."""
    met = _sides(pairs, prints, ["fp", "size"], "prints")
    differ = F.zip_with("a_fp", "b_fp", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int"))
    budget = F.when(F.least("a_size", "b_size") < TINY, TINY_DISTANCE).otherwise(DISTANCE)
    kept = met.select("a", "b", "n", differ.alias("differ"), budget.alias("budget")).where(ring_holds(F.col("differ"), LANES, F.col("budget")))
    return kept.where(F.aggregate("differ", F.lit(0), lambda x, y: x + y) <= F.col("budget")).select("a", "b", "n")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b; a saved table) whose texts reach the threshold."""
    tasks = 8 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _sides(pairs, texts, ["text"], "sides").select("a", "b", "a_text", "b_text")
    met = met.repartitionByRange(min(tasks, pairs.count() // _PAIRS + 1), "a", "b").sortWithinPartitions("a", "b")  # much work a row; a text's pairs together

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: tuple = (None, None)
        keep = []
        for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
            if a != known[0]:
                known = (a, shingles(x.as_py(), words))
            keep.append(alike(known[1], shingles(y.as_py(), words), percent))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return saved(map_batches(met, each, "a long, b long"), "confirmed")


def _paired(rows: DataFrame) -> DataFrame:
    """Distinct pairs a < b of ``rows`` (node, met), with n, the number of keys that name them."""
    return rows.where("node <> met").groupBy(F.least("node", "met").alias("a"), F.greatest("node", "met").alias("b")).agg(F.count("*").alias("n"))


def labels(texts: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """node and label for each node of ``texts`` (node, text: distinct) that has a link; linked nodes have equal labels.

    Components are those of the pairs with a Jaccard similarity of at least ``percent`` / 100.
    """
    outline = saved(_outline(texts, words), "outline")
    prints, keyed = outline.select("node", "fp", "size"), outline.select("node", F.explode("keys").alias("key"))
    any_ = lambda k: F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("order"), "node"))
    groups = saved(keyed.groupBy("key").agg(F.count("*").alias("n"), any_(0).alias("first"), any_(1).alias("second")).where("n > 1"), "groups")
    filed = saved(spread_join(keyed, "key", groups.select("key", "n", F.col("first.node").alias("x"), F.col("second.node").alias("y")), "n"), "filed")
    left = saved(_near(saved(_paired(filed.select("node", F.explode(F.array("x", "y")).alias("met"))), "pairs"), prints), "near")
    edges, known = [], left.select("a", "b")

    # the best partner of each text first: most other pairs are then within a component
    ends = left.select("a", "b", "n", F.col("a").alias("node")).union(left.select("a", "b", "n", F.col("b").alias("node")))
    best = ends.groupBy("node").agg(F.max(F.struct("n", F.xxhash64("a", "b").alias("order"), "a", "b")).alias("m"))
    tried = saved(best.select("m.a", "m.b").distinct(), "tried")
    edges.append(_confirmed(tried, texts, words, percent))
    out = components(edges[0])
    open_ = saved(_across(left.join(tried, ["a", "b"], "left_anti"), out), "open")
    edges.append(_confirmed(open_.select("a", "b"), texts, words, percent))

    for turn in ("linked", "full"):
        out = _merged(out, edges[-1])
        both = reduce(DataFrame.union, edges)
        degree = both.select(F.col("a").alias("node")).union(both.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
        named = filed.select("key", "node").join(out.join(degree, "node"), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"), F.coalesce("degree", F.lit(0)).alias("degree"))
        named = saved(named, "named")
        of = lambda order: F.max(F.struct(order.alias("order"), F.col("node").alias("met"), F.col("label").alias("met_label")))
        found = named.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), of(F.col("degree")).alias("pick")).where("low < high")
        rows = saved(spread_lookup(named, ["key"], F.col("node"), saved(found, "found"), "n", ["n", "pick"]).where(F.col("n").isNotNull()), "rows")
        if turn == "full":
            few = rows.where(F.col("n") <= _FEW).select("key", "node", "label")
            other = few.select("key", F.col("node").alias("met"), F.col("label").alias("met_label"))
            pairs = few.join(other, "key").where("node < met and label <> met_label").select("node", "met")
            edges.append(_apart(rows.where(F.col("n") > _FEW).select("key", "node", "label"), prints, texts, words, percent))
        else:
            pairs = rows.select("node", "label", "pick.*").where("label <> met_label").select("node", "met")
        fresh_ = saved(_paired(pairs).join(known, ["a", "b"], "left_anti"), "fresh")
        known = known.union(fresh_.select("a", "b"))
        edges.append(_confirmed(saved(_near(fresh_, prints).select("a", "b"), "near"), texts, words, percent))
    return _merged(out, edges[-1].union(edges[-2]))


def _apart(rows: DataFrame, prints: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that join the labels of ``rows`` (key, node, label) as all pairs of a key's texts that reach the threshold do.

    A key's texts are dealt to blocks by hash: those of its most frequent label, which need not meet each other, and apart from
    them the rest, which meet all. Each pair of blocks is compared where it meets.
    """
    sized = rows.join(prints.select("node", "size"), "node")
    counts = saved(sized.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("bulk")), "counts")
    most = counts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("bulk").alias("bulk"), F.max(F.struct("n", "label", "bulk")).alias("most"))
    dealt = lambda n, bulk: F.ceil(F.greatest(n / _BLOCK, bulk / _BULK)).cast("int")
    rest, calm = dealt(F.col("n") - F.col("most.n"), F.col("bulk") - F.col("most.bulk")), dealt(F.col("most.n"), F.col("most.bulk"))
    most = saved(most.select("key", "n", F.col("most.label").alias("most"), rest.alias("rest"), calm.alias("calm")), "most")
    held = spread_lookup(rows, ["key"], F.col("node"), most, "n", ["most", "rest", "calm"]).join(prints, "node")
    calm, rest = F.col("label") == F.col("most"), F.col("rest")
    place = lambda n: F.pmod(F.xxhash64("node", F.lit("block")), n).cast("int")
    held = held.withColumn("at", F.when(calm, rest + place(F.col("calm"))).otherwise(place(rest)))
    others = F.when(calm, F.sequence(F.lit(0), rest - 1)).otherwise(F.sequence(F.lit(0), rest + F.col("calm") - 1))
    met = held.select("key", "at", F.explode(others).alias("with"), "node", "label", "size", "fp")
    met = met.select("key", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), (F.col("at") > F.col("with")).alias("far"), "node", "label", "size", "fp")

    def sides(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of either side (the same where a block meets itself), nodes and labels."""
        far, node, label, i, j = (block.column(c).to_numpy() for c in ("far", "node", "label", "i", "j"))
        a = np.flatnonzero(~far)
        return a, a if i[0] == j[0] else np.flatnonzero(far), node, np.array(label)

    def near(block: pa.Table) -> pa.Table:
        a, b, _, label = sides(block)
        size, keep = block.column("size").to_numpy(), np.zeros(label.size, bool)
        fp = np.asarray(block.column("fp").combine_chunks().flatten()).view(np.uint64).reshape(-1, LANES)
        for x in a:
            y = b[(label[b] != label[x]) & (100 * np.minimum(size[b], size[x]) >= percent * np.maximum(size[b], size[x]))]
            differ = np.bitwise_count(fp[y] ^ fp[x]).sum(axis=1, dtype=np.int64)
            y = y[differ <= np.where(np.minimum(size[y], size[x]) < TINY, TINY_DISTANCE, DISTANCE)]
            keep[y] = True
            keep[x] |= y.size > 0
        return block.select(["key", "i", "j", "far", "node", "label"]).filter(pa.array(keep))

    def linked(block: pa.Table) -> pa.Table:
        a, b, node, label = sides(block)
        held = block.column("held").combine_chunks()
        vocabulary, flat = np.unique(held.flatten().to_numpy(), return_inverse=True)
        size = held.value_lengths().to_numpy()
        parts, own = np.split(flat, np.cumsum(size)[:-1]), np.zeros(vocabulary.size, np.int64)
        firsts, seconds = [], []
        for x in a:
            y = b[(label[b] != label[x]) & (100 * np.minimum(size[b], size[x]) >= percent * np.maximum(size[b], size[x]))]
            if not y.size:
                continue
            own[parts[x]] = 1
            both = np.add.reduceat(own[np.concatenate([parts[k] for k in y])], np.cumsum(size[y]) - size[y])
            own[parts[x]] = 0
            y = y[100 * both >= percent * (size[x] + size[y] - both)]
            joined, at = np.unique(label[y], return_index=True)
            firsts.extend([node[x]] * at.size)
            seconds.extend(node[y[at]])
            label[np.isin(label, joined)] = label[x]  # one link joins two labels
        return pa.table({"a": pa.array(np.minimum(firsts, seconds), pa.int64()), "b": pa.array(np.maximum(firsts, seconds), pa.int64())})

    where = "key long, i int, j int, far boolean, node long, label long"
    met = saved(met.groupBy("key", "i", "j").applyInArrow(near, where), "near")
    known = map_batches(met.select("node").distinct().join(texts, "node"), lambda batch: _held(batch, words), "node long, held array<long>")
    met = met.join(saved(known, "held").hint("merge"), "node")
    return saved(met.groupBy("key", "i", "j").applyInArrow(linked, "a long, b long").distinct(), "confirmed")


def _held(texts: pa.RecordBatch, words: int) -> pa.RecordBatch:
    held = [shingles(text.as_py(), words) for text in texts.column(1)]
    return pa.RecordBatch.from_arrays([texts.column(0), pa.array(held, pa.list_(pa.int64()))], names=["node", "held"])


def _merged(label: DataFrame, edges: DataFrame) -> DataFrame:
    """node and label after ``edges`` (a, b) have joined components of ``label``; only edges between components take part in its rounds."""
    nodes = label.union(edges.select(F.col("a").alias("node"), F.col("a").alias("label"))).union(edges.select(F.col("b"), F.col("b"))).groupBy("node").agg(F.min("label").alias("label"))
    nodes = saved(nodes, "nodes")
    named = edges
    for end in ("a", "b"):
        named = named.join(nodes.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end)
    joined = components(named.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).where("a <> b").distinct())
    sizes = nodes.groupBy("label").agg(F.count("*").alias("n")).join(joined.select(F.col("node").alias("label"), F.col("label").alias("to")), "label")
    return saved(spread_lookup(nodes, ["label"], F.col("node"), sizes, "n", ["to"]).select("node", F.coalesce("to", "label").alias("label")), "merged")


def _across(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that lie in different components."""
    out = pairs
    for end in ("a", "b"):
        out = out.join(label.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end, "left")
    return out.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).drop("label_a", "label_b")


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component of near-duplicates: that of the smallest doc_id; null ids sort last.

    Texts without words (null ones too) are one component. Of rows that repeat id and text one stays. An empty table stays empty;
    other columns, whatever their names, come along.
    """
    node, key = fresh(docs, "__node"), fresh(docs, "__key")
    has_words = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    named = docs.withColumn(node, F.when(has_words, F.xxhash64(F.col("text").cast("string"))).otherwise(F.lit(0))).withColumn(key, as_id())
    firsts = saved(named.groupBy(node).agg(F.min(key).alias(key)), "firsts")
    kept = saved(named.join(firsts, [node, key], "left_semi").dropDuplicates([node, key]), "texts")
    label = labels(kept.select(F.col(node).alias("node"), F.col("text").cast("string").alias("text")), words, percent)
    whole = firsts.join(label.withColumnRenamed("node", node), node)
    best = whole.groupBy("label").agg(F.min(F.struct(key, node)).alias("best"))
    lost = saved(whole.join(best, "label").where(F.col(node) != F.col(f"best.{node}")).select(node), "lost")
    return kept.join(lost, node, "left_anti").select(*docs.columns)
