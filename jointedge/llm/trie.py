"""The prefix trie of conversations: statistics of every distinct sequence of first turns.

Turns are 120-bit digests of role and text, and a prefix is named by its depth and two polynomial hashes of its turns, so equal prefixes meet by an
equi-join. A prefix of one conversation only is a row of the output as it stands; the prefixes that more share are compared in full: conversations,
cut to their shared turns, are dealt in lexicographic ranges, and each range is a padded matrix of turn ids (in panels of columns, so that a
deep conversation does not pad all others). ``numpy.lexsort`` orders it, masks of changed columns, OR-accumulated from the first
column, mark where nodes start, and from the deepest column to the first ``reduceat`` sums members, children, leaves and savings of every
node. Only the prefixes of a range's first and last row can go on in another range; these boundary nodes are summed over the ranges at the end.

No conversation meets in one task but for its shared turns: rows get their places, and their prefixes' hashes, from sorted ranges of rows and
what earlier ranges hold of the same conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, spread_lookup
from .textbytes import _BASES, mixed

_U = np.uint64
PANEL = 32  # columns of the matrix at a time
EMPTY = hashlib.sha256(b"").hexdigest()
FAMILY, LENT = 20, 3  # conversations whose first turns come from the first of them, and how many at most


def power(base: np.uint64, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo 2**64."""
    out, square, left = np.ones(exponents.size, _U), base, exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square, out)
        with np.errstate(over="ignore"):
            square = _U(int(square) * int(square) & (2**64 - 1))
        left = left >> 1
    return out


_INVERSES = tuple(_U(pow(int(b), -1, 1 << 64)) for b in _BASES)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _within(conv: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at each conversation."""
    starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
    total = np.cumsum(values, dtype=values.dtype)
    before = np.where(starts > 0, total[starts - 1], 0).astype(values.dtype)
    return total - np.repeat(before, np.diff(np.append(starts, conv.size)))


_PLACED = "conv_id long, part int, place long, x1 long, x2 long, words long, q1 long, q2 long"


def _placed(rows: DataFrame) -> DataFrame:
    """Sorted rows with their place in the conversation and the hashes of the turns so far, both counted from the start of the task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, open_conv, n, sums = TaskContext.get().partitionId(), None, 0, [_U(0), _U(0)]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = _column(batch, "conv_id")
            going_on = conv == open_conv if open_conv is not None else np.zeros(conv.size, bool)
            going_on &= np.logical_and.accumulate(going_on)
            place = _within(conv, np.ones(conv.size, np.int64)) + np.where(going_on, n, 0)
            turns, hashes = [mixed(_column(batch, x).astype(_U)) for x in ("x1", "x2")], []
            for k, base in enumerate(_BASES):
                hashes.append(_within(conv, turns[k] * power(base, place)) + np.where(going_on, sums[k], _U(0)))
            open_conv, n, sums = conv[-1], int(place[-1]), [h[-1] for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(np.full(conv.size, part, np.int32)), pa.array(place), *map(_signed, turns), batch.column("words"), *map(_signed, hashes)],
                names=[c.split()[0] for c in _PLACED.split(", ")],
            )

    return rows.mapInArrow(each, _PLACED)


def _carried(placed: DataFrame) -> DataFrame:
    """Places and hashes from the start of each conversation. What a task needs of the earlier ones is one row for each task."""
    ends = placed.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "place", "q1", "q2")).alias("last")).orderBy("part").collect()
    unsigned, carry, held = lambda x: x & (2**64 - 1), {}, (None, 0, [0, 0])
    for r in ends:
        n, sums = r.last.place, [unsigned(r.last.q1), unsigned(r.last.q2)]
        if held[0] == r.first:
            carry[r.part] = held
            if r.last.conv_id == r.first:
                sums = [unsigned(h + pow(int(b), held[1], 1 << 64) * s) for h, b, s in zip(held[2], _BASES, sums)]
                n += held[1]
        held = (r.last.conv_id, n, sums)
    if not carry:
        return placed.drop("part")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv, place = (_column(batch, c) for c in ("part", "conv_id", "place"))
            place, hashes = place.copy(), [_column(batch, q).view(_U).copy() for q in ("q1", "q2")]
            for p in set(part.tolist()) & carry.keys():
                of, n, sums = carry[p]
                rows = (part == p) & (conv == of)
                place[rows] += n
                for k, base in enumerate(_BASES):
                    hashes[k][rows] = _U(sums[k]) + _U(pow(int(base), n, 1 << 64)) * hashes[k][rows]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(place), *(batch.column(c) for c in ("x1", "x2", "words")), *map(_signed, hashes)], names=["conv_id", "place", "x1", "x2", "words", "q1", "q2"])

    return placed.mapInArrow(each, "conv_id long, place long, x1 long, x2 long, words long, q1 long, q2 long")


def turns_in_place(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), x1 and x2 (digest of role and text), words, q1 and q2 (hashes of the turns up to this) for each row.

    Rows go by turn, nulls first, those of equal turn by role, then text, in both by their first 16 and 64 characters and then a digest. Null roles and
    texts are empty. Rows of a null conv_id are left out.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("id"))
    mark = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    half = lambda at: F.conv(F.substring("mark", at, 15), 16, 10).cast("long")
    slim = rows.select("conv_id", "turn", F.substring("role", 1, 16).alias("role"), F.substring("text", 1, 64).alias("text"), mark.alias("mark"), "id", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = ["conv_id", "turn", "role", "text", "mark", "id"]
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(_carried(saved(_placed(ranged.select("conv_id", half(1).alias("x1"), half(16).alias("x2"), "words")), "placed")), "turns")


def _at(head: Column, place: Column, field: str) -> Column:
    """A field of a conversation's first turns at a place; 0 at place 0."""
    return F.when(place > 0, F.element_at(F.transform(head, lambda t: t[field]), F.greatest(place, F.lit(1)))).otherwise(F.lit(0).cast("long"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans (conv_id, length) and turns (conv_id, depth, length, x1, x2, words, h1, h2: hashes of the prefix) of the rebuilt conversations."""
    early = F.when(F.col("place") <= LENT, F.struct("place", "x1", "x2", "words", "q1", "q2"))
    heads = saved(turns.groupBy("conv_id").agg(F.max("place").alias("n"), F.array_sort(F.collect_list(early)).alias("head")), "heads")
    lenders = heads.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("lender"), F.col("n").alias("lender_n"), F.col("head").alias("lent"))
    borrowed = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    plan = heads.withColumn("lender", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", borrowed).join(lenders, "lender", "left")
    plan = plan.withColumn("m", F.least("h", F.coalesce("lender_n", F.lit(0))).cast("int")).withColumn("own", F.least("h", "n").cast("int"))
    values = {"from1": _at(F.col("lent"), F.col("m"), "q1"), "from2": _at(F.col("lent"), F.col("m"), "q2"), "less1": _at(F.col("head"), F.col("own"), "q1"), "less2": _at(F.col("head"), F.col("own"), "q2")}
    plan = saved(plan.withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).withColumns(values).drop("head", "lender", "lender_n"), "plan")
    first = F.filter("lent", lambda t: t["place"] <= F.col("m"))
    lent = plan.where("m > 0").select("conv_id", "length", F.inline(first)).select("conv_id", F.col("place").alias("depth"), "length", "x1", "x2", "words", "q1", "q2", *(F.lit(0).cast("long").alias(c) for c in values), F.lit(0).alias("back"))
    met = spread_lookup(turns, ["conv_id"], F.col("place"), plan, "n", ["h", "m", "length", *values])
    own = met.where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("m")).alias("depth"), "length", "x1", "x2", "words", "q1", "q2", *values, (F.col("h") - F.col("m")).alias("back"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back, hashes = _column(batch, "back"), []
            for k, inverse in enumerate(_INVERSES, 1):
                q, start, less = (_column(batch, f"{c}{k}").view(_U) for c in ("q", "from", "less"))
                hashes.append(start + (q - less) * power(inverse, back))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "depth", "length", "x1", "x2", "words")), *map(_signed, hashes)], names=["conv_id", "depth", "length", "x1", "x2", "words", "h1", "h2"])

    rows = lent.union(own).mapInArrow(each, "conv_id long, depth long, length long, x1 long, x2 long, words long, h1 long, h2 long")
    return plan.select("conv_id", "length"), saved(rows, "rebuilt")


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PART = "h1 long, h2 long, p1 long, p2 long, words long, shard int, ends string"
_SHARD = f"{_NODE}, {_PART}"


class Shard:
    """A range of conversations in the order of their shared turns: sizes, ``more`` (whether turns of their own follow) and flat turn columns."""

    def __init__(self, conv: np.ndarray, sizes: np.ndarray, more: np.ndarray, x1: np.ndarray, x2: np.ndarray, words: np.ndarray, firsts: np.ndarray):
        at = np.cumsum(sizes) - sizes
        ids = self._ranked(x1, x2)
        order = np.lexsort((conv, self._order(ids, at, sizes)))
        self.conv, self.sizes, self.more, self.at = conv[order], sizes[order], more[order], at[order]
        self.ids, self.words, self.firsts, self.turns = ids, words, firsts, (x1.view(_U), x2.view(_U))

    @staticmethod
    def _ranked(*keys: np.ndarray) -> np.ndarray:
        """Dense ranks, by the first key first."""
        order = np.lexsort(keys[::-1])
        if not order.size:
            return np.empty(0, np.int64)
        changed = np.zeros(order.size, bool)
        for key in keys:
            changed[1:] |= key[order][1:] != key[order][:-1]
        out = np.empty(order.size, np.int64)
        out[order] = np.cumsum(changed)
        return out

    @staticmethod
    def _panel(ids: np.ndarray, at: np.ndarray, sizes: np.ndarray, first: int) -> np.ndarray:
        """A padded matrix of the turn ids from depth ``first`` on, for rows that reach it."""
        width = min(PANEL, int(sizes.max()) - first)
        columns = first + np.arange(width)
        held = columns < sizes[:, None]
        return np.where(held, ids[np.where(held, at[:, None] + columns, 0)], -1)

    def _order(self, ids: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ranks of the rows by their turns, a shorter row before those that go on from it."""
        ranks = np.zeros(sizes.size, np.int64)
        for first in range(0, int(sizes.max(initial=0)), PANEL):
            rows = np.flatnonzero(sizes > first)
            panel = self._panel(ids, at[rows], sizes[rows], first)
            finer = np.zeros(sizes.size, np.int64)
            finer[rows] = 1 + self._ranked(ranks[rows], *panel.T)
            ranks = self._ranked(ranks, finer)
        return ranks

    def starts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each depth from 1: the rows that reach it, and which of them start a node."""
        out, changed = [], np.arange(self.sizes.size) == 0
        for first in range(0, int(self.sizes.max(initial=0)), PANEL):
            rows = np.flatnonzero(self.sizes > first)
            panel = self._panel(self.ids, self.at[rows], self.sizes[rows], first)
            seen = np.cumsum(changed)
            differs = np.ones(panel.shape, bool)
            differs[1:] = panel[1:] != panel[:-1]
            differs[1:, 0] |= (seen[rows][1:] - seen[rows][:-1]) > 0  # a change in an earlier panel, in rows between too
            mask = np.logical_or.accumulate(differs, axis=1)
            for k in range(panel.shape[1]):
                reach = self.sizes[rows] > first + k
                out.append((rows[reach], mask[reach, k]))
            changed[rows] |= mask[:, -1]
        return out

    def _prefix(self, row: int) -> list[tuple[int, int]]:
        """The two hashes of each prefix of a row, the empty one first."""
        size, at = int(self.sizes[row]), int(self.at[row])
        depth = np.arange(1, size + 1)
        sums = [np.append(_U(0), np.cumsum(x[at : at + size] * power(b, depth), dtype=_U)).view(np.int64).tolist() for x, b in zip(self.turns, _BASES)]
        return list(zip(*sums))

    def nodes(self, shard: int, root_first: int) -> Iterator[tuple]:
        """A row of ``_SHARD`` for each node. Those of boundary nodes have a shard, and only sums over what lies within this one, themselves and other boundary nodes not counted."""
        n = self.conv.size
        leaves, savings, child = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        edges = [self._prefix(0), self._prefix(n - 1)]
        levels = [(np.arange(n), np.arange(n) == 0), *self.starts()]
        for depth in range(len(levels) - 1, -1, -1):
            rows, starts = levels.pop()
            at = np.flatnonzero(starts)
            whole, here = np.diff(np.append(at, rows.size)), self.sizes[rows] == depth
            leaves[rows[here & self.more[rows]]] += 1
            children = np.add.reduceat(child[rows] + (here & self.more[rows]).astype(np.int64), at)
            head = rows[at]
            place = self.at[head] + depth - 1
            words = self.words[place] if depth else np.zeros(1, np.int64)
            firsts = self.firsts[place] if depth else np.array([root_first])
            parents = self.firsts[place - 1] if depth > 1 else np.full(at.size, root_first)
            ending = here & ~self.more[rows]
            held = np.add.reduceat(ending.astype(np.int64), at)
            boundary = np.zeros(at.size, bool)
            edge = {}
            for k, row in ((0, 0), (at.size - 1, n - 1)):
                prefix = edges[row > 0]
                if len(prefix) > depth:
                    boundary[k], edge[k] = True, prefix
            own = np.where(boundary, 0, (whole - 1) * words)
            savings[head] += own
            leaves[head] += ~boundary & (children == 0)
            total, below = np.add.reduceat(savings[rows], at), np.add.reduceat(leaves[rows], at)
            ids = self.conv[rows]
            for k in range(at.size):
                text = ""
                if held[k]:
                    part = slice(at[k], at[k] + whole[k])
                    text = ",".join(map(str, ids[part][ending[part]].tolist()))
                node = (int(firsts[k]), depth, None if depth == 0 else int(parents[k]), int(whole[k]), int(children[k]), int(below[k]), int(total[k]))
                if k in edge:
                    yield (*node, None, *edge[k][depth], *(edge[k][depth - 1] if depth else (0, 0)), int(words[k]), shard, text)
                else:
                    yield (*node, hashlib.sha256(text.encode()).hexdigest() if text else EMPTY, *[None] * 7)
            child[:] = False
            child[head[~boundary]] = True


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _batches(rows: Iterator[tuple], schema: str, size: int = 4096) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    held = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), _KINDS[k]) for c, k in zip(zip(*held), kinds)], names=list(names))

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def _sharded(members: DataFrame, root_first: int) -> DataFrame:
    """The nodes of each range of ``members`` (conv_id, more, seq: array of x1, x2, words and first)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = [b for b in batches if b.num_rows]
        if not found:
            return
        held = pa.Table.from_batches(found).combine_chunks()
        lists = held.column("seq").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat = lists.flatten()
        fields = [flat.field(k).to_numpy(zero_copy_only=False) for k in ("x1", "x2", "words", "first")]
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        shard = Shard(held.column("conv_id").to_numpy(), sizes, held.column("more").to_numpy(zero_copy_only=False).astype(bool), *fields)
        yield from _batches(shard.nodes(TaskContext.get().partitionId(), root_first), _SHARD)

    key = F.transform("seq", lambda t: F.struct(t["x1"], t["x2"]))
    return members.repartitionByRange(key, "conv_id").mapInArrow(each, _SHARD)


def _joined(parts: DataFrame) -> DataFrame:
    """The boundary nodes whole, from their parts in all ranges: at most two for each range and shared depth."""
    key = ["depth", "h1", "h2"]
    sums = parts.groupBy(*key).agg(*(F.min(c).alias(c) for c in ("conv_id", "parent_conv_id", "p1", "p2", "words")), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            now, digest, any_ = None, None, False
            for batch in batches:
                for i in range(batch.num_rows):  # one part's ids at a time
                    *key_, text = (c[i].as_py() for c in batch.columns)
                    if key_ != now:
                        if now:
                            yield (*now, digest.hexdigest())
                        now, digest, any_ = key_, hashlib.sha256(), False
                    if text:
                        digest.update((("," if any_ else "") + text).encode())
                        any_ = True
            if now:
                yield (*now, digest.hexdigest())

        return _batches(digests(), "depth long, h1 long, h2 long, ends_sha256 string")

    told = parts.repartition(*key).sortWithinPartitions(*key, "shard").select(*key, "ends").mapInArrow(ends, "depth long, h1 long, h2 long, ends_sha256 string")
    names = [*key, "conv_id", "parent_conv_id", "p1", "p2", "words", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = {(r["depth"], r["h1"], r["h2"]): r for b in batches for r in b.to_pylist()}
        below = dict.fromkeys(nodes, 0)
        for k, r in nodes.items():
            parent = (k[0] - 1, r["p1"], r["p2"])
            if k[0] and parent in nodes:
                below[parent] += 1
        for r in nodes.values():
            r |= {"leaves": 0, "savings": (r["n_convs"] - 1) * r["words"]}
        for k in sorted(nodes, reverse=True):
            r = nodes[k]
            r["n_children"] += below[k]
            r["leaves"] += r["n_children"] == 0
            parent = nodes.get((k[0] - 1, r["p1"], r["p2"]))
            if k[0] and parent:
                parent["leaves"] += r["leaves"]
                parent["savings"] += r["savings"]
        columns = [c.split()[0] for c in _NODE.split(", ")]
        yield from _batches((tuple((r | {"n_leaves": r["n_leaves"] + r["leaves"], "saved_tokens": r["saved_tokens"] + r["savings"]})[c] for c in columns) for r in nodes.values()), _NODE)

    return sums.join(told, key).select(names).repartition(1).mapInArrow(up, _NODE)


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations (conv_id, turn, role, text): see ``_NODE`` for its columns.

    A conversation c is the first h turns of c - c % 20 (h: crc32 of c in decimals, modulo 4), then its own after its first h. A node is a distinct sequence of
    first turns. conv_id is its smallest member and parent_conv_id its parent's (null for the root); n_leaves and saved_tokens are summed over its
    subtree; ends_sha256 names the members that end in it, in the order of their ids. Repeated rows are turns of their own; for the order of rows and for nulls see
    ``turns_in_place``. No conversations, no nodes. Other columns are not read.
    """
    spark = conversations.sparkSession
    turns = turns_in_place(conversations)
    plans, rows = rebuilt(turns)
    root = plans.agg(F.min("conv_id")).first()[0]
    if root is None:
        return spark.createDataFrame([], _NODE)
    key = ["depth", "h1", "h2"]
    shared = saved(rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("conv_id").alias("first")).where("n > 1"), "shared")
    met = saved(spread_lookup(rows, key, F.col("conv_id"), shared, "n", ["first"]), "met")
    single = met.where(F.col("first").isNull()).drop("first")
    # a prefix less its last turn: the hashes are signed, so the difference is taken in a task
    parents = _parents(single)
    above = spread_lookup(parents, key, F.col("conv_id"), shared, "n", ["first"])
    parent = F.coalesce("first", F.when(F.col("depth") == 0, F.lit(root)).otherwise(F.col("conv_id")))
    last = F.col("depth") + 1 == F.col("length")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    tails = above.select(
        "conv_id", (F.col("depth") + 1).alias("depth"), parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    turn = F.struct("depth", "x1", "x2", "words", "first")
    held = met.where(F.col("first").isNotNull()).select("conv_id", turn.alias("turn"), F.lit(None).cast("long").alias("length"))
    held = held.union(plans.select("conv_id", F.lit(None).cast(held.schema["turn"].dataType), "length"))
    members = held.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("seq"), F.max("length").alias("length"))
    members = members.select("conv_id", (F.col("length") > F.size("seq")).alias("more"), "seq")
    nodes = saved(_sharded(members, root), "nodes")
    names = [c.split()[0] for c in _NODE.split(", ")]
    inner = nodes.where(F.col("shard").isNull()).select(names)
    return tails.select(names).union(inner).union(_joined(nodes.where(F.col("shard").isNotNull())).select(names))


def _parents(rows: DataFrame) -> DataFrame:
    """conv_id, length, and depth and hashes of the prefix one turn shorter."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        depth = _column(batch, "depth")
        hashes = [_column(batch, f"h{k}").view(_U) - _column(batch, f"x{k}").view(_U) * power(b, depth) for k, b in enumerate(_BASES, 1)]
        return pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("length"), pa.array(depth - 1), *map(_signed, hashes)], names=["conv_id", "length", "depth", "h1", "h2"])

    slim = rows.select("conv_id", "length", "depth", "x1", "x2", "h1", "h2")
    return slim.mapInArrow(lambda batches: map(each, batches), "conv_id long, length long, depth long, h1 long, h2 long")
