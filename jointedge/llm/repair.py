"""Repair of conversation structure: the cheapest edits that make the role initials ``(s?(ua)+)?``, ASCII-least among ties.

A backward vector holds the cost from a row to the end for each state of that pattern. Vectors are stored only at checkpoints: those of
the rows between two checkpoints are made anew while walking forward, where each row takes the least edit that is tight. This is done at two
levels. Rows lie in order over the tasks, cut into pieces of about the square root of all rows (at most ``PIECE_CHARS`` characters or
one row); pieces of a conversation that is not whole in one piece are joined by their 4 x 4 cost matrices, which give the vectors at
their ends, and by the state in which each leaves the next. Within a piece, checkpoints stand at every square root of its rows.
So a conversation with a large share of all rows is repaired by many tasks, and its long rows meet nowhere.

Only the digest of a conversation that is split must see its rows in turn: one task streams them piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_id, from_id, saved, spread_lookup

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
NONE, SYSTEM, USER, ASSISTANT = range(4)  # initials, and what was kept last
BLANK, DUPLICATE, CUT = 1, 2, 3
FAR = 1 << 40
PIECE_ROWS, PIECE_CHARS = 256, 1 << 22

_AFTER = [{SYSTEM: SYSTEM, USER: USER}, {USER: USER}, {ASSISTANT: ASSISTANT}, {USER: USER}]  # state after each initial that may follow
_FILLS = [USER, USER, ASSISTANT, USER]  # what an insertion or a new role must be
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_OPEN = (NONE, ASSISTANT)  # states in which a conversation may end
END = (0, 2 * INSERT, INSERT, 0)  # the vector behind the last row
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def code(initial: int, fault: int) -> int:
    return initial | fault << 2


@cache
def _moves(of: int, state: int) -> list[tuple[str, int, int]]:
    """Edit, cost and next state for a row in a state, least initial first."""
    initial, fault = of & 3, of >> 2
    out = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        if initial in _AFTER[state]:
            out.append(("K", KEEP + more, _AFTER[state][initial]))
        out.append(("R", REROLE + more, _FILLS[state]))
    return out


def _filled(costs: list[int]) -> tuple[int, ...]:
    """Costs when insertions may come first; two in a row lead from the states before a user's turn to the one after an answer."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[_FILLS[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


@cache
def _back(of: int, after: tuple[int, ...]) -> tuple[int, ...]:
    return _filled([min(c + after[t] for _, c, t in _moves(of, s)) for s in range(4)])


def back(of: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The vector before a row, from that behind it. Vectors that differ by a constant share the work."""
    low = min(after)
    return tuple(low + c for c in _back(of, tuple(c - low for c in after)))


@cache
def _edit(of: int, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    """The least tight edits up to and with a row's own, and the state behind them."""
    here, moves = _back(of, after), _moves(of, state)
    for edit, cost, to in moves:
        if edit == "D" and cost + after[to] == here[state]:
            return edit, to
    if INSERT + here[_FILLS[state]] == here[state]:
        rest, to = _edit(of, _FILLS[state], after)
        return "I" + rest, to
    return next((edit, to) for edit, cost, to in moves if cost + after[to] == here[state])


def walk(codes: bytes, state: int, after: tuple[int, ...]) -> tuple[list[str], int]:
    """The edits of each row of a piece (insertions before it included) and the state behind it, given the vector there."""
    step = max(1, int(len(codes) ** 0.5))
    marks = list(range(0, len(codes), step))
    held = {}
    for at in reversed(marks):
        held[at] = after
        for of in reversed(codes[at : at + step]):
            after = back(of, after)
    edits = []
    for at in marks:
        part, vectors = codes[at : at + step], [held.pop(at)]
        for of in reversed(part[1:]):
            vectors.append(back(of, vectors[-1]))
        for of in part:
            behind = vectors.pop()
            low = min(behind)
            edit, state = _edit(of, state, tuple(c - low for c in behind))
            edits.append(edit)
    return edits, state


def closing(state: int) -> str:
    """The insertions behind the last row."""
    out = ""
    while state not in _OPEN:
        out, state = out + "I", _FILLS[state]
    return out


@cache
def _matrix(of: int) -> np.ndarray:
    unit = [tuple(0 if s == t else FAR for s in range(4)) for t in range(4)]
    return np.array([_filled([min(c + unit[t][to] for _, c, to in _moves(of, s)) for s in range(4)]) for t in range(4)], np.int64).T


def matrix(codes: bytes) -> np.ndarray:
    """[s, t]: the least cost from state s before the rows to state t behind them, by pairwise products."""
    held = np.stack([_matrix(of) for of in codes])
    while len(held) > 1:
        odd = held[len(held) // 2 * 2 :]
        left, right = held[0 : len(held) // 2 * 2 : 2], held[1::2]
        held = np.concatenate([np.minimum((left[:, :, :, None] + right[:, None, :, :]).min(axis=2), FAR), odd])
    return held[0]


def emitted(edits: list[str], state: int, roles: list[str], texts: list[str], last: bool) -> list[tuple[str, str]]:
    """The turns that the edits leave."""
    out = []
    for i, edit in enumerate(edits):
        for e in edit:
            if e == "D":
                continue
            if e == "K":
                state = _AFTER[state][{"s": SYSTEM, "u": USER, "a": ASSISTANT}[roles[i][0]]]
                out.append((roles[i], texts[i]))
            else:
                state = _FILLS[state]
                out.append((_ROLE[state], texts[i] if e == "R" else ""))
    for _ in closing(state) if last else "":
        state = _FILLS[state]
        out.append((_ROLE[state], ""))
    return out


def initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(NONE)


_SHAPE = "conv_id long, part int, piece int, split boolean, codes binary, roles array<string>, texts array<string>, low long, high long, turns long, turn_first long, turn_last long"


def _pieces(rows: DataFrame, size: int) -> DataFrame:
    """Rows (conv_id, turn, role, text, code; null code: no row, but its conversation is named) in order as pieces."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, count = TaskContext.get().partitionId(), [], 0
        conv, started, number, of_conv, held, chars, at_start = None, False, 0, 0, [], 0, True

        def cut(split: bool) -> None:
            nonlocal number, of_conv, held, chars
            real = [r for r in held if r[3] is not None]
            turns = [r[0] for r in real if r[0] is not None]
            done.append((conv, part, number, split, bytes(r[3] for r in real), [r[1] for r in real], [r[2] for r in real], min(turns, default=None), max(turns, default=None), len(set(turns)), turns[0] if turns else None, turns[-1] if turns else None))
            number, of_conv, held, chars = number + 1, of_conv + 1, [], 0

        def batch_of(rows_: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows_), kinds)], names=[c.split()[0] for c in _SHAPE.split(", ")])

        for batch in batches:
            for c, turn, role, text, of in zip(*(col.to_pylist() for col in batch.columns)):
                if not started or c != conv:
                    if started:
                        cut(at_start or of_conv > 0)  # whole only if it began and ended within this task, as one piece
                        at_start = False
                    conv, started, of_conv = c, True, 0
                elif len(held) >= size or chars >= PIECE_CHARS:
                    cut(True)
                held.append((turn, role, text, of))
                chars += len(text)
                count += len(text)
                if count >= PIECE_CHARS and done:
                    yield batch_of(done)
                    done, count = [], 0
        if started:
            cut(True)
            yield batch_of(done)

    return rows.mapInArrow(each, _SHAPE)


def _in_turn(df: DataFrame, order: list[Column], f, schema: str) -> DataFrame:
    """Rows of a conversation stream through one task in the given order; ``f`` maps an iterator of dicts to one."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in f(r for b in batches for i in range(0, b.num_rows, 256) for r in b.slice(i, 256).to_pylist()):
            out.append(row)
            if len(out) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, types)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, types)], names=names)

    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(each, schema)


def _joined(split: DataFrame) -> DataFrame:
    """part, piece, start (state), ends (vector) and last (1 or 0) of each piece of the split conversations."""

    def matrices(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = [(matrix(c) if c else np.where(np.eye(4, dtype=bool), 0, FAR)).ravel().tolist() for c in batch.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(flat, pa.list_(pa.int64()))], names=["conv_id", "part", "piece", "matrix"])

    slim = split.select("conv_id", "part", "piece", "codes")
    made = slim.mapInArrow(lambda bs: map(matrices, bs), "conv_id long, part int, piece int, matrix array<long>")

    def vectors(rows: Iterator[dict]) -> Iterator[dict]:
        conv, v = (), END
        for r in rows:
            last = conv != r["conv_id"]
            if last:
                conv, v = r["conv_id"], END
            yield r | {"ends": list(v), "last": int(last)}
            v = tuple((np.array(r["matrix"]).reshape(4, 4) + np.array(v)).min(axis=1).tolist())

    ends = saved(_in_turn(made, [F.desc("part"), F.desc("piece")], vectors, "conv_id long, part int, piece int, ends array<long>, last int"), "ends")

    def leaves(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[walk(c, s, tuple(v))[1] for s in range(4)] for c, v in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=["conv_id", "part", "piece", "to"])

    met = slim.join(ends.select("part", "piece", "ends"), ["part", "piece"]).select("conv_id", "part", "piece", "codes", "ends")
    to = met.mapInArrow(lambda bs: map(leaves, bs), "conv_id long, part int, piece int, to array<long>")

    def starts(rows: Iterator[dict]) -> Iterator[dict]:
        conv, state = (), NONE
        for r in rows:
            if conv != r["conv_id"]:
                conv, state = r["conv_id"], NONE
            yield r | {"start": state}
            state = r["to"][state]

    begun = _in_turn(to, [F.asc("part"), F.asc("piece")], starts, "conv_id long, part int, piece int, start int")
    return saved(begun.drop("conv_id").join(ends.drop("conv_id"), ["part", "piece"]), "joined")


_REPAIRED = "conv_id long, part int, piece int, split boolean, audit string, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, cost long"


def _repair_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = []
    for r in batch.to_pylist():
        codes, start = r["codes"], r["start"] or NONE
        edits, state = walk(codes, start, tuple(r["ends"] or END))
        turns = emitted(edits, start, r["roles"], r["texts"], bool(r["last"]))
        audit = "".join(edits) + (closing(state) if r["last"] else "")
        faults, initials = [c >> 2 for c in codes], [c & 3 for c in codes]
        cut = sum(TRUNCATED for c, e in zip(codes, edits) if c >> 2 == CUT and not e.endswith("D"))
        cost = sum(audit.count(e) * c for e, c in (("R", REROLE), ("D", DELETE), ("I", INSERT))) + cut
        illegal = sum(p not in LEGAL for p in zip(initials, initials[1:]))
        rows.append((r["conv_id"], r["part"], r["piece"], r["split"], audit, [t[0] for t in turns], [t[1] for t in turns], faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, cost))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.int64()] * 5]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _REPAIRED.split(", ")])


def repaired(rows: DataFrame, size: int | None = None) -> DataFrame:
    """The repaired turns of conversations given as rows (conv_id, turn, role, text), in pieces of bounded size.

    A row is blank if its text has no character but white space, else a duplicate if its role and text came before in the conversation, else
    truncated if its last such character is none of ``.!?``. Keeping costs 0, a new role 1, deleting 2 (blank rows and duplicates must go), inserting an
    empty turn 5, and leaving a truncated row in place 5.

    Columns: conv_id, part and piece (their order is that of the turns), split (whether a conversation may have more pieces), audit (initials of the
    edits), roles and texts (the repaired turns), blank, duplicate, truncated, illegal, cost (of this piece), first and last (initials at its
    ends, null without rows), low, high, turns, turn_first and turn_last (of the turn numbers; null without any).

    Rows go by turn, nulls first; those of equal turn by role, then text, in both by their first 16 and 64 characters and then a digest. Null roles and
    texts are empty. A null conv_id is a conversation. A row that is null in column ``kept``, if there is one, only names its conversation. No rows,
    no pieces. Other columns are not read. ``size`` is the number of rows of a piece.
    """
    kept = F.col("kept") if "kept" in rows.columns else F.lit(True)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    named = rows.select(as_id("conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kept.alias("kept"), F.monotonically_increasing_id().alias("id"))
    named = named.withColumn("mark", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    repeated = named.where("kept").groupBy("conv_id", "mark").agg(F.min(F.struct("turn", "id")).alias("begun"), F.count("*").alias("n")).where("n > 1")
    met = spread_lookup(named, ["conv_id", "mark"], F.col("id"), saved(repeated, "repeated"), "n", ["begun"])
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    open_end = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, BLANK).when(F.struct("turn", "id") > F.col("begun"), DUPLICATE).when(open_end, CUT).otherwise(0)
    coded = met.withColumn("code", F.when(F.col("kept"), initial(F.col("role")) + fault * 4))
    order = ["conv_id", "turn", F.substring("role", 1, 16), F.substring("text", 1, 64), "mark", "id"]
    sorted_rows = coded.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "code")
    if size is None:
        size = max(PIECE_ROWS, int(rows.count() ** 0.5))
    pieces = saved(_pieces(sorted_rows, size), "pieces")
    plan = _joined(pieces.where("split"))
    whole = pieces.where("not split").withColumns({"start": F.lit(NONE), "ends": F.lit(None).cast("array<bigint>"), "last": F.lit(1)})
    names = ["conv_id", "part", "piece", "split", "codes", "roles", "texts", "start", "ends", "last"]
    todo = whole.select(names).union(pieces.where("split").join(plan, ["part", "piece"]).select(names))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield from _repair_batch(batch.slice(at, 64))

    out = saved(todo.mapInArrow(each, _REPAIRED), "repaired")
    at = lambda place: F.when(F.length("codes") > 0, F.conv(F.hex(F.substring("codes", place, 1)), 16, 10).cast("int").bitwiseAND(3))
    ends = pieces.select("part", "piece", at(1).alias("first"), at(-1).alias("last"), "low", "high", "turns", "turn_first", "turn_last")
    return out.join(ends, ["part", "piece"]).withColumn("conv_id", from_id("conv_id")).select("conv_id", *[c for c in out.columns if c != "conv_id"], *ends.columns[2:])


_SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summary(pieces: DataFrame) -> DataFrame:
    """One row for each conversation of ``repaired``: gaps, the counts, cost, audit and repaired_sha256, the digest of its turns as ``role:text`` lines.

    gaps counts the turn numbers between the least and the greatest that no row has. A conversation without rows has zeros, an empty audit and the
    digest of the empty string.
    """
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    whole = pieces.where("not split").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")

    def merged(rows: Iterator[dict]) -> Iterator[dict]:
        conv, out = (), None
        for r in rows:
            if conv != r["conv_id"]:
                if out:
                    yield closed(out)
                conv = r["conv_id"]
                out = dict.fromkeys(counts, 0) | {"conv_id": conv, "audit": [], "digest": hashlib.sha256(), "any": False, "low": None, "high": None, "turns": 0, "turn": None, "tail": None}
            for c in counts:
                out[c] += r[c]
            out["audit"].append(r["audit"])
            for role, text in zip(r["roles"], r["texts"]):
                out["digest"].update((("\n" if out["any"] else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                out["any"] = True
            if r["first"] is not None:
                out["illegal"] += out["tail"] is not None and (out["tail"], r["first"]) not in LEGAL
                out["tail"] = r["last"]
            if r["turns"]:
                out["turns"] += r["turns"] - (out["turn"] == r["turn_first"])
                out["low"], out["high"], out["turn"] = r["low"] if out["low"] is None else out["low"], r["high"], r["turn_last"]
        if out:
            yield closed(out)

    def closed(out: dict) -> dict:
        gaps = out["high"] - out["low"] + 1 - out["turns"] if out["turns"] else 0
        return out | {"gaps": gaps, "audit": "".join(out["audit"]), "repaired_sha256": out["digest"].hexdigest()}

    split = pieces.where("split").withColumn("conv_id", as_id("conv_id"))
    told = _in_turn(split, [F.asc("part"), F.asc("piece")], merged, _SUMMARY)
    return whole.union(told.withColumn("conv_id", from_id("conv_id")).select(whole.columns))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, kept) with a fault by crc32 of ``conv_id:turn`` modulo 20; nulls there, in role and in text are one space.

    0 drops a row (kept is null, so that its conversation stays known), 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes its role user.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    held = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"), (F.crc32(key) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    copies = held.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fault") != 0, True).alias("kept"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy"))
    return copies.drop("copy")
