"""Mixing sources to target weights by hierarchical budgeting, in built-in functions only.

Leaves are (domain, lang, source). A token budget flows down the tree: at each node it is dealt to the children by weight, a
child that cannot absorb its part is filled and the rest goes to its siblings, and as a node's capacity is the sum of its
leaves', only what a whole subtree cannot absorb reaches the siblings of its ancestors. Each leaf then takes whole
epochs and a token prefix of one more; each epoch has an order of its own, seeded by md5 of id and text.

The tables of nodes are small (one row per leaf). The prefix is found in two steps: token sums by hash range give the
range where the budget ends, and only rows of that range are put in order, so no leaf meets in one task. A leaf of n rows has
about the square root of n ranges of about as many rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

LEVELS = ("domain", "lang", "source")
LEAVES_BROADCAST = 100_000  # more leaves meet the rows in a shuffle


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_hash(doc_id: Column, mark: Column, epoch: Column, seed: int) -> Column:
    """Rows without an id, or with the same one, are apart by ``mark``, the md5 of their texts."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")), mark))


def range_digits(rows: int) -> int:
    """Hex digits of the order hash that name a range, for about the square root of ``rows`` ranges."""
    return max(1, round(math.log(max(rows, 1), 16) / 2))


def _weights(node: Column, weights: dict[str, int], default: int) -> Column:
    return reduce(lambda c, kv: F.when(node == kv[0], F.lit(kv[1])).otherwise(c), weights.items(), F.lit(default)).cast("long")


def dealt(parents: DataFrame, children: DataFrame, on: list[str], child: str) -> DataFrame:
    """Children (on, child, capacity, weight) with the budget that the parents' (on, budget) gives each.

    Children in the order of capacity / weight are filled while their part by weight of what is left reaches the
    capacity; the others share what is left by weight, rounded down. A child of weight zero gets nothing.
    """
    x = children.join(parents, on, "left")
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight"))
    order = Window.partitionBy(*on).orderBy(ratio.asc_nulls_last(), child)
    before = F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    x = x.withColumn("left", F.greatest(F.coalesce("budget", F.lit(0)) - before, F.lit(0))).withColumn("rest", rest)
    fills = (F.col("weight") > 0) & (F.col("capacity") * F.col("rest") <= F.col("left") * F.col("weight"))
    x = x.withColumn("full", fills)
    # after the first that is not filled, no other is; all of them share what was left there
    x = x.withColumn("share", F.first(F.when(~F.col("full"), F.struct("left", "rest")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.expr("CASE WHEN share.rest > 0 THEN share.left * weight div share.rest ELSE 0 END")
    return x.withColumn("budget", F.when(F.col("share").isNull(), F.col("capacity")).otherwise(F.least(part, F.col("capacity")))).select(*on, child, "capacity", "budget")


def leaf_budgets(leaves: DataFrame, total: int, weights: dict[str, dict[str, int]], max_epochs: int, default: int = 1) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with their budget of at most ``total`` tokens and ``max_epochs`` of their own."""
    held = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    spark = leaves.sparkSession
    level = spark.range(1).select(F.lit(0).alias("root"), F.lit(total).cast("long").alias("budget"))
    for depth, name in enumerate(LEVELS):
        nodes = held.groupBy(*LEVELS[: depth + 1]).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", _weights(F.col(name), weights.get(name, {}), default)).withColumn("root", F.lit(0))
        level = dealt(level, nodes, ["root", *LEVELS[:depth]], name).select("root", *LEVELS[: depth + 1], "budget")
    return held.join(level, list(LEVELS)).select(*LEVELS, "tokens", "budget")


def mixture(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], budget_percent: int = 50, max_epochs: int = 2, seed: int = 20240601, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epochs (times it is taken) and the ``carry`` columns for each row that is taken at least once.

    The budget is ``budget_percent`` of the tokens of all rows. A leaf takes ``budget div tokens`` whole epochs, then, of the
    next epoch's order (md5 of seed, epoch, doc_id and text, ties by doc_id and tokens), the rows whose running token sum stays
    within the rest. Rows without tokens are never taken; null domain, lang or source is the empty string. Rows that repeat are
    rows of their own. Other columns are not read.
    """
    named = docs.select(
        F.col("doc_id"), *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(LEVELS, (domain, F.col("lang"), F.col("source")))), n_tokens(F.col("text")).alias("n_tokens"),
        F.md5(F.coalesce("text", F.lit(""))).alias("mark"), *carry,
    ).where("n_tokens > 0")
    rows = saved(named.drop(*carry), "tokens")
    leaves = saved(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "leaves")
    count, most, tokens = leaves.agg(F.count("*"), F.max("rows"), F.sum("tokens")).first()
    plan = leaf_budgets(leaves, (tokens or 0) * budget_percent // 100, weights, max_epochs).select(*LEVELS, F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("rest"))
    plan = saved(plan, "plan")
    small = F.broadcast if count <= LEAVES_BROADCAST else lambda df: df

    def ordered(held: DataFrame) -> DataFrame:
        placed = held.join(small(plan), list(LEVELS)).withColumn("hash", order_hash(F.col("doc_id"), F.col("mark"), F.col("whole") + 1, seed))
        return placed.withColumn("range", F.substring("hash", 1, range_digits(most or 0)))

    sums = ordered(rows).groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("sum"), F.first("rest").alias("rest"))
    before = F.sum("sum").over(Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("sum")
    ends = saved(sums.withColumn("before", before).where("before <= rest and before + sum > rest").select(*LEVELS, F.col("range").alias("end"), "before"), "ends")
    cut = ordered(named if carry else rows).join(small(ends), list(LEVELS), "left")
    inside = cut.where("range = end")
    running = F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "range").orderBy("hash", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("more", F.when(F.col("before") + running <= F.col("rest"), 1).otherwise(0))
    outside = cut.where("end is null or range <> end").withColumn("more", F.when((F.col("rest") > 0) & (F.col("end").isNull() | (F.col("range") < F.col("end"))), 1).otherwise(0))
    out = outside.unionByName(inside).withColumn("epochs", F.col("whole") + F.col("more"))
    return out.where("epochs > 0").select("doc_id", *LEVELS, "n_tokens", "epochs", *carry)
