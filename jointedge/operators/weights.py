"""Season weights: schemes and their renormalisation over the seasons that an entity has."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .moments import dot

# Weights of the three past seasons and the current one, by scheme.
ENTITY_SCHEMES = {
    "dyn_1_3": (0.20, 0.25, 0.40, 0.15),
    "dyn_4_8": (0.15, 0.20, 0.35, 0.30),
    "dyn_9_15": (0.10, 0.15, 0.30, 0.45),
    "dyn_16plus": (0.08, 0.12, 0.25, 0.55),
    "static": (0.15, 0.20, 0.30, 0.35),
    "unweighted": (1.0, 1.0, 1.0, 1.0),
}
DYAD_SCHEMES = {
    "dyn_1_10": (0.20, 0.25, 0.45, 0.10),
    "dyn_11_25": (0.15, 0.20, 0.35, 0.30),
    "dyn_26_60": (0.10, 0.15, 0.30, 0.45),
    "dyn_61plus": (0.08, 0.12, 0.25, 0.55),
    "static": (0.15, 0.20, 0.30, 0.35),
    "unweighted": (1.0, 1.0, 1.0, 1.0),
}


def with_rows(df: DataFrame, names: list[str], rows: list[tuple]) -> DataFrame:
    """Each row of ``df`` once for each of a few fixed rows (a spec), as columns ``names``: no join and no shuffle."""
    structs = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in rows]
    return df.select("*", F.inline(F.array(*structs)))


def with_numbers(df: DataFrame, names: list[str], rows: list[tuple[int, ...]]) -> DataFrame:
    """``with_rows`` for some hundreds of rows of whole numbers: one literal of the plan, however many they are."""
    kind = f"array<struct<{', '.join(f'{n}: int' for n in names)}>>"
    return df.select("*", F.inline(F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), kind)))


def with_schemes(df: DataFrame, schemes: dict[str, tuple[float, ...]]) -> DataFrame:
    """Each row for each scheme, with scheme, w0..w3 and pin (the current season keeps its weight; not for unweighted)."""
    return with_rows(df, ["scheme", "w0", "w1", "w2", "w3", "pin"], [(k, *v, k != "unweighted") for k, v in schemes.items()])


def normalised(present: list[Column], weights: list[Column], pin: Column) -> list[Column]:
    """Weights that add up to one over the seasons that are present; the last season is the current one.

    With ``pin`` and the current season present, it keeps its weight and the others share what remains, by weight, or
    evenly if they have none; alone it gets everything. Otherwise all present share one by weight, or evenly.
    """
    on = [F.when(p, 1.0).otherwise(0.0) for p in present]
    past = dot(on[:-1], weights[:-1])
    n_past = on[0]
    for x in on[1:-1]:
        n_past = n_past + x
    total, n_all = past + on[-1] * weights[-1], n_past + on[-1]
    pinned = pin & present[-1]
    scale = F.try_divide(1.0 - weights[-1], past)
    out = []
    for p, w in zip(present[:-1], weights[:-1]):
        part = F.when(past > 0, w * scale).otherwise(F.try_divide(1.0 - weights[-1], n_past))
        plain = F.when(total > 0, F.try_divide(w, total)).otherwise(F.try_divide(F.lit(1.0), n_all))
        out.append(F.when(~p, 0.0).when(pinned, part).otherwise(plain))
    last = F.when(n_past == 0, 1.0).when(pinned, weights[-1]).otherwise(F.when(total > 0, F.try_divide(weights[-1], total)).otherwise(F.try_divide(F.lit(1.0), n_all)))
    return [*out, F.when(~present[-1], 0.0).otherwise(last)]
