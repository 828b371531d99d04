"""Combo specs as documents: which pairs and triples of legs a build counts.

A spec is a JSON document with ``combos_2`` and ``combos_3``, arrays of arrays of legs such as ``Over 4.5 Strikeouts``. It is small by its nature,
some hundreds of combos, so its legs and combos become a part of the plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

MOST = 100_000  # combos; more is no spec
_LEG = re.compile(r"\s*(Over|Under)\s+(-?\d+(?:\.\d+)?)\s+(\S.*?)\s*", re.IGNORECASE)


def parsed_leg(text: str) -> tuple[str, float, str]:
    """Direction, threshold and stat of a leg; an error for what is none."""
    found = _LEG.fullmatch(text or "")
    if not found:
        raise ValueError(f"no leg: {text!r}")
    return found[1].capitalize(), float(found[2]), found[3]


@dataclass(frozen=True)
class Spec:
    """The distinct legs of all combos, and the combos as their number and places among the legs."""

    legs: list[tuple[str, float, str]]
    pairs: list[tuple[int, int, int]]
    triples: list[tuple[int, int, int, int]]


def spec_of(pairs: list[list[str]], triples: list[list[str]]) -> Spec:
    """Combos keep their order and number; a leg that several name is one leg. Legs in unknown form, or combos of another size, are errors."""
    place: dict[tuple[str, float, str], int] = {}
    rows = {}
    for size, combos in ((2, pairs), (3, triples)):
        if any(len(c) != size for c in combos):
            raise ValueError(f"combos of {size} legs expected")
        rows[size] = [(i, *(place.setdefault(parsed_leg(t), len(place)) for t in c)) for i, c in enumerate(combos)]
    return Spec(list(place), rows[2], rows[3])


def read_spec(spark: SparkSession, path: str) -> Spec:
    """The spec of a JSON document."""
    held = spark.read.schema("combos_2 array<array<string>>, combos_3 array<array<string>>").option("multiLine", True).json(path)
    if (held.agg(F.sum(F.coalesce(F.size("combos_2"), F.lit(0)) + F.coalesce(F.size("combos_3"), F.lit(0)))).first()[0] or 0) > MOST:
        raise ValueError(f"over {MOST} combos")
    row = held.first()
    if row is None:
        raise ValueError("no spec")
    return spec_of(row.combos_2 or [], row.combos_3 or [])


def write_spec(spark: SparkSession, path: str, pairs: list[list[str]], triples: list[list[str]]) -> None:
    spark.createDataFrame([(pairs, triples)], "combos_2 array<array<string>>, combos_3 array<array<string>>").coalesce(1).write.json(path)
