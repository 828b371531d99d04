"""Odds and stake arithmetic as column expressions; every function returns null for inputs that have no meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Rounds half toward plus infinity."""
    return F.floor(x + 0.5)


def american_to_prob(a: Column) -> Column:
    a = a.cast("double")
    return F.when(a.isNull() | F.isnan(a) | (a == 0), None).when(a > 0, 100 / (a + 100)).otherwise(-a / (-a + 100))


def prob_to_american(p: Column) -> Column:
    p = p.cast("double")
    return F.when((p > 0) & (p < 0.5), half_up(F.try_divide((1 - p) * 100, p))).when((p >= 0.5) & (p < 1), -half_up(F.try_divide(p * 100, 1 - p)))


def american_to_decimal(a: Column) -> Column:
    a = a.cast("double")
    return F.when(a.isNull() | F.isnan(a) | (a == 0), None).when(a > 0, 1 + a / 100).otherwise(1 + F.try_divide(F.lit(100.0), -a))


def decimal_to_american(d: Column) -> Column:
    d = d.cast("double")
    return F.when(d >= 2, half_up((d - 1) * 100)).when(d > 1, half_up(F.try_divide(F.lit(-100.0), d - 1)))


def parse_american(text: Column) -> Column:
    """An integer from text such as ``+120`` or ``−150`` (the Unicode minus included)."""
    plain = F.translate(F.trim(text), "−–+", "--")
    return F.when(plain.rlike(r"^-?\d+$"), plain.try_cast("long"))


def parse_odds_pair(text: Column) -> Column:
    """struct(over, under) from ``+204 / -309``; null parts where the text has none."""
    over, under = (F.nullif(F.regexp_extract(text, r"([+-]?\d+)\s*/\s*([+-]?\d+)", i), F.lit("")) for i in (1, 2))
    return F.struct(over.cast("long").alias("over"), under.cast("long").alias("under"))


def ev_pct(joint: Column, decimal: Column) -> Column:
    return (joint * decimal - 1) * 100


def full_kelly(joint: Column, decimal: Column) -> Column:
    return F.when(decimal > 1, F.try_divide(joint * decimal - 1, decimal - 1))


def quarter_kelly_pct(joint: Column, decimal: Column) -> Column:
    k = full_kelly(joint, decimal)
    return F.when(k.isNotNull(), F.greatest(F.lit(0.0), k * 0.25) * 100)


def no_vig(over: Column, under: Column, direction: Column) -> Column:
    """The fair probability of ``direction`` from both sides' odds; null where a side is missing or over is outside .02 to .98."""
    po, pu = american_to_prob(over), american_to_prob(under)
    fair = F.try_divide(po, po + pu)
    return F.when((fair >= 0.02) & (fair <= 0.98), F.when(direction == "Over", fair).otherwise(1 - fair))


def independent_decimal(decimals: Column) -> Column:
    """Product of the decimals of an array; null and zero parts are skipped."""
    return F.aggregate(F.filter(decimals, lambda d: d.isNotNull() & (d != 0)), F.lit(1.0), lambda a, d: a * d)


def correlation_factor(offered: Column, independent: Column) -> Column:
    return F.try_divide(offered, independent)


def edge_points(joint: Column, decimal: Column) -> Column:
    """Model joint less implied probability, in points."""
    return (joint - F.try_divide(F.lit(1.0), decimal)) * 100
