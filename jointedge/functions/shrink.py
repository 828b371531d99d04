"""Shrinkage of sampled correlations toward group baselines, buckets and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prior weights and sample floors of the shrinkage rules.
DYAD_PRIOR, DYAD_FLOOR = 80, 30
PAIR_PRIOR, PAIR_FLOOR = 50, 5
TRIPLE_PRIOR, TRIPLE_FLOOR = 80, 15


def blend(own: Column, base: Column, weight: Column) -> Column:
    """weight * own + (1 - weight) * base; the other one where one is null."""
    return F.when(own.isNull(), base).when(base.isNull(), own).otherwise(weight * own + (1 - weight) * base)


def resolve_dyad_r(own: Column, base: Column, has_base: Column, n: Column, mode: str = "blended") -> Column:
    """struct(r, weight, fallback) of a dyad's correlation under mode player, global or blended."""
    n = F.coalesce(n, F.lit(0))
    baseline = F.coalesce(base, F.lit(0.0))
    if mode == "player":
        r, weight, fallback = own, F.lit(1.0), F.lit(False)
    elif mode == "global":
        r, weight, fallback = baseline, F.lit(0.0), ~has_base
    elif mode == "blended":
        fallback = ~has_base | (n < DYAD_FLOOR)
        weight = F.when(fallback, 0.0).otherwise(n / (n + DYAD_PRIOR))
        r = F.when(fallback, baseline).otherwise(blend(own, base, n / (n + DYAD_PRIOR)))
    else:
        raise ValueError("mode is player, global or blended")
    return F.struct(r.alias("r"), weight.alias("weight"), fallback.alias("fallback"))


def shrunk_entity_r(own: Column, base: Column, n_eff: Column, legs: int = 2) -> Column:
    """The baseline below the floor of effective games, else the blend by n / (n + prior)."""
    prior, floor = (PAIR_PRIOR, PAIR_FLOOR) if legs == 2 else (TRIPLE_PRIOR, TRIPLE_FLOOR)
    n = F.coalesce(n_eff, F.lit(0.0))
    return F.when(n < floor, base).otherwise(blend(own, base, n / (n + prior)))


def mean_of(*rs: Column) -> Column:
    """Mean of those that are not null."""
    held = F.filter(F.array(*rs), lambda r: r.isNotNull())
    return F.try_divide(F.aggregate(held, F.lit(0.0), lambda a, r: a + r), F.size(held))


def entity_scheme(n: Column) -> Column:
    return F.when(n <= 3, "dyn_1_3").when(n <= 8, "dyn_4_8").when(n <= 15, "dyn_9_15").otherwise("dyn_16plus")


def dyad_scheme(n: Column) -> Column:
    return F.when(n <= 10, "dyn_1_10").when(n <= 25, "dyn_11_25").when(n <= 60, "dyn_26_60").otherwise("dyn_61plus")


def slot_confidence(n: Column) -> Column:
    return F.when(n >= 20, "high").when(n >= 5, "medium").when(n >= 1, "low").otherwise("none")


def slot_shift(a: Column, b: Column, was_a: Column, was_b: Column) -> Column:
    same = (a == was_a) & (b == was_b) | (a == was_b) & (b == was_a)
    now, then = F.abs(a - b), F.abs(was_a - was_b)
    return F.when(a.isNull() | b.isNull(), "unknown").when(was_a.isNull() | was_b.isNull(), "different").when(same, "same").when(now < then, "tighter").when(now > then, "wider").otherwise("different")


def badges(p_value: Column, n: Column, ev_frac: Column, p_joint: Column, p_independent: Column, drift: Column) -> Column:
    """What a reader should be warned of, in a fixed order."""
    return F.array_compact(
        F.array(
            F.when(p_value > 0.10, "low_confidence"),
            F.when(n < 25, "small_sample"),
            F.when(ev_frac > 1, "outlier"),
            F.when(F.abs(p_joint - p_independent) > 0.20, "implausible_gap"),
            F.when(drift > 0, "line_drift"),
        )
    )


def gap_label(r_gap: Column) -> Column:
    return F.when(r_gap > 0.05, "underpriced").when(r_gap < -0.05, "overpriced").when(r_gap.isNotNull(), "agrees")


def thesis(ev_pct: Column, from_legs: Column, from_corr: Column) -> Column:
    """correlation_gap above 8 % EV, the larger part between 3 and 8 %, else marginal."""
    return F.when(ev_pct > 8, "correlation_gap").when(ev_pct >= 3, F.when(from_legs > from_corr, "leg_mispricing").otherwise("correlation_gap")).when(ev_pct.isNotNull(), "marginal")


def pair_verdict(ev_pct: Column, n_eff: Column, r_gap: Column, clamp: Column) -> Column:
    thin = (n_eff < 15) | clamp.isNotNull() | (r_gap < -0.05)
    return F.when(ev_pct < 0, "SKIP").when((ev_pct <= 5) | thin, "MARGINAL").when(ev_pct > 5, "PLAY")


def triple_verdict(ev_pct: Column, model_ev_pct: Column, n_eff: Column) -> Column:
    agree = F.signum(ev_pct) == F.signum(model_ev_pct)
    return F.when(ev_pct < 0, "SKIP").when((ev_pct > 10) & (n_eff >= 20) & agree, "PLAY").when(ev_pct.isNotNull(), "MARGINAL")


def dyad_verdict(ev_pct: Column, confidence: Column) -> Column:
    return F.when(ev_pct < 0, "SKIP").when((ev_pct > 5) & confidence.isin("high", "medium"), "PLAY").when(ev_pct.isNotNull(), "MARGINAL")
