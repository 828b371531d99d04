"""Joint probabilities of two events from their marginals and a correlation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero(r: Column) -> Column:
    return F.coalesce(F.nanvl(r.cast("double"), F.lit(0.0)), F.lit(0.0))


def joint_frechet(pa: Column, pb: Column, r: Column) -> Column:
    """Between independence and the Fréchet bound that the sign of r points to; a null r is zero."""
    r, both = _zero(r), pa * pb
    return F.when(r >= 0, both + r * (F.least(pa, pb) - both)).otherwise(both + r * (both - F.greatest(F.lit(0.0), pa + pb - 1)))


def inverse_joint_frechet(pa: Column, pb: Column, joint: Column) -> Column:
    """struct(r, clamp): the r that gives ``joint``; clamp is ceiling, floor or degenerate where none does."""
    both, low, high = pa * pb, F.greatest(F.lit(0.0), pa + pb - 1), F.least(pa, pb)
    missing = pa.isNull() | pb.isNull() | joint.isNull() | F.isnan(pa) | F.isnan(pb) | F.isnan(joint)
    flat = high - low <= 1e-12
    up, down = high - both, both - low
    r = (
        F.when(missing, None).when(flat, 0.0).when(joint >= high, 1.0).when(joint <= low, -1.0)
        .when((joint > both) & (up > 1e-12), F.try_divide(joint - both, up)).when((joint < both) & (down > 1e-12), F.try_divide(joint - both, down)).otherwise(0.0)
    )
    clamp = (
        F.when(missing, None).when(flat, "degenerate").when(joint >= high, F.when(joint > high + 1e-9, "ceiling")).when(joint <= low, F.when(joint < low - 1e-9, "floor"))
        .when((joint > both) & (up <= 1e-12) | (joint < both) & (down <= 1e-12), "degenerate")
    )
    return F.struct(r.alias("r"), clamp.alias("clamp"))


def ev_attribution(pa: Column, pb: Column, r: Column, decimal: Column) -> Column:
    """struct: EV in percent, its parts from the legs and from correlation, the r the price implies and the gap to ours."""
    joint, both, inverse = joint_frechet(pa, pb, r), pa * pb, inverse_joint_frechet(pa, pb, F.try_divide(F.lit(1.0), decimal))
    usable = pa.isNotNull() & pb.isNotNull() & (decimal > 1)
    return F.when(
        usable,
        F.struct(
            ((joint * decimal - 1) * 100).alias("total"),
            ((both * decimal - 1) * 100).alias("from_legs"),
            ((joint - both) * decimal * 100).alias("from_corr"),
            inverse["r"].alias("r_offered"),
            (_zero(r) - inverse["r"]).alias("r_gap"),
            inverse["clamp"].alias("clamp"),
        ),
    )


def joint_from_phi(r: Column, p1: Column, p2: Column) -> Column:
    """r * sqrt(p1 q1 p2 q2) + p1 p2, inputs and result kept within .001 and .999."""
    keep = lambda x: F.least(F.greatest(x, F.lit(0.001)), F.lit(0.999))
    a, b = keep(p1), keep(p2)
    return keep(_zero(r) * F.sqrt(a * (1 - a) * b * (1 - b)) + a * b)


def joint_of_legs(ps: Column, pair_joints: Column, pair_ps: Column) -> Column:
    """exp(sum ln p + sum over pairs [ln p_ab - ln(p_a p_b)]): ``pair_joints`` and ``pair_ps`` hold p_ab and p_a p_b of each pair."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.ln(x))
    return F.exp(total(ps) + total(pair_joints) - total(pair_ps))
