"""Scalar column functions F1–F17: z-scores, tiers, node status, graph loads,
relative targets, interpolation, rounding. Each returns a ``Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import (CAPACITY_EPS, PR_EPS, STATUS_CRITICAL_AT, STATUS_ELEVATED_AT,
                      TIER_AMBER_MAX, TIER_GREEN_BELOW)


def risk_tier(prob: Column) -> Column:
    """Green below 0.4, Amber up to and including 0.7, else Red."""
    return (F.when(prob < F.lit(TIER_GREEN_BELOW), F.lit("Green"))
            .when(prob <= F.lit(TIER_AMBER_MAX), F.lit("Amber"))
            .otherwise(F.lit("Red")))


def status_of(max_abs_z: Column) -> Column:
    """Normal below 1.5, Elevated below 2.5, else Critical."""
    return (F.when(max_abs_z < F.lit(STATUS_ELEVATED_AT), F.lit("Normal"))
            .when(max_abs_z < F.lit(STATUS_CRITICAL_AT), F.lit("Elevated"))
            .otherwise(F.lit("Critical")))


def edge_capacity(g_src: Column, g_dst: Column) -> Column:
    """capacity of a producer→consumer edge."""
    return F.abs(g_src) + F.abs(g_dst) + F.lit(CAPACITY_EPS)


def load_ratio(flow: Column, capacity: Column) -> Column:
    """flow / capacity, capped at 1."""
    return F.least(flow / capacity, F.lit(1.0))


def is_relative(end_val: Column) -> Column:
    """whether a target is relative to its start (``'3x'``)."""
    return F.lower(F.trim(end_val.cast("string"))).endswith("x")


def resolve_target(end_val: Column, start_val: Column) -> Column:
    """``'3x'`` → 3·start, a number → itself (text form, as typed)."""
    txt = F.trim(end_val.cast("string"))
    factor = F.substring(txt, F.lit(1), F.length(txt) - F.lit(1)).try_cast("double")
    return F.when(is_relative(end_val), start_val * factor).otherwise(txt.try_cast("double"))


def interpolate(step: Column, s: Column, e: Column, v0: Column, v1: Column) -> Column:
    """linear ramp from ``v0`` at step s to ``v1`` at step e, guard max(e-s,1)."""
    t = (step - s).cast("double") / F.greatest(e - s, F.lit(1)).cast("double")
    return v0 + t * (v1 - v0)


def safe_ratio(num: Column, den: Column) -> Column:
    """0 when the denominator is 0 (zero_division=0 semantics)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def f1_guarded(precision: Column, recall: Column) -> Column:
    """2PR/(P+R+1e-12)."""
    return F.lit(2.0) * precision * recall / (precision + recall + F.lit(PR_EPS))


def pct(x: Column) -> Column:
    """F16: percent rounded to an integer (JS Math.round ≈ half-up)."""
    return F.round(x * F.lit(100.0), 0)


def hash_uniform(*parts: Column) -> Column:
    """Deterministic uniform in [0,1) from md5 of the parts (first 8 hex digits / 2^32).

    Same value in DuckDB: ('0x'||substr(md5(x),1,8))::BIGINT / 4294967296.
    """
    key = F.concat_ws("|", *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double")
            / F.lit(4294967296.0))


def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate; NULL when a column is constant. That is
    decided by min = max: the deviation of a constant that is no dyadic fraction is
    rounding noise, not 0. SQL twin: covar_pop(a,b) / nullif(stddev_pop(a)*stddev_pop(b), 0)."""
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varied, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
