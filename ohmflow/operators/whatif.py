"""Event-schedule what-if M21 (+ J4, F13, F14): expand base rows over steps,
overlay interval events, optionally switch to a rebased fix schedule.

Per step, an event holds ``start + t·(end − start)`` inside [s, e] (t =
(step−s)/max(e−s,1)), its end value after e, nothing before s; when several
events touch a feature the later one in list order wins. Which event wins at a
step does not depend on the base row, so the events are first reduced to one
row per (scenario, step) with the winner of each feature; the base rows take
that row by one broadcast equi-join and compute their values row-locally. The text of
an end value is read there too, once per event and not once per row. Features that no
event names are passed on as they are."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import interpolate, is_relative, resolve_target
from ..schema import RAW_FEATURES

EVENT_SCHEMA = ("scenario string, ordinal int, phase string, feature string, start_step int, "
                "end_step int, start_val double, end_val string")


def expand_steps(base: DataFrame, id_col: str, n_steps: int) -> DataFrame:
    """(base row) × step 0..n−1 via ``explode(sequence)`` (row-local fan-out)."""
    return base.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))))


def named_features(events: DataFrame, features: Sequence[str] = RAW_FEATURES) -> list[str]:
    """Those of ``features`` that an event names (events are few rows)."""
    named = {r["feature"] for r in events.select("feature").distinct().collect()}
    return [f for f in features if f in named]


def overlay(stepped: DataFrame, events: DataFrame, n_steps: int,
            features: Sequence[str] = RAW_FEATURES, fix_at_step: int | None = None,
            scenario_col: str | None = None, finish: Callable[[Column], Column] | None = None,
            finished: str = "") -> DataFrame:
    """Apply ``events`` (columns of ``EVENT_SCHEMA``; ``phase`` 'main' or
    'fix') to every row and step (0 .. ``n_steps`` − 1). A null ``start_val``
    means the base row's value; ``end_val`` may be relative (``"3x"``); a target
    that is no number leaves the base value. With ``fix_at_step`` the main events
    stop there and the fix events apply rebased by that step. With
    ``scenario_col`` an event applies only to rows of its own scenario, without
    it every event applies to every row. ``finish`` is applied to the values that events
    give; with it a feature that none touches is taken from the column named ``finished``
    + feature, where the base row's value was finished before the steps."""
    features = named_features(events, features)
    if not features:
        return stepped
    finish = finish or (lambda c: c)
    shift = F.lit(0) if fix_at_step is None else \
        F.when(F.col("phase") == "fix", F.lit(fix_at_step)).otherwise(F.lit(0))
    ev = events.withColumns({"start_step": F.col("start_step") + shift,
                             "end_step": F.col("end_step") + shift})
    first = F.greatest(F.col("start_step"), F.lit(0))
    ev = ev.where(first < n_steps).withColumn(
        "step", F.explode(F.sequence(first, F.lit(n_steps - 1))))
    live = (F.col("phase") == "main") if fix_at_step is None else F.when(
        F.col("step") >= fix_at_step, F.col("phase") == "fix").otherwise(F.col("phase") == "main")
    keys = ["step"] if scenario_col is None else ["scenario", "step"]
    # what resolve_target gives for a start of 1: the factor of a relative target, else the target
    ev = ev.withColumns({"relative": is_relative(F.col("end_val")),
                         "factor": resolve_target(F.col("end_val"), F.lit(1.0))})
    last = F.max(F.struct("ordinal", "start_step", "end_step", "start_val", "end_val", "relative", "factor"))
    winner = (ev.where(live).groupBy(*keys, "feature").agg(last.alias("e"))
              .groupBy(*[F.col(c).alias(f"_{c}") for c in keys])
              .pivot("feature", list(features)).agg(F.first("e")))
    winner = winner.select(*[f"_{c}" for c in keys],
                           *[F.col(f).alias(f"_ev_{f}") for f in features])
    on = F.col("step") == F.col("_step")
    if scenario_col is not None:
        on = on & (F.col(scenario_col) == F.col("_scenario"))
    # one row per (scenario and) step: a shuffle by step would put all rows in n_steps tasks
    joined = stepped.join(F.broadcast(winner), on, "left")

    def value(f: str):
        e = F.col(f"_ev_{f}")
        s0 = F.coalesce(e["start_val"], F.col(f))
        s1 = F.when(e["relative"], s0 * e["factor"]).otherwise(e["factor"])
        ramp = interpolate(F.col("step"), e["start_step"], e["end_step"], s0, s1)
        return F.coalesce(finish(F.when(F.col("step") <= e["end_step"], ramp).when(e.isNotNull(), s1)),
                          F.col(f"{finished}{f}"))
    return joined.select(*[value(c).alias(c) if c in features else F.col(c)
                           for c in stepped.columns])
