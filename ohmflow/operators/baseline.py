"""Baseline ("stable") statistics A8–A10 and z-scores J3/F1/F2.

The baseline is one row per feature (bounded by the column count), so it is
joined to the readings by broadcast — never collected into driver loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RAW_FEATURES, STD_FLOOR
from .common import attach_row, rounded
from .stats import exact_quantiles, qname


def baseline_stats(df: DataFrame, cols: Sequence[str] = RAW_FEATURES,
                   label: str | None = "stabf", stable_value=0,
                   quartiles: bool = True) -> DataFrame:
    """Per feature over the stable rows: mean, std (sample, floored at
    1e-6), p25, p75, min, max. Long: one row per feature."""
    src = df.where(F.col(label) == F.lit(stable_value)) if label else df
    long = src.select(*cols).unpivot([], list(cols), "feature", "value")
    moments = long.groupBy("feature").agg(
        F.avg("value").alias("mean"),
        F.greatest(F.stddev_samp("value"), F.lit(STD_FLOOR)).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    if not quartiles:
        return moments
    q = exact_quantiles(src, cols, [0.25, 0.75]).select(
        "feature", F.col(qname(0.25)).alias("p25"), F.col(qname(0.75)).alias("p75"))
    return moments.join(q, "feature")


def wide_baseline(stats: DataFrame, cols: Sequence[str] = RAW_FEATURES,
                  fields: Sequence[str] = ("mean", "std")) -> DataFrame:
    """One-row table ``{feature}_{field}`` from the long baseline."""
    return stats.groupBy().pivot("feature", list(cols)).agg(
        *[F.first(f).alias(f) for f in fields])


def with_zscores(df: DataFrame, stats: DataFrame, cols: Sequence[str] = RAW_FEATURES,
                 prefix: str = "z_", missing_as_mean: bool = True) -> DataFrame:
    """J3 + F1/F2: add ``z_<feature>`` = (x − mean)/std for every feature; a
    missing value counts as the mean (S16, ``??`` form)."""
    wide = wide_baseline(stats, cols)
    out = attach_row(df, wide)
    zs = []
    for c in cols:
        x = F.coalesce(F.col(c), F.col(f"{c}_mean")) if missing_as_mean else F.col(c)
        zs.append(((x - F.col(f"{c}_mean")) / F.col(f"{c}_std")).alias(f"{prefix}{c}"))
    return out.select(*df.columns, *zs)


def zscore_map(cols: Sequence[str] = RAW_FEATURES, prefix: str = "z_") -> Column:
    """F2: ``MAP<feature, z>`` of the z columns (the scored-record form)."""
    return F.map_from_arrays(F.array(*[F.lit(c) for c in cols]),
                             F.array(*[F.col(f"{prefix}{c}") for c in cols]))


def feature_ranges(stats: DataFrame, digits: int = 4) -> DataFrame:
    """A10: defaults (mean) and ranges, rounded to 4 decimals. ``mean`` is the
    documented "default" value (S13: the reference returns the mean)."""
    return stats.select("feature", *[rounded(F.col(c), digits).alias(c)
                                     for c in ("min", "max", "p25", "p75", "mean")])
