"""Profiles A1–A7: overview, class balance, histograms, correlations, box
plots, split sizes. Each is one or two aggregate passes; per-feature results
come back long (feature as a column), not as driver-side loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import pearson
from .stats import exact_quantiles, qname


def profile_overview(df: DataFrame) -> DataFrame:
    """A1: per column ``column, dtype, ordinal, n_rows, n_null`` in one pass."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"_null_{i}")
                   for i, c in enumerate(cols)])
    meta = df.sparkSession.createDataFrame(
        [(i, c, f.dataType.simpleString()) for i, (c, f) in
         enumerate(zip(cols, df.schema.fields))], "ordinal int, column string, dtype string")
    nulls = agg.unpivot(["_n"], [f"_null_{i}" for i in range(len(cols))], "_k", "n_null")
    nulls = nulls.select(F.col("_n").alias("n_rows"), "n_null",
                         F.regexp_extract("_k", r"(\d+)$", 1).cast("int").alias("ordinal"))
    return meta.join(F.broadcast(nulls), "ordinal")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """A2: count and share (3 decimals) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per class: tiny
    return counts.select(label, "n", F.round(F.col("n") / total, 3).alias("share"))


def class_histogram(df: DataFrame, cols: Sequence[str], label: str, bins: int = 40) -> DataFrame:
    """A3: equal-width histogram per feature and class, each class over its own
    [min, max]; the max lands in the last bin; constant → bin 0."""
    long = df.select(label, *cols).unpivot([label], list(cols), "feature", "value") \
        .where(F.col("value").isNotNull())
    rng = long.groupBy(label, "feature").agg(F.min("value").alias("lo"),
                                              F.max("value").alias("hi"))
    span = F.col("hi") - F.col("lo")
    b = F.when(span == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("lo")) / span * F.lit(float(bins))),
                F.lit(bins - 1)))
    return (long.join(rng, [label, "feature"])
            .groupBy(label, "feature", b.cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"),
                 F.first("hi").alias("hi")))


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A4: Pearson correlation of every pair i < j (lower triangle) in one agg."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    agg = df.agg(*[pearson(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    long = agg.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "corr")
    return long.select(F.split("pair", r"\|").getItem(0).alias("feature_a"),
                       F.split("pair", r"\|").getItem(1).alias("feature_b"), "corr")


def boxplot_stats(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """A5: per class and feature: quartiles, whiskers (most extreme values within
    1.5·IQR of the box) and the number of points outside them."""
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], by=[label])
    q = q.select(label, "feature", F.col(qname(0.25)).alias("q1"),
                 F.col(qname(0.5)).alias("median"), F.col(qname(0.75)).alias("q3"))
    long = df.select(label, *cols).unpivot([label], list(cols), "feature", "value") \
        .where(F.col("value").isNotNull())
    lo = F.col("q1") - F.lit(1.5) * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + F.lit(1.5) * (F.col("q3") - F.col("q1"))
    v = F.col("value")
    inside = (v >= lo) & (v <= hi)
    return (long.join(q, [label, "feature"])
            .groupBy(label, "feature")
            .agg(F.first("q1").alias("q1"), F.first("median").alias("median"),
                 F.first("q3").alias("q3"),
                 F.min(F.when(inside, v)).alias("whisker_low"),
                 F.max(F.when(inside, v)).alias("whisker_high"),
                 F.count_if(~inside).alias("n_outliers")))


def split_sizes(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Rows and positive rate per split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"),
                                 F.avg(F.col(label).cast("double")).alias("positive_rate"))


def column_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean of each column (long)."""
    agg = df.agg(*[F.avg(c).alias(c) for c in cols])
    return agg.unpivot([], list(cols), "feature", "mean")

