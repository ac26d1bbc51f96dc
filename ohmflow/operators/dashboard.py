"""Dashboard aggregates A13–A20 and feed/export shaping (T1, T6, W11, W12,
IO12, P14, P15). Every aggregate is a single pass (plus bounded lookups);
feed positions come from ``with_ordinal`` instead of a global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURE_GROUPS, FEATURE_LABELS, RAW_FEATURES, STD_FLOOR, TIERS
from .common import attach_row, rounded
from .sequence import with_ordinal


def feed_order(df: DataFrame, prob: str = "ensemble_prob", tie: str = "seq",
               row_col: str = "row") -> DataFrame:
    """T1 + W11: the feed sorted by probability ascending (tie key added) with a
    1-based ``row``."""
    o = with_ordinal(df, [prob, tie], "_ord")
    return o.withColumn(row_col, F.col("_ord") + 1).drop("_ord")


def upload_summary(raw: DataFrame, scored: DataFrame, prob: str = "ensemble_prob",
                   label: str = "ensemble_label", tier: str = "risk_tier",
                   features: Sequence[str] = RAW_FEATURES) -> DataFrame:
    """Totals, dropped rows, faults, fault %, mean/max/min probability and
    tier counts — one aggregate over the scored rows plus one null count."""
    any_null = F.lit(False)
    for c in features:
        any_null = any_null | F.col(c).isNull()
    dropped = raw.agg(F.count_if(any_null).alias("rows_dropped"))
    s = scored.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.sum(F.col(label)).cast("long").alias("fault_count"),
        F.count_if(F.col(label) == 0).alias("stable_count"),
        rounded(F.lit(100.0) * F.sum(F.col(label)) / F.count(F.lit(1)), 1).alias("fault_pct"),
        rounded(F.avg(prob), 4).alias("mean_prob"),
        rounded(F.max(prob), 4).alias("max_prob"),
        rounded(F.min(prob), 4).alias("min_prob"),
        *[F.count_if(F.col(tier) == t).alias(f"tier_{t.lower()}") for t in TIERS])
    return attach_row(s, dropped)


def tier_mix(df: DataFrame, tier: str = "risk_tier") -> DataFrame:
    """Count per tier, zero-filled over Green/Amber/Red."""
    counts = df.groupBy(F.col(tier).alias("name")).agg(F.count(F.lit(1)).alias("value"))
    tiers = df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(TIERS)],
                                            "name string, ordinal int")
    return (tiers.join(counts, "name", "left")
            .select("name", "ordinal", F.coalesce("value", F.lit(0)).alias("value")))


def cluster_mix(df: DataFrame, cluster: str = "kmeans_cluster") -> DataFrame:
    """Count and share per cluster present in the feed."""
    counts = df.groupBy(F.col(cluster).alias("name")).agg(F.count(F.lit(1)).alias("value"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return attach_row(counts, total).select(
        "name", "value", (F.col("value") / F.col("_total")).alias("pct"))


def _pct(c: Column) -> Column:
    """F16: percent as an integer (JS Math.round on non-negative values)."""
    return F.round(c * F.lit(100.0), 0).cast("long")


def feed_summary(feed: DataFrame, row_col: str = "row") -> DataFrame:
    """A16 + A17 + A20: accuracy, fault rates, mean and peak probability with its
    first 1-based row, mean model probabilities in percent, mean anomaly."""
    p = F.coalesce(F.col("ensemble_prob"), F.lit(0.0))
    lab = F.when(F.col("ensemble_label") == 1, 1).otherwise(0)
    truth = F.when(F.col("_true_label") == 1, 1).otherwise(0)
    return feed.agg(
        F.avg((lab == truth).cast("double")).alias("accuracy"),
        F.avg(lab.cast("double")).alias("fault_rate"),
        F.avg(truth.cast("double")).alias("true_fault_rate"),
        F.avg(p).alias("mean_prob"),
        F.greatest(F.max(p), F.lit(0.0)).alias("max_prob"),
        F.when(F.max(p) > 0, F.max_by(F.col(row_col), F.struct(p, -F.col(row_col))))
        .otherwise(F.lit(0)).cast("long").alias("max_row"),
        _pct(F.avg(F.coalesce(F.col("RF_prob"), F.lit(0.0)))).alias("rf_pct"),
        _pct(F.avg(F.coalesce(F.col("XGBoost_prob"), F.lit(0.0)))).alias("xgb_pct"),
        _pct(F.avg(p)).alias("ensemble_pct"),
        F.avg(F.coalesce(F.col("IF_anomaly_score"), F.lit(0.0))).alias("anomaly_mean"))


def abs_z_long(df: DataFrame, stats: DataFrame, features: Sequence[str] = RAW_FEATURES,
               keep: Sequence[str] = ()) -> DataFrame:
    """U3 + F1: long ``(keep…, feature, abs_z)`` with std floored at 1e-6 and a
    missing value taken as the mean (S16)."""
    long = df.select(*keep, *features).unpivot(list(keep), list(features), "feature", "value")
    st = stats.select("feature", "mean", F.greatest(F.coalesce("std", F.lit(STD_FLOOR)),
                                                   F.lit(STD_FLOOR)).alias("std"))
    v = F.coalesce(F.col("value"), F.col("mean"))
    return (long.join(F.broadcast(st), "feature")  # one row per feature
            .select(*keep, "feature", F.abs((v - F.col("mean")) / F.col("std")).alias("abs_z")))


def sensor_stress(df: DataFrame, stats: DataFrame,
                  features: Sequence[str] = RAW_FEATURES) -> DataFrame:
    """Mean and peak |z| per feature, 2 decimals."""
    z = abs_z_long(df, stats, features)
    return z.groupBy("feature").agg(rounded(F.avg("abs_z"), 2).alias("mean"),
                                    rounded(F.max("abs_z"), 2).alias("max"))


def group_stress(df: DataFrame, stats: DataFrame,
                 features: Sequence[str] = RAW_FEATURES) -> DataFrame:
    """Mean |z| per sensor group (feature name without digits)."""
    z = abs_z_long(df, stats, features).withColumn(
        "group", F.regexp_replace("feature", "[0-9]", ""))
    labels = F.create_map(*[x for k, v in FEATURE_GROUPS.items() for x in (F.lit(k), F.lit(v))])
    return z.groupBy("group").agg(rounded(F.avg("abs_z"), 2).alias("stress")) \
        .withColumn("label", labels[F.col("group")])


def trend_sample(feed: DataFrame, row_col: str = "row", points: int = 90) -> DataFrame:
    """Every n-th feed row (n = ceil(N/points)) and the last one, with
    percent probabilities."""
    n = feed.agg(F.count(F.lit(1)).alias("_n"))
    every = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(float(points))))
    idx = F.col(row_col) - 1
    return (attach_row(feed, n)
            .where((F.pmod(idx, every) == 0) | (idx == F.col("_n") - 1))
            .select(row_col, _pct(F.col("ensemble_prob")).alias("probability"),
                    _pct(F.col("RF_prob")).alias("rf"), _pct(F.col("XGBoost_prob")).alias("xgb"),
                    F.col("IF_anomaly_score").alias("anomaly"), F.col("risk_tier").alias("tier")))


def js_number(c: Column) -> Column:
    """Text of a 2-decimal number as JavaScript prints it (2.30 → 2.3, 2.00 → 2)."""
    txt = F.format_string("%.2f", rounded(c, 2) + F.lit(0.0))
    return F.regexp_replace(F.regexp_replace(txt, r"0+$", ""), r"\.$", "")


def fixed4(c: Column) -> Column:
    """``toFixed(4)`` on the binary value."""
    return F.format_string("%.4f", rounded(c, 4) + F.lit(0.0))


def export_rows(scored: DataFrame, reasons: str = "alert_reason",
                features: Sequence[str] = RAW_FEATURES, row_col: str = "row") -> DataFrame:
    """IO12 + P14 + T6: the flat export table (1-based row, raw features,
    4-decimal texts, Fault/Stable, ``feature(zσ)`` reasons joined by "; "),
    with the tier sort key and the display name of the top reason."""
    labels = F.create_map(*[x for k, v in FEATURE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    reason_txt = F.concat_ws("; ", F.transform(F.col(reasons), lambda a: F.concat(
        a["feature"], F.lit("("), js_number(a["z_score"]), F.lit("σ)"))))
    tier_key = F.when(F.col("risk_tier") == "Green", 0).when(F.col("risk_tier") == "Amber", 1) \
        .when(F.col("risk_tier") == "Red", 2).otherwise(0)
    return scored.select(
        row_col, *features, fixed4(F.col("ensemble_prob")).alias("ensemble_prob"), "risk_tier",
        F.when(F.col("ensemble_label") == 1, "Fault").otherwise("Stable").alias("label"),
        "kmeans_cluster", fixed4(F.col("RF_prob")).alias("RF_prob"),
        fixed4(F.col("XGBoost_prob")).alias("XGBoost_prob"),
        fixed4(F.col("IF_anomaly_score")).alias("IF_anomaly_score"),
        reason_txt.alias("alert_reason"), tier_key.alias("tier_order"),
        labels[F.col(reasons)[0]["feature"]].alias("top_reason_label"))


def lookup_row(df: DataFrame, n: int, row_col: str = "row") -> DataFrame:
    """One scored row by its 1-based index (a point lookup, pushed down)."""
    return df.where(F.col(row_col) == F.lit(n))


def stable_screen(df: DataFrame, prob: str = "ensemble_prob", label: str = "_true_label",
                  below: float = 0.35, tie: str = "seq") -> DataFrame:
    """P8 + T5: truly stable rows the model also finds clearly stable
    (prob < 0.35), ranked by rounded probability (rank 1 = the best start)."""
    s = df.where((F.col(label) == 0) & (F.col(prob) < F.lit(below))) \
        .withColumn("baseline_prob", rounded(F.col(prob), 4))
    o = with_ordinal(s, ["baseline_prob", tie], "_ord")
    return o.withColumn("screen_rank", F.col("_ord") + 1).drop("_ord")
