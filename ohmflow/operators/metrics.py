"""Classification metrics A21–A27 (+ A11, A12, M14, M17, W8, W9) as
distributed aggregates over (label, score) tables.

Curve metrics (ROC-AUC, average precision, PR curve) first pre-aggregate to
one row per (group, distinct score) — a partial aggregate, so a hot score
value costs nothing — then take running totals with
``sequence.cumulative_sums`` (no single-partition window). ``by`` groups
(fold, model, …) are carried through every step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import f1_guarded, safe_ratio
from .common import attach_row
from .sequence import cumulative_sums
from .stats import exact_quantiles, qname


def score_table(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, score) → positives, negatives, rows; one row per distinct score."""
    y = F.col(label).cast("long")
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"))


def curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Operating points by descending score: cum_pos/cum_neg = TP/FP at
    threshold ≥ score, plus class totals P/N of the group."""
    st = score_table(df, label, score, by).withColumn("neg_score", -F.col("score"))
    cum = cumulative_sums(st, by, ["neg_score"], ["pos", "neg"])
    totals = st.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if not by:
        return attach_row(cum, totals).drop("neg_score")
    totals = totals.select(*[F.col(c).alias(f"_g_{c}") for c in by], "P", "N")
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]
    return cum.join(totals, same).drop("neg_score", *[f"_g_{c}" for c in by])


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area under (FPR, TPR) over distinct scores."""
    c = curve(df, label, score, by)
    prev_tp = F.col("cum_pos") - F.col("pos")
    area = F.col("neg") * (F.col("cum_pos") + prev_tp) / F.lit(2.0)
    return c.groupBy(*by).agg(F.try_divide(F.sum(area), F.first("P") * F.first("N"))
                              .alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Σ (R_n − R_{n−1}) · P_n over descending distinct thresholds (not the
    trapezoidal PR area)."""
    c = curve(df, label, score, by)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return c.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("pos") * prec), F.first("P")).alias("average_precision"))


def pr_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """PR table: threshold, precision, recall, f1 (1e-12 guard, F15)."""
    c = curve(df, label, score, by)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    rec = F.try_divide(F.col("cum_pos"), F.col("P"))
    return c.select(*by, F.col("score").alias("threshold"), prec.alias("precision"),
                    rec.alias("recall")).withColumn(
        "f1", f1_guarded(F.col("precision"), F.col("recall")))


def best_threshold(df: DataFrame, label: str, score: str, min_recall: float = 0.90,
                   by: Sequence[str] = ()) -> DataFrame:
    """The threshold with the best F1 among those with recall ≥ min_recall,
    else the best F1 overall; ties → the lowest threshold (first maximum)."""
    pr = pr_curve(df, label, score, by)
    key = F.struct((F.col("recall") >= F.lit(min_recall)).alias("ok"), F.col("f1"),
                   (-F.col("threshold")).alias("neg_t"))
    return pr.groupBy(*by).agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"),
                                        key).alias("b")).select(*by, "b.*")


def confusion(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """2×2 counts, zero-filled: ``truth, predicted, n``."""
    counts = df.groupBy(*by, F.col(label).cast("int").alias("truth"),
                        F.col(pred).cast("int").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    cells = df.sparkSession.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)],
                                            "truth int, predicted int")
    if by:
        groups = df.groupBy(*by).agg(F.lit(1).alias("_k"))
        cells = groups.join(F.broadcast(cells.withColumn("_k", F.lit(1))), "_k").drop("_k")
    return cells.join(counts, list(by) + ["truth", "predicted"], "left") \
        .withColumn("n", F.coalesce(F.col("n"), F.lit(0)))


def _cells(df: DataFrame, label: str, pred: str, by: Sequence[str]) -> DataFrame:
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    return df.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))


def classification_report(df: DataFrame, label: str, pred: str,
                          by: Sequence[str] = ()) -> DataFrame:
    """Per class precision/recall/f1/support plus macro and weighted
    averages and accuracy; 0 on empty denominators (zero_division=0)."""
    c = _cells(df, label, pred, by)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))

    def cls(name, tp_, fp_, fn_):
        p = safe_ratio(tp_, tp_ + fp_)
        r = safe_ratio(tp_, tp_ + fn_)
        f = F.when(p + r == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), (tp_ + fn_).cast("long").alias("support"))

    total = tp + fp + fn + tn
    rows = c.select(*by, cls("0", tn, fn, fp).alias("c0"), cls("1", tp, fp, fn).alias("c1"),
                    safe_ratio(tp + tn, total).alias("acc"), total.alias("tot"))
    macro = F.struct(F.lit("macro avg").alias("class"),
                     ((F.col("c0.precision") + F.col("c1.precision")) / 2).alias("precision"),
                     ((F.col("c0.recall") + F.col("c1.recall")) / 2).alias("recall"),
                     ((F.col("c0.f1") + F.col("c1.f1")) / 2).alias("f1"),
                     F.col("tot").cast("long").alias("support"))

    def wavg(m):
        return safe_ratio(F.col(f"c0.{m}") * F.col("c0.support") + F.col(f"c1.{m}")
                          * F.col("c1.support"), F.col("tot"))

    weighted = F.struct(F.lit("weighted avg").alias("class"), wavg("precision").alias("precision"),
                        wavg("recall").alias("recall"), wavg("f1").alias("f1"),
                        F.col("tot").cast("long").alias("support"))
    accuracy = F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                        F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"),
                        F.col("tot").cast("long").alias("support"))
    return rows.select(*by, F.inline(F.array("c0", "c1", accuracy, macro, weighted)))


def binary_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, F1 of each class, Matthews correlation (0 when undefined)."""
    c = _cells(df, label, pred, by)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(*by, safe_ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
                    safe_ratio(2 * tn, 2 * tn + fp + fn).alias("f1_stable"),
                    safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1_unstable"),
                    F.when(den == 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / den).alias("mcc"))


def calibration_curve(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Quantile bins (edges = score quantiles at 1/bins … (bins−1)/bins);
    bin = number of inner edges strictly below the score; empty bins vanish."""
    probs = [i / bins for i in range(1, bins)]
    q = exact_quantiles(df, [score], probs)
    edges = q.select(*[F.col(qname(p)).alias(f"_e{i}") for i, p in enumerate(probs)])
    x = attach_row(df.select(label, score), edges)
    b = sum((F.col(score) > F.col(f"_e{i}")).cast("int") for i in range(len(probs)))
    return x.groupBy(b.alias("bin")).agg(
        F.avg(F.col(score)).alias("mean_predicted_probability"),
        F.avg(F.col(label).cast("double")).alias("fraction_of_positives"),
        F.count(F.lit(1)).alias("n"))


def cluster_names(df: DataFrame, cluster: str, label: str, names: Sequence[str]) -> DataFrame:
    """A11 + F12: fault rate per cluster, ascending, named by rank (names past
    the list → 'unknown'). The per-cluster table has k rows."""
    rates = df.groupBy(cluster).agg(F.avg(F.col(label).cast("double")).alias("fault_rate"))
    rank = F.row_number().over(Window.orderBy("fault_rate", cluster))  # k rows
    arr = F.array(*[F.lit(n) for n in names])
    return rates.withColumn("rank", rank).withColumn(
        "name", F.coalesce(F.try_element_at(arr, F.col("rank")), F.lit("unknown")))


def summarize(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample std of each metric per group (``<m>_mean``, ``<m>_std``)."""
    return df.groupBy(*by).agg(*[F.avg(m).alias(f"{m}_mean") for m in metrics],
                               *[F.stddev_samp(m).alias(f"{m}_std") for m in metrics])


def cumulative_share(imp: DataFrame, feature: str = "feature", value: str = "importance",
                     cutoff: float = 0.95) -> DataFrame:
    """W8 + M17 + T3: importances (negatives clipped to 0) sorted descending with
    rank, cumulative share, and ``selected``: every row with share ≤ cutoff plus
    the one that crosses it, at least two rows when none qualifies (the
    reference's mask+append rule). One row per feature: a bounded table."""
    clipped = imp.select(feature, F.greatest(F.col(value), F.lit(0.0)).alias(value))
    w = Window.orderBy(F.desc(value), feature)
    ranked = clipped.withColumn("rank", F.row_number().over(w))
    total = F.sum(value).over(Window.partitionBy())
    cum = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    share = ranked.withColumn("cum_importance", cum / (total + F.lit(1e-12)))
    k = F.count_if(F.col("cum_importance") <= F.lit(cutoff)).over(Window.partitionBy())
    return share.withColumn("selected", F.col("rank") <= F.greatest(k, F.lit(1)) + 1)

