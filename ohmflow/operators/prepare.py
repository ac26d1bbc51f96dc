"""Dataset preparation D1–D7: deterministic stratified splits, k-fold ids,
expanding time-series folds, standard and min-max scaling fit on train.

Randomness is a hash: u = md5(id|seed) as a uniform in [0,1), so any engine
can repeat a split. The exact stratified form ranks rows inside each class
with ``with_ordinal`` (a range exchange over (class, u)), never a window with
one task per class — a class can hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import hash_uniform
from .common import attach_row
from .sequence import with_ordinal

SEED = 42


def with_uniform(df: DataFrame, id_col: str, seed: int = SEED, name: str = "_u") -> DataFrame:
    return df.withColumn(name, hash_uniform(F.col(id_col), F.lit(seed)))


def class_rank(df: DataFrame, label: str, id_col: str, seed: int = SEED,
               num_partitions: int | None = None) -> DataFrame:
    """Adds ``_u``, ``_rank`` (0-based position inside the class by (u, id)) and
    ``_n`` (class size). Class sizes come from a partial aggregate (a few rows) and are
    broadcast: a shuffle by label would put each class in one task."""
    u = with_uniform(df, id_col, seed)
    o = with_ordinal(u, [label, "_u", id_col], "_ord", num_partitions)
    sizes = o.groupBy(label).agg(F.min("_ord").alias("_start"), F.count(F.lit(1)).alias("_n"))
    return (o.join(F.broadcast(sizes), label)
            .withColumn("_rank", F.col("_ord") - F.col("_start"))
            .drop("_ord", "_start"))


def stratified_split(df: DataFrame, label: str, id_col: str, test: float = 0.15,
                     val: float = 0.1765, seed: int = SEED, exact: bool = True,
                     num_partitions: int | None = None) -> DataFrame:
    """``split`` ∈ {train, val, test}: ``test`` of each class first, then
    ``val`` of the remainder (the reference's two-step 70/15/15). ``val=0``
    gives a two-way split. ``exact=False`` thresholds the hash (no shuffle).
    ``num_partitions``: of the exchange that ranks the rows."""
    if not exact:
        u = hash_uniform(F.col(id_col), F.lit(seed))
        cut_val = test + (1 - test) * val
        return df.withColumn("split", F.when(u < test, "test")
                             .when(u < cut_val, "val").otherwise("train"))
    r = class_rank(df, label, id_col, seed, num_partitions)
    n_test = F.round(F.col("_n") * F.lit(test), 0)
    n_val = F.round((F.col("_n") - n_test) * F.lit(val), 0)
    split = (F.when(F.col("_rank") < n_test, F.lit("test"))
             .when(F.col("_rank") < n_test + n_val, F.lit("val")).otherwise(F.lit("train")))
    return r.withColumn("split", split).drop("_u", "_rank", "_n")


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = 5,
                     seed: int = SEED, num_partitions: int | None = None) -> DataFrame:
    """D3: ``fold`` = (rank inside class by hash) mod k: class shares equal per fold."""
    r = class_rank(df, label, id_col, seed, num_partitions)
    return r.withColumn("fold", F.pmod(F.col("_rank"), F.lit(k)).cast("int")) \
        .drop("_u", "_rank", "_n")


def time_series_folds(df: DataFrame, order_by: Sequence[str], k: int = 5) -> DataFrame:
    """Expanding-window folds. With n rows and t = ⌊n/(k+1)⌋, fold i tests
    positions [n−(k−i)t, n−(k−i−1)t) and trains on every earlier position.
    Adds ``position``, ``test_fold`` (null if never tested) and
    ``first_train_fold`` (the first fold whose training set holds the row)."""
    o = with_ordinal(df, list(order_by), "position")
    n = o.agg(F.count(F.lit(1)).alias("_n"))
    t = F.floor(F.col("_n") / F.lit(k + 1))
    start0 = F.col("_n") - F.lit(k) * t
    test_fold = F.when(F.col("position") >= start0,
                       F.floor((F.col("position") - start0) / t))
    # fold i trains on positions < start0 + i*t  ->  first i with start0+i*t > pos
    first_train = F.greatest(F.lit(0), F.floor((F.col("position") - start0) / t) + 1)
    return (attach_row(o, n)
            .withColumn("test_fold", test_fold.cast("int"))
            .withColumn("first_train_fold",
                        F.when(first_train < k, first_train.cast("int")))
            .drop("_n"))


def fit_standard(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D5 fit: ``feature, center, scale`` with population std; zero std → 1."""
    agg = df.agg(*[F.avg(c).alias(f"{c}__m") for c in cols],
                 *[F.stddev_pop(c).alias(f"{c}__s") for c in cols])
    return _params(agg, cols, lambda c: F.col(f"{c}__m"),
                   lambda c: F.when(F.col(f"{c}__s") == 0, F.lit(1.0)).otherwise(F.col(f"{c}__s")))


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D6 fit: center = min, scale = max − min; constant column → scale 1 (x → 0)."""
    agg = df.agg(*[F.min(c).alias(f"{c}__m") for c in cols],
                 *[F.max(c).alias(f"{c}__s") for c in cols])
    rng = lambda c: F.col(f"{c}__s") - F.col(f"{c}__m")
    return _params(agg, cols, lambda c: F.col(f"{c}__m"),
                   lambda c: F.when(rng(c) == 0, F.lit(1.0)).otherwise(rng(c)))


def _params(agg: DataFrame, cols, center, scale) -> DataFrame:
    rows = [F.struct(F.lit(c).alias("feature"), center(c).alias("center"),
                     scale(c).alias("scale")) for c in cols]
    return agg.select(F.inline(F.array(*rows)))


def apply_scaler(df: DataFrame, params: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x − center) / scale with a stored parameter table (one row per
    feature, broadcast as a single row of two arrays)."""
    cols = list(cols)
    wide = params.groupBy().pivot("feature", cols).agg(
        F.first("center").alias("c"), F.first("scale").alias("s"))
    wide = wide.select(F.array(*[F.col(f"{c}_c") for c in cols]).alias("_centers"),
                       F.array(*[F.col(f"{c}_s") for c in cols]).alias("_scales"))
    at = {c: F.lit(i) for i, c in enumerate(cols)}
    out = attach_row(df, wide)
    return out.select(*[((F.col(c) - F.get("_centers", at[c])) / F.get("_scales", at[c])).alias(c)
                        if c in at else F.col(c) for c in df.columns])
