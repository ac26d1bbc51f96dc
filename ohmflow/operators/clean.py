"""Cleaning: P1–P13 (projection, null handling, labels, median imputation,
IQR capping). Statistics are computed in one distributed pass and applied
with a broadcast one-row join, never collected per feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..schema import IQR_FEATURES, RAW_FEATURES, TARGET
from .common import attach_row
from .stats import exact_quantiles, qname, quantiles_wide


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """P5: columns of numeric type."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def project_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (),
                     fill: float = 0.0) -> DataFrame:
    """Select a feature list; absent features become ``fill``."""
    have = set(df.columns)
    return df.select(*keep, *[F.col(f) if f in have else F.lit(fill).alias(f)
                              for f in features])


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    """IO3: raise naming the missing columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def encode_label(df: DataFrame, col: str = TARGET, positive: str = "unstable") -> DataFrame:
    """Two-value text label → 0/1 int."""
    return df.withColumn(col, (F.col(col) == F.lit(positive)).cast("int"))


def normalize_label(df: DataFrame, col: str, positive: str = "unstable",
                    negative: str = "stable") -> DataFrame:
    """P10: numeric labels become whole numbers as they are; text is trimmed,
    lower-cased and mapped to 1 or 0, other text to null (see ``invalid_labels``
    and ``require_known_labels``)."""
    if isinstance(df.schema[col].dataType, NumericType):
        return df.withColumn(col, F.col(col).cast("int"))
    txt = F.lower(F.trim(F.col(col).cast("string")))
    return df.withColumn(col, F.when(txt == positive, 1).when(txt == negative, 0))


def invalid_labels(df: DataFrame, col: str, positive: str = "unstable",
                   negative: str = "stable") -> DataFrame:
    """P10: the distinct labels (null included) that ``normalize_label`` cannot map."""
    txt = F.lower(F.trim(F.col(col).cast("string")))
    if isinstance(df.schema[col].dataType, NumericType):
        return df.where(F.col(col).isNull()).select(txt.alias("label")).distinct()
    return (df.where(~F.coalesce(txt.isin(positive, negative), F.lit(False)))
            .select(txt.alias("label")).distinct())


def require_known_labels(df: DataFrame, col: str, positive: str = "unstable",
                         negative: str = "stable", shown: int = 20) -> None:
    """P10: raise naming the unknown labels in order (the first ``shown`` of them)."""
    bad = invalid_labels(df, col, positive, negative).orderBy("label").limit(shown + 1).collect()
    if bad:
        more = " ..." if len(bad) > shown else ""
        raise ValueError(f"Unsupported target labels: {[r['label'] for r in bad[:shown]]}{more}")


def require_binary_target(df: DataFrame, col: str) -> None:
    """The target column exists and holds exactly two distinct values
    (nulls are not counted)."""
    if col not in df.columns:
        raise ValueError(f"Target column '{col}' not found")
    n = df.where(F.col(col).isNotNull()).select(col).distinct().count()
    if n != 2:
        raise ValueError(f"Target '{col}' must be binary, found {n} classes")


def drop_null_rows(df: DataFrame, cols: Sequence[str] = RAW_FEATURES) -> DataFrame:
    """Rows with a null in any of ``cols`` are dropped."""
    return df.na.drop(subset=list(cols))


def require_rows(df: DataFrame) -> DataFrame:
    """Raise when no row is left after dropping nulls; else ``df`` itself."""
    if df.isEmpty():
        raise ValueError("No valid rows left after dropping nulls")
    return df


def null_drop_summary(df: DataFrame, cols: Sequence[str] = RAW_FEATURES) -> DataFrame:
    """P6 counters in one pass: rows in, rows kept, rows dropped."""
    any_null = F.lit(False)
    for c in cols:
        any_null = any_null | F.col(c).isNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(~any_null).alias("n_kept"),
                  F.count_if(any_null).alias("n_dropped"))


def impute_median(df: DataFrame, cols: Sequence[str] | None = None,
                  fit_on: DataFrame | None = None) -> DataFrame:
    """Replace nulls by the column median (exact, interpolated), computed on
    ``fit_on`` (default: all rows, as the reference does — S1)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    med = quantiles_wide(fit_on if fit_on is not None else df, cols, 0.5)
    med = med.select(*[F.col(c).alias(f"_med_{c}") for c in cols])
    out = attach_row(df, med)
    return out.select(*[F.coalesce(F.col(c), F.col(f"_med_{c}")).alias(c) if c in cols
                        else F.col(c) for c in df.columns])


def iqr_bounds(df: DataFrame, cols: Sequence[str] = IQR_FEATURES, k: float = 3.0) -> DataFrame:
    """P13 statistics: ``feature, q1, q3, iqr, lower, upper`` (long, one row per feature)."""
    q = exact_quantiles(df, cols, [0.25, 0.75])
    q1, q3 = F.col(qname(0.25)), F.col(qname(0.75))
    return q.select("feature", q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"),
                    (q1 - F.lit(k) * (q3 - q1)).alias("lower"),
                    (q3 + F.lit(k) * (q3 - q1)).alias("upper"))


def cap_iqr(df: DataFrame, cols: Sequence[str] = IQR_FEATURES, k: float = 3.0,
            bounds: DataFrame | None = None) -> DataFrame:
    """Clip each column to [Q1 − k·IQR, Q3 + k·IQR]; keeps every row."""
    b = bounds if bounds is not None else iqr_bounds(df, cols, k)
    wide = b.groupBy().pivot("feature", list(cols)).agg(
        F.first("lower").alias("lo"), F.first("upper").alias("hi"))
    out = attach_row(df, wide)
    return out.select(*[F.greatest(F.least(F.col(c), F.col(f"{c}_hi")), F.col(f"{c}_lo"))
                        .alias(c) if c in cols else F.col(c) for c in df.columns])


def outlier_counts(df: DataFrame, cols: Sequence[str] = IQR_FEATURES, k: float = 3.0) -> DataFrame:
    """P13 report: bounds plus the number of values outside them, per feature."""
    b = iqr_bounds(df, cols, k)
    long = df.select(*cols).unpivot([], list(cols), "feature", "value")
    counted = (long.join(F.broadcast(b), "feature")  # one row per column
               .groupBy("feature").agg(F.count_if((F.col("value") < F.col("lower"))
                                                  | (F.col("value") > F.col("upper")))
                                       .alias("n_outliers")))
    return b.join(counted, "feature")


def clean_readings(df: DataFrame) -> DataFrame:
    """The reference's cleaning chain: impute numerics, cap p-columns (and the
    leak column), drop the leak column, encode the label."""
    num = numeric_columns(df, exclude=("seq",))
    imputed = impute_median(df, num)
    cap = [c for c in num if c.startswith("p")] + (["stab"] if "stab" in df.columns else [])
    capped = cap_iqr(imputed, cap)
    return encode_label(capped.drop("stab"))
