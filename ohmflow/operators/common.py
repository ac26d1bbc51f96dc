"""Small shared plan pieces."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row table (a global aggregate) to every row.

    The right side is an aggregate without grouping keys, so it has exactly
    one row: broadcasting it is size-safe. Catalyst folds the constant key, so
    the plan is a broadcast nested-loop join against that single row — a
    map-side attach, no shuffle of ``df``. (A scalar subquery per column would
    re-run the aggregate once per column.)
    """
    return (df.withColumn("_one", F.lit(1))
            .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one")
            .drop("_one"))


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str],
            var: str = "feature", value: str = "value") -> DataFrame:
    """Wide -> long (one output row per id row and column)."""
    return df.unpivot(list(ids), list(cols), var, value)


def rounded(c: Column, digits: int) -> Column:
    """Round half away from zero on the binary value: ``round(x·10^d)/10^d``.

    Spelled out so any SQL engine computing ``round(x * 1e6) / 1e6`` gets the
    bit-identical double (``round(x, d)`` on decimal text differs at ties)."""
    scale = float(10 ** digits)
    scaled = c * F.lit(scale)
    near = F.rint(scaled)       # ties to even, put right below; F.round goes through decimal text
    away = F.when(F.abs(scaled - near) == F.lit(0.5), scaled + F.signum(scaled) * F.lit(0.5)).otherwise(near)
    return (away + F.lit(0.0)) / F.lit(scale)      # + 0.0: no negative zero


def round_cols(df: DataFrame, digits: int, cols: Sequence[str] | None = None) -> DataFrame:
    """Round double columns (all by default) for stable comparisons and display."""
    cols = set(cols) if cols is not None else {
        f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[rounded(F.col(c), digits).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def feature_index(features: Sequence[str], col: Column) -> Column:
    """0-based ordinal of a feature name in a fixed list (tie keys for sorts)."""
    return F.array_position(F.array(*[F.lit(f) for f in features]), col) - F.lit(1)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder (``spark.checkpoint.dir``)
    and continue from the written copy: iterative learners then re-read it
    instead of recomputing the lineage, and a lost executor costs a re-read."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_columns(df: DataFrame) -> DataFrame:
    """Like ``materialize`` for wide tables: written as Parquet below the shared folder, so
    columns are compressed and a reader takes only those it needs. The copy stays until
    the folder is cleaned."""
    from ..session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/columns/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
