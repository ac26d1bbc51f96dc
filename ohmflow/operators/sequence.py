"""Global row positions for ordered data, without a single-partition window.

``with_ordinal`` range-partitions by the order key, checkpoints the sorted
partitions, numbers rows inside each partition with
``monotonically_increasing_id`` (partition index in the high bits) and adds
the row counts of all earlier partitions (P numbers, P = number of range
partitions: the session's, or ``tasks_for`` the rows where the caller counts them). Rows must be totally ordered by
``keys`` (add tie columns) so a recomputed partition gets the same numbers;
with ties the numbering among equal keys is arbitrary but still a
permutation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_LOCAL_BITS = 33
#: rows of a table that one task of its exchanges takes
ROWS_PER_TASK = 500_000


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions for an exchange of ``rows`` rows: the session's number, more when a
    partition would exceed ``ROWS_PER_TASK``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))


def with_ordinal(df: DataFrame, keys: Sequence[str | Column], name: str = "_ord",
                 num_partitions: int | None = None) -> DataFrame:
    """Add ``name``: 0-based position of each row in the total order ``keys``."""
    return with_ordinal_count(df, keys, name, num_partitions)[0]


def with_ordinal_count(df: DataFrame, keys: Sequence[str | Column], name: str = "_ord",
                       num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """``with_ordinal`` plus the total row count (known from the partition counts)."""
    n = _partitions(df, num_partitions)
    ensure_checkpoint_dir(df.sparkSession)
    # The range-partitioned, sorted rows are checkpointed to the shared
    # checkpoint folder: this pins one partitioning (range bounds are sampled,
    # and a re-planned exchange over shuffled input may sample differently),
    # cuts the lineage, and survives executor loss.
    fixed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).checkpoint(eager=True)
    # P row counts (P = partitions, a configuration bound) -> prefix offsets.
    counts = dict(fixed.groupBy(F.spark_partition_id().alias("p")).count().collect())
    offsets, run = [], 0
    for p in range(fixed.rdd.getNumPartitions()):
        offsets.append(run)
        run += counts.get(p, 0)
    mid = F.monotonically_increasing_id()
    off = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]),
                       (F.shiftright(mid, _LOCAL_BITS) + 1).cast("int"))
    return fixed.withColumn(name, off + mid.bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))), run


def with_blocks(df: DataFrame, ord_col: str, block_rows: int, back: int, ahead: int,
                block: str = "_blk", role: str = "_halo") -> DataFrame:
    """Cut the ordered rows into blocks of ``block_rows`` and copy the last
    ``back`` rows of each block into the next and the first ``ahead`` rows into
    the previous one. ``role``: 0 own row, 1 look-back copy, 2 look-ahead copy.
    """
    if block_rows <= max(back, ahead):
        raise ValueError("block_rows must exceed the halo widths")
    blk = F.floor(F.col(ord_col) / F.lit(block_rows))
    pos = F.pmod(F.col(ord_col), F.lit(block_rows))

    def copy(b, r):
        return F.struct(b.cast("long").alias("b"), F.lit(r).alias("r"))
    # one pass over the rows: each row yields itself and, near a block edge,
    # its copies for the neighbouring block (no union of three scans)
    copies = [copy(blk, 0)]
    if back > 0:
        copies.append(F.when(pos >= F.lit(block_rows - back), copy(blk + 1, 1)))
    if ahead > 0:
        copies.append(F.when((pos < F.lit(ahead)) & (blk > 0), copy(blk - 1, 2)))
    return (df.withColumn("_cp", F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull())))
            .withColumn(block, F.col("_cp.b")).withColumn(role, F.col("_cp.r")).drop("_cp"))


def cumulative_sums(df: DataFrame, group: Sequence[str], order: Sequence[str],
                    values: Sequence[str], prefix: str = "cum_",
                    num_partitions: int | None = None) -> DataFrame:
    """Running totals of ``values`` inside each ``group`` in ``order`` (inclusive),
    without one task per group: range-partition by (group, order) and
    checkpoint; per (partition, group) totals — at most P + G rows — give the
    offsets; the running sum inside a partition is a window per (partition,
    group), bounded by the partition size. ``order`` must be unique in a group
    (pre-aggregate ties)."""
    group, order = list(group), list(order)
    n = _partitions(df, num_partitions)
    ensure_checkpoint_dir(df.sparkSession)
    keys = group + order
    fixed = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
             .withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True))
    tot = fixed.groupBy("_pid", *group).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = (Window.partitionBy(*group).orderBy("_pid")
              .rowsBetween(Window.unboundedPreceding, -1))
    offs = tot.select("_pid", *group, *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0))
                                        .alias(f"_o_{v}") for v in values])
    inside = (Window.partitionBy("_pid", *group).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # null-safe group keys: a null group keeps its offsets
    offs = offs.select(*[F.col(c).alias(f"_g_{c}") for c in ["_pid", *group]],
                       *[f"_o_{v}" for v in values])
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in ["_pid", *group]]
    joined = fixed.join(offs, same, "left")
    return joined.select(
        *[c for c in df.columns],
        *[(F.coalesce(F.col(f"_o_{v}"), F.lit(0)) + F.sum(v).over(inside)).alias(f"{prefix}{v}")
          for v in values])
