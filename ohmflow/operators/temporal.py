"""Temporal features W1–W7 (rolling mean/std/min/max, rate of change, back-filled
lags), plus W10 history, W12 downsampling and T7 head.

Semantics (pandas ``rolling(w, min_periods=1)`` over rows in order):
 * frames count rows and include the current row; std of one row is 0 (S6);
 * ``roc`` = x − previous x, first row 0;
 * ``lag k`` = x k rows back; the first k rows take the series' first value,
   and a series of ≤ k rows keeps each row's own value (S7, S8).

Execution: ``mode="halo"`` (default) never puts a whole series in one task:
rows get a global ordinal (``sequence.with_ordinal``), are cut into blocks of
``block_rows`` (default: adaptive to the row count and cores) with a 19-row
look-back and 3-row look-ahead copy, and every window runs per (series key,
block). One range exchange + one hash exchange,
independent of how skewed the series keys are. Columns of doubles are computed
per block by numpy, all frames of a column set step by step (a window operator
with 140 frame expressions re-evaluates each frame row by row). ``mode="plain"`` is the
ordinary ``partitionBy(series)`` window (one task per series).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..schema import LAG_FEATURES, LAGS, ROLL_WINDOWS, ROLLING_FEATURES
from .common import attach_row
from .sequence import with_blocks, with_ordinal, with_ordinal_count

MAX_BLOCK_ROWS = 1 << 20
ARRAY_BLOCK_ROWS = 1 << 13      # rows that one task holds as arrays of all features
MIN_BLOCK_ROWS = 2048
BLOCKS_PER_CORE = 4


def adaptive_block_rows(n: int, parallelism: int) -> int:
    """Enough blocks to keep every core busy (4 per core), each at least 2048
    rows (halo copies stay ~1 %) and at most 1M rows (bounded task memory)."""
    want = -(-n // max(parallelism * BLOCKS_PER_CORE, 1))
    return int(min(MAX_BLOCK_ROWS, max(MIN_BLOCK_ROWS, want)))


def feature_names(rolling: Sequence[str], lag_cols: Sequence[str],
                  windows: Sequence[int] = ROLL_WINDOWS, lags: Sequence[int] = LAGS,
                  rate: bool = True) -> list[str]:
    names = []
    for c in rolling:
        for w in windows:
            names += [f"roll_mean_{c}_w{w}", f"roll_std_{c}_w{w}",
                      f"roll_min_{c}_w{w}", f"roll_max_{c}_w{w}"]
    if rate:
        names += [f"roc_{c}" for c in rolling]
    for c in lag_cols:
        names += [f"lag{k}_{c}" for k in lags]
    return names


def _exprs(win, rolling, lag_cols, windows, lags, rate, rn: Column,
           short: dict[int, Column]) -> list[Column]:
    out = []
    for c in rolling:
        x = F.col(c)
        for w in windows:
            fr = win.rowsBetween(-(w - 1), 0)
            out += [F.avg(x).over(fr).alias(f"roll_mean_{c}_w{w}"),
                    F.coalesce(F.stddev_samp(x).over(fr), F.lit(0.0)).alias(f"roll_std_{c}_w{w}"),
                    F.min(x).over(fr).alias(f"roll_min_{c}_w{w}"),
                    F.max(x).over(fr).alias(f"roll_max_{c}_w{w}")]
    if rate:
        for c in rolling:
            out.append(F.coalesce(F.col(c) - F.lag(c, 1).over(win), F.lit(0.0))
                       .alias(f"roc_{c}"))
    head = win.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in lag_cols:
        x = F.col(c)
        first = F.first(x).over(head)
        for k in lags:
            out.append(F.when(rn <= k, F.when(short[k], x).otherwise(first))
                       .otherwise(F.lag(x, k).over(win)).alias(f"lag{k}_{c}"))
    return out


def temporal_features(df: DataFrame, order_by: Sequence[str],
                      partition_by: Sequence[str] = (),
                      rolling: Sequence[str] = ROLLING_FEATURES,
                      lag_cols: Sequence[str] = LAG_FEATURES,
                      windows: Sequence[int] = ROLL_WINDOWS, lags: Sequence[int] = LAGS,
                      rate: bool = True, mode: str = "halo",
                      block_rows: int | None = None) -> DataFrame:
    """All temporal features in one pass; ``order_by`` must be unique
    within ``partition_by`` (add tie columns)."""
    keys = list(partition_by)
    max_lag = max(lags) if lag_cols else 0
    if mode == "plain":
        win = Window.partitionBy(*keys).orderBy(*order_by)
        rn = F.row_number().over(win)
        cnt = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        short = {k: cnt <= k for k in lags}
        return df.select("*", *_exprs(win, rolling, lag_cols, windows, lags, rate, rn, short))
    if mode != "halo":
        raise ValueError(f"unknown mode {mode!r}")
    back = max(max(windows, default=1) - 1 if rolling else 0, max_lag, 1)

    def build(win, rn):
        # A series with <= k rows: for its r-th row, no row sits k+1-r places
        # later. Such rows are near the series start; the look-ahead copy keeps
        # the rows that follow them visible even at a block end.
        short = {}
        for k in lags:
            cond = F.lit(False)
            for r in range(1, k + 1):
                cond = F.when(rn == r, F.lead("_ord", k + 1 - r).over(win).isNull()).otherwise(cond)
            short[k] = cond
        return _exprs(win, rolling, lag_cols, windows, lags, rate, rn, short)
    kinds = dict(df.dtypes)
    if any(kinds[c] != "double" for c in [*rolling, *lag_cols]):
        return blocked_window(df, order_by, keys, back, max_lag, build, block_rows)
    o, n = with_ordinal_count(df, keys + list(order_by), "_ord")
    if block_rows is None:
        block_rows = min(ARRAY_BLOCK_ROWS,
                         adaptive_block_rows(n, df.sparkSession.sparkContext.defaultParallelism))
    names = feature_names(rolling, lag_cols, windows, lags, rate)
    schema = StructType(df.schema.fields + [StructField(c, DoubleType()) for c in names])
    return with_blocks(o, "_ord", block_rows, back, max_lag).groupBy("_blk").applyInArrow(
        _block_features(df.columns, keys, rolling, lag_cols, windows, lags, rate), schema)


def _series_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """For each row the position of the first row of its series (runs of equal keys)."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        codes = pc.dictionary_encode(table[k], null_encoding="encode").combine_chunks().indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(n), 0))


def _frame_stats(x: np.ndarray, ok: np.ndarray, first: np.ndarray, w: int):
    """Mean, deviation, minimum and maximum (columns x rows) of the frame of ``w`` rows up
    to each row, without nulls and what lies before ``first``; and the number of
    values. Values are added from the oldest on, as a window aggregate does."""
    width, rows = x.shape
    n, total, avg, m2 = (np.zeros((width, rows)) for _ in range(4))
    low, high = np.full((width, rows), np.nan), np.full((width, rows), np.nan)
    at = np.arange(rows)
    for back in range(min(w, rows) - 1, -1, -1):
        s = slice(back, rows)                   # rows that have a row so far back
        v, use = x[:, :rows - back], ok[:, :rows - back] & (at[s] - back >= first[s])
        count = n[:, s] + 1.0
        delta = v - avg[:, s]
        share = delta / count
        total[:, s] = np.where(use, total[:, s] + v, total[:, s])
        m2[:, s] = np.where(use, m2[:, s] + delta * (delta - share), m2[:, s])
        avg[:, s] = np.where(use, avg[:, s] + share, avg[:, s])
        fresh = n[:, s] == 0
        # NaN counts as the largest value
        low[:, s] = np.where(use & (fresh | (v < low[:, s]) | np.isnan(low[:, s])), v, low[:, s])
        high[:, s] = np.where(use & (fresh | (v > high[:, s]) | np.isnan(v)), v, high[:, s])
        n[:, s] = np.where(use, count, n[:, s])
    std = np.where(n > 1, np.sqrt(m2 / np.maximum(n - 1.0, 1.0)), 0.0)
    return total / np.maximum(n, 1.0), std, low, high, n


def _block_features(columns, keys, rolling, lag_cols, windows, lags, rate):
    """All features of one block: rows in, own rows with the features out."""
    def matrix(table, names):
        cols = [table[c].combine_chunks() for c in names]
        ok = np.array([c.is_valid().to_numpy(zero_copy_only=False) for c in cols])
        x = np.array([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in cols])
        return x.reshape(len(names), table.num_rows), ok.reshape(len(names), table.num_rows)

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("_ord")
        rows, at = table.num_rows, np.arange(table.num_rows)
        own = table["_halo"].to_numpy() == 0
        first = _series_starts(table, keys)
        last = np.append(np.nonzero(first[1:] != first[:-1])[0], rows - 1)
        size = np.repeat(last, np.diff(np.append(-1, last))) - first + 1
        out = {}

        def put(name, values, ok=None):
            out[name] = pa.array(values[own], mask=None if ok is None else ~ok[own])
        with np.errstate(all="ignore"):
            if rolling:
                x, ok = matrix(table, rolling)
                for w in windows:
                    mean, std, low, high, n = _frame_stats(x, ok, first, w)
                    for i, c in enumerate(rolling):
                        some = n[i] > 0
                        put(f"roll_mean_{c}_w{w}", mean[i], some)
                        put(f"roll_std_{c}_w{w}", std[i])
                        put(f"roll_min_{c}_w{w}", low[i], some)
                        put(f"roll_max_{c}_w{w}", high[i], some)
                if rate:
                    before = np.maximum(at - 1, 0)
                    both = ok & ok[:, before] & (at > first)
                    for i, c in enumerate(rolling):
                        put(f"roc_{c}", np.where(both[i], x[i] - x[i][before], 0.0))
            if lag_cols:
                x, ok = matrix(table, lag_cols)
                for k in lags:
                    early = at - first < k          # takes its own value in a short series, else the first
                    source = np.where(early, np.where(size <= k, at, first), np.maximum(at - k, 0))
                    for i, c in enumerate(lag_cols):
                        put(f"lag{k}_{c}", x[i][source], ok[i][source])
        mine = table.filter(pa.array(own)).select(columns)
        names = feature_names(rolling, lag_cols, windows, lags, rate)
        return pa.table([*mine.columns, *[out[c] for c in names]], names=[*columns, *names])
    return build


def blocked_window(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str],
                   back: int, ahead: int, build, block_rows: int | None = None) -> DataFrame:
    """Run row-frame window expressions per (series key, block) instead of per
    series. ``build(win, rn)`` returns the expressions over ``win`` (ordered by
    the global ordinal ``_ord``); frames may look ``back`` rows behind and
    ``ahead`` rows ahead. ``rn`` (row number in the block partition) equals the
    position in the series whenever it is ≤ ``back``."""
    keys = list(partition_by)
    o, n = with_ordinal_count(df, keys + list(order_by), "_ord")
    if block_rows is None:
        block_rows = adaptive_block_rows(n, df.sparkSession.sparkContext.defaultParallelism)
    b = with_blocks(o, "_ord", block_rows, back, ahead)
    win = Window.partitionBy(*keys, "_blk").orderBy("_ord")
    rn = F.row_number().over(win)
    return (b.select("*", *build(win, rn)).where(F.col("_halo") == 0)
            .drop("_ord", "_blk", "_halo"))


def downsample_every(df: DataFrame, order_by: Sequence[str], target_points: int = 90,
                     row_col: str = "row") -> DataFrame:
    """Keep every n-th row (n = ceil(N/target)) plus the last row; ``row`` is
    the 1-based position. Positions come from ``with_ordinal`` (no single task)."""
    o = with_ordinal(df, list(order_by), "_ord")
    total = o.agg(F.count(F.lit(1)).alias("_n"))
    every = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(float(target_points))))
    return (attach_row(o, total)
            .where((F.pmod(F.col("_ord"), every) == 0) | (F.col("_ord") == F.col("_n") - 1))
            .withColumn(row_col, F.col("_ord") + 1)
            .drop("_ord", "_n"))


def first_rows(df: DataFrame, order_by: Sequence[str], n: int = 200) -> DataFrame:
    """The first ``n`` rows in order (top-k sort; no global sort of all rows)."""
    return df.orderBy(*order_by).limit(n)


def recent_history(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str],
                   value_col: str, rows: int = 60) -> DataFrame:
    """For each row, the trailing ``rows`` values of its series as an array
    (at most ``rows`` elements per row), computed per (series, block)."""
    def build(win, rn):
        fr = win.rowsBetween(-(rows - 1), Window.currentRow)
        return [F.collect_list(F.col(value_col)).over(fr).alias("history")]
    return blocked_window(df, order_by, partition_by, rows - 1, 0, build)
