"""Live monitor on Structured Streaming.

ST1 ``score_stream``: stateless z-score / status of every arriving reading
(stream–static join with a one-row baseline, broadcast).
ST2 ``sticky_alerts``: per series, every breach (|z| ≥ 1.5) raises an alert
that stays 10 s; a later breach restarts the timer; the "clear" is the end of an
event-time session window, emitted once the watermark passes. Rows older than the watermark are dropped (a rule the
replay UI did not need).
ST3 ``window_stats``: sliding event-time windows per series with a watermark.

``history_stream`` adds the last 60 values of the series to every reading (W10).

``run_available`` drives a stream to completion (trigger availableNow) into a
parquet sink under the shared checkpoint folder and returns the written table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalar import status_of
from ..operators.common import attach_row, rounded
from ..schema import STATUS_ELEVATED_AT, STICKY_ALERT_SECONDS
from ..session import ensure_checkpoint_dir

WATERMARK = "1 minute"


def table_stream(spark: SparkSession, sf_dir: str, table: str = "events",
                 files_per_trigger: int = 1) -> DataFrame:
    """File-stream source over one driver table (new files = new readings)."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
            .option("maxFilesPerTrigger", files_per_trigger).parquet(sf_dir))


def score_stream(stream: DataFrame, baseline: DataFrame, value: str = "value") -> DataFrame:
    """ST1: z-score against a one-row baseline (``mean``, ``std``) and status."""
    z = (F.col(value) - F.col("_mean")) / F.col("_std")
    return (attach_row(stream, baseline.select(F.col("mean").alias("_mean"),
                                               F.col("std").alias("_std")))
            .withColumn("z", z).withColumn("status", status_of(F.abs(F.col("z"))))
            .withColumn("ts", F.col("ts").cast("timestamp"))
            .drop("_mean", "_std"))


def sticky_alerts(scored: DataFrame, seconds: int = STICKY_ALERT_SECONDS,
                  delay: str = WATERMARK) -> DataFrame:
    """ST2: raise/clear alert events per user. Raises are a stateless filter; a
    clear is the end of a session of breaches, with the message of the latest."""
    z = rounded(F.col("z"), 2) + F.lit(0.0)
    # quiet readings move the watermark too: the predicate names ts, so that it
    # is not pushed below the watermark
    breach = F.when(F.col("ts").isNotNull(), F.abs("z") >= F.lit(STATUS_ELEVATED_AT))
    breaches = scored.withWatermark("ts", delay).where(breach).select(
        "user_id", "event_id", "ts", F.format_string(
            "Reading is %s (%.2fσ)", F.when(F.col("z") > 0, "too high").otherwise("too low"), z)
        .alias("message"))
    raises = breaches.select("user_id", "ts", F.lit("raise").alias("kind"), "message")
    clears = (breaches.groupBy("user_id", F.session_window("ts", f"{seconds} seconds").alias("w"))
              .agg(F.max_by("message", F.struct("ts", "event_id")).alias("message"))
              .select("user_id", F.col("w.end").alias("ts"), F.lit("clear").alias("kind"), "message"))
    return raises.unionByName(clears)


def window_stats(scored: DataFrame, length: str = "1 hour", slide: str = "10 minutes",
                 delay: str = WATERMARK) -> DataFrame:
    """ST3: per user and sliding window: readings, mean value, peak |z|."""
    return (scored.withWatermark("ts", delay)
            .groupBy(F.window("ts", length, slide), "user_id")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"),
                 F.max(F.abs("z")).alias("max_abs_z"))
            .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("window.end").cast("timestamp_ntz").alias("window_end"), "user_id", "n",
                    "mean_value",
                    "max_abs_z"))


def history_stream(scored: DataFrame, series: str = "user_id", row_id: str = "event_id",
                   values: Sequence[str] = ("value", "z"), rows: int = 60,
                   delay: str = WATERMARK) -> DataFrame:
    """ST3 + W10: every reading with the trailing ``rows`` values of its series (the
    reading included) as an array ``<value>_history`` per column of ``values``.

    Readings wait in the state of their series until the watermark has passed them,
    so the histories are those of event-time order (ties by ``row_id``) however the
    readings were spread over batches; a reading that comes later than ``delay``
    is dropped. A null or NaN value is null in the histories. The state holds the last ``rows - 1`` values and what waits: the
    readings of ``delay``. A reading still waiting when the stream ends is not
    emitted. One series is one task per batch; batches bound its rows."""
    kept, keys = rows - 1, [f"{v}_history" for v in values]
    state_schema = ", ".join(f"{part}_{c} array<{kind}>" for part in ("wait", "last") for c, kind in
                             [("ts", "long"), ("id", "long"), *((f"v{k}", "double") for k in range(len(values)))]
                             if part == "wait" or c.startswith("v"))

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        width = len(values)
        held = [list(x) for x in state.get] if state.exists else [[] for _ in range(2 + 2 * width)]
        waiting, last = list(zip(*held[:2 + width])), held[2 + width:]
        if not state.hasTimedOut:
            for pdf in frames:
                waiting += zip(pdf["_us"], pdf[row_id], *([None if x != x else x for x in pdf[v].tolist()]
                                                          for v in values))
        # a row is ready once its millisecond lies before the watermark
        mark = state.getCurrentWatermarkMs()
        waiting.sort(key=lambda r: r[:2])
        n = sum(-(-r[0] // 1000) < mark for r in waiting)
        out = []
        for us, rid, *now in waiting[:n]:
            full = [(old + [x])[-rows:] for old, x in zip(last, now)]
            out.append((key[0], int(rid), us, *full))
            last = [h[-kept:] if kept else [] for h in full]
        waiting = waiting[n:]
        state.update((*([r[c] if c > 1 else int(r[c]) for r in waiting] for c in range(2 + width)), *last))
        if waiting:
            state.setTimeoutTimestamp(max(-(-waiting[0][0] // 1000), mark))
        yield pd.DataFrame(out, columns=[series, row_id, "_us", *keys])

    kinds = {f.name: f.dataType.simpleString() for f in scored.schema.fields}
    timed = (scored.withWatermark("ts", delay).where(F.col("ts").isNotNull())
             .select(series, row_id, "ts", F.unix_micros("ts").alias("_us"),
                     *[F.col(v).cast("double").alias(v) for v in values]))
    done = timed.groupBy(series).applyInPandasWithState(
        update, f"{series} {kinds[series]}, {row_id} {kinds[row_id]}, _us long, "
                + ", ".join(f"{k} array<double>" for k in keys),
        state_schema, "append", GroupStateTimeout.EventTimeTimeout)
    return done.select(series, row_id, F.timestamp_micros("_us").alias("ts"), *keys)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run to completion (availableNow) into parquet under the checkpoint
    folder; return the sink contents as a batch table."""
    spark = stream.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    base = f"{root}/streams/{name}-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{base}/_checkpoint").option("path", f"{base}/data")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/data")

