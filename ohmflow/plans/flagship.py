"""Flagship query: clean the event readings, add per-user
rolling context, z-score three "sensors" against the non-error baseline,
derive the node status and keep the Critical readings, worst first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import status_of
from ..operators import clean, temporal
from ..operators.baseline import baseline_stats, with_zscores
from ..operators.common import round_cols
from ..sources.tables import table
from .sqlgen import r6

SENSORS = ["value", "roll_mean_value_w5", "lag1_value"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    ev = clean.cap_iqr(clean.impute_median(ev, ["value"]), ["value"])
    feats = temporal.temporal_features(ev, ["ts", "event_id"], ["user_id"], rolling=["value"],
                                       lag_cols=["value"], windows=[5], lags=[1], rate=False)
    feats = feats.withColumn("is_error", F.col("event_type") == "error")
    base = baseline_stats(feats, SENSORS, label="is_error", stable_value=False,
                          quartiles=False)
    z = with_zscores(feats, base, SENSORS)
    mx = F.greatest(*[F.abs(F.col(f"z_{c}")) for c in SENSORS])
    out = (z.select("event_id", "user_id", "event_type", *SENSORS,
                    *[f"z_{c}" for c in SENSORS], mx.alias("max_abs_z"))
           .withColumn("status", status_of(F.col("max_abs_z")))
           .where(F.col("status") == "Critical"))
    return round_cols(out, 6).orderBy(F.desc("max_abs_z"), "event_id")


FLAGSHIP_SQL = f"""
WITH med AS (SELECT quantile_cont(value, 0.5) AS m FROM events),
imp AS (SELECT event_id, user_id, ts, event_type, coalesce(value, (SELECT m FROM med)) AS value
        FROM events),
b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM imp),
cap AS (SELECT event_id, user_id, ts, event_type,
          greatest(least(value, q3 + 3 * (q3 - q1)), q1 - 3 * (q3 - q1)) AS value FROM imp, b),
f AS (SELECT *,
  avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                   ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS roll_mean_value_w5,
  CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1 THEN
    (CASE WHEN count(*) OVER (PARTITION BY user_id) <= 1 THEN value
     ELSE first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) END)
  ELSE lag(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS lag1_value
  FROM cap),
s AS (SELECT avg(value) AS m1, greatest(stddev_samp(value), 1e-6) AS s1,
             avg(roll_mean_value_w5) AS m2, greatest(stddev_samp(roll_mean_value_w5), 1e-6) AS s2,
             avg(lag1_value) AS m3, greatest(stddev_samp(lag1_value), 1e-6) AS s3
      FROM f WHERE event_type <> 'error'),
z AS (SELECT event_id, user_id, event_type, value, roll_mean_value_w5, lag1_value,
        (value - m1) / s1 AS z_value, (roll_mean_value_w5 - m2) / s2 AS z_roll_mean_value_w5,
        (lag1_value - m3) / s3 AS z_lag1_value FROM f, s)
SELECT event_id, user_id, event_type, {r6('value')} AS value,
  {r6('roll_mean_value_w5')} AS roll_mean_value_w5, {r6('lag1_value')} AS lag1_value,
  {r6('z_value')} AS z_value, {r6('z_roll_mean_value_w5')} AS z_roll_mean_value_w5,
  {r6('z_lag1_value')} AS z_lag1_value,
  {r6('greatest(abs(z_value), abs(z_roll_mean_value_w5), abs(z_lag1_value))')} AS max_abs_z,
  'Critical' AS status
FROM z WHERE greatest(abs(z_value), abs(z_roll_mean_value_w5), abs(z_lag1_value)) >= 2.5
"""
