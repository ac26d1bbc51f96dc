"""Derived views the operators are tested on.

``readings``: one sensor reading per four lines of an order, built from
``lineitem`` + ``orders`` (4 line slots -> 4 nodes); no line is left out. ``scored_fixture``: a deterministic
stand-in for model output, so metrics/dashboard operators can be checked
against SQL without a trained model. Each view has a Spark builder and the
identical SQL text used as a CTE by the oracle queries.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import risk_tier
from ..schema import CLUSTER_NAMES, RAW_FEATURES
from ..operators.common import materialize
from ..operators.sequence import tasks_for
from .tables import table

# Scales are powers of two so every reading is a dyadic rational: sums,
# medians and quartiles of them are exact in binary floating point, so two
# engines summing in different orders agree to the last bit.
PRICE_SCALE = 8192.0
#: readings an order may yield (four lines each); more lines are an error
PARTS = 8
DISC_SCALE = 16.0
SLOT_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
              "l_extendedprice", "l_quantity", "l_discount"]


def reading_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for exchanges of the readings, by the lines they are made of (a count
    that Parquet answers from its footers); the session's number where the rows come from
    elsewhere and there is no such table."""
    try:
        lines = table(spark, sf_dir, "lineitem").count()
    except AnalysisException:
        lines = 0
    return tasks_for(spark, lines)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings view: ``seq, tau1..4, p1..4, g1..4, stab, stabf``.

    Plan: one hash exchange of lineitem on ``l_orderkey`` serves the slot
    window, the pivot aggregate and the join with orders (same partitioning),
    so only orders is shuffled besides.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", *[c for c in SLOT_ORDER], "l_tax")
    tasks = reading_tasks(spark, sf_dir)
    if tasks > tasks_for(spark, 0):
        li = li.repartition(tasks, "l_orderkey")    # else the window's own exchange

    def at(slot: int, c: str):
        return F.max(F.when(F.col("slot") == slot, F.col(c)))

    price = F.floor(F.col("l_extendedprice")).cast("double")
    disc = F.round(F.col("l_discount") * F.lit(100.0), 0)
    tax = F.round(F.col("l_tax") * F.lit(100.0), 0)
    w = Window.partitionBy("l_orderkey").orderBy(*SLOT_ORDER)
    line = F.row_number().over(w) - 1
    part = F.floor(F.col("line") / 4)
    # price, discount and tax are rounded behind the exchange, which carries each once
    slotted = (li.withColumn("line", line)
               .withColumns({"_price": price, "_disc": disc, "_tax": tax})
               .withColumn("slot", F.col("line") % 4 + 1)
               .withColumn("part", F.when(part < PARTS, part).otherwise(
                   F.raise_error(F.lit(f"an order has more than {4 * PARTS} lines")).cast("long"))))
    aggs = [at(i, "l_quantity").alias(f"tau{i}") for i in range(1, 5)]
    aggs += [(at(1, "_price") / F.lit(PRICE_SCALE)).alias("p1")]
    aggs += [(at(i, "_price") / F.lit(-PRICE_SCALE)).alias(f"p{i}") for i in range(2, 5)]
    aggs += [(at(i, "_disc") / F.lit(DISC_SCALE)).alias(f"g{i}") for i in range(1, 5)]
    aggs += [((at(1, "_tax") - at(1, "_disc")) / F.lit(DISC_SCALE)).alias("stab")]
    per_order = slotted.groupBy("l_orderkey", "part").agg(*aggs)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    view = (per_order.join(orders, per_order.l_orderkey == orders.o_orderkey, "inner")
            .select((F.col("l_orderkey") * PARTS + F.col("part")).alias("seq"), *RAW_FEATURES, "stab",
                    F.when(F.col("o_orderstatus") == "F", F.lit("unstable"))
                    .otherwise(F.lit("stable")).alias("stabf")))
    # Every consumer (statistics, then the rows they are applied to, then
    # ordinals) reads the view several times: write it once to the shared
    # checkpoint folder instead of re-running the lineitem window and join.
    return materialize(view)


READINGS_SQL = """
readings AS (
  SELECT s.l_orderkey * 8 + part AS seq,
    max(CASE WHEN slot = 1 THEN l_quantity END) AS tau1,
    max(CASE WHEN slot = 2 THEN l_quantity END) AS tau2,
    max(CASE WHEN slot = 3 THEN l_quantity END) AS tau3,
    max(CASE WHEN slot = 4 THEN l_quantity END) AS tau4,
    max(CASE WHEN slot = 1 THEN floor(l_extendedprice) END) / 8192.0 AS p1,
    max(CASE WHEN slot = 2 THEN floor(l_extendedprice) END) / -8192.0 AS p2,
    max(CASE WHEN slot = 3 THEN floor(l_extendedprice) END) / -8192.0 AS p3,
    max(CASE WHEN slot = 4 THEN floor(l_extendedprice) END) / -8192.0 AS p4,
    max(CASE WHEN slot = 1 THEN round(l_discount * 100.0) END) / 16.0 AS g1,
    max(CASE WHEN slot = 2 THEN round(l_discount * 100.0) END) / 16.0 AS g2,
    max(CASE WHEN slot = 3 THEN round(l_discount * 100.0) END) / 16.0 AS g3,
    max(CASE WHEN slot = 4 THEN round(l_discount * 100.0) END) / 16.0 AS g4,
    (max(CASE WHEN slot = 1 THEN round(l_tax * 100.0) END)
      - max(CASE WHEN slot = 1 THEN round(l_discount * 100.0) END)) / 16.0 AS stab,
    CASE WHEN any_value(o.o_orderstatus) = 'F' THEN 'unstable' ELSE 'stable' END AS stabf
  FROM (
    SELECT *, (line - 1) % 4 + 1 AS slot, (line - 1) // 4 AS part FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
             l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount) AS line
      FROM lineitem)) s
  JOIN orders o ON o.o_orderkey = s.l_orderkey
  GROUP BY s.l_orderkey, part
)"""


# Deterministic stand-in scores (fixed values of this fixture).
RF_DIVISOR = 50.0
XGB_DIVISOR = 12.0
ENSEMBLE_WEIGHTS = (0.4, 0.6)
FIXTURE_THRESHOLD = 0.5
N_FIXTURE_CLUSTERS = 3


def scored_fixture(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Scored-feed stand-in: probabilities from raw columns, a hash cluster,
    tier, label and truth. Slot-1 columns are never null, so no imputation.
    ``rows``: the readings, where the caller has them written already."""
    r = readings(spark, sf_dir) if rows is None else rows
    rf = F.least(F.col("tau1") / F.lit(RF_DIVISOR), F.lit(1.0))
    xgb = F.least(F.col("p1") / F.lit(XGB_DIVISOR), F.lit(1.0))
    ens = F.lit(ENSEMBLE_WEIGHTS[0]) * rf + F.lit(ENSEMBLE_WEIGHTS[1]) * xgb
    cluster_id = F.pmod(F.col("seq") * F.lit(7) + F.lit(3), F.lit(N_FIXTURE_CLUSTERS))
    names = F.array(*[F.lit(n) for n in CLUSTER_NAMES])
    return (r.select("seq", *RAW_FEATURES, "stabf",
                     rf.alias("RF_prob"), xgb.alias("XGBoost_prob"))
            .withColumn("ensemble_prob", ens)
            .withColumn("threshold", F.lit(FIXTURE_THRESHOLD))
            .withColumn("ensemble_label",
                        (F.col("ensemble_prob") >= F.col("threshold")).cast("int"))
            .withColumn("IF_anomaly_score", F.col("g1"))
            .withColumn("cluster_id", cluster_id.cast("int"))
            .withColumn("kmeans_cluster", F.element_at(names, F.col("cluster_id") + 1))
            .withColumn("_true_label", (F.col("stabf") == "unstable").cast("int"))
            .withColumn("risk_tier", risk_tier(F.col("ensemble_prob"))))


SCORED_SQL = """
scored_fixture AS (
  SELECT *,
    CASE WHEN ensemble_prob < 0.4 THEN 'Green' WHEN ensemble_prob <= 0.7 THEN 'Amber'
         ELSE 'Red' END AS risk_tier,
    CAST(ensemble_prob >= threshold AS INTEGER) AS ensemble_label,
    ['normal operation', 'pre-fault stress', 'active fault'][cluster_id + 1] AS kmeans_cluster
  FROM (
    SELECT seq, tau1, tau2, tau3, tau4, p1, p2, p3, p4, g1, g2, g3, g4, stabf,
      least(tau1 / 50.0, 1.0) AS RF_prob,
      least(p1 / 12.0, 1.0) AS XGBoost_prob,
      0.4 * least(tau1 / 50.0, 1.0) + 0.6 * least(p1 / 12.0, 1.0) AS ensemble_prob,
      0.5 AS threshold,
      g1 AS IF_anomaly_score,
      CAST(((seq * 7 + 3) % 3 + 3) % 3 AS INTEGER) AS cluster_id,
      CAST(stabf = 'unstable' AS INTEGER) AS _true_label
    FROM readings)
)"""


def with_views(*views: str) -> str:
    """``WITH`` prefix for oracle SQL using the derived views."""
    parts = []
    if "readings" in views or "scored_fixture" in views:
        parts.append(READINGS_SQL)
    if "scored_fixture" in views:
        parts.append(SCORED_SQL)
    return "WITH " + ",\n".join(parts) + "\n"
