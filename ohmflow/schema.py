"""Column names, groups and display labels of the readings data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values (must equal the reference for matching results) ----------
# The 12 raw sensor features, in their canonical order.
RAW_FEATURES = ["tau1", "tau2", "tau3", "tau4", "p1", "p2", "p3", "p4",
                "g1", "g2", "g3", "g4"]
# Rolling windows (rows) and lag depths of the temporal features.
ROLL_WINDOWS = [5, 10, 20]
LAGS = [1, 2, 3]
# Risk tiers: prob < 0.4 Green, prob <= 0.7 Amber, else Red.
TIER_GREEN_BELOW = 0.4
TIER_AMBER_MAX = 0.7
TIERS = ["Green", "Amber", "Red"]
# Node status on max |z|: < 1.5 Normal, < 2.5 Elevated, else Critical.
STATUS_ELEVATED_AT = 1.5
STATUS_CRITICAL_AT = 2.5
# Floors / guards.
STD_FLOOR = 1e-6
CAPACITY_EPS = 1e-9
PR_EPS = 1e-12
# Display labels of the raw features.
FEATURE_LABELS = {
    "tau1": "Node 0 — Reaction time (τ1)",
    "tau2": "Node 1 — Reaction time (τ2)",
    "tau3": "Node 2 — Reaction time (τ3)",
    "tau4": "Node 3 — Reaction time (τ4)",
    "p1": "Node 0 — Power output (p1)",
    "p2": "Node 1 — Power demand (p2)",
    "p3": "Node 2 — Power demand (p3)",
    "p4": "Node 3 — Power demand (p4)",
    "g1": "Node 0 — Price elasticity (g1)",
    "g2": "Node 1 — Price elasticity (g2)",
    "g3": "Node 2 — Price elasticity (g3)",
    "g4": "Node 3 — Price elasticity (g4)",
}
# Per-node sensor triples (tau, p, g) and alert labels used by the live monitor.
NODES = [(0, "tau1", "p1", "g1"), (1, "tau2", "p2", "g2"),
         (2, "tau3", "p3", "g3"), (3, "tau4", "p4", "g4")]
ALERT_LABEL_TAU = "Reaction Time"
ALERT_LABEL_P_PRODUCER = "Power Output"
ALERT_LABEL_P_CONSUMER = "Power Demand"
ALERT_LABEL_G = "Grid Cooperation"
STICKY_ALERT_SECONDS = 10
HISTORY_ROWS = 60
# Cluster names, by ascending cluster fault rate.
CLUSTER_NAMES = ["normal operation", "pre-fault stress", "active fault"]
# Sensor groups of the dashboard radar: key -> label.
FEATURE_GROUPS = {"tau": "Reaction Time", "p": "Power Balance", "g": "Cooperation"}
# ---------------------------------------------------------------------------

TARGET = "stabf"
LEAK_COLUMN = "stab"
ROLLING_FEATURES = [c for c in RAW_FEATURES if c.startswith("tau") or c.startswith("p")]
LAG_FEATURES = ["g1", "g2", "g3", "g4"] + [c for c in RAW_FEATURES if c.startswith("p")]
IQR_FEATURES = [c for c in RAW_FEATURES if c.startswith("p")]

READINGS_SCHEMA = T.StructType(
    [T.StructField("seq", T.LongType(), True)]
    + [T.StructField(c, T.DoubleType(), True) for c in RAW_FEATURES]
    + [T.StructField(LEAK_COLUMN, T.DoubleType(), True),
       T.StructField(TARGET, T.StringType(), True)]
)
