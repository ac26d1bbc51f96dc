"""Plan-shape checks for the scale design: no single-partition exchanges on
row-sized data, pruned scans."""

import pytest
from pyspark.sql import functions as F

from ohmflow.operators import metrics, temporal

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_global_series_windows_are_not_single_partition(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "value")
    out = temporal.temporal_features(ev, ["ts", "event_id"], [], rolling=["value"],
                                     lag_cols=["value"])
    plan = _plan(out)
    assert "SinglePartition" not in plan
    assert "hashpartitioning" in plan and "_blk" in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_curve_metric_has_no_single_partition_window(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").select(
        (F.col("event_type") == "error").cast("int").alias("y"), "value")
    plan = _plan(metrics.average_precision(ev, "y", "value"))
    # row-sized running sums run per range partition (window keyed by _pid);
    # only tiny inputs gather to one partition: the final one-row aggregate,
    # the P-row offset table and the class totals
    assert "hashpartitioning(_pid" in plan
    assert plan.count("SinglePartition") <= 3


def test_scan_reads_only_needed_columns(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    plan = ev.where(F.col("event_type") == "error").select("value")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "ReadSchema: struct<event_type:string,value:double>" in plan
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan


@pytest.mark.parametrize("name", ["rf_grid", "gbt_weight_sweep", "baseline_models",
                                  "permutation_importance", "score_modes"])
def test_model_queries_use_the_library_defaults(spark, monkeypatch, name):
    """Stops at the first learner: which settings and features it gets."""
    from ohmflow.plans import QUERIES, modeling

    class Called(Exception):
        pass

    def learner(*args, **settings):
        for value in args:
            if isinstance(value, list):     # feature names
                assert len(value) == 156
        # only the selector's forest has settings of its own
        assert settings == ({"trees": 200, "depth": 10, "weight": "weight"}
                            if name == "permutation_importance" else {})
        raise Called
    for f in ("random_forest", "boosted_trees", "tune_forest", "sweep_boosting_weights", "kmeans_sweep"):
        monkeypatch.setattr(modeling.models, f, learner)
    assert len(modeling.FEATS) == 156
    with pytest.raises(Called):
        QUERIES[name](spark, "/root/testdata/sf0.001")
