"""Hand-computed cases for the semantics table and operators."""

import math

import pytest
from pyspark.sql import functions as F

from ohmflow.functions.scalar import resolve_target, risk_tier, status_of
from ohmflow.operators import clean, metrics, prepare, temporal
from ohmflow.operators.sequence import with_ordinal


def test_short_series_lag_and_single_row_std(spark):
    # Series of 1, 2, 3, 4 rows
    rows = [(k, i, float(10 * k + i)) for k in (1, 2, 3, 4) for i in range(k)]
    df = spark.createDataFrame(rows, "k int, t int, x double")
    for mode in ("plain", "halo"):
        out = {(r.k, r.t): r for r in temporal.temporal_features(
            df, ["t"], ["k"], rolling=["x"], lag_cols=["x"], mode=mode, block_rows=23).collect()}
        assert out[(1, 0)]["roll_std_x_w5"] == 0.0          # one row -> 0
        assert out[(1, 0)]["lag1_x"] == 10.0                # n <= k: own value
        assert out[(2, 1)]["lag1_x"] == 20.0                # previous row
        assert out[(2, 1)]["lag2_x"] == 21.0                # n=2 <= 2: own value
        assert out[(3, 0)]["lag1_x"] == 30.0                # head back-filled with first value
        assert out[(4, 2)]["lag3_x"] == 40.0                # head back-filled
        assert out[(4, 3)]["lag3_x"] == 40.0                # x[0]
        assert out[(4, 3)]["roc_x"] == 1.0
        assert out[(2, 0)]["roc_x"] == 0.0


def test_halo_equals_plain(spark):
    df = spark.range(0, 500).select(
        (F.col("id") % 3).alias("k"), F.col("id").alias("t"),
        F.sin(F.col("id").cast("double")).alias("x"))
    a = temporal.temporal_features(df, ["t"], ["k"], rolling=["x"], lag_cols=["x"], mode="plain")
    b = temporal.temporal_features(df, ["t"], ["k"], rolling=["x"], lag_cols=["x"],
                                   block_rows=23)
    cols = a.columns
    ra = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                for r in a.select(cols).collect())
    rb = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                for r in b.select(cols).collect())
    assert ra == rb


def test_ordinal_dense_and_unique(spark):
    df = spark.range(0, 1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    o = with_ordinal(df, ["v"]).collect()
    assert sorted(r._ord for r in o) == list(range(1000))
    assert all(r._ord == r.v for r in o)


@pytest.mark.parametrize("p,tier", [(0.39999, "Green"), (0.4, "Amber"), (0.7, "Amber"),
                                    (0.70001, "Red")])
def test_tier_edges(spark, p, tier):
    assert spark.range(1).select(risk_tier(F.lit(p))).first()[0] == tier


@pytest.mark.parametrize("z,status", [(1.49, "Normal"), (1.5, "Elevated"), (2.49, "Elevated"),
                                      (2.5, "Critical")])
def test_status_edges(spark, z, status):
    assert spark.range(1).select(status_of(F.lit(z))).first()[0] == status


def test_ap_and_roc_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    ap = metrics.average_precision(df, "y", "s").first()[0]
    roc = metrics.roc_auc(df, "y", "s").first()[0]
    assert math.isclose(ap, 0.8333333333, rel_tol=1e-9)
    assert math.isclose(roc, 0.75, rel_tol=1e-12)


def test_scalers_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (8.0, 5.0)], "a double, c double")
    std = prepare.apply_scaler(df, prepare.fit_standard(df, ["a", "c"]), ["a", "c"]).collect()
    mm = prepare.apply_scaler(df, prepare.fit_minmax(df, ["a", "c"]), ["a", "c"]).collect()
    assert all(r.c == 0.0 for r in std) and all(r.c == 0.0 for r in mm)
    # population std (divide by n): 1,2,4,8 -> std 2.6810
    assert math.isclose(std[3].a, (8 - 3.75) / 2.680951323690902, rel_tol=1e-12)
    assert [r.a for r in mm] == [0.0, 1 / 7, 3 / 7, 1.0]


def test_median_impute_and_cap(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,), (100.0,)], "p double")
    imp = [r.p for r in clean.impute_median(df, ["p"]).collect()]
    assert sorted(imp) == [1.0, 2.0, 3.0, 4.0, 100.0]   # median of 1,2,4,100 = 3
    capped = sorted(r.p for r in clean.cap_iqr(df.na.fill(3.0), ["p"]).collect())
    # q1=2, q3=4 -> bounds [-4, 10]
    assert capped[-1] == 10.0


def test_empty_after_drop_and_missing_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, None)], "a double, b double")
    assert clean.drop_null_rows(df, ["a", "b"]).count() == 0
    with pytest.raises(ValueError, match="No valid rows"):
        clean.require_rows(clean.drop_null_rows(df, ["a", "b"]))
    assert clean.require_rows(df) is df
    with pytest.raises(ValueError, match="Missing required columns"):
        clean.require_columns(df, ["a", "zz"])


def test_relative_target(spark):
    row = spark.createDataFrame([("3x", 2.0), ("0.2x", 5.0), ("9.8", 1.0)], "end_val string, s double") \
        .select(resolve_target(F.col("end_val"), F.col("s")).alias("v")).collect()
    assert [r.v for r in row] == [6.0, 1.0, 9.8]


def test_split_disjoint_and_exhaustive(spark):
    df = spark.range(0, 2000).select(F.col("id").alias("seq"), (F.col("id") % 3 == 0).cast("int")
                                     .alias("y"))
    s = prepare.stratified_split(df, "y", "seq").groupBy("split", "y").count().collect()
    got = {(r.split, r.y): r["count"] for r in s}
    assert sum(got.values()) == 2000
    assert got[("test", 1)] == round(667 * 0.15)


def test_knn_exact_and_smote_properties(spark):
    import numpy as np
    from ohmflow.operators import neighbors
    rng = np.random.default_rng(0)
    pts = np.vstack([rng.normal(0, 1, (60, 3)), rng.normal(8, 0.5, (5, 3)), [[40.0, 40.0, 40.0]]])
    rows = [(i, *map(float, p)) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {r.id: [n.nid for n in r.neighbors] for r in neighbors.knn(df, "id", ["a", "b", "c"], 4).collect()}
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    for i in range(len(pts)):
        want = [j for _, j in sorted((d[i, j], j) for j in range(len(pts)) if j != i)][:4]
        assert got[i] == want
    lab = spark.createDataFrame([(i, int(i < 20), *map(float, p)) for i, p in enumerate(pts)],
                                "id long, y int, a double, b double, c double")
    out = neighbors.smote(lab, "id", "y", ["a", "b", "c"], k=3)
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[0] == counts[1]
    syn = out.where("synthetic").toPandas()
    base = pts[:20]
    for r in syn.itertuples():  # each synthetic point lies on a segment between two minority points
        x = np.array([r.a, r.b, r.c])
        ok = False
        for i in range(20):
            for j in range(20):
                v = base[j] - base[i]
                if i == j or not v.any():
                    continue
                t = np.dot(x - base[i], v) / np.dot(v, v)
                if -1e-9 <= t <= 1 + 1e-9 and np.allclose(base[i] + t * v, x, atol=1e-9):
                    ok = True
                    break
            if ok:
                break
        assert ok


def test_upload_validation_and_quarantine(spark, tmp_path):
    from ohmflow.sources import io as sio
    feats = ["tau1", "tau2", "tau3", "tau4", "p1", "p2", "p3", "p4", "g1", "g2", "g3", "g4"]
    good = ",".join(feats + ["extra"]) + "\n" + "\n".join(
        ",".join(["1.5"] * 12 + ["x"]) for _ in range(3)) + "\n" + ",".join(["oops"] * 12 + ["y"]) + "\n"
    p = tmp_path / "up.csv"
    p.write_text(good)
    q = str(tmp_path / "quarantine")
    df = sio.read_upload(spark, str(p), quarantine=q)
    assert df.columns == feats and df.count() == 3
    assert spark.read.text(q).count() == 1
    with pytest.raises(ValueError, match="Only .csv"):
        sio.read_upload(spark, str(tmp_path / "up.txt"))
    bad = tmp_path / "bad.csv"
    bad.write_text("tau1,tau2\n1,2\n")
    with pytest.raises(ValueError, match="Missing required columns"):
        sio.read_upload(spark, str(bad))


def test_load_splits_names_missing(spark, tmp_path):
    from ohmflow.sources import io as sio
    df = spark.createDataFrame([(1, "train"), (2, "test")], "seq int, split string")
    sio.write_splits(df, str(tmp_path / "s"))
    assert sio.load_splits(spark, str(tmp_path / "s"), ["train"]).count() == 1
    with pytest.raises(FileNotFoundError, match="val"):
        sio.load_splits(spark, str(tmp_path / "s"), ["train", "val"])


def test_overlay_equals_step_by_step(spark):
    from ohmflow.operators import whatif
    base = [(1, 1.0, -2.0), (2, 3.0, -1.0)]
    events = [("s", 0, "main", "p2", 2, 6, None, "3x"), ("s", 1, "main", "p2", 4, 4, 5.0, "0.2x"),
              ("s", 2, "main", "p3", 0, 0, None, "9.8"), ("s", 3, "fix", "p2", 0, 3, None, "0.5x"),
              ("t", 4, "main", "p3", 1, 2, None, "bad"), ("s", 5, "main", "p2", 99, 99, None, "1")]
    events += [("many", 100 + i, "main", "p2", 0, 1, None, str(i)) for i in range(300)]

    def brute(row, step, fix, scenario):
        out = dict(zip(("p2", "p3"), row[1:]))
        for sc, _, phase, f, s, e, v0, target in events:   # the later event wins
            if scenario is not None and sc != scenario:
                continue
            if phase != ("fix" if fix is not None and step >= fix else "main"):
                continue
            if phase == "fix":
                s, e = s + fix, e + fix
            if step < s:
                continue
            own = row[1] if f == "p2" else row[2]
            v0 = own if v0 is None else v0
            if target == "bad":
                out[f] = own
                continue
            v1 = v0 * float(target[:-1]) if target.endswith("x") else float(target)
            out[f] = v0 + (step - s) / max(e - s, 1) * (v1 - v0) if step <= e else v1
        return out["p2"], out["p3"]
    ev = spark.createDataFrame(events, whatif.EVENT_SCHEMA)
    df = spark.createDataFrame(base, "seq int, p2 double, p3 double")
    for fix, scenario in ((None, None), (8, None), (None, "s"), (8, "s"), (None, "t"),
                          (None, "many"), (None, "none")):
        named = df if scenario is None else df.withColumn("sc", F.lit(scenario))
        st = whatif.expand_steps(named, "seq", 12)
        got = whatif.overlay(st, ev, 12, ["p2", "p3"], fix, "sc" if scenario else None).collect()
        assert len(got) == 24
        for r in got:
            want = brute(base[r.seq - 1], r.step, fix, scenario)
            assert (r.p2, r.p3) == pytest.approx(want), (fix, scenario, r)


def test_quantiles_of_repeated_values(spark):
    import numpy as np
    from ohmflow.operators.stats import exact_quantiles, qname
    rng = np.random.default_rng(3)
    vals = np.where(rng.random(5000) < 0.6, 7.0, np.round(rng.normal(0, 50, 5000), 1))
    rows = [(None if i % 3 == 0 else i % 3, float(v) if i % 11 else None)
            for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g int, x double").withColumn("none", F.lit(None).cast("double"))
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r for r in exact_quantiles(df, ["x", "none"], probs, ["g"]).collect()}
    assert set(got) == {None, 1, 2} and all(r.feature == "x" for r in got.values())
    for g, r in got.items():
        own = [v for k, v in rows if k == g and v is not None]
        assert [r[qname(p)] for p in probs] == pytest.approx(list(np.quantile(own, probs)))
    assert exact_quantiles(df.limit(0), ["x"], [0.5]).count() == 0


def test_hot_value_is_one_row_of_the_rank_table(spark):
    # 60 percent of the rows hold one value: it is counted before the range exchange
    from ohmflow.operators.sequence import cumulative_sums
    df = spark.range(20000).selectExpr("if(id % 10 < 6, -1, id) as value", "'x' as feature")
    counted = df.groupBy("feature", "value").count()
    cum = cumulative_sums(counted, ["feature"], ["value"], ["count"], num_partitions=8)
    assert cum.count() == 8001
    assert cum.agg(F.max("cum_count")).first()[0] == 20000


def test_counterfactuals_are_ranked(spark):
    from ohmflow.operators import scoring
    from ohmflow.schema import RAW_FEATURES as R
    df = spark.createDataFrame([(1, *[8.0] * 4, *[4.0] * 4, *[1.0] * 4),
                                (2, *[2.0] * 12)], "seq int, " + ", ".join(f"{f} double" for f in R))
    stats = spark.createDataFrame([(f, 2.0) for f in R], "feature string, mean double")
    got = scoring.counterfactuals(df, "seq", scoring.twelve_feature_scorer(), (0.4, 0.6), 0.5,
                                  stats).orderBy("seq", "cf_rank").collect()
    assert {r.seq for r in got} == {1} and [r.cf_rank for r in got] == list(range(1, 13))
    assert [r.delta for r in got] == sorted(r.delta for r in got)
    assert [r.feature for r in got[:4]] == ["p1", "p2", "p3", "p4"]


def test_sticky_alert_blocks_equal_range_frame(spark):
    from pyspark.sql import Window
    from ohmflow.operators import alerts
    rows = [(k, i, i * 3 + (k % 2), float(((i * 37 + k * 11) % 17) - 8)) for k in range(3)
            for i in range(400)]
    df = spark.createDataFrame(rows, "k int, i int, sec long, z double") \
        .withColumn("ts", F.timestamp_seconds("sec"))
    breach = F.abs(F.col("z")) >= 6
    msg = F.concat(F.lit("z="), F.col("z").cast("string"))
    got = alerts.sticky_alert(df, "ts", ["k"], breach, msg, block_rows=37) \
        .select("k", "i", "active_alert", "alert_age_s").orderBy("k", "i").collect()
    t = F.unix_micros("ts")
    w = Window.partitionBy("k").orderBy(t).rangeBetween(-10_000_000, 0)
    ref = (df.withColumn("m", F.when(breach, msg)).withColumn("bt", F.when(breach, t))
           .select("k", "i", F.last("m", True).over(w).alias("active_alert"),
                   ((t - F.last("bt", True).over(w)) / 1e6).alias("alert_age_s"))
           .orderBy("k", "i").collect())
    assert [tuple(r) for r in got] == [tuple(r) for r in ref]


def test_projection_labels_and_lookup(spark):
    from ohmflow.operators import dashboard
    df = spark.createDataFrame([(1, 2.0, " Unstable "), (2, 3.0, "stable"), (3, 1.0, "maybe")],
                               "row int, a double, y string")
    proj = clean.project_features(df, ["a", "missing"], keep=["row"])
    assert proj.columns == ["row", "a", "missing"] and proj.first()["missing"] == 0.0   # P2
    norm = [r.y for r in clean.normalize_label(df, "y").orderBy("row").collect()]
    assert norm == [1, 0, None]                                                          # P10
    assert [r.label for r in clean.invalid_labels(df, "y").collect()] == ["maybe"]
    clean.require_binary_target(df.where("row < 3"), "y")                                # P11
    for wrong in (df, df.where("row = 1"), df.limit(0)):
        with pytest.raises(ValueError, match="must be binary"):
            clean.require_binary_target(wrong, "y")
    with pytest.raises(ValueError, match=r"Unsupported target labels: \['maybe'\]"):
        clean.require_known_labels(df, "y")
    clean.require_known_labels(df.where("row < 3"), "y")
    assert [r.row for r in clean.normalize_label(df, "row").orderBy("row").collect()] == [1, 2, 3]
    with pytest.raises(ValueError, match="not found"):
        clean.require_binary_target(df, "zz")
    assert dashboard.lookup_row(df, 2).first()["a"] == 3.0                               # P15


def test_knn_exact_with_sharded_dense_cells(spark, monkeypatch):
    import numpy as np
    from ohmflow.operators import neighbors
    monkeypatch.setattr(neighbors, "SHARD_ROWS", 7)   # force probe/target shards
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.normal(0, 0.01, (80, 3)), rng.normal(3, 1, (40, 3))])  # one dense cluster
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)],
                               "id long, a double, b double, c double")
    got = {r.id: [n.nid for n in r.neighbors] for r in neighbors.knn(df, "id", ["a", "b", "c"], 5).collect()}
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    for i in range(len(pts)):
        assert got[i] == [j for _, j in sorted((d[i, j], j) for j in range(len(pts)) if j != i)][:5]


def test_model_save_and_load(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel
    from ohmflow.operators import models
    from ohmflow.sources import io as sio
    df = spark.createDataFrame([(float(i), float(i % 7), int(i % 2)) for i in range(60)],
                               "a double, b double, y int")
    m = models.logistic("y", 60).fit(models.assemble(df, ["a", "b"]))
    sio.save_model(m, str(tmp_path / "lr"))                                             # IO8
    back = LogisticRegressionModel.load(str(tmp_path / "lr"))
    a = [r.prediction for r in m.transform(models.assemble(df, ["a", "b"])).collect()]
    b = [r.prediction for r in back.transform(models.assemble(df, ["a", "b"])).collect()]
    assert a == b


def test_null_group_keeps_its_running_total(spark):
    from ohmflow.operators.metrics import roc_auc
    from ohmflow.operators.sequence import cumulative_sums
    df = spark.range(40).selectExpr("id", "cast(null as string) as g", "1L as v")
    rows = cumulative_sums(df, ["g"], ["id"], ["v"], num_partitions=4).collect()
    assert sorted(r.cum_v for r in rows) == list(range(1, 41))
    two = df.selectExpr("g", "cast(id % 2 as int) as y", "id / 40.0D as s").unionByName(
        df.selectExpr("'a' as g", "cast(id % 2 as int) as y", "id / 40.0D as s"))
    assert roc_auc(two, "y", "s", ["g"]).count() == 2


def test_isolation_forest_samples_and_planted_outlier(spark):
    from ohmflow.operators import isoforest
    df = spark.range(10000).selectExpr("id", "sin(id) as a", "cos(id * 3) as b",
                                       "cast(id = 7777 as int) as y")
    for c in "ab":
        df = df.withColumn(c, F.when(F.col("id") == 7777, 40.0).otherwise(F.col(c)))
    sample = isoforest.tree_samples(df, "id", 12, 256, 42)
    per_tree = sample.groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"))
    assert [(r.n, r.d) for r in per_tree.collect()] == [(256, 256)] * 12
    newest = sample.where("id >= 9000").count() / (12 * 256)    # no part of the ids is left out
    assert 0.05 < newest < 0.15
    small = isoforest.tree_samples(df.limit(30), "id", 5, 256, 42)
    assert [r["count"] for r in small.groupBy("tree").count().collect()] == [30] * 5
    assert isoforest.fit(df.limit(0), ["a", "b"], "id", trees=3).count() == 0

    forest = isoforest.fit(df, ["a", "b"], "id").cache()
    assert {r["size"] for r in forest.where("node = 0").collect()} == {256}
    scored = isoforest.score(df, forest, ["a", "b"]).cache()
    top = scored.orderBy(F.desc("IF_anomaly_score")).limit(10).collect()
    assert 7777 in {r.id for r in top}
    sweep = isoforest.contamination_sweep(scored.where("id >= 7000"), "y", scored).collect()
    assert len(sweep) == 16
    cut = {r.contamination: r.cutoff for r in sweep}
    above = scored.where(F.col("IF_anomaly_score") > cut[0.1]).count()
    assert abs(above - 1000) <= 5       # ten percent of the fitted rows


def test_correlation_with_a_constant_is_null(spark):
    from pyspark.sql import functions as F

    from ohmflow.functions.scalar import pearson
    df = spark.createDataFrame([(0.1, float(k), float(-2 * k), None) for k in range(999)],
                               "c double, x double, y double, n double").repartition(4)
    row = df.agg(pearson(F.col("c"), F.col("x")).alias("c"), pearson(F.col("x"), F.col("y")).alias("xy"),
                 pearson(F.col("x"), F.col("n")).alias("n")).first()
    assert row.c is None and row.n is None and abs(row.xy + 1) < 1e-12


def test_affine_maps_are_permutations_and_stay_in_range():
    from ohmflow.operators.importance import affine_map
    for n in (1, 2, 6, 30, 97, 1000):
        for f in ("a", "b"):
            for r in range(3):
                a, b = affine_map(n, f, r)
                assert sorted((a * q + b) % n for q in range(n)) == list(range(n))
    a, b = affine_map(10 ** 11, "a", 0)
    assert a * 10 ** 11 + b < 1 << 63 and affine_map(0, "a", 0)[1] == 0


def test_permutation_drops_equal_brute_force(spark):
    from pyspark.sql import functions as F

    from ohmflow.operators import importance
    rows = [(3 * i, i % 2, float(i % 2), float(i % 5)) for i in range(41)]
    df = spark.createDataFrame(rows, "id long, y int, good double, noise double")
    got = {(r.feature, r["repeat"]): r["drop"] for r in importance.permutation_scores(
        df, "id", "y", ["good", "noise"], lambda d: d.withColumn("pred", F.col("good").cast("int")), 4).collect()}
    for r in range(4):
        a, b = importance.affine_map(41, "good", r)
        moved = {(a * q + b) % 41: rows[q][2] for q in range(41)}
        right = sum(int(moved[i]) == rows[i][1] for i in range(41)) / 41
        assert abs(got["good", r] - (1 - right)) < 1e-12 and got["noise", r] == 0


def test_weighted_clustering_equals_brute_force(spark):
    import random
    from itertools import combinations

    from ohmflow.operators import graph
    rng = random.Random(4)
    # a hub with every node, a dense part, leaves, parallel and looping edges
    edges = [(0, k, rng.randint(1, 9)) for k in range(1, 25)]
    edges += [(a, b, rng.randint(1, 9)) for a, b in combinations(range(1, 10), 2) if rng.random() < 0.6]
    edges += [(5, 2, 3), (7, 7, 50), (30, 31, 4), (None, 3, 1), (40, 41, 1), (41, 42, 1)]
    w = {}
    for a, b, x in edges:
        if a is not None and a != b:
            w[min(a, b), max(a, b)] = w.get((min(a, b), max(a, b)), 0) + x
    top, near = max(w.values()), {}
    for a, b in w:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for n, around in near.items():
        g = [(w[min(n, a), max(n, a)] * w[min(n, b), max(n, b)] * w[a, b]) ** (1 / 3) / top
             for a, b in combinations(sorted(around), 2) if (a, b) in w]
        k = len(around)
        want[n] = (k, len(g), 2 * sum(g) / (k * (k - 1)) if k > 1 else 0.0)
    df = spark.createDataFrame(edges, "a int, b int, weight int")
    got = {r.node: (r.degree, r.triangles, r.clustering) for r in graph.weighted_clustering(df).collect()}
    assert got.keys() == want.keys()
    for n in want:
        assert got[n][:2] == want[n][:2] and abs(got[n][2] - want[n][2]) < 1e-12
    assert graph.weighted_clustering(df.limit(0)).collect() == []


def test_reuse_finds_the_first_run_and_rebuilds_on_change(spark, tmp_path):
    from ohmflow.sources import io as sio
    src, root = str(tmp_path / "in"), str(tmp_path / "feeds")
    spark.range(5).write.parquet(src)
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(src).selectExpr("id * 2 as x")
    assert sio.reuse(spark, [src], root, build).count() == 5
    before = sorted(str(p) for p in tmp_path.rglob("*"))
    assert sio.reuse(spark, [src], root, build).count() == 5
    assert len(calls) == 1 and sorted(str(p) for p in tmp_path.rglob("*")) == before
    spark.range(3).write.mode("append").parquet(src)
    assert sio.reuse(spark, [src], root, build).count() == 8 and len(calls) == 2
    assert sio.reuse(spark, [src], root, build).count() == 8 and len(calls) == 2


def test_upload_without_a_usable_row_is_an_error(spark, tmp_path):
    import pytest

    from ohmflow.sources import io as sio
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("a,b\n1,2\n3,\n")
    bad.write_text("a,b\n1,\n,2\n")
    assert sio.upload_rows(spark, str(good), ["a", "b"]).count() == 1
    with pytest.raises(ValueError):
        sio.upload_rows(spark, str(bad), ["a", "b"])
