"""Shared steps keep their work spread at size, with the rows unchanged."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import functions as F


def plan_of(df) -> str:
    """The plan's text as explain prints it."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_class_sizes_reach_the_rows_without_a_shuffle_by_label(spark):
    from ohmflow.operators import models, prepare
    df = spark.range(400).select(F.col("id").alias("seq"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    split = prepare.stratified_split(df, "y", "seq")
    weighted = models.balanced_weights(df, "y")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")    # as with tables too large to guess
    try:
        plans = [plan_of(out) for out in (split, weighted)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert all("SortMergeJoin" not in p and "BroadcastHashJoin" in p for p in plans)
    got = {(r["y"], r["split"]): r["count"] for r in split.groupBy("y", "split").count().collect()}
    assert got == {(0, "test"): 45, (0, "val"): 45, (0, "train"): 210,
                   (1, "test"): 15, (1, "val"): 15, (1, "train"): 70}
    assert {(r["y"], r["weight"]) for r in weighted.select("y", "weight").distinct().collect()} == {
        (0, 400 / 600), (1, 2.0)}


def test_rounding_is_half_away_from_zero_as_before(spark):
    from ohmflow.operators.common import rounded
    xs = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.3, -0.0, 1e17 + 16, 1234.5675, 2.0 ** 52 - 0.5,
          float("nan"), None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (0, 3):
        scale = float(10 ** digits)
        old = F.round(F.col("x") * F.lit(scale), 0) / F.lit(scale)
        rows = df.select(rounded(F.col("x"), digits).alias("new"), old.alias("old")).collect()
        assert [repr(r["new"]) for r in rows] == [repr(r["old"]) for r in rows]
    assert "round(" not in plan_of(df.select(rounded(F.col("x"), 6))).lower()


def test_features_of_double_columns_run_without_window_frames(spark):
    from ohmflow.operators import temporal
    rows = [(u, t, None if (u + t) % 7 == 3 else float("nan") if (u, t) == (2, 9) else (t * 37 % 11) / 8.0 - u)
            for u in range(6) for t in range([1, 2, 3, 4, 30, 57][u])]
    rows += [(None, t, float(t)) for t in range(5)]
    df = spark.createDataFrame(rows, "u int, t int, x double").repartition(5)
    got = temporal.temporal_features(df, ["t"], ["u"], rolling=["x"], lag_cols=["x"], block_rows=21)
    want = temporal.temporal_features(df, ["t"], ["u"], rolling=["x"], lag_cols=["x"], mode="plain")
    assert "Window" not in plan_of(got)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    one = temporal.temporal_features(df.where("u is not null"), ["u", "t"], rolling=["x"], lag_cols=["x"])
    two = temporal.temporal_features(df.where("u is not null"), ["u", "t"], rolling=["x"], lag_cols=["x"], mode="plain")
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_triangles_are_closed_in_tasks_by_node_groups(spark, monkeypatch):
    from itertools import combinations

    from ohmflow.operators import graph
    edges = [(a, b, float(1 + (a * b) % 5)) for a, b in combinations(range(40), 2) if (a * 7 + b * 3) % 4]
    edges += [(100, k, 2.0) for k in range(40)] + [(200, 201, 0.0), (201, 202, 1.0), (200, 202, 3.0)]
    simple = graph.simple_edges(spark.createDataFrame(edges, "a long, b long, weight double"))
    w = {(min(a, b), max(a, b)): x for a, b, x in edges}
    near: dict = {}
    for a, b in w:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want: dict = {}
    for a, b in w:
        for c in near[a] & near[b]:
            if c > b:
                g = (w[a, b] * w[a, c] * w[b, c]) ** (1 / 3)
                for node in (a, b, c):
                    n, s = want.get(node, (0, 0.0))
                    want[node] = n + 1, s + g
    for size, chunk in ((10 ** 9, 50), (60, 10 ** 6)):     # one group of nodes, and several
        monkeypatch.setattr(graph, "GROUP_EDGES", size)
        monkeypatch.setattr(graph, "CHUNK_PATHS", chunk)
        got = {r["node"]: (r["triangles"], r["s"]) for r in graph.triangle_sums(simple).collect()}
        assert {n: t for n, (t, _) in got.items()} == {n: t for n, (t, _) in want.items()}
        assert all(abs(got[n][1] - s) < 1e-9 for n, (_, s) in want.items())


def test_counterfactuals_are_dealt_by_id_before_the_fan_out(spark):
    from ohmflow.operators import scoring
    from ohmflow.schema import RAW_FEATURES
    df = spark.range(50).select(F.col("id").alias("seq"), *[
        (F.pmod(F.col("id") * (i + 3), F.lit(17)) / 8.0).alias(c) for i, c in enumerate(RAW_FEATURES)])
    stats = spark.createDataFrame([(c, 1.0) for c in RAW_FEATURES], "feature string, mean double")
    out = scoring.counterfactuals(df, "seq", scoring.twelve_feature_scorer(), (0.4, 0.6), 0.5, stats)
    window = plan_of(out).split("Window", 1)[1]
    assert window.index("Generate") < window.index("hashpartitioning(seq")
    each = out.groupBy("seq").agg(F.sort_array(F.collect_list("cf_rank")).alias("r")).collect()
    assert all(r["r"] == list(range(1, len(r["r"]) + 1)) for r in each)


def test_winning_events_reach_the_steps_without_a_shuffle(spark):
    from ohmflow.operators import whatif
    base = spark.createDataFrame([(1, 4.0, 2.0), (2, None, 1.0)], "seq long, p1 double, p2 double")
    ev = spark.createDataFrame([("a", 0, "main", "p1", 1, 3, None, " 3X "), ("a", 1, "main", "p2", 1, 2, 5.0, "9"),
                                ("a", 2, "main", "p2", 3, 4, None, "none")], whatif.EVENT_SCHEMA)
    out = whatif.overlay(whatif.expand_steps(base, "seq", 5), ev, 5, ["p1", "p2"])
    assert "SortMergeJoin" not in plan_of(out) and "BroadcastHashJoin" in plan_of(out)
    got = {(r["seq"], r["step"]): (r["p1"], r["p2"]) for r in out.collect()}
    assert got == {(1, 0): (4.0, 2.0), (1, 1): (4.0, 5.0), (1, 2): (8.0, 9.0), (1, 3): (12.0, 2.0),
                   (1, 4): (12.0, 2.0), (2, 0): (None, 1.0), (2, 1): (None, 5.0), (2, 2): (None, 9.0),
                   (2, 3): (None, 1.0), (2, 4): (None, 1.0)}


def test_scaled_features_are_written_once_and_split_as_before(spark, monkeypatch):
    from ohmflow.operators import prepare
    from ohmflow.plans import modeling
    from ohmflow.schema import RAW_FEATURES
    rows = spark.createDataFrame(
        [(7 * i % 61, *[float((i * (k + 3)) % 17) / 4 - 1 for k in range(len(RAW_FEATURES))], i % 3 % 2)
         for i in range(61)], ["seq", *RAW_FEATURES, "stabf"])
    monkeypatch.setattr(modeling, "cleaned_readings", lambda *_: rows)
    s = prepare.stratified_split(modeling._features(spark, ""), "stabf", "seq")
    want = prepare.apply_scaler(s, prepare.fit_standard(s.where("split = 'train'"), modeling.FEATS), modeling.FEATS)
    widths, write = [], type(rows).checkpoint
    monkeypatch.setattr(type(rows), "checkpoint",
                        lambda df, *a, **k: (widths.append(len(df.columns)), write(df, *a, **k))[1])
    got = modeling._scaled(spark, "")
    assert widths and max(widths) < len(modeling.FEATS)
    assert got.columns == want.columns
    for a, b in zip(got.orderBy("seq").collect(), want.orderBy("seq").collect(), strict=True):
        assert (a["seq"], a["stabf"], a["split"]) == (b["seq"], b["stabf"], b["split"])
        assert all(abs(a[c] - b[c]) < 1e-9 for c in modeling.FEATS)


def test_readings_exchange_carries_no_derived_columns(spark, monkeypatch, tmp_path):
    from ohmflow.sources import fixtures
    spark.createDataFrame([(1, n, n, 1, "1995-01-01", 100.75 * n, 5.0, 0.04, 0.06) for n in range(1, 6)],
                          "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_shipdate string, "
                          "l_extendedprice double, l_quantity double, l_discount double, l_tax double"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "F")], "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(fixtures, "materialize", lambda df: df)
    view = fixtures.readings(spark, str(tmp_path))
    plan = view._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = plan[max(i for i, line in enumerate(plan) if "Window [" in line) + 1:]
    assert below and not any("_price" in line or "_disc#" in line or "_tax#" in line and "AS _tax" in line for line in below)
    got = {r["seq"]: r for r in view.collect()}
    assert sorted(got) == [8, 9]
    assert (got[8]["p1"], got[8]["p2"], got[9]["p1"]) == (100 / 8192, -201 / 8192, 503 / 8192)
    assert (got[8]["g1"], got[8]["stab"], got[9]["g2"]) == (4 / 16, 2 / 16, None)


def _orders(spark, path, orders=40):
    spark.createDataFrame([(o, n, n, 1, "1995-01-01", 100.75 * n + o, 5.0 + o % 7, 0.04, 0.06)
                           for o in range(orders) for n in range(1, 6)],
                          "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_shipdate string, "
                          "l_extendedprice double, l_quantity double, l_discount double, l_tax double"
                          ).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(o, "F" if o % 3 else "O") for o in range(orders)],
                          "o_orderkey long, o_orderstatus string").write.parquet(f"{path}/orders.parquet")
    return str(path)


def test_readings_and_their_split_get_tasks_by_their_rows(spark, monkeypatch, tmp_path):
    from ohmflow.operators import sequence
    from ohmflow.plans import catalog
    sf = _orders(spark, tmp_path)
    want = sorted(catalog.split_readings(spark, sf).collect(), key=lambda r: r["seq"])
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(sequence, "ROWS_PER_TASK", 200 // (3 * session))
    frame, seen = type(spark.range(1)), []
    fixed = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange",
                        lambda df, n, *keys: seen.append(n) or fixed(df, n, *keys))
    assert catalog.readings(spark, sf).rdd.getNumPartitions() >= 3 * session
    got = catalog.split_readings(spark, sf)
    assert max(seen) >= 3 * session
    assert sorted(got.collect(), key=lambda r: r["seq"]) == want


def test_splits_of_the_model_queries_get_tasks_by_their_rows(spark, monkeypatch, tmp_path):
    from ohmflow.operators import sequence
    from ohmflow.plans import modeling
    sf = _orders(spark, tmp_path)
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(sequence, "ROWS_PER_TASK", 200 // (3 * session))
    monkeypatch.setattr(modeling, "_features", modeling.cleaned_readings)   # narrow rows will do
    frame, seen = type(spark.range(1)), []
    fixed = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange",
                        lambda df, n, *keys: seen.append((n, keys)) or fixed(df, n, *keys))
    modeling._splits(spark, sf)
    assert [n >= 3 * session for n, keys in seen if "_u" in keys] == [True]


def test_scores_and_baseline_read_one_view_of_the_readings(spark, monkeypatch, tmp_path):
    from ohmflow.plans import catalog
    from ohmflow.sources import fixtures
    sf, made, plain = _orders(spark, tmp_path), [], fixtures.readings
    for module in (catalog, fixtures):
        monkeypatch.setattr(module, "readings", lambda *a: made.append(1) or plain(*a))
    for query, rows in ((catalog.q_export_rows, 80), (catalog.q_ensemble_metadata, 1),
                        (catalog.q_group_stress, 3)):
        made.clear()
        assert query(spark, sf).count() == rows
        assert len(made) == 1


def test_knn_searches_only_the_leaves_within_reach(spark):
    import numpy as np
    from ohmflow.operators import neighbors
    rng = np.random.default_rng(5)
    wide = rng.random((4000, 6))
    tree = neighbors._Tree(wide, 250)
    reach = np.full(len(wide), 0.05)
    row, leaf = tree.within(wide, reach)
    assert tree.leaves == 250 and len(row) < 12 * len(wide)
    home = tree.leaf(wide)
    assert np.bincount(home).max() <= 32
    seen = set(zip(row.tolist(), leaf.tolist()))
    close = np.argwhere(((wide[:300, None] - wide[None, :]) ** 2).sum(-1) <= 0.05 ** 2)
    assert all((int(i), int(home[j])) in seen for i, j in close)

    # a grid with many equal distances, copies of points and a repeated id
    pts = np.vstack([rng.integers(0, 6, (260, 3)) * 0.1, np.full((30, 3), 0.3), [[50.0, 0.0, 0.0]]])
    ids = [*range(len(pts) - 1), 7]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in zip(ids, pts)],
                               "id long, a double, b double, c double").repartition(3)
    got = {}
    for r in neighbors.knn(df, "id", ["a", "b", "c"], 4, leaf_rows=8).collect():
        got.setdefault(r.id, []).append([(x.dist, x.nid) for x in r.neighbors])
    assert sum(map(len, got.values())) == len(pts)
    for i, p in zip(ids[:-1], pts):
        if i == 7:
            continue
        d = np.zeros(len(pts))
        for c in range(3):
            d += (p[c] - pts[:, c]) ** 2
        want = sorted((float(x), j) for x, j in zip(np.sqrt(d), ids) if j != i)[:4]
        assert got[i] == [want]


def test_knn_deals_a_point_to_blocks_and_not_to_leaves(spark, monkeypatch):
    import numpy as np
    from ohmflow.operators import neighbors
    rng = np.random.default_rng(3)
    pts = rng.random((3000, 8))
    names = [f"x{i}" for i in range(8)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], ["id", *names]).repartition(4)
    frame, dealt = type(df), []
    plain = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda d, *a: dealt.append(d.count()) or plain(d, *a))
    got = {r["id"]: [x.nid for x in r["neighbors"]]
           for r in neighbors.knn(df, "id", names, 5, leaf_rows=8).collect()}
    assert len(dealt) == 4 and dealt[:2] == [3000, 3000]
    assert dealt[2] < 40 * 3000         # 375 leaves, most of them within reach
    for i in range(0, 3000, 50):
        d = ((pts - pts[i]) ** 2).sum(1)
        d[i] = np.inf
        assert got[i] == np.argsort(d, kind="stable")[:5].tolist()


def test_triangle_tasks_get_an_edge_once_a_group(spark, monkeypatch):
    from itertools import combinations

    from ohmflow.operators import graph
    edges = list(combinations(range(30), 2))
    simple = graph.simple_edges(spark.createDataFrame([(a, b, 1.0) for a, b in edges], "a long, b long, weight double"))
    monkeypatch.setattr(graph, "GROUP_EDGES", 20)
    log = spark.sparkContext.accumulator(0)
    close = graph._close_paths

    def counted(table):
        log.add(sum(len(x) for x in table["to"].to_pylist()))
        return close(table)
    monkeypatch.setattr(graph, "_close_paths", counted)
    got = {r["node"]: r["triangles"] for r in graph.triangle_sums(simple).collect()}
    assert got == {n: 29 * 28 // 2 for n in range(30)}
    groups = -(-(2 * len(edges) / 20) ** 0.5 // 1)
    assert log.value == groups * len(edges)


def test_steps_carry_work_only_for_features_that_events_name(spark):
    from ohmflow.operators import whatif
    from ohmflow.operators.common import rounded
    base = spark.createDataFrame([(1, 4.1234, 2.5678), (2, None, 1.0)], "seq long, p1 double, p2 double")
    ev = spark.createDataFrame([("a", 0, "main", "p1", 1, 3, None, "3x")], whatif.EVENT_SCHEMA)
    plain = whatif.overlay(whatif.expand_steps(base, "seq", 3), ev, 3, ["p1", "p2"])
    assert "_ev_p2" not in plan_of(plain)
    ready = base.select("seq", "p1", *[rounded(F.col(c), 2).alias(f"_base_{c}") for c in ("p1", "p2")])
    out = whatif.overlay(whatif.expand_steps(ready, "seq", 3), ev, 3, ["p1", "p2"],
                         finish=lambda v: rounded(v, 2), finished="_base_")
    want = plain.select("seq", "step", *[rounded(F.col(c), 2) for c in ("p1", "p2")]).collect()
    got = out.select("seq", "step", "p1", "_base_p2").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    assert (1, 2, 8.25, 2.57) in map(tuple, got)
    none = whatif.overlay(whatif.expand_steps(base, "seq", 3), ev.where("ordinal > 0"), 3, ["p1", "p2"])
    assert none.count() == 6 and none.columns == ["seq", "p1", "p2", "step"]


def test_tree_samples_rank_ids_alone(spark, monkeypatch):
    from ohmflow.operators import isoforest
    df = spark.range(500).select("id", *[(F.col("id") * k % 7).alias(f"x{k}") for k in range(1, 9)])
    frame, widths = type(df), []
    fixed = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda d, n, *k: widths.append(len(d.columns)) or fixed(d, n, *k))
    got = isoforest.tree_samples(df, "id", 4, 50, 42)
    assert widths == [1] and got.columns == [*df.columns, "tree"]
    rows = got.collect()
    assert all(len({r["id"] for r in rows if r["tree"] == t}) == 50 for t in range(4)) and len(rows) == 200
    assert all(r["x3"] == r["id"] * 3 % 7 for r in rows)
    twice = isoforest.tree_samples(df.unionByName(df), "id", 4, 50, 42).groupBy("tree").count().collect()
    assert [r["count"] for r in twice] == [50] * 4


def test_scaler_parameters_reach_a_row_as_two_arrays(spark):
    from ohmflow.operators import prepare
    df = spark.createDataFrame([(1, 2.0, None), (2, 4.0, 3.0)], "id int, a double, b double")
    params = spark.createDataFrame([("b", 1.0, 4.0), ("a", 2.0, 0.5)], "feature string, center double, scale double")
    out = prepare.apply_scaler(df, params, ["a", "b"])
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, 0.0, None), (2, 4.0, 0.5)]
    assert "_centers" in plan_of(out) and "a_c" not in plan_of(out).split("BroadcastExchange")[0]
