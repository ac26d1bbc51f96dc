"""Registered queries. Each reads the driver tables (or views Spark derives
from them) over whole tables and returns rounded, named columns; the oracle
SQL twin computes the same result in plain SQL over the same parquet views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, profile, temporal
from ..operators.common import materialize, round_cols, rounded
from ..schema import (FEATURE_LABELS, LAG_FEATURES, LAGS, RAW_FEATURES, ROLL_WINDOWS,
                      ROLLING_FEATURES)
from ..sources.fixtures import (SCORED_SQL, reading_tasks, readings, scored_fixture,  # noqa: F401
                                with_views)
from ..sources.tables import table
from .registry import query
from ..operators.common import round_cols  # noqa: F811
from .sqlgen import r6, union_all, unpivot_sql

R = RAW_FEATURES


def _r6(df):
    return round_cols(df, 6)


def imputed_sql(name: str = "imputed") -> str:
    """CTE: readings with medians filled in (all-rows medians, S1)."""
    cols = ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM readings)) AS {c}"
                     for c in R)
    return f",\n{name} AS (SELECT seq, {cols}, stab, stabf FROM readings)\n"


def imputed_readings(spark, sf):
    r = readings(spark, sf)
    return clean.impute_median(r, R)


# ---------------------------------------------------------------- profiles --
def _overview_sql() -> str:
    cols = [("seq", "bigint")] + [(c, "double") for c in R] + [("stab", "double"),
                                                              ("stabf", "string")]
    parts = [f"SELECT {i} AS ordinal, '{c}' AS \"column\", '{t}' AS dtype, "
             f"count(*) AS n_rows, count(*) - count({c}) AS n_null FROM readings"
             for i, (c, t) in enumerate(cols)]
    return with_views("readings") + union_all(parts)


@query("profile_overview", _overview_sql())
def q_profile_overview(spark, sf):
    return profile.profile_overview(readings(spark, sf))


@query("class_balance", with_views("readings") + """
SELECT stabf, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 3) AS share
FROM readings GROUP BY stabf""")
def q_class_balance(spark, sf):
    return profile.class_balance(readings(spark, sf), "stabf")


@query("class_histogram", with_views("readings") + f""",
long AS ({unpivot_sql('readings', ['stabf'], R)}),
rng AS (SELECT stabf, feature, min(value) AS lo, max(value) AS hi FROM long
        WHERE value IS NOT NULL GROUP BY stabf, feature)
SELECT l.stabf, l.feature,
  CAST(CASE WHEN hi - lo = 0 THEN 0
       ELSE least(floor((value - lo) / (hi - lo) * 40.0), 39) END AS INTEGER) AS bin,
  count(*) AS n, {r6('any_value(lo)')} AS lo, {r6('any_value(hi)')} AS hi
FROM long l JOIN rng USING (stabf, feature) WHERE value IS NOT NULL
GROUP BY ALL""")
def q_class_histogram(spark, sf):
    return _r6(profile.class_histogram(readings(spark, sf), R, "stabf"))


@query("correlation_pairs", with_views("readings") + union_all([
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, "
    f"{r6(f'covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)')} AS corr "
    f"FROM readings" for i, a in enumerate(R) for b in R[i + 1:]]))
def q_correlation_pairs(spark, sf):
    return _r6(profile.correlation_pairs(readings(spark, sf), R))


@query("boxplot_by_class", with_views("readings") + f""",
long AS ({unpivot_sql('readings', ['stabf'], R)}),
q AS (SELECT stabf, feature, quantile_cont(value, 0.25) AS q1,
             quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
      FROM long WHERE value IS NOT NULL GROUP BY stabf, feature)
SELECT stabf, feature, {r6('any_value(q1)')} AS q1, {r6('any_value(median)')} AS median,
  {r6('any_value(q3)')} AS q3,
  {r6('min(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END)')}
    AS whisker_low,
  {r6('max(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END)')}
    AS whisker_high,
  CAST(count_if(NOT (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS BIGINT) AS n_outliers
FROM long JOIN q USING (stabf, feature) WHERE value IS NOT NULL GROUP BY stabf, feature""")
def q_boxplot_by_class(spark, sf):
    return _r6(profile.boxplot_stats(readings(spark, sf), R, "stabf"))


# ---------------------------------------------------------------- cleaning --
@query("impute_median", with_views("readings") + imputed_sql() + "SELECT seq, "
       + ", ".join(f"{r6(c)} AS {c}" for c in R) + " FROM imputed")
def q_impute_median(spark, sf):
    return _r6(imputed_readings(spark, sf).select("seq", *R))


def _capped_sql() -> str:
    caps = ["p1", "p2", "p3", "p4", "stab"]
    b = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3"
                  for c in caps)
    sel = ", ".join(
        f"greatest(least({c}, {c}_q3 + 3 * ({c}_q3 - {c}_q1)), {c}_q1 - 3 * ({c}_q3 - {c}_q1)) AS {c}"
        for c in caps)
    return (with_views("readings") + imputed_sql()
            + f", b AS (SELECT {b} FROM imputed),\n"
            + f"capped AS (SELECT seq, tau1, tau2, tau3, tau4, {sel}, g1, g2, g3, g4, "
            + "CAST(stabf = 'unstable' AS INTEGER) AS stabf FROM imputed, b)\n")


@query("cap_iqr", _capped_sql() + "SELECT seq, " + ", ".join(f"{r6(c)} AS {c}" for c in R)
       + ", stabf FROM capped")
def q_cap_iqr(spark, sf):
    return _r6(clean.clean_readings(readings(spark, sf)))


@query("iqr_outliers", with_views("readings") + f""",
long AS ({unpivot_sql('readings', [], ['p1', 'p2', 'p3', 'p4'])}),
b AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
      FROM long WHERE value IS NOT NULL GROUP BY feature)
SELECT feature, {r6('any_value(q1)')} AS q1, {r6('any_value(q3)')} AS q3,
  {r6('any_value(q3 - q1)')} AS iqr, {r6('any_value(q1 - 3 * (q3 - q1))')} AS lower,
  {r6('any_value(q3 + 3 * (q3 - q1))')} AS upper,
  CAST(count_if(value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)) AS BIGINT) AS n_outliers
FROM long JOIN b USING (feature) GROUP BY feature""")
def q_iqr_outliers(spark, sf):
    return _r6(clean.outlier_counts(readings(spark, sf), ["p1", "p2", "p3", "p4"]))


@query("drop_null_rows", with_views("readings") + """
SELECT count(*) AS n_rows,
  CAST(count_if(""" + " AND ".join(f"{c} IS NOT NULL" for c in R) + """) AS BIGINT) AS n_kept,
  CAST(count_if(""" + " OR ".join(f"{c} IS NULL" for c in R) + """) AS BIGINT) AS n_dropped
FROM readings""")
def q_drop_null_rows(spark, sf):
    r = readings(spark, sf)
    clean.require_columns(r, R)
    return clean.null_drop_summary(r, R)


# ---------------------------------------------------------------- temporal --
def temporal_sql(src: str, keys: list[str], order: list[str], rolling, lag_cols,
                 windows=ROLL_WINDOWS, lags=LAGS, rate=True) -> list[str]:
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    w = f"({part}ORDER BY {', '.join(order)})"
    out = []
    for c in rolling:
        for n in windows:
            fr = f"({part}ORDER BY {', '.join(order)} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
            out += [f"{r6(f'avg({c}) OVER {fr}')} AS roll_mean_{c}_w{n}",
                    f"{r6(f'coalesce(stddev_samp({c}) OVER {fr}, 0)')} AS roll_std_{c}_w{n}",
                    f"{r6(f'min({c}) OVER {fr}')} AS roll_min_{c}_w{n}",
                    f"{r6(f'max({c}) OVER {fr}')} AS roll_max_{c}_w{n}"]
    if rate:
        out += [f"{r6(f'coalesce({c} - lag({c}, 1) OVER {w}, 0)')} AS roc_{c}" for c in rolling]
    cnt = f"count(*) OVER ({part.strip()})" if keys else "count(*) OVER ()"
    for c in lag_cols:
        for k in lags:
            out.append(r6(f"CASE WHEN row_number() OVER {w} <= {k} THEN "
                          f"(CASE WHEN {cnt} <= {k} THEN {c} ELSE first_value({c}) OVER {w} END) "
                          f"ELSE lag({c}, {k}) OVER {w} END") + f" AS lag{k}_{c}")
    return out


_EV_KEYS, _EV_ORDER = ["user_id"], ["ts", "event_id"]


def _events_temporal(spark, sf, rolling, lag_cols, rate, windows=ROLL_WINDOWS):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    out = temporal.temporal_features(ev, _EV_ORDER, _EV_KEYS, rolling=rolling,
                                     lag_cols=lag_cols, windows=windows, rate=rate)
    names = temporal.feature_names(rolling, lag_cols, windows, LAGS, rate)
    return _r6(out.select("event_id", "user_id", *names))


def _ev_sql(rolling, lag_cols, rate):
    cols = temporal_sql("events", _EV_KEYS, _EV_ORDER, rolling, lag_cols, rate=rate)
    return f"SELECT event_id, user_id, {', '.join(cols)} FROM events"


@query("rolling_stats", _ev_sql(["value"], [], False))
def q_rolling_stats(spark, sf):
    return _events_temporal(spark, sf, ["value"], [], False)


@query("rate_of_change", "SELECT event_id, user_id, "
       + r6("coalesce(value - lag(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0)")
       + " AS roc_value FROM events")
def q_rate_of_change(spark, sf):
    return _events_temporal(spark, sf, ["value"], [], True, windows=[]) \
        .select("event_id", "user_id", "roc_value")


@query("lag_features", _ev_sql([], ["value"], False))
def q_lag_features(spark, sf):
    return _events_temporal(spark, sf, [], ["value"], False)


_TEMPORAL_NAMES = temporal.feature_names(ROLLING_FEATURES, LAG_FEATURES)


def _readings_temporal_sql() -> str:
    cols = temporal_sql("imputed", [], ["seq"], ROLLING_FEATURES, LAG_FEATURES)
    return (with_views("readings") + imputed_sql()
            + f"SELECT seq, {', '.join(cols)} FROM imputed")


@query("temporal_all", _readings_temporal_sql())
def q_temporal_all(spark, sf):
    r = imputed_readings(spark, sf)
    out = temporal.temporal_features(r, ["seq"])
    return _r6(out.select("seq", *_TEMPORAL_NAMES))


@query("halo_rolling", _readings_temporal_sql())
def q_halo_rolling(spark, sf):
    # Small blocks so that the look-back/look-ahead copies are exercised on
    # every block boundary of the test tables; results are independent of it.
    r = imputed_readings(spark, sf)
    out = temporal.temporal_features(r, ["seq"], block_rows=997)
    return _r6(out.select("seq", *_TEMPORAL_NAMES))


# ------------------------------------------------------- baseline & alerts --
from ..operators import alerts, graph  # noqa: E402
from ..operators.baseline import baseline_stats, feature_ranges, with_zscores  # noqa: E402
from ..functions.scalar import risk_tier  # noqa: E402
from .flagship import FLAGSHIP_SQL, flagship  # noqa: E402


def cleaned_readings(spark, sf, rows=None):
    """``rows``: the readings, where a query has them written already."""
    return clean.clean_readings(readings(spark, sf) if rows is None else rows)


from ..operators import prepare  # noqa: E402


def _u_sql(id_col: str = "seq", seed: int = 42) -> str:
    return (f"(('0x' || substr(md5(CAST({id_col} AS VARCHAR) || '|' || '{seed}'), 1, 8))"
            f"::BIGINT / 4294967296.0)")


_SPLIT_SQL = _capped_sql() + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY stabf ORDER BY {_u_sql()}, seq) - 1 AS rk,
                  count(*) OVER (PARTITION BY stabf) AS n FROM capped),
splits AS (SELECT *, CASE WHEN rk < round(n * 0.15) THEN 'test'
    WHEN rk < round(n * 0.15) + round((n - round(n * 0.15)) * 0.1765) THEN 'val'
    ELSE 'train' END AS split FROM ranked)
"""


def split_readings(spark, sf, rows=None):
    return prepare.stratified_split(cleaned_readings(spark, sf, rows), "stabf", "seq",
                                    num_partitions=reading_tasks(spark, sf))


def stable_baseline(spark, sf, rows=None, quartiles=True):
    """Statistics of the stable rows of the train split. Without quartiles, which
    z-scores do not use, features without any value are left out as with them."""
    train = split_readings(spark, sf, rows).where(F.col("split") == "train")
    stats = baseline_stats(train, R, label="stabf", stable_value=0, quartiles=quartiles)
    return stats if quartiles else stats.where(F.col("mean").isNotNull())


def scored_validation(spark, sf):
    """The scores and labels of the validation split, by id, written once. A row's
    split depends on its class and id alone, so no other column goes with the ranking."""
    r = readings(spark, sf)
    split = prepare.stratified_split(cleaned_readings(spark, sf, r).select("seq", "stabf"), "stabf",
                                     "seq", num_partitions=reading_tasks(spark, sf))
    val_ids = split.where(F.col("split") == "val").select("seq")
    return materialize(scored_fixture(spark, sf, r).select("seq", "_true_label", "RF_prob", "XGBoost_prob")
                       .join(val_ids, "seq").drop("seq"))


_STATS_SQL = _SPLIT_SQL + f""",
stable_long AS ({unpivot_sql("splits WHERE split = 'train' AND stabf = 0", [], R)}),
stats AS (SELECT feature, avg(value) AS mean, greatest(stddev_samp(value), 1e-6) AS std,
                 quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75,
                 min(value) AS min, max(value) AS max
          FROM stable_long GROUP BY feature)
"""


@query("flagship_critical", FLAGSHIP_SQL)
def q_flagship(spark, sf):
    return flagship(spark, sf)


@query("stable_stats", _STATS_SQL + "SELECT feature, " + ", ".join(
    f"{r6(c)} AS {c}" for c in ("mean", "std", "p25", "p75", "min", "max")) + " FROM stats")
def q_stable_stats(spark, sf):
    return _r6(stable_baseline(spark, sf))


@query("feature_ranges", _STATS_SQL + "SELECT feature, " + ", ".join(
    f"(round({c} * 10000.0) / 10000.0 + 0.0) AS {c}" for c in ("min", "max", "p25", "p75", "mean"))
    + " FROM stats")
def q_feature_ranges(spark, sf):
    return feature_ranges(stable_baseline(spark, sf))


_Z_SQL = _STATS_SQL + f""",
zl AS (SELECT c.seq, c.stabf, l.feature, (l.value - s.mean) / s.std AS z
       FROM ({unpivot_sql('capped', ['seq', 'stabf'], R)}) l
       JOIN capped c USING (seq) JOIN stats s USING (feature))
"""


def zscored(spark, sf):
    """All readings against the baseline of the train split; one cleaned table for both."""
    rows = split_readings(spark, sf)
    base = baseline_stats(rows.where(F.col("split") == "train"), R, label="stabf", stable_value=0,
                          quartiles=False)
    return with_zscores(rows.drop("split"), base, R)


@query("zscores_long", _STATS_SQL + f"""
SELECT l.seq, l.feature, {r6('(l.value - s.mean) / s.std')} AS z
FROM ({unpivot_sql('capped', ['seq'], R)}) l JOIN stats s USING (feature)""")
def q_zscores_long(spark, sf):
    z = zscored(spark, sf)
    return _r6(z.select("seq", *[F.col(f"z_{c}").alias(c) for c in R])
               .unpivot(["seq"], R, "feature", "z"))


@query("top_deviations", _STATS_SQL + f""",
zl AS (SELECT l.seq, l.feature, (l.value - s.mean) / s.std AS z,
         list_position({R!r}, l.feature) AS o
       FROM ({unpivot_sql('capped', ['seq'], R)}) l JOIN stats s USING (feature))
SELECT seq, rank, feature, {r6('round(z * 100.0) / 100.0')} AS z_score FROM (
  SELECT *, row_number() OVER (PARTITION BY seq ORDER BY abs(z) DESC, o) AS rank FROM zl)
WHERE rank <= 3""")
def q_top_deviations(spark, sf):
    z = zscored(spark, sf)
    top = alerts.top_deviations([f"z_{c}" for c in R])
    return (z.select("seq", F.posexplode(top).alias("rank", "d"))
            .select("seq", (F.col("rank") + 1).cast("long").alias("rank"),
                    F.col("d.feature").alias("feature"),
                    F.col("d.z_score").alias("z_score")))


def _node_sql() -> str:
    parts = []
    for node, tau, p, g in [(0, "tau1", "p1", "g1"), (1, "tau2", "p2", "g2"),
                            (2, "tau3", "p3", "g3"), (3, "tau4", "p4", "g4")]:
        plabel = "Power Output" if node == 0 else "Power Demand"
        parts.append(f"""SELECT seq, {node} AS node, z_{tau} AS zt, z_{p} AS zp, z_{g} AS zg,
          '{plabel}' AS plabel FROM zw""")
    piv = ", ".join(f"max(CASE WHEN feature = '{c}' THEN z END) AS z_{c}" for c in R)
    return _Z_SQL + f""",
zw AS (SELECT seq, {piv} FROM zl GROUP BY seq),
nodes AS ({union_all(parts)}),
k AS (SELECT *, CASE WHEN abs(zt) >= 1.5 THEN abs(zt) ELSE -1 END AS at_,
        CASE WHEN abs(zp) >= 1.5 THEN abs(zp) ELSE -1 END AS ap_,
        CASE WHEN abs(zg) >= 1.5 THEN abs(zg) ELSE -1 END AS ag_ FROM nodes),
worst AS (SELECT *,
  CASE WHEN at_ >= 0 AND at_ >= ap_ AND at_ >= ag_ THEN 'Reaction Time'
       WHEN ap_ >= 0 AND ap_ >= ag_ THEN plabel
       WHEN ag_ >= 0 THEN 'Grid Cooperation' END AS wl,
  CASE WHEN at_ >= 0 AND at_ >= ap_ AND at_ >= ag_ THEN zt
       WHEN ap_ >= 0 AND ap_ >= ag_ THEN zp
       WHEN ag_ >= 0 THEN zg END AS wz FROM k)
SELECT seq, node, {r6('greatest(abs(zt), abs(zp), abs(zg))')} AS max_abs_z,
  CASE WHEN greatest(abs(zt), abs(zp), abs(zg)) < 1.5 THEN 'Normal'
       WHEN greatest(abs(zt), abs(zp), abs(zg)) < 2.5 THEN 'Elevated' ELSE 'Critical' END AS status,
  wl AS worst_sensor,
  CASE WHEN wl IS NULL THEN NULL WHEN abs(wz) >= 2.5 THEN 'Critical' ELSE 'Elevated' END
    AS alert_tier,
  CASE WHEN wl IS NULL THEN NULL ELSE printf('%s is %s (%.2fσ)', wl,
       CASE WHEN wz > 0 THEN 'too high' ELSE 'too low' END, round(wz * 100.0) / 100.0) END
    AS message
FROM worst"""


@query("node_status", _node_sql())
def q_node_status(spark, sf):
    z = zscored(spark, sf)
    return _r6(alerts.node_status(z, ["seq"]))


@query("risk_tier", with_views("scored_fixture") + f"""
SELECT seq, {r6('RF_prob')} AS RF_prob, {r6('XGBoost_prob')} AS XGBoost_prob,
  {r6('ensemble_prob')} AS ensemble_prob, ensemble_label, risk_tier FROM scored_fixture""")
def q_risk_tier(spark, sf):
    s = scored_fixture(spark, sf)
    return _r6(s.select("seq", "RF_prob", "XGBoost_prob", "ensemble_prob", "ensemble_label",
                        risk_tier(F.col("ensemble_prob")).alias("risk_tier")))


@query("recent_history", f"""
SELECT event_id, user_id,
  count(*) OVER w AS hist_len, {r6('sum(value) OVER w')} AS hist_sum,
  {r6('max(value) OVER w')} AS hist_max
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
                         ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def q_recent_history(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    h = temporal.recent_history(ev, ["ts", "event_id"], ["user_id"], "value", rows=60)
    return _r6(h.select("event_id", "user_id", F.size("history").cast("long").alias("hist_len"),
                        F.aggregate("history", F.lit(0.0), lambda a, x: a + x).alias("hist_sum"),
                        F.array_max("history").alias("hist_max")))


@query("sticky_alert", f"""
WITH s AS (SELECT avg(value) AS m, greatest(stddev_samp(value), 1e-6) AS sd FROM events),
e AS (SELECT event_id, user_id, ts, (value - m) / sd AS z FROM events, s),
b AS (SELECT *, abs(z) >= 1.5 AS breach,
        CASE WHEN abs(z) >= 1.5 THEN printf('%s is %s (%.2fσ)', 'Reading',
             CASE WHEN z > 0 THEN 'too high' ELSE 'too low' END, round(z * 100.0) / 100.0) END
          AS msg, epoch_us(ts) AS t FROM e)
SELECT event_id, user_id,
  last_value(msg IGNORE NULLS) OVER w AS active_alert,
  {r6('(t - last_value(CASE WHEN breach THEN t END IGNORE NULLS) OVER w) / 1000000.0')}
    AS alert_age_s
FROM b WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 10000000 PRECEDING
                    AND CURRENT ROW)""")
def q_sticky_alert(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    base = baseline_stats(ev, ["value"], label=None, quartiles=False)
    z = with_zscores(ev, base, ["value"])
    zc = F.col("z_value")
    breach = F.abs(zc) >= F.lit(1.5)
    msg = F.format_string("%s is %s (%.2fσ)", F.lit("Reading"),
                          F.when(zc > 0, F.lit("too high")).otherwise(F.lit("too low")),
                          round_cols_expr(zc))
    out = alerts.sticky_alert(z, "ts", ["user_id"], breach, msg)
    return _r6(out.select("event_id", "user_id", "active_alert", "alert_age_s"))


def round_cols_expr(c):
    from ..operators.common import rounded
    return rounded(c, 2)


def _edge_sql() -> str:
    loads = [f"least(abs(p{i + 1}) / (abs(g1) + abs(g{i + 1}) + 1e-9), 1.0)" for i in (1, 2, 3)]
    cols = [f"{3 if n == 0 else 1} AS node{n}_degree, "
            f"CAST({1.0 if n == 0 else 0.0} AS DOUBLE) AS node{n}_betweenness, "
            f"CAST(0.0 AS DOUBLE) AS node{n}_clustering" for n in range(4)]
    cols += [f"{r6(l)} AS edge_load_0_{i}" for i, l in zip((1, 2, 3), loads)]
    cols.append(f"{r6('(' + ' + '.join(loads) + ') / 3.0')} AS avg_edge_load")
    return _capped_sql() + "SELECT seq, " + ", ".join(cols) + " FROM capped"


@query("edge_load", _edge_sql())
def q_edge_load(spark, sf):
    g = graph.graph_features(cleaned_readings(spark, sf))
    return _r6(g.select("seq", *graph.GRAPH_FEATURES))


@query("node_degree", _capped_sql() + """
SELECT seq, node, count(*) AS degree FROM (
  SELECT seq, unnest([0, 0, 0, 1, 2, 3]) AS node FROM capped) GROUP BY seq, node""")
def q_node_degree(spark, sf):
    return graph.node_degree(graph.grid_edges(cleaned_readings(spark, sf)))


@query("supplier_clustering", f"""
WITH l AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem),
e AS (SELECT x.s AS a, y.s AS b, CAST(count(*) AS DOUBLE) AS weight
      FROM l x JOIN l y ON x.o = y.o AND x.s < y.s GROUP BY x.s, y.s),
top AS (SELECT max(weight) AS top FROM e),
t AS (SELECT x.a AS u, x.b AS v, y.b AS w, cbrt(x.weight * y.weight * z.weight) / top AS g
      FROM e x JOIN e y ON x.a = y.a AND x.b < y.b JOIN e z ON z.a = x.b AND z.b = y.b, top),
each AS (SELECT node, count(*) AS triangles, sum(g) AS s FROM (SELECT unnest([u, v, w]) AS node, g FROM t) GROUP BY node),
d AS (SELECT node, count(*) AS degree FROM (SELECT unnest([a, b]) AS node FROM e) GROUP BY node)
SELECT node, degree, coalesce(triangles, 0) AS triangles, {r6("CASE WHEN degree > 1 THEN "
  "2.0 * coalesce(s, 0.0) / (degree * (degree - 1)) ELSE 0.0 END")} AS clustering
FROM d LEFT JOIN each USING (node)""")
def q_supplier_clustering(spark, sf):
    """F10 on a graph with triangles: suppliers are linked by the orders they share
    (an order's suppliers are a set of at most its lines)."""
    order = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(
        F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    edges = order.select(F.inline(pairs)).withColumn("weight", F.lit(1))
    return _r6(graph.weighted_clustering(edges))


# -------------------------------------------------------------- preparation --


@query("stratified_split", _SPLIT_SQL + "SELECT seq, stabf, split FROM splits")
def q_stratified_split(spark, sf):
    return split_readings(spark, sf).select("seq", "stabf", "split")


@query("split_summary", _SPLIT_SQL + f"""
SELECT split, count(*) AS n, {r6('avg(stabf)')} AS positive_rate FROM splits GROUP BY split""")
def q_split_summary(spark, sf):
    from ..operators.profile import split_sizes
    return _r6(split_sizes(split_readings(spark, sf), "split", "stabf"))


@query("stratified_split_80_20", _capped_sql() + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY stabf ORDER BY {_u_sql()}, seq) - 1 AS rk,
                  count(*) OVER (PARTITION BY stabf) AS n FROM capped)
SELECT seq, stabf, CASE WHEN rk < round(n * 0.2) THEN 'test' ELSE 'train' END AS split
FROM ranked""")
def q_split_80_20(spark, sf):
    return prepare.stratified_split(cleaned_readings(spark, sf), "stabf", "seq",
                                    num_partitions=reading_tasks(spark, sf),
                                    test=0.2, val=0.0).select("seq", "stabf", "split")


@query("kfold_ids", _capped_sql() + f"""
SELECT seq, stabf, CAST((row_number() OVER (PARTITION BY stabf ORDER BY {_u_sql()}, seq) - 1)
       % 5 AS INTEGER) AS fold FROM capped""")
def q_kfold_ids(spark, sf):
    return prepare.stratified_folds(cleaned_readings(spark, sf), "stabf", "seq",
                                    num_partitions=reading_tasks(spark, sf)) \
        .select("seq", "stabf", "fold")


@query("timeseries_folds", with_views("readings") + """,
o AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS position, count(*) OVER () AS n
      FROM readings),
p AS (SELECT *, n - 5 * (n // 6) AS s0, n // 6 AS t FROM o)
SELECT seq, position,
  CAST(CASE WHEN position >= s0 THEN floor((position - s0) / t) END AS INTEGER) AS test_fold,
  CAST(CASE WHEN greatest(0, floor((position - s0) / t) + 1) < 5
       THEN greatest(0, floor((position - s0) / t) + 1) END AS INTEGER) AS first_train_fold
FROM p""")
def q_timeseries_folds(spark, sf):
    return prepare.time_series_folds(readings(spark, sf).select("seq"), ["seq"]) \
        .select("seq", "position", "test_fold", "first_train_fold")


def _scale_sql(kind: str) -> str:
    if kind == "std":
        fit = ", ".join(f"avg({c}) AS {c}_c, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 "
                        f"ELSE stddev_pop({c}) END AS {c}_s" for c in R)
    else:
        fit = ", ".join(f"min({c}) AS {c}_c, CASE WHEN max({c}) - min({c}) = 0 THEN 1.0 "
                        f"ELSE max({c}) - min({c}) END AS {c}_s" for c in R)
    cols = ", ".join(f"{r6(f'({c} - {c}_c) / {c}_s')} AS {c}" for c in R)
    return (_SPLIT_SQL + f", params AS (SELECT {fit} FROM splits WHERE split = 'train')\n"
            + f"SELECT seq, split, {cols} FROM splits, params")


def _scaled(spark, sf, kind):
    s = split_readings(spark, sf)
    train = s.where(F.col("split") == "train")
    params = prepare.fit_standard(train, R) if kind == "std" else prepare.fit_minmax(train, R)
    return _r6(prepare.apply_scaler(s, params, R).select("seq", "split", *R))


@query("standard_scale", _scale_sql("std"))
def q_standard_scale(spark, sf):
    return _scaled(spark, sf, "std")


@query("minmax_scale", _scale_sql("mm"))
def q_minmax_scale(spark, sf):
    return _scaled(spark, sf, "mm")


def _scaled_means_sql() -> str:
    base = _scale_sql("std").replace("SELECT seq, split, ", ", scaled AS (SELECT seq, split, ", 1)
    base = base.replace(", params AS", ", params AS", 1) + " WHERE split = 'train')\n"
    parts = [f"SELECT '{c}' AS feature, (round(avg({c}) * 10000.0) / 10000.0 + 0.0) AS mean "
             f"FROM scaled" for c in R]
    return base + union_all(parts)


@query("scaled_means", _scaled_means_sql())
def q_scaled_means(spark, sf):
    """Means of the standard-scaled train columns (≈ 0), 4 decimals."""
    from ..operators.common import rounded
    from ..operators.profile import column_means
    s = split_readings(spark, sf)
    train = s.where(F.col("split") == "train")
    scaled = prepare.apply_scaler(train, prepare.fit_standard(train, R), R)
    m = column_means(scaled, R)
    return m.select("feature", (rounded(F.col("mean"), 4) + F.lit(0.0)).alias("mean"))


# ------------------------------------------------------------------ metrics --
from ..operators import metrics  # noqa: E402

MODELS = ["RF_prob", "XGBoost_prob", "ensemble_prob"]


def scored_long(spark, sf):
    s = scored_fixture(spark, sf)
    return s.select("seq", "_true_label", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).alias("prob")) for m in MODELS])))


_LONG_SQL = with_views("scored_fixture") + f""",
long AS ({union_all([f"SELECT seq, _true_label AS y, '{m}' AS model, {m} AS prob FROM scored_fixture"
                     for m in MODELS])})
"""


def _curve_sql(src: str, by: str, c: str = "c", prob: str = "prob") -> str:
    """CTE ``c``: per (by, distinct score) running TP/FP (descending) and totals."""
    part = f"PARTITION BY {by} " if by else ""
    grp = f"{by}, " if by else ""
    return f""",
{c}_st AS (SELECT {grp}{prob} AS score, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY ALL),
{c} AS (SELECT *, sum(pos) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
        sum(neg) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_neg,
        sum(pos) OVER ({part.strip()}) AS P, sum(neg) OVER ({part.strip()}) AS N FROM {c}_st)
"""


@query("confusion_matrix", with_views("scored_fixture") + """,
cells AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(truth, predicted)),
cnt AS (SELECT _true_label AS truth, ensemble_label AS predicted, count(*) AS n
        FROM scored_fixture GROUP BY ALL)
SELECT truth, predicted, coalesce(n, 0) AS n FROM cells LEFT JOIN cnt USING (truth, predicted)""")
def q_confusion_matrix(spark, sf):
    return metrics.confusion(scored_fixture(spark, sf), "_true_label", "ensemble_label")


def _report_sql() -> str:
    def sr(a, b):
        return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END"
    p0, r0 = sr("tn", "tn + fn"), sr("tn", "tn + fp")
    p1, r1 = sr("tp", "tp + fp"), sr("tp", "tp + fn")

    def f(p, r):
        return f"CASE WHEN ({p}) + ({r}) = 0 THEN 0.0 ELSE 2.0 * ({p}) * ({r}) / (({p}) + ({r})) END"
    f0, f1 = f(p0, r0), f(p1, r1)
    tot = "(tp + fp + fn + tn)"
    s0, s1 = "(tn + fp)", "(tp + fn)"
    rows = [
        f"SELECT '0' AS class, {r6(p0)} AS precision, {r6(r0)} AS recall, {r6(f0)} AS f1, "
        f"CAST({s0} AS BIGINT) AS support FROM k",
        f"SELECT '1', {r6(p1)}, {r6(r1)}, {r6(f1)}, CAST({s1} AS BIGINT) FROM k",
        f"SELECT 'accuracy', NULL, NULL, {r6(sr('tp + tn', tot))}, CAST({tot} AS BIGINT) FROM k",
        f"SELECT 'macro avg', {r6(f'(({p0}) + ({p1})) / 2')}, {r6(f'(({r0}) + ({r1})) / 2')}, "
        f"{r6(f'(({f0}) + ({f1})) / 2')}, CAST({tot} AS BIGINT) FROM k",
        f"SELECT 'weighted avg', {r6(sr(f'({p0}) * {s0} + ({p1}) * {s1}', tot))}, "
        f"{r6(sr(f'({r0}) * {s0} + ({r1}) * {s1}', tot))}, "
        f"{r6(sr(f'({f0}) * {s0} + ({f1}) * {s1}', tot))}, CAST({tot} AS BIGINT) FROM k"]
    return with_views("scored_fixture") + """,
k AS (SELECT CAST(count_if(_true_label = 1 AND ensemble_label = 1) AS BIGINT) AS tp,
             CAST(count_if(_true_label = 0 AND ensemble_label = 1) AS BIGINT) AS fp,
             CAST(count_if(_true_label = 1 AND ensemble_label = 0) AS BIGINT) AS fn,
             CAST(count_if(_true_label = 0 AND ensemble_label = 0) AS BIGINT) AS tn FROM scored_fixture)
""" + union_all(rows)


@query("classification_report", _report_sql())
def q_classification_report(spark, sf):
    return _r6(metrics.classification_report(scored_fixture(spark, sf), "_true_label",
                                             "ensemble_label"))


_BIN_SQL = """
SELECT {r6acc} AS accuracy, {f1s} AS f1_stable, {f1u} AS f1_unstable, {mcc} AS mcc FROM k"""


@query("binary_metrics", with_views("scored_fixture") + """,
k AS (SELECT CAST(CAST(count_if(_true_label = 1 AND ensemble_label = 1) AS BIGINT) AS DOUBLE) AS tp,
             CAST(CAST(count_if(_true_label = 0 AND ensemble_label = 1) AS BIGINT) AS DOUBLE) AS fp,
             CAST(CAST(count_if(_true_label = 1 AND ensemble_label = 0) AS BIGINT) AS DOUBLE) AS fn,
             CAST(CAST(count_if(_true_label = 0 AND ensemble_label = 0) AS BIGINT) AS DOUBLE) AS tn
      FROM scored_fixture)
SELECT """ + ", ".join([
    f"{r6('(tp + tn) / (tp + tn + fp + fn)')} AS accuracy",
    f"{r6('2 * tn / (2 * tn + fp + fn)')} AS f1_stable",
    f"{r6('2 * tp / (2 * tp + fp + fn)')} AS f1_unstable",
    r6("CASE WHEN sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) = 0 THEN 0.0 ELSE "
       "(tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END") + " AS mcc"])
    + " FROM k")
def q_binary_metrics(spark, sf):
    return _r6(metrics.binary_metrics(scored_fixture(spark, sf), "_true_label", "ensemble_label"))


@query("roc_auc", _LONG_SQL + _curve_sql("long", "model") + f"""
SELECT model, {r6('sum(neg * (2 * cum_pos - pos) / 2.0) / (any_value(P) * any_value(N))')}
  AS roc_auc FROM c GROUP BY model""")
def q_roc_auc(spark, sf):
    return _r6(metrics.roc_auc(scored_long(spark, sf), "_true_label", "prob", by=["model"]))


@query("average_precision", _LONG_SQL + _curve_sql("long", "model") + f"""
SELECT model, {r6('sum(pos * (cum_pos / (cum_pos + cum_neg))) / any_value(P)')}
  AS average_precision FROM c GROUP BY model""")
def q_average_precision(spark, sf):
    return _r6(metrics.average_precision(scored_long(spark, sf), "_true_label", "prob",
                                         by=["model"]))


_EV_LONG = """
WITH ev AS (SELECT CAST(event_type = 'error' AS INTEGER) AS y, value AS prob FROM events)"""


@query("roc_auc_events", _EV_LONG + _curve_sql("ev", "") + f"""
SELECT {r6('sum(neg * (2 * cum_pos - pos) / 2.0) / (any_value(P) * any_value(N))')} AS roc_auc,
  {r6('sum(pos * (cum_pos / (cum_pos + cum_neg))) / any_value(P)')} AS average_precision
FROM c""")
def q_roc_auc_events(spark, sf):
    ev = table(spark, sf, "events").select(
        (F.col("event_type") == "error").cast("int").alias("y"), F.col("value").alias("prob"))
    roc = metrics.roc_auc(ev, "y", "prob")
    ap = metrics.average_precision(ev, "y", "prob")
    return _r6(attach_row_df(roc, ap))


def attach_row_df(a, b):
    from ..operators.common import attach_row
    return attach_row(a, b)


@query("best_threshold", _LONG_SQL + _curve_sql("long", "model") + f""",
pr AS (SELECT model, score AS threshold, cum_pos / (cum_pos + cum_neg) AS precision,
         cum_pos / P AS recall FROM c),
f AS (SELECT *, 2.0 * precision * recall / (precision + recall + 1e-12) AS f1 FROM pr)
SELECT model, {r6('threshold')} AS threshold, {r6('precision')} AS precision,
  {r6('recall')} AS recall, {r6('f1')} AS f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY recall >= 0.9 DESC, f1 DESC,
                               threshold) AS rk FROM f) WHERE rk = 1""")
def q_best_threshold(spark, sf):
    return _r6(metrics.best_threshold(scored_long(spark, sf), "_true_label", "prob",
                                      by=["model"]))


@query("calibration_curve", with_views("scored_fixture") + """,
e AS (SELECT """ + ", ".join(f"quantile_cont(ensemble_prob, {i / 10}) AS e{i}"
                             for i in range(1, 10)) + """ FROM scored_fixture),
b AS (SELECT _true_label, ensemble_prob, """ + " + ".join(
    f"CAST(ensemble_prob > e{i} AS INTEGER)" for i in range(1, 10)) + """ AS bin
      FROM scored_fixture, e)
SELECT bin, """ + r6("avg(ensemble_prob)") + " AS mean_predicted_probability, "
       + r6("avg(_true_label)") + """ AS fraction_of_positives, count(*) AS n
FROM b GROUP BY bin""")
def q_calibration_curve(spark, sf):
    return _r6(metrics.calibration_curve(scored_fixture(spark, sf), "_true_label",
                                         "ensemble_prob"))


@query("cluster_naming", with_views("scored_fixture") + f"""
SELECT cluster_id, {r6('fault_rate')} AS fault_rate, rank,
  coalesce(['normal operation', 'pre-fault stress', 'active fault'][rank], 'unknown') AS name
FROM (SELECT cluster_id, avg(_true_label) AS fault_rate,
        row_number() OVER (ORDER BY avg(_true_label), cluster_id) AS rank
      FROM scored_fixture GROUP BY cluster_id)""")
def q_cluster_naming(spark, sf):
    from ..schema import CLUSTER_NAMES
    c = metrics.cluster_names(scored_fixture(spark, sf), "cluster_id", "_true_label",
                              CLUSTER_NAMES)
    return _r6(c.withColumn("rank", F.col("rank").cast("long")))


# ---------------------------------------------------------------- dashboard --
from ..operators import dashboard  # noqa: E402


def _feed(spark, sf):
    return dashboard.feed_order(scored_fixture(spark, sf))


_FEED_SQL = with_views("scored_fixture") + """,
feed AS (SELECT *, row_number() OVER (ORDER BY ensemble_prob, seq) AS row FROM scored_fixture)
"""


@query("upload_summary", with_views("scored_fixture") + """
SELECT count(*) AS total_rows, CAST(sum(ensemble_label) AS BIGINT) AS fault_count,
  CAST(count_if(ensemble_label = 0) AS BIGINT) AS stable_count,
  (round(100.0 * sum(ensemble_label) / count(*) * 10.0) / 10.0 + 0.0) AS fault_pct,
  (round(avg(ensemble_prob) * 10000.0) / 10000.0 + 0.0) AS mean_prob,
  (round(max(ensemble_prob) * 10000.0) / 10000.0 + 0.0) AS max_prob,
  (round(min(ensemble_prob) * 10000.0) / 10000.0 + 0.0) AS min_prob,
  CAST(count_if(risk_tier = 'Green') AS BIGINT) AS tier_green, CAST(count_if(risk_tier = 'Amber') AS BIGINT) AS tier_amber,
  CAST(count_if(risk_tier = 'Red') AS BIGINT) AS tier_red,
  (SELECT CAST(count_if(""" + " OR ".join(f"{c} IS NULL" for c in R) + """) AS BIGINT) FROM readings)
    AS rows_dropped
FROM scored_fixture WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in R))
def q_upload_summary(spark, sf):
    s = scored_fixture(spark, sf)
    return dashboard.upload_summary(readings(spark, sf), clean.drop_null_rows(s, R))


@query("tier_mix", with_views("scored_fixture") + """
SELECT t.name, t.ordinal, coalesce(c.value, 0) AS value
FROM (VALUES ('Green', 0), ('Amber', 1), ('Red', 2)) t(name, ordinal)
LEFT JOIN (SELECT risk_tier AS name, count(*) AS value FROM scored_fixture GROUP BY 1) c
USING (name)""")
def q_tier_mix(spark, sf):
    return dashboard.tier_mix(scored_fixture(spark, sf))


@query("cluster_mix", with_views("scored_fixture") + f"""
SELECT kmeans_cluster AS name, count(*) AS value,
  {r6('count(*) / (SELECT count(*) FROM scored_fixture)')} AS pct
FROM scored_fixture GROUP BY kmeans_cluster""")
def q_cluster_mix(spark, sf):
    return _r6(dashboard.cluster_mix(scored_fixture(spark, sf)))


@query("feed_summary", _FEED_SQL + f"""
SELECT {r6('avg(CAST(ensemble_label = _true_label AS DOUBLE))')} AS accuracy,
  {r6('avg(ensemble_label)')} AS fault_rate, {r6('avg(_true_label)')} AS true_fault_rate,
  {r6('avg(ensemble_prob)')} AS mean_prob, {r6('greatest(max(ensemble_prob), 0.0)')} AS max_prob,
  CAST(CASE WHEN max(ensemble_prob) > 0 THEN arg_max(row, (ensemble_prob, -row)) ELSE 0 END
       AS BIGINT) AS max_row,
  CAST(round(avg(RF_prob) * 100.0) AS BIGINT) AS rf_pct,
  CAST(round(avg(XGBoost_prob) * 100.0) AS BIGINT) AS xgb_pct,
  CAST(round(avg(ensemble_prob) * 100.0) AS BIGINT) AS ensemble_pct,
  {r6('avg(IF_anomaly_score)')} AS anomaly_mean
FROM feed""")
def q_feed_summary(spark, sf):
    return _r6(dashboard.feed_summary(_feed(spark, sf)))


_STRESS_SQL = _STATS_SQL + "," + SCORED_SQL + f""",
sl AS ({unpivot_sql('scored_fixture', ['seq'], R)}),
az AS (SELECT sl.feature, abs((coalesce(sl.value, s.mean) - s.mean) / greatest(s.std, 1e-6))
         AS abs_z FROM sl JOIN stats s USING (feature))
"""


@query("sensor_stress", _STRESS_SQL + """
SELECT feature, (round(avg(abs_z) * 100.0) / 100.0 + 0.0) AS mean,
  (round(max(abs_z) * 100.0) / 100.0 + 0.0) AS max FROM az GROUP BY feature""")
def q_sensor_stress(spark, sf):
    r = readings(spark, sf)
    return dashboard.sensor_stress(scored_fixture(spark, sf, r),
                                   stable_baseline(spark, sf, r, quartiles=False))


@query("group_stress", _STRESS_SQL + """
SELECT regexp_replace(feature, '[0-9]', '', 'g') AS "group",
  (round(avg(abs_z) * 100.0) / 100.0 + 0.0) AS stress,
  CASE regexp_replace(feature, '[0-9]', '', 'g') WHEN 'tau' THEN 'Reaction Time'
    WHEN 'p' THEN 'Power Balance' WHEN 'g' THEN 'Cooperation' END AS label
FROM az GROUP BY 1""")
def q_group_stress(spark, sf):
    r = readings(spark, sf)
    return dashboard.group_stress(scored_fixture(spark, sf, r),
                                  stable_baseline(spark, sf, r, quartiles=False))


@query("trend_sample", _FEED_SQL + f"""
SELECT row, CAST(round(ensemble_prob * 100.0) AS BIGINT) AS probability,
  CAST(round(RF_prob * 100.0) AS BIGINT) AS rf, CAST(round(XGBoost_prob * 100.0) AS BIGINT) AS xgb,
  {r6('IF_anomaly_score')} AS anomaly, risk_tier AS tier
FROM feed, (SELECT count(*) AS n FROM feed) k
WHERE (row - 1) % greatest(1, ceil(n / 90.0)) = 0 OR row = n""")
def q_trend_sample(spark, sf):
    return _r6(dashboard.trend_sample(_feed(spark, sf)))


@query("stable_screen", _SPLIT_SQL + "," + SCORED_SQL + """
SELECT *, row_number() OVER (ORDER BY baseline_prob, seq) AS screen_rank FROM (
  SELECT seq, kmeans_cluster, (round(ensemble_prob * 10000.0) / 10000.0 + 0.0) AS baseline_prob
  FROM scored_fixture WHERE _true_label = 0 AND ensemble_prob < 0.35
    AND seq IN (SELECT seq FROM splits WHERE split = 'test'))""")
def q_stable_screen(spark, sf):
    """P8 over the test split: what the models were not fitted on."""
    test = split_readings(spark, sf).where(F.col("split") == "test").select("seq")
    s = scored_fixture(spark, sf).select("seq", "kmeans_cluster", "ensemble_prob", "_true_label") \
        .join(test, "seq", "left_semi")
    return dashboard.stable_screen(s).select("seq", "kmeans_cluster", "baseline_prob",
                                             "screen_rank")


def _export_sql() -> str:
    piv = ", ".join(f"max(CASE WHEN feature = '{c}' THEN z END) AS z_{c}" for c in R)
    labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FEATURE_LABELS.items())
    return _STATS_SQL + "," + SCORED_SQL + f""",
sl AS ({unpivot_sql('scored_fixture', ['seq'], R)}),
zl AS (SELECT sl.seq, sl.feature, list_position({R!r}, sl.feature) AS o,
         (coalesce(sl.value, s.mean) - s.mean) / s.std AS z FROM sl JOIN stats s USING (feature)),
top AS (SELECT seq, string_agg(feature || '(' || regexp_replace(regexp_replace(
           printf('%.2f', round(z * 100.0) / 100.0 + 0.0), '0+$', ''), '[.]$', '') || 'σ)', '; '
           ORDER BY rk) AS alert_reason,
           arg_min(feature, rk) AS top_feature
        FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY abs(z) DESC, o) AS rk FROM zl)
        WHERE rk <= 3 GROUP BY seq)
SELECT row_number() OVER (ORDER BY f.seq) AS row, """ + ", ".join(R) + f""",
  printf('%.4f', round(ensemble_prob * 10000.0) / 10000.0 + 0.0) AS ensemble_prob, risk_tier,
  CASE WHEN ensemble_label = 1 THEN 'Fault' ELSE 'Stable' END AS label, kmeans_cluster,
  printf('%.4f', round(RF_prob * 10000.0) / 10000.0 + 0.0) AS RF_prob,
  printf('%.4f', round(XGBoost_prob * 10000.0) / 10000.0 + 0.0) AS XGBoost_prob,
  printf('%.4f', round(IF_anomaly_score * 10000.0) / 10000.0 + 0.0) AS IF_anomaly_score,
  t.alert_reason, CASE risk_tier WHEN 'Green' THEN 0 WHEN 'Amber' THEN 1 WHEN 'Red' THEN 2
  ELSE 0 END AS tier_order, CASE t.top_feature {labels} END AS top_reason_label
FROM scored_fixture f JOIN top t USING (seq)"""


@query("export_rows", _export_sql())
def q_export_rows(spark, sf):
    r = readings(spark, sf)
    z = with_zscores(scored_fixture(spark, sf, r), stable_baseline(spark, sf, r, quartiles=False), R)
    z = z.withColumn("alert_reason", alerts.top_deviations([f"z_{c}" for c in R]))
    from ..operators.sequence import with_ordinal
    z = with_ordinal(z, ["seq"], "_o", reading_tasks(spark, sf)).withColumn("row", (F.col("_o") + 1)).drop("_o")
    return dashboard.export_rows(z)


@query("split_union", _SPLIT_SQL + """
SELECT seq, split, stabf FROM splits WHERE split = 'train'
UNION ALL SELECT seq, split, stabf FROM splits WHERE split = 'val'
UNION ALL SELECT seq, split, stabf FROM splits WHERE split = 'test'""")
def q_split_union(spark, sf):
    from functools import reduce
    s = split_readings(spark, sf).select("seq", "split", "stabf")
    parts = [s.where(F.col("split") == x) for x in ("train", "val", "test")]
    return reduce(lambda a, b: a.unionByName(b), parts)


# ------------------------------------------------ cross-validation & shares --
CV_METRICS = ["pr_auc", "roc_auc", "f1_stable", "f1_unstable", "mcc"]


def cv_fold_metrics(spark, sf):
    """Metrics per (fold, model) on the scored feed with stratified fold ids."""
    s = scored_fixture(spark, sf)
    folds = prepare.stratified_folds(s.select("seq", "_true_label", *MODELS), "_true_label", "seq")
    long = folds.select("fold", "_true_label", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).alias("prob")) for m in MODELS])))
    long = long.withColumn("pred", (F.col("prob") >= F.lit(0.5)).cast("int"))
    by = ["fold", "model"]
    ap = metrics.average_precision(long, "_true_label", "prob", by).withColumnRenamed(
        "average_precision", "pr_auc")
    roc = metrics.roc_auc(long, "_true_label", "prob", by)
    cls = metrics.binary_metrics(long, "_true_label", "pred", by).drop("accuracy")
    return ap.join(roc, by).join(cls, by)


_CV_SQL = _LONG_SQL + f""",
fl AS (SELECT l.*, CAST((row_number() OVER (PARTITION BY l.y, l.model ORDER BY {_u_sql('l.seq')},
          l.seq) - 1) % 5 AS INTEGER) AS fold FROM long l),
""" + _curve_sql("fl", "fold, model")[2:].replace("GROUP BY ALL", "GROUP BY ALL") + """,
ap AS (SELECT fold, model, sum(pos * (cum_pos / (cum_pos + cum_neg))) / any_value(P) AS pr_auc,
         sum(neg * (2 * cum_pos - pos) / 2.0) / (any_value(P) * any_value(N)) AS roc_auc
       FROM c GROUP BY fold, model),
k AS (SELECT fold, model,
        CAST(count_if(y = 1 AND prob >= 0.5) AS DOUBLE) AS tp,
        CAST(count_if(y = 0 AND prob >= 0.5) AS DOUBLE) AS fp,
        CAST(count_if(y = 1 AND prob < 0.5) AS DOUBLE) AS fn,
        CAST(count_if(y = 0 AND prob < 0.5) AS DOUBLE) AS tn FROM fl GROUP BY fold, model),
m AS (SELECT ap.*,
        CASE WHEN 2 * tn + fp + fn = 0 THEN 0.0 ELSE 2 * tn / (2 * tn + fp + fn) END AS f1_stable,
        CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1_unstable,
        CASE WHEN sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) = 0 THEN 0.0 ELSE
          (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc
      FROM ap JOIN k USING (fold, model))
"""


@query("cv_summary", _CV_SQL + "SELECT 'stratified' AS cv_strategy, model, " + ", ".join(
    f"{r6(f'avg({m})')} AS {m}_mean, {r6(f'stddev_samp({m})')} AS {m}_std" for m in CV_METRICS)
    + " FROM m GROUP BY model")
def q_cv_summary(spark, sf):
    s = metrics.summarize(cv_fold_metrics(spark, sf), ["model"], CV_METRICS)
    return _r6(s.select(F.lit("stratified").alias("cv_strategy"), "*"))


IMPORTANCE_FEATURES = R + ["edge_load_0_1", "edge_load_0_2", "edge_load_0_3", "avg_edge_load"]


def importance_table(spark, sf):
    """Data-derived importances: |Pearson corr(feature, label)| on cleaned readings."""
    g = graph.graph_features(cleaned_readings(spark, sf))
    from ..functions.scalar import pearson
    agg = g.agg(*[F.abs(pearson(F.col(c), F.col("stabf").cast("double"))).alias(c)
                  for c in IMPORTANCE_FEATURES])
    return agg.unpivot([], IMPORTANCE_FEATURES, "feature", "importance")


def _share_sql() -> str:
    loads = {f"edge_load_0_{i}": f"least(abs(p{i + 1}) / (abs(g1) + abs(g{i + 1}) + 1e-9), 1.0)"
             for i in (1, 2, 3)}
    loads["avg_edge_load"] = "(" + " + ".join(loads.values()) + ") / 3.0"
    expr = {**{c: c for c in R}, **loads}
    parts = [f"SELECT '{f}' AS feature, abs(covar_pop({e}, CAST(stabf AS DOUBLE)) / nullif("
             f"stddev_pop({e}) * stddev_pop(CAST(stabf AS DOUBLE)), 0)) AS importance "
             f"FROM capped" for f, e in expr.items()]
    return _capped_sql() + f""",
imp AS ({union_all(parts)}),
r AS (SELECT feature, greatest(importance, 0.0) AS importance,
        row_number() OVER (ORDER BY greatest(importance, 0.0) DESC, feature) AS rank FROM imp),
cs AS (SELECT *, sum(importance) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING)
         / (sum(importance) OVER () + 1e-12) AS cum_importance FROM r),
sel AS (SELECT *, rank <= greatest(count_if(cum_importance <= 0.95) OVER (), 1) + 1 AS selected
        FROM cs)
"""


@query("cumulative_share", _share_sql() + f"""
SELECT feature, {r6('importance')} AS importance, rank, {r6('cum_importance')} AS cum_importance,
  selected FROM sel""")
def q_cumulative_share(spark, sf):
    s = metrics.cumulative_share(importance_table(spark, sf))
    return _r6(s.withColumn("rank", F.col("rank").cast("long")))


@query("unselected_features", _share_sql() + """
SELECT feature FROM imp WHERE feature NOT IN (SELECT feature FROM sel WHERE selected)""")
def q_unselected_features(spark, sf):
    imp = importance_table(spark, sf)
    sel = metrics.cumulative_share(imp).where("selected").select("feature")
    return imp.select("feature").join(sel, "feature", "left_anti")


# ------------------------------------------------- scoring & what-if (SQL) --
from ..operators import scoring, whatif  # noqa: E402


def _cf_vote(col) -> str:
    """The twelve-feature stand-in scorer as SQL (``scoring.twelve_feature_scorer``)."""
    rf = " + ".join(col(f"tau{k}") for k in range(1, 5))
    rf += " + " + " + ".join(f"16 * {col(f'g{k}')}" for k in range(1, 5))
    xg = " + ".join(f"abs({col(f'p{k}')})" for k in range(1, 5))
    return f"(0.4 * least(({rf}) / 256.0, 1.0) + 0.6 * least(({xg}) / 64.0, 1.0))"


@query("counterfactuals", _STATS_SQL + f""",
v AS (SELECT c.*, s.feature, s.mean AS stable,
        CASE s.feature {' '.join(f"WHEN '{x}' THEN c.{x}" for x in R)} END AS cur
      FROM capped c, stats s),
m AS (SELECT seq, feature, stable, cur, {_cf_vote(lambda x: x)} AS old,
        {_cf_vote(lambda x: f"CASE WHEN feature = '{x}' THEN stable ELSE {x} END")} AS new
      FROM v WHERE abs(cur - stable) >= 1e-6),
d AS (SELECT seq, feature, {r6('cur')} AS current_value,
        (round(stable * 10000.0) / 10000.0 + 0.0) AS stable_value,
        (round(new * 10000.0) / 10000.0 + 0.0) AS new_prob,
        (round((new - old) * 10000.0) / 10000.0 + 0.0) AS delta FROM m)
SELECT *, CAST(row_number() OVER (PARTITION BY seq ORDER BY delta,
    CASE feature {' '.join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(R))} END) AS INTEGER)
  AS cf_rank FROM d""")
def q_counterfactuals(spark, sf):
    c = cleaned_readings(spark, sf)
    out = scoring.counterfactuals(c, "seq", scoring.twelve_feature_scorer(), (0.4, 0.6), 0.5,
                                  stable_baseline(spark, sf))
    return round_cols(out, 6, ["current_value"])


def _soft_vote_sql() -> str:
    return (_SPLIT_SQL + "," + SCORED_SQL + """,
v AS (SELECT f.seq, f._true_label AS y, f.RF_prob, f.XGBoost_prob
      FROM scored_fixture f JOIN splits s USING (seq) WHERE s.split = 'val')"""
            + _curve_sql("v", "", "crf", "RF_prob") + _curve_sql("v", "", "cxg", "XGBoost_prob")
            + """,
w AS (SELECT a.ap_rf, b.ap_xgb,
        CASE WHEN a.ap_rf + b.ap_xgb > 0 THEN a.ap_rf / (a.ap_rf + b.ap_xgb) ELSE 0.5 END AS w_rf,
        CASE WHEN a.ap_rf + b.ap_xgb > 0 THEN b.ap_xgb / (a.ap_rf + b.ap_xgb) ELSE 0.5 END AS w_xgb
      FROM (SELECT sum(pos * (cum_pos / (cum_pos + cum_neg))) / any_value(P) AS ap_rf FROM crf) a,
           (SELECT sum(pos * (cum_pos / (cum_pos + cum_neg))) / any_value(P) AS ap_xgb FROM cxg) b),
vote AS (SELECT y, w_rf * RF_prob + w_xgb * XGBoost_prob AS prob FROM v, w)"""
            + _curve_sql("vote", "", "cv") + f""",
pr AS (SELECT score AS threshold, cum_pos / (cum_pos + cum_neg) AS precision, cum_pos / P AS recall
       FROM cv),
f AS (SELECT *, 2.0 * precision * recall / (precision + recall + 1e-12) AS f1 FROM pr),
t AS (SELECT threshold FROM f ORDER BY recall >= 0.9 DESC, f1 DESC, threshold LIMIT 1)
SELECT {r6('ap_rf')} AS ap_rf, {r6('ap_xgb')} AS ap_xgb, {r6('w_rf')} AS w_rf,
  {r6('w_xgb')} AS w_xgb, {r6('threshold')} AS threshold FROM w, t""")


@query("soft_vote", _soft_vote_sql())
def q_soft_vote(spark, sf):
    return _r6(scoring.soft_vote(scored_validation(spark, sf), "_true_label"))


@query("majority_baseline", _SPLIT_SQL + f""",
maj AS (SELECT stabf AS majority_label FROM splits WHERE split = 'train'
        GROUP BY stabf ORDER BY count(*) DESC, stabf LIMIT 1)
SELECT majority_label, count(*) AS n_test,
  {r6('avg(CAST(stabf = majority_label AS DOUBLE))')} AS test_accuracy
FROM splits, maj WHERE split = 'test' GROUP BY majority_label""")
def q_majority_baseline(spark, sf):
    from ..operators import models
    s = split_readings(spark, sf)
    return _r6(models.majority_baseline(s, "stabf"))


# ---- fixed values: the reference's preset scenario "Cascading Overload" ----
SCENARIO_EVENTS = [
    ("Cascading Overload", 0, "main", "p2", 3, 18, None, "3x"),
    ("Cascading Overload", 1, "main", "p3", 13, 28, None, "3x"),
]
# An operator fix applied from step 30 (rebased): shed Node 1 load.
SCENARIO_FIX = [("Cascading Overload", 2, "fix", "p2", 0, 5, None, "0.5x")]
SCENARIO_STEPS, SCENARIO_FIX_AT = 40, 30


def _overlay_sql() -> str:
    rows = ", ".join(
        f"({o}, '{ph}', '{f}', {s0}, {s1}, NULL, '{e}')"
        for _, o, ph, f, s0, s1, _sv, e in SCENARIO_EVENTS + SCENARIO_FIX)
    base_val = "CASE ev.feature " + " ".join(f"WHEN '{x}' THEN st.{x}" for x in R) + " END"
    s0 = f"coalesce(ev.start_val, {base_val})"
    s1 = (f"CASE WHEN lower(trim(ev.end_val)) LIKE '%x' THEN {s0} * TRY_CAST(substr(trim(ev.end_val),"
          f" 1, length(trim(ev.end_val)) - 1) AS DOUBLE) ELSE TRY_CAST(trim(ev.end_val) AS DOUBLE) END")
    interp = (f"{s0} + CAST(st.step - ev.start_step AS DOUBLE) / CAST(greatest(ev.end_step - "
              f"ev.start_step, 1) AS DOUBLE) * ({s1} - {s0})")
    cols = ", ".join(f"{r6(f'coalesce(max(CASE WHEN a.feature = {chr(39)}{x}{chr(39)} THEN a.value END), any_value(st2.{x}))')} AS {x}" for x in R)
    return _capped_sql() + f""",
ev0 AS (SELECT * FROM (VALUES {rows}) t(ordinal, phase, feature, start_step, end_step, start_val,
        end_val)),
ev AS (SELECT ordinal, phase, feature,
         CASE WHEN phase = 'fix' THEN start_step + {SCENARIO_FIX_AT} ELSE start_step END AS start_step,
         CASE WHEN phase = 'fix' THEN end_step + {SCENARIO_FIX_AT} ELSE end_step END AS end_step,
         CAST(start_val AS DOUBLE) AS start_val, end_val FROM ev0),
st AS (SELECT c.*, s.step FROM capped c, range(0, {SCENARIO_STEPS}) s(step)),
j AS (SELECT st.seq, st.step, ev.feature, ev.ordinal,
        CASE WHEN st.step <= ev.end_step THEN {interp} ELSE {s1} END AS value
      FROM st JOIN ev ON st.step >= ev.start_step
      WHERE CASE WHEN st.step >= {SCENARIO_FIX_AT} THEN ev.phase = 'fix' ELSE ev.phase = 'main' END),
a AS (SELECT seq, step, feature, arg_max(value, ordinal) AS value FROM j GROUP BY ALL),
st2 AS (SELECT * FROM st)
SELECT st2.seq, CAST(st2.step AS INTEGER) AS step, {cols}
FROM st2 LEFT JOIN a USING (seq, step) GROUP BY st2.seq, st2.step"""


@query("schedule_overlay", _overlay_sql())
def q_schedule_overlay(spark, sf):
    c = cleaned_readings(spark, sf).select("seq", *R)
    ev = spark.createDataFrame(SCENARIO_EVENTS + SCENARIO_FIX, whatif.EVENT_SCHEMA)
    # base values are rounded once a reading, only what events change once a step
    named = whatif.named_features(ev, R)
    base = c.select("seq", *named, *[rounded(F.col(f), 6).alias(f"_base_{f}") for f in R])
    out = whatif.overlay(whatif.expand_steps(base, "seq", SCENARIO_STEPS), ev, SCENARIO_STEPS,
                         fix_at_step=SCENARIO_FIX_AT, finish=lambda v: rounded(v, 6), finished="_base_")
    return out.select("seq", "step", *[F.col(f if f in named else f"_base_{f}").alias(f) for f in R])


# ---------------------------------------------------------------- streaming --
from ..streaming import monitor  # noqa: E402

_EV_STATS_SQL = """
WITH s AS (SELECT avg(value) AS m, greatest(stddev_samp(value), 1e-6) AS sd FROM events),
z AS (SELECT event_id, user_id, ts, value, (value - m) / sd AS z FROM events, s)
"""


def _event_baseline(spark, sf):
    ev = table(spark, sf, "events").select("value")
    return baseline_stats(ev, ["value"], label=None, quartiles=False)


def scored_events_stream(spark, sf):
    return monitor.score_stream(monitor.table_stream(spark, sf), _event_baseline(spark, sf))


@query("stream_scores", _EV_STATS_SQL + f"""
SELECT event_id, user_id, {r6('z')} AS z,
  CASE WHEN abs(z) < 1.5 THEN 'Normal' WHEN abs(z) < 2.5 THEN 'Elevated' ELSE 'Critical' END
    AS status FROM z""")
def q_stream_scores(spark, sf):
    s = scored_events_stream(spark, sf).select("event_id", "user_id", "z", "status")
    return _r6(monitor.run_available(s, "scores"))


@query("stream_alerts")
def q_stream_alerts(spark, sf):
    return monitor.run_available(monitor.sticky_alerts(scored_events_stream(spark, sf)), "alerts")


@query("stream_windows", _EV_STATS_SQL + f""",
w AS (SELECT z.*, time_bucket(INTERVAL 10 MINUTE, CAST(ts AS TIMESTAMP)) - INTERVAL (k * 10) MINUTE
        AS window_start FROM z, range(0, 6) r(k)),
wm AS (SELECT max(ts) - INTERVAL 1 MINUTE AS wmark FROM events)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, user_id, count(*) AS n,
  {r6('avg(value)')} AS mean_value, {r6('max(abs(z))')} AS max_abs_z
FROM w, wm WHERE ts >= window_start AND ts < window_start + INTERVAL 1 HOUR
  AND window_start + INTERVAL 1 HOUR <= wmark
GROUP BY window_start, user_id""")
def q_stream_windows(spark, sf):
    return _r6(monitor.run_available(monitor.window_stats(scored_events_stream(spark, sf)),
                                     "windows"))


@query("stream_history", _EV_STATS_SQL + f""",
h AS (SELECT event_id, user_id, ts, count(*) OVER w AS hist_len, {r6('sum(value) OVER w')} AS hist_sum,
  {r6('max(abs(z)) OVER w')} AS hist_peak_z, {r6('min(z) OVER w')} AS hist_low_z
  FROM z WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, hist_len, hist_sum, hist_peak_z, hist_low_z FROM h
WHERE ts < (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 MINUTE FROM events)""")
def q_stream_history(spark, sf):
    h = monitor.run_available(monitor.history_stream(scored_events_stream(spark, sf)), "history")
    return _r6(h.select(
        "event_id", "user_id", F.size("value_history").cast("long").alias("hist_len"),
        F.aggregate("value_history", F.lit(0.0), lambda a, x: a + x).alias("hist_sum"),
        F.array_max(F.transform("z_history", lambda x: F.abs(x))).alias("hist_peak_z"),
        F.array_min("z_history").alias("hist_low_z")))


# ------------------------------------------------------ neighbours & SMOTE --
from ..operators import neighbors  # noqa: E402

EMB_DIMS = 64


def _minority_embeddings(spark, sf):
    emb = table(spark, sf, "embeddings")
    counts = emb.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    minority = counts.agg(F.min_by("label", F.struct("n", "label")).alias("label"))
    arr = F.col("embedding")
    return emb.join(minority, "label").select(
        "vec_id", *[arr[i].cast("double").alias(f"e{i}") for i in range(EMB_DIMS)])


@query("minority_knn", f"""
WITH c AS (SELECT label FROM embeddings GROUP BY label ORDER BY count(*), label LIMIT 1),
m AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label = (SELECT label FROM c)),
p AS (SELECT a.vec_id, b.vec_id AS nid, sqrt(list_sum(list_transform(
        list_zip(a.e, b.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS dist
      FROM m a JOIN m b ON a.vec_id <> b.vec_id)
SELECT vec_id, rank, nid, {r6('dist')} AS dist FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nid) AS rank FROM p)
WHERE rank <= 5""")
def q_minority_knn(spark, sf):
    df = _minority_embeddings(spark, sf)
    nb = neighbors.knn(df, "vec_id", [f"e{i}" for i in range(EMB_DIMS)], k=5)
    out = nb.select("vec_id", F.posexplode("neighbors").alias("rank", "n"))
    return _r6(out.select("vec_id", (F.col("rank") + 1).cast("long").alias("rank"),
                          F.col("n.nid").alias("nid"), F.col("n.dist").alias("dist")))


def _smote_sql(k: int = 5) -> str:
    fit = ", ".join(f"avg({c}) AS {c}_c, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS {c}_s"
                    for c in R)
    scaled = ", ".join(f"{r6(f'({c} - {c}_c) / {c}_s')} AS {c}" for c in R)
    dist = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in R)
    synth = ", ".join(f"{r6(f'g.{c} + g.u * (d.{c} - g.{c})')} AS {c}" for c in R)

    def draw(purpose: str) -> str:
        return f"(('0x' || substr(md5(seq || '|' || j || '|42|{purpose}'), 1, 8))::BIGINT / 4294967296.0)"
    return _SPLIT_SQL + f""",
params AS (SELECT {fit} FROM splits WHERE split = 'train'),
sc AS (SELECT seq, stabf, {scaled} FROM splits, params WHERE split = 'train'),
sizes AS (SELECT stabf, count(*) AS n FROM sc GROUP BY stabf),
need AS (SELECT arg_min(stabf, n * 2 + stabf) AS minority, min(n) AS few, max(n) - min(n) AS need FROM sizes),
mino AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS pos FROM sc, need WHERE stabf = minority),
near AS (SELECT a.seq, b.seq AS nid, row_number() OVER (PARTITION BY a.seq ORDER BY sqrt({dist}), b.seq) AS rank
  FROM mino a JOIN mino b ON a.seq <> b.seq QUALIFY rank <= {k}),
made AS (SELECT m.*, unnest(range(need // few + CASE WHEN pos < need % few THEN 1 ELSE 0 END)) AS j FROM mino m),
gen AS (SELECT *, CAST(floor({draw('nn')} * {k}) AS BIGINT) + 1 AS pick, {draw('gap')} AS u FROM made)
SELECT seq, stabf, {", ".join(R)}, false AS synthetic FROM sc
UNION ALL
SELECT -(g.seq * (g.need // g.few + 1) + g.j + 1), g.stabf, {synth}, true
FROM gen g JOIN near n ON n.seq = g.seq AND n.rank = g.pick JOIN mino d ON d.seq = n.nid"""


@query("smote_balance", _smote_sql())
def q_smote_balance(spark, sf):
    """D8 on the train split, its scaled features taken to six decimals first, so
    that two engines see the same distances and the same ties."""
    s = split_readings(spark, sf)
    train = s.where(F.col("split") == "train")
    params = prepare.fit_standard(train, R)
    scaled = round_cols(prepare.apply_scaler(train, params, R).select("seq", "stabf", *R), 6, R)
    return _r6(neighbors.smote(scaled, "seq", "stabf", R, k=5))


# ------------------------------------------------------------------ sources --
from ..sources import io as sio  # noqa: E402


@query("roundtrip_tables", _SPLIT_SQL + "SELECT seq, split, stabf, " + ", ".join(
    f"{r6(c)} AS {c}" for c in R) + " FROM splits")
def q_roundtrip_tables(spark, sf):
    """IO1, IO4–IO7, IO11: readings → CSV → schema'd read → split table
    partitioned by split → named-split load; equals the in-memory split."""
    import uuid
    from ..session import ensure_checkpoint_dir
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
    r = readings(spark, sf)
    sio.export_csv(r.select("seq", *R, "stab", "stabf"), f"{root}/readings_csv")
    back = sio.read_readings_csv(spark, f"{root}/readings_csv")
    split = prepare.stratified_split(clean.clean_readings(back), "stabf", "seq",
                                     num_partitions=reading_tasks(spark, sf))
    sio.write_splits(split, f"{root}/splits")
    loaded = sio.load_splits(spark, f"{root}/splits", ["train", "val", "test"])
    return _r6(sio.materialize_once(spark, loaded, f"{root}/feed")
               .select("seq", "split", "stabf", *R))


@query("first_rows", with_views("readings") + "SELECT seq, " + ", ".join(R)
       + ", stabf FROM readings ORDER BY seq LIMIT 200")
def q_first_rows(spark, sf):
    """The first 200 readings in order (the trend view's head: a top-n
    is the feature here)."""
    return temporal.first_rows(readings(spark, sf), ["seq"], 200).select("seq", *R, "stabf")


@query("ensemble_metadata", _soft_vote_sql())
def q_ensemble_metadata(spark, sf):
    """IO7/IO9/IO10: the soft-vote metadata (weights, threshold) and cluster
    names written as JSON and a parquet table, read back."""
    import uuid
    from ..session import ensure_checkpoint_dir
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/meta-{uuid.uuid4().hex}"
    # one row, written as JSON and as a table
    meta = materialize(scoring.soft_vote(scored_validation(spark, sf), "_true_label"))
    sio.write_json_row(_r6(meta), f"{root}/ensemble_meta")
    sio.write_table(_r6(meta), f"{root}/ensemble_table")
    back = spark.read.schema(meta.schema).json(f"{root}/ensemble_meta")
    same = spark.read.parquet(f"{root}/ensemble_table")
    return back.unionByName(same).distinct()


@query("profile_head", with_views("readings") + "SELECT seq, " + ", ".join(R)
       + ", stab, stabf FROM readings ORDER BY seq LIMIT 5")
def q_profile_head(spark, sf):
    """A1: the first five readings shown by the profile (a head is the feature)."""
    return temporal.first_rows(readings(spark, sf), ["seq"], 5).select("seq", *R, "stab", "stabf")


# ---- fixed values: the reference's five preset scenarios (name, feature,
# start step, end step, start value, end value) ----
PRESET_EVENTS = [
    ("Consumer Spike — Node 1", "p2", 5, 20, None, "3x"),
    ("Consumer Spike — Node 2", "p3", 5, 20, None, "3x"),
    ("Generator Sag", "p1", 3, 25, None, "0.2x"),
    ("Response Slowdown — Node 1", "tau2", 5, 25, None, "9.8"),
    ("Cascading Overload", "p2", 3, 18, None, "3x"),
    ("Cascading Overload", "p3", 13, 28, None, "3x"),
]
PRESET_FEATURES = ["tau2", "p1", "p2", "p3"]


def _presets_sql() -> str:
    rows = ", ".join(f"('{n}', {i}, '{f}', {s0}, {s1}, '{e}')"
                     for i, (n, f, s0, s1, _sv, e) in enumerate(PRESET_EVENTS))
    names = ", ".join(f"('{n}')" for n in dict.fromkeys(n for n, *_ in PRESET_EVENTS))
    base_val = "CASE ev.feature " + " ".join(f"WHEN '{x}' THEN st.{x}" for x in R) + " END"
    s1 = (f"CASE WHEN lower(trim(ev.end_val)) LIKE '%x' THEN {base_val} * TRY_CAST(substr("
          f"trim(ev.end_val), 1, length(trim(ev.end_val)) - 1) AS DOUBLE) "
          f"ELSE TRY_CAST(trim(ev.end_val) AS DOUBLE) END")
    interp = (f"{base_val} + CAST(st.step - ev.start_step AS DOUBLE) / CAST(greatest(ev.end_step"
              f" - ev.start_step, 1) AS DOUBLE) * ({s1} - {base_val})")
    cols = ", ".join(
        f"{r6(f'coalesce(max(CASE WHEN a.feature = {chr(39)}{x}{chr(39)} THEN a.value END), any_value(st2.{x}))')} AS {x}"
        for x in PRESET_FEATURES)
    return _capped_sql() + f""",
ev AS (SELECT * FROM (VALUES {rows}) t(scenario, ordinal, feature, start_step, end_step, end_val)),
sc AS (SELECT * FROM (VALUES {names}) t(scenario)),
st AS (SELECT c.*, sc.scenario, s.step FROM capped c, sc, range(0, {SCENARIO_STEPS}) s(step)),
j AS (SELECT st.seq, st.scenario, st.step, ev.feature, ev.ordinal,
        CASE WHEN st.step <= ev.end_step THEN {interp} ELSE {s1} END AS value
      FROM st JOIN ev ON st.scenario = ev.scenario AND st.step >= ev.start_step),
a AS (SELECT seq, scenario, step, feature, arg_max(value, ordinal) AS value FROM j GROUP BY ALL),
st2 AS (SELECT * FROM st)
SELECT st2.seq, st2.scenario, CAST(st2.step AS INTEGER) AS step, {cols}
FROM st2 LEFT JOIN a USING (seq, scenario, step) GROUP BY st2.seq, st2.scenario, st2.step"""


@query("scenario_presets", _presets_sql())
def q_scenario_presets(spark, sf):
    """M21 over every preset: each cleaned reading as the base row of each
    preset scenario, 40 steps."""
    c = cleaned_readings(spark, sf).select("seq", *R)
    names = list(dict.fromkeys(n for n, *_ in PRESET_EVENTS))
    ev = spark.createDataFrame(
        [(n, i, "main", f, s0, s1, sv, e) for i, (n, f, s0, s1, sv, e) in enumerate(PRESET_EVENTS)],
        whatif.EVENT_SCHEMA)
    with_sc = c.withColumn("scenario", F.explode(F.array(*[F.lit(n) for n in names])))
    stepped = whatif.expand_steps(with_sc, "seq", SCENARIO_STEPS)
    out = whatif.overlay(stepped, ev, SCENARIO_STEPS, scenario_col="scenario")
    return _r6(out.select("seq", "scenario", "step", *PRESET_FEATURES))
