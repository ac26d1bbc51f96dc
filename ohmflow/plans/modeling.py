"""Model-backed queries (rows-only checks: learners are MLlib's, so values
differ from any SQL engine). All read the driver tables through the same
cleaned ``readings`` view and the same stratified split."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import bundle, graph, importance, isoforest, models, neighbors, prepare, temporal
from ..operators.common import materialize, round_cols, stored_columns
from ..schema import RAW_FEATURES as R
from ..session import ensure_checkpoint_dir
from ..sources.fixtures import reading_tasks
from .catalog import _SPLIT_SQL, cleaned_readings, split_readings
from .registry import query
from .sqlgen import r6

#: all 156: raw, temporal and graph features
FEATS = (R + temporal.feature_names(temporal.ROLLING_FEATURES, temporal.LAG_FEATURES)
         + graph.GRAPH_FEATURES)
LABEL = "stabf"


def _features(spark, sf):
    """The engineered readings with all features."""
    return _engineered(cleaned_readings(spark, sf), "sequence").select("seq", LABEL, *FEATS)


def _splits(spark, sf):
    return materialize(prepare.stratified_split(_features(spark, sf), LABEL, "seq",
                                                num_partitions=reading_tasks(spark, sf)))


def _scaled(spark, sf):
    """Standard-scaled features of every split. A row's split depends on its class and id
    alone, so it is drawn on the narrow readings; the wide rows are written once, and scaled
    as they are read."""
    rows = prepare.stratified_split(cleaned_readings(spark, sf), LABEL, "seq",
                                    num_partitions=reading_tasks(spark, sf))
    s = stored_columns(_engineered(rows, "sequence").select(LABEL, "seq", *FEATS, "split"))
    params = materialize(prepare.fit_standard(s.where(F.col("split") == "train"), FEATS))
    return prepare.apply_scaler(s, params, FEATS)


@query("baseline_models")
def q_baseline_models(spark, sf):
    """M1–M5 on a stratified 80/20 split."""
    s = materialize(prepare.stratified_split(_features(spark, sf), LABEL, "seq", test=0.2, val=0.0,
                                             num_partitions=reading_tasks(spark, sf)))
    tr, te = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    n = tr.count()
    ests = {"logistic_regression": models.logistic(LABEL, n),
            "random_forest": models.random_forest(LABEL)}
    m = models.evaluate_models(tr, te, LABEL, FEATS, ests)
    from ..operators.metrics import average_precision, binary_metrics, roc_auc
    maj = models.majority_predictions(tr, te, LABEL).select(
        F.lit("majority").alias("model"), LABEL, "pred", "score")
    mm = binary_metrics(maj, LABEL, "pred", ["model"]).join(
        roc_auc(maj, LABEL, "score", ["model"]), "model").join(
        average_precision(maj, LABEL, "score", ["model"]), "model")
    return round_cols(m.unionByName(mm), 6)


@query("rf_grid")
def q_rf_grid(spark, sf):
    """M6 + T8: grid search over stratified 5-fold ids, AP scoring."""
    tr = _splits(spark, sf).where(F.col("split") == "train")
    folds = prepare.stratified_folds(tr, LABEL, "seq", num_partitions=reading_tasks(spark, sf))
    res, _ = models.tune_forest(folds, LABEL, FEATS, "fold")
    return round_cols(res, 6)


@query("gbt_weight_sweep")
def q_gbt_weight_sweep(spark, sf):
    """M7: positive-weight sweep of boosted trees by validation AP."""
    s = _splits(spark, sf)
    res, _ = models.sweep_boosting_weights(s.where(F.col("split") == "train"),
                                           s.where(F.col("split") == "val"), LABEL, FEATS)
    return round_cols(res, 6)


@query("pca_95")
def q_pca_95(spark, sf):
    """M9 + W9: explained variance and cumulative share, kept components."""
    s = _scaled(spark, sf)
    table, _ = models.fit_pca(s.where(F.col("split") == "train"), FEATS)
    return round_cols(table, 6)


@query("kmeans_segments")
def q_kmeans_segments(spark, sf):
    """Elbow and silhouette for k = 2..6 on the PCA scores of all splits."""
    s = _scaled(spark, sf)
    _, transform = models.fit_pca(s.where(F.col("split") == "train"), FEATS)
    scores = materialize(transform(s).select("pca"))    # every start reads the scores
    res, _ = models.kmeans_sweep(scores, ks=(2, 3, 4, 5, 6))
    return round_cols(res, 6)


def _pca_columns(s):
    """PCA scores of every split as plain columns ``pc1 ..`` (fitted on train)."""
    from pyspark.ml.functions import vector_to_array
    table, transform = models.fit_pca(s.where(F.col("split") == "train"), FEATS)
    names = [f"pc{r['component']}" for r in table.where("kept").orderBy("component").collect()]
    scores = vector_to_array(F.col("pca"))
    return transform(s).select("*", *[scores[i].alias(n) for i, n in enumerate(names)]), names


@query("isolation_forest")
def q_isolation_forest(spark, sf):
    """M10 + M11 + S17: fit on the train PCA scores, cut-offs from the train
    scores, contamination swept on validation."""
    pcs, names = _pca_columns(_scaled(spark, sf))
    tr = pcs.where(F.col("split") == "train")
    forest = materialize(isoforest.fit(tr, names, "seq"))
    scored = materialize(isoforest.score(
        pcs.where(F.col("split").isin("train", "val")).select("split", LABEL, *names), forest, names))
    return round_cols(isoforest.contamination_sweep(
        scored.where(F.col("split") == "val"), LABEL, scored.where(F.col("split") == "train")), 6)


def _stored_bundle(spark, sf):
    """All splits with their engineered features, and the bundle fitted on them,
    written and read back."""
    s = _splits(spark, sf)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bundles/{uuid.uuid4().hex}"
    bundle.save(bundle.fit(s, LABEL, "seq", FEATS), root)
    return s, bundle.load(spark, root)


@query("score_all_splits")
def q_score_all_splits(spark, sf):
    """M13 (+ M8–M12, F11, F12, U4, IO8, D7): every split scored by a stored bundle,
    whose classifiers are trained on the SMOTE rows."""
    s, parts = _stored_bundle(spark, sf)
    return round_cols(bundle.score(parts, s, keep=["seq", "split", LABEL]).drop(*R), 6)


@query("cross_validate")
def q_cross_validate(spark, sf):
    """Stratified and time-series 5-fold CV of RF, boosted trees and their
    AP-weighted vote, SMOTE inside each fold's training part; per-fold
    threshold by A26; summary per (strategy, model).
    Fits run per fold (driver loop over 10 folds); every metric is computed in
    one grouped pass over the union of all fold predictions."""
    from ..operators import metrics
    base = _splits(spark, sf)
    strat = prepare.stratified_folds(base, LABEL, "seq", num_partitions=reading_tasks(spark, sf))
    ts = prepare.time_series_folds(base, ["seq"])
    preds = None
    for name, df in (("stratified", strat), ("timeseries", ts)):
        df = materialize(df)
        for k in range(5):
            if name == "stratified":
                tr, va = df.where(F.col("fold") != k), df.where(F.col("fold") == k)
            else:
                tr = df.where(F.col("first_train_fold") <= k)
                va = df.where(F.col("test_fold") == k)
            # oversample inside the fold (train part only), as the reference does
            bal = materialize(neighbors.smote(tr.select("seq", LABEL, *FEATS), "seq", LABEL,
                                              FEATS, k=5))
            trv = models.assemble(bal, FEATS)
            rf = models.random_forest(LABEL).fit(trv)
            gb = models.boosted_trees(LABEL).fit(trv)
            a = models.assemble(va.select("seq", LABEL, *FEATS), FEATS)
            p = models.positive_score(rf.transform(a), "RF_prob").select("seq", LABEL, "RF_prob", *FEATS)
            p = models.positive_score(gb.transform(models.assemble(p, FEATS)), "XGBoost_prob") \
                .select(F.lit(name).alias("cv_strategy"), F.lit(k + 1).alias("fold"), "seq", LABEL,
                        "RF_prob", "XGBoost_prob")
            preds = p if preds is None else preds.unionByName(p)
    preds = materialize(preds)
    g = ["cv_strategy", "fold"]
    ap_rf = metrics.average_precision(preds, LABEL, "RF_prob", g).withColumnRenamed(
        "average_precision", "ap_rf")
    ap_x = metrics.average_precision(preds, LABEL, "XGBoost_prob", g).withColumnRenamed(
        "average_precision", "ap_x")
    tot = F.col("ap_rf") + F.col("ap_x")
    w = ap_rf.join(ap_x, g).select(*g, F.when(tot > 0, F.col("ap_rf") / tot).otherwise(0.5).alias("w_rf"),
                                   F.when(tot > 0, F.col("ap_x") / tot).otherwise(0.5).alias("w_x"))
    ens = preds.join(F.broadcast(w), g).withColumn(  # 10 rows
        "ensemble_prob", F.col("w_rf") * F.col("RF_prob") + F.col("w_x") * F.col("XGBoost_prob"))
    long = ens.select(*g, LABEL, F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(c).alias("prob")) for m, c in
        (("rf", "RF_prob"), ("xgboost", "XGBoost_prob"), ("ensemble", "ensemble_prob"))])))
    by = g + ["model"]
    thr = metrics.best_threshold(long, LABEL, "prob", by=by).select(*by, F.col("threshold").alias("thr"))
    lab = long.join(F.broadcast(thr), by).withColumn(  # 30 rows
        "pred", (F.col("prob") >= F.col("thr")).cast("int"))
    fm = (metrics.average_precision(lab, LABEL, "prob", by)
          .join(metrics.roc_auc(lab, LABEL, "prob", by), by)
          .join(metrics.binary_metrics(lab, LABEL, "pred", by), by).join(thr, by))
    ms = ["average_precision", "roc_auc", "f1_stable", "f1_unstable", "mcc", "thr"]
    return round_cols(metrics.summarize(fm, ["cv_strategy", "model"], ms), 6)


@query("permutation_importance")
def q_permutation_importance(spark, sf):
    """Accuracy drop per feature on validation, 10 repeats, by the balanced
    forest of 200 trees of depth 10."""
    s = _splits(spark, sf)
    predict = models.selector_forest(s.where(F.col("split") == "train"), LABEL, FEATS)
    imp = importance.permutation_importance(s.where(F.col("split") == "val"), "seq", LABEL, FEATS,
                                            predict, repeats=10)
    return round_cols(imp, 6)


def _importance_sql(repeats: int = 10) -> str:
    """The same permutations over the twelve raw features, scored by a rule."""
    def draw(purpose: str) -> str:
        return f"('0x' || substr(md5('42|' || feature || '|' || rep || '|{purpose}'), 1, 15))::BIGINT"

    def rule(cols: dict) -> str:
        slow = " + ".join(f"{cols[f'tau{k}']} + 16.0 * {cols[f'g{k}']}" for k in range(1, 5))
        power = " + ".join(f"abs({cols[f'p{k}']})" for k in range(1, 5))
        return f"CAST(({slow}) / 256.0 + ({power}) / 64.0 >= 1.0 AS INTEGER)"
    names = ", ".join(f"'{f}'" for f in R)
    own = {f: f"CASE WHEN m.feature = '{f}' THEN d.{f} ELSE t.{f} END" for f in R}
    return _SPLIT_SQL + f""",
val AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS pos, count(*) OVER () AS size
        FROM splits WHERE split = 'val'),
draws AS (SELECT feature, CAST(rep AS INTEGER) AS rep, size, {draw('step')} % size AS a0, {draw('start')} % size AS b
  FROM (SELECT unnest([{names}]) AS feature), (SELECT unnest(range({repeats})) AS rep), (SELECT max(size) AS size FROM val)),
maps AS (SELECT *, (a0 + list_filter(range(1000), lambda i: gcd((a0 + i) % size + 1, size) = 1)[1]) % size + 1 AS a
         FROM draws),
copies AS (SELECT m.feature, m.rep, t.stabf, {rule(own)} AS pred
  FROM val d JOIN maps m ON true JOIN val t ON t.pos = (m.a * d.pos + m.b) % m.size),
acc AS (SELECT feature, rep, avg(CAST(pred = stabf AS DOUBLE)) AS acc FROM copies GROUP BY ALL),
base AS (SELECT avg(CAST({rule({f: f for f in R})} = stabf AS DOUBLE)) AS base FROM val)
SELECT feature, {r6('avg(base - acc)')} AS importance_mean, {r6('stddev_pop(base - acc)')} AS importance_std
FROM acc, base GROUP BY feature"""


def rule_model(df):
    """A stand-in model that reads every raw feature (as ``_importance_sql``)."""
    slow = sum((F.col(f"tau{k}") for k in range(2, 5)), F.col("tau1"))
    slow = sum((F.lit(16) * F.col(f"g{k}") for k in range(1, 5)), slow)
    power = sum((F.abs(f"p{k}") for k in range(2, 5)), F.abs("p1"))
    return df.withColumn("pred", (slow / 256.0 + power / 64.0 >= 1.0).cast("int"))


@query("permutation_rule_importance", _importance_sql())
def q_permutation_rule_importance(spark, sf):
    """M16's permutations and drops with a rule in place of the forest, so that SQL
    can repeat every one of them."""
    val = split_readings(spark, sf).where(F.col("split") == "val")
    return round_cols(importance.permutation_importance(val, "seq", LABEL, R, rule_model), 6)


def _engineered(df, mode):
    if mode == "sequence":
        t = temporal.temporal_features(df, ["seq"])
    else:  # M19: no context — rolling = x, std = 0, roc = 0, lag = x
        cols = {}
        for n in temporal.feature_names(temporal.ROLLING_FEATURES, temporal.LAG_FEATURES):
            src = n.split("_")[2] if n.startswith("roll_") else n.split("_", 1)[1]
            cols[n] = F.lit(0.0) if n.startswith(("roll_std", "roc_")) else F.col(src)
        t = df.withColumns(cols)
    return graph.graph_features(t)


@query("score_modes")
def q_score_modes(spark, sf):
    """M18 + M19: one model on engineered features; readings scored as a
    sequence (temporal context) and as independent rows."""
    c = cleaned_readings(spark, sf)
    names = (R + temporal.feature_names(temporal.ROLLING_FEATURES, temporal.LAG_FEATURES)
             + graph.GRAPH_FEATURES)
    names = [n for n in names if "degree" not in n and "betweenness" not in n
             and "clustering" not in n]
    seq_df = _engineered(c, "sequence")
    split = prepare.stratified_split(c.select("seq", LABEL), LABEL, "seq",
                                     num_partitions=reading_tasks(spark, sf)).select("seq", "split")
    train = seq_df.join(split, "seq").where(F.col("split") == "train")
    rf = models.random_forest(LABEL).fit(models.assemble(train, names))

    def prob(df, out):
        return models.positive_score(rf.transform(models.assemble(df, names)), out) \
            .select("seq", out)
    a = prob(seq_df, "prob_sequence")
    b = prob(_engineered(c, "independent"), "prob_independent")
    from ..functions.scalar import risk_tier
    return round_cols(a.join(b, "seq").withColumn("tier_sequence", risk_tier(F.col("prob_sequence")))
                      .withColumn("tier_independent", risk_tier(F.col("prob_independent"))), 6)

