"""Registered queries: model training, scoring, comparison, calibration, attributions, importance
(M1–M10, A26–A28). Model outputs cannot be reproduced in SQL, so these get the rows-only check, except the class
weights (A28), which are plain aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelkit.operators import features as FE
from panelkit.operators import metrics as M
from panelkit.operators import ml as ML
from panelkit.operators import pairs as P
from panelkit.operators.boosting import fit_boosted
from panelkit.operators.ranking import running_pairs
from panelkit.operators.topk import top_n_per_group
from panelkit.plans import bindings as B
from panelkit.plans.common import DIGITS, round_doubles
from panelkit.plans.registry import query
from panelkit.session import materialize, scratch_path, spread

R = DIGITS
# The policy's model has the operators' full size (2500 x depth 8 with a patience of 200). It starts with FIRST rounds, which
# changes the time only: the best of the first 100 rounds is found by one fit.
FIRST = 300
# What the other registered queries fit; the forests' full size is 300 x depth 12. README gives what full size took.
GBT = {"max_iter": 30, "depth": 4, "patience": 10, "first": 30}
FOLD_GBT = {"max_iter": 12, "depth": 4}
RF = {"trees": 60, "depth": 8}


def _feature_sets(spark, sf_dir):
    panel = materialize(B.cust_year(spark, sf_dir))  # pairs, periods and the split read it
    train, valid = P.temporal_split(materialize(P.build_pairs(panel)), panel)
    tr, va, lookup = FE.build_features(train, valid, keys_mode="latest")
    # training iterates over its input many times: cut the feature lineage once (reliable checkpoint)
    tr, va = materialize(spread(tr, lookup.rows)), materialize(spread(va, valid.count()))
    num, cat = FE.feature_columns(tr)
    return tr, va, num, cat


@query("class_weights", B.with_ctes(B.B2_SQL) + f""",
t AS (SELECT target FROM pairs WHERE pair_label <> (SELECT max(pair_label) FROM pairs)),
c AS (SELECT target, count(*) AS n_class FROM t GROUP BY target)
SELECT target, CAST(n_class AS BIGINT) AS n_class,
       round((SELECT sum(n_class) FROM c) / ((SELECT count(*) FROM c) * CAST(n_class AS DOUBLE)), {R}) AS weight FROM c""",
       ids=("A28",))
def class_weights(spark, sf_dir):
    panel = B.cust_year(spark, sf_dir)
    train, _ = P.temporal_split(P.build_pairs(panel), panel)
    return round_doubles(ML.class_weights(train))


@query("gbt_valid_scores", None, ids=("M1", "M2", "M3", "F34", "P13"))
def gbt_valid_scores(spark, sf_dir):
    tr, va, num, cat = _feature_sets(spark, sf_dir)
    model, _ = fit_boosted(tr, va, num, cat, first=FIRST)
    return ML.score(model, va, num, cat, keep=["ra", "pair_label", "fase", "target"])


@query("gbt_valid_policy", None, ids=("M3", "A9", "W3", "A8"))
def gbt_valid_policy(spark, sf_dir):
    """The reference's evaluation of a trained model: AUC and stratified top-15% metrics on the valid pair."""
    scored = materialize(gbt_valid_scores(spark, sf_dir).withColumn("fase", F.col("fase").cast("string")))  # read by every metric
    k = F.lit("gbt")
    auc = M.auc_table(scored).select(k.alias("model"), "auc", "n", "n_pos")
    pol = M.operational_metrics(scored, 15.0).select(k.alias("model"), "n_alert", "recall_at_k", "precision_at_k",
                                                      "lift_at_k")
    return round_doubles(auc.join(pol, "model"))


@query("model_comparison", None, ids=("M4", "M5", "M6"))
def model_comparison(spark, sf_dir):
    """M5: one row per model (boosted trees, random forests on one-hot and on ordinal categories, logistic) — AUC and
    stratified recall / precision / lift at 15%, sorted by lift."""
    tr, va, num, cat = _feature_sets(spark, sf_dir)
    codes = [f"{c}__code" for c in cat]
    tr_codes, va_codes = ML.ordinal_codes(tr, cat, tr), ML.ordinal_codes(va, cat, tr)
    imputer = ML.imputer_of(num).fit(ML.prepare(tr, num, cat))  # the medians of three models
    rows = None
    for name in ("gbt", "random_forest", "random_forest_ordinal", "logistic"):
        if name == "gbt":
            scored = ML.score(fit_boosted(tr, va, num, cat, **GBT)[0], va, num, cat, keep=["ra", "fase", "target"])
        elif name == "random_forest_ordinal":
            model = ML.fit(ML.rf_estimator(num + codes, [], **RF, imputer=imputer), tr_codes, num + codes, [], checkpoint=False)
            scored = ML.score(model, va_codes, num + codes, [], keep=["ra", "fase", "target"])
        else:
            pipe = ML.lr_estimator(num, cat, imputer=imputer) if name == "logistic" else ML.rf_estimator(num, cat, **RF, imputer=imputer)
            scored = ML.score(ML.fit(pipe, tr, num, cat, checkpoint=False), va, num, cat, keep=["ra", "fase", "target"])
        scored = materialize(scored)  # read by every metric
        auc = M.auc_table(scored)
        pol = M.operational_metrics(scored, 15.0)
        k = F.lit(name)  # the two one-row tables are paired on the model name
        r = auc.select(k.alias("model"), "auc").join(
            pol.select(k.alias("model"), "recall_at_k", "precision_at_k", "lift_at_k"), "model")
        rows = r if rows is None else rows.unionByName(r)
    return round_doubles(rows.orderBy(F.col("lift_at_k").desc()))


@query("boosting_kept_prefix", "SELECT 0 AS n_wrong_auc, 0 AS n_better_rounds, 0 AS n_rows_differ", ids=("M2", "M11"))
def boosting_kept_prefix(spark, sf_dir):
    """The kept prefix is saved with its metadata and loaded again; its scores are written and their AUC taken anew: it
    is the AUC of the best round in the metadata, no round before the patience ran out has a larger one, and the loaded model
    scores every row like the fitted one."""
    tr, va, num, cat = _feature_sets(spark, sf_dir)
    model, info = fit_boosted(tr, va, num, cat, **GBT)
    path = scratch_path(spark, f"model-{uuid.uuid4().hex[:10]}")
    ML.save_model(model, ML.model_metadata("gbt", num, cat, GBT, info), f"{path}/saved")
    again, meta = ML.load_model(f"{path}/saved")
    ML.score(again, va, num, cat, keep=["ra", "target"]).write.parquet(f"{path}/scores")
    scores = spark.read.parquet(f"{path}/scores")
    fitted = ML.score(model, va, num, cat, keep=["ra", "target"])
    differ = fitted.select("ra", "prob").exceptAll(scores.select("ra", "prob")).agg(F.count(F.lit(1)).cast("int").alias("n_rows_differ"))
    best, rounds = meta["metrics"]["best_auc"], meta["metrics"]["auc_by_round"][: meta["metrics"]["best_iteration"] + GBT["patience"]]
    wrong = M.auc_table(scores, "prob").agg(F.count_if(F.abs(F.col("auc") - F.lit(best)) > 1e-9).cast("int").alias("n_wrong_auc"))
    one = wrong.select("n_wrong_auc", F.lit(sum(a > best for a in rounds)).alias("n_better_rounds"), F.lit(1).alias("_k"))
    return one.join(differ.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query("isotonic_calibration", None, ids=("M7",))
def isotonic_calibration(spark, sf_dir):
    return _calibrated(spark, sf_dir).drop("fold_probs", "fold_calibrated")


def _calibrated(spark, sf_dir):
    tr, va, num, cat = _feature_sets(spark, sf_dir)
    bins = ML.bins_for(tr, cat)
    return ML.isotonic_calibrated(lambda: ML.gbt_estimator(num, cat, max_bins=bins, **FOLD_GBT), tr, va, num, cat, "ra")


@query("calibration_folds", "SELECT unnest([0, 1, 2]) AS fold, 0 AS n_falls, 0 AS n_outside, 0 AS n_wrong_means", ids=("M7",))
def calibration_folds(spark, sf_dir):
    """For each fold: neighbouring probabilities whose calibrated values fall, calibrated values outside [0, 1], and
    rows whose mean is not the mean of the folds."""
    rows = materialize(_calibrated(spark, sf_dir))
    mean = F.aggregate("fold_calibrated", F.lit(0.0), lambda a, v: a + v) / 3
    long = rows.select((F.abs(mean - F.col("prob_calibrated")) > 1e-12).alias("wrong"), F.posexplode(F.arrays_zip("fold_probs", "fold_calibrated")).alias("fold", "p"))
    values = long.groupBy("fold", F.col("p.fold_probs").alias("prob"), F.col("p.fold_calibrated").alias("calibrated")).agg(
        F.count_if("wrong").alias("wrong"), F.count_if(~F.col("p.fold_calibrated").between(0, 1)).alias("outside"))
    before = running_pairs(values, "fold", "prob", "calibrated")
    return before.groupBy("fold").agg(F.count_if(F.col("calibrated") < F.col("_previous") - 1e-12).cast("int").alias("n_falls"),
                                      F.sum("outside").cast("int").alias("n_outside"), F.sum("wrong").cast("int").alias("n_wrong_means"))


@query("linear_attributions", None, ids=("M8", "W6"))
def linear_attributions(spark, sf_dir):
    tr, va, num, cat = _feature_sets(spark, sf_dir)
    model = ML.fit(ML.lr_estimator(num, cat), tr, num, cat, checkpoint=False)
    return ML.linear_attributions(model, va, num, cat, "ra").drop("contributions")


def _attribution_table(spark, sf_dir):
    tr, va, num, cat = _feature_sets(spark, sf_dir)
    model = ML.fit(ML.lr_estimator(num, cat), tr, num, cat, checkpoint=False)
    return _report_columns(ML.attribution_by_stratum(ML.linear_attributions(model, va, num, cat, "ra"), [*num, *cat]))


def _report_columns(long):
    # F36 report columns: direction by sign (>= 0 raises risk), values to 6 decimals, share in percent to 1 decimal
    return long.select("fase", "feature", "n", F.round("mean_contrib", 6).alias("mean_contrib"),
                       F.round("mean_abs_contrib", 6).alias("mean_abs_contrib"),
                       F.round(F.col("pct_positive") * 100, 1).alias("pct_positive"),
                       F.when(F.col("mean_contrib") >= 0, F.lit("↑ risco")).otherwise(F.lit("↓ risco"))
                       .alias("direction"))


@query("attribution_by_stratum", None, ids=("A27", "F36"))
def attribution_by_stratum(spark, sf_dir):
    """Every feature, categorical ones included, over all rows of every stratum."""
    return _attribution_table(spark, sf_dir)


@query("attribution_top_by_stratum", None, ids=("A27", "W5", "F36"))
def attribution_top_by_stratum(spark, sf_dir):
    """The 20 features with the largest mean contribution of each stratum."""
    return top_n_per_group(_attribution_table(spark, sf_dir), "fase", "mean_abs_contrib", 20, tiebreak="feature")


@query("linear_attribution_margins", "SELECT 0 AS n_wrong_margins, 0 AS n_wrong_probabilities", ids=("M8",))
def linear_attribution_margins(spark, sf_dir):
    """Rows whose contributions and intercept do not add up to the model's margin, or whose probability leaves [0, 1]."""
    tr, va, num, cat = _feature_sets(spark, sf_dir)
    model = ML.fit(ML.lr_estimator(num, cat), tr, num, cat, checkpoint=False)
    a = ML.linear_attributions(model, va, num, cat, "ra")
    total = F.aggregate("contributions", F.lit(float(model.stages[-1].intercept)), lambda acc, v: acc + v)
    margin = F.log(F.col("prob") / (1 - F.col("prob")))
    return a.agg(F.count_if(F.abs(total - margin) > 1e-6).cast("int").alias("n_wrong_margins"),
                 F.count_if(~F.col("prob").between(0, 1)).cast("int").alias("n_wrong_probabilities"))


@query("permutation_importance", None, ids=("M9", "A26"))
def permutation_importance(spark, sf_dir):
    """Every feature of every stratum."""
    tr, va, num, cat = _feature_sets(spark, sf_dir)
    model, _ = fit_boosted(tr, va, num, cat, **GBT)
    return ML.permutation_importance(model, va, num, cat, "ra")


@query("gbt_tree_attributions", None, ids=("M8", "W6"))
def gbt_tree_attributions(spark, sf_dir):
    """Per-row path attributions of the boosted trees on the valid pair (top 3 factors with values)."""
    tr, va, num, cat = _feature_sets(spark, sf_dir)
    model, _ = fit_boosted(tr, va, num, cat, **GBT)
    return ML.tree_attributions(model, va, num, cat, "ra").drop("contributions")


VALID_SQL = B.with_ctes(B.B2_SQL) + """,
v AS (SELECT * FROM pairs WHERE pair_label = (SELECT max(pair_label) FROM pairs))
"""


@query("model_score_checks", VALID_SQL + """
SELECT fase, CAST(count(*) AS BIGINT) AS n, CAST(sum(target) AS BIGINT) AS n_pos, 0 AS n_outside, 0 AS n_wrong_scores, 0 AS n_wrong_labels
FROM v GROUP BY fase""", ids=("M1", "M3", "F34", "P13"))
def model_score_checks(spark, sf_dir):
    """Every row of the valid pair is scored once, in its stratum: probabilities outside [0, 1], scores that are not the
    percentage rounded half to even, and targets that the matrix lost. No identifier or target is a feature."""
    tr, va, num, cat = _feature_sets(spark, sf_dir)
    if {"ra", "ano_base", "pair_label", "target", "defasagem_t1"} & {*num, *cat}:
        raise ValueError("an identifier or the target is among the features")
    model = ML.fit(ML.lr_estimator(num, cat), tr, num, cat, checkpoint=False)
    scored = ML.score(model, va, num, cat, keep=["ra", "fase", "target"])
    label = ML.prepare(va, num, cat).where(F.col(ML.LABEL) != F.coalesce(F.col("target").cast("double"), F.lit(0.0)))
    wrong = label.groupBy(F.col("fase").alias("_f")).agg(F.count(F.lit(1)).cast("int").alias("_w"))
    exact = F.bround(F.col("prob").cast("decimal(38,30)") * 100, 4).cast("double")
    out = scored.groupBy("fase").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("target").cast("bigint")).alias("n_pos"),
                                     F.count_if(~F.col("prob").between(0, 1)).cast("int").alias("n_outside"),
                                     F.count_if(F.abs(F.col("score") - exact) > 1.01e-4).cast("int").alias("n_wrong_scores"))
    joined = out.join(wrong, F.col("fase").cast("string") == F.col("_f"), "left")
    return joined.select(F.col("fase").cast("int").alias("fase"), "n", "n_pos", "n_outside", "n_wrong_scores", F.coalesce("_w", F.lit(0)).alias("n_wrong_labels"))


@query("importance_strata", VALID_SQL + """
SELECT CAST(fase AS VARCHAR) AS fase, CAST(count(*) AS BIGINT) AS n, count(*) < 30 AS unstable, 0 AS n_missing_features FROM v GROUP BY fase""",
       ids=("M9", "A26"))
def importance_strata(spark, sf_dir):
    """Strata of the importance table with their rows, the flag of small ones, and features without a row there."""
    tr, va, num, cat = _feature_sets(spark, sf_dir)
    model = ML.fit(ML.lr_estimator(num, cat), tr, num, cat, checkpoint=False)
    per = ML.permutation_importance(model, va, num, cat, "ra").groupBy("fase").agg(
        F.max("n").alias("n"), F.max("unstable").alias("unstable"), F.countDistinct("feature").alias("_k"))
    return per.select(F.col("fase").cast("string").alias("fase"), "n", "unstable", (F.lit(len(num) + len(cat)) - F.col("_k")).cast("int").alias("n_missing_features"))


@query("attribution_checks", VALID_SQL + """
SELECT CAST(fase AS VARCHAR) AS fase, CAST(count(*) AS BIGINT) AS n, 0 AS n_wrong_directions, 0 AS n_wrong_shares, 0 AS n_wrong_sums FROM v GROUP BY fase""",
       ids=("A27", "F36", "M10"))
def attribution_checks(spark, sf_dir):
    """The attribution report of each stratum: rows; features whose direction is not the sign of their mean (the sign is taken
    before the mean is rounded), whose share
    leaves 0 to 100, and strata whose means do not add up to the mean margin less the intercept."""
    tr, va, num, cat = _feature_sets(spark, sf_dir)
    model = ML.fit(ML.lr_estimator(num, cat), tr, num, cat, checkpoint=False)
    rows = materialize(ML.linear_attributions(model, va, num, cat, "ra"))
    margin = F.log(F.col("prob") / (1 - F.col("prob"))) - F.lit(float(model.stages[-1].intercept))
    margins = rows.groupBy(F.col("fase").alias("_f")).agg(F.avg(margin).alias("_margin"))
    table = _report_columns(ML.attribution_by_stratum(rows, [*num, *cat]))
    per = table.groupBy("fase").agg(
        F.max("n").alias("n"), F.sum("mean_contrib").alias("_sum"),
        F.count_if((F.abs("mean_contrib") > 1e-6) & (F.col("direction") != F.when(F.col("mean_contrib") >= 0, F.lit("↑ risco")).otherwise(F.lit("↓ risco")))).cast("int").alias("n_wrong_directions"),
        F.count_if(~F.col("pct_positive").between(0, 100)).cast("int").alias("n_wrong_shares"))
    # each mean is rounded to 6 decimals
    off = (F.abs(F.col("_sum") - F.col("_margin")) > F.lit(1e-6 * (len(num) + len(cat)) + 1e-6)).cast("int")
    return per.join(margins, F.col("fase").eqNullSafe(F.col("_f"))).select(F.col("fase").cast("string").alias("fase"), "n", "n_wrong_directions", "n_wrong_shares", off.alias("n_wrong_sums"))
