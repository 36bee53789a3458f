"""Forest walks, boosting with patience, fold calibration and importance on the smallest tables."""

import inspect
from functools import partialmethod

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from panelkit.operators import features as FE
from panelkit.operators import ml as ML
from panelkit.operators import pairs as P
from panelkit.operators.boosting import best_round, fit_boosted, prefix_margins
from panelkit.operators.forest import Forest, first_trees, forest_of, saved
from panelkit.operators.ranking import running_pairs
from panelkit import session
from panelkit.plans import bindings as B
from panelkit.plans import q_ml
from panelkit.session import materialize, spread

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sets(spark):
    panel = B.cust_year(spark, SF)
    train, valid = P.temporal_split(materialize(P.build_pairs(panel)), panel)
    tr, va, _ = FE.build_features(train, valid, keys_mode="latest")
    tr, va = materialize(tr), materialize(va)
    return (tr, va, *FE.feature_columns(tr))


@pytest.fixture(scope="module")
def model(spark, sets):
    tr, _, num, cat = sets
    return ML.fit(ML.gbt_estimator(num, cat, max_iter=6, depth=4, max_bins=ML.bins_for(tr, cat)), tr, num, cat)


def matrix(model, df, num, cat):
    rows = model.transform(ML.prepare(df, num, cat)).select(vector_to_array(ML.FEATURES).alias("x"), vector_to_array("rawPrediction").alias("raw"), vector_to_array("probability").alias("p"), ML.LABEL, "fase", "ra").collect()
    return np.array([r.x for r in rows]), np.array([r.raw[1] for r in rows]), rows


def test_walk_equals_the_models_margin(spark, sets, model):
    _, va, num, cat = sets
    forest = forest_of(spark, model.stages[-1])
    x, raw, _ = matrix(model, va, num, cat)
    # the raw prediction of boosted trees is twice the margin
    assert np.allclose(2 * forest.terms(x).sum(axis=1), raw, atol=1e-9) or np.allclose(forest.terms(x).sum(axis=1), raw, atol=1e-9)
    bias, parts, margin = forest.contributions(x, x.shape[1])
    assert np.allclose(bias + parts.sum(axis=1), margin)


def test_category_splits():
    forest = Forest([[(0, 0.0, np.array([True, False, True]), 1, 2, 0.0), (-1, 0.0, None, 1, 1, 5.0), (1, 0.5, None, 3, 4, 0.0), (-1, 0.0, None, 3, 3, 7.0), (-1, 0.0, None, 4, 4, 9.0)], [(-1, 0.0, None, 0, 0, 1.0)]], [1.0, 0.5])
    x = np.array([[0.0, 9.0], [1.0, 0.5], [1.0, 0.6], [2.0, 0.0], [1.0, np.nan]])
    assert forest.terms(x).tolist() == [[5, 0.5], [7, 0.5], [9, 0.5], [5, 0.5], [9, 0.5]]
    assert forest.trees_of(1).tolist() == [0] and forest.trees_of(5).tolist() == []


def test_first_trees_equal_a_shorter_fit(spark, sets, model):
    """The cut ensemble scores like one that was fitted for so many rounds with the same seed."""
    tr, va, num, cat = sets
    cut = first_trees(spark, saved(spark, model.stages[-1]), 3)
    short = ML.fit(ML.gbt_estimator(num, cat, max_iter=3, depth=4, max_bins=ML.bins_for(tr, cat)), tr, num, cat)
    vectors = model.transform(ML.prepare(va, num, cat)).drop("prediction", "rawPrediction", "probability")
    a = [r.p for r in cut.transform(vectors).orderBy("ra").select(vector_to_array("probability")[1].alias("p")).collect()]
    b = [r.prob for r in ML.score(short, va, num, cat, keep=["ra"]).orderBy("ra").collect()]
    assert cut.getNumTrees == 3 and np.allclose(a, b)


def test_prefix_margins(spark, sets, model):
    _, va, num, cat = sets
    vectors = model.transform(ML.prepare(va, num, cat)).select(ML.FEATURES, ML.LABEL)
    got = prefix_margins(vectors, saved(spark, model.stages[-1]))
    x, _, rows = matrix(model, va, num, cat)
    want = np.cumsum(forest_of(spark, model.stages[-1]).terms(x), axis=1)
    assert got.count() == want.size
    assert np.allclose(sorted(r.margin for r in got.where("round = 2").collect()), sorted(want[:, 1]))


def test_patience():
    assert best_round([0.5, 0.6, 0.6, 0.55], 2) == (2, True)
    assert best_round([0.5, 0.4, 0.4, 0.9], 2) == (1, True)  # the later gain comes too late
    assert best_round([0.5, 0.4, 0.9, 0.4], 2) == (3, False)
    assert best_round([0.7], 1) == (1, False)


def test_fit_boosted_doubles_and_cuts(sets):
    tr, va, num, cat = sets
    model, info = fit_boosted(tr, va, num, cat, max_iter=8, depth=3, patience=3, first=4)
    n = info["best_iteration"]
    assert model.stages[-1].getNumTrees == n and len(info["auc_by_round"]) == info["fitted_rounds"] in (4, 8)
    assert info["best_auc"] == max(info["auc_by_round"][: n + 3])
    assert info["stopped_by_patience"] == (best_round(info["auc_by_round"], 3)[1])
    assert info["stopped_by_patience"] or info["fitted_rounds"] == 8


def sizes_asked(spark, sets, monkeypatch, query):
    """Rounds, depth and patience that ``query`` asks for; what is fitted here is small."""
    asked = []

    def record(*args, **sizes):
        call = inspect.signature(fit_boosted).bind(*args, **sizes)
        call.apply_defaults()
        asked.append(tuple(call.arguments[k] for k in ("max_iter", "depth", "patience")))
        return fit_boosted(*args, max_iter=2, depth=2, patience=1)

    monkeypatch.setattr(q_ml, "_feature_sets", lambda spark, sf_dir: sets)
    monkeypatch.setattr(q_ml, "fit_boosted", record)
    assert query(spark, SF).count() > 0
    return asked


def test_scores_come_from_a_model_of_full_size(spark, sets, monkeypatch):
    assert sizes_asked(spark, sets, monkeypatch, q_ml.gbt_valid_scores) == [(2500, 8, 200)]


def test_policy_comes_from_a_model_of_full_size(spark, sets, monkeypatch):
    assert sizes_asked(spark, sets, monkeypatch, q_ml.gbt_valid_policy) == [(2500, 8, 200)]


def test_comparison_fits_every_median_and_reads_encoded_rows_once(spark, sets, monkeypatch):
    """The medians are shared by the models, and no model reads rows that are still to be encoded."""
    medians, plans = [], []

    def count_columns(imputer, df, fit=Imputer._fit):
        medians.extend(imputer.getInputCols())
        return fit(imputer, df)

    def note_plan(model, df, fit=RandomForestClassifier._fit):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return fit(model, df)

    monkeypatch.setattr(Imputer, "_fit", count_columns)
    for kind in (GBTClassifier, RandomForestClassifier, LogisticRegression):
        monkeypatch.setattr(kind, "_fit", partialmethod(note_plan, fit=kind._fit))
    monkeypatch.setattr(q_ml, "_feature_sets", lambda spark, sf_dir: sets)
    monkeypatch.setattr(q_ml, "GBT", {"max_iter": 2, "depth": 2, "patience": 2, "first": 2})
    monkeypatch.setattr(q_ml, "RF", {"trees": 2, "depth": 2})
    assert q_ml.model_comparison(spark, SF).count() == 4
    assert len(medians) == len(set(medians)) >= len(sets[2])
    assert len(plans) == 4 and all("LogicalRDD" in p and "Join" not in p and "UDF" not in p for p in plans)


def test_a_fitted_imputer_gives_the_same_forest(sets):
    tr, va, num, cat = sets
    fitted = ML.imputer_of(num).fit(ML.prepare(tr, num, cat))
    probs = [sorted(r.prob for r in ML.score(ML.fit(ML.rf_estimator(num, cat, trees=3, depth=3, imputer=i), tr, num, cat), va, num, cat, keep=["ra"]).collect())
             for i in (None, fitted)]
    assert probs[0] == probs[1]


def test_importance_equals_scoring_swapped_rows(spark, sets, model):
    """Against the plain way: build each swapped matrix and walk the whole forest."""
    _, va, num, cat = sets
    for fitted, scale in ((model, 2.0), (ML.fit(ML.lr_estimator(num, cat), sets[0], num, cat), 1.0)):
        swaps = ML._Swaps(fitted, spark, num, cat)
        x, _, _ = matrix(fitted, va, num, cat)
        other = x[::-1]
        margin, terms = swaps.margins(x)
        for i in range(len(num) + len(cat)):
            new = x.copy()
            new[:, swaps.places[i]] = other[:, swaps.places[i]]
            assert np.allclose(swaps.swapped(x, other, margin, terms, i), swaps.margins(new)[0])


def test_importance_rows(sets, model):
    _, va, num, cat = sets
    got = ML.permutation_importance(model, va, num, cat, "ra", buckets=2).collect()
    strata = {r.fase: r.n for r in va.groupBy("fase").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(got) == len(strata) * (len(num) + len(cat))
    assert all(r.n == strata[r.fase] and r.unstable == (r.n < 30) for r in got)
    assert any(r.importance != 0 for r in got)


def test_isotonic_map_is_the_min_max_formula(spark):
    """Spark's pooled adjacent violators against max over starts of min over ends of the mean between, in SQL."""
    rng = np.random.default_rng(3)
    rows = [(round(float(p), 2), float(rng.random() < p)) for p in rng.random(200)]
    df = spark.createDataFrame(rows, "prob double, y double")
    iso = IsotonicRegression(featuresCol="prob", labelCol="y").fit(df)
    df.createOrReplaceTempView("held_out")
    want = spark.sql("""
      WITH v AS (SELECT prob, sum(y) AS s, count(*) AS n FROM held_out GROUP BY prob),
      m AS (SELECT a.prob AS x, b.prob AS lo, c.prob AS hi, (SELECT sum(s) / sum(n) FROM v WHERE v.prob BETWEEN b.prob AND c.prob) AS mean
            FROM v a JOIN v b ON b.prob <= a.prob JOIN v c ON c.prob >= a.prob)
      SELECT x, max(least_mean) AS value FROM (SELECT x, lo, min(mean) AS least_mean FROM m GROUP BY x, lo) GROUP BY x""")
    got = {r.prob: r.prediction for r in iso.transform(df.select("prob").distinct()).collect()}
    assert all(abs(got[r.x] - r.value) < 1e-9 for r in want.collect())


def test_fold_calibration(sets):
    tr, va, num, cat = sets
    out = ML.isotonic_calibrated(lambda: ML.lr_estimator(num, cat), tr, va, num, cat, "ra", folds=2, carry=["fase"]).collect()
    assert len(out) == va.count()
    for r in out:
        assert len(r.fold_probs) == len(r.fold_calibrated) == 2 and r.fase is not None
        assert abs(np.mean(r.fold_probs) - r.prob) < 1e-12 and abs(np.mean(r.fold_calibrated) - r.prob_calibrated) < 1e-12


def test_running_pairs(spark):
    rows = [(k, float(i), float((i * 7) % 5)) for k in (1, 2, None) for i in range(40)]
    got = {(r.k, r.x): r._previous for r in running_pairs(spark.createDataFrame(rows, "k int, x double, v double"), "k", "x", "v", 5).collect()}
    for k, x, _ in rows:
        before = [v for kk, xx, v in rows if kk == k and xx < x]
        assert got[k, x] == (max(before) if before else None)


def test_ordinal_forest(sets):
    tr, va, num, cat = sets
    codes = [f"{c}__code" for c in cat]
    model = ML.fit(ML.rf_estimator(num + codes, [], trees=3, depth=3), ML.ordinal_codes(tr, cat, tr), num + codes, [])
    assert ML.score(model, ML.ordinal_codes(va, cat, tr), num + codes, [], keep=["ra"]).count() == va.count()


def test_training_rows_are_spread_by_their_size(spark, monkeypatch):
    """The share of a task is a number of bytes, not the rows over a fixed number of partitions."""
    few = materialize(spark.range(1000).select(*[F.col("id").alias(f"c{i}") for i in range(10)]).coalesce(1))
    assert spread(few, 1000).rdd.getNumPartitions() == 1  # small tables stay as they are
    whole = q_ml._feature_sets(spark, SF)[:2]
    monkeypatch.setattr(session, "TASK_BYTES", 1 << 13)
    dealt = q_ml._feature_sets(spark, SF)[:2]
    for a, b in zip(whole, dealt, strict=True):
        rows = b.rdd.glom().map(len).collect()
        assert max(rows) * 16 * len(b.columns) <= 2 * (1 << 13)
        assert len(rows) > a.rdd.getNumPartitions()
        a, b = (df.select("ra", "ano_base", "fase", "target") for df in (a, b))  # means differ in their last digits by the order of rows
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
