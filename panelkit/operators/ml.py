"""Risk models with Spark ML.

Boosted trees replace the reference's gradient-boosting library (``GBTClassifier`` with a validation indicator for
early stopping and balanced class weights), the random-forest pipeline becomes Imputer → StringIndexer →
OneHotEncoder → RandomForestClassifier, isotonic calibration uses out-of-fold scores with hash folds, and per-row
attributions are exact linear contributions of a logistic model (coef · (x − mean)), computed as native array
expressions, or path attributions of a tree ensemble walked per Arrow batch in ``mapInPandas`` (bias + Σ contributions
equals the model margin). Everything trains and scores on executors; only fitted model parameters live on the driver.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, ImputerModel, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators.features import feature_columns
from panelkit.operators.forest import forest_of
from panelkit.operators.topk import top3_by_magnitude
from panelkit.schema import DEFAULT, PanelSchema
from panelkit.session import materialize

LABEL, WEIGHT, FEATURES = "_label", "_weight", "_features"


def class_weights(df: DataFrame, target: str = "target") -> DataFrame:
    """Balanced weights n / (classes · n_class) per class (one small aggregate)."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n_class"))
    tot = counts.agg(F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k"))
    row = tot.first()
    return counts.select(target, "n_class",
                         (F.lit(float(row["n"])) / (F.lit(float(row["k"])) * F.col("n_class"))).alias("weight"))


def with_weights(df: DataFrame, target: str = "target") -> DataFrame:
    """Attach the balanced weight of each row's class; the weight table has one row per class (broadcast-sized)."""
    w = class_weights(df, target).select(target, F.col("weight").alias(WEIGHT))
    return df.join(F.broadcast(w), target, "left")


def prepare(df: DataFrame, num: list[str], cat: list[str], target: str = "target") -> DataFrame:
    """M1: missing feature columns added as nulls, categorical values as strings with a real missing token, label
    from the target with nulls as 0."""
    cols = []
    for c in num:
        cols.append((F.col(c) if c in df.columns else F.lit(None)).cast("double").alias(c))
    for c in cat:
        cols.append(F.coalesce((F.col(c) if c in df.columns else F.lit(None)).cast("string"),
                               F.lit("MISSING_CATEGORY")).alias(c))
    keep = [c for c in df.columns if c not in set(num) | set(cat)]
    return df.select(*keep, *cols, F.coalesce(F.col(target).cast("double"), F.lit(0.0)).alias(LABEL))


def _encoders(cat: list[str], one_hot: bool):
    # one multi-column indexer: all categorical vocabularies are fitted in a single pass over the data
    idx = [StringIndexer(inputCols=cat, outputCols=[f"{c}__idx" for c in cat], handleInvalid="keep")] if cat else []
    if not one_hot or not cat:
        return idx, [f"{c}__idx" for c in cat]
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in cat], outputCols=[f"{c}__ohe" for c in cat],
                        handleInvalid="keep")
    return idx + [ohe], [f"{c}__ohe" for c in cat]


def bins_for(train: DataFrame, cat: list[str]) -> int:
    """Bins that the largest categorical feature of ``train`` needs (its values, one for unknown), 32 at least."""
    if not cat:
        return 32
    row = train.agg(*[F.countDistinct(c) for c in cat]).first()  # one row
    return max(32, max(row) + 2)


def gbt_estimator(num: list[str], cat: list[str], max_iter: int = 2500, depth: int = 8, step: float = 0.1,
                 max_bins: int = 128, seed: int = 42, validation_col: str | None = None) -> Pipeline:
    """M2: boosted trees on indexed categoricals and numeric features; row and column subsampling 0.8; balanced
    weights; optional validation indicator column for early stopping (on loss). ``max_bins`` must reach the largest
    categorical feature (:func:`bins_for`)."""
    stages, cat_out = _encoders(cat, one_hot=False)
    assembler = VectorAssembler(inputCols=num + cat_out, outputCol=FEATURES, handleInvalid="keep")
    gbt = GBTClassifier(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, maxIter=max_iter, maxDepth=depth,
                        stepSize=step, subsamplingRate=0.8, featureSubsetStrategy="0.8", maxBins=max_bins, seed=seed)
    if validation_col:
        gbt = gbt.setValidationIndicatorCol(validation_col)
    return Pipeline(stages=stages + [assembler, gbt])


def imputer_of(num: list[str]) -> Imputer:
    """Medians for missing numbers, as ``<column>__imp``."""
    return Imputer(inputCols=num, outputCols=[f"{c}__imp" for c in num], strategy="median")


def _imputers(num: list[str], fitted: ImputerModel | None) -> list:
    """The imputer of ``num``; columns that ``fitted`` knows are taken from it."""
    rest = [c for c in num if fitted is None or c not in set(fitted.getInputCols())]
    return ([fitted] if fitted is not None else []) + ([imputer_of(rest)] if rest else [])


def rf_estimator(num: list[str], cat: list[str], trees: int = 300, depth: int = 12, min_leaf: int = 5,
                seed: int = 42, imputer: ImputerModel | None = None) -> Pipeline:
    """M4: median imputation, one-hot categoricals (unknown kept), 300 trees, depth 12, min leaf 5, sqrt features,
    balanced weights. ``imputer`` was fitted on the same rows before."""
    stages, cat_out = _encoders(cat, one_hot=True)
    assembler = VectorAssembler(inputCols=[f"{c}__imp" for c in num] + cat_out, outputCol=FEATURES,
                                handleInvalid="keep")
    rf = RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, numTrees=trees, cacheNodeIds=True,
                                maxDepth=depth, minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", seed=seed)
    return Pipeline(stages=_imputers(num, imputer) + stages + [assembler, rf])


def lr_estimator(num: list[str], cat: list[str], reg: float = 0.01, imputer: ImputerModel | None = None) -> Pipeline:
    """Linear model used for exact per-row attributions (M8): median-imputed, standardised numeric features."""
    stages, cat_out = _encoders(cat, one_hot=True)
    assembler = VectorAssembler(inputCols=[f"{c}__imp" for c in num], outputCol="_num_vec", handleInvalid="keep")
    scaler = StandardScaler(inputCol="_num_vec", outputCol="_num_std", withMean=True, withStd=True)
    full = VectorAssembler(inputCols=["_num_std"] + cat_out, outputCol=FEATURES, handleInvalid="keep")
    lr = LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, regParam=reg, maxIter=100)
    return Pipeline(stages=_imputers(num, imputer) + stages + [assembler, scaler, full, lr])


def fit(pipeline: Pipeline, train: DataFrame, num: list[str], cat: list[str], target: str = "target",
        checkpoint: bool = True) -> PipelineModel:
    """Fit on the prepared, weighted training rows. The prepared frame is checkpointed first because every encoder
    re-reads it; pass checkpoint=False when ``train`` is already a checkpointed table (preparing it again
    is then a cheap projection and a join with a per-class table). The encoded vectors are checkpointed, as the model
    reads them several times."""
    data = with_weights(prepare(train, num, cat, target), LABEL)
    if checkpoint:
        data = materialize(data)
    *encoders, last = pipeline.getStages()
    encoded = Pipeline(stages=encoders).fit(data)
    vectors = materialize(encoded.transform(data).select(FEATURES, LABEL, WEIGHT))
    return PipelineModel([*encoded.stages, last.fit(vectors)])


def score(model: PipelineModel, df: DataFrame, num: list[str], cat: list[str], target: str = "target",
          keep: list[str] | None = None) -> DataFrame:
    """M3: probability of the positive class and the 0..100 score rounded half-to-even to 4 decimals."""
    data = df if target in df.columns else df.withColumn(target, F.lit(None).cast("int"))
    out = model.transform(prepare(data, num, cat, target))
    prob = vector_to_array(F.col("probability"))[1]
    keep = keep or [c for c in df.columns if c not in set(num) | set(cat)]
    return out.select(*keep, prob.alias("prob"), F.bround(prob * 100.0, 4).alias("score"))


def ordinal_codes(df: DataFrame, cols: list[str], train: DataFrame) -> DataFrame:
    """M6: ordinal codes learnt on train; values unseen in train get −1."""
    if not cols:
        return df
    # one multi-column indexer: a single pass over the training rows
    model = StringIndexer(inputCols=cols, outputCols=[f"{c}__code" for c in cols], handleInvalid="keep").fit(train)
    out = model.transform(df)
    sel = []
    for labels, c in zip(model.labelsArray, cols):
        n = len(labels)
        sel.append(F.when(F.col(f"{c}__code") >= n, F.lit(-1)).otherwise(F.col(f"{c}__code").cast("int")).alias(
            f"{c}__code"))
    return out.select(*[x for x in df.columns], *sel)


def isotonic_calibrated(estimator_factory, train: DataFrame, test: DataFrame, num: list[str], cat: list[str],
                        entity: str, target: str = "target", folds: int = 3, carry: list[str] | None = None) -> DataFrame:
    """M7: the mean of ``folds`` calibrated models. Fold = pmod(xxhash64(entity), folds); each model is fitted on the
    other folds' rows and its isotonic map on its own fold's probabilities, which it never saw.

    Returns the test rows with ``prob`` and ``prob_calibrated`` (means over the folds) and the arrays ``fold_probs``
    and ``fold_calibrated``; ``carry`` names further columns to keep."""
    fold = F.pmod(F.xxhash64(F.col(entity).cast("string")), F.lit(folds))
    tagged = train.withColumn("_fold", fold)
    keep = list(dict.fromkeys([entity, target, *(carry or [])]))
    vectors = test.withColumns({"_probs": F.array().cast("array<double>"), "_calibrated": F.array().cast("array<double>")})
    for f in range(folds):
        model = fit(estimator_factory(), tagged.filter(F.col("_fold") != f), num, cat, target)
        held_out = score(model, tagged.filter(F.col("_fold") == f), num, cat, target, keep=[target])
        iso = IsotonicRegression(featuresCol="prob", labelCol="_y").fit(
            held_out.select("prob", F.coalesce(F.col(target).cast("double"), F.lit(0.0)).alias("_y")))
        # a row carries its lists through the models, so nothing is joined by key
        part = score(model, vectors, num, cat, target, keep=[*vectors.columns])
        both = iso.transform(part.drop("score"))
        vectors = both.select(*[c for c in vectors.columns if c not in ("_probs", "_calibrated")],
                              F.concat("_probs", F.array("prob")).alias("_probs"),
                              F.concat("_calibrated", F.array("prediction")).alias("_calibrated"))

    def mean(c: str) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v) / F.lit(float(folds))

    return vectors.select(*keep, mean("_probs").alias("prob"), mean("_calibrated").alias("prob_calibrated"),
                          F.col("_probs").alias("fold_probs"), F.col("_calibrated").alias("fold_calibrated"))


def linear_attributions(model: PipelineModel, df: DataFrame, num: list[str], cat: list[str], entity: str,
                        target: str = "target", k: int = 3) -> DataFrame:
    """M8: exact contributions of every feature in a logistic model, numeric ones as coef_j · z_j of the standardised
    value, a categorical one as the coefficient of the row's category; Σ contributions + intercept = margin. The k
    largest by magnitude per row as (top3_factors, top3_values) — native array expressions, no Python. The order of
    ``contributions`` is ``num`` then ``cat``."""
    lr = model.stages[-1]
    coefs = [float(c) for c in lr.coefficients.toArray()]
    sizes = next((list(s.categorySizes) for s in model.stages if hasattr(s, "categorySizes")), [])
    out = model.transform(prepare(df, num, cat, target))
    parts = F.zip_with(vector_to_array(F.col(FEATURES)), F.lit(coefs), lambda x, c: x * c)
    starts = [len(num) + sum(sizes[:i]) for i in range(len(sizes))]
    groups = [F.aggregate(F.slice(F.col("_parts"), a + 1, n), F.lit(0.0), lambda acc, v: acc + v) for a, n in zip(starts, sizes)]
    out = out.withColumn("_parts", parts)
    contrib = F.concat(F.slice("_parts", 1, len(num)), F.array(*groups)) if groups else F.slice("_parts", 1, len(num))
    out = out.withColumn("_contrib", contrib)
    top_n, top_v = top3_by_magnitude(F.lit([*num, *cat]), F.col("_contrib"), k)
    return out.select(entity, *[c for c in ("fase",) if c in df.columns], F.col("_contrib").alias("contributions"),
                      top_n.alias("top3_factors"), top_v.alias("top3_values"),
                      vector_to_array(F.col("probability"))[1].alias("prob"))


def attribution_by_stratum(attr: DataFrame, names: list[str], stratum: str = "fase") -> DataFrame:
    """Per (stratum, feature): rows, mean contribution, mean |contribution| and share of positive ones — the
    contribution arrays are exploded and aggregated (one shuffle on (stratum, feature))."""
    z = attr.select(stratum, F.posexplode("contributions").alias("_i", "v"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_i") + 1)
    return z.groupBy(stratum, name.alias("feature")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_contrib"), F.avg(F.abs("v")).alias("mean_abs_contrib"),
        F.avg((F.col("v") > 0).cast("double")).alias("pct_positive"))


def _logloss(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    q = np.clip(p, 1e-15, 1 - 1e-15)
    return -(y * np.log(q) + (1 - y) * np.log(1 - q))


class _Swaps:
    """Margins of rows after each feature's columns are taken from another row, without building the swapped rows."""

    def __init__(self, model: PipelineModel, spark, num: list[str], cat: list[str]):
        last = model.stages[-1]
        sizes = next((list(s.categorySizes) for s in model.stages if hasattr(s, "categorySizes")), [1] * len(cat))
        starts = [len(num) + sum(sizes[:i]) for i in range(len(cat))]
        self.places = [[i] for i in range(len(num))] + [list(range(a, a + n)) for a, n in zip(starts, sizes)]
        self.linear = hasattr(last, "coefficients")
        if self.linear:
            self.coef, self.bias, self.scale = np.array(last.coefficients.toArray()), float(last.intercept), 1.0
        else:
            self.forest, self.scale = forest_of(spark, last), 2.0  # boosted trees: log-odds are twice the margin

    def margins(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        if self.linear:
            return x @ self.coef + self.bias, None
        terms = self.forest.terms(x)
        return terms.sum(axis=1), terms

    def swapped(self, x: np.ndarray, other: np.ndarray, margin: np.ndarray, terms: np.ndarray | None, feature: int) -> np.ndarray:
        at = self.places[feature]
        if self.linear:
            return margin + (other[:, at] - x[:, at]) @ self.coef[at]
        trees = self.forest.trees_of(feature)  # the others give what they gave
        if not len(trees):
            return margin
        new = x.copy()
        new[:, at] = other[:, at]
        return margin + self.forest.terms(new, trees).sum(axis=1) - terms[:, trees].sum(axis=1)

    def prob(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.scale * margin))


def permutation_importance(model: PipelineModel, df: DataFrame, num: list[str], cat: list[str], entity: str,
                           features: list[str] | None = None, stratum: str = "fase", target: str = "target",
                           seed: int = 42, min_n: int = 30, buckets: int | None = None) -> DataFrame:
    """Per (stratum, feature) the increase in log-loss when that feature's column is permuted across rows;
    every feature unless ``features`` names some. For boosted trees and the logistic model.

    The permutation is drawn inside random hash buckets of rows (eight for each shuffle partition): within a bucket the
    i-th row by one seeded hash receives the values of the i-th row by another, via one equi-join on (bucket, rank), so
    no task ever ranks the whole table and every row gets exactly one partner. A batch of paired rows is scored for all
    features inside its task (only the trees that split on a feature are walked again) and sends the loss sums of its
    strata: no row is copied for a feature. Strata with fewer than ``min_n`` rows are flagged unstable."""
    from pyspark.sql import Window

    spark, every = df.sparkSession, [*num, *cat]
    feats = [c for c in (features or every) if c in df.columns]
    at = [every.index(c) for c in feats]
    n = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    key = F.col(entity).cast("string")
    vectors = model.transform(prepare(df, num, cat, target)).select(
        F.col(entity), F.col(stratum).alias("_s"), F.col(LABEL).alias("_y"), vector_to_array(F.col(FEATURES)).alias("_x"))
    dealt = vectors.withColumn("_b", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n)))

    def ranked(by: str) -> Column:
        return F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(key, F.lit(by)), key)).alias("_r")

    donors = dealt.select("_b", ranked("donor"), F.col("_x").alias("_d"))
    pairs = dealt.select("_b", "_s", "_y", "_x", ranked("row")).join(donors, ["_b", "_r"]).select("_s", "_y", "_x", "_d")
    swaps = spark.sparkContext.broadcast(_Swaps(model, spark, num, cat))

    def run(batches):
        s = swaps.value
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x, other = (np.asarray(batch.column(i).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1) for i in (2, 3))
            strata = batch.column(0).dictionary_encode()
            codes = strata.indices.fill_null(len(strata.dictionary)).to_numpy()
            margin, terms = s.margins(x)
            rows = np.bincount(codes)
            seen = np.flatnonzero(rows)
            names = [strata.dictionary[int(c)].as_py() if c < len(strata.dictionary) else None for c in seen]
            for i in [-1, *at]:  # -1: as they are
                m = margin if i < 0 else s.swapped(x, other, margin, terms, i)
                loss = np.bincount(codes, weights=_logloss(s.prob(m), y))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, batch.schema.field(0).type), pa.array([i] * len(seen), pa.int32()), pa.array(loss[seen]), pa.array(rows[seen].astype(np.int64))],
                    names=["_s", "_i", "_loss", "_n"])

    kind = vectors.schema["_s"].dataType.simpleString()
    sums = pairs.mapInArrow(run, f"_s {kind}, _i int, _loss double, _n long").groupBy("_s", "_i").agg(F.sum("_loss").alias("_loss"), F.sum("_n").alias("_n"))
    before = Window.partitionBy("_s")  # one row a feature
    mean = F.col("_loss") / F.col("_n")
    out = sums.withColumn("_base", F.max(F.when(F.col("_i") < 0, mean)).over(before)).where(F.col("_i") >= 0)
    name = F.array(*[F.lit(c) for c in every])[F.col("_i")]
    return out.select(F.col("_s").alias(stratum), name.alias("feature"), (mean - F.col("_base")).alias("importance"), F.col("_n").alias("n"),
                      (F.col("_n") < min_n).alias("unstable"))


def model_metadata(model_kind: str, num: list[str], cat: list[str], params: dict, metrics: dict) -> dict:
    """The document saved with a model (features, parameters, validation metrics)."""
    return {"model_kind": model_kind, "num_features": num, "cat_features": cat, "params": params, "metrics": metrics}


def save_model(model: PipelineModel, meta: dict, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    s.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(path: str) -> tuple[PipelineModel, dict]:
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    meta = json.loads(s.read.option("wholetext", "true").text(f"{path}/meta").first()[0])
    return PipelineModel.load(f"{path}/model"), meta


def split_features(feats: DataFrame, schema: PanelSchema = DEFAULT) -> tuple[list[str], list[str]]:
    """P13 for model inputs."""
    return feature_columns(feats, schema)


# ------------------------------------------------------------------------------------------------ tree attribution
def tree_attributions(model: PipelineModel, df: DataFrame, num: list[str], cat: list[str], entity: str,
                      target: str = "target", k: int = 3) -> DataFrame:
    """M8 for tree ensembles: per-row path attributions of the fitted forest via ``mapInPandas`` (Arrow batches; the
    forest's arrays are broadcast, their size is bounded by the model's). Returns the entity, the model margin, the
    bias, the per-feature contributions and the top-k by magnitude (native array functions)."""
    spark = df.sparkSession
    forest = spark.sparkContext.broadcast(forest_of(spark, model.stages[-1]))
    assemblers = [s for s in model.stages if type(s).__name__ == "VectorAssembler"]
    names = list(assemblers[-1].getInputCols()) if assemblers else num + cat
    prepared = model.transform(prepare(df, num, cat, target)).select(
        F.col(entity).cast("string").alias("_e"), vector_to_array(F.col(FEATURES)).alias("_x"))

    def run(batches):
        for b in batches:
            if len(b) == 0:
                continue
            bias, contrib, margin = forest.value.contributions(np.vstack(b["_x"].to_numpy()), len(names))
            yield pd.DataFrame({"_e": b["_e"], "margin": margin, "bias": bias, "contributions": list(contrib)})

    out = prepared.mapInPandas(run, "_e string, margin double, bias double, contributions array<double>")
    top_n, top_v = top3_by_magnitude(F.array(*[F.lit(c) for c in names]), F.col("contributions"), k)
    return out.select(F.col("_e").alias(entity), "margin", "bias", "contributions", top_n.alias("top3_factors"),
                      top_v.alias("top3_values"))
