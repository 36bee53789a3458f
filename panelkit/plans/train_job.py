"""The batch training job as one Spark job: panel → pairs → temporal split → cohort summary →
features (fit on train, apply to valid) → model → scores for both splits → evaluation → artefacts.

Artefacts (all written through Spark under ``out_dir``): cohort summary and evaluation documents, the lookup tables,
the model with its metadata, scored train / valid / history exports with the key columns first, and an empty drift
history folder. Nothing but one-row metric documents passes through the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators import features as FE
from panelkit.operators import metrics as M
from panelkit.operators import ml as ML
from panelkit.operators.boosting import fit_boosted
from panelkit.operators import pairs as P
from panelkit.schema import DEFAULT, PanelSchema
from panelkit.session import materialize, spread
from panelkit.sources import files as S

FRONT = ["ra", "ano_base", "pair_label", "fase", "turma", "target", "score", "prob", "dataset_split"]


def _doc_rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def run_training(panel: DataFrame, out_dir: str, schema: PanelSchema = DEFAULT, model_kind: str = "gbt",
                 keys_mode: str = "latest", model_params: dict | None = None, k_pct: float = 15.0) -> dict:
    """Train and evaluate on a yearly panel; returns the evaluation document (also written to ``out_dir``)."""
    spark = panel.sparkSession
    pairs = materialize(P.build_pairs(panel, schema))
    train, valid = P.temporal_split(pairs, panel, schema)
    cohort = P.cohort_summary(panel, pairs, schema)
    S.save_document(spark, {"cohort_summary": _doc_rows(cohort.orderBy("ano_base"))},
                    os.path.join(out_dir, "model", "cohort_summary"))

    tr, va, lookup = FE.build_features(train, valid, schema, keys_mode=keys_mode)
    tr, va = materialize(spread(tr, lookup.rows)), materialize(spread(va, valid.count()))
    S.save_lookup(lookup, os.path.join(out_dir, "model", "lookup"))
    num, cat = FE.feature_columns(tr, schema)
    params, info = dict(model_params or {}), {}
    if model_kind == "gbt":
        model, info = fit_boosted(tr, va, num, cat, schema.target, **params)  # stops on the AUC of the valid pair
    else:
        pipe = ML.rf_estimator(num, cat, **params) if model_kind == "random_forest" else ML.lr_estimator(num, cat, **params)
        model = ML.fit(pipe, tr, num, cat, schema.target)

    keep = [c for c in (schema.entity, schema.period, schema.pair_label, schema.stratum, schema.group, schema.target)
            if c in tr.columns]
    # training scores stay unrounded (as the reference's training path), served scores are rounded to 4 decimals
    s_tr = ML.score(model, tr, num, cat, schema.target, keep).withColumn("score", F.col("prob") * 100.0)
    s_va = ML.score(model, va, num, cat, schema.target, keep)
    s_tr = materialize(s_tr.withColumn("dataset_split", F.lit("train")))
    s_va = materialize(s_va.withColumn("dataset_split", F.lit("valid")))

    overall, per_k, per_stratum = M.evaluate(s_va.withColumn(schema.stratum, F.col(schema.stratum).cast("string")),
                                             schema)
    policy = M.operational_metrics(s_va.withColumn(schema.stratum, F.col(schema.stratum).cast("string")), k_pct,
                                   schema)
    doc = {
        "overall": _doc_rows(overall)[0],
        "global_topk": _doc_rows(per_k.orderBy("k_pct")),
        "per_stratum": _doc_rows(per_stratum.orderBy(schema.stratum)),
        "stratified_policy": _doc_rows(policy)[0],
    }
    S.save_document(spark, doc, os.path.join(out_dir, "evaluation", "evaluation_results"))
    ML.save_model(model, ML.model_metadata(model_kind, num, cat, params, {**doc["overall"], **info}),
                  os.path.join(out_dir, "model", "model"))

    ev = os.path.join(out_dir, "evaluation")
    S.export_csv(s_va, os.path.join(ev, "valid_scored.csv"), FRONT)
    S.export_csv(s_tr, os.path.join(ev, "train_scored.csv"), FRONT)
    S.export_csv(s_tr.unionByName(s_va), os.path.join(ev, "scored_history.csv"), FRONT)
    spark.createDataFrame([], "value string").write.mode("overwrite").text(
        os.path.join(out_dir, "monitoring", "drift_history"))
    return doc
