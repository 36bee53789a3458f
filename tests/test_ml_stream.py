"""Models, persistence and the micro-batch scoring stream on the smallest tables."""

import os
from datetime import datetime, timedelta, timezone
import tempfile
import uuid

from pyspark.sql import functions as F

from panelkit.operators import features as FE
from panelkit.operators import ml as ML
from panelkit.operators import pairs as P
from panelkit.plans import bindings as B
from panelkit.sources import files as S
from panelkit.streaming.scoring import score_batch, seed_baseline_event, start_scoring

SF = "/root/testdata/sf0.001"


def _features(spark):
    panel = B.cust_year(spark, SF)
    train, valid = P.temporal_split(P.build_pairs(panel), panel)
    tr, va, lookup = FE.build_features(train, valid, keys_mode="latest")
    num, cat = FE.feature_columns(tr)
    return train, valid, tr, va, lookup, num, cat


def test_model_roundtrip_and_scores(spark):
    _, _, tr, va, lookup, num, cat = _features(spark)
    model = ML.fit(ML.lr_estimator(num, cat), tr, num, cat)
    scored = ML.score(model, va, num, cat, keep=["ra", "fase", "target"])
    stats = scored.agg(F.min("score"), F.max("score"), F.count(F.lit(1))).first()
    assert 0 <= stats[0] <= stats[1] <= 100 and stats[2] == va.count()
    d = tempfile.mkdtemp(prefix="pk-model-")
    ML.save_model(model, ML.model_metadata("logistic", num, cat, {"reg": 0.01}, {}), d)
    m2, meta = ML.load_model(d)
    again = ML.score(m2, va, num, cat, keep=["ra"]).agg(F.sum("score")).first()[0]
    assert abs(again - scored.agg(F.sum("score")).first()[0]) < 1e-9 and meta["num_features"] == num
    S.save_lookup(lookup, os.path.join(d, "lookup"))
    lk2 = S.load_lookup(spark, os.path.join(d, "lookup"))
    assert lk2.all_null_cols == lookup.all_null_cols and lk2.tables["turma"].count() == lookup.tables["turma"].count()


def test_ordinal_codes_unknown_is_minus_one(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    test = spark.createDataFrame([("a",), ("z",)], "c string")
    out = {r.c: r.c__code for r in ML.ordinal_codes(test, ["c"], train).collect()}
    assert out["z"] == -1 and out["a"] >= 0


def test_scoring_stream_is_keyed_and_idempotent(spark):
    train, valid, tr, va, lookup, num, cat = _features(spark)
    model = ML.fit(ML.lr_estimator(num, cat), tr, num, cat)
    req_dir = tempfile.mkdtemp(prefix="pk-req-")
    out_dir = tempfile.mkdtemp(prefix="pk-out-")
    cols = ["ra", "ano_base", "fase", "turma", "matem", "portug", "ingles", "ieg", "iaa", "ips", "ipp", "genero",
            "instituicao", "ano_ingresso", "defasagem_t", "pair_label"]
    valid.select(*cols).write.mode("overwrite").json(req_dir)
    schema = valid.select(*cols).schema.simpleString().replace("struct<", "").rstrip(">").replace(":", " ")
    baseline = ML.score(model, tr, num, cat, keep=["fase"]).select((F.col("score") / 100.0).alias("score"), "fase")
    q = start_scoring(spark, req_dir, schema, model, num, cat, lookup, baseline, out_dir, 15.0,
                      name=f"score_{uuid.uuid4().hex[:8]}")
    q.awaitTermination()
    snaps = spark.read.json(os.path.join(out_dir, "snapshots"))
    assert snaps.count() == valid.count()
    assert snaps.select("ra").distinct().count() == valid.select("ra").distinct().count()
    ev = spark.read.json(os.path.join(out_dir, "drift_events"))
    assert ev.count() >= 1 and {"psi", "stratum_drift", "n_students", "n_alerts", "k_pct"} <= set(ev.columns)
    # the same batch again, after midnight: one copy of every row, under the day of the first try
    batch = spark.read.schema(schema).json(req_dir)
    before = sorted(r.dt.isoformat() if hasattr(r.dt, "isoformat") else str(r.dt) for r in snaps.select("dt").distinct().collect())
    later = datetime.now(timezone.utc) + timedelta(days=1)
    score_batch(batch, 0, model, num, cat, lookup, baseline, out_dir, 15.0, now=later)
    again = spark.read.json(os.path.join(out_dir, "snapshots"))
    assert again.count() == valid.count()
    assert [str(d) for d in before] == sorted(str(r.dt) for r in again.select("dt").distinct().collect())
    # every row carries its own score
    want = {r.ra: r.score for r in ML.score(model, FE.finalize(FE.apply_lookup(FE.base_columns(batch), lookup), lookup, False),
                                            num, cat, keep=["ra"]).collect()}
    assert {r.ra: r.score for r in again.collect()} == want


def test_seed_baseline_only_once(spark):
    base = spark.createDataFrame([(0.1 * (i % 10), f"F{i % 2}") for i in range(50)], "score double, fase string")
    empty = spark.createDataFrame([], "baseline_id string")
    assert sorted(r.scope for r in seed_baseline_event(spark, empty, base, "b1").collect()) == ["F0", "F1", "__all__"]
    hist = spark.createDataFrame([("b1",)], "baseline_id string")
    assert seed_baseline_event(spark, hist, base, "b1").count() == 0
    assert seed_baseline_event(spark, hist, base, "b2").count() == 0  # any history suppresses the seed
    assert seed_baseline_event(spark, hist, base, "b2", only_if_empty=False).count() == 3


def test_documents_roundtrip(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="pk-doc-"), "metrics")
    S.save_document(spark, {"auc": 0.75, "per_fase": {"1": {"n": 3}}}, d)
    assert S.load_document(spark, d)["per_fase"]["1"]["n"] == 3


def test_training_job_end_to_end(spark):
    from panelkit.plans.train_job import run_training

    out = tempfile.mkdtemp(prefix="pk-train-")
    doc = run_training(B.cust_year(spark, SF), out, model_kind="logistic")
    assert 0.0 <= doc["overall"]["auc"] <= 1.0
    assert [r["k_pct"] for r in doc["global_topk"]] == [10.0, 15.0, 20.0, 25.0]
    hist = spark.read.option("header", "true").csv(os.path.join(out, "evaluation", "scored_history.csv"))
    assert hist.columns[:3] == ["ra", "ano_base", "pair_label"]
    assert {r.dataset_split for r in hist.select("dataset_split").distinct().collect()} == {"train", "valid"}
    assert S.load_document(spark, os.path.join(out, "model", "cohort_summary"))["cohort_summary"]
    m, meta = ML.load_model(os.path.join(out, "model", "model"))
    assert meta["model_kind"] == "logistic"


def test_tree_attributions_are_additive(spark):
    from pyspark.ml.functions import vector_to_array

    _, _, tr, va, _, num, cat = _features(spark)
    model = ML.fit(ML.gbt_estimator(num, cat, max_iter=8, depth=3), tr, num, cat)
    attr = ML.tree_attributions(model, va, num, cat, "ra")
    raw = model.transform(ML.prepare(va, num, cat)).select(
        F.col("ra").cast("string").alias("ra"), vector_to_array("rawPrediction")[1].alias("raw"))
    j = attr.join(raw, "ra").select("margin", "raw", "bias", F.aggregate("contributions", F.lit(0.0),
                                                                          lambda a, b: a + b).alias("s")).collect()
    assert len(j) == va.count()
    for r in j:
        assert abs(r.margin - r.raw) < 1e-9 and abs(r.bias + r.s - r.margin) < 1e-9
