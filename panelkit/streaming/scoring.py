"""Micro-batch scoring flow (T1) and the one-off baseline seed.

Requests arrive as files in a folder; each micro-batch is scored by ``foreachBatch``: features with the frozen lookup
→ model probability → stratified top-K inside the batch → snapshot rows (every input row travels with its score as a
struct, so nothing is paired by position or by a generated id) → drift against the baseline, overall and per stratum →
one drift event. A batch's time is written before anything else and read again by a retry, and snapshot writes go to a
per-batch folder with overwrite, so a retried batch (same batch id after an executor or driver failure, even on another
day) replaces its own output instead of duplicating it.
"""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelkit.operators import drift as D
from panelkit.operators import features as FE
from panelkit.operators import ml as ML
from panelkit.operators.topk import topk_flags
from panelkit.schema import DEFAULT, PanelSchema
from panelkit.session import ensure_checkpoint_dir
from panelkit.sources.files import load_document, path_exists, save_document


def batch_time(spark: SparkSession, out_dir: str, batch_id: int, now: datetime | None = None) -> datetime:
    """The time at which the batch was first tried: stored on the first call, read by every later one."""
    path = os.path.join(out_dir, "batch_times", f"batch={batch_id}")
    if path_exists(spark, os.path.join(path, "_SUCCESS")):
        return datetime.fromisoformat(load_document(spark, path)["timestamp_utc"])
    ts = (now or datetime.now(timezone.utc)).astimezone(timezone.utc)
    save_document(spark, {"timestamp_utc": ts.isoformat()}, path)
    return ts


def score_batch(batch: DataFrame, batch_id: int, model, num: list[str], cat: list[str], lookup: FE.Lookup,
                baseline: DataFrame, out_dir: str, k_pct: float = 15.0, schema: PanelSchema = DEFAULT,
                now: datetime | None = None, baseline_id: str = "", model_version: str = "") -> None:
    """Score one micro-batch and persist its snapshot and drift event (idempotent per batch id)."""
    ts = batch_time(batch.sparkSession, out_dir, batch_id, now)
    request_id = f"batch_{batch_id:08d}"
    rows = batch.withColumn("_row", F.struct("*"))
    feats = FE.finalize(FE.apply_lookup(FE.base_columns(rows, schema), lookup, schema, extra=["_row"]), lookup, False,
                        schema)
    scored = ML.score(model, feats, num, cat, schema.target, keep=[schema.entity, schema.stratum, "_row"])
    # snapshot, alerts and drift read the scored batch (bounded by maxFilesPerTrigger)
    scored = scored.withColumn(schema.stratum, F.col(schema.stratum).cast("string")).persist()
    alerted = topk_flags(scored, k_pct, "score", schema.stratum, schema.entity, schema.alert)
    stamp = {"request_id": F.lit(request_id), "timestamp_utc": F.lit(ts.isoformat()), "k_pct": F.lit(float(k_pct))}
    snap = alerted.select("_row.*", "score", schema.alert).withColumns(
        {**stamp, "dt": F.lit(ts.strftime("%Y-%m-%d")), "source": F.lit("stream_predict")})
    snap.write.mode("overwrite").json(os.path.join(out_dir, "snapshots", f"dt={ts:%Y-%m-%d}", f"batch={batch_id}"))
    current = scored.select((F.col("score") / 100.0).alias("score"), schema.stratum)
    counts = alerted.agg(F.count(F.lit(1)).alias("n"), F.sum(schema.alert).alias("alerts")).first()
    per = [r.asDict() for r in D.stratum_drift(baseline, current, "score", schema.stratum).collect()]  # one row a stratum
    phases = F.lit(json.dumps(sorted(per, key=lambda r: str(r[schema.stratum])), ensure_ascii=False))
    drift = D.drift_summary(baseline, current, "score").withColumns({
        **stamp, "event_type": F.lit("predict_batch"), "n_students": F.lit(counts.n), "n_alerts": F.lit(counts.alerts or 0),
        "baseline_id": F.lit(baseline_id), "model_version": F.lit(model_version), "stratum_drift": phases})
    drift.write.mode("overwrite").json(os.path.join(out_dir, "drift_events", f"batch={batch_id}"))
    scored.unpersist()


def start_scoring(spark: SparkSession, request_dir: str, request_schema: str, model, num: list[str], cat: list[str],
                  lookup: FE.Lookup, baseline: DataFrame, out_dir: str, k_pct: float = 15.0, name: str = "scoring",
                  available_now: bool = True, max_files_per_trigger: int = 1000, baseline_id: str = "",
                  model_version: str = "") -> StreamingQuery:
    """File source → foreachBatch(score_batch); the stream checkpoint lives in the shared checkpoint folder and
    ``maxFilesPerTrigger`` bounds the size of one micro-batch."""
    stream = (spark.readStream.schema(request_schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .json(request_dir))
    ckpt = os.path.join(ensure_checkpoint_dir(spark), f"stream-{name}")

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        score_batch(batch, batch_id, model, num, cat, lookup, baseline, out_dir, k_pct, baseline_id=baseline_id,
                    model_version=model_version)

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", ckpt)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def seed_baseline_event(spark: SparkSession, history: DataFrame, baseline: DataFrame, baseline_id: str,
                        stratum: str = "fase", only_if_empty: bool = True) -> DataFrame:
    """The baseline's own snapshot as 'baseline_snapshot' events: the overall row (scope '__all__') and one row
    per stratum with at least 5 rows (A17, PSI 0).

    only_if_empty=True (the reference's rule): emitted only when the history holds no event at all.
    only_if_empty=False: emitted when the history holds no event for this baseline id (left anti join)."""
    overall = D.drift_summary(baseline, baseline, "score")
    summary = overall.unionByName(D.baseline_snapshot(baseline, "score", stratum).withColumnRenamed(stratum, "scope")).withColumns({
        "event_type": F.lit("baseline_snapshot"), "baseline_id": F.lit(baseline_id)})
    if only_if_empty:
        return summary if history.limit(1).count() == 0 else summary.limit(0)
    known = history.select("baseline_id").distinct() if "baseline_id" in history.columns else \
        spark.createDataFrame([], "baseline_id string")
    return summary.join(known, "baseline_id", "left_anti")
