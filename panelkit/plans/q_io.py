"""Registered queries over files the job itself writes: CSV / parquet round trips with key columns first and a
fallback path (S3, S4, S9, P10), period folders (S1), day-partitioned snapshots (S6, S7), the event log (S8), saved
statistics (S10), the baseline registry (S12, S13), schema parity (P14, U5) and the ordered alert list (W7). Scratch
output goes under the shared checkpoint folder, one fresh sub-folder per run."""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.operators import topk as K
from panelkit.plans import bindings as B
from panelkit.plans.common import round_doubles
from panelkit.plans.q_features import GROUP_STATS_SQL
from panelkit.plans.registry import query
from panelkit.session import scratch_path
from panelkit.sources.commits import CommittedTable, swap_document
from panelkit.sources.files import (
    append_event, baseline_manifests, export_csv, file_hashes, load_baseline, load_lookup, load_periods, path_exists,
    read_jsonl, read_small_text, read_snapshots, save_document, save_lookup, write_snapshots)

# file column order: the key columns written first (P10), then the rest
SCORED_SCHEMA = "ra bigint, ano_base int, fase string, turma string, score double, target int"


def _scratch(spark, tag):
    return scratch_path(spark, f"{tag}-{uuid.uuid4().hex[:10]}")


@query("csv_roundtrip_scored", B.with_ctes(B.B3_SQL) + " SELECT ra, fase, turma, ano_base, score, target FROM scored",
       ids=("S3", "S9", "P10"))
def csv_roundtrip_scored(spark, sf_dir):
    """Export the scored table as CSV (keys first), then read it back the way the dashboard does: the preferred
    history file when it exists, else the fallback, with an explicit schema (no inference)."""
    base = _scratch(spark, "csv")
    export_csv(B.scored(spark, sf_dir), os.path.join(base, "valid_scored.csv"), front=["ra", "ano_base", "fase"])
    preferred, fallback = os.path.join(base, "scored_history.csv"), os.path.join(base, "valid_scored.csv")
    path = preferred if path_exists(spark, preferred) else fallback
    # enforceSchema=false: the header must name the schema's columns in order, so a reordered export fails loudly
    df = spark.read.schema(SCORED_SCHEMA).option("header", "true").option("enforceSchema", "false").csv(path)
    return df.select("ra", "fase", "turma", "ano_base", F.col("score").cast("double").alias("score"), "target")


@query("parquet_roundtrip_pairs", B.with_ctes(B.B2_SQL) + """
SELECT ra, ano_base, pair_label, defasagem_t, defasagem_t1, target FROM pairs""", ids=("S4",))
def parquet_roundtrip_pairs(spark, sf_dir):
    from panelkit.operators.pairs import build_pairs

    path = _scratch(spark, "pq")
    build_pairs(B.cust_year(spark, sf_dir)).select("ra", "ano_base", "pair_label", "defasagem_t", "defasagem_t1",
                                                   "target").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("alert_list", B.with_ctes(B.B3_SQL) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY fase ORDER BY score DESC NULLS LAST, ra) AS rn,
        greatest(1, CAST(ceil(CAST(count(*) OVER (PARTITION BY fase) AS DOUBLE) * 15.0 / 100.0) AS BIGINT)) AS k
      FROM scored)
SELECT ra, fase, turma, score FROM r WHERE rn <= k""", ids=("W7", "P19"))
def alert_list(spark, sf_dir):
    """The alerted rows, ordered by stratum ascending and score descending (entity breaks ties)."""
    out = K.alert_list(B.scored(spark, sf_dir), 15.0)
    return out.filter(F.col("alerta") == 1).select("ra", "fase", "turma", "score")


PANEL_COLS = ["ra", "fase", "turma", "ieg", "ano_base"]


@query("period_folders", B.with_ctes(B.B1_SQL) + " SELECT ra, fase, turma, ieg, ano_base FROM cust_year", ids=("S1", "S2"))
def period_folders(spark, sf_dir):
    """One folder a period, found by its name whatever the case; folders of other names are not read."""
    root = _scratch(spark, "periods")
    panel = B.cust_year(spark, sf_dir).select(*PANEL_COLS)
    years = sorted(r[0] for r in panel.select("ano_base").distinct().collect())  # some years
    for i, year in enumerate(years):
        part = panel.where(F.col("ano_base") == year).drop("ano_base")
        part.write.parquet(os.path.join(root, f"{'PEDE' if i % 2 else 'pede'}{year}"))
    panel.limit(5).write.parquet(os.path.join(root, "PEDE_backup"))
    return load_periods(spark, root).select(*PANEL_COLS)


@query("snapshot_trailing_scan", B.with_ctes(B.B3_SQL) + """,
d AS (SELECT ra, score, CAST(DATE '2024-01-30' - CAST((ra % 20) * 2 AS INTEGER) AS DATE) AS dt FROM scored)
SELECT CAST(dt AS VARCHAR) AS dt, CAST(count(*) AS BIGINT) AS n, round(sum(score), 4) AS score_sum FROM d
WHERE dt >= DATE '2024-01-30' - 14 GROUP BY dt""", ids=("S6", "S7"))
def snapshot_trailing_scan(spark, sf_dir):
    """Scored rows appended day by day, then the last 15 days read back; badly named partitions hold rows too."""
    base = _scratch(spark, "snapshots")
    scored = B.scored(spark, sf_dir).select("ra", "score")
    last = datetime(2024, 1, 30, 12, tzinfo=timezone.utc)
    for k in range(20):
        write_snapshots(scored.where(F.col("ra") % 20 == k), base, f"req-{k}", {"k_pct": 15.0}, now=last - timedelta(days=2 * k))
    for name in ("dt=not-a-date", "dt=2024-13-45"):
        scored.limit(3).write.json(os.path.join(base, name))
    schema = T.StructType([T.StructField("ra", T.LongType()), T.StructField("score", T.StringType())])
    out = read_snapshots(spark, base, schema, "2024-01-30", 15)
    return out.groupBy(F.col("dt").cast("string").alias("dt")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("score_sum"))


@query("committed_appends", B.with_ctes(B.B3_SQL) + """,
d AS (SELECT ra, score, CAST(ra % 6 AS INTEGER) AS k FROM scored)
SELECT 'req-' || k AS request_id, CAST(DATE '2024-01-30' - k AS VARCHAR) AS dt, CAST(count(*) AS BIGINT) AS n,
       round(sum(score), 4) AS score_sum, CAST(1 AS BIGINT) AS n_events, 'req-5' AS pointer FROM d GROUP BY k""", ids=("S7", "S8", "S12"))
def committed_appends(spark, sf_dir):
    """Six requests of scored rows. One fails after its rows are staged and is tried again; two are sent twice. Every
    row and every event counts once, and the pointer names the last published request."""
    base = _scratch(spark, "committed")
    table, pointer = CommittedTable(spark, os.path.join(base, "rows")), os.path.join(base, "current.json")
    scored = B.scored(spark, sf_dir).select("ra", "score")
    last = datetime(2024, 1, 30, 12, tzinfo=timezone.utc)
    for k in range(6):
        rows, name, now = scored.where(F.col("ra") % 6 == k), f"req-{k}", last - timedelta(days=k)
        if k == 2:
            table.stage(rows, name, now=now)  # lost before it was published
        for _ in range(2 if k in (1, 2) else 1):
            if table.append(rows, name, event={"event_type": "predict_batch"}, now=now):
                swap_document(spark, {"request_id": name}, pointer)
    schema = T.StructType([T.StructField("ra", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("request_id", T.StringType())])
    seen = table.read(schema).groupBy("request_id", F.col("dt").cast("string").alias("dt")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("score_sum"))
    events = table.commits().groupBy("request_id").agg(F.count(F.lit(1)).alias("n_events"))
    return seen.join(events, "request_id").withColumn("pointer", F.lit(json.loads(read_small_text(spark, pointer))["request_id"]))


@query("event_log_append", """
SELECT event_type, CAST(count(*) AS BIGINT) AS n_students FROM events GROUP BY event_type""", ids=("S8", "S5"))
def event_log_append(spark, sf_dir):
    """One log entry for each kind of event with its number of rows, appended one by one and read back."""
    path = _scratch(spark, "history")
    counts = B.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).collect()
    for r in counts:  # some kinds
        append_event(spark, path, r.event_type, {"n_students": r.n})
    return read_jsonl(spark, path, T.StructType([T.StructField("event_type", T.StringType()), T.StructField("n_students", T.LongType())]))


@query("baseline_registry", B.with_ctes(B.B3_SQL) + """
SELECT 'b1' AS baseline_id, (SELECT CAST(count(*) AS BIGINT) FROM scored) AS n_manifest, fase, CAST(count(*) AS BIGINT) AS n,
       round(avg(score), 6) AS score_mean FROM scored GROUP BY fase""", ids=("S12", "S13"))
def baseline_registry(spark, sf_dir):
    """A baseline of several part files, accepted by the hash of each; a second one, which the pointer names first and
    whose hashes are wrong, is rejected."""
    root = _scratch(spark, "baselines")
    csv = os.path.join(root, "registry", "b1", "baseline.csv")
    scored = B.scored(spark, sf_dir).select("ra", "fase", "score")
    scored.write.option("header", "true").csv(csv)
    manifest = {"n_rows": scored.count(), "created_at": "2024-01-01T00:00:00.000001", "baseline_part_sha256": file_hashes(spark, csv)}
    save_document(spark, manifest, os.path.join(root, "registry", "b1", "baseline_manifest.json"))
    pointer = os.path.join(root, "current.json")
    wrong = os.path.join(root, "registry", "b2")
    scored.where(F.col("ra") % 2 == 0).write.option("header", "true").csv(os.path.join(wrong, "baseline.csv"))
    save_document(spark, manifest | {"n_rows": None}, os.path.join(wrong, "baseline_manifest.json"))
    save_document(spark, {"baseline_id": "b2"}, pointer)
    if load_baseline(spark, os.path.join(root, "registry"), pointer) != (None, None):
        raise ValueError("a baseline whose hashes differ from its manifest was accepted")
    save_document(spark, {"baseline_id": "b1"}, pointer)
    found, frame = load_baseline(spark, os.path.join(root, "registry"), os.path.join(root, "current.json"))
    listed = baseline_manifests(spark, os.path.join(root, "registry")).where(F.col("n_rows").isNotNull())
    per = frame.groupBy("fase").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("score").cast("double")), 6).alias("score_mean"))
    n = listed.agg(F.max("n_rows")).first()[0]
    return per.select(F.lit(found).alias("baseline_id"), F.lit(n).cast("long").alias("n_manifest"), "fase", "n", "score_mean")


@query("saved_statistics", GROUP_STATS_SQL, ids=("S10",))
def saved_statistics(spark, sf_dir):
    """Group statistics fitted, saved, loaded: the rows of the group level (SQL of ``group_stats_by_group``)."""
    from panelkit.operators import features as FE
    from panelkit.operators import pairs as P

    panel = B.cust_year(spark, sf_dir)
    train, _ = P.temporal_split(P.build_pairs(panel), panel)
    path = _scratch(spark, "lookup")
    save_lookup(FE.fit_lookup(FE.base_columns(train)), path)
    return round_doubles(load_lookup(spark, path).tables["turma"])


@query("feature_schema_parity", 'SELECT CAST(NULL AS VARCHAR) AS "column", CAST(NULL AS VARCHAR) AS side WHERE 1 = 0',
       ids=("P14", "U5"))
def feature_schema_parity(spark, sf_dir):
    """Columns that only the training or only the valid features have (none), after both passed the leakage policy."""
    from panelkit.operators import features as FE
    from panelkit.operators import pairs as P
    from panelkit.operators.quality import schema_difference

    panel = B.cust_year(spark, sf_dir)
    train, valid = P.temporal_split(P.build_pairs(panel), panel)
    tr, va, _ = FE.build_features(train, valid)
    FE.check_leakage(tr, va)
    return schema_difference(tr, va)
