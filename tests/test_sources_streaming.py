"""Sources, sinks and streaming flows on scratch folders."""

import json
import os
import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.operators import monitor as MO
from panelkit.sources import files as S
from panelkit.streaming.monitoring import start_daily_histograms, trailing_psi

SCHEMA = T.StructType([T.StructField("event_type", T.StringType()), T.StructField("psi", T.DoubleType())])


def test_jsonl_tolerant(spark):
    d = tempfile.mkdtemp(prefix="pk-jsonl-")
    p = os.path.join(d, "events.jsonl")
    with open(p, "w") as f:
        f.write('{"event_type": "a", "psi": 0.1}\n\n not json\n[1, 2]\n"x"\n{"event_type": "b", "psi": 0.3}\n')
    out = S.read_jsonl(spark, p, SCHEMA).orderBy("event_type").collect()
    assert [(r.event_type, r.psi) for r in out] == [("a", 0.1), ("b", 0.3)]
    assert S.read_jsonl(spark, os.path.join(d, "missing.jsonl"), SCHEMA).count() == 0


def test_snapshots_partition_pruning(spark):
    base = os.path.join(tempfile.mkdtemp(prefix="pk-snap-"), "snapshots")
    df = spark.createDataFrame([("RA-1", 50.0), ("RA-2", 70.0)], "ra string, score double")
    for day in ("2024-01-01", "2024-01-20", "2024-01-30"):
        S.write_snapshots(df, base, f"req-{day}", {"k_pct": 15.0},
                          now=datetime.fromisoformat(day + "T12:00:00+00:00"))
    for bad in ("dt=not-a-date", "dt=2024-13-45", "other"):
        os.makedirs(os.path.join(base, bad))
        with open(os.path.join(base, bad, "part-0.json"), "w") as f:
            f.write('{"ra": "RA-9", "score": "1.0", "timestamp_utc": "2024-01-30T00:00:00Z"}\n')
    schema = T.StructType([T.StructField("ra", T.StringType()), T.StructField("score", T.StringType()),
                           T.StructField("timestamp_utc", T.StringType())])
    out = S.read_snapshots(spark, base, schema, "2024-01-30", 15)
    assert sorted(str(r.dt) for r in out.select("dt").distinct().collect()) == ["2024-01-20", "2024-01-30"]
    assert out.filter(F.col("timestamp_utc").isNull()).count() == 0
    assert all("2024-01-01" not in f for f in out.inputFiles())  # older days are not even opened
    assert S.read_snapshots(spark, base, schema, "2020-01-30", 1).count() == 6  # later days count as recent
    assert S.read_snapshots(spark, base + "/missing", schema, "2024-01-30", 15).count() == 0


def test_event_append_and_manifest(spark):
    d = tempfile.mkdtemp(prefix="pk-ev-")
    S.append_event(spark, os.path.join(d, "history"), "predict_batch", {"psi": 0.2, "n_students": 5})
    S.append_event(spark, os.path.join(d, "history"), "oot_snapshot", {"psi": 0.05, "n_students": 500})
    ev = S.read_jsonl(spark, os.path.join(d, "history"), T.StructType([
        T.StructField("event_type", T.StringType()), T.StructField("n_students", T.LongType())]))
    assert ev.count() == 2
    bdir = os.path.join(d, "baselines", "b1")
    os.makedirs(bdir)
    csv = os.path.join(bdir, "baseline.csv")
    with open(csv, "w") as f:
        f.write("ra,fase,score\nRA-1,1,50.0\n")
    import hashlib

    digest = hashlib.sha256(open(csv, "rb").read()).hexdigest()
    with open(os.path.join(bdir, "baseline_manifest.json"), "w") as f:
        json.dump({"n_rows": 1, "created_at": "2024-01-01T00:00:00.123456", "baseline_file_sha256": digest}, f)
    with open(os.path.join(d, "current.json"), "w") as f:
        json.dump({"baseline_id": "b1"}, f)
    bid, frame = S.load_baseline(spark, os.path.join(d, "baselines"), os.path.join(d, "current.json"))
    assert bid == "b1" and frame.count() == 1
    with open(os.path.join(bdir, "baseline_manifest.json"), "w") as f:
        json.dump({"n_rows": 1, "created_at": "x", "baseline_file_sha256": "0" * 64}, f)
    bid2, _ = S.load_baseline(spark, os.path.join(d, "baselines"), os.path.join(d, "current.json"))
    assert bid2 is None
    parts = os.path.join(d, "baselines", "b2")
    spark.createDataFrame([("RA-1", 50.0), ("RA-2", 60.0)], "ra string, score double").repartition(2).write.option(
        "header", "true").csv(os.path.join(parts, "baseline.csv"))
    hashes = S.file_hashes(spark, os.path.join(parts, "baseline.csv"))
    assert len(hashes) == 2
    for good in (True, False):
        with open(os.path.join(parts, "baseline_manifest.json"), "w") as f:
            json.dump({"n_rows": 2, "created_at": "y", "baseline_part_sha256": hashes if good else {**hashes, "x": "0"}}, f)
        with open(os.path.join(d, "pointer2.json"), "w") as f:
            json.dump({"baseline_id": "b2"}, f)
        found, frame = S.load_baseline(spark, os.path.join(d, "baselines"), os.path.join(d, "pointer2.json"))
        assert (found, frame.count() if frame else None) == (("b2", 2) if good else (None, None))
    os.remove(os.path.join(parts, "baseline_manifest.json"))
    assert S.baseline_manifests(spark, os.path.join(d, "none")).count() == 0
    m = S.baseline_manifests(spark, os.path.join(d, "baselines")).collect()
    assert m[0].baseline_id == "b1"


def test_log_kpis(spark):
    lines = spark.createDataFrame([
        ("2024-01-01 00:00:00 | INFO | api | Predict batch complete | event_type=predict_batch latency_ms=10",),
        ("2024-01-01 00:00:01 | INFO | api | Predict batch complete | event_type=predict_batch latency_ms=20",),
        ("2024-01-01 00:00:02 | ERROR | api | boom | event_type=error",),
        ("no event here",)], "value string")
    r = MO.log_kpis(lines).first()
    assert (r.n_requests, r.n_errors, r.p95_latency_ms) == (2, 1, 19.5)


def test_streaming_daily_histograms_and_trailing_psi(spark):
    src = tempfile.mkdtemp(prefix="pk-stream-src-")
    rows = [(i, datetime(2024, 1, 1 + i % 10, 12, tzinfo=timezone.utc).replace(tzinfo=None), "view" if i % 2 else "error",
             float(i % 97)) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double")
    df.write.mode("overwrite").parquet(os.path.join(src, "batch1"))
    name = f"pk_test_hist_{uuid.uuid4().hex[:8]}"  # stream checkpoints persist in the shared folder: fresh name
    q = start_daily_histograms(spark, os.path.join(src, "batch1"),
                               "event_id long, ts timestamp_ntz, event_type string, value double", "ts",
                               F.col("value") / 100.0, "event_type", name)
    q.awaitTermination()
    daily = spark.table(name)
    assert daily.agg(F.sum("n")).first()[0] == 400
    base = daily.groupBy("stratum", "bin").agg(F.sum("n").alias("n"))
    psi = trailing_psi(daily, base, "2024-01-10", 10).collect()
    assert all(abs(r.psi) < 1e-9 for r in psi)


def test_streaming_histogram_table_upserts_across_batches(spark):
    from panelkit.streaming.monitoring import start_daily_histogram_table

    src = tempfile.mkdtemp(prefix="pk-stream2-")
    schema = "event_id long, ts timestamp_ntz, event_type string, value double"
    for part in range(3):
        rows = [(part * 1000 + i, datetime(2024, 1, 1 + (i % 3), 8 + part), "view" if i % 2 else "error",
                 float(i % 50)) for i in range(90)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(os.path.join(src, f"p{part}"))
    table = os.path.join(tempfile.mkdtemp(prefix="pk-hist-"), "daily")
    name = f"pk_hist_table_{uuid.uuid4().hex[:8]}"
    q = start_daily_histogram_table(spark, src + "/*", schema, "ts", F.col("value") / 100.0, "event_type", table, name,
                                    max_files_per_trigger=1)
    q.awaitTermination()
    out = spark.read.parquet(table)
    assert out.agg(F.sum("n")).first()[0] == 270
    assert out.groupBy("day", "stratum", "bin").count().filter(F.col("count") > 1).count() == 0


def test_period_folders_discovered_and_conformed(spark):
    import pytest

    from panelkit.operators.conform import conform_sheet

    root = tempfile.mkdtemp(prefix="pk-periods-")
    sheets = {"PEDE2022": [("  RA-1 ", "FASE 1", "7.5", " feminino ")],
              "pede2023": [("RA-1", "2", "n/a", "M")],
              "PEDE2024": [("RA-2", "ALFA", "8", None)]}
    for name, rows in sheets.items():
        spark.createDataFrame(rows, "RA string, Fase string, Matem string, `Gênero` string").write.parquet(
            os.path.join(root, name))
    os.makedirs(os.path.join(root, "notes"))
    found = S.discover_periods(spark, root)
    assert [y for y, _ in found] == [2022, 2023, 2024]
    panel = S.load_periods(spark, root, conform=lambda df, y: conform_sheet(df.drop("ano_base"), y))
    got = sorted((r.ra, r.ano_base, r.fase, r.matem, r.genero) for r in panel.collect())
    assert got == [("RA-1", 2022, 1, 7.5, "F"), ("RA-1", 2023, 2, None, "M"), ("RA-2", 2024, 0, 8.0, "NA")]
    few = tempfile.mkdtemp(prefix="pk-periods2-")
    os.makedirs(os.path.join(few, "PEDE2022"))
    with pytest.raises(ValueError):
        S.discover_periods(spark, few)
