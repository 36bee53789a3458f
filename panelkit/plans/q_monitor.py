"""Registered queries: log KPIs, log tail, tolerant JSON lines, trailing-window drift, drift history
(F30, F32, A23, S5, S6, S11, T2, T3, T5, W9, R7, F39)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.operators import drift as D
from panelkit.operators import monitor as MO
from panelkit.plans import bindings as B
from panelkit.plans.common import DIGITS, round_doubles
from panelkit.plans.registry import query
from panelkit.session import scratch_path
from panelkit.sources.files import parse_json_objects, tail_lines, tolerant_timestamp
from panelkit.sources.tail import tail_by_position

R = DIGITS
NOW = B.MON_NOW

LOG_CLASS_SQL = """,
cls AS (
  SELECT *, value LIKE '%event_type%' AND value LIKE '%event_type=error%' AS is_error,
         value LIKE '%event_type%' AND NOT (value LIKE '%event_type=error%') AND value LIKE '%event_type=predict_batch%'
           AND value LIKE '%Predict batch complete%' AS is_request,
         nullif(regexp_extract(value, 'latency_ms=(\\d+)', 1), '') AS lat
  FROM log_lines
)"""


@query("log_kpis", B.with_ctes(B.B5_SQL + LOG_CLASS_SQL) + """
SELECT CAST(count(*) FILTER (WHERE is_request) AS BIGINT) AS n_requests,
       CAST(count(*) FILTER (WHERE is_error) AS BIGINT) AS n_errors,
       round(coalesce(quantile_cont(CAST(lat AS DOUBLE), 0.95) FILTER (WHERE is_request), 0.0), 9) AS p95_latency_ms
FROM cls""", ids=("F32", "A23"))
def log_kpis(spark, sf_dir):
    # exact p95 (the 1-decimal display rounding is left to the caller: engines round halves differently)
    return round_doubles(MO.log_kpis(B.log_lines(spark, sf_dir), digits=None))


@query("daily_log_kpis", B.with_ctes(B.B5_SQL + LOG_CLASS_SQL) + """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(count(*) FILTER (WHERE is_request) AS BIGINT) AS n_requests,
       CAST(count(*) FILTER (WHERE is_error) AS BIGINT) AS n_errors,
       round(coalesce(quantile_cont(CAST(lat AS DOUBLE), 0.95) FILTER (WHERE is_request), 0.0), 9) AS p95_latency_ms
FROM cls GROUP BY CAST(ts AS DATE)""", ids=("T5", "A23"))
def daily_log_kpis(spark, sf_dir):
    out = MO.daily_kpis(B.log_lines(spark, sf_dir), digits=None).withColumn("day", F.col("day").cast("string"))
    return round_doubles(out)


@query("log_tail", B.with_ctes(B.B5_SQL) + """
SELECT event_id, value FROM log_lines ORDER BY ts DESC, event_id DESC LIMIT 80""", ids=("S11", "W9"))
def log_tail(spark, sf_dir):
    return tail_lines(B.log_lines(spark, sf_dir), 80, ["ts", "event_id"]).select("event_id", "value")


@query("log_tail_by_position", B.with_ctes(B.B5_SQL) + """
SELECT CAST(row_number() OVER (ORDER BY event_id DESC) AS INTEGER) AS position, value AS line FROM log_lines
ORDER BY event_id DESC LIMIT 250""", ids=("S11", "W9"))
def log_tail_by_position(spark, sf_dir):
    """The log as rotated files in writing order; its last 250 lines are found by file and offset, with no order column."""
    path = scratch_path(spark, f"log-{uuid.uuid4().hex[:10]}")
    lines = B.log_lines(spark, sf_dir).select("event_id", "value")
    lines.repartitionByRange(6, "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return tail_by_position(spark, path, 250, split_bytes=1 << 14).select("position", "line")


LINES_SQL = """,
lines AS (
  SELECT CASE event_id % 10 WHEN 0 THEN '' WHEN 1 THEN 'not json {' WHEN 2 THEN '[1, 2]' WHEN 3 THEN '"text"'
         ELSE '{"event_id": ' || CAST(event_id AS VARCHAR) || ', "event_type": "' || event_type || '", "props": '
              || props || ', "ts": "' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z"}' END AS value
  FROM mon_events
)"""


def _json_lines(spark, sf_dir):
    ev = B.mon_events(spark, sf_dir)
    obj = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "event_type": "'),
                   F.col("event_type"), F.lit('", "props": '), F.col("props"), F.lit(', "ts": "'),
                   F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z"}'))
    k = F.col("event_id") % 10
    line = (F.when(k == 0, F.lit("")).when(k == 1, F.lit("not json {")).when(k == 2, F.lit("[1, 2]"))
            .when(k == 3, F.lit('"text"')).otherwise(obj))
    return ev.select(line.alias("value"))


JSONL_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("props", T.StructType([T.StructField("k", T.LongType())])), T.StructField("ts", T.StringType())])


@query("json_lines_parse", B.with_ctes(B.B5_SQL + LINES_SQL) + """
SELECT CAST(json_extract(value, '$.event_id') AS BIGINT) AS event_id, json_extract_string(value, '$.event_type') AS event_type,
       CAST(json_extract(value, '$.props.k') AS BIGINT) AS k,
       strftime(CAST(CAST(json_extract_string(value, '$.ts') AS TIMESTAMPTZ) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ts
FROM lines WHERE json_valid(value) AND json_type(value) = 'OBJECT'""", ids=("S5", "F30"))
def json_lines_parse(spark, sf_dir):
    parsed = parse_json_objects(_json_lines(spark, sf_dir), JSONL_SCHEMA)
    return parsed.select("event_id", "event_type", F.col("props.k").alias("k"),
                         F.date_format(tolerant_timestamp(F.col("ts")), "yyyy-MM-dd HH:mm:ss").alias("ts"))


# T2 batch form: baseline = the first 7 days, current = the trailing 7 days ending at NOW; score = latency / 500
WINDOW_SQL = B.B5_SQL + f""",
w AS (
  SELECT CASE WHEN dt < DATE '2024-01-08' THEN 'b' WHEN dt >= DATE '{NOW}' - INTERVAL 6 DAY AND dt <= DATE '{NOW}'
              THEN 'c' END AS side, event_type, value / 500.0 AS x FROM mon_events
)"""


def _window_sides(spark, sf_dir):
    ev = B.mon_events(spark, sf_dir).withColumn("score", F.col("value") / 500.0)
    cut = F.date_sub(F.lit(NOW).cast("date"), 6)
    base = ev.filter(F.col("dt") < F.lit("2024-01-08").cast("date"))
    cur = ev.filter((F.col("dt") >= cut) & (F.col("dt") <= F.lit(NOW).cast("date")))
    return base, cur


def _sql_bin(x: str) -> str:
    E = D.EDGES
    parts = [f"WHEN {x} >= {E[i]!r} AND {x} {'<=' if i == 9 else '<'} {E[i + 1]!r} THEN {i}" for i in range(10)]
    return f"CASE {' '.join(parts)} END"


@query("trailing_window_drift", B.with_ctes(WINDOW_SQL) + f""",
tot AS (SELECT side, event_type, count(*) AS n, avg(x) AS m, stddev_pop(x) AS sd FROM w WHERE side IS NOT NULL
        GROUP BY side, event_type),
h AS (SELECT side, event_type, {_sql_bin('x')} AS bin, count(*) AS c FROM w WHERE side IS NOT NULL GROUP BY ALL),
bins AS (SELECT unnest(range(10)) AS bin),
st AS (SELECT event_type FROM tot WHERE side = 'b' AND n >= 5 INTERSECT SELECT event_type FROM tot WHERE side = 'c' AND n >= 5),
p AS (
  SELECT s.event_type, sum((greatest(coalesce(hc.c, 0) / tc.n, 1e-6) - greatest(coalesce(hb.c, 0) / tb.n, 1e-6))
         * ln(greatest(coalesce(hc.c, 0) / tc.n, 1e-6) / greatest(coalesce(hb.c, 0) / tb.n, 1e-6))) AS psi
  FROM st s CROSS JOIN bins
  JOIN tot tb ON tb.event_type = s.event_type AND tb.side = 'b' JOIN tot tc ON tc.event_type = s.event_type AND tc.side = 'c'
  LEFT JOIN h hb ON hb.event_type = s.event_type AND hb.bin = bins.bin AND hb.side = 'b'
  LEFT JOIN h hc ON hc.event_type = s.event_type AND hc.bin = bins.bin AND hc.side = 'c'
  GROUP BY s.event_type)
SELECT p.event_type, round_even(p.psi, 4) AS psi,
       CASE WHEN p.psi < 0.1 THEN 'ok' WHEN p.psi < 0.2 THEN 'warning' ELSE 'critical' END AS severity,
       CAST(tb.n AS BIGINT) AS n_baseline, CAST(tc.n AS BIGINT) AS n_current
FROM p JOIN tot tb ON tb.event_type = p.event_type AND tb.side = 'b'
JOIN tot tc ON tc.event_type = p.event_type AND tc.side = 'c'""", ids=("T2", "A16"))
def trailing_window_drift(spark, sf_dir):
    base, cur = _window_sides(spark, sf_dir)
    out = D.stratum_drift(base, cur, "score", "event_type")
    return out.select("event_type", "psi", "severity", "n_baseline", "n_current")


@query("drift_history", B.with_ctes(B.B5_SQL) + f"""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM mon_events
WHERE event_type = 'predict_batch' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY
ORDER BY mon_events.ts DESC, event_id DESC LIMIT 50""", ids=("T3", "W9"))
def drift_history(spark, sf_dir):
    h = MO.drift_history(B.mon_events(spark, sf_dir), "predict_batch", NOW, 7, 50)
    return h.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("drift_events_table", B.with_ctes(B.B5_SQL) + """
SELECT strftime(CAST(dt AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS timestamp, CAST(count(*) AS BIGINT) AS n_students,
       CASE WHEN count(*) < 100 THEN 'low_sample' END AS psi_note
FROM mon_events WHERE event_type = 'predict_batch' GROUP BY dt ORDER BY dt DESC LIMIT 30""", ids=("R7", "F39"))
def drift_events_table(spark, sf_dir):
    daily = (B.mon_events(spark, sf_dir).filter(F.col("event_type") == "predict_batch")
             .groupBy("dt").agg(F.count(F.lit(1)).alias("n_students"))
             .select(F.col("dt").cast("timestamp_ntz").alias("ts"), "n_students")
             .orderBy(F.col("ts").desc()).limit(30))
    return MO.events_table(daily)


@query("score_summary_by_window", B.with_ctes(WINDOW_SQL) + f"""
SELECT side, round(coalesce(avg(x), 0.0), {R}) AS score_mean, round(coalesce(quantile_cont(x, 0.9), 0.0), {R}) AS score_p90,
       round(coalesce(quantile_cont(x, 0.99), 0.0), {R}) AS score_p99 FROM w WHERE side IS NOT NULL GROUP BY side""",
       ids=("A22", "T2"))
def score_summary_by_window(spark, sf_dir):
    from panelkit.operators.metrics import score_summary

    base, cur = _window_sides(spark, sf_dir)
    b = score_summary(base).withColumn("side", F.lit("b"))
    c = score_summary(cur).withColumn("side", F.lit("c"))
    return round_doubles(b.unionByName(c))
