"""Operational monitoring over logs and events.

Log lines have the layout ``TS | LEVEL | MODULE | MESSAGE | k=v ...``. Everything is column expressions plus one
aggregate; the p95 latency is an exact linear-interpolated percentile (``percentile``), or a mergeable sketch with
ranges of the latencies, never one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators.selection import quantiles

from panelkit.operators.report import low_sample

REQUEST_TAG = "event_type=predict_batch"
REQUEST_MESSAGE = "Predict batch complete"
ERROR_TAG = "event_type=error"


def parse_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """F32: split a log line into timestamp text, level, module, message and a key/value map; classify it."""
    v = F.col(col)
    parts = F.split(v, r" \| ")
    kv_text = F.element_at(parts, 5)
    kv = F.when(kv_text.isNotNull(), F.str_to_map(kv_text, F.lit(" "), F.lit("=")))
    has_type = v.contains("event_type")
    is_error = has_type & v.contains(ERROR_TAG)
    is_request = has_type & ~is_error & v.contains(REQUEST_TAG) & v.contains(REQUEST_MESSAGE)
    lat = F.regexp_extract(v, r"latency_ms=(\d+)", 1)
    return lines.select(
        "*",
        F.element_at(parts, 1).alias("ts_text"), F.element_at(parts, 2).alias("level"),
        F.element_at(parts, 3).alias("module"), F.element_at(parts, 4).alias("message"), kv.alias("kv"),
        is_error.alias("is_error"), is_request.alias("is_request"),
        F.when(is_request & (lat != ""), lat.cast("double")).alias("latency_ms"),
    )


def log_kpis(lines: DataFrame, col: str = "value", by: list[Column] | None = None,
             digits: int | None = 1) -> DataFrame:
    """Requests, errors and exact p95 latency (rounded half-to-even to ``digits``, 0 when there is no
    latency), overall or per ``by`` (e.g. a daily window). digits=None keeps the exact percentile."""
    p = parse_log(lines, col)
    keyed = p.select("*", *(by or []))
    keys = keyed.columns[len(p.columns):]
    counted = keyed.groupBy(*keys).agg(F.count_if("is_request").alias("n_requests"), F.count_if("is_error").alias("n_errors"))
    q = quantiles(keyed.select(*keys, "latency_ms"), ["latency_ms"], [0.95], by=keys)
    if keys:
        found = q.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("q")[0].alias("_p95"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        counted = counted.join(found, same, "left")
    else:
        row = q.first()  # one row
        counted = counted.withColumn("_p95", F.lit(row.q[0] if row else None))
    p95 = F.coalesce(F.col("_p95").cast("double"), F.lit(0.0))
    return counted.select(*keys, "n_requests", "n_errors",
                          (F.bround(p95, digits) if digits is not None else p95).alias("p95_latency_ms"))


def daily_kpis(lines: DataFrame, ts: str = "ts", col: str = "value", digits: int | None = 1) -> DataFrame:
    """T5: the KPIs per UTC day (tumbling 1-day event-time windows)."""
    out = log_kpis(lines, col, by=[F.window(ts, "1 day").alias("w")], digits=digits)
    return out.select(F.to_date(F.col("w.start")).alias("day"), "n_requests", "n_errors", "p95_latency_ms")


def drift_history(events: DataFrame, event_type: str, now: str | None = None, days: int | None = None,
                  limit: int = 100, ts: str = "ts") -> DataFrame:
    """Events of one type; with ``days`` only those at or after now − days (unparseable timestamps dropped);
    the ``limit`` most recent ones (a top-n, not a full sort)."""
    out = events.filter(F.col("event_type") == event_type).filter(F.col(ts).isNotNull())
    if days is not None and now is not None:
        out = out.filter(F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS"))
    return out.orderBy(F.col(ts).desc(), F.col("event_id").desc()).limit(limit)


def events_table(history: DataFrame, n_col: str = "n_students", ts: str = "ts") -> DataFrame:
    """The drift-events table: timestamp cut to the second (19 characters) and the low-sample note."""
    return history.select(F.substring(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), 1, 19).alias("timestamp"),
                          "*", low_sample(F.col(n_col)).alias("psi_note")).drop(ts)
