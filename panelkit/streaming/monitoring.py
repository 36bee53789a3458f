"""Streaming drift state (T2, T5): daily per-(stratum, bin) score counts kept by Structured Streaming.

Daily histogram counts are additive, so the streaming state is tiny (days × strata × 11 bins) regardless of the event
volume; a trailing N-day PSI is a batch sum over the last N days of that table against the frozen baseline
histogram. Late events inside the watermark update their day's counts; later ones are dropped by the watermark.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelkit.operators.drift import BINS, EPS_CLIP, bin_index
from panelkit.session import ensure_checkpoint_dir


def daily_histogram_stream(events: DataFrame, ts: str, score: Column, stratum: str, watermark: str = "2 days"
                           ) -> DataFrame:
    """Streaming plan: event-time watermark → 1-day tumbling windows → counts per (day, stratum, bin) plus the
    number of scored rows per (day, stratum)."""
    x = score.cast("double")
    # watermarks need an instant type; wall-clock timestamps are read as UTC instants (session time zone UTC)
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return (events.withWatermark(ts, watermark)
            .select(F.col(ts), F.col(stratum).cast("string").alias("stratum"), bin_index(x).alias("bin"))
            .groupBy(F.window(ts, "1 day").alias("w"), "stratum", "bin")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.to_date(F.col("w.start")).alias("day"), "stratum", "bin", "n"))


def start_daily_histograms(spark: SparkSession, source_dir: str, schema: str, ts: str, score: Column, stratum: str,
                           name: str, glob: str | None = None, sink: str = "memory", output_mode: str = "complete",
                           available_now: bool = True, watermark: str = "2 days") -> StreamingQuery:
    """Run the daily-histogram stream over a folder of parquet files (new files are new events). The checkpoint
    lives under the shared checkpoint folder so a restarted driver resumes where it stopped."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = daily_histogram_stream(reader.parquet(source_dir), ts, score, stratum, watermark)
    ckpt = os.path.join(ensure_checkpoint_dir(spark), f"stream-{name}")
    writer = stream.writeStream.outputMode(output_mode).option("checkpointLocation", ckpt)
    writer = writer.format(sink).queryName(name) if sink == "memory" else writer.format(sink)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def trailing_psi(daily: DataFrame, baseline_hist: DataFrame, now: str, days: int, min_per_side: int = 5) -> DataFrame:
    """PSI per stratum of the last ``days`` days of daily counts against a baseline histogram
    (stratum, bin, n). Proportions are bin count / all rows of the side, clipped at 1e-6; strata with fewer than
    ``min_per_side`` rows on either side are left out (J5)."""
    cutoff = F.date_sub(F.lit(now).cast("date"), days - 1)
    cur = (daily.filter((F.col("day") >= cutoff) & (F.col("day") <= F.lit(now).cast("date")))
           .groupBy(F.col("stratum").alias("stratum"))
           .agg(*[F.sum(F.when(F.col("bin") == i, F.col("n")).otherwise(0)).alias(f"c_h{i}")
                                      for i in range(BINS)], F.sum("n").alias("c_n")))
    # grouping on fresh aliases gives each side its own attribute ids (both sides may come from one in-memory table)
    base = baseline_hist.groupBy(F.col("stratum").alias("stratum")).agg(
        *[F.sum(F.when(F.col("bin") == i, F.col("n")).otherwise(0)).alias(f"b_h{i}") for i in range(BINS)],
        F.sum("n").alias("b_n"))
    j = base.join(cur, "stratum").where((F.col("b_n") >= min_per_side) & (F.col("c_n") >= min_per_side))
    terms = []
    for i in range(BINS):
        pb = F.greatest(F.col(f"b_h{i}") / F.col("b_n"), F.lit(EPS_CLIP))
        pc = F.greatest(F.col(f"c_h{i}") / F.col("c_n"), F.lit(EPS_CLIP))
        terms.append((pc - pb) * F.log(pc / pb))
    return j.select("stratum", sum(terms).alias("psi"), F.col("b_n").cast("bigint").alias("n_baseline"),
                    F.col("c_n").cast("bigint").alias("n_current"))


def upsert_daily_counts(updates: DataFrame, table_path: str) -> None:
    """Merge one micro-batch of updated (day, stratum, bin, n) rows into a day-partitioned parquet table.

    In update mode a micro-batch carries the *full* new count of every key it touched, so the merge replaces those
    keys and keeps every other key of the touched days; only the touched day partitions are rewritten (dynamic
    partition overwrite). Re-running a batch after a failure produces the same table (idempotent)."""
    spark = updates.sparkSession
    updates = updates.persist()  # read for the days, the keys and the merge
    days = [r[0] for r in updates.select("day").distinct().collect()]  # the handful of days one batch touches
    if not days:
        updates.unpersist()
        return
    keys = ["day", "stratum", "bin"]
    from panelkit.sources.files import path_exists

    if path_exists(spark, table_path):
        current = spark.read.parquet(table_path).filter(F.col("day").isin(days))
        kept = current.join(updates.select(*keys), keys, "left_anti")
        merged = kept.unionByName(updates.select(*keys, "n"))
    else:
        merged = updates.select(*keys, "n")
    # materialise before overwriting the partitions the merge reads from
    from panelkit.session import materialize

    (materialize(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day").parquet(table_path))
    updates.unpersist()


def start_daily_histogram_table(spark: SparkSession, source_dir: str, schema: str, ts: str, score: Column,
                                stratum: str, table_path: str, name: str, glob: str | None = None,
                                watermark: str = "2 days", available_now: bool = True,
                                max_files_per_trigger: int = 1000) -> StreamingQuery:
    """T2 production form: update-mode aggregation (state for days older than the watermark is dropped) merged into
    a day-partitioned table by ``upsert_daily_counts`` in ``foreachBatch``."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = daily_histogram_stream(reader.parquet(source_dir), ts, score, stratum, watermark)
    ckpt = os.path.join(ensure_checkpoint_dir(spark), f"stream-{name}")
    w = (stream.writeStream.outputMode("update").option("checkpointLocation", ckpt)
         .foreachBatch(lambda df, _batch_id: upsert_daily_counts(df, table_path)))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
