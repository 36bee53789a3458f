"""Registered queries run through Structured Streaming (T2 state, T5): the events folder is read as a file stream and
processed to completion with an available-now trigger."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelkit.operators import drift as D
from panelkit.operators import features as FE
from panelkit.operators import ml as ML
from panelkit.operators import pairs as P
from panelkit.plans import bindings as B
from panelkit.plans.registry import query
from panelkit.session import materialize, scratch_path, spread
from panelkit.streaming.monitoring import start_daily_histogram_table, trailing_psi
from panelkit.streaming.scoring import seed_baseline_event, start_scoring

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _sql_bin(x: str) -> str:
    E = D.EDGES
    parts = [f"WHEN {x} >= {E[i]!r} AND {x} {'<=' if i == 9 else '<'} {E[i + 1]!r} THEN {i}" for i in range(10)]
    return f"CASE {' '.join(parts)} END"


@query("streaming_daily_histogram", f"""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS stratum, {_sql_bin('value / 500.0')} AS bin,
       CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY ALL""", ids=("T2", "T5", "A11"))
def streaming_daily_histogram(spark, sf_dir):
    return _daily_table(spark, sf_dir).select(F.col("day").cast("string").alias("day"), "stratum", "bin",
                                              F.col("n").cast("bigint").alias("n"))


def _daily_table(spark, sf_dir):
    """The day-partitioned table that the update-mode stream merges its counts into."""
    name = f"daily_hist_{uuid.uuid4().hex[:8]}"
    path = scratch_path(spark, name)
    start_daily_histogram_table(spark, sf_dir, EVENTS_SCHEMA, "ts", F.col("value") / 500.0, "event_type", path, name,
                                glob="events.parquet").awaitTermination()
    return spark.read.parquet(path)


def _side(prefix: str, where: str) -> str:
    bins = ", ".join(f"sum(CASE WHEN bin = {i} THEN n ELSE 0 END) AS {prefix}{i}" for i in range(10))
    return f"SELECT stratum, {bins}, sum(n) AS {prefix}n FROM d WHERE {where} GROUP BY stratum"


_TERMS = " + ".join(f"(greatest(c{i} / cn, 1e-6) - greatest(b{i} / bn, 1e-6)) * ln(greatest(c{i} / cn, 1e-6) / greatest(b{i} / bn, 1e-6))"
                    for i in range(10))


@query("streaming_trailing_psi", f"""
WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type AS stratum, {_sql_bin('value / 500.0')} AS bin, CAST(count(*) AS DOUBLE) AS n
           FROM events GROUP BY ALL),
last AS (SELECT max(day) AS day FROM d),
b AS ({_side('b', 'day <= (SELECT day FROM last) - 7')}),
c AS ({_side('c', 'day > (SELECT day FROM last) - 7')})
SELECT stratum, round({_TERMS}, 6) AS psi, CAST(bn AS BIGINT) AS n_baseline, CAST(cn AS BIGINT) AS n_current
FROM b JOIN c USING (stratum) WHERE bn >= 5 AND cn >= 5""", ids=("T2", "J5", "A12"))
def streaming_trailing_psi(spark, sf_dir):
    """T2 over the streamed table: the last 7 days against all days before them."""
    daily = _daily_table(spark, sf_dir)
    last = daily.agg(F.max("day")).first()[0]
    base = daily.where(F.col("day") <= F.date_sub(F.lit(last), 7))
    return trailing_psi(daily, base, str(last), 7).withColumn("psi", F.round("psi", 6))


REQUEST_COLS = ["ra", "ano_base", "fase", "turma", "matem", "portug", "ingles", "ieg", "iaa", "ips", "ipp", "genero", "instituicao",
                "ano_ingresso", "defasagem_t", "pair_label"]


@query("scoring_stream_replay", B.with_ctes(B.B2_SQL) + """,
v AS (SELECT fase, count(*) AS n FROM pairs WHERE pair_label = (SELECT max(pair_label) FROM pairs) GROUP BY fase),
t AS (SELECT fase, count(*) AS n FROM pairs WHERE pair_label <> (SELECT max(pair_label) FROM pairs) GROUP BY fase)
SELECT CAST((SELECT sum(n) FROM v) AS BIGINT) AS n_rows,
       CAST((SELECT sum(greatest(1, ceil(n * 15.0 / 100.0))) FROM v) AS BIGINT) AS n_alerts,
       CAST((SELECT sum(n) FROM v) AS BIGINT) AS n_own_scores, 0 AS n_rows_differ, 0 AS n_events_differ, 1 AS n_events,
       CAST((SELECT count(*) + 1 FROM t WHERE n >= 5) AS BIGINT) AS n_seeded, 0 AS n_seeded_again""", ids=("T1", "J7", "T6"))
def scoring_stream_replay(spark, sf_dir):
    """Requests scored by an available-now stream; then the stream's checkpoint is lost and all of it runs again. The
    second run must leave the same snapshots and events, every snapshot row must carry its own row's score, and the baseline
    is seeded once."""
    base = scratch_path(spark, f"replay-{uuid.uuid4().hex[:8]}")
    panel = materialize(B.cust_year(spark, sf_dir))
    train, valid = P.temporal_split(materialize(P.build_pairs(panel)), panel)
    tr, va, lookup = FE.build_features(train, valid, keys_mode="latest")
    num, cat = FE.feature_columns(tr)
    tr = materialize(spread(tr, lookup.rows))
    model = ML.fit(ML.lr_estimator(num, cat), tr, num, cat, checkpoint=False)
    requests = valid.select(*REQUEST_COLS)
    requests.write.json(f"{base}/requests")
    baseline = materialize(ML.score(model, tr, num, cat, keep=["fase"]).select((F.col("score") / 100.0).alias("score"), "fase"))
    schema = ", ".join(f"`{c}` {t}" for c, t in requests.dtypes)
    runs = []
    for i in range(2):  # another name is another checkpoint: the second run knows nothing of the first
        start_scoring(spark, f"{base}/requests", schema, model, num, cat, lookup, baseline, f"{base}/out", name=f"{uuid.uuid4().hex[:8]}-{i}",
                      max_files_per_trigger=100_000, baseline_id="b1").awaitTermination()
        runs.append([materialize(spark.read.json(f"{base}/out/{kind}").select(F.to_json(F.struct("*")).alias("row")))
                     for kind in ("snapshots", "drift_events")])
    differ = [sum(a.exceptAll(b).count() for a, b in ((x, y), (y, x))) for x, y in zip(*runs, strict=True)]
    snapshots = spark.read.json(f"{base}/out/snapshots")
    own = ML.score(model, va, num, cat, keep=["ra"]).select(F.col("ra").alias("_ra"), F.col("score").alias("_score"))
    same = snapshots.join(own, (F.col("ra") == F.col("_ra")) & (F.abs(F.col("score") - F.col("_score")) < 1e-9))
    empty = spark.createDataFrame([], "baseline_id string")
    seed = seed_baseline_event(spark, empty, baseline, "b1")
    seed.write.json(f"{base}/history")
    again = seed_baseline_event(spark, spark.read.json(f"{base}/history"), baseline, "b1").count()
    events = spark.read.json(f"{base}/out/drift_events").count()
    counts = snapshots.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("alerta").cast("bigint").alias("n_alerts"))
    return counts.select("n_rows", "n_alerts", F.lit(same.count()).cast("bigint").alias("n_own_scores"), F.lit(differ[0]).alias("n_rows_differ"),
                         F.lit(differ[1]).alias("n_events_differ"), F.lit(events).cast("int").alias("n_events"),
                         F.lit(spark.read.json(f"{base}/history").count()).cast("bigint").alias("n_seeded"), F.lit(again).cast("int").alias("n_seeded_again"))
