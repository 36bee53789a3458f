"""Registered queries: top-K alerting, policy metrics, AUC, ROC, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import metrics as M
from panelkit.operators import topk as K
from panelkit.plans import bindings as B
from panelkit.plans.common import DIGITS, round_doubles
from panelkit.plans.registry import query

R = DIGITS

RANKED_SQL = """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY fase ORDER BY score DESC NULLS LAST, ra) AS rn,
         greatest(1, CAST(ceil(CAST(count(*) OVER (PARTITION BY fase) AS DOUBLE) * 15.0 / 100.0) AS BIGINT)) AS k
  FROM scored
),
flagged AS (SELECT *, CAST(rn <= k AS INTEGER) AS alerta FROM ranked)"""


def _conf_sql(by: str) -> str:
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {sel}CAST(count(*) AS BIGINT) AS n, CAST(sum(alerta) AS BIGINT) AS n_alert, CAST(sum(target) AS BIGINT) AS n_pos,
  CAST(count(*) FILTER (WHERE alerta = 1 AND target = 1) AS BIGINT) AS tp,
  CAST(count(*) FILTER (WHERE alerta = 1 AND target = 0) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE alerta = 0 AND target = 1) AS BIGINT) AS fn,
  round(avg(CAST(target AS DOUBLE)), {R}) AS base_rate,
  round(coalesce(CAST(count(*) FILTER (WHERE alerta = 1 AND target = 1) AS DOUBLE)
    / nullif(count(*) FILTER (WHERE target = 1), 0), 0.0), {R}) AS recall_at_k,
  round(coalesce(CAST(count(*) FILTER (WHERE alerta = 1 AND target = 1) AS DOUBLE)
    / nullif(count(*) FILTER (WHERE alerta = 1), 0), 0.0), {R}) AS precision_at_k,
  round(CASE WHEN avg(CAST(target AS DOUBLE)) > 0 THEN coalesce(CAST(count(*) FILTER (WHERE alerta = 1 AND target = 1)
    AS DOUBLE) / nullif(count(*) FILTER (WHERE alerta = 1), 0), 0.0) / avg(CAST(target AS DOUBLE)) END, {R}) AS lift_at_k,
  CAST(15.0 AS DOUBLE) AS k_pct
FROM flagged {grp}"""


@query("stratified_alerts", B.with_ctes(B.B3_SQL + RANKED_SQL) + " SELECT ra, fase, alerta FROM flagged",
       ids=("W3", "W1"))
def stratified_alerts(spark, sf_dir):
    return K.stratified_alerts(B.scored(spark, sf_dir), 15.0).select("ra", "fase", "alerta")


@query("stratified_alerts_row_number", B.with_ctes(B.B3_SQL + RANKED_SQL) + " SELECT ra, fase, alerta FROM flagged",
       ids=("W3",))
def stratified_alerts_row_number(spark, sf_dir):
    return K.stratified_alerts(B.scored(spark, sf_dir), 15.0, method="row_number").select("ra", "fase", "alerta")


@query("stratified_alerts_with_nulls", B.with_ctes(B.B3N_SQL) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY fase ORDER BY score DESC NULLS LAST, ra) AS rn,
        greatest(1, CAST(ceil(CAST(count(*) OVER (PARTITION BY fase) AS DOUBLE) * 20.0 / 100.0) AS BIGINT)) AS k
      FROM scored_nulls)
SELECT ra, fase, score, CAST(rn <= k AS INTEGER) AS alerta FROM r""", ids=("W3",))
def stratified_alerts_with_nulls(spark, sf_dir):
    return K.stratified_alerts(B.scored_with_nulls(spark, sf_dir), 20.0).select("ra", "fase", "score", "alerta")


@query("dashboard_alerts", B.with_ctes(B.B3N_SQL) + """,
e AS (SELECT * FROM scored_nulls WHERE fase IS NOT NULL AND score IS NOT NULL),
r AS (SELECT ra, row_number() OVER (PARTITION BY fase ORDER BY score DESC, ra) AS rn,
        greatest(1, CAST(ceil(CAST(count(*) OVER (PARTITION BY fase) AS DOUBLE) * 25.0 / 100.0) AS BIGINT)) AS k
      FROM e)
SELECT s.ra, s.fase, coalesce(r.rn <= r.k, false) AS alerta FROM scored_nulls s LEFT JOIN r ON s.ra = r.ra""",
       ids=("W3b",))
def dashboard_alerts(spark, sf_dir):
    out = K.stratified_alerts(B.scored_with_nulls(spark, sf_dir), 25.0, null_stratum="exclude", null_scores="never",
                              as_bool=True)
    return out.select("ra", "fase", "alerta")


@query("stratified_topk_metrics", B.with_ctes(B.B3_SQL + RANKED_SQL) + _conf_sql(""), ids=("A7", "W3"))
def stratified_topk_metrics(spark, sf_dir):
    return round_doubles(M.operational_metrics(B.scored(spark, sf_dir), 15.0))


@query("stratified_topk_metrics_by_stratum", B.with_ctes(B.B3_SQL + RANKED_SQL) + _conf_sql("fase"), ids=("A8", "W3"))
def stratified_topk_metrics_by_stratum(spark, sf_dir):
    return round_doubles(M.operational_metrics(B.scored(spark, sf_dir), 15.0, by_stratum=True))


def _auc_sql(src: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {sel}round(CASE WHEN sum(target) > 0 AND sum(1 - target) > 0 THEN
  (sum(CASE WHEN target = 1 THEN rk END) - sum(target) * (sum(target) + 1) / 2.0)
  / (CAST(sum(target) AS DOUBLE) * sum(1 - target)) ELSE 0.5 END, {R}) AS auc,
  CAST(sum(target) AS BIGINT) AS n_pos, CAST(count(*) AS BIGINT) AS n
FROM (SELECT {sel}target, rank() OVER ({part} ORDER BY score) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}score) - 1) / 2.0 AS rk
      FROM {src}) {grp}"""


@query("auc_overall", B.with_ctes(B.B3_SQL) + _auc_sql("scored"), ids=("A10",))
def auc_overall(spark, sf_dir):
    return round_doubles(M.auc_table(B.scored(spark, sf_dir)))


@query("auc_by_stratum", B.with_ctes(B.B3_SQL) + _auc_sql("scored", "fase"), ids=("A10",))
def auc_by_stratum(spark, sf_dir):
    return round_doubles(M.auc_table(B.scored(spark, sf_dir), by=["fase"]))


@query("auc_documents", B.with_ctes(B.B4_SQL) + _auc_sql("doc_scored"), ids=("A10",))
def auc_documents(spark, sf_dir):
    return round_doubles(M.auc_table(B.doc_scored(spark, sf_dir)))


EVAL_SQL = """,
clean AS (SELECT ra, fase, coalesce(score, 0.0) / 100.0 AS s, coalesce(target, 0) AS target FROM scored_nulls),
g AS (SELECT *, row_number() OVER (ORDER BY s DESC, ra) AS grn, count(*) OVER () AS n,
             sum(target) OVER () AS npos FROM clean)"""


@query("evaluation_overall", B.with_ctes(B.B3N_SQL + EVAL_SQL) + f"""
SELECT a.auc, a.n AS n_total, a.n_pos AS n_positive, round(CAST(a.n_pos AS DOUBLE) / a.n, {R}) AS base_rate
FROM ({_auc_sql("(SELECT s AS score, target FROM clean)")}) a""", ids=("A9", "A10"))
def evaluation_overall(spark, sf_dir):
    overall = M.evaluate_overall(B.scored_with_nulls(spark, sf_dir))
    return round_doubles(overall)


@query("evaluation_global_topk", B.with_ctes(B.B3N_SQL + EVAL_SQL) + f""",
ks AS (SELECT unnest([10.0, 15.0, 20.0, 25.0]::DOUBLE[]) AS k_pct)
SELECT k_pct, round(coalesce(CAST(sum(target) AS DOUBLE) / nullif(max(npos), 0), 0.0), {R}) AS recall,
       round(CAST(sum(target) AS DOUBLE) / count(*), {R}) AS precision,
       round(CASE WHEN max(npos) > 0 THEN (CAST(sum(target) AS DOUBLE) / count(*)) / (CAST(max(npos) AS DOUBLE) / max(n))
             ELSE 0.0 END, {R}) AS lift,
       CAST(count(*) AS BIGINT) AS n_alert
FROM ks JOIN g ON g.grn <= greatest(1, ceil(CAST(g.n AS DOUBLE) * ks.k_pct / 100.0))
GROUP BY k_pct""", ids=("A9", "W1", "W2"))
def evaluation_global_topk(spark, sf_dir):
    per_k = M.evaluate_per_k(B.scored_with_nulls(spark, sf_dir))
    return round_doubles(per_k)


@query("evaluation_by_stratum", B.with_ctes(B.B3N_SQL + EVAL_SQL) + f""",
st AS (SELECT *, row_number() OVER (PARTITION BY fase ORDER BY s DESC, ra) AS rn,
         greatest(1, CAST(ceil(CAST(count(*) OVER (PARTITION BY fase) AS DOUBLE) * 15.0 / 100.0) AS BIGINT)) AS k
       FROM clean WHERE fase IS NOT NULL),
conf AS (SELECT fase, coalesce(CAST(count(*) FILTER (WHERE rn <= k AND target = 1) AS DOUBLE)
                 / nullif(sum(target), 0), 0.0) AS recall_top15,
                coalesce(CAST(count(*) FILTER (WHERE rn <= k AND target = 1) AS DOUBLE)
                 / nullif(count(*) FILTER (WHERE rn <= k), 0), 0.0) AS precision_top15 FROM st GROUP BY fase),
au AS ({_auc_sql("(SELECT fase, s AS score, target FROM clean WHERE fase IS NOT NULL)", "fase")})
SELECT au.fase, au.n, au.n_pos, au.auc, round(conf.recall_top15, {R}) AS recall_top15,
       round(conf.precision_top15, {R}) AS precision_top15
FROM au JOIN conf ON au.fase = conf.fase""", ids=("A9", "A8"))
def evaluation_by_stratum(spark, sf_dir):
    per_stratum = M.evaluate_by_stratum(B.scored_with_nulls(spark, sf_dir))
    return round_doubles(per_stratum)


@query("roc_curve", B.with_ctes(B.B3_SQL) + f"""
SELECT score, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(q) OVER w AS BIGINT) AS fp,
       round(sum(p) OVER w / sum(p) OVER (), {R}) AS tpr, round(sum(q) OVER w / sum(q) OVER (), {R}) AS fpr
FROM (SELECT score, count(*) FILTER (WHERE target = 1) AS p, count(*) FILTER (WHERE target <> 1) AS q
      FROM scored GROUP BY score)
WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", ids=("W11",))
def roc_curve(spark, sf_dir):
    return round_doubles(M.roc_curve(B.scored(spark, sf_dir)))


@query("k_tradeoff_curve", B.with_ctes(B.B3N_SQL) + f""",
v AS (SELECT ra, score, target, row_number() OVER (ORDER BY score DESC, ra) AS grn, count(*) OVER () AS n,
             sum(target) OVER () AS npos FROM scored_nulls WHERE score IS NOT NULL AND target IS NOT NULL),
ks AS (SELECT unnest([10.0, 15.0, 20.0, 25.0]::DOUBLE[]) AS k_pct)
SELECT k_pct, round(CAST(sum(target) AS DOUBLE) / count(*), {R}) AS precision,
       round(coalesce(CAST(sum(target) AS DOUBLE) / nullif(max(npos), 0), 0.0), {R}) AS recall
FROM ks JOIN v ON v.grn <= greatest(1, ceil(CAST(v.n AS DOUBLE) * ks.k_pct / 100.0)) GROUP BY k_pct""", ids=("W12",))
def k_tradeoff_curve(spark, sf_dir):
    valid = B.scored_with_nulls(spark, sf_dir).filter(F.col("score").isNotNull() & F.col("target").isNotNull())
    per_k = M.global_topk_metrics(valid, score="score", target="target", entity="ra")
    return round_doubles(per_k.select("k_pct", "precision", "recall"))


EDGES5 = [i * 0.2 for i in range(6)]


@query("calibration_curve", B.with_ctes(B.B3_SQL) + f""",
b AS (SELECT score / 100.0 AS s, CAST(target AS DOUBLE) AS y,
        CASE {' '.join(f"WHEN score / 100.0 >= {EDGES5[i]!r} AND score / 100.0 < {EDGES5[i + 1]!r} THEN {i}"
                       for i in range(5))} END AS bin
      FROM scored WHERE score IS NOT NULL AND target IS NOT NULL)
SELECT CASE bin {' '.join(f"WHEN {i} THEN '[{EDGES5[i]:.1f}-{EDGES5[i + 1]:.1f})'" for i in range(5))} END AS bucket,
       CAST(count(*) AS BIGINT) AS n, round(avg(y), {R}) AS rate, round(avg(s), {R}) AS mean_pred
FROM b WHERE bin IS NOT NULL AND (SELECT count(*) FROM b) >= 11 GROUP BY bin""", ids=("A18",))
def calibration_curve(spark, sf_dir):
    return round_doubles(M.calibration(B.scored(spark, sf_dir)))


@query("alerts_by_stratum", B.with_ctes(B.B3_SQL + RANKED_SQL) + f"""
SELECT fase, CAST(count(ra) AS BIGINT) AS total, CAST(sum(alerta) AS BIGINT) AS alertas,
       round(avg(score), {R}) AS score_medio, round(100.0 * sum(alerta) / count(ra), {R}) AS pct_alerta
FROM flagged GROUP BY fase""", ids=("A21",))
def alerts_by_stratum(spark, sf_dir):
    flagged = K.stratified_alerts(B.scored(spark, sf_dir), 15.0)
    return round_doubles(M.alerts_by_stratum(flagged))


@query("score_summary", B.with_ctes(B.B3N_SQL) + f"""
SELECT round(coalesce(avg(score), 0.0), {R}) AS score_mean,
       round(coalesce(quantile_cont(score, 0.9), 0.0), {R}) AS score_p90,
       round(coalesce(quantile_cont(score, 0.99), 0.0), {R}) AS score_p99 FROM scored_nulls""", ids=("A22",))
def score_summary(spark, sf_dir):
    return round_doubles(M.score_summary(B.scored_with_nulls(spark, sf_dir)))


@query("alert_threshold", B.with_ctes(B.B3_SQL + RANKED_SQL) + """
SELECT CAST(sum(alerta) AS BIGINT) AS n_alerta, CAST(count(*) AS BIGINT) AS n_total,
       coalesce(min(score) FILTER (WHERE alerta = 1), 0.0) AS score_threshold FROM flagged""", ids=("P19",))
def alert_threshold(spark, sf_dir):
    flagged = K.stratified_alerts(B.scored(spark, sf_dir), 15.0)
    return flagged.agg(F.sum("alerta").cast("bigint").alias("n_alerta"), F.count(F.lit(1)).alias("n_total"),
                       F.coalesce(F.min(F.when(F.col("alerta") == 1, F.col("score"))), F.lit(0.0))
                       .alias("score_threshold"))


@query("top_n_per_stratum", B.with_ctes(B.B3_SQL) + """
SELECT ra, fase, score FROM (SELECT *, row_number() OVER (PARTITION BY fase ORDER BY score DESC, ra) AS rn
FROM scored) WHERE rn <= 20""", ids=("W5",))
def top_n_per_stratum(spark, sf_dir):
    return K.top_n_per_group(B.scored(spark, sf_dir), "fase", "score", 20, tiebreak="ra").select("ra", "fase", "score")


@query("sample_per_stratum", B.with_ctes(B.B3_SQL) + """
SELECT ra, fase FROM (SELECT *, row_number() OVER (PARTITION BY fase ORDER BY md5(CAST(ra AS VARCHAR) || ':42')) AS rn
FROM scored) WHERE rn <= 500""", ids=("W10",))
def sample_per_stratum(spark, sf_dir):
    return K.sample_per_stratum(B.scored(spark, sf_dir), "fase", "ra", 500, seed=42).select("ra", "fase")


@query("top3_factors", B.with_ctes(B.B1_SQL) + """,
u AS (SELECT ra, ano_base, unnest(['matem', 'portug', 'ieg', 'ips']) AS f,
             unnest([coalesce(matem, 6.0) - 6.0, coalesce(portug, 6.0) - 6.0, coalesce(ieg, 6.0) - 6.0,
                     coalesce(ips, 6.0) - 6.0]) AS v, unnest([1, 2, 3, 4]) AS pos FROM cust_year),
r AS (SELECT *, row_number() OVER (PARTITION BY ra, ano_base ORDER BY abs(v) DESC, pos) AS rn FROM u)
SELECT ra, ano_base, list(f ORDER BY rn) AS top3_factors, list(round(v, 9) ORDER BY rn) AS top3_values
FROM r WHERE rn <= 3 GROUP BY ra, ano_base""", ids=("W6",))
def top3_factors(spark, sf_dir):
    df = B.cust_year(spark, sf_dir)
    names = F.array(*[F.lit(c) for c in ("matem", "portug", "ieg", "ips")])
    vals = F.array(*[F.coalesce(F.col(c), F.lit(6.0)) - 6.0 for c in ("matem", "portug", "ieg", "ips")])
    n, v = K.top3_by_magnitude(names, vals)
    return df.select("ra", "ano_base", n.alias("top3_factors"),
                     F.transform(v, lambda x: F.round(x, 9)).alias("top3_values"))


@query("model_comparison_on_k", B.with_ctes(B.B3_SQL) + f""",
two AS (SELECT ra, target, score AS score_a, CAST(ra % 100 AS DOUBLE) AS score_b FROM scored),
ks AS (SELECT unnest([10.0, 15.0, 20.0, 25.0]::DOUBLE[]) AS k_pct),
ga AS (SELECT *, row_number() OVER (ORDER BY score_a DESC, ra) AS rn, count(*) OVER () AS n, sum(target) OVER () AS np
       FROM two),
gb AS (SELECT *, row_number() OVER (ORDER BY score_b DESC, ra) AS rn, count(*) OVER () AS n, sum(target) OVER () AS np
       FROM two),
a AS (SELECT k_pct, CAST(sum(target) AS DOUBLE) / count(*) AS precision_a,
             CAST(sum(target) AS DOUBLE) / max(np) AS recall_a
      FROM ks JOIN ga ON ga.rn <= greatest(1, ceil(CAST(ga.n AS DOUBLE) * ks.k_pct / 100.0)) GROUP BY k_pct),
b AS (SELECT k_pct, CAST(sum(target) AS DOUBLE) / count(*) AS precision_b,
             CAST(sum(target) AS DOUBLE) / max(np) AS recall_b
      FROM ks JOIN gb ON gb.rn <= greatest(1, ceil(CAST(gb.n AS DOUBLE) * ks.k_pct / 100.0)) GROUP BY k_pct)
SELECT a.k_pct, round(precision_a, {R}) AS precision_a, round(recall_a, {R}) AS recall_a,
       round(precision_b, {R}) AS precision_b, round(recall_b, {R}) AS recall_b
FROM a LEFT JOIN b USING (k_pct)""", ids=("J6", "W1", "W2"))
def model_comparison_on_k(spark, sf_dir):
    """Two models' global top-K tables (the order-value score and a weak id-based score) left-joined on K."""
    s = B.scored(spark, sf_dir).withColumn("score_b", (F.col("ra") % 100).cast("double"))
    a = M.global_topk_metrics(s, score="score", target="target", entity="ra").select(
        "k_pct", F.col("precision").alias("precision_a"), F.col("recall").alias("recall_a"))
    b = M.global_topk_metrics(s, score="score_b", target="target", entity="ra").select(
        "k_pct", F.col("precision").alias("precision_b"), F.col("recall").alias("recall_b"))
    return round_doubles(a.join(b, "k_pct", "left"))
