"""Registered queries: reasons, factors, monitoring panel, filtered view, id resolution, dossier parts
(F25, F26, F27, F35, F39, R1–R3, R8, P16–P18, J9, W8, W14, A24, A25)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelkit.operators import drift as D
from panelkit.operators import metrics as M
from panelkit.operators import report as RP
from panelkit.plans import bindings as B
from panelkit.plans.common import DIGITS, round_doubles
from panelkit.plans.registry import REGISTRY, query
from panelkit.session import materialize, scratch_path
from panelkit.sources.lookup import lookup, open_lookup, write_lookup

R = DIGITS


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


REASON_SQL = ("CASE WHEN len(list_filter([" + ", ".join(
    f"CASE WHEN {c} < 6 THEN {_sql_str(m)} END" for c, m in RP.REASON_RULES) + "], lambda x: x IS NOT NULL)) = 0 THEN "
    + _sql_str(RP.REASON_DEFAULT) + " ELSE array_to_string(list_slice(list_filter([" + ", ".join(
    f"CASE WHEN {c} < 6 THEN {_sql_str(m)} END" for c, m in RP.REASON_RULES)
    + "], lambda x: x IS NOT NULL), 1, 3), ', ') END")


@query("reason_texts", B.with_ctes(B.B1_SQL) + f" SELECT ra, ano_base, {REASON_SQL} AS motivos FROM cust_year",
       ids=("F25",))
def reason_texts(spark, sf_dir):
    df = B.cust_year(spark, sf_dir)
    return df.select("ra", "ano_base", RP.reason_text(df).alias("motivos"))


@query("rule_factors", B.with_ctes(B.B1_SQL) + f""",
f AS ({' UNION ALL '.join(f"SELECT ra, ano_base, {i} AS k, {_sql_str(lbl)} AS feature, CAST({c} AS DOUBLE) AS value, "
                          f"round(6.0 - {c}, {R}) AS impact FROM cust_year WHERE {c} < 6"
                          for i, (c, lbl) in enumerate(RP.FACTOR_LABELS))})
SELECT ra, ano_base, CAST(row_number() OVER (PARTITION BY ra, ano_base ORDER BY k) - 1 AS INTEGER) AS pos, feature, value,
       impact, '↑ risco' AS direction FROM f""", ids=("F35",))
def rule_factors(spark, sf_dir):
    df = B.cust_year(spark, sf_dir)
    out = df.select("ra", "ano_base", F.posexplode(RP.factors_from_rules(df)).alias("pos", "f"))
    return round_doubles(out.select("ra", "ano_base", F.col("pos").cast("int").alias("pos"), "f.feature", "f.value",
                                    "f.impact", "f.direction"))


_ARRAYS = ("matem", "portug", "ingles", "ieg", "iaa", "ips")


@query("attribution_factors", B.with_ctes(B.B1_SQL) + f""",
a AS (SELECT ra, ano_base, unnest([{', '.join(_sql_str(c) for c in _ARRAYS)}]) AS feature, unnest([{', '.join(f'{c} - 6.0' for c in _ARRAYS)}]) AS impact,
             unnest(range({len(_ARRAYS)})) AS pos FROM cust_year)
SELECT ra, ano_base, CAST(pos AS INTEGER) AS pos, feature, round(coalesce(impact, 0.0), 4) AS impact,
       CASE WHEN coalesce(impact, 0.0) > 0 THEN '↑ risco' ELSE '↓ risco' END AS direction FROM a WHERE pos < 5""", ids=("F35",))
def attribution_factors(spark, sf_dir):
    """Parallel arrays of names and impacts, one impact a mark's distance from 6, as the first five factor rows."""
    df = B.cust_year(spark, sf_dir)
    impacts = F.array(*[F.col(c) - F.lit(6.0) for c in _ARRAYS])
    out = df.select("ra", "ano_base", F.posexplode(RP.factors_from_arrays(F.array(*[F.lit(c) for c in _ARRAYS]), impacts)).alias("pos", "f"))
    return out.select("ra", "ano_base", F.col("pos").cast("int").alias("pos"), "f.feature", "f.impact", "f.direction")


@query("group_status", B.with_ctes(B.B3_SQL) + f"""
SELECT fase, turma, ano_base, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(target AS DOUBLE)), {R}) AS rate,
  CASE WHEN avg(CAST(target AS DOUBLE)) >= 0.75 THEN 'ok' WHEN avg(CAST(target AS DOUBLE)) >= 0.65 THEN 'warning'
       ELSE 'critical' END AS precision_status,
  CASE WHEN (CASE WHEN avg(CAST(target AS DOUBLE)) >= 0.75 THEN 'ok' WHEN avg(CAST(target AS DOUBLE)) >= 0.65
       THEN 'warning' ELSE 'critical' END) IN ('critical', 'high', 'danger', 'warning', 'medium', 'warn')
       THEN 'critical' ELSE 'ok' END AS badge,
  CASE WHEN count(*) < 100 THEN 'low_sample' END AS note
FROM scored GROUP BY fase, turma, ano_base""", ids=("F26", "F27", "F39"))
def group_status(spark, sf_dir):
    g = B.scored(spark, sf_dir).groupBy("fase", "turma", "ano_base").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("target").cast("double")).alias("rate"))
    st = RP.gate(F.col("rate"), *RP.GATES["precision"])
    return round_doubles(g.select("fase", "turma", "ano_base", "n", "rate", st.alias("precision_status"),
                                  RP.status_collapse(st).alias("badge"), RP.low_sample(F.col("n")).alias("note")))


def _metrics_row(spark, sf_dir):
    """psi (orders up to 1997 vs later), AUC of all orders, stratified K=15 precision / recall / lift."""
    scored = materialize(B.scored(spark, sf_dir))  # three metric passes read the same scored table
    s = D.with_scale(scored)
    psi = D.drift_summary(s.filter(F.col("ano_base") <= 1997), s.filter(F.col("ano_base") >= 1998)).first()["psi"]
    auc = M.auc_table(scored).first()["auc"]
    op = M.operational_metrics(scored, 15.0).first()
    return spark.createDataFrame([(float(psi), float(auc), float(op["precision_at_k"]), float(op["recall_at_k"]),
                                   float(op["lift_at_k"]))],
                                 "psi double, auc double, precision double, recall double, lift double")


MON_SQL = B.B3_SQL + """,
sides AS (SELECT CASE WHEN ano_base <= 1997 THEN 'b' ELSE 'c' END AS side, score / 100.0 AS x FROM scored),
h AS (SELECT side, """ + "CASE " + " ".join(
    f"WHEN x >= {D.EDGES[i]!r} AND x {'<=' if i == 9 else '<'} {D.EDGES[i + 1]!r} THEN {i}" for i in range(10)) + """ END
      AS bin, count(*) AS c FROM sides GROUP BY ALL),
n AS (SELECT side, count(*) AS n FROM sides GROUP BY side),
bins AS (SELECT unnest(range(10)) AS bin),
psi AS (SELECT round_even(sum((pc - pb) * ln(pc / pb)), 4) AS psi FROM (
  SELECT greatest(coalesce(hb.c, 0) / (SELECT n FROM n WHERE side = 'b'), 1e-6) AS pb,
         greatest(coalesce(hc.c, 0) / (SELECT n FROM n WHERE side = 'c'), 1e-6) AS pc
  FROM bins LEFT JOIN h hb ON hb.bin = bins.bin AND hb.side = 'b' LEFT JOIN h hc ON hc.bin = bins.bin AND hc.side = 'c')),
rk AS (SELECT target, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored),
auc AS (SELECT (sum(CASE WHEN target = 1 THEN r END) - sum(target) * (sum(target) + 1) / 2.0)
               / (CAST(sum(target) AS DOUBLE) * sum(1 - target)) AS auc FROM rk),
fl AS (SELECT target, CAST(row_number() OVER (PARTITION BY fase ORDER BY score DESC, ra)
         <= greatest(1, ceil(CAST(count(*) OVER (PARTITION BY fase) AS DOUBLE) * 15.0 / 100.0)) AS INTEGER) AS a FROM scored),
op AS (SELECT CAST(count(*) FILTER (WHERE a = 1 AND target = 1) AS DOUBLE) / count(*) FILTER (WHERE a = 1) AS precision,
              CAST(count(*) FILTER (WHERE a = 1 AND target = 1) AS DOUBLE) / count(*) FILTER (WHERE target = 1) AS recall,
              avg(CAST(target AS DOUBLE)) AS base FROM fl),
m AS (SELECT psi.psi, auc.auc, op.precision, op.recall, op.precision / op.base AS lift FROM psi, auc, op)"""


@query("monitoring_panel", B.with_ctes(MON_SQL) + f"""
SELECT round(psi, {R}) AS psi, round(auc, {R}) AS auc, round(precision, {R}) AS precision, round(recall, {R}) AS recall,
  round(lift, {R}) AS lift,
  CASE WHEN psi >= 0.10 THEN 'Drift' ELSE 'Estável' END AS drift_axis,
  CASE WHEN auc >= 0.70 AND precision >= 0.65 THEN 'Coerente' ELSE 'Não coerente' END AS coherence_axis,
  CASE WHEN len(list_filter([CASE WHEN psi >= 0.20 THEN {_sql_str(RP.ACTION_DRIFT)} END,
                             CASE WHEN auc < 0.70 THEN {_sql_str(RP.ACTION_AUC)} END,
                             CASE WHEN precision < 0.65 THEN {_sql_str(RP.ACTION_PRECISION)} END], lambda x: x IS NOT NULL)) = 0
       THEN [{_sql_str(RP.ACTION_DEFAULT)}]
       ELSE list_filter([CASE WHEN psi >= 0.20 THEN {_sql_str(RP.ACTION_DRIFT)} END,
                         CASE WHEN auc < 0.70 THEN {_sql_str(RP.ACTION_AUC)} END,
                         CASE WHEN precision < 0.65 THEN {_sql_str(RP.ACTION_PRECISION)} END], lambda x: x IS NOT NULL) END
    AS actions,
  printf('Com K=%d%%, Precision≈%.0f%% e Recall≈%.0f%%. ', 15, precision * 100, recall * 100)
    || CASE WHEN recall < 0.30 THEN 'Para maior cobertura, considere K=20%.' ELSE 'Bom equilíbrio.' END AS k_suggestion,
  CASE WHEN psi < 0.10 THEN 'ok' WHEN psi < 0.20 THEN 'warning' ELSE 'critical' END AS psi_status,
  CASE WHEN auc >= 0.70 THEN 'ok' WHEN auc >= 0.65 THEN 'warning' ELSE 'critical' END AS auc_status,
  CASE WHEN precision >= 0.75 THEN 'ok' WHEN precision >= 0.65 THEN 'warning' ELSE 'critical' END AS precision_status,
  CASE WHEN recall >= 0.35 THEN 'ok' WHEN recall >= 0.25 THEN 'warning' ELSE 'critical' END AS recall_status,
  CASE WHEN lift >= 1.8 THEN 'ok' WHEN lift >= 1.3 THEN 'warning' ELSE 'critical' END AS lift_status
FROM m""", ids=("R1", "R2", "R3", "F26"))
def monitoring_panel(spark, sf_dir):
    return round_doubles(RP.monitoring_panel(_metrics_row(spark, sf_dir)))


@query("filtered_alert_view", B.with_ctes(B.B1_SQL) + f""",
v AS (SELECT *, coalesce(matem, 0.0) * 10.0 AS score FROM cust_year
      WHERE ano_base = 1997 AND CAST(fase AS VARCHAR) IN ('1', '2', '3') AND contains(lower(ra), '1')),
r AS (SELECT *, row_number() OVER (PARTITION BY fase ORDER BY score DESC, ra) AS rn,
             greatest(1, ceil(CAST(count(*) OVER (PARTITION BY fase) AS DOUBLE) * 20.0 / 100.0)) AS k FROM v)
SELECT ra, fase, score, rn <= k AS alerta, {REASON_SQL} AS motivos FROM r""", ids=("P16", "W3b", "F25"))
def filtered_alert_view(spark, sf_dir):
    df = B.cust_year(spark, sf_dir).withColumn("score", F.coalesce(F.col("matem"), F.lit(0.0)) * 10.0)
    out = RP.filtered_view(df, 20.0, period=1997, strata=[1, 2, 3], id_query="1")
    return out.select("ra", "fase", "score", "alerta", "motivos")


REQ_SQL = """,
req AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'RA-' || CAST(c_custkey AS VARCHAR) WHEN 1 THEN CAST(c_custkey AS VARCHAR)
                 WHEN 2 THEN 'ra' || CAST(c_custkey AS VARCHAR) ELSE ' RA- ' || CAST(c_custkey AS VARCHAR) END AS request
        FROM customer)"""


def _requests(spark, sf_dir):
    k = F.col("c_custkey")
    s = k.cast("string")
    req = (F.when(k % 4 == 0, F.concat(F.lit("RA-"), s)).when(k % 4 == 1, s)
           .when(k % 4 == 2, F.concat(F.lit("ra"), s)).otherwise(F.concat(F.lit(" RA- "), s)))
    return B.table(spark, sf_dir, "customer").select(req.alias("request"))


@query("id_resolution", B.with_ctes(B.B1_SQL + REQ_SQL) + """,
c AS (SELECT request, trim(request) AS s FROM req),
cands AS (
  SELECT request, 0 AS pos, s AS cand FROM c
  UNION ALL SELECT request, 1, CASE WHEN starts_with(upper(s), 'RA-') THEN trim(substr(s, 4))
                                     WHEN starts_with(upper(s), 'RA') THEN trim(regexp_replace(substr(s, 3), '^[- ]+', '')) END
            FROM c
  UNION ALL SELECT request, 2, CASE WHEN regexp_full_match(s, '[0-9]+') OR regexp_full_match(replace(s, '-', ''), '[0-9]+')
                                     THEN 'RA-' || s END FROM c),
ids AS (SELECT DISTINCT trim(ra) AS cand FROM cust_year),
hit AS (SELECT request, min(pos) AS pos FROM cands JOIN ids USING (cand) GROUP BY request)
SELECT DISTINCT c.request, (SELECT cand FROM cands x WHERE x.request = c.request AND x.pos = h.pos) AS matched_id
FROM c LEFT JOIN hit h USING (request)""", ids=("P18", "J9"))
def id_resolution(spark, sf_dir):
    return RP.match_ids(_requests(spark, sf_dir), "request", B.cust_year(spark, sf_dir), "ra")


@query("latest_record", B.with_ctes(B.B1_SQL) + f"""
SELECT ra, ano_base, fase, turma, defasagem, round(matem, {R}) AS matem, ieg FROM (
  SELECT *, row_number() OVER (PARTITION BY ra ORDER BY ano_base DESC) AS rn FROM cust_year) WHERE rn = 1""",
       ids=("W8", "R8"))
def latest_record(spark, sf_dir):
    df = B.cust_year(spark, sf_dir).select("ra", "ano_base", "fase", "turma", "defasagem", "matem", "ieg")
    return round_doubles(RP.latest_record(df, "ra", "ano_base"))


@query("score_trajectory", B.with_ctes(B.B1_SQL) + """
SELECT ra, string_agg(CAST(ano_base AS VARCHAR) || ':' || CAST(ieg AS VARCHAR), ',' ORDER BY ano_base) AS history
FROM cust_year GROUP BY ra""", ids=("W14", "R8"))
def score_trajectory(spark, sf_dir):
    hist, _ = RP.trajectory(B.cust_year(spark, sf_dir), "ra", "ano_base", "ieg")
    return hist.select("ra", F.array_join(F.transform("history", lambda x: F.concat(
        x["ano_base"].cast("string"), F.lit(":"), x["ieg"].cast("string"))), ",").alias("history"))


@query("score_change", B.with_ctes(B.B1_SQL) + """
SELECT ra, ano_base, ieg, ieg - lag(ieg) OVER (PARTITION BY ra ORDER BY ano_base) AS change FROM cust_year""",
       ids=("W14",))
def score_change(spark, sf_dir):
    _, change = RP.trajectory(B.cust_year(spark, sf_dir), "ra", "ano_base", "ieg")
    return change


def _fixed(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(18,4)) AS VARCHAR)"


_FACTOR_TEXT = ", ".join(f"CASE WHEN {c} < 6 THEN {_sql_str(lbl)} || '=' || {_fixed(f'6.0 - {c}')} END" for c, lbl in RP.FACTOR_LABELS)


@query("entity_dossiers", B.with_ctes(B.B1_SQL) + f""",
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ra ORDER BY ano_base DESC) AS rn FROM cust_year) WHERE rn = 1),
h AS (SELECT ra, string_agg(CAST(ano_base AS VARCHAR) || '=' || CAST(CAST(ieg AS BIGINT) AS VARCHAR), ';' ORDER BY ano_base) AS history
      FROM cust_year GROUP BY ra),
r AS (SELECT fase, min(ieg) AS lo, max(ieg) AS hi FROM cust_year GROUP BY fase),
b AS (SELECT ra, ano_base, fase, CASE WHEN hi > lo THEN least(floor((ieg - lo) / (hi - lo) * 20), 19) ELSE 0 END AS bin
      FROM cust_year JOIN r USING (fase) WHERE ieg IS NOT NULL),
c AS (SELECT fase, bin, count(*) AS n FROM b GROUP BY ALL),
p AS (SELECT fase, bin, coalesce(sum(n) OVER (PARTITION BY fase ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             sum(n) OVER (PARTITION BY fase) AS n_rows FROM c)
SELECT l.ra, l.ano_base, l.fase, l.turma, h.history, concat_ws(';', {_FACTOR_TEXT}) AS factors, {REASON_SQL} AS motivos,
       round(p.below / p.n_rows, {R}) AS share_below, CAST(p.n_rows AS BIGINT) AS n_rows
FROM l JOIN h USING (ra) LEFT JOIN b ON b.ra = l.ra AND b.ano_base = l.ano_base LEFT JOIN p ON p.fase = b.fase AND p.bin = b.bin""",
       ids=("R8", "W8", "W14", "F35"))
def entity_dossiers(spark, sf_dir):
    """The composed dossier of every entity, its nested parts flattened to text."""
    columns = ["ra", "ano_base", "fase", "turma", "ieg", *[c for c, _ in RP.FACTOR_LABELS if c != "ieg"]]
    d = RP.dossiers(B.cust_year(spark, sf_dir).select(*columns))
    fixed = lambda x: x.cast("decimal(18,4)").cast("string")
    return round_doubles(d.select(
        "ra", F.col("latest.ano_base").alias("ano_base"), F.col("latest.fase").alias("fase"), F.col("latest.turma").alias("turma"),
        F.array_join(F.transform("history", lambda e: F.concat_ws("=", e["period"].cast("string"), e["value"].cast("bigint").cast("string"))), ";").alias("history"),
        F.array_join(F.transform("factors", lambda e: F.concat_ws("=", e["feature"], fixed(e["impact"]))), ";").alias("factors"),
        "motivos", F.col("place.share_below").alias("share_below"), F.col("place.n_rows").alias("n_rows")))


@query("point_lookup", B.with_ctes(B.B3_SQL) + """,
ids AS (SELECT unnest(range(0, 3700, 37)) AS ra)
SELECT ids.ra, s.ra IS NOT NULL AS found, s.ano_base, s.fase, s.turma, s.score FROM ids LEFT JOIN scored s ON s.ra = ids.ra""",
       ids=("P17",))
def point_lookup(spark, sf_dir):
    """A request for 100 ids, absent ones included, against the scored history written by bucket of the id."""
    path = scratch_path(spark, f"lookup-{uuid.uuid4().hex[:10]}")
    history = B.scored(spark, sf_dir).select("ra", "ano_base", "fase", "turma", "score")
    write_lookup(history, path, "ra", ["ano_base"], buckets=32)
    table = open_lookup(spark, path, history.schema.simpleString()[7:-1].replace(":", " "), "ra", 32)
    ids = list(range(0, 3700, 37))
    asked = spark.createDataFrame([(i,) for i in ids], "ra long")
    found = lookup(table, "ra", ids).select(F.col("ra").alias("_ra"), "ano_base", "fase", "turma", "score")
    return asked.join(found, F.col("ra") == F.col("_ra"), "left").select("ra", F.col("_ra").isNotNull().alias("found"), "ano_base", "fase", "turma", "score")


@query("filter_vocabularies", B.with_ctes(B.B1_SQL) + """
SELECT 'period' AS kind, v AS value, CAST(dense_rank() OVER (ORDER BY CAST(v AS BIGINT)) AS INTEGER) AS ord
  FROM (SELECT DISTINCT CAST(ano_base AS VARCHAR) AS v FROM cust_year WHERE ano_base IS NOT NULL)
UNION ALL
SELECT 'stratum', v, CAST(dense_rank() OVER (ORDER BY CASE WHEN v = '0' THEN 0 ELSE CAST(v AS BIGINT) END, v) AS INTEGER)
  FROM (SELECT DISTINCT CAST(fase AS VARCHAR) AS v FROM cust_year WHERE fase IS NOT NULL)
UNION ALL
SELECT 'group', v, CAST(dense_rank() OVER (ORDER BY v) AS INTEGER)
  FROM (SELECT DISTINCT turma AS v FROM cust_year WHERE turma IS NOT NULL)""", ids=("A24", "F5"))
def filter_vocabularies(spark, sf_dir):
    out = RP.filter_vocabularies(B.cust_year(spark, sf_dir))
    return out.withColumn("ord", F.col("ord").cast("int"))


@query("stratum_score_histogram", B.with_ctes(B.B3_SQL) + """,
r AS (SELECT fase, min(score) AS lo, max(score) AS hi FROM scored GROUP BY fase)
SELECT s.fase, CAST(CASE WHEN r.hi - r.lo > 0 THEN least(floor((s.score - r.lo) / (r.hi - r.lo) * 20), 19) ELSE 0 END
       AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n
FROM scored s JOIN r USING (fase) WHERE s.score IS NOT NULL GROUP BY ALL""", ids=("A25", "R8"))
def stratum_score_histogram(spark, sf_dir):
    return RP.stratum_histogram(B.scored(spark, sf_dir))


@query("monitoring_report_document", None, ids=("R4", "S14"))
def monitoring_report_document(spark, sf_dir):
    """The monitoring report as one JSON document: filters, policy metrics, panel statuses and counts."""
    panel = RP.monitoring_panel(_metrics_row(spark, sf_dir))
    counts = B.scored(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"),
                                         F.countDistinct("fase").alias("n_strata")).first()
    doc = panel.select(F.to_json(F.struct(
        F.struct(F.lit(15).alias("k_pct"), F.lit(None).cast("int").alias("ano_base")).alias("filters"),
        F.struct("psi", "auc", "precision", "recall", "lift").alias("metrics"),
        F.struct("drift_axis", "coherence_axis", "psi_status", "auc_status", "precision_status", "recall_status",
                 "lift_status").alias("status"),
        F.col("actions"), F.col("k_suggestion"),
        F.struct(F.lit(int(counts["n_rows"])).alias("n_rows"),
                 F.lit(int(counts["n_strata"])).alias("n_strata")).alias("counts"))).alias("report"))
    return doc


@query("monitoring_report_fields", REGISTRY["monitoring_panel"].sql.replace("FROM m", """,
  15 AS k_pct, (SELECT CAST(count(*) AS INTEGER) FROM scored) AS n_rows, (SELECT CAST(count(DISTINCT fase) AS INTEGER) FROM scored) AS n_strata
FROM m"""), ids=("R4",))
def monitoring_report_fields(spark, sf_dir):
    """The written report document read back, field by field."""
    statuses = [f"{m}_status" for m in ("psi", "auc", "precision", "recall", "lift")]
    metrics = ["psi", "auc", "precision", "recall", "lift"]
    schema = (f"filters struct<k_pct int>, metrics struct<{', '.join(f'{m}: double' for m in metrics)}>, status struct<drift_axis: string, "
              f"coherence_axis: string, {', '.join(f'{s}: string' for s in statuses)}>, actions array<string>, k_suggestion string, "
              "counts struct<n_rows: int, n_strata: int>")
    path = scratch_path(spark, f"report-{uuid.uuid4().hex[:10]}")
    monitoring_report_document(spark, sf_dir).write.text(path)
    doc = spark.read.schema(schema).json(path)
    return round_doubles(doc.select("metrics.*", "status.*", "actions", "k_suggestion", "filters.k_pct", "counts.*"))
