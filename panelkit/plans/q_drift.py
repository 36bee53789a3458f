"""Registered queries: histograms, PSI (both dialects), contributions, drift summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import drift as D
from panelkit.plans import bindings as B
from panelkit.plans.common import DIGITS, round_doubles
from panelkit.plans.registry import query

R = DIGITS
E = D.EDGES


def _sql_bin(x: str) -> str:
    parts = []
    for i in range(D.BINS):
        hi = f"{x} <= {E[i + 1]!r}" if i == D.BINS - 1 else f"{x} < {E[i + 1]!r}"
        parts.append(f"WHEN {x} >= {E[i]!r} AND {hi} THEN {i}")
    return f"CASE {' '.join(parts)} END"


# baseline: orders up to 1997; current: orders from 1998 (score on 0..1)
SIDES_SQL = B.B3_SQL + f""",
sides AS (
  SELECT CASE WHEN ano_base <= 1997 THEN 'b' ELSE 'c' END AS side, fase, score / 100.0 AS x FROM scored
),
binned AS (SELECT *, {_sql_bin('x')} AS bin FROM sides),
tot AS (SELECT side, fase, count(*) AS n, avg(x) AS m, stddev_pop(x) AS sd FROM sides GROUP BY side, fase),
tot_all AS (SELECT side, count(*) AS n, avg(x) AS m, stddev_pop(x) AS sd FROM sides GROUP BY side),
bins AS (SELECT unnest(range(10)) AS bin),
h_all AS (SELECT side, bin, count(*) AS c FROM binned WHERE bin IS NOT NULL GROUP BY side, bin),
h_st AS (SELECT side, fase, bin, count(*) AS c FROM binned WHERE bin IS NOT NULL GROUP BY side, fase, bin)"""


def _sides(spark, sf_dir):
    s = D.with_scale(B.scored(spark, sf_dir))
    return s.filter(F.col("ano_base") <= 1997), s.filter(F.col("ano_base") >= 1998)


PSI_ALL_SQL = """
psi_all AS (
  SELECT sum((pc - pb) * ln(pc / pb)) AS psi FROM (
    SELECT greatest(coalesce(hb.c, 0) / (SELECT n FROM tot_all WHERE side = 'b'), 1e-6) AS pb,
           greatest(coalesce(hc.c, 0) / (SELECT n FROM tot_all WHERE side = 'c'), 1e-6) AS pc
    FROM bins LEFT JOIN h_all hb ON hb.bin = bins.bin AND hb.side = 'b'
              LEFT JOIN h_all hc ON hc.bin = bins.bin AND hc.side = 'c')
)"""


@query("score_histogram", B.with_ctes(SIDES_SQL) + """
SELECT side, CAST(bins.bin AS INTEGER) AS bin, CAST(coalesce(c, 0) AS BIGINT) AS n
FROM (SELECT DISTINCT side FROM sides) s CROSS JOIN bins LEFT JOIN h_all USING (side, bin)""", ids=("A11",))
def score_histogram(spark, sf_dir):
    b, c = _sides(spark, sf_dir)
    h = D.side_histograms(b, c, "score")
    return h.select(F.col("_side").alias("side"), F.posexplode(F.array(*[F.col(f"h{i}") for i in range(D.BINS)]))
                    ).select("side", F.col("pos").cast("int").alias("bin"), F.col("col").cast("bigint").alias("n"))


@query("psi_overall", B.with_ctes(SIDES_SQL, PSI_ALL_SQL) + f"""
SELECT round(psi, {R}) AS psi, CAST((SELECT n FROM tot_all WHERE side = 'b') AS BIGINT) AS n_baseline,
       CAST((SELECT n FROM tot_all WHERE side = 'c') AS BIGINT) AS n_current FROM psi_all""", ids=("A12",))
def psi_overall(spark, sf_dir):
    b, c = _sides(spark, sf_dir)
    return round_doubles(D.psi_table(b, c).drop("stratum"))


@query("psi_smoothed", B.with_ctes(SIDES_SQL) + f""",
cl AS (SELECT side, {_sql_bin('least(greatest(x, 0.0), 1.0)')} AS bin FROM sides),
hh AS (SELECT side, bin, count(*) AS c FROM cl GROUP BY side, bin),
nn AS (SELECT side, sum(c) AS n FROM hh GROUP BY side),
p AS (SELECT (coalesce(hb.c, 0) + 1e-6) / ((SELECT n FROM nn WHERE side = 'b') + 1e-6) AS pb,
             (coalesce(hc.c, 0) + 1e-6) / ((SELECT n FROM nn WHERE side = 'c') + 1e-6) AS pc
      FROM bins LEFT JOIN hh hb ON hb.bin = bins.bin AND hb.side = 'b' LEFT JOIN hh hc ON hc.bin = bins.bin AND hc.side = 'c')
SELECT round(greatest(sum((pc - pb) * ln((pc + 1e-10) / (pb + 1e-10))), 0.0), {R}) AS psi FROM p""", ids=("A13",))
def psi_smoothed(spark, sf_dir):
    b, c = _sides(spark, sf_dir)
    return round_doubles(D.psi_table(b, c, dialect="smooth").select("psi"))


@query("psi_contributions", B.with_ctes(SIDES_SQL) + f""",
cl AS (SELECT side, {_sql_bin('least(greatest(x, 0.0), 1.0)')} AS bin FROM sides),
hh AS (SELECT side, bin, count(*) AS c FROM cl GROUP BY side, bin),
nn AS (SELECT side, sum(c) AS n FROM hh GROUP BY side),
p AS (SELECT bins.bin, (coalesce(hb.c, 0) + 1e-6) / ((SELECT n FROM nn WHERE side = 'b') + 1e-6) AS pb,
             (coalesce(hc.c, 0) + 1e-6) / ((SELECT n FROM nn WHERE side = 'c') + 1e-6) AS pc
      FROM bins LEFT JOIN hh hb ON hb.bin = bins.bin AND hb.side = 'b' LEFT JOIN hh hc ON hc.bin = bins.bin AND hc.side = 'c')
SELECT '[' || printf('%.1f', bin / 10.0) || ',' || printf('%.1f', (bin + 1) / 10.0) || ')' AS name,
       round(pb, {R}) AS baseline_pct, round(pc, {R}) AS current_pct,
       round(greatest((pc - pb) * ln((pc + 1e-10) / (pb + 1e-10)), 0.0), {R}) AS contrib FROM p""", ids=("A14",))
def psi_contributions(spark, sf_dir):
    b, c = _sides(spark, sf_dir)
    return round_doubles(D.psi_contributions(b, c))


def _summary_sql(scope: str, psi: str, tb: str, tc: str) -> str:
    return f"""SELECT {scope}, round_even({psi}, 4) AS psi, CAST(0.2 AS DOUBLE) AS threshold, {psi} >= 0.2 AS drift_detected,
  CASE WHEN {psi} < 0.1 THEN 'ok' WHEN {psi} < 0.2 THEN 'warning' ELSE 'critical' END AS severity,
  round_even(coalesce({tb}.m, 0.0), 4) AS baseline_mean, round_even(coalesce({tc}.m, 0.0), 4) AS current_mean,
  round_even(coalesce({tb}.sd, 0.0), 4) AS baseline_std, round_even(coalesce({tc}.sd, 0.0), 4) AS current_std,
  CAST({tb}.n AS BIGINT) AS n_baseline, CAST({tc}.n AS BIGINT) AS n_current,
  CASE WHEN {psi} >= 0.2 THEN 'drift_detected' ELSE 'ok' END AS status"""


@query("drift_summary", B.with_ctes(SIDES_SQL, PSI_ALL_SQL) + _summary_sql("'__all__' AS scope", "psi_all.psi", "tb", "tc")
       + " FROM psi_all, (SELECT * FROM tot_all WHERE side = 'b') tb, (SELECT * FROM tot_all WHERE side = 'c') tc",
       ids=("A15", "F26", "T4"))
def drift_summary(spark, sf_dir):
    b, c = _sides(spark, sf_dir)
    return D.drift_summary(b, c)


STRATUM_PSI_SQL = """
fases AS (SELECT fase FROM tot WHERE side = 'b' AND n >= 5 INTERSECT SELECT fase FROM tot WHERE side = 'c' AND n >= 5),
psi_st AS (
  SELECT f.fase, sum((greatest(coalesce(hc.c, 0) / tc.n, 1e-6) - greatest(coalesce(hb.c, 0) / tb.n, 1e-6))
                     * ln(greatest(coalesce(hc.c, 0) / tc.n, 1e-6) / greatest(coalesce(hb.c, 0) / tb.n, 1e-6))) AS psi
  FROM fases f CROSS JOIN bins
  JOIN tot tb ON tb.fase = f.fase AND tb.side = 'b' JOIN tot tc ON tc.fase = f.fase AND tc.side = 'c'
  LEFT JOIN h_st hb ON hb.fase = f.fase AND hb.bin = bins.bin AND hb.side = 'b'
  LEFT JOIN h_st hc ON hc.fase = f.fase AND hc.bin = bins.bin AND hc.side = 'c'
  GROUP BY f.fase
)"""


@query("stratum_drift", B.with_ctes(SIDES_SQL, STRATUM_PSI_SQL) + _summary_sql("p.fase", "p.psi", "tb", "tc") + """
FROM psi_st p JOIN tot tb ON tb.fase = p.fase AND tb.side = 'b' JOIN tot tc ON tc.fase = p.fase AND tc.side = 'c'""",
       ids=("A16", "J5"))
def stratum_drift(spark, sf_dir):
    b, c = _sides(spark, sf_dir)
    return D.stratum_drift(b, c, stratum="fase")


@query("baseline_snapshot", B.with_ctes(B.B3_SQL) + """,
t AS (SELECT fase, count(*) AS n, avg(score / 100.0) AS m, stddev_pop(score / 100.0) AS sd FROM scored
      WHERE ano_base <= 1997 GROUP BY fase HAVING count(*) >= 5)
SELECT fase, CAST(0.0 AS DOUBLE) AS psi, CAST(0.2 AS DOUBLE) AS threshold, false AS drift_detected, 'ok' AS severity,
       round_even(m, 4) AS baseline_mean, round_even(m, 4) AS current_mean, round_even(sd, 4) AS baseline_std,
       round_even(sd, 4) AS current_std, CAST(n AS BIGINT) AS n_baseline, CAST(n AS BIGINT) AS n_current,
       'ok' AS status FROM t""", ids=("A17",))
def baseline_snapshot(spark, sf_dir):
    b, _ = _sides(spark, sf_dir)
    return D.baseline_snapshot(b, stratum="fase")


@query("drift_report_oot", B.with_ctes(SIDES_SQL, PSI_ALL_SQL) + _summary_sql("'__all__' AS scope", "psi_all.psi", "tb", "tc")
       + " FROM psi_all, (SELECT * FROM tot_all WHERE side = 'b') tb, (SELECT * FROM tot_all WHERE side = 'c') tc",
       ids=("T4", "A15"))
def drift_report_oot(spark, sf_dir):
    """T4 'oot' mode: training-period scores (orders up to 1997) as baseline, later scores as current."""
    train, valid = _sides(spark, sf_dir)
    summary, _ = D.drift_report("oot", valid=valid, train=train)
    return summary


@query("drift_report_internal", B.with_ctes(SIDES_SQL) + """,
c AS (SELECT * FROM tot_all WHERE side = 'c')
SELECT '__all__' AS scope, CAST(0.0 AS DOUBLE) AS psi, CAST(0.2 AS DOUBLE) AS threshold, false AS drift_detected, 'ok' AS severity,
  round_even(m, 4) AS baseline_mean, round_even(m, 4) AS current_mean, round_even(sd, 4) AS baseline_std,
  round_even(sd, 4) AS current_std, CAST(n AS BIGINT) AS n_baseline, CAST(n AS BIGINT) AS n_current, 'ok' AS status
FROM c""", ids=("T4", "A17"))
def drift_report_internal(spark, sf_dir):
    """T4 'internal' mode: the validation scores against themselves (PSI 0)."""
    _, valid = _sides(spark, sf_dir)
    summary, _ = D.drift_report("internal", valid=valid)
    return summary
