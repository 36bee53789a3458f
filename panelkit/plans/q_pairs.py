"""Registered queries: pairing, temporal split, cohort counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import pairs as P
from panelkit.plans import bindings as B
from panelkit.plans.registry import query

PAIR_COLS = ("ra, ano_base, fase, turma, defasagem_t, defasagem_t1, target, pair_label, "
             "round(matem, 9) AS matem, ieg")


def _pair_proj(df):
    return df.select("ra", "ano_base", "fase", "turma", "defasagem_t", "defasagem_t1", "target", "pair_label",
                     F.round("matem", 9).alias("matem"), "ieg")


@query("base_rate_by_pair", B.with_ctes(B.B2_SQL) + """
SELECT pair_label, CAST(count(*) AS BIGINT) AS n, CAST(sum(target) AS BIGINT) AS n_pos,
       round(avg(CAST(target AS DOUBLE)), 9) AS base_rate
FROM pairs GROUP BY pair_label""", ids=("J1", "F33", "A2"))
def base_rate_by_pair(spark, sf_dir):
    out = P.base_rate_by_pair(B.pairs(spark, sf_dir))
    return out.withColumn("base_rate", F.round("base_rate", 9))


@query("adjacent_pairs", B.with_ctes(B.B2_SQL) + f"SELECT {PAIR_COLS} FROM pairs", ids=("J1", "F33", "U2"))
def adjacent_pairs(spark, sf_dir):
    return _pair_proj(B.pairs(spark, sf_dir))


@query("adjacent_pairs_fanout", B.with_ctes(B.B1_SQL) + f""",
dup AS (SELECT * FROM cust_year UNION ALL
        SELECT * REPLACE (CAST(defasagem + 1 AS INTEGER) AS defasagem) FROM cust_year WHERE CAST(ra AS BIGINT) % 3 = 0),
per AS (SELECT ano_base, lead(ano_base) OVER (ORDER BY ano_base) AS nxt FROM (SELECT DISTINCT ano_base FROM dup)),
pairs AS (SELECT a.ra, a.ano_base, a.fase, a.turma, a.defasagem AS defasagem_t, b.defasagem AS defasagem_t1,
                 CAST(coalesce(CAST(b.defasagem > a.defasagem AS INTEGER), 0) AS INTEGER) AS target,
                 CAST(a.ano_base AS VARCHAR) || '->' || CAST(b.ano_base AS VARCHAR) AS pair_label, a.matem, a.ieg
          FROM dup a JOIN per p ON p.ano_base = a.ano_base JOIN dup b ON b.ra = a.ra AND b.ano_base = p.nxt)
SELECT {PAIR_COLS} FROM pairs""", ids=("J1",))
def adjacent_pairs_fanout(spark, sf_dir):
    """Every third entity has each of its periods twice, with another state: all four pairs of two periods come out."""
    panel = B.cust_year(spark, sf_dir)
    again = panel.where(F.col("ra").cast("bigint") % 3 == 0).withColumn("defasagem", F.col("defasagem") + 1)
    return _pair_proj(P.build_pairs(panel.unionByName(again), dedup=False))


@query("consecutive_pairs", B.with_ctes(B.B1_SQL) + """
SELECT a.ra, a.ano_base, a.defasagem AS defasagem_t, b.defasagem AS defasagem_t1,
       CAST(coalesce(CAST(b.defasagem > a.defasagem AS INTEGER), 0) AS INTEGER) AS target,
       CAST(a.ano_base AS VARCHAR) || '->' || CAST(b.ano_base AS VARCHAR) AS pair_label
FROM cust_year a JOIN cust_year b ON a.ra = b.ra AND b.ano_base = a.ano_base + 1""", ids=("J2", "F33"))
def consecutive_pairs(spark, sf_dir):
    out = P.build_pairs(B.cust_year(spark, sf_dir), adjacency="consecutive")
    return out.select("ra", "ano_base", "defasagem_t", "defasagem_t1", "target", "pair_label")


@query("temporal_split_counts", B.with_ctes(B.B2_SQL) + """
SELECT CASE WHEN pair_label = (SELECT max(pair_label) FROM pairs) THEN 'valid' ELSE 'train' END AS dataset_split,
       CAST(count(*) AS BIGINT) AS n, CAST(sum(target) AS BIGINT) AS n_pos,
       CAST(count(DISTINCT pair_label) AS BIGINT) AS n_pairs
FROM pairs GROUP BY 1""", ids=("U4", "U3"))
def temporal_split_counts(spark, sf_dir):
    panel = B.cust_year(spark, sf_dir)
    train, valid = P.temporal_split(P.build_pairs(panel), panel)
    tagged = train.withColumn("dataset_split", F.lit("train")).unionByName(
        valid.withColumn("dataset_split", F.lit("valid")))
    return tagged.groupBy("dataset_split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("target").cast("bigint").alias("n_pos"),
        F.countDistinct("pair_label").alias("n_pairs"))


@query("cohort_summary", B.with_ctes(B.B2_SQL) + """,
yrs AS (SELECT ano_base, lead(ano_base) OVER (ORDER BY ano_base) AS ano_previsto FROM (SELECT DISTINCT ano_base FROM cust_year)),
raw AS (SELECT ano_base, count(*) AS raw_total, count(*) FILTER (WHERE defasagem = 0) AS eligible_ontrack
        FROM cust_year GROUP BY ano_base),
m AS (SELECT pair_label, count(*) AS matched, sum(target) AS pos FROM pairs GROUP BY pair_label)
SELECT y.ano_base, y.ano_previsto, CAST(r.raw_total AS BIGINT) AS raw_total,
       CAST(r.eligible_ontrack AS BIGINT) AS eligible_ontrack,
       CAST(coalesce(m.matched, 0) AS BIGINT) AS matched_next_year,
       CAST(coalesce(m.matched, 0) AS BIGINT) AS used_in_model,
       CAST(coalesce(m.pos, 0) AS BIGINT) AS n_target_1
FROM yrs y JOIN raw r USING (ano_base)
LEFT JOIN m ON m.pair_label = CAST(y.ano_base AS VARCHAR) || '->' || CAST(y.ano_previsto AS VARCHAR)
WHERE y.ano_previsto IS NOT NULL""", ids=("A3",))
def cohort_summary(spark, sf_dir):
    panel = B.cust_year(spark, sf_dir)
    return P.cohort_summary(panel, P.build_pairs(panel))


@query("population_state_split", B.with_ctes(B.B1_SQL) + """
SELECT ano_base, CAST(count(*) FILTER (WHERE defasagem < 0) AS BIGINT) AS n_ahead,
       CAST(count(*) FILTER (WHERE defasagem = 0) AS BIGINT) AS n_ontrack,
       CAST(count(*) FILTER (WHERE defasagem > 0) AS BIGINT) AS n_lagging
FROM cust_year GROUP BY ano_base""", ids=("A29",))
def population_state_split(spark, sf_dir):
    return P.population_state_split(B.cust_year(spark, sf_dir))
