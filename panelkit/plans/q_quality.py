"""Registered queries: data quality, keyed dedup and the star views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from panelkit.operators import quality as Q
from panelkit.operators import star as S
from panelkit.plans import bindings as B
from panelkit.plans.common import DIGITS, round_doubles
from panelkit.plans.registry import query
from panelkit.session import materialize

R = DIGITS
# current = panel years from 1999, train = earlier years
NUM_COLS = ["ano_base", "fase", "defasagem", "matem", "portug", "ingles", "ieg", "iaa", "ips", "ipp", "ano_ingresso"]
STR_COLS = ["ra", "turma", "genero", "instituicao"]


def _cur_train(spark, sf_dir):
    # the quality card runs several one-row aggregates over the same panel: derive it once
    p = materialize(B.cust_year(spark, sf_dir))
    return p.filter(F.col("ano_base") >= 1999), p.filter(F.col("ano_base") < 1999)


CUR_TR = B.B1_SQL + """,
cur AS (SELECT * FROM cust_year WHERE ano_base >= 1999),
tr AS (SELECT * FROM cust_year WHERE ano_base < 1999)"""
Q_CTE = "q AS (SELECT " + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1_{c}, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3_{c}, "
    f"count({c}) AS n_{c}" for c in NUM_COLS) + " FROM cur)"
IQR_SELECT = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(CASE WHEN q.n_{c} >= 4 AND q.q3_{c} - q.q1_{c} > 0 THEN "
    f"(SELECT count(*) FROM cur WHERE CAST({c} AS DOUBLE) < q.q1_{c} - 1.5 * (q.q3_{c} - q.q1_{c}) "
    f"OR CAST({c} AS DOUBLE) > q.q3_{c} + 1.5 * (q.q3_{c} - q.q1_{c})) ELSE 0 END AS BIGINT) AS n_outliers FROM q"
    for c in NUM_COLS)
UNSEEN_SELECT = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) AS BIGINT) AS n_new FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v "
    f"FROM cur WHERE {c} IS NOT NULL EXCEPT SELECT DISTINCT CAST({c} AS VARCHAR) FROM tr WHERE {c} IS NOT NULL) "
    f"HAVING count(*) > 0" for c in STR_COLS)


@query("iqr_outliers", B.with_ctes(CUR_TR, Q_CTE) + IQR_SELECT, ids=("A19",))
def iqr_outliers(spark, sf_dir):
    cur, _ = _cur_train(spark, sf_dir)
    return Q.iqr_outliers(cur, NUM_COLS)


@query("unseen_categories", B.with_ctes(CUR_TR) + UNSEEN_SELECT, ids=("J8",))
def unseen_categories(spark, sf_dir):
    cur, train = _cur_train(spark, sf_dir)
    return Q.unseen_categories(cur, train, STR_COLS)


@query("quality_card", B.with_ctes(CUR_TR, Q_CTE, f"o AS ({IQR_SELECT})", f"u AS ({UNSEEN_SELECT})") + f"""
SELECT round((SELECT {' + '.join(f'count(*) FILTER (WHERE {c} IS NULL)' for c in NUM_COLS)} FROM cur) * 100.0
             / ((SELECT count(*) FROM cur) * {len(NUM_COLS)}), {R}) AS pct_missing,
       CAST((SELECT coalesce(sum(n_outliers), 0) FROM o) AS BIGINT) AS n_outliers,
       CAST((SELECT coalesce(sum(n_new), 0) FROM u) AS BIGINT) AS n_newcats,
       CAST((SELECT count(*) FROM cur) AS BIGINT) AS n_rows, {len(NUM_COLS)} AS n_numeric_cols""", ids=("A20", "A5"))
def quality_card(spark, sf_dir):
    cur, train = _cur_train(spark, sf_dir)
    return round_doubles(Q.quality_card(cur.select(*NUM_COLS, *STR_COLS), train, outlier_cols=20, category_cols=5))


LINE_REST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
             "l_linestatus", "l_shipdate"]


@query("key_sanity", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS n_keys,
       CAST((SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS BIGINT)
         AS n_dup_keys,
       CAST(count(DISTINCT l_returnflag) AS BIGINT) AS n_classes FROM lineitem""", ids=("A6",))
def key_sanity(spark, sf_dir):
    return Q.key_sanity(B.dup_lines(spark, sf_dir), ["l_orderkey", "l_linenumber"], "l_returnflag")


FIRST_SQL = f"""
SELECT l_orderkey, l_linenumber, {', '.join(c if c != 'l_shipdate' else 'CAST(l_shipdate AS VARCHAR) AS l_shipdate'
                                            for c in LINE_REST)}
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                   ORDER BY {', '.join(c + ' NULLS FIRST' for c in LINE_REST)}) AS rn FROM lineitem)
WHERE rn = 1"""


@query("dedup_keep_first", FIRST_SQL, ids=("W4",))
def dedup_keep_first(spark, sf_dir):
    from panelkit.operators.pairs import dedup_first

    out = dedup_first(B.dup_lines(spark, sf_dir), ["l_orderkey", "l_linenumber"])
    return out.withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


@query("dedup_keep_latest", """
SELECT l_orderkey, CAST(l_shipdate AS VARCHAR) AS l_shipdate, l_linestatus, l_returnflag, l_linenumber
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_shipdate DESC NULLS LAST, l_linestatus DESC NULLS LAST, l_returnflag DESC NULLS LAST,
                 l_linenumber DESC NULLS LAST) AS rn FROM lineitem) WHERE rn = 1""", ids=("W4", "W8"))
def dedup_keep_latest(spark, sf_dir):
    src = B.dup_lines(spark, sf_dir).select("l_orderkey", "l_shipdate", "l_linestatus", "l_returnflag", "l_linenumber")
    out = S.dedup_latest(src, ["l_orderkey"], ["l_shipdate"])
    return out.withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


def _star(spark, sf_dir):
    panel = B.dup_lines(spark, sf_dir)
    star = S.build_star(
        panel, "l_orderkey", "l_linenumber",
        fact_cols=["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"],
        entity_cols=["l_shipdate", "l_linestatus"],
        indicator_cols=["l_discount", "l_tax", "l_quantity"],
        process_cols=["l_linestatus", "l_shipdate", "l_tax"],
        entity_order=["l_shipdate"])
    return S.views(star, "l_orderkey", "l_linenumber", ml_entity_fields=["l_shipdate", "l_linestatus"],
                   dash_process_fields=["l_linestatus"], audit_fact_fields=["l_quantity", "l_returnflag"])


STAR_SQL = """
line AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey NULLS FIRST, l_suppkey NULLS FIRST,
    l_quantity NULLS FIRST, l_extendedprice NULLS FIRST, l_returnflag NULLS FIRST, l_discount NULLS FIRST, l_tax NULLS FIRST,
    l_linestatus NULLS FIRST, l_shipdate NULLS FIRST) AS rn FROM lineitem) WHERE rn = 1),
fact AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag FROM line),
ent AS (SELECT l_orderkey, l_shipdate, l_linestatus FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC NULLS LAST, l_linestatus DESC NULLS LAST) AS rn
  FROM lineitem) WHERE rn = 1),
ind AS (SELECT l_orderkey, l_linenumber, l_discount, l_tax, l_quantity FROM line),
proc AS (SELECT l_orderkey, l_linenumber, l_linestatus, l_shipdate, l_tax FROM line)"""


@query("star_view_ml", B.with_ctes(STAR_SQL) + """
SELECT f.*, CAST(e.l_shipdate AS VARCHAR) AS l_shipdate, e.l_linestatus FROM fact f LEFT JOIN ent e USING (l_orderkey)""",
       ids=("J4", "W4"))
def star_view_ml(spark, sf_dir):
    return _star(spark, sf_dir)["vw_ml"].withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


@query("star_view_360", B.with_ctes(STAR_SQL) + """
SELECT f.*, i.l_discount, i.l_tax, i.l_quantity AS l_quantity_ind, p.l_linestatus
FROM fact f LEFT JOIN ind i USING (l_orderkey, l_linenumber) LEFT JOIN proc p USING (l_orderkey, l_linenumber)""",
       ids=("J4",))
def star_view_360(spark, sf_dir):
    return _star(spark, sf_dir)["vw_360"]


@query("star_view_360_source_lines", B.with_ctes(STAR_SQL) + """,
v AS (SELECT f.*, i.l_discount, i.l_tax, p.l_linestatus
      FROM fact f JOIN ind i USING (l_orderkey, l_linenumber) JOIN proc p USING (l_orderkey, l_linenumber))
SELECT count(*) AS n_rows, CAST(sum(CASE WHEN EXISTS (
    SELECT 1 FROM lineitem s WHERE s.l_orderkey = v.l_orderkey AND s.l_linenumber = v.l_linenumber
      AND s.l_partkey = v.l_partkey AND s.l_suppkey = v.l_suppkey AND s.l_quantity = v.l_quantity
      AND s.l_extendedprice = v.l_extendedprice AND s.l_returnflag = v.l_returnflag AND s.l_discount = v.l_discount
      AND s.l_tax = v.l_tax AND s.l_linestatus = v.l_linestatus) THEN 1 ELSE 0 END) AS BIGINT) AS n_source_lines
FROM v""", ids=("J4",))
def star_view_360_source_lines(spark, sf_dir):
    """Every row of vw_360 is one line of the source."""
    v = _star(spark, sf_dir)["vw_360"]
    cols = [c for c in v.columns if not c.endswith("_ind")]
    lines = B.dup_lines(spark, sf_dir).select(*cols).distinct().withColumn("_source", F.lit(1))
    same = reduce(lambda a, b: a & b, [F.col(f"v.{c}").eqNullSafe(F.col(f"s.{c}")) for c in cols])
    return v.alias("v").join(lines.alias("s"), same, "left").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("_source").alias("n_source_lines"))


@query("star_view_audit", B.with_ctes(STAR_SQL) + """
SELECT p.l_orderkey, p.l_linenumber, p.l_linestatus, CAST(p.l_shipdate AS VARCHAR) AS l_shipdate, p.l_tax,
       f.l_quantity, f.l_returnflag FROM proc p LEFT JOIN fact f USING (l_orderkey, l_linenumber)""", ids=("J4",))
def star_view_audit(spark, sf_dir):
    return _star(spark, sf_dir)["vw_audit"].withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


@query("union_periods", B.with_ctes(B.B1_SQL) + """
SELECT ra, ano_base, fase, CASE WHEN ano_base % 2 = 0 THEN NULL ELSE matem END AS matem,
       CASE WHEN ano_base % 2 = 1 THEN NULL ELSE portug END AS portug, ieg FROM cust_year""", ids=("U1",))
def union_periods(spark, sf_dir):
    panel = B.cust_year(spark, sf_dir).select("ra", "ano_base", "fase", "matem", "portug", "ieg")
    even = panel.filter(F.col("ano_base") % 2 == 0).drop("matem")
    odd = panel.filter(F.col("ano_base") % 2 == 1).drop("portug")
    return S.union_periods([even, odd])
