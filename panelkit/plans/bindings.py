"""Bindings: panel relations derived from the driver's tables.

The operators are generic over a PanelSchema; these functions build the concrete relations they are exercised on. Each
binding exists twice: as DataFrame code (what the library runs) and as an independent SQL text (what the DuckDB oracle
runs). The SQL is written by hand, not generated from the DataFrame code, so the two are genuinely separate
implementations.

B1 cust_year  — one row per (customer, order year): a yearly panel.
B2 pairs      — B1 joined to the customer's next available year (J1).
B3 scored     — one row per order with a score, a stratum and a binary target.
B4 doc_scored — labelled documents scored by length.
B5 mon_events — monitoring events and the log lines built from them.
B6 dup_lines  — line items keyed by (order, line number), with real duplicate keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Anchor "now" of the monitoring binding (events span 2024-01-01 .. 2024-01-30). A parameter, never current_date().
MON_NOW = "2024-01-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mark(prio: str) -> Column:
    # Marks on an exact 0.01 grid (0..~10): floor() of an IEEE quotient is identical in every engine, so averages
    # of marks never sit on a rounding boundary.
    mark = F.floor(F.col("o_totalprice") / F.lit(500.0)) / F.lit(100.0)
    return F.avg(F.when(F.col("o_orderpriority") == prio, mark))


# ---------------------------------------------------------------- B1
def cust_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly customer panel. Orders are pre-aggregated per (customer, year) before the customer join, so only one
    row per panel cell crosses the join shuffle."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus",
        F.year("o_orderdate").cast("int").alias("ano_base"),
    )
    cells = orders.groupBy("o_custkey", "ano_base").agg(
        _mark("1-URGENT").alias("matem"),
        _mark("2-HIGH").alias("portug"),
        _mark("3-MEDIUM").alias("ingles"),
        F.count(F.lit(1)).cast("double").alias("ieg"),
        _mark("5-LOW").alias("iaa"),
        _mark("4-NOT SPECIFIED").alias("ips"),
        (F.count_if(F.col("o_orderstatus") == "O") - F.count_if(F.col("o_orderstatus") == "F"))
        .cast("int").alias("defasagem"),
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    panel = cells.join(customer, cells.o_custkey == customer.c_custkey, "inner")
    first_year = F.min("ano_base").over(_by_customer())
    return panel.select(
        F.col("o_custkey").cast("string").alias("ra"),
        "ano_base",
        (F.col("c_nationkey") % 10).cast("int").alias("fase"),
        F.concat_ws("-", F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("turma"),
        "defasagem", "matem", "portug", "ingles", "ieg", "iaa", "ips",
        F.lit(None).cast("double").alias("ipp"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("genero"),
        F.col("c_mktsegment").alias("instituicao"),
        first_year.cast("int").alias("ano_ingresso"),
    )


def _by_customer():
    from pyspark.sql import Window

    # A panel holds at most one row per (customer, year), so this partition is bounded by the number of years.
    return Window.partitionBy("o_custkey")


B1_SQL = """
cust_year AS (
  SELECT CAST(c.o_custkey AS VARCHAR) AS ra, c.ano_base,
         CAST(cu.c_nationkey % 10 AS INTEGER) AS fase,
         cu.c_mktsegment || '-' || CAST(cu.c_nationkey AS VARCHAR) AS turma,
         c.defasagem, c.matem, c.portug, c.ingles, c.ieg, c.iaa, c.ips,
         CAST(NULL AS DOUBLE) AS ipp,
         CASE WHEN cu.c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS genero,
         cu.c_mktsegment AS instituicao,
         CAST(min(c.ano_base) OVER (PARTITION BY c.o_custkey) AS INTEGER) AS ano_ingresso
  FROM (
    SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS ano_base,
           avg(CASE WHEN o_orderpriority = '1-URGENT' THEN floor(o_totalprice / 500.0) / 100.0 END) AS matem,
           avg(CASE WHEN o_orderpriority = '2-HIGH' THEN floor(o_totalprice / 500.0) / 100.0 END) AS portug,
           avg(CASE WHEN o_orderpriority = '3-MEDIUM' THEN floor(o_totalprice / 500.0) / 100.0 END) AS ingles,
           CAST(count(*) AS DOUBLE) AS ieg,
           avg(CASE WHEN o_orderpriority = '5-LOW' THEN floor(o_totalprice / 500.0) / 100.0 END) AS iaa,
           avg(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN floor(o_totalprice / 500.0) / 100.0 END) AS ips,
           CAST(count(*) FILTER (WHERE o_orderstatus = 'O') - count(*) FILTER (WHERE o_orderstatus = 'F') AS INTEGER)
             AS defasagem
    FROM orders GROUP BY o_custkey, CAST(year(o_orderdate) AS INTEGER)
  ) c JOIN customer cu ON c.o_custkey = cu.c_custkey
)"""


# ---------------------------------------------------------------- B2
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelkit.operators.pairs import build_pairs

    return build_pairs(cust_year(spark, sf_dir))


B2_SQL = B1_SQL + """,
periods AS (SELECT ano_base, dense_rank() OVER (ORDER BY ano_base) AS prank FROM (SELECT DISTINCT ano_base FROM cust_year)),
ranked AS (SELECT y.*, p.prank FROM cust_year y JOIN periods p USING (ano_base)),
pairs AS (
  SELECT a.ra, a.ano_base, a.fase, a.turma, a.matem, a.portug, a.ingles, a.ieg, a.iaa, a.ips, a.ipp,
         a.genero, a.instituicao, a.ano_ingresso,
         a.defasagem AS defasagem_t, b.defasagem AS defasagem_t1,
         CAST(coalesce(CAST(b.defasagem > a.defasagem AS INTEGER), 0) AS INTEGER) AS target,
         CAST(a.ano_base AS VARCHAR) || '->' || CAST(b.ano_base AS VARCHAR) AS pair_label
  FROM ranked a JOIN ranked b ON a.ra = b.ra AND b.prank = a.prank + 1
)"""


# ---------------------------------------------------------------- B3
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order. The returned-line flag is reduced per order before the join (map-side partial agg)."""
    orders = table(spark, sf_dir, "orders")
    returned = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("target"))
    )
    joined = orders.join(returned, orders.o_orderkey == returned.l_orderkey, "left")
    return joined.select(
        F.col("o_orderkey").alias("ra"),
        F.col("o_orderpriority").alias("fase"),
        F.col("o_orderstatus").alias("turma"),
        F.year("o_orderdate").cast("int").alias("ano_base"),
        (F.col("o_totalprice") / F.lit(5000.0)).alias("score"),
        F.coalesce(F.col("target"), F.lit(0)).cast("int").alias("target"),
    )


B3_SQL = """
scored AS (
  SELECT o.o_orderkey AS ra, o.o_orderpriority AS fase, o.o_orderstatus AS turma,
         CAST(year(o.o_orderdate) AS INTEGER) AS ano_base,
         o.o_totalprice / 5000.0 AS score,
         CAST(coalesce(r.target, 0) AS INTEGER) AS target
  FROM orders o LEFT JOIN (
    SELECT l_orderkey, max(CAST(l_returnflag = 'R' AS INTEGER)) AS target FROM lineitem GROUP BY l_orderkey
  ) r ON o.o_orderkey = r.l_orderkey
)"""


# ---------------------------------------------------------------- B4
def doc_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("ra"),
        F.col("lang").alias("fase"),
        F.col("n_chars").cast("double").alias("score"),
        F.col("quality").cast("int").alias("target"),
    )


B4_SQL = """
doc_scored AS (
  SELECT l.doc_id AS ra, d.lang AS fase, CAST(d.n_chars AS DOUBLE) AS score, CAST(l.quality AS INTEGER) AS target
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""


# ---------------------------------------------------------------- B5
LOG_LEVEL = {"error": "ERROR"}


def mon_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitoring events: the event type 'purchase' plays the role of a scoring request ('predict_batch'),
    'error' is an error event, value*10 is the request latency in ms."""
    ev = table(spark, sf_dir, "events")
    etype = F.when(F.col("event_type") == "purchase", F.lit("predict_batch")).otherwise(F.col("event_type"))
    return ev.select(
        "event_id", "ts", "user_id",
        etype.alias("event_type"),
        F.floor(F.col("value") * 10).cast("bigint").alias("latency_ms"),
        "value", "props",
        F.to_date("ts").alias("dt"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text log lines in the 'TS | LEVEL | MODULE | MESSAGE | k=v ...' layout, rebuilt from the events."""
    ev = mon_events(spark, sf_dir)
    level = F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("INFO"))
    message = (
        F.when(F.col("event_type") == "error", F.lit("Request failed"))
        .when(F.col("event_type") == "predict_batch", F.lit("Predict batch complete"))
        .otherwise(F.lit("Event recorded"))
    )
    kv = F.concat(
        F.lit("event_type="), F.col("event_type"),
        F.lit(" request_id="), F.col("event_id").cast("string"),
        F.lit(" latency_ms="), F.col("latency_ms").cast("string"),
    )
    line = F.concat_ws(" | ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), level, F.lit("api.routes"), message, kv)
    return ev.select("event_id", "ts", line.alias("value"))


B5_SQL = """
mon_events AS (
  SELECT event_id, ts, user_id,
         CASE WHEN event_type = 'purchase' THEN 'predict_batch' ELSE event_type END AS event_type,
         CAST(floor(value * 10) AS BIGINT) AS latency_ms, value, props, CAST(ts AS DATE) AS dt
  FROM events
),
log_lines AS (
  SELECT event_id, ts,
         strftime(ts, '%Y-%m-%d %H:%M:%S') || ' | ' ||
         CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' | api.routes | ' ||
         CASE WHEN event_type = 'error' THEN 'Request failed'
              WHEN event_type = 'predict_batch' THEN 'Predict batch complete' ELSE 'Event recorded' END || ' | ' ||
         'event_type=' || event_type || ' request_id=' || CAST(event_id AS VARCHAR) ||
         ' latency_ms=' || CAST(latency_ms AS VARCHAR) AS value
  FROM mon_events
)"""


# ---------------------------------------------------------------- B6
def dup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )


def with_ctes(*ctes: str) -> str:
    """Join CTE bodies into one WITH clause (each body starts with 'name AS (')."""
    return "WITH " + ",".join(c.strip().lstrip(",") for c in ctes)


# ---------------------------------------------------------------- raw period sheet (conformance input)
def raw_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A messy 'year sheet' derived from orders: padded ids, phase labels in several spellings, gender and stone
    words with accents and case noise, marks as text (some with decimal commas or junk), day-first birth dates,
    fractional birth years. Every order yields one row, so the conformance work grows with the table."""
    o = table(spark, sf_dir, "orders")
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    price = F.col("o_totalprice").cast("decimal(12,2)").cast("string")

    def pick(key, *values):
        expr = None
        for i, v in enumerate(values):
            v = v if isinstance(v, Column) else F.lit(v)
            expr = F.when(key == i, v) if expr is None else expr.when(key == i, v)
        return expr

    return o.select(
        F.concat(F.lit("  "), k.cast("string"), F.lit(" ")).alias("ra_raw"),
        F.year("o_orderdate").cast("int").alias("ano_base"),
        pick(k % 8, "ALFA", F.concat(F.lit("FASE "), (ck % 10).cast("string")), (ck % 10).cast("string"),
             F.concat((ck % 10).cast("string"), F.lit("A")), ((ck % 13) + 5).cast("string"), None,
             F.concat(F.lit("Fase_"), (ck % 12).cast("string")), F.col("o_orderpriority")).alias("fase_raw"),
        pick(ck % 7, "  feminino  ", "Menino", "M", "f", "MASCULINO", "outro", None).alias("genero_raw"),
        pick(k % 7, "Quartzo", "AMETISTA ", "Topázio", "Ágata", "INCLUIR", "xx", None).alias("pedra_raw"),
        pick(k % 4, F.concat(F.lit("  "), F.col("o_orderstatus"), F.lit(" ")), "nan", "", "NAN").alias("turma_raw"),
        pick(k % 5, price, F.regexp_replace(price, r"\.", ","), F.concat(F.lit(" "), price, F.lit(" ")),
             F.concat(price, F.lit("d")), "n/a").alias("matem_raw"),
        F.when(k % 6 == 5, F.concat(F.lit("31/02/"), F.year("o_orderdate").cast("string")))
        .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("data_nasc"),
        ((F.year("o_orderdate") - 20 - (ck % 5)).cast("double") + F.when(k % 2 == 1, F.lit(0.5)).otherwise(0.0))
        .alias("ano_nasc_raw"),
        F.when(k % 3 == 0, F.lit(None).cast("double")).otherwise((ck % 30).cast("double")).alias("idade_raw"),
    )


RAW_SQL = """
raw_sheet AS (
  SELECT '  ' || CAST(o_orderkey AS VARCHAR) || ' ' AS ra_raw, CAST(year(o_orderdate) AS INTEGER) AS ano_base,
    CASE o_orderkey % 8 WHEN 0 THEN 'ALFA' WHEN 1 THEN 'FASE ' || CAST(o_custkey % 10 AS VARCHAR)
      WHEN 2 THEN CAST(o_custkey % 10 AS VARCHAR) WHEN 3 THEN CAST(o_custkey % 10 AS VARCHAR) || 'A'
      WHEN 4 THEN CAST(o_custkey % 13 + 5 AS VARCHAR) WHEN 5 THEN NULL
      WHEN 6 THEN 'Fase_' || CAST(o_custkey % 12 AS VARCHAR) ELSE o_orderpriority END AS fase_raw,
    CASE o_custkey % 7 WHEN 0 THEN '  feminino  ' WHEN 1 THEN 'Menino' WHEN 2 THEN 'M' WHEN 3 THEN 'f'
      WHEN 4 THEN 'MASCULINO' WHEN 5 THEN 'outro' END AS genero_raw,
    CASE o_orderkey % 7 WHEN 0 THEN 'Quartzo' WHEN 1 THEN 'AMETISTA ' WHEN 2 THEN 'Topázio' WHEN 3 THEN 'Ágata'
      WHEN 4 THEN 'INCLUIR' WHEN 5 THEN 'xx' END AS pedra_raw,
    CASE o_orderkey % 4 WHEN 0 THEN '  ' || o_orderstatus || ' ' WHEN 1 THEN 'nan' WHEN 2 THEN '' ELSE 'NAN' END
      AS turma_raw,
    CASE o_orderkey % 5 WHEN 0 THEN CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR)
      WHEN 1 THEN replace(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR), '.', ',')
      WHEN 2 THEN ' ' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) || ' '
      WHEN 3 THEN CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) || 'd' ELSE 'n/a' END AS matem_raw,
    CASE WHEN o_orderkey % 6 = 5 THEN '31/02/' || CAST(year(o_orderdate) AS VARCHAR)
      ELSE strftime(o_orderdate, '%d/%m/%Y') END AS data_nasc,
    CAST(year(o_orderdate) - 20 - o_custkey % 5 AS DOUBLE) + CASE WHEN o_orderkey % 2 = 1 THEN 0.5 ELSE 0.0 END
      AS ano_nasc_raw,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 30 AS DOUBLE) END AS idade_raw
  FROM orders
)"""


def scored_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3 with holes: a null stratum on every 11th order key and a null score on every 13th."""
    s = scored(spark, sf_dir)
    return s.select(
        "ra", F.when(F.col("ra") % 11 == 0, F.lit(None)).otherwise(F.col("fase")).alias("fase"), "turma", "ano_base",
        F.when(F.col("ra") % 13 == 0, F.lit(None)).otherwise(F.col("score")).alias("score"), "target")


B3N_SQL = B3_SQL + """,
scored_nulls AS (
  SELECT ra, CASE WHEN ra % 11 = 0 THEN NULL ELSE fase END AS fase, turma, ano_base,
         CASE WHEN ra % 13 = 0 THEN NULL ELSE score END AS score, target FROM scored
)"""
