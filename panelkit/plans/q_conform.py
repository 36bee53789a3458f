"""Registered queries: period sheets with drifting column names conformed and stacked (S1, S2, P1, P3, P6, P7, U1),
and the notebook standardisation chain (P4, P8–P11, F8–F14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from panelkit.functions import names as N
from panelkit.operators import conform as CF
from panelkit.plans import bindings as B
from panelkit.plans.common import DIGITS, round_doubles
from panelkit.plans.q_functions import PEDRA_SQL, _NUM_RE, sql_f3, sql_slug
from panelkit.plans.registry import query

R = DIGITS


def _styled_sheets(spark, sf_dir):
    """Three naming styles of the same yearly sheet, chosen by year % 3 (names drift between periods)."""
    raw = B.raw_sheet(spark, sf_dir)
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus",
                                                  "o_orderpriority")
    j = raw.join(o, F.trim("ra_raw").cast("bigint") == o.o_orderkey)
    grid = F.floor(F.col("o_totalprice") / 500.0) / 100.0
    style = F.col("ano_base") % 3
    a = j.filter(style == 0).select(
        F.col("ano_base").alias("_year"), F.col("ra_raw").alias("RA"), F.col("fase_raw").alias("Fase"),
        F.col("o_orderstatus").alias("Turma"), F.col("matem_raw").alias("Matem"),
        (F.col("o_totalprice") / 1000.0).alias("Portug"), grid.alias("Inglês"), (F.col("o_custkey") % 10).alias("IEG"),
        (F.col("o_custkey") % 3).cast("string").alias("Defasagem"), F.col("genero_raw").alias("Gênero"),
        F.col("o_orderpriority").alias("Instituição de Ensino"), F.col("ano_nasc_raw").alias("Ano nasc"))
    b = j.filter(style == 1).select(
        F.col("ano_base").alias("_year"), F.col("ra_raw").alias("ra"), F.col("fase_raw").alias("FASE"),
        F.col("o_orderstatus").alias("TURMA"), grid.alias("Matem"), F.col("matem_raw").alias("MAT"),
        (F.col("o_totalprice") / 1000.0).alias("Por"), (F.col("o_custkey") % 3).alias("Defas"),
        F.col("genero_raw").alias("genero"), F.col("o_orderpriority").alias("INSTITUICAO"),
        F.col("idade_raw").alias("Idade"), F.col("ano_nasc_raw").alias("Ano nasc"))
    c = j.filter(style == 2).select(
        F.col("ano_base").alias("_year"), F.col("ra_raw").alias("Ra"), F.col("fase_raw").alias("fase"),
        F.col("o_orderstatus").alias("turma"), F.col("matem_raw").alias("matem"),
        (F.col("o_custkey") % 10).cast("double").alias("ieg"), (F.col("o_totalprice") / 7000.0).alias("ipp"),
        F.col("o_orderpriority").alias("Escola"), F.col("genero_raw").alias("genero"))
    return [a, b, c]


CONFORM_COLS = ["ra", "ano_base", "fase_raw", "turma", "defasagem", "matem", "portug", "ingles", "ieg", "iaa", "ips",
                "ipp", "genero", "instituicao", "escola", "ano_ingresso", "ano_nasc", "idade", "fase"]


def _f11(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{_NUM_RE}') THEN try_cast(trim({x}) AS DOUBLE) END"


GENDER_NA = (f"coalesce(CASE WHEN {sql_slug('genero_raw')} IN ('menino','masculino','m') THEN 'M' "
             f"WHEN {sql_slug('genero_raw')} IN ('menina','feminino','f') THEN 'F' END, 'NA')")


@query("conform_period_sheets", B.with_ctes(B.RAW_SQL) + f""",
j AS (SELECT r.*, o.o_custkey, o.o_totalprice, o.o_orderstatus, o.o_orderpriority, r.ano_base % 3 AS st
      FROM raw_sheet r JOIN orders o ON CAST(trim(r.ra_raw) AS BIGINT) = o.o_orderkey)
SELECT trim(ra_raw) AS ra, ano_base, fase_raw, o_orderstatus AS turma,
  CASE st WHEN 0 THEN {_f11("CAST(o_custkey % 3 AS VARCHAR)")} WHEN 1 THEN CAST(o_custkey % 3 AS DOUBLE) END AS defasagem,
  round(CASE st WHEN 1 THEN floor(o_totalprice / 500.0) / 100.0 ELSE {_f11('matem_raw')} END, {R}) AS matem,
  round(CASE WHEN st IN (0, 1) THEN o_totalprice / 1000.0 END, {R}) AS portug,
  round(CASE st WHEN 0 THEN floor(o_totalprice / 500.0) / 100.0 END, {R}) AS ingles,
  CASE WHEN st IN (0, 2) THEN CAST(o_custkey % 10 AS DOUBLE) END AS ieg,
  CAST(NULL AS DOUBLE) AS iaa, CAST(NULL AS DOUBLE) AS ips,
  round(CASE st WHEN 2 THEN o_totalprice / 7000.0 END, {R}) AS ipp,
  {GENDER_NA} AS genero,
  CASE WHEN st IN (0, 1) THEN o_orderpriority END AS instituicao,
  CASE st WHEN 2 THEN o_orderpriority END AS escola,
  CAST(NULL AS DOUBLE) AS ano_ingresso,
  CASE WHEN st IN (0, 1) THEN ano_nasc_raw END AS ano_nasc,
  CASE st WHEN 0 THEN ano_base - ano_nasc_raw WHEN 1 THEN coalesce(idade_raw, ano_base - ano_nasc_raw) END AS idade,
  {sql_f3('fase_raw')} AS fase
FROM j""", ids=("S2", "P1", "P3", "P5", "P6", "P7", "U1", "F3", "F7", "F11", "F15"))
def conform_period_sheets(spark, sf_dir):
    sheets = _styled_sheets(spark, sf_dir)
    # P5: a compatibility rename by ASCII-folded, case-insensitive name ('IEG' matches 'ieg' only after folding)
    sheets[0] = N.fuzzy_rename(sheets[0], {"ieg": "ieg"})
    parts = [CF.conform_sheet(s, F.col("_year")).drop("_year") for s in sheets]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return round_doubles(stacked.select(*CONFORM_COLS))


def _notebook_sheet(spark, sf_dir):
    """A sheet whose names are already normalised (the notebook dialect), with per-year 'inde' / 'pedra' columns."""
    raw = B.raw_sheet(spark, sf_dir)
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    j = raw.join(o, F.trim("ra_raw").cast("bigint") == o.o_orderkey)
    return j.select(
        F.col("ano_base").alias("_year"), F.col("ra_raw").alias("ra"), F.col("fase_raw").alias("fase"),
        F.col("turma_raw").alias("turma"), F.col("matem_raw").alias("mat"), (F.col("o_totalprice") / 1000.0).alias("por"),
        (F.col("o_custkey") % 3).cast("string").alias("defas"), F.col("data_nasc").alias("data_de_nasc"),
        F.col("ano_nasc_raw").alias("ano_nasc"), F.col("genero_raw").alias("genero"),
        F.col("o_orderpriority").alias("instituicao_de_ensino"),
        ((F.col("o_custkey") % 4).cast("double") + 0.5).alias("no_av"),
        (F.col("o_totalprice") / 10000.0).alias("inde_97"), (F.col("o_totalprice") / 20000.0).alias("inde_1998"),
        F.col("pedra_raw").alias("pedra_97"), F.col("pedra_raw").alias("pedra_1998"))


NB_COLS = ["ra", "ano_base", "fase_raw", "turma", "defasagem", "matem", "portug", "ingles", "ieg", "iaa", "ips", "ipp",
           "genero", "instituicao", "ano_ingresso", "fase", "data_nasc", "ano_nasc", "idade", "no_av", "inde", "pedra"]
_TOK = "CASE WHEN trim({x}) IN ('NAN', 'nan', '') THEN NULL ELSE trim({x}) END"
_UTOK = "CASE WHEN upper(trim({x})) IN ('NAN', 'nan', '') THEN NULL ELSE upper(trim({x})) END"
_G = _UTOK.format(x="genero_raw")
_BORN = "try_strptime(data_nasc, '%d/%m/%Y')"
_BIRTH = f"coalesce(year({_BORN}), CAST(round_even(ano_nasc_raw, 0) AS BIGINT))"


@query("standardize_sheet", B.with_ctes(B.RAW_SQL) + f""",
j AS (SELECT r.*, o.o_custkey, o.o_totalprice, o.o_orderpriority
      FROM raw_sheet r JOIN orders o ON CAST(trim(r.ra_raw) AS BIGINT) = o.o_orderkey)
SELECT trim(ra_raw) AS ra, ano_base, fase_raw, {_TOK.format(x='turma_raw')} AS turma,
  CAST(round_even({_f11("CAST(o_custkey % 3 AS VARCHAR)")}, 0) AS BIGINT) AS defasagem,
  round({_f11('matem_raw')}, {R}) AS matem, round(o_totalprice / 1000.0, {R}) AS portug,
  CAST(NULL AS DOUBLE) AS ingles, CAST(NULL AS DOUBLE) AS ieg, CAST(NULL AS DOUBLE) AS iaa, CAST(NULL AS DOUBLE) AS ips,
  CAST(NULL AS DOUBLE) AS ipp,
  CASE WHEN {sql_slug(_G)} IN ('menino','masculino','m') THEN 'M' WHEN {sql_slug(_G)} IN ('menina','feminino','f') THEN 'F'
       END AS genero,
  {_TOK.format(x='o_orderpriority')} AS instituicao, CAST(NULL AS BIGINT) AS ano_ingresso,
  CAST({sql_f3(_UTOK.format(x='fase_raw'))} AS BIGINT) AS fase,
  CAST(CAST({_BORN} AS DATE) AS VARCHAR) AS data_nasc, {_BIRTH} AS ano_nasc,
  CASE WHEN ano_base - {_BIRTH} BETWEEN 0 AND 120 THEN ano_base - {_BIRTH} END AS idade,
  CAST(round_even(CAST(o_custkey % 4 AS DOUBLE) + 0.5, 0) AS BIGINT) AS no_av,
  round(CASE ano_base WHEN 1997 THEN o_totalprice / 10000.0 WHEN 1998 THEN o_totalprice / 20000.0 END, {R}) AS inde,
  CASE WHEN ano_base IN (1997, 1998) THEN {PEDRA_SQL.format(s=sql_slug('pedra_raw'))} END AS pedra
FROM j""", ids=("P4", "P8", "P9", "P10", "P11", "F8", "F9", "F10", "F12", "F13", "F14", "F15"))
def standardize_sheet(spark, sf_dir):
    sheet = _notebook_sheet(spark, sf_dir)
    out = CF.standardize(sheet, F.col("_year")).drop("_year")
    out = CF.ensure_inde_pedra(out)
    out = CF.normalize_dtypes(CF.normalize_text_fields(out))
    out = out.withColumn("data_nasc", F.col("data_nasc").cast("string"))
    return round_doubles(out.select(*NB_COLS))
