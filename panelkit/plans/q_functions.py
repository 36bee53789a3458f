"""Registered queries: scalar column functions over whole tables (F1–F15, P1/P2 on values).

The SQL side uses DuckDB's own string functions; the helpers below only assemble SQL text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.functions import coerce as C
from panelkit.functions import strata as S
from panelkit.functions import text as T
from panelkit.plans import bindings as B
from panelkit.plans.registry import query


def sql_slug(x: str) -> str:
    s = f"lower(trim(strip_accents({x})))"
    s = f"regexp_replace({s}, '[/\\-.,()\\[\\]{{}}]+', ' ', 'g')"
    s = f"regexp_replace({s}, '\\s+', '_', 'g')"
    s = f"regexp_replace({s}, '[^a-z0-9_]', '', 'g')"
    s = f"regexp_replace({s}, '_+', '_', 'g')"
    return f"regexp_replace({s}, '^_+|_+$', '', 'g')"


def sql_f3(x: str) -> str:
    u = f"upper(trim({x}))"
    n = f"try_cast(nullif(regexp_extract({u}, '(\\d+)', 1), '') AS BIGINT)"
    return (f"CAST(CASE WHEN {x} IS NULL THEN NULL WHEN {u} = 'ALFA' THEN 0 "
            f"WHEN {n} BETWEEN 0 AND 9 THEN {n} END AS INTEGER)")


def sql_f4(x: str) -> str:
    u = f"upper(trim({x}))"
    d = f"regexp_extract({u}, '(\\d+)', 1)"
    return (f"CASE WHEN {x} IS NULL THEN 'UNKNOWN' WHEN {u} = 'ALFA' THEN 'ALFA' "
            f"WHEN starts_with({u}, 'FASE') AND {d} <> '' THEN 'FASE' || CAST(CAST({d} AS BIGINT) AS VARCHAR) "
            f"WHEN regexp_full_match({u}, '[0-9]+') THEN CASE WHEN CAST({u} AS BIGINT) = 0 THEN 'ALFA' "
            f"ELSE 'FASE' || CAST(CAST({u} AS BIGINT) AS VARCHAR) END "
            f"WHEN regexp_matches({u}, '^[0-9]') THEN 'FASE' || substr({u}, 1, 1) ELSE {u} END")


def sql_f5(x: str, full: bool = True) -> str:
    u = f"upper(trim({x}))"
    f_n = "WHEN regexp_full_match(t, 'F[0-9]+') THEN CAST(substr(t, 2) AS BIGINT) " if full else ""
    toks = (f"list_filter(list_transform(string_split_regex(trim(replace({u}, '_', ' ')), '\\s+'), lambda t: "
            f"CASE WHEN regexp_full_match(t, '[0-9]+') THEN CAST(t AS BIGINT) "
            f"WHEN regexp_full_match(t, 'FASE[0-9]+') THEN CAST(substr(t, 5) AS BIGINT) {f_n}END), "
            f"lambda v: v IS NOT NULL)[1]")
    digits = f"CASE WHEN regexp_full_match({u}, '[0-9]+') THEN CAST({u} AS BIGINT) END"
    found = f"coalesce({toks}, {digits})" if full else f"coalesce({digits}, {toks})"
    return f"CAST(CASE WHEN {u} IN ('ALFA', 'F0', 'FASE0', '0') THEN 0 ELSE coalesce({found}, 99) END AS BIGINT)"


def sql_f6(x: str) -> str:
    return (f"CASE WHEN upper(trim({x})) = 'ALFA' THEN CAST(0 AS BIGINT) "
            f"ELSE try_cast(nullif(regexp_extract(upper({x}), '(\\d+)', 1), '') AS BIGINT) END")


@query("fold_accents_documents", """
SELECT doc_id, md5(strip_accents(text)) AS folded_md5, CAST(length(strip_accents(text)) AS BIGINT) AS folded_len
FROM documents""", ids=("F1",))
def fold_accents_documents(spark, sf_dir):
    folded = T.strip_accents(F.col("text"))
    return B.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(folded).alias("folded_md5"), F.length(folded).cast("bigint").alias("folded_len"))


@query("fold_full_documents", """
SELECT doc_id, md5(strip_accents(text)) AS folded_md5 FROM documents""", ids=("F1",))
def fold_full_documents(spark, sf_dir):
    """The full compatibility form over whole texts; these hold Latin letters, where both forms agree."""
    return B.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.strip_accents_full(F.col("text"))).alias("folded_md5"))


@query("slug_values", f"""
SELECT 'url' AS kind, page_id AS id, {sql_slug('url')} AS slug FROM pages
UNION ALL SELECT 'part', p_partkey, {sql_slug('p_name')} FROM part
UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT), {sql_slug('n_name')} FROM nation""", ids=("F2", "P1"))
def slug_values(spark, sf_dir):
    pages = B.table(spark, sf_dir, "pages").select(F.lit("url").alias("kind"), F.col("page_id").alias("id"),
                                                    T.slug(F.col("url")).alias("slug"))
    parts = B.table(spark, sf_dir, "part").select(F.lit("part"), "p_partkey", T.slug(F.col("p_name")))
    nations = B.table(spark, sf_dir, "nation").select(F.lit("nation"), F.col("n_nationkey").cast("bigint"),
                                                       T.slug(F.col("n_name")))
    return pages.unionAll(parts).unionAll(nations)


@query("slug_ascii_urls", """
SELECT page_id, regexp_replace(regexp_replace(lower(trim(regexp_replace(strip_accents(url), '[^\\x00-\\x7F]', '', 'g'))),
       '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages""", ids=("P2",))
def slug_ascii_urls(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", T.slug_ascii(F.col("url")).alias("slug"))


@query("stratum_parsing", B.with_ctes(B.RAW_SQL) + f"""
SELECT fase_raw, {sql_f3('fase_raw')} AS fase_int, {sql_f4('fase_raw')} AS fase_label,
       {sql_f5('fase_raw')} AS sort_key, {sql_f5('fase_raw', False)} AS sort_key_reduced,
       {sql_f6('fase_raw')} AS fase_lenient, CAST(count(*) AS BIGINT) AS n
FROM raw_sheet GROUP BY ALL""", ids=("F3", "F4", "F5", "F6"))
def stratum_parsing(spark, sf_dir):
    c = F.col("fase_raw")
    return B.raw_sheet(spark, sf_dir).groupBy(
        "fase_raw",
        S.stratum_int(c).alias("fase_int"),
        S.stratum_label(c).alias("fase_label"),
        S.stratum_sort_key(c).alias("sort_key"),
        S.stratum_sort_key(c, "reduced").alias("sort_key_reduced"),
        S.stratum_int_lenient(c).alias("fase_lenient"),
    ).agg(F.count(F.lit(1)).alias("n"))


PEDRA_SQL = ("CASE {s} WHEN 'quartzo' THEN 'quartzo' WHEN 'ametista' THEN 'ametista' WHEN 'topazio' THEN 'topazio' "
             "WHEN 'agata' THEN 'agata' WHEN 'incluir' THEN 'sem_pedra_fase_8_9' END")


@query("vocabulary_maps", B.with_ctes(B.RAW_SQL) + f"""
SELECT genero_raw, pedra_raw, turma_raw,
  coalesce(CASE WHEN {sql_slug('genero_raw')} IN ('menino','masculino','m') THEN 'M'
                WHEN {sql_slug('genero_raw')} IN ('menina','feminino','f') THEN 'F' END, 'NA') AS genero_na,
  CASE WHEN {sql_slug('genero_raw')} IN ('menino','masculino','m') THEN 'M'
       WHEN {sql_slug('genero_raw')} IN ('menina','feminino','f') THEN 'F' END AS genero_null,
  {PEDRA_SQL.format(s=sql_slug('pedra_raw'))} AS pedra,
  CASE WHEN trim(turma_raw) IN ('NAN', 'nan', '') THEN NULL ELSE trim(turma_raw) END AS turma,
  CASE WHEN upper(trim(genero_raw)) IN ('NAN', 'nan', '') THEN NULL ELSE upper(trim(genero_raw)) END AS genero_up,
  CAST(count(*) AS BIGINT) AS n
FROM raw_sheet GROUP BY ALL""", ids=("F7", "F8", "F9", "F10"))
def vocabulary_maps(spark, sf_dir):
    g, p, t = F.col("genero_raw"), F.col("pedra_raw"), F.col("turma_raw")
    return B.raw_sheet(spark, sf_dir).groupBy(
        "genero_raw", "pedra_raw", "turma_raw",
        C.gender(g).alias("genero_na"),
        C.gender(g, default=None).alias("genero_null"),
        C.vocabulary(p, C.PEDRA_VOCAB).alias("pedra"),
        T.null_tokens(t).alias("turma"),
        T.null_tokens(g, upper=True).alias("genero_up"),
    ).agg(F.count(F.lit(1)).alias("n"))


_NUM_RE = "^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$"


@query("numeric_date_coercion", B.with_ctes(B.RAW_SQL) + f"""
SELECT trim(ra_raw) AS ra, matem_raw,
  CASE WHEN regexp_matches(matem_raw, '{_NUM_RE}') THEN try_cast(trim(matem_raw) AS DOUBLE) END AS matem,
  CASE WHEN regexp_matches(replace(matem_raw, ',', '.'), '{_NUM_RE}')
       THEN try_cast(trim(replace(matem_raw, ',', '.')) AS DOUBLE) END AS matem_comma,
  CAST(round_even(ano_nasc_raw, 0) AS BIGINT) AS ano_nasc,
  CAST(CAST(try_strptime(data_nasc, '%d/%m/%Y') AS DATE) AS VARCHAR) AS data_nasc,
  CASE WHEN ano_base - year(try_strptime(data_nasc, '%d/%m/%Y')) BETWEEN 0 AND 120
       THEN ano_base - year(try_strptime(data_nasc, '%d/%m/%Y')) END AS idade_recomputed,
  coalesce(idade_raw, CAST(ano_base AS DOUBLE) - ano_nasc_raw) AS idade_filled
FROM raw_sheet""", ids=("F11", "F12", "F13", "F14", "F15"))
def numeric_date_coercion(spark, sf_dir):
    raw = B.raw_sheet(spark, sf_dir)
    born = C.day_first_date(F.col("data_nasc"))
    return raw.select(
        F.trim("ra_raw").alias("ra"), "matem_raw",
        C.to_number(F.col("matem_raw")).alias("matem"),
        C.to_number_comma(F.col("matem_raw")).alias("matem_comma"),
        C.round_half_even_int(F.col("ano_nasc_raw")).alias("ano_nasc"),
        born.cast("string").alias("data_nasc"),
        C.age_recomputed(F.col("ano_base"), F.year(born)).alias("idade_recomputed"),
        C.age_filled(F.col("idade_raw"), F.col("ano_base"), F.col("ano_nasc_raw")).alias("idade_filled"),
    )
