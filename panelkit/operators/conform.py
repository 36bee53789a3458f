"""Per-period conformance (S2, P11 and the notebook clean-up steps), each one projection over the period table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions import coerce as C
from panelkit.functions import names as N
from panelkit.functions.strata import stratum_int
from panelkit.functions.text import null_tokens

# Fixed values that must equal the reference: the columns a period sheet must have, and which of them are numbers.
SHEET_REQUIRED = ["ra", "ano_base", "fase_raw", "turma", "defasagem", "matem", "portug", "ingles", "ieg", "iaa", "ips",
                  "ipp", "genero", "instituicao", "escola", "ano_ingresso", "ano_nasc", "idade"]
SHEET_NUMERIC = ["defasagem", "matem", "portug", "ingles", "ieg", "iaa", "ips", "ipp", "ano_ingresso", "ano_nasc",
                 "idade"]
MUST_HAVE = ["ra", "ano_base", "fase_raw", "turma", "defasagem", "matem", "portug", "ingles", "ieg", "iaa", "ips",
             "ipp", "genero", "instituicao", "ano_ingresso"]
OTHER_NUMERIC = ["defasagem", "matem", "portug", "ingles", "ieg", "iaa", "ips", "ipp", "ano_ingresso", "no_av"]


def _num(df: DataFrame, c: str):
    t = dict(df.dtypes)[c]
    return C.to_number(F.col(c)) if t == "string" else F.col(c).cast("double")


def conform_sheet(df: DataFrame, period, period_col: str = "ano_base") -> DataFrame:
    """Normalised alias rename (P3) → period column → required back-fill (P6) → trimmed id → stratum as int
    (F3) → gender with 'NA' default (F7) → numeric coercion (F11) → age filled from birth year only where missing
    (F15 fill policy). ``period`` is an int (one sheet per period) or a Column (a sheet holding several)."""
    df = N.canonicalize_columns(df)
    df = df.withColumn(period_col, (period if isinstance(period, Column) else F.lit(int(period))).cast("int"))
    df = N.backfill(df, {c: ("string" if c in ("ra", "fase_raw", "turma", "genero", "instituicao", "escola")
                             else "double") for c in SHEET_REQUIRED})
    repl = {
        "ra": F.trim(F.col("ra").cast("string")),
        "genero": C.gender(F.col("genero")),
        **{c: _num(df, c) for c in SHEET_NUMERIC},
    }
    repl["idade"] = C.age_filled(_num(df, "idade"), F.col(period_col), _num(df, "ano_nasc"))
    out = df.select(*[repl.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns],
                    stratum_int(F.col("fase_raw")).alias("fase"))
    return out


def standardize(df: DataFrame, period, period_col: str = "ano_base") -> DataFrame:
    """Literal renames (P4) then type coercion and clean-up: id trimmed, stratum text upper-cased with null
    tokens removed, day-first birth date, birth year (overridden by the date's year), age recomputed and clamped to
    [0, 120], numeric coercion, text clean-up (F10); key columns first (P10)."""
    df = N.apply_literal_renames(df)
    df = df.withColumn(period_col, (period if isinstance(period, Column) else F.lit(int(period))).cast("int"))
    df = N.backfill(df, {c: ("string" if c in ("ra", "fase_raw", "turma", "genero", "instituicao") else "double")
                         for c in MUST_HAVE})
    repl = {"ra": F.trim(F.col("ra").cast("string"))}
    fase = null_tokens(F.upper(F.col("fase_raw").cast("string")))
    born = C.day_first_date(F.col("data_nasc")) if "data_nasc" in df.columns else None
    birth = (F.bround(_num(df, "ano_nasc"), 0).cast("bigint") if "ano_nasc" in df.columns
             else F.lit(None).cast("bigint"))
    if born is not None:
        birth = F.coalesce(F.year(born).cast("bigint"), birth)
        repl["data_nasc"] = born
    repl["ano_nasc"] = birth
    for c in OTHER_NUMERIC:
        if c in df.columns:
            repl[c] = _num(df, c)
    for c, up in (("turma", False), ("genero", True), ("instituicao", False)):
        if c in df.columns:
            repl[c] = null_tokens(F.col(c).cast("string"), upper=up)
    cols = [repl.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns if c not in ("ano_nasc", "idade", "fase")]
    extra = [fase.alias("fase"), birth.alias("ano_nasc"), C.age_recomputed(F.col(period_col), birth).alias("idade")]
    out = df.select(*cols, *extra)
    front = MUST_HAVE + ["fase", "data_nasc", "ano_nasc", "idade", "no_av"]
    return N.reorder(out, front)


def normalize_text_fields(df: DataFrame) -> DataFrame:
    """Notebook step: gender → M/F (null otherwise, F8), stone → canonical value (F9), stratum → int."""
    repl = {}
    if "genero" in df.columns:
        repl["genero"] = C.gender(F.col("genero"), default=None)
    if "pedra" in df.columns:
        repl["pedra"] = C.vocabulary(F.col("pedra"), C.PEDRA_VOCAB)
    if "fase" in df.columns:
        repl["fase"] = stratum_int(F.col("fase"))
    return df.select(*[repl.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def normalize_dtypes(df: DataFrame) -> DataFrame:
    """Notebook step: integer columns rounded half-to-even (F13), marks parsed with decimal commas."""
    repl = {}
    if "ra" in df.columns:
        repl["ra"] = F.trim(F.col("ra").cast("string"))
    for c in ("ano_nasc", "idade", "ano_ingresso", "fase", "no_av", "defasagem"):
        if c in df.columns:
            repl[c] = C.round_half_even_int(_num(df, c))
    for c in ("ieg", "iaa", "ips", "ipp", "matem", "portug", "ingles"):
        if c in df.columns:
            repl[c] = C.to_number_comma(F.col(c))
    return df.select(*[repl.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def ensure_inde_pedra(df: DataFrame, period_col: str = "ano_base") -> DataFrame:
    """P8 + P9: the row's own-period 'inde' and 'pedra' columns, then the per-year columns dropped."""
    out = df.select("*", N.period_pick(df, "inde", period_col).alias("inde"),
                    N.period_pick(df, "pedra", period_col).alias("pedra"))
    return N.drop_annual(out)
