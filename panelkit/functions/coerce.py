"""Value coercion expressions: vocabularies (F7–F9), numbers (F11–F13), dates and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelkit.functions.text import slug

# Fixed values that must equal the reference for right results: the gender vocabulary and the 'pedra' vocabulary.
GENDER_MALE = ("menino", "masculino", "m")
GENDER_FEMALE = ("menina", "feminino", "f")
PEDRA_VOCAB = {
    "quartzo": "quartzo",
    "ametista": "ametista",
    "topazio": "topazio",
    "agata": "agata",
    "incluir": "sem_pedra_fase_8_9",
}

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def gender(c: Column, default: str | None = "NA") -> Column:
    """F7 (default 'NA', null input also 'NA') and F8 (default=None: null stays null, unknown → null)."""
    s = slug(c.cast("string"))
    mapped = F.when(s.isin(*GENDER_MALE), F.lit("M")).when(s.isin(*GENDER_FEMALE), F.lit("F"))
    if default is None:
        return mapped
    return F.coalesce(mapped, F.lit(default))


def vocabulary(c: Column, vocab: dict[str, str]) -> Column:
    """slug the value and look it up in a small fixed vocabulary map; unknown or empty → null."""
    m = F.create_map(*[F.lit(x) for kv in vocab.items() for x in kv])
    s = slug(c.cast("string"))
    return F.when(s == "", F.lit(None)).otherwise(F.try_element_at(m, s))


def to_number(c: Column) -> Column:
    """strings that are plain decimal / scientific numbers become doubles, anything else (comma decimals,
    Java-only suffixes such as '7.5d') becomes null. Numeric input is cast."""
    s = c.cast("string")
    return F.when(s.rlike(_NUMBER), F.trim(s).try_cast("double"))


def to_number_comma(c: Column) -> Column:
    """decimal comma accepted: ',' → '.', trim, then F11."""
    return to_number(F.regexp_replace(c.cast("string"), ",", "."))


def round_half_even_int(c: Column) -> Column:
    """Python-style round (half to even) to an integer."""
    return F.bround(c, 0).cast("bigint")


def day_first_date(c: Column) -> Column:
    """dates and timestamps as they are, day-first text ('01/06/2005', '1-6-2005', with or without a time) and
    ISO text ('2005-06-01', '2005-06-01 00:00:00') → date; unparseable → null."""
    day = F.regexp_extract(F.trim(c.cast("string")), r"^([0-9/.\-]+)(?:[ T].*)?$", 1)
    iso = F.when(day.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), day.try_cast("date"))
    first = F.regexp_replace(day, r"[.\-]", "/")
    return F.coalesce(iso, F.try_to_timestamp(F.when(first.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), first), F.lit("d/M/yyyy")).cast("date"))


def age_recomputed(period: Column, birth_year: Column) -> Column:
    """F15, recompute policy: period − birth year, kept only inside [0, 120]."""
    a = period.cast("bigint") - birth_year.cast("bigint")
    return F.when(a.between(0, 120), a)


def age_filled(age: Column, period: Column, birth_year: Column) -> Column:
    """F15, fill policy: keep the given age, fill period − birth year only where it is missing (no clamp)."""
    return F.coalesce(age.cast("double"), period.cast("double") - birth_year.cast("double"))
