"""Stratum (school-phase) expressions: F3 strict int, F4 label, F5 sort key (two dialects), F6 lenient int."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _up(c: Column) -> Column:
    return F.upper(F.trim(c.cast("string")))


def _first_int(c: Column) -> Column:
    digits = F.regexp_extract(c, r"(\d+)", 1)
    return F.when(digits == "", F.lit(None)).otherwise(digits.try_cast("bigint"))


def stratum_int(c: Column) -> Column:
    """null → null; 'ALFA' → 0; first digit run when it is 0..9, else null ('12' → null)."""
    u = _up(c)
    n = _first_int(u)
    return (
        F.when(c.isNull(), F.lit(None))
        .when(u == "ALFA", F.lit(0))
        .when(n.between(0, 9), n)
        .otherwise(F.lit(None))
        .cast("int")
    )


def stratum_int_lenient(c: Column, numeric_input: bool = False) -> Column:
    """like F3 without the 0..9 cap; numeric input passes through unchanged."""
    if numeric_input:
        return c.cast("bigint")
    u = F.upper(c.cast("string"))
    return F.when(F.trim(u) == "ALFA", F.lit(0).cast("bigint")).otherwise(_first_int(u))


def stratum_label(c: Column) -> Column:
    """null → 'UNKNOWN'; 'ALFA'; 'FASE <n>' → 'FASEn'; all digits → 'ALFA' for 0 else 'FASEn';
    leading digit → 'FASE' + that first character's digit; anything else upper-cased as is."""
    u = _up(c)
    fase_digits = F.regexp_extract(u, r"(\d+)", 1)
    return (
        F.when(c.isNull(), F.lit("UNKNOWN"))
        .when(u == "ALFA", F.lit("ALFA"))
        .when(u.startswith("FASE") & (fase_digits != ""),
              F.concat(F.lit("FASE"), fase_digits.try_cast("bigint").cast("string")))
        .when(u.rlike(r"^[0-9]+$"),
              F.when(u.try_cast("bigint") == 0, F.lit("ALFA"))
              .otherwise(F.concat(F.lit("FASE"), u.try_cast("bigint").cast("string"))))
        .when(u.rlike(r"^[0-9]"), F.concat(F.lit("FASE"), F.substring(u, 1, 1)))
        .otherwise(u)
    )


def stratum_sort_key(c: Column, dialect: str = "full") -> Column:
    """'ALFA','F0','FASE0','0' → 0; else the first whitespace/underscore token that is all digits, 'FASE<n>' or
    (full dialect only) 'F<n>'; else 99. The 'reduced' dialect checks an all-digit value first and has no 'F<n>'."""
    u = _up(c)
    spaced = F.trim(F.regexp_replace(u, "_", " "))
    tokens = F.split(spaced, r"\s+")

    def tok_val(t: Column) -> Column:
        as_int = F.when(t.rlike(r"^[0-9]+$"), t.try_cast("bigint"))
        fase = F.when(t.rlike(r"^FASE[0-9]+$"), F.substring(t, 5, 1000).try_cast("bigint"))
        if dialect == "full":
            f_n = F.when(t.rlike(r"^F[0-9]+$"), F.substring(t, 2, 1000).try_cast("bigint"))
            return F.coalesce(as_int, fase, f_n)
        return F.coalesce(as_int, fase)

    firsts = F.filter(F.transform(tokens, tok_val), lambda v: v.isNotNull())
    first_hit = F.when(F.size(firsts) > 0, F.element_at(firsts, 1))
    if dialect == "full":
        tail = F.when(u.rlike(r"^[0-9]+$"), u.try_cast("bigint"))
        found = F.coalesce(first_hit, tail)
    else:
        found = F.coalesce(F.when(u.rlike(r"^[0-9]+$"), u.try_cast("bigint")), first_hit)
    return (
        F.when(u.isin("ALFA", "F0", "FASE0", "0"), F.lit(0).cast("bigint"))
        .otherwise(F.coalesce(found, F.lit(99).cast("bigint")))
    )
