"""Text column expressions: accent folding (F1), value slugs (F2 / P1, P2 dialect), null tokens.

All of these are native Catalyst expressions (translate / regexp_replace / lower / trim), so they stay inside
whole-stage codegen. The accent table is derived from Unicode data by rule at import time.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Characters whose canonical decomposition is one base letter plus combining marks, mapped to that letter,
    followed by the combining marks themselves (which ``translate`` deletes, having no counterpart)."""
    src, dst = [], []
    ranges = list(range(0x00C0, 0x0250)) + list(range(0x1E00, 0x1F00))
    for cp in ranges:
        ch = chr(cp)
        nfd = unicodedata.normalize("NFD", ch)
        if len(nfd) < 2:
            continue
        base, marks = nfd[0], nfd[1:]
        if all(unicodedata.combining(m) for m in marks) and not unicodedata.combining(base):
            src.append(ch)
            dst.append(base)
    drop = [chr(cp) for cp in range(0x0300, 0x0370)]
    return "".join(src) + "".join(drop), "".join(dst)


ACCENT_SRC, ACCENT_DST = _accent_table()


def strip_accents(c: Column) -> Column:
    """remove diacritics (canonical decomposition minus combining marks) as one native ``translate``."""
    return F.translate(c, ACCENT_SRC, ACCENT_DST)


# The characters that part words in a value, as a class, and those a word is made of.
VALUE_SEPARATORS, VALUE_CHARS = r"\s/\-.,()\[\]{}_", "a-z0-9"


def slug(c: Column) -> Column:
    """F2 / P1 applied to values: the words of the folded lower-case text, joined by one underscore. What neither parts
    words nor belongs to one vanishes without parting."""
    kept = F.regexp_replace(F.lower(strip_accents(c)), f"[^{VALUE_CHARS}{VALUE_SEPARATORS}]", "")
    return F.array_join(F.regexp_extract_all(kept, F.lit(f"[{VALUE_CHARS}]+"), F.lit(0)), "_")


def slug_ascii(c: Column) -> Column:
    """P2 dialect: drop every non-ASCII character after folding, lower, trim, any run outside [a-z0-9] → '_'."""
    s = F.regexp_replace(strip_accents(c), r"[^\x00-\x7F]", "")
    s = F.regexp_replace(F.lower(F.trim(s)), r"[^a-z0-9]+", "_")
    return F.regexp_replace(s, r"^_+|_+$", "")


NULL_TOKENS = ("NAN", "nan", "")


def null_tokens(c: Column, upper: bool = False) -> Column:
    """trim; the tokens NAN / nan / empty become null; optionally upper-case (as for gender)."""
    s = F.trim(c)
    if upper:
        s = F.upper(s)
    return F.when(s.isin(*NULL_TOKENS), F.lit(None)).otherwise(s)


# ---- the same normalisers for column *names* (driver-side metadata, not data) --------------------------------------
# The characters that separate words in a name, and those that a normalised name may hold.
NAME_SEPARATORS = frozenset("/-.,()[]{}_")
NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _plain(name: str) -> str:
    """Compatibility decomposition without combining marks, lower-cased."""
    return "".join(ch for ch in unicodedata.normalize("NFKD", str(name)) if not unicodedata.combining(ch)).lower()


def _words(chars, separates) -> str:
    """Runs of permitted characters, joined by one underscore; what neither separates nor is permitted vanishes."""
    kept = ("_" if separates(ch) else ch for ch in chars if separates(ch) or ch in NAME_CHARS)
    return "_".join(w for w in "".join(kept).split("_") if w)


def name_slug(name: str) -> str:
    """P1 for a column name: white space and separators part words, other characters are dropped."""
    return _words(_plain(name), lambda ch: ch in NAME_SEPARATORS or ch.isspace())


def name_slug_ascii(name: str) -> str:
    """P2 for a column name: characters outside ASCII are dropped, all others part words."""
    return _words(filter(str.isascii, _plain(name)), lambda ch: ch not in NAME_CHARS)


# ---- full compatibility folding -------------------------------------------------------------------------------------
#: Expansions up to this length are built by one ``translate`` for each place; the longer ones are few.
PLACES = 3


def _full_tables() -> tuple[str, str, list[str], dict[str, str], str]:
    """For every code point whose compatibility decomposition without combining marks differs from it: those with at
    most one character left (source and target of one ``translate``, what vanishes last), the places of those with two or
    three, the longer ones, and the character class of all that expand."""
    one, none, some, longer = [], [], [], {}
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        plain = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if plain == ch:
            continue
        if len(plain) == 1:
            one.append((ch, plain))
        elif not plain:
            none.append(ch)
        elif len(plain) <= PLACES:
            some.append((ch, plain))
        else:
            longer[ch] = plain
    places = ["".join(p[i] if i < len(p) else "" for _, p in sorted(some, key=lambda t: -len(t[1]))) for i in range(PLACES)]
    some.sort(key=lambda t: -len(t[1]))  # ``translate`` deletes what has no counterpart: the short ones come last
    expands = sorted({ord(c) for c, _ in some} | {ord(c) for c in longer})
    runs: list[list[int]] = []
    for cp in expands:
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    chars = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"
    return "".join(c for c, _ in one) + "".join(none), "".join(p for _, p in one), ["".join(c for c, _ in some), *places], longer, chars


_FULL = None


def strip_accents_full(c: Column) -> Column:
    """F1, full form: compatibility decomposition (NFKD) without combining marks for every code point, as native
    expressions. One ``translate`` folds what has one character left, or none; only texts that hold a character with more
    (ligatures, fractions, Hangul syllables and the like) are taken apart into characters, whose first, second and third
    characters come from a ``translate`` each and the few longer ones from replacements."""
    global _FULL
    _FULL = _FULL or _full_tables()
    src, dst, (some, *places), longer, chars = _FULL

    def expanded(ch: Column) -> Column:
        return F.when(ch.rlike(chars), F.concat(*[F.translate(ch, some, p) for p in places])).otherwise(ch)

    whole = c
    for k, v in longer.items():
        whole = F.replace(whole, F.lit(k), F.lit(v))
    taken = F.array_join(F.transform(F.split(whole, ""), expanded), "")
    return F.translate(F.when(c.rlike(chars), taken).otherwise(c), src, dst)
