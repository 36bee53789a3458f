"""Quality rules, lines first.

Every line with a word is judged on its own: punctuation, navigation, boilerplate. Failing lines are removed; a document
that loses more than ``MOST_LOST`` of its words is rejected, as is one that fails the base rules (too few words, too many
words in repeated three-word windows). One pass over whole texts without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import arrow_rows, col, fresh

MIN_WORDS = 50
#: Most words in repeated windows, and most words lost with their lines, in percent.
MOST_REPEATED, MOST_LOST = 50, 30

# Fixed values of the line rules.
SYMBOLS = b"#*$%&|<>"
SEPARATORS = ("|", "/", ">", "-", "–", "—", "•", "·", "»", "›", "::")
NAVIGATION = ("home", "menu", "login", "logout", "register", "search", "next", "previous", "back", "top", "share", "print", "contact", "about", "sitemap", "archive", "archives", "tags", "categories")
PHRASES = (
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "use cookies", "uses cookies", "enable javascript", "lorem ipsum", "click here", "subscribe to", "sign up for", "powered by", "copyright ©",
)

_TERMINAL = re.compile("[.!?…。！？][\"')\\]»”’]*\\Z")
_INSIDE = re.compile("[.!?…。！？,;:]")
_SEPARATORS = frozenset(s.encode() for s in SEPARATORS)
_NAVIGATION = frozenset(s.encode() for s in NAVIGATION)
_PHRASES = tuple(p.encode() for p in PHRASES)
_SPACES = " \t\n\x0b\x0c\r"
_EDGE = b".,;:!?|"
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_LOWER = bytes(b for b in range(256) if not 97 <= b <= 122)


def line_fails(line: bytes, words: list[bytes]) -> str | None:
    """The rule that a line breaks, if any. ``words`` is not empty."""
    n = len(words)
    last = words[-1].decode()
    if not _TERMINAL.search(last) and (n < 10 or not _INSIDE.search(line.decode())):
        return "punctuation"  # neither ends a sentence nor looks like part of running text
    if 2 * (len(line) - len(line.translate(None, SYMBOLS))) > n or 2 * (line.count(b"!") + line.count(b"?")) > n + 2:
        return "punctuation"
    if 5 * sum(map(_SEPARATORS.__contains__, words)) >= n:
        return "navigation"
    if n <= 12 and 2 * sum(w.strip(_EDGE).lower() in _NAVIGATION for w in words) > n:
        return "navigation"
    if n >= 4 and len(line.translate(None, _NOT_UPPER)) > len(line.translate(None, _NOT_LOWER)):
        return "boilerplate"  # shouted banners
    if n >= 10 and 3 * len(set(words)) < n:
        return "boilerplate"  # filler
    low = line.lower()
    if any(p in low for p in _PHRASES):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    size = len(codes)
    pairs = ids[:-1] * size + ids[1:]
    if size >= 2_000_000:  # keep the product inside 63 bits
        _, pairs = np.unique(pairs, return_inverse=True)
        size = max(size, int(pairs.max()) + 1)
    windows = pairs[:-1] * size + ids[2:] if size < 2_000_000 else np.unique(np.column_stack([pairs[:-1], ids[2:]]), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : k + n - 2] |= twice
    return int(cover.sum())


@dataclass
class Judged:
    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    base_failed: bool = True
    kept: bool = False
    kept_words: int = 0
    cleaned: str | None = None


def judge(text: str | None) -> Judged:
    """All figures of a text and the text without its failing lines."""
    if text is None:
        return Judged()
    data = text.encode()
    words: list[bytes] = []
    good, seen = [], set()
    dups = lost = 0
    for line in data.split(b"\n"):
        own = line.split()
        if not own:
            good.append(line)
            continue
        words += own
        if line in seen:
            dups += 1
            lost += len(own)
            continue
        seen.add(line)
        if line_fails(line, own):
            lost += len(own)
        else:
            good.append(line)
    n = len(words)
    repeated = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeated > MOST_REPEATED * n
    return Judged(
        n, len(text) - sum(text.count(c) for c in _SPACES), len(data) - len(data.translate(None, SYMBOLS)), dups, repeated,
        failed, not failed and 100 * lost <= MOST_LOST * n, n - lost, text if not lost else b"\n".join(good).decode(),
    )


_FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, kept_words long"


def _judged(fields: str, names: list[str]):
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    kinds = [arrow[f.strip().split(" ")[1]] for f in fields.split(",")]

    def judged(texts: pa.Array) -> pa.Array:
        rows = [judge(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([getattr(r, n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    judged.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(judged, fields)


def quality_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the base figures, ``base_failed``, ``kept`` and ``kept_words`` of every row.

    Null and empty texts have no words and fail. Null ids and repeated rows are kept as rows. An empty table gives no
    rows. Other columns are ignored. Texts of any length are judged whole.
    """
    arrow_rows(docs.sparkSession, 2000)
    names = [f.strip().split(" ")[0] for f in _FIGURES.split(",")]
    slim = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return slim.select("doc_id", _judged(_FIGURES, names)("text").alias("j")).select("doc_id", "j.*")


def cleaned_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without rejected rows, and without the failing lines of the others. Where lines went, a long column
    ``n_chars`` is set to the new length; all other values stay.

    Null and empty texts are rejected. Null ids, repeated rows and extra columns, clashing names included, are kept as they
    are; an empty table stays empty. Texts of any length are judged whole, row by row."""
    arrow_rows(docs.sparkSession, 2000)
    j = fresh(docs, "judged")
    judged = docs.withColumn(j, _judged("kept boolean, cleaned string", ["kept", "cleaned"])(col(text_col).cast("string"))).where(F.col(f"{j}.kept"))
    out = []
    for c, kind in docs.dtypes:
        if c == text_col:
            out.append(F.col(f"{j}.cleaned").alias(c))
        elif c == "n_chars" and kind == "bigint":
            same = F.col(f"{j}.cleaned") == col(text_col)
            out.append(F.when(same, col(c)).otherwise(F.length(F.col(f"{j}.cleaned")).cast("long")).alias(c))
        else:
            out.append(col(c))
    return judged.select(*out)


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: The same figures in DuckDB.
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
lines AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs WHERE text IS NOT NULL
), split AS (
  SELECT *, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS w, row_number() OVER (PARTITION BY rid, line ORDER BY i) > 1 AS dup FROM lines
), judged AS (
  SELECT *, len(w) AS n,
    dup
    OR (NOT regexp_matches(w[-1], '[.!?…。！？]["'')\\]»”’]*$') AND (len(w) < 10 OR NOT regexp_matches(line, '[.!?…。！？,;:]')))
    OR 2 * length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > len(w)
    OR 2 * length(regexp_replace(line, '[^!?]', '', 'g')) > len(w) + 2
    OR 5 * len(list_filter(w, lambda x: list_contains({_sql_list(SEPARATORS)}, x))) >= len(w)
    OR (len(w) <= 12 AND 2 * len(list_filter(w, lambda x: list_contains({_sql_list(NAVIGATION)}, lower(trim(x, '.,;:!?|'))))) > len(w))
    OR (len(w) >= 4 AND length(regexp_replace(line, '[^A-Z]', '', 'g')) > length(regexp_replace(line, '[^a-z]', '', 'g')))
    OR (len(w) >= 10 AND 3 * len(list_distinct(w)) < len(w))
    OR len(list_filter({_sql_list(PHRASES)}, lambda p: contains(lower(line), p))) > 0 AS fails
  FROM split WHERE len(w) > 0
), by_line AS (
  SELECT rid, CAST(sum(CAST(dup AS INT)) AS BIGINT) AS n_dup_lines, CAST(sum(CASE WHEN fails THEN 0 ELSE n END) AS BIGINT) AS kept_words FROM judged GROUP BY rid
), words AS (
  SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs)
), windows AS (
  SELECT rid, p, word, lead(word, 1) OVER t AS b, lead(word, 2) OVER t AS c FROM words WINDOW t AS (PARTITION BY rid ORDER BY p)
), twice AS (
  SELECT rid, p, word, c IS NOT NULL AND count(*) OVER (PARTITION BY rid, word, b, c) > 1 AS again FROM windows
), covered AS (
  SELECT rid, word, bool_or(again) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inside FROM twice
), by_word AS (
  SELECT rid, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars, CAST(sum(CAST(inside AS INT)) AS BIGINT) AS n_repeat_words FROM covered GROUP BY rid
), figures AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(kept_words, 0) AS kept_words
  FROM docs LEFT JOIN by_line USING (rid) LEFT JOIN by_word USING (rid)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * (n_words - kept_words) <= {MOST_LOST} * n_words AS kept
FROM figures
"""
