"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Targets. Sources by code point, null last, weigh 1, 2, 3, repeating. They share the words of the whole corpus by weight;
no target exceeds three times its source. The shares of the others grow until none is above its limit, so every target
is the lesser of its limit and its weight times one common level. Sources sorted by limit over weight reach their limit
in that order; prefix sums over this order (one row a source) give the level.

Copies. Every document of a source is expected ``target / source size`` times (at most three). Along the source,
ordered by size, these expectations are summed up; one random offset is added, and a document is emitted once for each
integer that its own step crosses. Neighbours have similar sizes, so the words taken stay near the target.

Ranks along a source come from cells (source, size class, salt): cells are counted first, their prefix sums place each
cell, and a window ranks rows inside a cell alone. Size classes are an eighth of an octave. The number of salts grows
with the table, so a source or a group of equal documents of any share is ranked in cells of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkit.llm.common import WORD, col, fresh, written

WEIGHTS = 3
LIMIT = 3
SEED = "mix"
#: Salts of a size class: this many, and one more for each ROWS_PER_SALT rows of the table.
SALTS, ROWS_PER_SALT = 64, 500_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(text: Column, digits: int) -> Column:
    """The first hex digits of a text's MD5, as a number."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def _size_class(size: Column) -> Column:
    """Order-preserving class: the number of bits and the three bits after the first."""
    bits = F.length(F.bin(size))
    return bits * 16 + F.floor((size * 8) / F.pow(F.lit(2.0), bits - 1)).cast("int")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, key, n) -> ``key, source_size, target, rate, offset``: one row a source, ordered and summed
    in windows over the sources."""
    by_source = sizes.groupBy("source", "key").agg(F.sum("n").cast("long").alias("source_size"))
    named = by_source.withColumn("w", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % WEIGHTS + 1)
    order = Window.orderBy(F.col("source_size") / F.col("w"), "key")
    so_far, everywhere = order.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    summed = named.select(
        "*", F.coalesce(F.sum("source_size").over(so_far), zero).alias("s_before"), F.coalesce(F.sum("w").over(so_far), zero).alias("w_before"),
        F.sum("source_size").over(everywhere).alias("s_all"), F.sum("w").over(everywhere).alias("w_all"),
    )
    # level if all sources before this one stand at their limit: (left) / (w_left)
    left, w_left = F.col("s_all") - LIMIT * F.col("s_before"), F.col("w_all") - F.col("w_before")
    flagged = summed.select("*", left.alias("left"), w_left.alias("w_left"), (LIMIT * F.col("source_size") * w_left <= F.col("w") * left).alias("full"))
    # the first source below its limit fixes the level for itself and all after it
    first = F.struct(F.col("source_size") / F.col("w"), F.col("key"), F.col("left"), F.col("w_left"))
    level = F.min(F.when(~F.col("full"), first)).over(everywhere)
    limit = (LIMIT * F.col("source_size")).cast("double")
    target = F.when(F.col("full") | level.isNull(), limit).otherwise(F.least(limit, F.col("w") * level["left"] / level["w_left"]))
    out = flagged.select("key", "source_size", target.cast("double").alias("target"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return out.select("*", rate.alias("rate"), (_hash(F.concat(F.lit(SEED), F.col("key")), 4) / 65536.0).alias("offset"))


def mix(rows: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` (row: any struct, doc_id, source, size, tie) with ``source_size, target, copies``; ``tie`` orders
    documents of one size."""
    salts = SALTS + n_rows // ROWS_PER_SALT
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("!"))
    celled = rows.select("*", key.alias("key"), _size_class(F.col("size")).alias("class"), (F.conv(F.substring("tie", 1, 8), 16, 10).cast("long") % salts).alias("salt"))
    cells = celled.groupBy("source", "key", "class", "salt").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("n"))
    cells = written(cells, "cells")
    zero = F.lit(0).cast("long")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    classes = cells.groupBy("key", "class").agg(F.sum("rows").alias("class_rows"))
    classes = classes.select("key", "class", F.coalesce(F.sum("class_rows").over(earlier(Window.partitionBy("key").orderBy("class"))), zero).alias("class_base"))
    inside = cells.select("key", "class", "salt", F.coalesce(F.sum("rows").over(earlier(Window.partitionBy("key", "class").orderBy("salt"))), zero).alias("salt_base"))
    bases = inside.join(classes, ["key", "class"]).join(source_targets(cells), "key")
    bases = bases.select("key", "class", "salt", (F.col("class_base") + F.col("salt_base")).alias("base"), "source_size", "target", "rate", "offset")
    nth = F.row_number().over(Window.partitionBy("key", "class", "salt").orderBy("size", "tie", F.col("doc_id").asc_nulls_last()))
    ranked = celled.join(bases, ["key", "class", "salt"]).withColumn("k", F.col("base") + nth)
    crossed = F.floor(F.col("offset") + F.col("k") * F.col("rate")) - F.floor(F.col("offset") + (F.col("k") - 1) * F.col("rate"))
    return ranked.withColumn("copies", F.least(crossed, F.lit(LIMIT).cast("long")).cast("int"))


def _tie(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row.

    Null texts have size 0. Null sources are one source, the last. Repeated rows are documents of their own. An empty
    table gives no rows; a source without words has target 0 and takes nothing. Other columns are ignored. The
    offsets and the order come from hashes, so reruns agree.
    """
    text = col(text_col).cast("string")
    slim = docs.select(col(id_col).cast("long").alias("doc_id"), col(source_col).cast("string").alias("source"), word_count(text).alias("size"), _tie(col(id_col), text).alias("tie"))
    slim = written(slim, "sizes")
    mixed = mix(slim, slim.count())
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it (not at all, up to three times).

    Null and empty texts have size 0 and stand where their source's smallest do; null sources are one source. Repeated rows
    are documents of their own, null ids come last among equals, extra columns are carried along. An empty table stays
    empty. Texts of any length move whole with their row."""
    text = col(text_col).cast("string")
    rows = docs.select(F.struct("*").alias("row"), col(id_col).cast("long").alias("doc_id"), col(source_col).cast("string").alias("source"), word_count(text).alias("size"), _tie(col(id_col), text).alias("tie"))
    mixed = mix(rows, docs.count())
    times = fresh(docs, "copy")
    return mixed.where("copies > 0").select("row.*", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias(times)).drop(times)


#: The same rows in DuckDB.
SQL = f"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS tie,
    coalesce('=' || source, '!') AS key
  FROM documents
), celled AS (
  SELECT *, CAST('0x' || substr(tie, 1, 8) AS BIGINT) % ({SALTS} + (SELECT count(*) FROM base) // {ROWS_PER_SALT}) AS salt,
    length(bin(size)) * 16 + ((CAST(size AS BIGINT) * 8) >> (length(bin(size)) - 1)::INTEGER) AS class
  FROM base
), sources AS (
  SELECT source, key, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {WEIGHTS} + 1 AS w
  FROM base GROUP BY source, key
), summed AS (
  SELECT *, CAST(sum(source_size) OVER () - {LIMIT} * coalesce(sum(source_size) OVER before, 0) AS BIGINT) AS rest,
    CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS BIGINT) AS w_rest
  FROM sources
  WINDOW before AS (ORDER BY source_size / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT rest, w_rest FROM summed WHERE {LIMIT} * source_size * w_rest > w * rest ORDER BY source_size / w, key LIMIT 1
), targets AS (
  SELECT key, source_size, coalesce(
      CASE WHEN {LIMIT} * source_size * w_rest > w * rest
        THEN least(CAST({LIMIT} * source_size AS DOUBLE), w * (SELECT rest FROM level) / (SELECT w_rest FROM level)) END,
      CAST({LIMIT} * source_size AS DOUBLE)) AS target,
    CAST('0x' || substr(md5('{SEED}' || key), 1, 4) AS BIGINT) / 65536.0::DOUBLE AS shift
  FROM summed
), ranked AS (
  SELECT c.*, t.source_size, t.target, t.shift,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    row_number() OVER (PARTITION BY c.key ORDER BY class, salt, size, tie, doc_id ASC NULLS LAST) AS k
  FROM celled c JOIN targets t ON c.key = t.key
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * least(floor(shift + k * rate) - floor(shift + (k - 1) * rate), {LIMIT}) AS BIGINT) AS taken
FROM ranked
"""
