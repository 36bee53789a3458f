"""Exact running sums and ranks over a global order, one plan at every size.

A window ordered over a whole table (or a whole stratum) runs in one task. Here the rows are dealt into ranges of (group
keys, order keys) and the dealt table, each row with the number of its range, is written once to the shared checkpoint
folder: Spark samples the ranges' bounds a single time, and everything after reads the same ranges. Each range computes
its own running sums; a table of totals per group and range (at most groups + ranges rows, since a range is one
contiguous stretch of the order) supplies the offsets. A task handles about rows / ranges rows whatever the skew of the
groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.session import materialize


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] | None = None,
                 partitions: int | None = None, inclusive: bool = False, totals: dict[str, str] | None = None) -> DataFrame:
    """Add, for every name in ``sums``, the running total of its expression over ``order`` within ``by`` groups
    (exclusive of the current row unless ``inclusive``), and for every name in ``totals`` the group's total of the sum
    it names. ``order`` must be a total order inside each group; null groups are groups of their own."""
    by, totals = by or [], totals or {}
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    work = df.select("*", *[e.alias(f"_v_{k}") for k, e in sums.items()])
    dealt = work.repartitionByRange(n, *[F.col(b) for b in by], *order)
    ranged = materialize(dealt.withColumn("_pid", F.spark_partition_id()))
    frame = (Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    local_w = Window.partitionBy("_pid", *by).orderBy(*order).rowsBetween(*frame)
    zero = F.lit(0)
    local = ranged.select("*", *[F.coalesce(F.sum(f"_v_{k}").over(local_w), zero).alias(f"_l_{k}") for k in sums])
    parts = ranged.groupBy(*by, "_pid").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = parts.select(
        *[F.col(b).alias(f"_ob_{b}") for b in by], F.col("_pid").alias("_opid"),
        *[F.coalesce(F.sum(f"_t_{k}").over(before), zero).alias(f"_o_{k}") for k in sums],
        *[F.sum(f"_t_{k}").over(group).alias(f"_g_{name}") for name, k in totals.items()])
    cond = F.col("_pid") == F.col("_opid")
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"_ob_{b}"))
    return local.join(off, cond).select(
        *df.columns, *[(F.col(f"_l_{k}") + F.col(f"_o_{k}")).alias(k) for k in sums],
        *[F.col(f"_g_{name}").alias(name) for name in totals])


def row_numbers(df: DataFrame, order: list[Column], name: str, by: list[str] | None = None,
                partitions: int | None = None) -> DataFrame:
    """row_number() over (partition by ``by`` order by ``order``) without sorting any group in one task."""
    out = running_sums(df, order, {name: F.lit(1)}, by, partitions, inclusive=True)
    return out.withColumn(name, F.col(name).cast("int"))


def dense_ranks(df: DataFrame, order: list[str], name: str, by: str, partitions: int | None = None) -> DataFrame:
    """dense_rank() over (partition by ``by`` order by ``order``): the distinct order keys are numbered over ranges and
    joined back, so no group of values is ranked in one task."""
    keys = [by, *order]
    numbered = row_numbers(df.select(*keys).distinct(), [F.col(c).asc_nulls_first() for c in order], name, by=[by], partitions=partitions)
    numbered = numbered.select(*[F.col(c).alias(f"_d{i}") for i, c in enumerate(keys)], name)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_d{i}")) for i, c in enumerate(keys)])
    return df.join(numbered, same).drop(*[f"_d{i}" for i in range(len(keys))])


def running_pairs(df: DataFrame, by: str, order: str, value: str, partitions: int | None = None) -> DataFrame:
    """Add ``_previous``: the largest ``value`` of the rows before in ``order`` within ``by`` (null for the first), over
    ranges like :func:`running_sums`."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = materialize(df.repartitionByRange(n, by, order).withColumn("_pid", F.spark_partition_id()))
    local = F.max(value).over(Window.partitionBy("_pid", by).orderBy(order, value).rowsBetween(Window.unboundedPreceding, -1))
    parts = ranged.groupBy(F.col(by).alias("_by"), F.col("_pid").alias("_part")).agg(F.max(value).alias("_m"))
    parts = parts.select("_by", "_part", F.max("_m").over(Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
    joined = ranged.withColumn("_local", local).join(parts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_pid") == F.col("_part")))
    return joined.select(*df.columns, F.greatest("_local", "_earlier").alias("_previous"))
