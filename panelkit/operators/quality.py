"""Data-quality checks (A5 reuse, A6, A19, A20, J8, U5).

IQR outliers need the quartiles before the count, so they take two passes: the first returns the exact quartiles
(driver-sized: 2 numbers per column), the second counts rows outside the fences with those literals.
Unseen categories are a ``left_anti`` join of (column, value) pairs, distinct on both sides before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators.selection import quantiles

NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint")


def numeric_cols(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


def string_cols(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


def iqr_outliers(df: DataFrame, cols: list[str] | None = None, max_cols: int | None = None) -> DataFrame:
    """Per numeric column (all, or the first ``max_cols``) count values strictly outside [q1 − 1.5·IQR,
    q3 + 1.5·IQR]; a column needs ≥ 4 values and IQR > 0. One row per column; quartiles are exact at every size."""
    cols = (cols or numeric_cols(df))[:max_cols]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, n_outliers bigint")
    wide = df.agg(*[c.alias(f"o{i}") for i, c in enumerate(_outlier_counts(df, cols))])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"o{i}").alias("n_outliers"))
                                          for i, c in enumerate(cols)])))


def _outlier_counts(df: DataFrame, cols: list[str]) -> list[Column]:
    """An aggregate for each column; the quartiles inside are numbers of ``df``."""
    q = {r["column"]: r for r in quantiles(df, cols, [0.25, 0.75]).collect()} if cols else {}  # one row a column
    counts = []
    for c in cols:
        qs = q[c].q if c in q else None
        if qs is None or q[c].n < 4 or qs[1] - qs[0] <= 0:
            counts.append(F.sum(F.lit(0).cast("bigint")))
            continue
        lo, hi = qs[0] - 1.5 * (qs[1] - qs[0]), qs[1] + 1.5 * (qs[1] - qs[0])
        x = F.col(c).cast("double")
        counts.append(F.count_if((x < F.lit(lo)) | (x > F.lit(hi))))
    return [F.coalesce(c, F.lit(0).cast("bigint")) for c in counts]


def unseen_categories(current: DataFrame, train: DataFrame, cols: list[str] | None = None,
                      max_cols: int | None = None) -> DataFrame:
    """Per string column that also exists in train (all, or the first ``max_cols`` of them), the number of distinct
    non-null current values never seen in train."""
    cols = [c for c in (cols or string_cols(current)) if c in train.columns][:max_cols]
    if not cols:
        return current.sparkSession.createDataFrame([], "column string, n_new bigint")

    def long(df: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
        return df.select(F.inline(pairs)).filter(F.col("value").isNotNull()).distinct()

    new = long(current).join(long(train), ["column", "value"], "left_anti")
    return new.groupBy("column").agg(F.count(F.lit(1)).alias("n_new"))


def quality_card(current: DataFrame, train: DataFrame, outlier_cols: int | None = None,
                 category_cols: int | None = None) -> DataFrame:
    """Missing percentage over numeric columns, IQR outliers (all numeric columns or the first ``outlier_cols``),
    new categories (all string columns or the first ``category_cols``), row and numeric-column counts — one row. After the quartiles, one aggregate gives all counts of
    ``current``; the new categories are the other."""
    nums = numeric_cols(current)
    outliers = sum(_outlier_counts(current, nums[:outlier_cols]), F.lit(0).cast("bigint"))
    nulls = sum((F.count_if(F.col(c).isNull()) for c in nums), F.lit(0))
    rows = F.count(F.lit(1))
    pct = F.when((rows > 0) & F.lit(len(nums) > 0), nulls * 100.0 / (rows * F.lit(max(1, len(nums))))).otherwise(0.0)
    card = current.agg(pct.alias("pct_missing"), outliers.alias("n_outliers"), rows.alias("n_rows"))
    new = unseen_categories(current, train, max_cols=category_cols).agg(F.coalesce(F.sum("n_new"), F.lit(0)).alias("n_newcats"))
    one = F.lit(1).alias("_one")  # the two one-row tables meet on a constant
    return card.select("*", one).join(new.select("*", one), "_one").select(
        "pct_missing", F.col("n_outliers").cast("bigint").alias("n_outliers"), F.col("n_newcats").cast("bigint").alias("n_newcats"),
        F.col("n_rows").cast("bigint").alias("n_rows"), F.lit(len(nums)).alias("n_numeric_cols"))


def key_sanity(df: DataFrame, keys: list[str], target: str | None = None) -> DataFrame:
    """Rows, distinct keys, keys that occur more than once, and the number of target classes (one row, from
    two one-row aggregates)."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    k = per_key.agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("_c") > 1).alias("n_dup_keys"),
                    F.sum("_c").alias("n_rows")).first()
    n_classes = df.agg(F.countDistinct(F.col(target))).first()[0] if target else None
    return df.sparkSession.createDataFrame(
        [(int(k["n_rows"] or 0), int(k["n_keys"]), int(k["n_dup_keys"]), n_classes)],
        "n_rows bigint, n_keys bigint, n_dup_keys bigint, n_classes bigint")


def schema_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns present on one side only, with the side (schema-level metadata, no data is read)."""
    only_a = sorted(set(a.columns) - set(b.columns))
    only_b = sorted(set(b.columns) - set(a.columns))
    rows = [(c, "left") for c in only_a] + [(c, "right") for c in only_b]
    return a.sparkSession.createDataFrame(rows, "column string, side string")
