"""Top-K% alert selection.

Stratified top-K% with a data-dependent k per stratum cannot use Spark's WindowGroupLimit, and a row_number over
(stratum) sorts whole strata in one task each (a handful of strata → a handful of tasks). The default plan here is a
*threshold selection*:

1. per stratum: n and k = max(1, ceil(n · K / 100)) — one small aggregate;
2. per (stratum, score): row counts — a hash aggregate with map-side combine;
3. running sums over ranges of that table find, per stratum, the boundary score and how many of the rows tied at it
   still fit — one row per stratum;
4. every row is compared with its stratum's boundary (a join against the per-stratum row); only rows tied exactly at
   the boundary score are ranked (entity id ascending, over ranges), everything above is in and everything below is
   out.

``method="row_number"`` keeps the direct window form for comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators.ranking import row_numbers, running_sums
from panelkit.schema import DEFAULT, PanelSchema
from panelkit.session import materialize

# boundary rows (one a stratum, some 100 bytes) that may be broadcast, after counting them; beyond it the join shuffles
BROADCAST_STRATA = 100_000


def k_of(n: Column, k_pct: float) -> Column:
    """W1 k = max(1, ceil(n · K / 100)) in double arithmetic (as a float multiply, not a decimal one)."""
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(n.cast("double") * F.lit(float(k_pct)) / F.lit(100.0)))


def topk_flags(
    df: DataFrame,
    k_pct: float,
    score: str = "score",
    stratum: str | None = "fase",
    entity: str = "ra",
    alert: str = "alerta",
    null_stratum: str = "group",
    null_scores: str = "last",
    as_bool: bool = False,
    method: str = "threshold",
) -> DataFrame:
    """Mark the top K% rows by score inside each stratum (stratum=None → one global group).

    null_stratum: "group" (null is a stratum of its own, W3) or "exclude" (rows with a null stratum are never
    alerted, W3b). null_scores: "last" (null scores rank after every score, W3) or "never" (null scores are neither
    counted nor alerted, W3b). Ties are broken by entity id ascending.
    """
    keys = [stratum] if stratum else []
    work = df
    if stratum is None:
        work = work.withColumn("_g", F.lit(0))
        keys = ["_g"]
    eligible = F.lit(True)
    if null_stratum == "exclude" and stratum:
        eligible = eligible & F.col(stratum).isNotNull()
    if null_scores == "never":
        eligible = eligible & F.col(score).isNotNull()
    work = work.withColumn("_elig", eligible)

    if method == "row_number":
        w = Window.partitionBy("_elig", *keys).orderBy(F.col(score).desc_nulls_last(), F.col(entity).asc())
        n = F.count(F.lit(1)).over(Window.partitionBy("_elig", *keys))
        flag = F.col("_elig") & (F.row_number().over(w) <= k_of(n, k_pct))
        out = work.withColumn(alert, flag)
    else:
        out = _threshold_flags(work, k_pct, score, keys, entity, alert)
    out = out.withColumn(alert, F.coalesce(F.col(alert), F.lit(False)))
    if not as_bool:
        out = out.withColumn(alert, F.col(alert).cast("int"))
    return out.drop("_elig", "_g")


def _threshold_flags(work: DataFrame, k_pct: float, score: str, keys: list[str], entity: str,
                     alert: str) -> DataFrame:
    elig = work.filter(F.col("_elig"))
    # (2) rows per (stratum, score); (1) is its sum per stratum
    per_score = elig.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_c"))
    cum = running_sums(per_score, [F.col(score).desc_nulls_last()], {"_before": F.col("_c")}, by=keys,
                       totals={"_n": "_before"})
    ranked = cum.withColumn("_k", k_of(F.col("_n"), k_pct))
    # (3) the boundary: the score group where the cumulative count first reaches k
    boundary = ranked.filter((F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_c") >= F.col("_k")))
    bounds = materialize(boundary.select(
        *[F.col(k).alias(f"_b_{k}") for k in keys],
        F.col(score).alias("_bscore"),
        (F.col("_k") - F.col("_before")).alias("_slots"),
        (F.col("_c") == F.col("_k") - F.col("_before")).alias("_whole"),
    ))
    side = F.broadcast(bounds) if bounds.count() <= BROADCAST_STRATA else bounds
    cond = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"_b_{k}"))
        cond = e if cond is None else cond & e
    marked = work.join(side, cond, "left")
    s = F.col(score)
    bs = F.col("_bscore")
    above = F.when(bs.isNull(), s.isNotNull()).otherwise(s > bs)
    tied = s.eqNullSafe(bs)
    # (4) only the rows sitting on the boundary score need an order; whole boundary groups are simply in
    pre = (
        F.when(~F.col("_elig"), F.lit(False))
        .when(above, F.lit(True))
        .when(tied & F.col("_whole"), F.lit(True))
        .when(tied, F.lit(None).cast("boolean"))
        .otherwise(F.lit(False))
    )
    flagged = marked.withColumn(alert, pre)
    settled = flagged.filter(F.col(alert).isNotNull())
    tie_rows = flagged.filter(F.col(alert).isNull())
    tie_rows = row_numbers(tie_rows, [F.col(entity).asc()], "_rn", by=keys)
    tie_rows = tie_rows.withColumn(alert, F.col("_rn") <= F.col("_slots")).drop("_rn")
    drop = [f"_b_{k}" for k in keys] + ["_bscore", "_slots", "_whole"]
    return settled.unionByName(tie_rows).drop(*drop)


def stratified_alerts(df: DataFrame, k_pct: float = 15.0, schema: PanelSchema = DEFAULT, **kw) -> DataFrame:
    """Stratified top-K% alert flag (int 0/1) on the schema's score / stratum / entity columns."""
    return topk_flags(df, k_pct, schema.score, schema.stratum, schema.entity, schema.alert, **kw)


def alert_list(df: DataFrame, k_pct: float = 15.0, schema: PanelSchema = DEFAULT) -> DataFrame:
    """Alerts flagged, ordered by stratum ascending, score descending (entity for a total order)."""
    return stratified_alerts(df, k_pct, schema).orderBy(
        F.col(schema.stratum).asc(), F.col(schema.score).desc(), F.col(schema.entity).asc())


def top_n_per_group(df: DataFrame, group: str, metric: str, n: int, tiebreak: str | None = None) -> DataFrame:
    """The n rows with the largest metric per group; a constant n lets Spark plan a WindowGroupLimit."""
    order = [F.col(metric).desc()] + ([F.col(tiebreak).asc()] if tiebreak else [])
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def top3_by_magnitude(names: Column, values: Column, k: int = 3) -> tuple[Column, Column]:
    """Per row, the k entries with the largest |value| (names and values), no shuffle."""
    zipped = F.arrays_zip(names.alias("n"), values.alias("v"))
    ordered = F.array_sort(
        zipped,
        lambda a, b: F.when(F.abs(a["v"]) > F.abs(b["v"]), -1).when(F.abs(a["v"]) < F.abs(b["v"]), 1).otherwise(0),
    )
    top = F.slice(ordered, 1, k)
    return F.transform(top, lambda e: e["n"]), F.transform(top, lambda e: e["v"])


def sample_per_stratum(df: DataFrame, stratum: str, entity: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows per stratum without replacement, seeded and deterministic.

    Rows are ordered by md5(entity:seed). Instead of sorting whole strata, the first 5 hex digits of the digest
    (2^20 buckets) are counted per (stratum, bucket); the bucket where the running count reaches n is the boundary;
    rows in earlier buckets are in, and only rows of the boundary bucket (about N / 2^20 of them) are ranked.
    """
    h = F.md5(F.concat(F.col(entity).cast("string"), F.lit(f":{seed}")))
    work = df.withColumn("_h", h).withColumn("_bk", F.conv(F.substring("_h", 1, 5), 16, 10).cast("bigint"))
    per = work.groupBy(stratum, "_bk").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(stratum).orderBy("_bk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumn("_before", F.sum("_c").over(run) - F.col("_c"))
    bound = per.filter((F.col("_before") < n) & (F.col("_before") + F.col("_c") >= n)).select(
        F.col(stratum).alias("_s"), F.col("_bk").alias("_bbk"), (F.lit(n) - F.col("_before")).alias("_slots"))
    marked = work.join(bound, F.col(stratum).eqNullSafe(F.col("_s")), "left")
    inside = marked.filter(F.col("_bbk").isNull() | (F.col("_bk") < F.col("_bbk")))
    edge = marked.filter(F.col("_bk") == F.col("_bbk"))
    w = Window.partitionBy(stratum).orderBy("_h")
    edge = edge.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= F.col("_slots"))
    cols = df.columns
    return inside.select(*cols).unionByName(edge.select(*cols))
