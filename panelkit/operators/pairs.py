"""Longitudinal pairing: each period joined to the entity's next period, labelled by whether the state got worse.

Plan shape (J1, default): dedup per (entity, period) with a hash aggregate (map-side partial aggregation, so a hot
duplicated key is combined before the shuffle) → one window partitioned by entity ordered by period (after the dedup an
entity holds at most one row per period, so no window partition can grow with the data) → the next *available* period
comes from the tiny distinct-period table. No self-join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.schema import DEFAULT, PanelSchema

_NEXT = "_next_period"
_LAST = "_last_period"


def clean_entity(df: DataFrame, schema: PanelSchema = DEFAULT) -> DataFrame:
    """Trim string ids and drop null ids (null ids must not join to each other)."""
    e = schema.entity
    col = F.col(e)
    if dict(df.dtypes)[e] == "string":
        col = F.trim(col)
        col = F.when(col == "", None).otherwise(col)
    return df.withColumn(e, col).filter(F.col(e).isNotNull())


def dedup_first(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with a deterministic choice (smallest remaining row), via a hash aggregate.

    ``min(struct(...))`` is combined map-side, so a key holding a third of all rows is reduced inside every map task
    before anything is shuffled; no group is ever collected into one task.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    picked = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def period_table(df: DataFrame, schema: PanelSchema = DEFAULT) -> DataFrame:
    """Distinct periods with the next available period, the last period and the period rank.

    The table has one row per distinct period (a handful of years), so the un-partitioned window below runs on a
    few rows; it stays lazy so it is computed inside the jobs that use it, and joins against it are turned into
    broadcast joins by AQE from the measured size.
    """
    p = schema.period
    periods = df.select(p).filter(F.col(p).isNotNull()).distinct()
    w = Window.orderBy(p)
    return periods.select(
        p,
        F.lead(p).over(w).alias(_NEXT),
        F.max(p).over(Window.partitionBy()).alias(_LAST),
        F.dense_rank().over(w).alias("_prank"),
    )


def require_periods(df: DataFrame, schema: PanelSchema = DEFAULT, minimum: int = 3,
                    periods: DataFrame | None = None) -> int:
    """Raise when fewer than ``minimum`` periods exist (a temporal split needs train pairs and one valid pair)."""
    n = (periods if periods is not None else period_table(df, schema)).count()
    if n < minimum:
        raise ValueError(f"at least {minimum} periods are needed for a temporal split, found {n}")
    return n


def pair_label(a: Column, b: Column) -> Column:
    """F33 label ``"t->t+1"``."""
    return F.concat(a.cast("string"), F.lit("->"), b.cast("string"))


def worse_target(state_t: Column, state_t1: Column) -> Column:
    """F33 target: 1 when the state rises; a null on either side gives 0."""
    return F.coalesce((state_t1 > state_t).cast("int"), F.lit(0))


def build_pairs(
    panel: DataFrame,
    schema: PanelSchema = DEFAULT,
    adjacency: str = "available",
    dedup: bool = True,
) -> DataFrame:
    """Pair each (entity, period) row with the entity's next period.

    adjacency="available": the next period is the next one present anywhere in the panel (gaps allowed, J1).
    adjacency="consecutive": the next period must be exactly period + 1 (J2).
    dedup=False keeps duplicate (entity, period) rows and fans them out like an inner join would (parity with the
    unguarded reference behaviour); it uses a self-join instead of the window.
    """
    e, p, s = schema.entity, schema.period, schema.state
    df = clean_entity(panel, schema)
    periods = period_table(df, schema).select(p, _NEXT)
    if dedup:
        df = dedup_first(df, [e, p])
        w = Window.partitionBy(e).orderBy(p)
        nxt = df.withColumn("_np", F.lead(p).over(w)).withColumn(schema.state_t1, F.lead(s).over(w))
        if adjacency == "consecutive":
            out = nxt.filter(F.col("_np") == F.col(p) + 1)
        else:
            out = nxt.join(periods, p).filter(F.col("_np") == F.col(_NEXT)).drop(_NEXT)
    else:
        right = df.select(F.col(e).alias("_e1"), F.col(p).alias("_np"), F.col(s).alias(schema.state_t1))
        left = df if adjacency == "consecutive" else df.join(periods, p)
        step = (F.col(p) + 1) if adjacency == "consecutive" else F.col(_NEXT)
        out = left.join(right, (F.col(e) == F.col("_e1")) & (F.col("_np") == step), "inner").drop("_e1")
        if adjacency != "consecutive":
            out = out.drop(_NEXT)
    out = out.withColumnRenamed(s, schema.state_t)
    return out.select(
        *[c for c in out.columns if c not in ("_np", schema.state_t1)],
        schema.state_t1,
        worse_target(F.col(schema.state_t), F.col(schema.state_t1)).alias(schema.target),
        pair_label(F.col(p), F.col("_np")).alias(schema.pair_label),
    )


def temporal_split(pairs: DataFrame, panel: DataFrame, schema: PanelSchema = DEFAULT, check: bool = True):
    """U4: the latest adjacent pair is validation, every earlier pair is training. Returns (train, valid).

    The latest pair is the one whose base period is the second-to-last available period; it is found by joining the
    tiny period table, never by collecting rows.
    """
    p = schema.period
    periods = period_table(clean_entity(panel, schema), schema)
    if check:
        require_periods(panel, schema, periods=periods)
    tagged = pairs.join(periods.select(p, _NEXT, _LAST), p)
    is_valid = F.col(_NEXT) == F.col(_LAST)
    cols = pairs.columns
    return tagged.filter(~is_valid).select(*cols), tagged.filter(is_valid).select(*cols)


def base_rate_by_pair(pairs: DataFrame, schema: PanelSchema = DEFAULT) -> DataFrame:
    """A2: rows, positives and positive rate per pair label."""
    t = F.col(schema.target)
    return pairs.groupBy(schema.pair_label).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(t).cast("bigint").alias("n_pos"),
        F.avg(t.cast("double")).alias("base_rate"),
    )


def cohort_summary(panel: DataFrame, pairs: DataFrame, schema: PanelSchema = DEFAULT) -> DataFrame:
    """A3: per adjacent period pair, raw rows of the base period, on-track rows (state == 0), matched pairs, pairs
    used and positives. Pairs with no matches keep a row with zeros."""
    p, s = schema.period, schema.state
    df = panel  # raw counts cover every row of the period table, ids or not
    raw = df.groupBy(p).agg(
        F.count(F.lit(1)).alias("raw_total"),
        F.count_if(F.col(s) == 0).alias("eligible_ontrack"),
    )
    periods = period_table(df, schema).filter(F.col(_NEXT).isNotNull()).select(p, F.col(_NEXT).alias("ano_previsto"))
    matched = pairs.groupBy(schema.pair_label).agg(
        F.count(F.lit(1)).alias("matched_next_year"),
        F.sum(F.col(schema.target)).cast("bigint").alias("n_target_1"),
    )
    base = periods.join(raw, p).withColumn(schema.pair_label, pair_label(F.col(p), F.col("ano_previsto")))
    out = base.join(matched, schema.pair_label, "left")
    return out.select(
        F.col(p).alias("ano_base"),
        "ano_previsto",
        F.col("raw_total").cast("bigint").alias("raw_total"),
        F.col("eligible_ontrack").cast("bigint").alias("eligible_ontrack"),
        F.coalesce("matched_next_year", F.lit(0)).cast("bigint").alias("matched_next_year"),
        F.coalesce("matched_next_year", F.lit(0)).cast("bigint").alias("used_in_model"),
        F.coalesce("n_target_1", F.lit(0)).cast("bigint").alias("n_target_1"),
    )


def population_state_split(panel: DataFrame, schema: PanelSchema = DEFAULT) -> DataFrame:
    """Per period, rows with state < 0, == 0 and > 0."""
    s = F.col(schema.state)
    return panel.groupBy(schema.period).agg(
        F.count_if(s < 0).cast("bigint").alias("n_ahead"),
        F.count_if(s == 0).cast("bigint").alias("n_ontrack"),
        F.count_if(s > 0).cast("bigint").alias("n_lagging"),
    )
