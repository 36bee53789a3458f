"""Policy and ranking metrics.

AUC, the ROC curve and the K trade-off all start from the same per-score table: ``groupBy(score)`` with positive and
negative counts (map-side combined). Running sums over ranges of that table (``ranking.running_sums``) give the
negatives ranked below every score — the tie-aware Mann–Whitney AUC — and every top-K cut, without ordering the scores
or a stratum in one task. Per-stratum variants run over the same ranges with the stratum as group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators.ranking import row_numbers, running_sums
from panelkit.operators.selection import quantiles
from panelkit.operators.topk import k_of, topk_flags
from panelkit.schema import DEFAULT, PanelSchema

DEFAULT_KS = (10, 15, 20, 25)


def _ratio(num: Column, den: Column, empty) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(empty).cast("double"))


def auc_table(df: DataFrame, score: str = "score", target: str = "target", by: list[str] | None = None,
              one_class: float | None = 0.5) -> DataFrame:
    """A10: tie-aware ROC AUC (Mann–Whitney with half credit for ties), optionally per group.

    One class only → ``one_class`` (0.5 in the evaluation module, None in the dashboard dialect)."""
    by = by or []
    y = F.col(target)
    per_score = df.groupBy(*by, score).agg(
        F.count_if(y == 1).alias("_pos"), F.count_if(y != 1).alias("_neg"))
    scored = running_sums(per_score, [F.col(score).asc_nulls_first()], {"_neg_below": F.col("_neg")}, by=by)
    agg = scored.groupBy(*by).agg(
        F.sum(F.col("_pos") * (F.col("_neg_below") + F.col("_neg") * 0.5)).alias("_u"),
        F.sum("_pos").alias("n_pos"),
        F.sum("_neg").alias("n_neg"),
    )
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                 F.col("_u") / (F.col("n_pos").cast("double") * F.col("n_neg"))).otherwise(
        F.lit(one_class).cast("double"))
    return agg.select(*by, auc.alias("auc"), F.col("n_pos").cast("bigint").alias("n_pos"),
                      (F.col("n_pos") + F.col("n_neg")).cast("bigint").alias("n"))


def confusion(df: DataFrame, alert: str, target: str, by: list[str] | None = None, k_pct: float | None = None,
              lift_empty=None) -> DataFrame:
    """Tp, fp, fn, recall, precision (0 when empty), base rate and lift (``lift_empty`` when the base rate
    is 0), optionally per group."""
    by = by or []
    a, y = F.col(alert).cast("int"), F.col(target).cast("int")
    agg = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(a).cast("bigint").alias("n_alert"),
        F.sum(y).cast("bigint").alias("n_pos"),
        F.count_if((a == 1) & (y == 1)).alias("tp"),
        F.count_if((a == 1) & (y == 0)).alias("fp"),
        F.count_if((a == 0) & (y == 1)).alias("fn"),
    )
    base = _ratio(F.col("n_pos"), F.col("n"), 0.0)
    prec = _ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0)
    rec = _ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0)
    out = agg.select(
        *by, "n", "n_alert", "n_pos", "tp", "fp", "fn",
        base.alias("base_rate"), rec.alias("recall_at_k"), prec.alias("precision_at_k"),
        F.when(base > 0, prec / base).otherwise(F.lit(lift_empty).cast("double")).alias("lift_at_k"),
    )
    if k_pct is not None:
        out = out.withColumn("k_pct", F.lit(float(k_pct)))
    return out


def operational_metrics(df: DataFrame, k_pct: float = 15.0, schema: PanelSchema = DEFAULT,
                        by_stratum: bool = False) -> DataFrame:
    """A7 (global numbers of the stratified policy) / A8 (the same per stratum)."""
    flagged = topk_flags(df, k_pct, schema.score, schema.stratum, schema.entity, schema.alert)
    by = [schema.stratum] if by_stratum else []
    return confusion(flagged, schema.alert, schema.target, by, k_pct)


def _clean_scores(df: DataFrame, score: str, target: str) -> DataFrame:
    """Evaluation inputs: null target → 0, null score → 0, score on the 0..1 scale."""
    return df.select(
        "*",
        (F.coalesce(F.col(score).cast("double"), F.lit(0.0)) / 100.0).alias("_s"),
        F.coalesce(F.col(target).cast("int"), F.lit(0)).alias("_y"),
    )


def global_topk_metrics(df: DataFrame, ks=DEFAULT_KS, score: str = "_s", target: str = "_y",
                        entity: str = "ra", lift_empty: float | None = 0.0) -> DataFrame:
    """W1 + W2 for several K at once (global, unstratified): one per-score table, one cumulative pass.

    For each K the top k rows are all rows above the boundary score plus the first ``slots`` of the boundary score
    by entity; positives among those slots need the tie group ranked, which only touches the boundary rows.
    """
    per_score = df.groupBy(score).agg(F.count(F.lit(1)).alias("_c"), F.sum(F.col(target)).alias("_p"))
    cum = running_sums(per_score, [F.col(score).desc_nulls_last()], {"_before": F.col("_c"), "_pos_before": F.col("_p")},
                       totals={"_n": "_before", "_npos": "_pos_before"})
    # every K cut from the same rows: each score row is paired with the (few) K values by an explode, not a join
    cuts = F.explode(F.array(*[F.struct(F.lit(float(k)).alias("k_pct"), k_of(F.col("_n"), k).alias("_k"))
                               for k in ks])).alias("_cut")
    exploded = cum.select("*", cuts).select("*", "_cut.k_pct", "_cut._k").drop("_cut")
    bounds = exploded.filter((F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_c") >= F.col("_k"))).select(
        "k_pct", F.col(score).alias("_bscore"), (F.col("_k") - F.col("_before")).alias("_slots"),
        F.col("_c").alias("_bc"), "_pos_before", F.col("_p").alias("_bp"), "_n", "_npos", "_k")
    # positives among the boundary slots: rank the boundary rows by entity (only those rows are touched)
    tie = df.join(F.broadcast(bounds.select("k_pct", "_bscore", "_slots", "_bc")),
                  F.col(score).eqNullSafe(F.col("_bscore")))  # ≤ len(ks) rows, bounded by construction
    cut_ties = tie.filter(F.col("_slots") < F.col("_bc")).select("k_pct", "_slots", entity, target)
    tie_pos = (row_numbers(cut_ties, [F.col(entity).asc()], "_rn", by=["k_pct"])
               .filter(F.col("_rn") <= F.col("_slots"))
               .groupBy("k_pct").agg(F.sum(F.col(target)).alias("_tp_tie")))
    j = bounds.join(tie_pos, "k_pct", "left")
    tp = F.col("_pos_before") + F.when(F.col("_slots") >= F.col("_bc"), F.col("_bp")).otherwise(
        F.coalesce(F.col("_tp_tie"), F.lit(0)))
    base = _ratio(F.col("_npos"), F.col("_n"), 0.0)
    prec = _ratio(tp, F.col("_k"), 0.0)
    return j.select(
        "k_pct",
        _ratio(tp, F.col("_npos"), 0.0).alias("recall"),
        prec.alias("precision"),
        F.when(base > 0, prec / base).otherwise(F.lit(lift_empty).cast("double")).alias("lift"),
        F.col("_k").cast("bigint").alias("n_alert"),
    )


def evaluate_overall(df: DataFrame, schema: PanelSchema = DEFAULT) -> DataFrame:
    """A9, one row: auc, n_total, n_positive, base_rate."""
    auc = auc_table(_clean_scores(df, schema.score, schema.target), "_s", "_y")
    return auc.select(F.col("auc"), F.col("n").alias("n_total"), F.col("n_pos").alias("n_positive"),
                      _ratio(F.col("n_pos"), F.col("n"), 0.0).alias("base_rate"))


def evaluate_per_k(df: DataFrame, schema: PanelSchema = DEFAULT, ks=DEFAULT_KS) -> DataFrame:
    """A9, one row for each K: recall / precision / lift of the global top-K."""
    return global_topk_metrics(_clean_scores(df, schema.score, schema.target), ks, entity=schema.entity)


def evaluate_by_stratum(df: DataFrame, schema: PanelSchema = DEFAULT) -> DataFrame:
    """A9, one row for each stratum (null stratum dropped): n, n_pos, auc, recall@15, precision@15."""
    strat = _clean_scores(df, schema.score, schema.target).filter(F.col(schema.stratum).isNotNull())
    s_auc = auc_table(strat, "_s", "_y", by=[schema.stratum])
    flagged = topk_flags(strat, 15.0, "_s", schema.stratum, schema.entity, "_a")
    s_conf = confusion(flagged, "_a", "_y", [schema.stratum])
    return s_auc.join(s_conf.select(schema.stratum, "recall_at_k", "precision_at_k"), schema.stratum).select(
        schema.stratum, "n", "n_pos", "auc", F.col("recall_at_k").alias("recall_top15"),
        F.col("precision_at_k").alias("precision_top15"))


def evaluate(df: DataFrame, schema: PanelSchema = DEFAULT, ks=DEFAULT_KS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(overall one-row table, per-K global table, per-stratum table); callers of one table use its function."""
    return evaluate_overall(df, schema), evaluate_per_k(df, schema, ks), evaluate_by_stratum(df, schema)


def roc_curve(df: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    """Cumulative true / false positives by descending score, on per-score aggregates."""
    per = df.groupBy(score).agg(F.count_if(F.col(target) == 1).alias("_p"), F.count_if(F.col(target) != 1).alias("_n"))
    cum = running_sums(per, [F.col(score).desc()], {"tp": F.col("_p"), "fp": F.col("_n")}, inclusive=True,
                       totals={"_tp": "tp", "_fp": "fp"})
    return cum.select(score, "tp", "fp", (F.col("tp") / F.col("_tp")).alias("tpr"), (F.col("fp") / F.col("_fp")).alias("fpr"))


def calibration(df: DataFrame, score: str = "score", target: str = "target", bins: int = 5,
                min_rows: int = 11) -> DataFrame:
    """Equal-width bins on [0, 1], every bin right-open (a score of exactly 1.0 falls in no bin); mean predicted
    score, positive rate and count per non-empty bin; nothing when fewer than ``min_rows`` valid rows."""
    edges = [i * (1.0 / bins) for i in range(bins + 1)]
    s = F.col(score).cast("double") / 100.0
    valid = df.filter(F.col(score).isNotNull() & F.col(target).isNotNull()).select(
        s.alias("_s"), F.col(target).cast("double").alias("_y"))
    b = None
    for i in range(bins):
        cond = (F.col("_s") >= F.lit(edges[i])) & (F.col("_s") < F.lit(edges[i + 1]))
        b = F.when(cond, F.lit(i)) if b is None else b.when(cond, F.lit(i))
    # per-bin aggregates first (≤ bins + 1 rows, the extra one holds out-of-range scores); the valid-row total is
    # taken over that tiny table, never over the rows themselves
    grouped = valid.withColumn("_b", b).groupBy("_b").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("rate"), F.avg("_s").alias("mean_pred"))
    grouped = grouped.withColumn("_total", F.sum("n").over(Window.partitionBy()))
    labels = F.create_map(*[x for i in range(bins) for x in (F.lit(i), F.lit(f"[{edges[i]:.1f}-{edges[i + 1]:.1f})"))])
    return (grouped.filter(F.col("_b").isNotNull() & (F.col("_total") >= min_rows))
            .select(labels[F.col("_b")].alias("bucket"), "n", "rate", "mean_pred"))


def alerts_by_stratum(flagged: DataFrame, stratum: str = "fase", alert: str = "alerta", score: str = "score",
                      entity: str = "ra") -> DataFrame:
    """Rows, alerts, mean score and alert percentage per stratum."""
    agg = flagged.groupBy(stratum).agg(
        F.count(F.col(entity)).alias("total"),
        F.sum(F.col(alert).cast("int")).cast("bigint").alias("alertas"),
        F.avg(score).alias("score_medio"))
    return agg.withColumn("pct_alerta", _ratio(100 * F.col("alertas"), F.col("total"), 0.0))


def score_summary(df: DataFrame, score: str = "score") -> DataFrame:
    """Mean, p90 and p99 of the non-null scores (exact, linear interpolation), 0 when there are none."""
    s = F.col(score).cast("double")
    found = quantiles(df.select(s.alias("_s")), ["_s"], [0.9, 0.99]).first()  # one row
    q = found.q if found else (0.0, 0.0)
    return df.agg(F.coalesce(F.avg(s), F.lit(0.0)).alias("score_mean")).select(
        "score_mean", F.lit(float(q[0])).alias("score_p90"), F.lit(float(q[1])).alias("score_p99"))
