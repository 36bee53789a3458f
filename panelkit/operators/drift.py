"""Score drift: fixed-edge histograms, PSI in two dialects, per-bin contributions, drift summaries overall and per
stratum (A11–A17, J5, F26).

Plan: both score sets are tagged with a side and stacked; ONE ``groupBy(side, stratum)`` aggregate (map-side
combined) yields rows, mean, population std and the ten bin counts of every side and stratum. Everything after that
works on ≤ 2 × strata rows. Nothing proportional to the data leaves the executors. Bin counts are additive, so a
trailing N-day window is a sum of daily counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 10
# Histogram edges on [0, 1]: i / 10 computed as i * 0.1, exactly as an evenly spaced edge array is (0.3, 0.6 and 0.7
# are then 0.30000000000000004, 0.6000000000000001, 0.7000000000000001; this is why width_bucket is not used).
EDGES = [i * (1.0 / BINS) for i in range(BINS + 1)]
EPS_CLIP = 1e-6


def bin_index(x: Column, edges: list[float] = EDGES, last_closed: bool = True) -> Column:
    """Bin of x for the given edges; [e_i, e_i+1) except the last bin, which is closed. Out of range → null."""
    n = len(edges) - 1
    expr = None
    for i in range(n):
        hi_ok = (x <= F.lit(edges[i + 1])) if (last_closed and i == n - 1) else (x < F.lit(edges[i + 1]))
        cond = (x >= F.lit(edges[i])) & hi_ok
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def severity(psi: Column, threshold: float = 0.2) -> Column:
    """F26 (drift): < 0.1 ok, < threshold warning, else critical."""
    return F.when(psi < 0.1, F.lit("ok")).when(psi < threshold, F.lit("warning")).otherwise(F.lit("critical"))


def _stack(baseline: DataFrame, current: DataFrame, score: str, stratum: str | None) -> DataFrame:
    cols = [F.col(score).cast("double").alias("_x")]
    if stratum:
        cols.append(F.col(stratum).cast("string").alias("_st"))
    else:
        cols.append(F.lit("__all__").alias("_st"))
    b = baseline.select(F.lit("b").alias("_side"), *cols)
    c = current.select(F.lit("c").alias("_side"), *cols)
    return b.unionByName(c)


def side_histograms(baseline: DataFrame, current: DataFrame, score: str = "score", stratum: str | None = None,
                    clip: bool = False) -> DataFrame:
    """One row per (side, stratum): rows, non-null rows, mean, population std and the 10 bin counts h0..h9, from ONE
    aggregate over the stacked sides (partial aggregation keeps the shuffle at ≤ 2 × strata rows per task).

    clip=True clips scores into [0, 1] first (smoothed dialect); otherwise out-of-range scores get no bin but still
    count in the side's total (the reference dialect divides by all rows)."""
    x = F.col("_x")
    if clip:
        x = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    stacked = _stack(baseline, current, score, stratum).withColumn("_x", x).withColumn("_bin", bin_index(F.col("_x")))
    return stacked.groupBy("_side", "_st").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.col("_x")).alias("nn"),
        F.avg("_x").alias("mean"),
        F.stddev_pop("_x").alias("std"),
        *[F.count_if(F.col("_bin") == i).alias(f"h{i}") for i in range(BINS)],
    )


def _sides(h: DataFrame) -> DataFrame:
    """Baseline and current rows of each stratum side by side (a join of two tiny per-stratum tables).
    Strata missing on one side get zeros there."""
    cols = ["n", "nn", "mean", "std"] + [f"h{i}" for i in range(BINS)]
    b = h.filter(F.col("_side") == "b").select("_st", *[F.col(c).alias(f"b_{c}") for c in cols])
    c = h.filter(F.col("_side") == "c").select("_st", *[F.col(c).alias(f"c_{c}") for c in cols])
    j = b.join(c, "_st", "full")
    zero = [f"{s}_{c}" for s in ("b", "c") for c in cols if c not in ("mean", "std")]
    return j.fillna(0, zero)


def _psi_expr(dialect: str, min_rows: int) -> Column:
    nb, nc = F.col("b_n"), F.col("c_n")
    if dialect == "smooth":
        sb = sum(F.col(f"b_h{i}") for i in range(BINS))
        sc = sum(F.col(f"c_h{i}") for i in range(BINS))
        terms = []
        for i in range(BINS):
            pb = (F.col(f"b_h{i}") + 1e-6) / (sb + 1e-6)
            pc = (F.col(f"c_h{i}") + 1e-6) / (sc + 1e-6)
            terms.append((pc - pb) * F.log((pc + 1e-10) / (pb + 1e-10)))
        return F.when((nb < min_rows) | (nc < min_rows), F.lit(0.0)).otherwise(F.greatest(sum(terms), F.lit(0.0)))
    terms = []
    for i in range(BINS):
        pb = F.greatest(F.col(f"b_h{i}") / nb, F.lit(EPS_CLIP))
        pc = F.greatest(F.col(f"c_h{i}") / nc, F.lit(EPS_CLIP))
        terms.append((pc - pb) * F.log(pc / pb))
    return F.when((nb == 0) | (nc == 0), F.lit(0.0)).otherwise(sum(terms))


def psi_table(baseline: DataFrame, current: DataFrame, score: str = "score", stratum: str | None = None,
              dialect: str = "clip", min_rows: int = 10) -> DataFrame:
    """PSI per stratum (one row with stratum '__all__' when ``stratum`` is None).

    dialect="clip": proportions = bin count / all rows of the side, clipped below at 1e-6; Σ (c − b)·ln(c / b);
    0 when either side is empty.
    dialect="smooth": scores clipped into [0, 1]; proportions (n + 1e-6) / (N + 1e-6); Σ (c − b)·ln((c + 1e-10) /
    (b + 1e-10)); 0 when either side has fewer than ``min_rows`` rows; never below 0.
    """
    j = _sides(side_histograms(baseline, current, score, stratum, clip=(dialect == "smooth")))
    return j.select(F.col("_st").alias("stratum"), _psi_expr(dialect, min_rows).alias("psi"),
                    F.col("b_n").cast("bigint").alias("n_baseline"), F.col("c_n").cast("bigint").alias("n_current"))


def psi_contributions(baseline: DataFrame, current: DataFrame, score: str = "score") -> DataFrame:
    """Smoothed-dialect contribution of each bin, negative parts cut to 0, labelled '[0.0,0.1)'; one row per
    bin, unpivoted from the single per-side row."""
    j = _sides(side_histograms(baseline, current, score, None, clip=True))
    sb = sum(F.col(f"b_h{i}") for i in range(BINS))
    sc = sum(F.col(f"c_h{i}") for i in range(BINS))
    rows = []
    for i in range(BINS):
        pb = (F.col(f"b_h{i}") + 1e-6) / (sb + 1e-6)
        pc = (F.col(f"c_h{i}") + 1e-6) / (sc + 1e-6)
        contrib = F.greatest((pc - pb) * F.log((pc + 1e-10) / (pb + 1e-10)), F.lit(0.0))
        rows.append(F.struct(F.lit(f"[{EDGES[i]:.1f},{EDGES[i + 1]:.1f})").alias("name"), pb.alias("baseline_pct"),
                             pc.alias("current_pct"), contrib.alias("contrib")))
    return j.select(F.inline(F.array(*rows)))


def drift_summary(baseline: DataFrame, current: DataFrame, score: str = "score", stratum: str | None = None,
                  threshold: float = 0.2, min_per_side: int = 0, digits: int = 4) -> DataFrame:
    """A15 (stratum=None) / A16 (per stratum): PSI, severity, drift flag, means and population stds of both sides,
    counts, status. Per stratum, only strata present on both sides with at least ``min_per_side`` rows each (J5).
    Values are rounded half-to-even to ``digits``."""
    j = _sides(side_histograms(baseline, current, score, stratum))
    if stratum:
        j = j.filter((F.col("b_n") >= max(min_per_side, 1)) & (F.col("c_n") >= max(min_per_side, 1)))
    p = _psi_expr("clip", 10)
    return j.select(
        F.col("_st").alias(stratum or "scope"),
        F.bround(p, digits).alias("psi"),
        F.lit(float(threshold)).alias("threshold"),
        (p >= threshold).alias("drift_detected"),
        severity(p, threshold).alias("severity"),
        F.bround(F.coalesce("b_mean", F.lit(0.0)), digits).alias("baseline_mean"),
        F.bround(F.coalesce("c_mean", F.lit(0.0)), digits).alias("current_mean"),
        F.bround(F.coalesce("b_std", F.lit(0.0)), digits).alias("baseline_std"),
        F.bround(F.coalesce("c_std", F.lit(0.0)), digits).alias("current_std"),
        F.col("b_n").cast("bigint").alias("n_baseline"),
        F.col("c_n").cast("bigint").alias("n_current"),
        F.when(p >= threshold, F.lit("drift_detected")).otherwise(F.lit("ok")).alias("status"),
    )


def stratum_drift(baseline: DataFrame, current: DataFrame, score: str = "score", stratum: str = "fase",
                  threshold: float = 0.2) -> DataFrame:
    """A16 + J5: per-stratum drift for strata with ≥ 5 rows on both sides (caller orders by psi desc)."""
    return drift_summary(baseline, current, score, stratum, threshold, min_per_side=5)


def baseline_snapshot(baseline: DataFrame, score: str = "score", stratum: str = "fase") -> DataFrame:
    """The baseline against itself per stratum (PSI 0) for strata with ≥ 5 rows."""
    return drift_summary(baseline, baseline, score, stratum, min_per_side=5)


def with_scale(df: DataFrame, score: str = "score", factor: float = 0.01) -> DataFrame:
    """Scores on 0..100 → 0..1 (the drift functions work on probabilities)."""
    return df.withColumn(score, F.col(score).cast("double") * factor)


def drift_report(mode: str, valid: DataFrame | None = None, train: DataFrame | None = None,
                 baseline: DataFrame | None = None, current: DataFrame | None = None, score: str = "score",
                 stratum: str | None = "fase", threshold: float = 0.2) -> tuple[DataFrame | None, DataFrame | None]:
    """T4: one entry point for the three drift modes; returns (summary, per-stratum) or (None, None) when there is no
    current data ('no_current_data').

    internal: the validation scores against themselves; oot: training scores (baseline) against validation scores;
    prod: a frozen baseline against production scores already restricted to the trailing window (S6)."""
    if mode == "internal":
        base, cur = valid, valid
    elif mode == "oot":
        base, cur = train, valid
    elif mode == "prod":
        base, cur = baseline, current
    else:
        raise ValueError(f"unknown drift mode {mode!r}")
    if cur is None or base is None or cur.filter(F.col(score).isNotNull()).limit(1).count() == 0:
        return None, None
    b = base.filter(F.col(score).isNotNull())
    c = cur.filter(F.col(score).isNotNull())
    per = stratum_drift(b, c, score, stratum, threshold) if stratum else None
    return drift_summary(b, c, score, None, threshold), per
