"""Group-relative features fitted on past periods only.

fit:   base columns → three grouped aggregates (group, stratum, global) of mean / sample std / p25 / p75 for six
       variables, each level computed in ONE aggregate (all 24 statistics in a single pass).
apply: left joins of the three small lookup tables on null-safe keys (the lookups are materialised once and
       joined many times; AQE broadcasts them from their measured size), hierarchical fallback group → stratum →
       global, deltas, guarded z-scores, below-quartile flags, column selection, all-null drop and fills.

Everything is one wide ``select`` per stage — no ``withColumn`` loops — to keep the analysed plan flat.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators.selection import quantiles

from panelkit.functions.strata import stratum_int_lenient
from panelkit.schema import DEFAULT, PanelSchema

EPS = 1e-6
# Fixed values that must equal the reference: strata without an English exam, the categorical features, the
# variables with group statistics and the statistic names.
NO_ENGLISH_STRATA = (0, 1, 2, 8)
CAT_FEATURES = ("fase", "turma", "genero", "instituicao")
GROUP_VARS = ("media_provas", "matem", "portug", "ieg", "ips", "iaa")
STATS = ("mean", "std", "_p25", "_p75")
LEVELS = ("turma", "fase", "global")
BELOW_P25_VARS = ("media_provas", "matem", "ieg")
DERIVED_PREFIXES = ("turma_", "fase_", "global_", "delta_", "z_", "abaixo_p25_")
MISSING_CATEGORY = "MISSING_CATEGORY"


def stat_name(level: str, stat: str, var: str) -> str:
    return f"{level}_{stat}_{var}"


# ------------------------------------------------------------------------------------------------ base columns
def row_mean_std(cols: list[Column]) -> tuple[Column, Column]:
    """F16: mean and population std over the non-null values of a row; std is 0 when no value is present."""
    n = sum(c.isNotNull().cast("int") for c in cols)
    total = sum(F.coalesce(c, F.lit(0.0)) for c in cols)
    mean = F.when(n > 0, total / n)
    sq = sum(F.when(c.isNotNull(), (c - mean) * (c - mean)).otherwise(F.lit(0.0)) for c in cols)
    std = F.coalesce(F.when(n > 0, F.sqrt(sq / n)), F.lit(0.0))
    return mean, std


def base_columns(df: DataFrame, schema: PanelSchema = DEFAULT, numeric_stratum: bool = True) -> DataFrame:
    """Exam mean / dispersion, presence flags, tenure, participation, stratum as int, no-English strata
    neutralised (after the mean, so English still counts in it), state one-hots. One projection."""
    exams = [F.col(c) for c in schema.exam_cols]
    mean, std = row_mean_std(exams)
    eng = schema.exam_cols[-1]
    stratum = stratum_int_lenient(F.col(schema.stratum), numeric_input=numeric_stratum)
    no_eng = stratum.isin(*NO_ENGLISH_STRATA)
    st = F.col(schema.state_t) if schema.state_t in df.columns else F.lit(None)
    d = F.coalesce(st.cast("double"), F.lit(0.0))
    iaa = F.col("iaa") if "iaa" in df.columns else F.lit(None).cast("double")
    replaced = {
        schema.stratum: stratum,
        eng: F.when(no_eng, F.lit(None).cast("double")).otherwise(F.col(eng)),
        "iaa": F.coalesce(iaa.cast("double"), F.lit(0.0)),
        schema.state_t: d,
    }
    added = {
        "fez_ingles": F.when(no_eng, F.lit(0)).otherwise(F.col(eng).isNotNull().cast("int")),
        "media_provas": mean,
        "disp_provas": std,
        "tempo_casa": F.col(schema.period).cast("double") - F.col(schema.start_col).cast("double"),
        "iaa_participou": iaa.isNotNull().cast("int"),
        f"{schema.state_t}_is0": (d == 0).cast("int"),
        f"{schema.state_t}_bin_1": (d == 1).cast("int"),
        f"{schema.state_t}_bin_2plus": (d >= 2).cast("int"),
    }
    if "ipp" not in df.columns:
        added["ipp"] = F.lit(None).cast("double")
    cols = [replaced.get(c, F.col(c)).alias(c) for c in df.columns if c not in added]
    return df.select(*cols, *[v.alias(k) for k, v in added.items()])


# ------------------------------------------------------------------------------------------------ lookup
@dataclass
class Lookup:
    """The fitted state: three statistic tables, their keys, the all-null columns, the training medians and rows."""

    tables: dict[str, DataFrame]
    keys: dict[str, list[str]]
    all_null_cols: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    combined: DataFrame | None = None
    rows: int = 0


def _level_stats(df: DataFrame, keys: list[str] | None, level: str, grouping=None) -> DataFrame:
    """A1: mean, deviation and exact quartiles of the group variables per ``keys``, or per grouping set."""
    if grouping is not None:
        sets, all_keys = grouping
        levels = F.array(*[F.struct(F.lit(_grouping_id(all_keys, s)).cast("bigint").alias("_gid"),
                                    *[(F.col(k) if k in s else F.lit(None)).cast(df.schema[k].dataType).alias(k) for k in all_keys])
                           for s in sets])
        df, keys = df.select(F.explode(levels).alias("_l"), *GROUP_VARS).select("_l.*", *GROUP_VARS), [*all_keys, "_gid"]
    keys = keys or []
    aggs = []
    for v in GROUP_VARS:
        aggs += [F.avg(v).alias(stat_name(level, "mean", v)), F.stddev_samp(v).alias(stat_name(level, "std", v))]
    grouped = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    spread = quantiles(df, GROUP_VARS, [0.25, 0.75], by=keys)
    wide = spread.groupBy(*[F.col(k).alias(f"_q_{k}") for k in keys]).agg(
        *[F.max(F.when(F.col("column") == v, F.col("q"))).alias(f"_q_{v}") for v in GROUP_VARS])
    if keys:
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_q_{k}")) for k in keys])
        grouped = grouped.join(wide, same, "left")
    else:
        row = wide.first()  # one row
        grouped = grouped.withColumns({f"_q_{v}": F.lit(row[f"_q_{v}"] if row else None) for v in GROUP_VARS})
    out = []
    for v in GROUP_VARS:
        out += [stat_name(level, "mean", v), stat_name(level, "std", v),
                F.col(f"_q_{v}")[0].alias(stat_name(level, "_p25", v)),
                F.col(f"_q_{v}")[1].alias(stat_name(level, "_p75", v))]
    return grouped.select(*keys, *out)


def fit_lookup(base_train: DataFrame, schema: PanelSchema = DEFAULT, keys_mode: str = "period",
               one_pass: bool = True) -> Lookup:
    """A1: statistics per (period, group), (period, stratum) and (period).

    keys_mode="period" keeps the period in the keys (parity: rows of a later period then match nothing, D3).
    keys_mode="latest" fits on the last training period only and drops the period from the keys, so later periods
    inherit the most recent statistics.
    one_pass=True computes the three levels together (one scan, each row once for every level); the levels are
    told apart by grouping_id, so a real null group key stays distinct from "not grouped by this key".
    """
    p = schema.period
    df = base_train
    if keys_mode == "latest":
        last = df.agg(F.max(p).alias("_last"))
        df = df.join(F.broadcast(last), F.col(p) == F.col("_last")).drop("_last")  # 1-row table
        pk: list[str] = []
    else:
        pk = [p]
    keys = {"turma": pk + [schema.group], "fase": pk + [schema.stratum], "global": list(pk)}
    if not one_pass:
        tables = {lvl: _level_stats(df, keys[lvl], lvl) for lvl in LEVELS}
        return Lookup(tables=tables, keys=keys)
    all_keys = list(dict.fromkeys(pk + [schema.group, schema.stratum]))
    sets = [keys[lvl] for lvl in LEVELS]
    stats = _level_stats(df, None, "_lvl", grouping=(sets, all_keys))
    tables = {}
    for lvl in LEVELS:
        gid = _grouping_id(all_keys, keys[lvl])
        cols = [F.col(stat_name("_lvl", st, v)).alias(stat_name(lvl, st, v)) for v in GROUP_VARS for st in STATS]
        tables[lvl] = stats.filter(F.col("_gid") == gid).select(*keys[lvl], *cols)
    return Lookup(tables=tables, keys=keys, combined=stats)


def _grouping_id(all_keys: list[str], present: list[str]) -> int:
    """Spark's grouping_id: one bit per grouping column (first column = most significant), 1 = not grouped."""
    gid = 0
    for k in all_keys:
        gid = (gid << 1) | (0 if k in present else 1)
    return gid


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        # One statistics row: it is read back as literals (24 numbers) instead of joining every row against it.
        row = right.first()
        values = row.asDict() if row is not None else {}
        return left.select("*", *[F.lit(values.get(c)).cast("double").alias(c) for c in right.columns])
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = e if cond is None else cond & e
    return left.join(renamed, cond, "left").drop(*[f"_r_{k}" for k in keys])


def apply_lookup(base: DataFrame, lookup: Lookup, schema: PanelSchema = DEFAULT,
                 extra: list[str] | None = None) -> DataFrame:
    """J3 + F21–F24 + P12: join the three statistic tables, fall back group → stratum → global, derive deltas,
    guarded z-scores and below-quartile flags, then select identifiers, base columns and derived columns."""
    df = base
    for lvl in LEVELS:
        df = _null_safe_join(df, lookup.tables[lvl], lookup.keys[lvl])

    def s(level, stat, v):
        return F.col(stat_name(level, stat, v))

    fallback = {
        stat_name("turma", st, v): F.coalesce(s("turma", st, v), s("fase", st, v), s("global", st, v))
        for v in GROUP_VARS for st in STATS
    }
    derived: list[Column] = []
    for lvl in LEVELS:
        for v in GROUP_VARS:
            for st in STATS:
                name = stat_name(lvl, st, v)
                derived.append((fallback[name] if lvl == "turma" else F.col(name)).alias(name))
    for v in GROUP_VARS:
        x = F.col(v)
        for lvl in ("turma", "fase"):
            m = fallback[stat_name(lvl, "mean", v)] if lvl == "turma" else s(lvl, "mean", v)
            sd = fallback[stat_name(lvl, "std", v)] if lvl == "turma" else s(lvl, "std", v)
            derived.append((x - m).alias(f"delta_{lvl}_{v}"))
            derived.append(F.coalesce(F.when(sd > EPS, (x - m) / sd), F.lit(0.0)).alias(f"z_{lvl}_{v}"))
    for v in BELOW_P25_VARS:
        p25 = fallback[stat_name("turma", "_p25", v)]
        derived.append(F.coalesce((F.col(v) < p25).cast("int"), F.lit(0)).alias(f"abaixo_p25_turma_{v}"))

    st = schema.state_t
    # fixed values: identifiers and carried columns, in the order of the feature table
    id_cols = [schema.entity, schema.period, schema.pair_label, schema.stratum, schema.group, schema.target]
    base_cols = ["genero", "instituicao", "escola", schema.start_col, "tempo_casa", "ano_nasc", "idade",
                 st, f"{st}_is0", f"{st}_bin_1", f"{st}_bin_2plus",
                 *schema.exam_cols, "fez_ingles", "media_provas", "disp_provas", "ieg", "iaa", "ips", "ipp"]
    present = set(df.columns)
    keep = [F.col(c) for c in id_cols + base_cols + list(extra or []) if c in present and c != schema.state_t1]
    return df.select(*keep, *derived)


# ------------------------------------------------------------------------------------------------ fills
def numeric_columns(df: DataFrame, schema: PanelSchema = DEFAULT) -> list[str]:
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return [c for c, t in df.dtypes if (t in numeric or t.startswith("decimal")) and c != schema.target]


def fit_fill(features_train: DataFrame, lookup: Lookup, schema: PanelSchema = DEFAULT) -> Lookup:
    """P15 + A4: which columns are entirely null in training, and the exact training median of every numeric column (0
    when undefined). The medians of all columns come from the same passes over counts; what reaches the driver is one
    number a column."""
    cols = features_train.columns
    nums = numeric_columns(features_train, schema)
    row = features_train.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    lookup.rows = row["rows"]
    lookup.all_null_cols = [c for i, c in enumerate(cols) if row[f"n{i}"] == 0]
    found = {r["column"]: float(r.q[0]) for r in quantiles(features_train, nums, [0.5]).collect()} if nums else {}
    lookup.medians = {c: found.get(c, 0.0) for c in nums}
    return lookup


def finalize(features: DataFrame, lookup: Lookup, is_train: bool, schema: PanelSchema = DEFAULT) -> DataFrame:
    """P15 drop (decided on train, mirrored elsewhere) + F37 numeric fill (train medians on train, 0 elsewhere) +
    F38 categorical fill with a real MISSING_CATEGORY token."""
    drop = set(lookup.all_null_cols)
    nums = set(numeric_columns(features, schema))
    out = []
    for c in features.columns:
        if c in drop:
            continue
        col = F.col(c)
        if c in nums:
            fill = lookup.medians.get(c, 0.0) if is_train else 0.0
            col = F.coalesce(col, F.lit(fill).cast(dict(features.dtypes)[c]))
        if c in CAT_FEATURES:
            col = F.coalesce(col.cast("string"), F.lit(MISSING_CATEGORY))
        out.append(col.alias(c))
    return features.select(*out)


def build_features(train_pairs: DataFrame, other_pairs: DataFrame | None = None, schema: PanelSchema = DEFAULT,
                   keys_mode: str = "period", materialize_lookup: bool = True):
    """Fit on the training pairs, apply to training and (optionally) to another pair set.
    Returns (train_features, other_features_or_None, lookup). Quartiles and medians are exact at every size."""
    from panelkit.session import materialize

    # the training base is read by the statistics pass, the feature joins and the fill statistics: cut its lineage once
    base_train = base_columns(train_pairs, schema)
    if materialize_lookup:
        base_train = materialize(base_train)
    lookup = fit_lookup(base_train, schema, keys_mode=keys_mode)
    if materialize_lookup:
        if lookup.combined is not None:
            combined = materialize(lookup.combined)
            lookup = _split_combined(combined, lookup)
        else:
            lookup.tables = {k: materialize(v) for k, v in lookup.tables.items()}
    feats_train = apply_lookup(base_train, lookup, schema)
    if materialize_lookup:  # the fill statistics scan it several times
        feats_train = materialize(feats_train)
    fit_fill(feats_train, lookup, schema)
    train_out = finalize(feats_train, lookup, True, schema)
    other_out = None
    if other_pairs is not None:
        other_out = finalize(apply_lookup(base_columns(other_pairs, schema), lookup, schema), lookup, False, schema)
    return train_out, other_out, lookup


def _split_combined(combined: DataFrame, lookup: Lookup) -> Lookup:
    """Re-derive the three level tables from the materialised grouping-sets result."""
    all_keys = [c for c in combined.columns if not c.startswith("_lvl_") and c != "_gid"]
    tables = {}
    for lvl in LEVELS:
        gid = _grouping_id(all_keys, lookup.keys[lvl])
        cols = [F.col(stat_name("_lvl", st, v)).alias(stat_name(lvl, st, v)) for v in GROUP_VARS for st in STATS]
        tables[lvl] = combined.filter(F.col("_gid") == gid).select(*lookup.keys[lvl], *cols)
    lookup.tables, lookup.combined = tables, combined
    return lookup


def leaking_columns(schema: PanelSchema = DEFAULT) -> tuple[str, ...]:
    """What is known only in the period that a pair predicts."""
    later = [schema.state_t1, *(f"{c}_t1" for c in (*schema.exam_cols, *GROUP_VARS))]
    return tuple(dict.fromkeys(later))


def check_leakage(train: DataFrame, other: DataFrame, schema: PanelSchema = DEFAULT, deny: tuple[str, ...] = ()) -> None:
    """Raise when a denied column is among the features, or when the two tables' columns or types differ."""
    denied = sorted({*leaking_columns(schema), *deny} & {*train.columns, *other.columns})
    if denied:
        raise ValueError(f"features hold columns of the predicted period: {denied}")
    if dict(train.dtypes) != dict(other.dtypes):
        raise ValueError(f"feature tables differ: {sorted(set(train.dtypes) ^ set(other.dtypes))}")


def feature_columns(df: DataFrame, schema: PanelSchema = DEFAULT) -> tuple[list[str], list[str]]:
    """(numeric features, categorical features); identifiers, target and next state are excluded."""
    exclude = {schema.entity, schema.period, schema.pair_label, schema.target, schema.state_t1}
    cats = [c for c in CAT_FEATURES if c in df.columns]
    nums = [c for c in numeric_columns(df, schema) if c not in exclude and c not in cats]
    return nums, cats


def missing_rate(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A5 (overall): nulls / (rows × numeric columns), one aggregate."""
    cols = cols or numeric_columns(df)
    nulls = sum(F.count_if(F.col(c).isNull()) for c in cols)
    return df.agg((nulls / (F.count(F.lit(1)) * F.lit(len(cols)))).alias("missing_rate"),
                  F.count(F.lit(1)).alias("n_rows"), F.lit(len(cols)).alias("n_numeric_cols"))


def missing_by_column(df: DataFrame, cols: list[str]) -> DataFrame:
    """A5 (per column, long form, sorted desc): one aggregate, unpivoted with ``stack``."""
    agg = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return agg.unpivot([], cols, "column", "missing_rate")
