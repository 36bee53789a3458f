"""Registered queries: base columns, group statistics, lookup joins and the final feature tables.

The SQL oracle is assembled from the same fixed names (statistics × variables), written against DuckDB's
``quantile_cont`` / ``stddev_samp`` / ``IS NOT DISTINCT FROM``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import features as FE
from panelkit.operators import pairs as P
from panelkit.plans import bindings as B
from panelkit.plans.common import DIGITS, round_doubles
from panelkit.plans.registry import query
from panelkit.session import materialize

GV = FE.GROUP_VARS
SQL_STAT = {"mean": "avg({v})", "std": "stddev_samp({v})", "_p25": "quantile_cont({v}, 0.25)",
            "_p75": "quantile_cont({v}, 0.75)"}


def _split(spark, sf_dir):
    """Train / valid pairs. The panel feeds pairs, periods and the split, the pair table both sides and several passes, so
    the lineage of each is cut once."""
    panel = materialize(B.cust_year(spark, sf_dir))
    return P.temporal_split(materialize(P.build_pairs(panel)), panel)


BASE_SQL = B.B2_SQL + """,
split AS (SELECT *, pair_label = (SELECT max(pair_label) FROM pairs) AS is_valid FROM pairs),
nn AS (SELECT *, CAST(matem IS NOT NULL AS INTEGER) + CAST(portug IS NOT NULL AS INTEGER)
                 + CAST(ingles IS NOT NULL AS INTEGER) AS n_ex FROM split),
mm AS (SELECT *, CASE WHEN n_ex > 0 THEN (coalesce(matem, 0.0) + coalesce(portug, 0.0) + coalesce(ingles, 0.0)) / n_ex
                 END AS mp FROM nn),
base AS (
  SELECT ra, ano_base, pair_label, fase, turma, target, genero, instituicao, ano_ingresso,
         CAST(ano_base AS DOUBLE) - CAST(ano_ingresso AS DOUBLE) AS tempo_casa,
         coalesce(CAST(defasagem_t AS DOUBLE), 0.0) AS defasagem_t,
         CAST(coalesce(CAST(defasagem_t AS DOUBLE), 0.0) = 0 AS INTEGER) AS defasagem_t_is0,
         CAST(coalesce(CAST(defasagem_t AS DOUBLE), 0.0) = 1 AS INTEGER) AS defasagem_t_bin_1,
         CAST(coalesce(CAST(defasagem_t AS DOUBLE), 0.0) >= 2 AS INTEGER) AS defasagem_t_bin_2plus,
         matem, portug,
         CASE WHEN fase IN (0, 1, 2, 8) THEN NULL ELSE ingles END AS ingles,
         CASE WHEN fase IN (0, 1, 2, 8) THEN 0 ELSE CAST(ingles IS NOT NULL AS INTEGER) END AS fez_ingles,
         mp AS media_provas,
         CASE WHEN n_ex > 0 THEN sqrt((CASE WHEN matem IS NOT NULL THEN (matem - mp) * (matem - mp) ELSE 0.0 END
              + CASE WHEN portug IS NOT NULL THEN (portug - mp) * (portug - mp) ELSE 0.0 END
              + CASE WHEN ingles IS NOT NULL THEN (ingles - mp) * (ingles - mp) ELSE 0.0 END) / n_ex)
              ELSE 0.0 END AS disp_provas,
         ieg, coalesce(iaa, 0.0) AS iaa, ips, ipp, is_valid
  FROM mm
)"""


def _stats_cte(level: str, keys: list[str], where: str) -> str:
    cols = ", ".join(f"{SQL_STAT[st].format(v=v)} AS {FE.stat_name(level, st, v)}" for v in GV for st in FE.STATS)
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    sel = (", ".join(keys) + ", ") if keys else ""
    return f"st_{level} AS (SELECT {sel}{cols} FROM base WHERE {where} {group})"


def _features_sql(valid: bool, latest: bool = False) -> str:
    if latest:
        where = "NOT is_valid AND ano_base = (SELECT max(ano_base) FROM base WHERE NOT is_valid)"
        keys = {"turma": ["turma"], "fase": ["fase"], "global": []}
    else:
        where = "NOT is_valid"
        keys = {"turma": ["ano_base", "turma"], "fase": ["ano_base", "fase"], "global": ["ano_base"]}
    ctes = [_stats_cte(lvl, keys[lvl], where) for lvl in FE.LEVELS]
    joins = []
    for lvl in FE.LEVELS:
        if keys[lvl]:
            on = " AND ".join(f"b.{k} IS NOT DISTINCT FROM {lvl[0]}.{k}" for k in keys[lvl])
        else:
            on = "TRUE"
        joins.append(f"LEFT JOIN st_{lvl} {lvl[0]} ON {on}")

    def st(level, stat, v):
        name = FE.stat_name(level, stat, v)
        if level == "turma":
            return f"coalesce(t.{name}, f.{FE.stat_name('fase', stat, v)}, g.{FE.stat_name('global', stat, v)})"
        return f"{level[0]}.{name}"

    derived = []
    for lvl in FE.LEVELS:
        derived += [f"{st(lvl, s, v)} AS {FE.stat_name(lvl, s, v)}" for v in GV for s in FE.STATS]
    for v in GV:
        for lvl in ("turma", "fase"):
            m, sd = st(lvl, "mean", v), st(lvl, "std", v)
            derived.append(f"b.{v} - {m} AS delta_{lvl}_{v}")
            derived.append(f"coalesce(CASE WHEN {sd} > 1e-6 THEN (b.{v} - {m}) / {sd} END, 0.0) AS z_{lvl}_{v}")
    for v in FE.BELOW_P25_VARS:
        derived.append(f"coalesce(CAST(b.{v} < {st('turma', '_p25', v)} AS INTEGER), 0) AS abaixo_p25_turma_{v}")
    ids = ["ra", "ano_base", "pair_label", "fase", "turma", "target", "genero", "instituicao", "ano_ingresso",
           "tempo_casa", "defasagem_t", "defasagem_t_is0", "defasagem_t_bin_1", "defasagem_t_bin_2plus",
           "matem", "portug", "ingles", "fez_ingles", "media_provas", "disp_provas", "ieg", "iaa", "ips"]
    feat = (f"feat AS (SELECT {', '.join('b.' + c for c in ids)}, {', '.join(derived)} FROM base b "
            f"{' '.join(joins)} WHERE {'b.is_valid' if valid else 'NOT b.is_valid'})")
    names = ids + [d.rsplit(" AS ", 1)[1] for d in derived]
    numeric = [c for c in names if c not in ("ra", "pair_label", "turma", "genero", "instituicao", "target")]
    ints = {"fase", "ano_base", "ano_ingresso", "defasagem_t_is0", "defasagem_t_bin_1", "defasagem_t_bin_2plus",
            "fez_ingles"} | {f"abaixo_p25_turma_{v}" for v in FE.BELOW_P25_VARS}
    # training medians decide the fill of the training rows; other rows are filled with 0
    med_where = "NOT b.is_valid"
    med = (f"med AS (SELECT {', '.join(f'median({c}) AS {c}' for c in numeric)} FROM feat_train)")
    feat_train = feat.replace("feat AS", "feat_train AS").replace(
        f"WHERE {'b.is_valid' if valid else 'NOT b.is_valid'})", f"WHERE {med_where})")
    out = []
    for c in names:
        if c in numeric:
            fill = "0" if valid else f"coalesce(med.{c}, 0)"
            e = f"coalesce(feat.{c}, CAST({fill} AS {'INTEGER' if c in ints else 'DOUBLE'}))"
            if c == "fase":
                e = f"coalesce(CAST({e} AS VARCHAR), 'MISSING_CATEGORY')"
            elif c not in ints:
                e = f"round({e}, {DIGITS})"
        elif c in ("turma", "genero", "instituicao"):
            e = f"coalesce(feat.{c}, 'MISSING_CATEGORY')"
        else:
            e = f"feat.{c}"
        out.append(f"{e} AS {c}")
    return (B.with_ctes(BASE_SQL, *ctes, feat_train, feat, med)
            + f" SELECT {', '.join(out)} FROM feat, med")


@query("features_train", _features_sql(valid=False), ids=("F16", "F17", "F18", "F19", "F20", "A1", "J3", "F21",
                                                          "F22", "F23", "F24", "A4", "F37", "F38", "P12", "P15"))
def features_train(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    feats, _, _ = FE.build_features(train)
    return round_doubles(feats)


@query("features_valid_parity", _features_sql(valid=True), ids=("J3", "F24", "F37"))
def features_valid_parity(spark, sf_dir):
    train, valid = _split(spark, sf_dir)
    _, feats, _ = FE.build_features(train, valid)
    return round_doubles(feats)


@query("features_valid_latest", _features_sql(valid=True, latest=True), ids=("J3", "A1"))
def features_valid_latest(spark, sf_dir):
    train, valid = _split(spark, sf_dir)
    _, feats, _ = FE.build_features(train, valid, keys_mode="latest")
    return round_doubles(feats)


def _stats_select(level: str, keys: list[str]) -> str:
    cols = [FE.stat_name(level, st, v) for v in GV for st in FE.STATS]
    # the stratum key is a 64-bit integer on the Spark side (lenient stratum parse)
    key_sql = [f"CAST({k} AS BIGINT) AS {k}" if k == "fase" else k for k in keys]
    return f" SELECT {', '.join(key_sql)}, {', '.join(f'round({c}, {DIGITS}) AS {c}' for c in cols)} FROM st_{level}"


@query("group_stats_by_group", B.with_ctes(BASE_SQL, _stats_cte("turma", ["ano_base", "turma"], "TRUE"))
       + _stats_select("turma", ["ano_base", "turma"]), ids=("A1",))
def group_stats_by_group(spark, sf_dir):
    base = FE.base_columns(B.pairs(spark, sf_dir))
    return round_doubles(FE._level_stats(base, ["ano_base", "turma"], "turma"))


@query("group_stats_by_stratum", B.with_ctes(BASE_SQL, _stats_cte("fase", ["ano_base", "fase"], "TRUE"))
       + _stats_select("fase", ["ano_base", "fase"]), ids=("A1",))
def group_stats_by_stratum(spark, sf_dir):
    base = FE.base_columns(B.pairs(spark, sf_dir))
    return round_doubles(FE._level_stats(base, ["ano_base", "fase"], "fase"))


#: The group level fitted on the training pairs only.
GROUP_STATS_SQL = B.with_ctes(BASE_SQL, _stats_cte("turma", ["ano_base", "turma"], "NOT is_valid")) + _stats_select("turma", ["ano_base", "turma"])


@query("panel_missing_rate", B.with_ctes(B.B1_SQL) + """
SELECT round((count(*) FILTER (WHERE matem IS NULL) + count(*) FILTER (WHERE portug IS NULL)
  + count(*) FILTER (WHERE ingles IS NULL) + count(*) FILTER (WHERE ieg IS NULL)
  + count(*) FILTER (WHERE iaa IS NULL) + count(*) FILTER (WHERE ips IS NULL)
  + count(*) FILTER (WHERE ipp IS NULL)) / (count(*) * 7.0), 9) AS missing_rate,
  CAST(count(*) AS BIGINT) AS n_rows, 7 AS n_numeric_cols FROM cust_year""", ids=("A5",))
def panel_missing_rate(spark, sf_dir):
    cols = ["matem", "portug", "ingles", "ieg", "iaa", "ips", "ipp"]
    return round_doubles(FE.missing_rate(B.cust_year(spark, sf_dir), cols))


@query("panel_missing_by_column", B.with_ctes(B.B1_SQL) + """
SELECT "column", round(missing_rate, 9) AS missing_rate FROM (
  UNPIVOT (SELECT avg(CAST(matem IS NULL AS DOUBLE)) AS matem, avg(CAST(portug IS NULL AS DOUBLE)) AS portug,
                  avg(CAST(ingles IS NULL AS DOUBLE)) AS ingles, avg(CAST(ieg IS NULL AS DOUBLE)) AS ieg,
                  avg(CAST(iaa IS NULL AS DOUBLE)) AS iaa, avg(CAST(ips IS NULL AS DOUBLE)) AS ips,
                  avg(CAST(ipp IS NULL AS DOUBLE)) AS ipp FROM cust_year)
  ON matem, portug, ingles, ieg, iaa, ips, ipp INTO NAME "column" VALUE missing_rate)""", ids=("A5", "W13"))
def panel_missing_by_column(spark, sf_dir):
    cols = ["matem", "portug", "ingles", "ieg", "iaa", "ips", "ipp"]
    return round_doubles(FE.missing_by_column(B.cust_year(spark, sf_dir), cols))


@query("missingness_ranking", B.with_ctes(B.B1_SQL) + """
SELECT "column", round(missing_rate, 9) AS missing_rate FROM (
  UNPIVOT (SELECT avg(CAST(matem IS NULL AS DOUBLE)) AS matem, avg(CAST(portug IS NULL AS DOUBLE)) AS portug,
                  avg(CAST(ingles IS NULL AS DOUBLE)) AS ingles, avg(CAST(ieg IS NULL AS DOUBLE)) AS ieg,
                  avg(CAST(iaa IS NULL AS DOUBLE)) AS iaa, avg(CAST(ips IS NULL AS DOUBLE)) AS ips,
                  avg(CAST(ipp IS NULL AS DOUBLE)) AS ipp, avg(CAST(turma IS NULL AS DOUBLE)) AS turma,
                  avg(CAST(genero IS NULL AS DOUBLE)) AS genero FROM cust_year)
  ON matem, portug, ingles, ieg, iaa, ips, ipp, turma, genero INTO NAME "column" VALUE missing_rate)
ORDER BY missing_rate DESC, "column" LIMIT 15""", ids=("W13", "A5"))
def missingness_ranking(spark, sf_dir):
    """The most-missing columns, descending (a top-n: the limit is the feature)."""
    cols = ["matem", "portug", "ingles", "ieg", "iaa", "ips", "ipp", "turma", "genero"]
    out = FE.missing_by_column(B.cust_year(spark, sf_dir), cols)
    return round_doubles(out.orderBy(F.col("missing_rate").desc(), F.col("column")).limit(15))
