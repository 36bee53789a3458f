"""Feature builder: known answers from tiny frames."""

import random

import pytest

from pyspark.sql import functions as F

from panelkit.operators import features as FE


def _rows(n=40, seed=0):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        out.append((f"RA-{i}", 2022, "2022->2023", 1 + i % 2, "A" if i % 3 else "B", 2019,
                    rnd.uniform(3, 10), rnd.uniform(3, 10), rnd.uniform(3, 10), rnd.uniform(3, 10),
                    rnd.uniform(3, 10), rnd.uniform(3, 10),
                    None if i % 3 == 0 else rnd.uniform(4, 10), i % 2, 0, i % 2, "F", "PUBLICA"))
    return out


SCHEMA = ("ra string, ano_base int, pair_label string, fase int, turma string, ano_ingresso int, ieg double, "
          "iaa double, ips double, ipp double, matem double, portug double, ingles double, defasagem_t int, "
          "defasagem_t1 int, target int, genero string, instituicao string")


def test_exam_mean_dispersion_tenure(spark):
    df = spark.createDataFrame([r for r in _rows(3)], SCHEMA)
    base = FE.base_columns(df).orderBy("ra").collect()
    r0 = base[0]  # English missing
    assert abs(r0.media_provas - (r0.matem + r0.portug) / 2) < 1e-12
    assert r0.tempo_casa == 3.0
    one = spark.createDataFrame([("RA-x", 2023, "p", 3, "A", 2019, 5.0, 5.0, 5.0, 5.0, 7.0, None, None, 0, 0, 0,
                                  "F", "P")], SCHEMA)
    b = FE.base_columns(one).first()
    assert b.disp_provas == 0.0 and b.media_provas == 7.0 and b.tempo_casa == 4.0


def test_english_neutralised_in_early_strata_after_mean(spark):
    df = spark.createDataFrame([("RA-1", 2022, "p", 1, "A", 2019, 5.0, 5.0, 5.0, 5.0, 6.0, 8.0, 10.0, 0, 0, 0,
                                 "F", "P")], SCHEMA)
    r = FE.base_columns(df).first()
    assert r.ingles is None and r.fez_ingles == 0 and r.media_provas == 8.0


def test_no_nulls_after_fit_and_valid_mirrors_drops(spark):
    train = spark.createDataFrame(_rows(40), SCHEMA)
    valid = spark.createDataFrame(_rows(10, seed=1), SCHEMA).withColumn("ano_base", F.lit(2023))
    tr, va, lookup = FE.build_features(train, valid)
    nums, _ = FE.feature_columns(tr)
    nulls = tr.select(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in nums]).first().asDict()
    assert all(v == 0 for v in nulls.values())
    assert set(tr.columns) == set(va.columns)
    # parity keys (period in the keys): a later period matches no statistics, so z-scores are 0 (D3)
    assert va.agg(F.max(F.abs("z_turma_matem"))).first()[0] == 0.0
    _, va_latest, _ = FE.build_features(train, valid, keys_mode="latest")
    assert va_latest.agg(F.max(F.abs("z_turma_matem"))).first()[0] > 0.0


def test_grouping_sets_equal_separate_aggregates(spark):
    base = FE.base_columns(spark.createDataFrame(_rows(60), SCHEMA))
    one = FE.fit_lookup(base, one_pass=True)
    sep = FE.fit_lookup(base, one_pass=False)
    for lvl in FE.LEVELS:
        a = sorted(tuple(r) for r in one.tables[lvl].collect())
        b = sorted(tuple(r) for r in sep.tables[lvl].select(*one.tables[lvl].columns).collect())
        assert a == b


def test_leakage_policy(spark):
    a = spark.createDataFrame([(1, 2.0)], "ra long, ieg double")
    FE.check_leakage(a, a)
    with pytest.raises(ValueError, match="predicted period"):
        FE.check_leakage(a.withColumn(FE.leaking_columns()[0], F.lit(1)), a)
    with pytest.raises(ValueError, match="predicted period"):
        FE.check_leakage(a, a, deny=("ieg",))
    with pytest.raises(ValueError, match="differ"):
        FE.check_leakage(a, a.withColumn("ieg", F.lit(1)))
