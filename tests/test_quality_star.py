"""Quality checks and star-model dedup on tiny frames with known answers."""

from pyspark.sql import functions as F

from panelkit.operators import quality as Q
from panelkit.operators import star as S
from panelkit.operators.pairs import dedup_first


def test_iqr_outliers_known_answer(spark):
    df = spark.createDataFrame([(float(v), 1.0) for v in [1, 2, 3, 4, 5, 6, 7, 8, 100]], "x double, flat double")
    out = {r.column: r.n_outliers for r in Q.iqr_outliers(df, ["x", "flat"]).collect()}
    assert out == {"x": 1, "flat": 0}  # q1=3, q3=7, fence 13 → only 100; a flat column has IQR 0


def test_unseen_categories_and_key_sanity(spark):
    cur = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "k string, t string")
    train = spark.createDataFrame([("a", "x")], "k string, t string")
    assert {r.column: r.n_new for r in Q.unseen_categories(cur, train).collect()} == {"k": 2, "t": 1}
    dups = spark.createDataFrame([(1, 1, "A"), (1, 1, "B"), (1, 2, "A")], "o int, l int, f string")
    r = Q.key_sanity(dups, ["o", "l"], "f").first()
    assert (r.n_rows, r.n_keys, r.n_dup_keys, r.n_classes) == (3, 2, 1, 2)


def test_dedup_first_and_latest(spark):
    df = spark.createDataFrame([(1, 2020, "b"), (1, 2020, "a"), (1, 2021, "c"), (2, 2020, None)],
                               "id int, y int, v string")
    first = {(r.id, r.y): r.v for r in dedup_first(df, ["id", "y"]).collect()}
    assert first == {(1, 2020): "a", (1, 2021): "c", (2, 2020): None}
    latest = {r.id: (r.y, r.v) for r in S.dedup_latest(df, ["id"], ["y"]).collect()}
    assert latest == {1: (2021, "c"), 2: (2020, None)}


def test_union_periods_aligns_by_name(spark):
    a = spark.createDataFrame([(1, 7.0)], "id int, matem double")
    b = spark.createDataFrame([(2, "X")], "id int, turma string")
    out = S.union_periods([a, b]).orderBy("id").collect()
    assert [(r.id, r.matem, r.turma) for r in out] == [(1, 7.0, None), (2, None, "X")]
    assert S.union_periods([a, b]).filter(F.col("matem").isNull()).count() == 1
