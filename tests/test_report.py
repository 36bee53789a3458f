"""Report operators: filters before top-K, id candidates, reasons, gates."""

from pyspark.sql import functions as F

from panelkit.operators import report as RP


def test_filters_apply_before_topk(spark):
    rows = [(f"RA-{i}", 2023, 1, "A" if i < 10 else "B", float(i), 5.0) for i in range(20)]
    df = spark.createDataFrame(rows, "ra string, ano_base int, fase int, turma string, score double, matem double")
    everyone = {r.ra for r in RP.filtered_view(df, 10.0).filter("alerta").collect()}
    only_a = {r.ra for r in RP.filtered_view(df, 10.0, groups=["A"]).filter("alerta").collect()}
    assert everyone == {"RA-19", "RA-18"} and only_a == {"RA-9"}
    reasons = {r.motivos for r in RP.filtered_view(df, 10.0).collect()}
    assert reasons == {"Baixo desempenho em Matemática"}


def test_id_candidates_order(spark):
    df = spark.createDataFrame([("RA-5",), ("5",), ("ra5",), (" RA- 5",), ("12-3",)], "r string")
    got = [r[0] for r in df.select(RP.id_candidates(F.col("r"))).collect()]
    assert got == [["RA-5", "5"], ["5", "RA-5"], ["ra5", "5"], ["RA- 5", "5"], ["12-3", "RA-12-3"]]


def test_gates_and_collapse(spark):
    df = spark.createDataFrame([(0.72,), (0.66,), (0.5,), (None,)], "auc double")
    g = [r[0] for r in df.select(RP.gate(F.col("auc"), *RP.GATES["auc"])).collect()]
    assert g == ["ok", "warning", "critical", "warning"]
    s = spark.createDataFrame([(" Warning ",), ("ok",), ("HIGH",)], "s string")
    assert [r[0] for r in s.select(RP.status_collapse(F.col("s"))).collect()] == ["critical", "ok", "critical"]


def test_reason_default_and_first_three(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0), (9.0, 9.0, 9.0, 9.0)], "matem double, portug double, ieg double, ips double")
    got = [r[0] for r in df.select(RP.reason_text(df)).collect()]
    assert got[0].count(", ") == 2 and got[1] == RP.REASON_DEFAULT
