"""Pairing, temporal split and conformance on tiny frames (known answers)."""

import pytest
from pyspark.sql import functions as F

from panelkit.functions import coerce as C
from panelkit.functions import strata as S
from panelkit.functions import text as T
from panelkit.operators import conform as CF
from panelkit.operators import pairs as P


def _panel(spark, rows):
    return spark.createDataFrame(rows, "ra string, ano_base int, defasagem int, fase int, turma string")


def test_pair_target_rises(spark):
    rows = [("RA-1", 2022, 0, 1, "A"), ("RA-2", 2022, 1, 1, "A"), ("RA-3", 2022, 2, 1, "A"),
            ("RA-1", 2023, 1, 1, "A"), ("RA-2", 2023, 1, 1, "A"), ("RA-3", 2023, 3, 1, "A")]
    out = {r.ra: r.target for r in P.build_pairs(_panel(spark, rows)).collect()}
    assert out == {"RA-1": 1, "RA-2": 0, "RA-3": 1}


def test_missing_next_period_is_dropped_and_lagging_kept(spark):
    rows = [("RA-1", 2022, 2, 1, "A"), ("RA-2", 2022, 0, 1, "A"), ("RA-1", 2023, 2, 1, "A")]
    out = P.build_pairs(_panel(spark, rows)).collect()
    assert [(r.ra, r.defasagem_t, r.defasagem_t1, r.target) for r in out] == [("RA-1", 2, 2, 0)]


def test_ids_are_trimmed_and_null_ids_dropped(spark):
    rows = [(" RA-1 ", 2022, 0, 1, "A"), ("RA-1", 2023, 1, 1, "A"), (None, 2022, 0, 1, "A"), (None, 2023, 2, 1, "A")]
    out = P.build_pairs(_panel(spark, rows)).collect()
    assert [(r.ra, r.target) for r in out] == [("RA-1", 1)]


def test_duplicates_fan_out_only_without_dedup(spark):
    rows = [("RA-1", 2022, 0, 1, "A"), ("RA-1", 2022, 0, 1, "B"), ("RA-1", 2023, 1, 1, "A")]
    assert P.build_pairs(_panel(spark, rows)).count() == 1
    assert P.build_pairs(_panel(spark, rows), dedup=False).count() == 2


def test_adjacency_available_vs_consecutive(spark):
    rows = [("RA-1", 2020, 0, 1, "A"), ("RA-1", 2022, 1, 1, "A"), ("RA-2", 2021, 0, 1, "A")]
    df = _panel(spark, rows)
    assert P.build_pairs(df).count() == 0  # 2020's next available period is 2021
    rows2 = [("RA-1", 2020, 0, 1, "A"), ("RA-1", 2022, 1, 1, "A")]
    assert P.build_pairs(_panel(spark, rows2)).count() == 1  # gap allowed: 2022 is the next available period
    assert P.build_pairs(_panel(spark, rows2), adjacency="consecutive").count() == 0


def test_temporal_split(spark):
    rows = [(f"RA-{i}", y, s, 1, "A") for i, states in enumerate([[0, 1, 0], [1, 1, 0], [2, 1, 0]])
            for y, s in zip((2022, 2023, 2024), states)]
    df = _panel(spark, rows)
    train, valid = P.temporal_split(P.build_pairs(df), df)
    assert {r.pair_label for r in valid.collect()} == {"2023->2024"}
    assert {r.pair_label for r in train.collect()} == {"2022->2023"}


def test_two_periods_raise(spark):
    df = _panel(spark, [("RA-1", 2022, 0, 1, "A"), ("RA-1", 2023, 1, 1, "A")])
    with pytest.raises(ValueError):
        P.temporal_split(P.build_pairs(df), df)


def test_scalar_functions(spark):
    df = spark.createDataFrame([("1A",), ("0",), (None,), ("FASE 3",), ("12",), ("ALFA",), ("2B",)], "x string")
    got = df.select(S.stratum_label(F.col("x")).alias("l"), S.stratum_int(F.col("x")).alias("i")).collect()
    assert [r.l for r in got] == ["FASE1", "ALFA", "UNKNOWN", "FASE3", "FASE12", "ALFA", "FASE2"]
    assert [r.i for r in got] == [1, 0, None, 3, None, 0, 2]
    acc = spark.createDataFrame([("ção",)], "x string").select(T.strip_accents(F.col("x"))).first()[0]
    assert acc == "cao"
    g = spark.createDataFrame([("  feminino  ",), ("Menino",), ("x",), (None,)], "g string")
    assert [r[0] for r in g.select(C.gender(F.col("g"))).collect()] == ["F", "M", "NA", "NA"]
    assert [r[0] for r in g.select(C.gender(F.col("g"), default=None)).collect()] == ["F", "M", None, None]


def test_numeric_coercion_and_rounding(spark):
    df = spark.createDataFrame([("7,5",), (" 8.5 ",), ("7.5d",), ("abc",)], "v string")
    assert [r[0] for r in df.select(C.to_number(F.col("v"))).collect()] == [None, 8.5, None, None]
    assert [r[0] for r in df.select(C.to_number_comma(F.col("v"))).collect()] == [7.5, 8.5, None, None]
    r = spark.createDataFrame([(2.5,), (3.5,), (-2.5,)], "v double").select(C.round_half_even_int(F.col("v")))
    assert [x[0] for x in r.collect()] == [2, 4, -2]


def test_inde_pedra_and_age(spark):
    df = spark.createDataFrame([(5, "quartzo", 2023)], "inde_2023 int, pedra_23 string, ano_base int")
    row = CF.ensure_inde_pedra(df).first()
    assert row.inde == 5 and row.pedra == "quartzo" and "inde_2023" not in row.asDict()
    sheet = spark.createDataFrame([("  RA-001  ", "FASE3", 2000.0)], "RA string, Fase string, ano_nasc double")
    out = CF.conform_sheet(sheet, 2023).first()
    assert out.ra == "RA-001" and out.fase == 3 and out.idade == 23.0 and out.genero == "NA"


def test_standardize_literal_renames_are_case_sensitive(spark):
    sheet = spark.createDataFrame([("RA-1", "7,5", "01/06/2005")], "ra string, Matem string, data_de_nasc string")
    out = CF.standardize(sheet, 2023)
    # 'Matem' is not an alias, so it is neither renamed nor coerced; with Spark's case-insensitive names it occupies
    # the 'matem' slot instead of a second, back-filled column
    assert "Matem" in out.columns and [c.lower() for c in out.columns].count("matem") == 1
    row = out.first()
    assert row.Matem == "7,5" and row.ano_nasc == 2005 and row.idade == 18


def test_full_nfkd_fold_matches_native_on_latin_text(spark):
    df = spark.createDataFrame([("ção àéîõü",), ("ﬁ Ｆｕｌｌ",), (None,)], "x string")
    rows = df.select(T.strip_accents(F.col("x")).alias("a"), T.strip_accents_full(F.col("x")).alias("b")).collect()
    assert rows[0].a == rows[0].b == "cao aeiou"
    assert rows[1].b == "fi Full" and rows[2].b is None
