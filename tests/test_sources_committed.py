"""Committed appends, the tail by position, point lookups, dossiers, dense ranks and full folding."""

import threading
import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.functions.text import slug, strip_accents_full
from panelkit.operators import report as RP
from panelkit.operators.ranking import dense_ranks
from panelkit.sources.commits import CommittedTable, swap_document
from panelkit.sources.files import read_small_text
from panelkit.sources.lookup import lookup, open_lookup, write_lookup
from panelkit.sources.tail import age_order, tail_by_position

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("request_id", T.StringType())])


def ids(table):
    return sorted(r.id for r in table.read(SCHEMA).collect())


def test_staged_rows_are_not_seen(spark, tmp_path):
    table = CommittedTable(spark, f"{tmp_path}/t")
    assert ids(table) == [] and table.commits().count() == 0
    attempt = table.stage(spark.range(3), "r1")
    assert ids(table) == []
    assert table.publish("r1", attempt) and ids(table) == [0, 1, 2]


def test_of_two_attempts_one_is_published(spark, tmp_path):
    table = CommittedTable(spark, f"{tmp_path}/t")
    a, b = table.stage(spark.range(3), "r1"), table.stage(spark.range(3), "r1")
    answers = []
    racers = [threading.Thread(target=lambda x=x: answers.append(table.publish("r1", x))) for x in (a, b)]
    for r in racers:
        r.start()
    for r in racers:
        r.join()
    assert sorted(answers) == [False, True] and ids(table) == [0, 1, 2]
    assert not table.append(spark.range(9), "r1") and ids(table) == [0, 1, 2]


def test_a_failed_job_leaves_nothing_to_see(spark, tmp_path):
    table = CommittedTable(spark, f"{tmp_path}/t")
    with pytest.raises(Exception):
        table.append(spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id")), "r1")
    assert ids(table) == []
    assert table.append(spark.range(2), "r1", event={"event_type": "x"}) and ids(table) == [0, 1]
    table.stage(spark.range(5), "r2")
    assert table.vacuum(keep_hours=0) >= 1 and ids(table) == [0, 1]
    assert [r.event for r in table.commits().collect()] == ['{"event_type": "x"}']


def test_days_and_names(spark, tmp_path):
    from datetime import datetime, timezone

    table = CommittedTable(spark, f"{tmp_path}/t")
    for day in (1, 5, 9):
        table.append(spark.range(day, day + 1), f"r{day}", now=datetime(2024, 1, day, tzinfo=timezone.utc))
    assert [r.id for r in table.read(SCHEMA, "2024-01-09", 5).orderBy("id").collect()] == [5, 9]
    with pytest.raises(ValueError):
        table.append(spark.range(1), "a/b")


def test_pointer_swap(spark, tmp_path):
    path = f"{tmp_path}/current.json"
    for i in range(3):
        swap_document(spark, {"baseline_id": i}, path)
    assert read_small_text(spark, path) == '{"baseline_id": 2}'


def test_tail_over_rotated_files(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    every = [f"2024-01-01 00:00:00 | line {i} " + "é" * (i % 50) for i in range(3000)]
    for name, part in (("app.log.10", every[:500]), ("app.log.2", every[500:1500]), ("app.log.1", every[1500:2990]), ("app.log", every[2990:])):
        (logs / name).write_text("\n".join(part) + "\n")
    (logs / "_hidden").write_text("no\n")
    (logs / "app.log.0").write_text("")
    for n in (1, 10, 11, 1700, 5000):
        got = [r.line for r in tail_by_position(spark, str(logs), n, split_bytes=4096).orderBy("position").collect()]
        assert got == every[::-1][:n]
    assert tail_by_position(spark, str(logs / "none"), 5).count() == 0
    rows = tail_by_position(spark, str(logs), 12, split_bytes=64).orderBy("position").collect()
    assert [r.file for r in rows] == ["app.log"] * 10 + ["app.log.1"] * 2 and rows[9].offset == 0


def test_tail_opens_the_last_splits_only(spark, tmp_path, monkeypatch):
    (tmp_path / "app.log").write_text("".join(f"line {i}\n" for i in range(200_000)))
    opened = []
    run = spark.sparkContext.runJob
    monkeypatch.setattr(spark.sparkContext, "runJob", lambda rdd, f, parts: (opened.append((rdd.getNumPartitions(), parts)), run(rdd, f, parts))[1])
    assert tail_by_position(spark, str(tmp_path), 100, split_bytes=1 << 14).count() == 100
    assert opened[0][0] > 100 and len(opened) == 1


def test_age_order():
    names = ["app.log", "app.log.1", "app.log.12", "app.log.2.gz"]
    assert sorted(names, key=age_order) == ["app.log.12", "app.log.2.gz", "app.log.1", "app.log"]


def test_lookup_reads_one_bucket(spark, tmp_path, capsys):
    path = f"{tmp_path}/lookup"
    write_lookup(spark.range(1000).selectExpr("id % 300 AS ra", "id AS score"), path, "ra", ["score"], buckets=16)
    table = open_lookup(spark, path, "ra long, score long", "ra", 16)
    assert sorted(r.score for r in lookup(table, "ra", [7, 999_999]).collect()) == [7, 307, 607, 907]
    # without this the plan prunes buckets too, but does not print it
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    lookup(table, "ra", [7]).explain("formatted")
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    plan = capsys.readouterr().out
    assert "SelectedBucketsCount: 1 out of 16" in plan and "PushedFilters" in plan


def test_dense_ranks(spark):
    rows = [(k, v, t) for k in ("a", "b") for v, t in ((1, "x"), (1, "x"), (1, "y"), (2, None), (None, "z"))]
    got = {(r.k, r.v, r.t): r.ord for r in dense_ranks(spark.createDataFrame(rows, "k string, v int, t string"), ["v", "t"], "ord", by="k", partitions=3).collect()}
    for k in ("a", "b"):
        assert [got[k, v, t] for v, t in ((None, "z"), (1, "x"), (1, "y"), (2, None))] == [1, 2, 3, 4]


def test_many_groups_without_one_partition(spark):
    df = spark.range(1_000_000).select(F.lit(2024).alias("ano_base"), (F.col("id") % 9).alias("fase"), F.format_string("g%07d", "id").alias("turma"))
    out = RP.filter_vocabularies(df)
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    top = out.where("kind = 'group'").agg(F.max("ord").alias("m"), F.countDistinct("ord").alias("n")).first()
    assert (top.m, top.n) == (1_000_000, 1_000_000)


def test_dossier(spark):
    rows = [("a", 2020, 1, "t", 2.0, 5.0), ("a", 2021, 1, "t", 9.0, 8.0), ("a", 2021, 1, "t", 9.0, 8.5), ("b", 2020, 1, "u", 4.0, None), ("c", 2020, None, "u", None, 3.0)]
    df = spark.createDataFrame(rows, "ra string, ano_base int, fase int, turma string, ieg double, matem double")
    got = {r.ra: r for r in RP.dossiers(df).collect()}
    assert got["a"].latest.ano_base == 2021 and [tuple(h) for h in got["a"].history] == [(2020, 2.0), (2021, 9.0)]
    assert got["a"].place.n_rows == 4 and got["a"].place.share_below == 0.5 and got["a"].factors == []
    assert [f.feature for f in got["b"].factors] == ["IEG"] and got["b"].place.share_below == 0.25
    assert got["c"].place is None and [f.feature for f in got["c"].factors] == ["Matemática"]


def test_full_folding_of_every_code_point(spark):
    """Equal to NFKD without combining marks on every assigned code point, alone and between letters."""
    chars = [chr(cp) for cp in range(0x110000) if not 0xD800 <= cp < 0xE000 and unicodedata.category(chr(cp)) not in ("Cn", "Co")]
    texts = ["".join(f"{c}|" for c in chars[i : i + 200]) for i in range(0, len(chars), 200)] + ["plain", "", "ação ﬁ ½ 한국어 Ａ１"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(8)
    got = {r.i: r.f for r in df.select("i", strip_accents_full(F.col("t")).alias("f")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == "".join(x for c in t for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def test_slug_is_made_of_words(spark):
    pairs = {"  Ação (nova)/2024 ": "acao_nova_2024", "a__b--c": "a_b_c", "x%y": "xy", "%%%": "", "-a.": "a", "A\tB": "a_b"}
    df = spark.createDataFrame([(k, v) for k, v in pairs.items()], "k string, v string")
    assert all(r.got == r.v for r in df.select("v", slug(F.col("k")).alias("got")).collect())
