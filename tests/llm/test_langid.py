"""The recurrent network: its gradients, its windows, and accuracy on documents that it did not learn from."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import langid
from panelkit.llm.queries import QUERIES

LETTERS = {"aa": "abcde ", "oo": "opqrs ", "éé": "éèçàü "}


def text(lang, n, seed):
    rng = random.Random(f"{lang}{n}{seed}")
    return "".join(rng.choice(LETTERS[lang]) for _ in range(n))


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = langid.Network.new(["a", "b", "c"], 4)
    net.w = {k: v.astype(np.float64) * 3 for k, v in net.w.items()}
    x = rng.integers(97, 101, (7, 5)).astype(np.uint8)
    real = (np.arange(7)[:, None] < np.array([7, 5, 7, 1, 6])).astype(np.float32)
    label = np.array([0, 1, 2, 1, 0])
    _, grad = langid.gradients(net, x, real, label)
    for name, w in net.w.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in w.shape)
            if name[0] == "x":
                at = (int(rng.integers(97, 101)), at[1])
            old = w[at]
            w[at] = old + 1e-2
            up = langid.gradients(net, x, real, label)[0]
            w[at] = old - 1e-2
            down = langid.gradients(net, x, real, label)[0]
            w[at] = old
            assert grad[name][at] == pytest.approx((up - down) / 2e-2, abs=2e-3, rel=2e-2), (name, at)


def test_every_position_is_pooled(monkeypatch):
    """Side-by-side windows of texts of all lengths give what each text gives alone."""
    net = langid.Network.new(["a", "b"], 4)
    texts = [b"", b"x", bytes(range(97, 120)) * 40, b"yz" * 64, b"q" * 129]
    monkeypatch.setattr(langid, "SIDE_BY_SIDE", 3)
    together = langid.document_probabilities(net, texts)
    alone = np.concatenate([langid.document_probabilities(net, [t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)
    assert np.allclose(together.sum(axis=1), [0, 1, 1, 1, 1], atol=1e-4)


def rows():
    out = [(i, text(lang, 300, i), lang) for i, lang in enumerate(list(LETTERS) * 40)]
    return out + [(500, None, "aa"), (501, "", "oo"), (502, "12 3!? \n", "aa"), (None, text("oo", 200, 1), "oo"), (503, text("aa", 200, 2), None), (503, text("aa", 200, 2), None), (504, text("éé", 60_000, 3), "éé")]


def test_languages(spark, docs, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 60)
    df = docs(rows()).withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit("x"))
    got = langid.languages(df).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    for i, t, lang in rows():
        r = by[i]
        assert r.held_out == (zlib.crc32(str(i if i is not None else "").encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if i in (500, 501, 502):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == (lang or "aa")
    kept = langid.identified_documents(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted((i or 0) for i, _, _ in rows() if i not in (500, 501, 502))


def test_nothing_to_learn_from(spark, docs):
    assert langid.languages(docs([])).count() == 0
    assert {r.lang_pred for r in langid.languages(docs([(1, "abc", None), (2, "def", None)])).collect()} == {"und"}
    assert {r.lang_pred for r in langid.languages(docs([(1, "abc def", "aa"), (3, "abc", "aa")])).collect()} == {"aa"}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op8_language_id"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred != 'und'").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)


def test_a_repeated_row_is_learnt_once(spark):
    """20,000 copies of the only French row: its language is learnt, from as many windows as one row gives."""
    from panelkit.llm.langid import training_windows

    for row_id in (1, 2, 3):  # some ids are held out of training
        df = spark.range(20_000, numPartitions=4).selectExpr(f"CAST({row_id} AS BIGINT) AS doc_id", "repeat('Le chat est sur la table. ', 30) AS text", "'fr' AS lang")
        windows = training_windows(df)
        assert len(windows) in (0, 4) and {lang for lang, _ in windows} <= {"fr"}
        if windows:
            break
    assert windows


def test_the_sample_is_bounded(spark):
    from panelkit.llm import langid

    df = spark.range(5_000, numPartitions=4).selectExpr("id AS doc_id", "concat('word ', id) AS text", "IF(id % 2 = 0, 'a', 'b') AS lang")
    windows = langid.training_windows(df)
    for lang in "ab":
        n = sum(x == lang for x, _ in windows)
        assert 0.7 * langid.SAMPLE_DOCS < n <= 2 * langid.SAMPLE_DOCS * langid.SAMPLE_WINDOWS
