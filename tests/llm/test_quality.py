"""Quality rules against SQL, direct figures and clean or spoilt texts."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from panelkit.llm import quality

_RNG = random.Random(4)
GOOD = "\n".join("The " + " ".join("".join(_RNG.choice("aeioulmnrst") for _ in range(6)) for _ in range(9)) + " river." for _ in range(12))
ROWS = [
    (1, GOOD), (1, GOOD), (None, GOOD), (2, None), (3, ""), (4, " \n\t\n"), (5, "short text."), (6, "Same words again. " * 60),
    (7, GOOD + "\nHome | Login | Contact | About\nAll rights reserved."), (8, "\n".join(["THIS IS SHOUTED LOUD!! BUY NOW!!"] * 3 + [f"THE{i}!! OFFER{i}!! ENDS{i}!!" for i in range(40)])),
    (9, " | ".join(f"item{i}" for i in range(80)) + "."), (10, "\n".join(f"a{i}### b{i}$$$ c{i}%%% d{i}&&& e{i}." for i in range(20))),
    (11, GOOD + "\n" + GOOD), (12, "x\x1cy é 漢字 " + GOOD.replace("river", "Fluß ")), (13, "wrapped line of running text, which goes on and on without an end\n" * 2 + GOOD),
    (14, " ".join(f"w{i}" for i in range(30_000)) + "."), (15, "\n".join(f"Title {i}" for i in range(60))),
]


def figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {p + k for p, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if wins[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), failed


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("kept", F.lit("clash")).withColumn("j", F.lit(0))
    return quality.quality_figures(df).collect()


def test_base_figures(spark):
    rows = got(spark, ROWS)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows), key=str) == sorted(((i, *figures(t)) for i, t in ROWS), key=str)
    assert {r.doc_id: r.kept for r in rows if r.doc_id} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: True, 8: False, 9: False, 10: False, 11: False, 12: True, 13: True, 14: True, 15: False}
    assert quality.quality_figures(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in ROWS])
    cur = con.execute(quality.SQL)
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    key = lambda r: str(sorted(r.items()))
    assert sorted(key(r.asDict()) for r in got(spark, ROWS)) == sorted(map(key, want))


def test_cleaned_documents(spark, docs):
    df = docs([(i, t) for i, t in ROWS]).withColumn("judged", F.lit("clash")).withColumn("__judged", F.lit(1)).withColumn("a.b", F.lit(2))
    out = quality.cleaned_documents(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 1, 7, 12, 13, 14]
    assert {r.text for r in rows if r.doc_id in (None, 1)} == {GOOD}  # clean texts stay as they are
    cut = next(r for r in rows if r.doc_id == 7)
    assert cut.text == GOOD and cut.n_chars == len(GOOD)


@pytest.mark.parametrize(("line", "rule"), [("Home | News | Sport", "punctuation"), ("a. | b. | c.", "navigation"), ("Home. Login. Search.", "navigation"), ("BUY THE NEW MODEL.", "boilerplate"), ("We use cookies on this site.", "boilerplate"), ("Plain words, as they come.", None), ("He asked: why? Nobody knew!", None)])
def test_line_rules(line, rule):
    assert quality.line_fails(line.encode(), line.encode().split()) == rule


def test_labelled_documents(spark):
    """Documents labelled good stay unless the base rules fail them; most labelled bad go."""
    d = "/root/testdata/sf0.01"
    rows = quality.quality_figures(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1 and not r.base_failed], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(r.kept for r in bad) <= 0.15 * len(bad)
