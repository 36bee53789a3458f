"""Mixing against SQL, iterated resharing and its own bounds."""

from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from panelkit.llm import mixing

WORDS = "a b c d e f g h i j".split()


def text(n):
    return " ".join(WORDS[i % 10] for i in range(n))


ROWS = (
    [(i, text(i % 7), "en", "big") for i in range(150)] + [(1000 + i, text(30 + i), "en", f"s{i % 4}") for i in range(40)]
    + [(2000 + i, text(2), "en", None) for i in range(5)] + [(7, None, "en", "nothing"), (None, text(5), "en", "big"), (3, text(3), "en", "big"), (3, text(3), "en", "big"), (5, text(90000), "en", "é")]
)


def targets(sizes):
    """Shares by weight, the excess over three times a source dealt out again until none is left."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(fixed.values())
        open_ = [s for s in names if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in above}


@pytest.fixture(scope="module")
def mixed(spark):
    df = spark.createDataFrame([(a, b, c, d, 0) for a, b, c, d in ROWS], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    clash = df.withColumn("size", F.lit("clash")).withColumn("copies", F.lit(9)).withColumn("key", F.lit(1)).withColumn("row", F.lit(2)).withColumn("a.b", F.lit(0))
    return clash, [r.asDict() for r in mixing.mixture(clash).collect()]


def test_targets_and_words_taken(mixed):
    got = mixed[1]
    sizes = defaultdict(int)
    for _, t, _, s in ROWS:
        sizes[s] += len((t or "").split())
    want = targets(sizes)
    assert len(got) == len(ROWS)
    by_size = {round(v, 6) for v in want.values()}
    assert {round(r["target"], 6) for r in got} == by_size
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for r in got:
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        taken[r["target"]] += r["taken"]
        largest[r["target"]] = max(largest[r["target"]], r["size"])
    assert all(abs(taken[t] - t) <= 2 * largest[t] for t in taken)


def test_documents_are_repeated(spark, mixed):
    df, got = mixed
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert sum(len((r.text or "").split()) for r in rows) == sum(r["taken"] for r in got)
    assert sorted(map(str, mixing.mixed_documents(df).collect())) == sorted(map(str, rows))  # reruns agree


def test_sql(spark, mixed):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [list(r) for r in ROWS])
    cur = con.execute(mixing.SQL)
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    key = lambda r: tuple(str(r[k]) for k in sorted(r))
    assert sorted(map(key, mixed[1])) == sorted(map(key, want))


def test_empty(spark, docs):
    assert mixing.mixture(docs([])).count() == 0
    assert mixing.mixed_documents(docs([])).count() == 0
    assert [r.taken for r in mixing.mixture(docs([(1, None)])).collect()] == [0]


def test_no_python(spark, docs):
    plan = mixing.mixed_documents(docs([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
