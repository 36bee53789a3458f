"""The pipeline against brute force, stage by stage on what the stage before it kept."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from panelkit.llm import quality, simhash
from panelkit.llm.common import tokenizer, tokenizer_path


def brute_quality(rows):
    out = []
    for r in rows:
        j = quality.judge(r["text"])
        if j.kept:
            out.append({**r, "text": j.cleaned, "n_chars": r["n_chars"] if j.cleaned == r["text"] else len(j.cleaned)})
    return out


def brute_groups(rows):
    prints = np.array([simhash.fingerprint(r["text"].encode()) for r in rows], np.uint64)
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3):
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i]["doc_id"])
    return list(members.values())


def stages(spark, df, folder):
    """Rows in and out of each stage, written and read as the driver does."""
    docs, seen = df, [df]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        seen.append(docs)
    return seen


def as_dicts(df):
    return [r.asDict() for r in df.collect()]


def key(rows):
    return sorted(str(sorted(r.items(), key=str)) for r in rows)


def check(spark, df, folder):
    raw, clean, told, single, mixed, packed = stages(spark, df, folder)
    for a in (clean, told, single, mixed):
        assert a.columns == df.columns
    assert key(as_dicts(clean)) == key(brute_quality(as_dicts(raw)))
    told_rows = as_dicts(told)
    rest = Counter(key(as_dicts(clean)))
    rest.subtract(Counter(key(told_rows)))
    assert min(rest.values(), default=0) >= 0  # language identification only drops rows
    groups = brute_groups(told_rows)
    kept = [r["doc_id"] for r in as_dicts(single)]
    assert sorted(map(str, kept)) == sorted(str(min((x for x in g if x is not None), default=None)) for g in groups)
    known = {str(r["doc_id"]): r for r in as_dicts(single)}
    mixed_rows = as_dicts(mixed)
    times = Counter(str(r["doc_id"]) for r in mixed_rows)
    assert all(n <= 3 for n in times.values()) and all(r == known[str(r["doc_id"])] for r in mixed_rows)
    tok = tokenizer(tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for r in mixed_rows:
        ids = np.asarray([*tok.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want.update((r["doc_id"], p, a, z - a, zlib.crc32(ids[a:z].tobytes())) for p, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)))
    got = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    return told_rows, got


def test_stages_on_a_table(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told, got = check(spark, df, str(tmp_path))
    clean = {r["doc_id"] for r in brute_quality(as_dicts(df))}
    assert len({r["doc_id"] for r in told}) >= 0.99 * len(clean)  # clean documents stay
    assert got


def test_stages_on_odd_rows(spark, docs, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(6))
    good = [". ".join(" ".join(word() for _ in range(8)) for _ in range(9)) + "." for _ in range(20)]
    rows = [(i, good[i % 20], ["en", None][i % 2], ["a", "b", None][i % 3]) for i in range(60)] + [(3, good[3], "en", "a")] * 3 + [(None, good[4]), (None, None), (70, ""), (71, None), (72, "word " * 40_000), (73, good[5], "de", "b")]
    df = docs(rows).withColumn("row", F.lit("clash")).withColumn("__judged", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("key", F.lit("k"))
    check(spark, df, str(tmp_path))


def test_empty_table(spark, docs, tmp_path):
    assert stages(spark, docs([]), str(tmp_path))[-1].count() == 0


def test_run_is_registered(spark):
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} >= {f"op{n}" for n in (1, 2, 3, 5, 6, 8, 9)}
    assert names["pipeline"](spark, "/root/testdata/sf0.001").count() > 0
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]


@pytest.mark.parametrize("name", ["panelkit.plans.registry", "panelkit.session"])
def test_nothing_else_imports_the_subpackage(name):
    import subprocess
    import sys

    code = f"import sys, {name} as m; getattr(m, 'load_all', lambda: 0)(); sys.exit(any(x.startswith('panelkit.llm') for x in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd="/root/repo", check=False).returncode == 0
