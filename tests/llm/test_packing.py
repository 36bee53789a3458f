"""Packing: whole documents, gapless sequences, bins near the bound."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from panelkit.llm import packing
from panelkit.llm.common import tokenizer, tokenizer_path


def layout(rules, counts):
    """Pieces of each bin as (offset, length), from the rules."""
    bins, seen = defaultdict(list), Counter()
    for length, lo, hi, first, per_bin, at in rules:
        assert lo == seen[length]  # ranks follow one another
        seen[length] = hi
        for k in range(hi - lo):
            bins[first + k // per_bin].append((at + k % per_bin * length, length))
    assert seen == Counter({n: c for n, c in counts.items() if c})
    return bins


def test_plan_fills_bins_without_gaps():
    rng = random.Random(1)
    for cap in (10, 64, 1024):
        for _ in range(30):
            counts = Counter(min(cap, max(1, int(rng.expovariate(3 / cap)))) for _ in range(rng.randint(1, 800)))
            rules, n = packing.plan_bins(counts, cap)
            bins = layout(rules, counts)
            assert len(bins) == n
            for held in bins.values():
                held.sort()
                at = 0
                for offset, length in held:
                    assert offset == at
                    at += length
                assert at <= cap
                assert sum(3 * length > cap for _, length in held) <= 2
            total = sum(k * c for k, c in counts.items())
            assert n <= max(-(-total // cap) * 1.25 + 1, sum(c for k, c in counts.items() if 2 * k > cap) * 1.1 + 1)


def test_plan_matches_large_items():
    rules, n = packing.plan_bins({600: 2, 400: 3, 20: 5}, 1024)
    assert n == 3  # 600 + 400 (+ 20), 600 + 400 (+ 20), 400 + the rest
    assert packing.plan_bins({}, 1024) == ([], 0)
    assert packing.plan_bins({1024: 7}, 1024)[1] == 7
    assert packing.plan_bins({500: 7}, 1024)[1] == 4


def test_rules_do_not_grow_with_the_corpus():
    rng = random.Random(2)
    small = {n: rng.randint(1, 9) for n in range(1, 1025)}
    assert len(packing.plan_bins({n: c * 10**6 for n, c in small.items()}, 1024)[0]) < 20_000


def brute(rows, cap):
    tok = tokenizer(tokenizer_path("byte_bpe_50k.json"))
    out = []
    for i, t in rows:
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % cap or cap, len(ids) + 1, cap)]
        out += [(i, p, a, z - a, zlib.crc32(ids[a:z].tobytes())) for p, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return sorted(out, key=str)


def check(got, rows, cap):
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == brute(rows, cap)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= cap
    return len(held)


def test_pack(spark, docs):
    rng = random.Random(5)
    rows = [(i % 40 or None, " ".join("word" for _ in range(rng.choice([0, 1, 5, 30, 200])))) for i in range(120)] + [(7, None), (8, "x y " * 4000)]
    df = docs(rows).withColumn("sequence_id", F.lit("clash")).withColumn("length", F.lit(1))
    packed = packing.pack(df, "byte_bpe_50k.json", capacity=64, keep_ids=True)
    got = packed.collect()
    n = check(got, rows, 64)
    assert n <= sum(r.length for r in got) / 64 * 1.1 + 1
    seqs = packing.sequences(packed).collect()
    assert len(seqs) == n
    by = {(r.sequence_id, r.offset): np.frombuffer(r.ids, "<u4").tolist() for r in packed.collect()}
    for s in seqs:
        at = 0
        for length in s.lengths:
            assert s.input_ids[at : at + length] == by[s.sequence_id, at]
            at += length


def test_pack_empty(spark, docs):
    assert packing.pack(docs([]), "byte_bpe_50k.json").count() == 0


def test_pack_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = packing.pack(spark.read.parquet(f"{d}/documents.parquet"), "byte_bpe_50k.json").collect()
    n = check(got, rows, 1024)
    assert n <= sum(r.length for r in got) / 1024 + 2


def test_tasks_share_an_encoder_and_give_memory_back(monkeypatch):
    import pyarrow as pa

    class Task:
        get = partitionId = staticmethod(lambda: Task)

    Task.partitionId = staticmethod(lambda: 3)
    freed, path = [], tokenizer_path("byte_bpe_50k.json")
    monkeypatch.setattr("pyspark.TaskContext", Task)
    monkeypatch.setattr(packing, "give_back", lambda: freed.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1, None]), pa.array(["a b " * 9, None])], names=["doc_id", "text"])
    for n in (1, 2):
        got = [r for b in packing._pieces(iter([batch]), path, 8, 2, False) for r in b.to_pylist()]
        assert [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got] == sorted(brute([(1, "a b " * 9), (None, None)], 8), key=lambda r: (r[0] is None, r[1]))
        assert len(freed) == 2 * n  # before the first text, of what other stages left, and after the last
    assert packing.encoder(path) is packing.encoder(path)
