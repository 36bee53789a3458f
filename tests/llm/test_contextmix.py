"""Language-model scores: exact base figures, proper probabilities, and held-out texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelkit.llm import contextmix as cm
from panelkit.llm.queries import QUERIES


def brute(rows):
    """(doc_id, held_out, n_tokens, n_known, N, base) of each row."""
    read = [(i, zlib.crc32(str("" if i is None else i).encode()) % 7 == 2, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    counts = Counter(w for _, held, words in read if not held for w in words)
    n, v = sum(counts.values()), len(counts)
    return [(i, held, len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 1) / (n + v)) for w in words)) for i, held, words in read]


def check(got, rows):
    key = lambda r: tuple(str(x) if not isinstance(x, float) else f"{x:012.4f}" for x in r)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    for a, b in zip(got, sorted(brute(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    return [" ".join(rng.choice(words).capitalize() + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(0, 120))) for _ in range(n)]


ROWS = [(i, t) for i, t in enumerate(texts(90, 1))] + [(3, "x"), (3, "x"), (None, "no id"), (200, None), (201, ""), (202, " \t "), (203, "long" * 5000 + " tail"), (204, "long" * 5000), (210, "q" * cm.CUT + " " + "r" * (cm.CUT - 1)), (211, "unseen words only here zzz zzz")]


@pytest.mark.parametrize("head", [cm.HEAD, 5, 0])
def test_base_figures(spark, docs, head):
    """Whatever part of the words is broadcast."""
    df = docs(ROWS).withColumn("data", F.lit("clash")).withColumn("score", F.lit(0)).withColumn("row", F.lit(1))
    got = cm.scored(df, head=head).collect()
    check(got, ROWS)
    assert all(r.score < 0 and math.isfinite(r.score) and r.bits_per_byte > 0 for r in got)
    again = {(r.doc_id, r.n_tokens, round(r.score, 6)) for r in cm.scored(docs(ROWS, 5), head=head).collect()}
    assert {(r.doc_id, r.n_tokens, round(r.score, 6)) for r in got} == again  # partitions don't matter


def test_empty_and_untrained(spark, docs):
    assert cm.scored(docs([])).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = cm.scored(docs([(held, "a b")])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, None)
    assert row.score == pytest.approx(row.n_bytes * 8 * math.log10(0.5), rel=0.01)


ONE = cm.Kinds([], np.zeros((1, 0)), np.zeros(1))


def small_model(seed=2):
    units = Counter(u for t in texts(60, seed) for u in cm.text_units(t.encode(), ONE)[0])
    names = sorted(units)
    filled = list(cm._fill(iter([pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([units[u] for u in names])], names=["u", "c"])])))
    return cm.assemble([cm._finish(pa.Table.from_batches([b])).to_pylist()[0] for b in filled]), units


def binned(model, units, names=None, lead=cm.LEAD):
    names = sorted(units) if names is None else names
    return cm.Bin(model, names, np.full(len(names), lead), np.array([units[u] for u in names]))


@pytest.mark.parametrize("lead", [0, cm.LEAD, 9])
def test_bytes_have_proper_probabilities(lead):
    model, units = small_model()
    counted = sorted(units)
    for prefix in (b"\x01", b"\x01ab", b"\x05abc", b"\x05zzzz"):
        asked = [prefix, *(prefix + bytes([b]) for b in range(256))]
        got = binned(model, units, counted + [u for u in asked if len(u) > 1], lead).score()
        of = dict(zip(counted + [u for u in asked if len(u) > 1], got, strict=True))
        assert sum(10 ** (of[u] - of.get(prefix, 0.0)) for u in asked[1:]) == pytest.approx(1, abs=1e-6)


def test_learning_helps():
    model, units = small_model()
    other = small_model(9)[1]
    names = sorted(units | other)
    counts, fresh = np.array([other[u] for u in names]), binned(model, units, names)
    before = (fresh.score() * counts).sum()
    model.weights, seen = fresh.learn(counts)
    assert seen.sum() == pytest.approx(8 * sum((len(u) - 1) * other[u] for u in names))
    assert (binned(model, units, names).score() * counts).sum() > before


def test_contexts_tell_positions_apart():
    row, before, byte, ctx = cm.contexts([b"\x01ab ", b"\x02ab ", b"\x01abc ", b"\x01\n"])
    assert bytes(byte) == b"ab ab abc \n" and row.tolist() == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2, 3]
    assert before.tolist() == [0, 1, 2, 0, 1, 2, 0, 1, 2, 3, 0]
    for k in range(cm.PREDICTORS):
        assert ctx[k][0] == ctx[k][6] == ctx[k][10] and ctx[k][1] == ctx[k][7]  # same mark, same bytes before
        assert (ctx[k][1] == ctx[k][4]) == (k not in (2, 5))  # the word before enters two of them


def test_repeats_are_a_running_estimate():
    rng = np.random.default_rng(0)
    p = np.array([0.5, 0.3, 0.2])
    units = rng.integers(0, 3, 50)
    want, seen = 0.0, Counter()
    for i, u in enumerate(units.tolist()):
        want += math.log10((seen[u] + cm.ADAPT * p[u]) / (i + cm.ADAPT))
        seen[u] += 1
    assert cm.repeats(units, np.log10(p[units])) - cm.places(50) == pytest.approx(want)


def test_marks_name_the_word_before():
    units, cut = cm.text_units(b"The cat of THE longer word", ONE)
    assert [u[1:] for u in units] == [b"the ", b"cat ", b"of ", b"the ", b"longer ", b"word ", b"\n"] and not cut
    assert units[0][0] == cm._START and units[1][0] == units[4][0] and units[5][0] == units[6][0] == cm._LONG
    assert len({units[i][0] for i in (0, 1, 3, 5)}) >= 3


@pytest.mark.parametrize("head", [7, 0])
def test_score_does_not_depend_on_the_head(spark, docs, head):
    figures = lambda df: sorted((r.doc_id or -1, r.n_bytes, r.score) for r in df.collect())
    for a, b in zip(figures(cm.scored(docs(ROWS), head=head)), figures(cm.scored(docs(ROWS))), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9)


def test_hot_leads_are_split(spark, docs, monkeypatch):
    """Bins stay small where many words share their first bytes; every unit is in one bin with all of its lead."""
    monkeypatch.setattr(cm, "BIN_BYTES", 400)
    words = [f"user{i:05d}" for i in range(400)] + [f"w{i}" for i in range(50)]
    units = cm.count_units(docs([(i, " ".join(words[i::5])) for i in range(5)]).selectExpr("doc_id", "false held_out", "cast(text as binary) data"), ONE)
    rows = cm.binned(units).collect()
    assert len(rows) == units.count()
    bins = {}
    for r in rows:
        key = bytes(r.unit[1 : 1 + r.lead])
        assert bins.setdefault(key, r.bin) == r.bin
    assert {r.lead for r in rows} >= {cm.LEAD, 12}
    got = cm.scored(docs([(i, " ".join(words[i::5])) for i in range(5)])).collect()
    assert all(math.isfinite(r.score) for r in got)


def test_word_order_counts(spark):
    """The words of held-out texts in random order score worse than the texts."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in table.collect() if r.text]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 2]
    rng, free = random.Random(0), iter(i for i in range(10**9, 2 * 10**9) if zlib.crc32(str(i).encode()) % 7 == 2)
    mixed = {next(free): (i, rng.sample(t.split(), len(t.split()))) for i, t in held}
    given = rows + [(new, " ".join(words)) for new, (_, words) in mixed.items()]
    score = {r.doc_id: r.score for r in cm.scored(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    assert sum(score[new] for new in mixed) < sum(score[i] for i, _ in mixed.values())


def test_held_out_texts_of_a_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op4_lm_scores"](spark, d).collect()
    check(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # better than the unigram baseline
    assert 1 < sum(-r.score for r in held) / math.log10(2) / sum(r.n_bytes for r in held) < 3


def test_blocks_survive_squeezing():
    counts = np.random.default_rng(1).poisson(0.3, 2 * 4096).astype(np.float32) * 1000
    assert (cm._unsqueezed(cm._squeezed(counts)) == counts).all()


def fill(units, counts):
    batch = pa.RecordBatch.from_arrays([pa.array(units, pa.binary()), pa.array(counts, pa.int64())], names=["u", "c"])
    sums = {}
    for b in cm._fill(iter([batch])):
        sums.setdefault((b["predictor"][0].as_py(), b["block"][0].as_py()), []).append(b)
    return {k: cm._unsqueezed(cm._sum(pa.Table.from_batches(v))["data"][0].as_py()) for k, v in sums.items()}


def test_large_counts_are_exact():
    units, counts = [b"Aab ", b"Bab ", b"Aac "], [(1 << 24) + 1, 3 * (1 << 33) + 7, 1]
    got, alone = fill(units, counts), [fill([u], [1]) for u in units]
    for key, table in got.items():
        assert (table == sum(c * a.get(key, np.zeros(2 * cm._BLOCK, np.int64)) for c, a in zip(counts, alone, strict=True))).all()


def test_weights_see_whole_counts():
    model, units = small_model()
    names = sorted(units)
    learned = [binned(model, units, names).learn(np.array([times if i == 0 else 1 for i in range(len(names))]))[0] for times in (50, 5000)]
    assert np.isfinite(learned).all() and not np.allclose(*learned)


def kinds_input(spark, n, parts):
    topics = [b"alpha beta gamma", b"uno dos tres", b"eins zwei drei"]
    rows = [(i, bytearray(topics[i % 3] + b" common" * (1 + i % 4) if i % 100 else b" ")) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, data binary").repartition(parts)


def test_kinds_come_from_all_training_documents(spark):
    n = 4100  # twice what a sample would hold
    kinds = cm.fit_kinds(kinds_input(spark, n, 3))
    assert round(float((np.exp(kinds.prior) - 1).sum())) == n - len(range(0, n, 100))  # every text with a word is in a kind
    assert set(kinds.at) == set(b"alpha beta gamma uno dos tres eins zwei drei common".split())
    last = {topic.split()[0]: kinds.along(topic.split() * 3)[-1] for topic in (b"alpha beta gamma", b"uno dos tres", b"eins zwei drei")}
    assert len(set(last.values())) == 3  # the topics are told apart


def test_kinds_do_not_depend_on_partitions(spark):
    one, many = (cm.fit_kinds(kinds_input(spark, 500, parts)) for parts in (1, 7))
    assert list(one.at) == list(many.at)
    assert np.allclose(one.table, many.table) and np.allclose(one.prior, many.prior)


def test_kinds_of_no_text(spark):
    assert cm.fit_kinds(spark.createDataFrame([(1, bytearray(b"")), (2, bytearray(b" "))], "doc_id long, data binary")).kinds == 1


def test_places_are_the_units_of_the_texts():
    kinds = cm.Kinds([b"the", b"la"], np.log(np.array([[0.9, 0.1], [0.2, 0.8]])), np.log(np.array([3.0, 2.0])))
    given = [None, b"", b" \t ", b" The la la ", "É la\x0bà the\x1cx\x85y".encode(), b"a\xff\xfe b", b"x" * cm.CUT + b" la", b"la " * 50 + b"the " * 300 + b"end", b"w" * (cm.CUT - 1)]
    places = cm.Places(pa.array([b"off", *given], pa.binary()).slice(1), kinds)
    assert places.cut.tolist() == [len(t or b"") > cm.CUT and b" " in t and t[:1] == b"x" for t in given]
    left = [t for t, cut in zip(given, places.cut, strict=True) if not cut]
    names = places.units.to_pylist()
    got = [[names[u] for u in places.unit[places.text == i]] for i in range(len(left))]
    assert got == [cm.text_units(t, kinds)[0] for t in left]
    assert places.n_bytes.tolist() == [sum(len(u) - 1 for u in units) for units in got]


def test_kinds_named_in_parts(monkeypatch):
    rng = np.random.default_rng(5)
    kinds = cm.Kinds([b"%d" % i for i in range(20)], np.log(rng.dirichlet(np.ones(20), 4)), np.log(rng.random(4)))
    at, text = rng.integers(-1, 20, 500), np.sort(rng.permutation(np.r_[np.arange(40), rng.integers(0, 40, 460)]))
    whole = kinds.named(at, text)
    assert len(set(whole.tolist())) > 1
    for part in (1, 7, 64):
        monkeypatch.setattr(cm, "_PLACES", part)
        assert (kinds.named(at, text) == whole).all()


def test_a_bin_keeps_common_bytes_once():
    """Memory and work of a bin go by the distinct beginnings of its units, not by all their bytes."""
    model, units = small_model()
    names = [mark + b"prefixes" * 20 + b"%03d " % i for mark in (b"\x01", b"\x02") for i in range(200)]
    bin_ = cm.Bin(model, names, np.full(len(names), 3), np.ones(len(names)))
    beginnings = {u[:i] for u in names for i in range(2, len(u) + 1)}
    assert len(bin_.byte) == len(beginnings) < sum(map(len, names)) / 20
    alone = cm.Bin(model, sorted(units), np.full(len(units), 3), np.array([units[u] for u in sorted(units)]))
    mixed = random.Random(0).sample(sorted(units), len(units))
    again = cm.Bin(model, mixed, np.full(len(units), 3), np.array([units[u] for u in mixed]))
    assert dict(zip(sorted(units), alone.score().tolist(), strict=True)) == dict(zip(mixed, again.score().tolist(), strict=True))


def test_tally_hands_on_when_full(monkeypatch):
    monkeypatch.setattr(cm, "FLUSH", 10)
    tally = cm.Tally(["k"], ["n"])
    out = [b for i in range(30) for b in tally.add(pa.table({"k": [b"%d" % (i * j % 37) for j in range(9)], "n": [1] * 9}))]
    assert out and tally.rows <= 20 + 9
    got, want = Counter(), Counter(b"%d" % (i * j % 37) for i in range(30) for j in range(9))
    for b in [*out, *tally.rest()]:
        got.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
    assert got == want


def test_repeated_equals_the_run():
    rng = np.random.default_rng(3)
    p, times = rng.dirichlet(np.ones(6)), np.array([1, 2, 5, 1, 40, 3])
    assert cm.repeated(np.log10(p), times).sum() == pytest.approx(cm.repeats(np.repeat(np.arange(6), times), np.repeat(np.log10(p), times)))


def test_a_tally_gives_memory_back_whenever_it_adds_up(monkeypatch):
    freed = []
    monkeypatch.setattr(cm, "FLUSH", 10)
    monkeypatch.setattr(cm, "give_back", lambda: freed.append(1))
    tally = cm.Tally(["k"], ["n"])
    got = [b for i in range(6) for b in tally.add(pa.table({"k": np.arange(15) + i, "n": np.ones(15, np.int64)}))]
    assert len(freed) == 3
    assert sum(sum(b.column(1).to_pylist()) for b in [*got, *tally.rest()]) == 90


def test_few_counts_of_a_block_take_few_bytes():
    for kind in (np.uint32, np.int64, np.float64):
        for at in ([], [0], [65535], [0, 7, 300, 65535]):
            counts = np.zeros(1 << 16, kind)
            counts[at] = np.arange(len(at)) + 1000
            got = cm._unsqueezed(cm._squeezed(counts))
            assert got.dtype == kind and (got == counts).all()
            assert len(cm._squeezed(counts)) < 150


def test_shared_tables_take_a_context_once_for_all_its_units(monkeypatch):
    monkeypatch.setattr(cm, "SHARED_BITS", (15, 15, 15))
    units = [bytes([0]) + bytes([x, y]) + b"stitute " for x in b"abcdefgh" for y in b"abcdefgh"]
    counts = np.arange(len(units)) + 1
    expected = [np.zeros(2 << 15, np.int64) for _ in range(cm.SHARED)]
    row, _, byte, ctx = cm.contexts(units, predictors=cm.SHARED)
    for b in range(8):
        node, bit = (1 << b) | (byte.astype(np.int64) >> (8 - b)), (byte >> (7 - b)) & 1
        for k in range(cm.SHARED):
            np.add.at(expected[k], 2 * cm._slots(15, ctx[k], node) + bit, counts[row])
    looked_up, slots = [], cm._slots
    monkeypatch.setattr(cm, "_slots", lambda bits, context, node: looked_up.append(len(context)) or slots(bits, context, node))
    found = pa.Table.from_batches(cm._fill(iter([pa.RecordBatch.from_pydict({"unit": pa.array(units, pa.binary()), "c": pa.array(counts)})]))).to_pylist()
    for k in range(cm.SHARED):
        blocks = {r["block"]: cm._unsqueezed(r["data"]) for r in found if r["predictor"] == k}
        assert (np.concatenate([blocks[b] for b in sorted(blocks)]) == expected[k]).all()
    assert max(looked_up) < len(byte) / 2


def test_fits_of_lists_equal_those_of_whole_rows():
    rng = np.random.default_rng(2)
    counts = rng.poisson(0.3, (40, 30)).astype(np.float64)
    counts[:, 0] += 1
    table = rng.normal(size=(5, 30))
    text, at = np.nonzero(counts)
    start = np.flatnonzero(np.diff(text, prepend=-1))
    n = counts[text, at].astype(np.int64)
    assert np.allclose(cm._fits(at, n, start, table, False), table @ counts.T)
    assert np.allclose(cm._fits(at, n, start, table, True), table @ cm._shape(counts).T)
